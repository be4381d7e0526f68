"""Sinks: reports and exports. Each is a DataFrame of lines or a Spark writer's table."""
