"""Sources: files, what they contain, and their history."""
