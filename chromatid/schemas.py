"""Schemas of the data model and its small dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Drift types with their default severity and label.
DRIFT_TYPES = {
    "deprecated-pattern": ("warning", "Deprecated Pattern"),
    "accessibility-conflict": ("critical", "Accessibility Conflict"),
    "semantic-mismatch": ("warning", "Semantic Mismatch"),
    "orphaned-component": ("info", "Orphaned Component"),
    "orphaned-token": ("info", "Orphaned Token"),
    "value-divergence": ("warning", "Value Divergence"),
    "naming-inconsistency": ("info", "Naming Inconsistency"),
    "missing-documentation": ("info", "Missing Documentation"),
    "hardcoded-value": ("warning", "Hardcoded Value"),
    "framework-sprawl": ("warning", "Framework Sprawl"),
    "unused-component": ("warning", "Unused Component"),
    "unused-token": ("info", "Unused Token"),
    "color-contrast": ("critical", "Color Contrast"),
    "repeated-pattern": ("info", "Repeated Pattern"),
}
# Severities by rank, from 0.
SEVERITIES = ("info", "warning", "critical")

PROP = "struct<name: string, type: string, required: boolean, defaultValue: string, description: string>"
SOURCE = "struct<type: string, path: string, exportName: string, line: int, fileKey: string, nodeId: string, storyId: string, kind: string, url: string>"
#: Components as scanners give them; seq is the input order that first-wins and last-wins rules need.
COMPONENTS = (
    f"seq long, id string, name string, source {SOURCE}, props array<{PROP}>, variants array<struct<name: string, props: map<string, string>>>,"
    " dependencies array<string>, metadata struct<deprecated: boolean, deprecationReason: string, tags: array<string>,"
    " accessibility: struct<hasAriaLabel: boolean, hasRole: boolean, issues: array<string>>, documentation: string,"
    " hardcodedValues: array<struct<type: string, value: string, property: string, location: string>>, compoundGroup: string, isCompoundRoot: boolean>"
)
#: Design tokens; value_key is the typed value in one string, as tokens compare.
TOKENS = "seq long, id string, name string, category string, kind string, hex string, number double, unit string, raw string, source string, path string, deprecated boolean"
#: Drift signals, flattened.
SIGNALS = (
    "seq long, id string, type string, severity string, entity_type string, entity_id string, entity_name string, location string, message string,"
    " expected string, actual string, suggestions array<string>, token_suggestions array<string>, detected_at timestamp"
)
NODES = "seq long, id string, type string, name string, author string, timestamp timestamp, deprecated boolean"
EDGES = "seq long, id string, type string, src string, dst string"


def struct_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES[0], 0)
    for rank, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == name, rank)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def default_severity(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (s, _) in DRIFT_TYPES.items() for x in (k, s)])[kind]


def token_value_key(kind: Column, hex_: Column, number: Column, unit: Column, raw: Column) -> Column:
    """The typed value that tokens are equal by: colors by lower-case hex, lengths by number and unit, others by their text."""
    return (
        F.when(kind == "color", F.concat(F.lit("color:"), F.lower(hex_)))
        .when(kind == "spacing", F.concat(F.lit("spacing:"), number.cast("string"), unit))
        .otherwise(F.concat(kind, F.lit(":"), raw))
    )
