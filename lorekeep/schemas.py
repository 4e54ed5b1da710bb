"""The eight catalog tables as data: columns, unique keys, references between tables, severities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# fixed values: severities from mildest to strictest
SEVERITY_RANK = {"Avoid": 0, "StronglyAvoid": 1, "Never": 2}


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


def _int(name: str, nullable: bool = False) -> tuple:
    return name, T.IntegerType(), nullable


def _text(name: str, nullable: bool = False) -> tuple:
    return name, T.StringType(), nullable


def _flag(name: str) -> tuple:
    return name, T.BooleanType(), False


_CREATED = ("CreatedAt", T.TimestampNTZType(), False)

SCHEMAS: dict[str, T.StructType] = {
    "coding_patterns": _table(_int("Id"), _text("Name"), _text("Description"), _text("Category"), _text("Example", True), _flag("IsActive"), _CREATED),
    "design_preferences": _table(_int("Id"), _text("Category"), _text("Preference"), _text("Rationale", True), _int("Priority"), _CREATED),
    "avoidance_rules": _table(_int("Id"), _text("Name"), _text("Description"), _text("Category"), _text("Severity"), _CREATED, _int("PreferredAlternativeId", True)),
    "architecture_patterns": _table(_int("Id"), _text("Name"), _text("Description"), _text("Diagram", True), _flag("IsActive"), _CREATED),
    "architecture_layers": _table(_int("Id"), _int("PatternId"), _text("Name"), _text("Description"), _text("Responsibility"), _text("Contains", True), _int("Order")),
    "layer_dependencies": _table(_int("Id"), _int("SourceLayerId"), _int("TargetLayerId"), _flag("IsAllowed"), _text("Rationale", True)),
    "code_templates": _table(_int("Id"), _text("Name"), _text("Description"), _text("Language"), _text("Category"), _text("Template"), _int("LayerId", True), _CREATED),
    "naming_conventions": _table(_int("Id"), _text("Context"), _text("Pattern"), _text("Example"), _text("Description", True), _int("LayerId", True), _CREATED),
}

#: Column sets, beside Id, whose values no two rows share.
UNIQUE: dict[str, list[tuple[str, ...]]] = {
    "architecture_patterns": [("Name",)],
    "architecture_layers": [("PatternId", "Name")],
    "layer_dependencies": [("SourceLayerId", "TargetLayerId")],
    "code_templates": [("Name", "Language")],
    "naming_conventions": [("Context", "Pattern")],
}


@dataclass(frozen=True)
class Reference:
    """child.column holds an Id of parent; on_delete says what a parent's removal does to the child's rows."""

    child: str
    column: str
    parent: str
    on_delete: str  # cascade, set_null or restrict


REFERENCES = (
    Reference("avoidance_rules", "PreferredAlternativeId", "design_preferences", "set_null"),
    Reference("architecture_layers", "PatternId", "architecture_patterns", "cascade"),
    Reference("layer_dependencies", "SourceLayerId", "architecture_layers", "cascade"),
    Reference("layer_dependencies", "TargetLayerId", "architecture_layers", "restrict"),
    Reference("code_templates", "LayerId", "architecture_layers", "set_null"),
    Reference("naming_conventions", "LayerId", "architecture_layers", "set_null"),
)
