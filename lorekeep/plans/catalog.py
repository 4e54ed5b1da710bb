"""The catalog's read plans: paged lists, details, facets, search and reports, over a dict of the eight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import has_text, has_words, rank_of
from lorekeep.operators.lookup import facet, first_flagged, lookup
from lorekeep.operators.nest import with_child_count, with_children, with_optional_struct, with_parent
from lorekeep.operators.paging import PAGE_SIZE, equal_filters, keyset_page
from lorekeep.operators.report import grouped_section, joined, text_of
from lorekeep.operators.search import Searched, search_union
from lorekeep.schemas import SEVERITY_RANK

Tables = dict[str, DataFrame]

#: Rows of a table that searches, reports and tools read at most; None lifts the limit.
CAP = 1000

LAYER = ["Id", "PatternId", "Name", "Description", "Responsibility", "Order"]
DEPENDENCY = ["Id", "SourceLayerId", "SourceLayerName", "TargetLayerId", "TargetLayerName", "IsAllowed"]
TEMPLATE = ["Id", "Name", "Description", "Language", "Category", "LayerId", "LayerName"]
CONVENTION = ["Id", "Context", "Pattern", "Example", "LayerId", "LayerName"]
ALTERNATIVE = ["Id", "Preference", "Category"]


# paged lists: the limit comes before the joins, which keep the number of rows


def coding_patterns(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None, category: str | None = None) -> DataFrame:
    page = keyset_page(t["coding_patterns"], "Id", after, size, equal_filters(Category=category))
    return page.select("Id", "Name", "Description", "Category", "Example", "IsActive")


def design_preferences(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None, category: str | None = None) -> DataFrame:
    page = keyset_page(t["design_preferences"], "Id", after, size, equal_filters(Category=category))
    return page.select("Id", "Category", "Preference", "Rationale", "Priority")


def avoidance_rules(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None, category: str | None = None, severity: str | None = None) -> DataFrame:
    page = keyset_page(t["avoidance_rules"], "Id", after, size, equal_filters(Category=category, Severity=severity))
    page = with_optional_struct(page, t["design_preferences"], "PreferredAlternativeId", "PreferredAlternative", ALTERNATIVE)
    return page.select("Id", "Name", "Description", "Category", "Severity", "PreferredAlternativeId", "PreferredAlternative").orderBy("Id")


def architecture_patterns(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None) -> DataFrame:
    page = keyset_page(t["architecture_patterns"], "Id", after, size)
    return with_child_count(page, t["architecture_layers"], "PatternId", "LayerCount").select("Id", "Name", "Description", "IsActive", "LayerCount").orderBy("Id")


def architecture_layers(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None, pattern_id: int | None = None) -> DataFrame:
    return keyset_page(t["architecture_layers"], "Id", after, size, equal_filters(PatternId=pattern_id)).select(*LAYER)


def _named_dependencies(t: Tables, rows: DataFrame) -> DataFrame:
    rows = with_parent(rows, t["architecture_layers"], "SourceLayerId", {"SourceLayerName": "Name"}, how="inner")
    return with_parent(rows, t["architecture_layers"], "TargetLayerId", {"TargetLayerName": "Name"}, how="inner")


def layer_dependencies(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None, pattern_id: int | None = None, layer_id: int | None = None) -> DataFrame:
    """pattern_id looks at the source's pattern; layer_id at either end."""
    rows, filters = t["layer_dependencies"], []
    if pattern_id is not None:
        own = t["architecture_layers"].where(F.col("PatternId") == pattern_id).select(F.col("Id").alias("__own"))
        rows = rows.join(own, rows["SourceLayerId"] == own["__own"], "left_semi")
    if layer_id is not None:
        filters.append((F.col("SourceLayerId") == layer_id) | (F.col("TargetLayerId") == layer_id))
    return _named_dependencies(t, keyset_page(rows, "Id", after, size, filters)).select(*DEPENDENCY).orderBy("Id")


def code_templates(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None, category: str | None = None, language: str | None = None, layer_id: int | None = None) -> DataFrame:
    page = keyset_page(t["code_templates"], "Id", after, size, equal_filters(Category=category, Language=language, LayerId=layer_id))
    return with_parent(page, t["architecture_layers"], "LayerId", {"LayerName": "Name"}).select(*TEMPLATE).orderBy("Id")


def naming_conventions(t: Tables, size: int | None = PAGE_SIZE, after: int | None = None, context: str | None = None, layer_id: int | None = None) -> DataFrame:
    page = keyset_page(t["naming_conventions"], "Id", after, size, equal_filters(Context=context, LayerId=layer_id))
    return with_parent(page, t["architecture_layers"], "LayerId", {"LayerName": "Name"}).select(*CONVENTION).orderBy("Id")


# details: one row, or none


def coding_pattern(t: Tables, key: int) -> DataFrame:
    return lookup(t["coding_patterns"], "Id", key)


def design_preference(t: Tables, key: int) -> DataFrame:
    return lookup(t["design_preferences"], "Id", key)


def avoidance_rule(t: Tables, key: int) -> DataFrame:
    row = with_optional_struct(lookup(t["avoidance_rules"], "Id", key), t["design_preferences"], "PreferredAlternativeId", "PreferredAlternative", ALTERNATIVE)
    return row.select("Id", "Name", "Description", "Category", "Severity", "PreferredAlternativeId", "PreferredAlternative", "CreatedAt")


def _with_layers(t: Tables, rows: DataFrame) -> DataFrame:
    rows = with_children(rows, t["architecture_layers"], "PatternId", "Layers", F.struct(*[F.col(f"`{c}`") for c in LAYER]), ["Order", "Id"])
    return rows.select("Id", "Name", "Description", "Diagram", "IsActive", "CreatedAt", "Layers")


def architecture_pattern(t: Tables, key: int) -> DataFrame:
    return _with_layers(t, lookup(t["architecture_patterns"], "Id", key))


def active_pattern(t: Tables) -> DataFrame:
    """Of several active patterns the one of least Id."""
    return _with_layers(t, first_flagged(t["architecture_patterns"], "IsActive", "Id"))


def architecture_layer(t: Tables, key: int) -> DataFrame:
    """With four lists, each grouped by itself before it is joined."""
    row = with_parent(lookup(t["architecture_layers"], "Id", key), t["architecture_patterns"], "PatternId", {"PatternName": "Name"}, how="inner")
    edges = _named_dependencies(t, t["layer_dependencies"])
    edge, own_name = F.struct(*DEPENDENCY), lambda df: with_parent(df, t["architecture_layers"], "LayerId", {"LayerName": "Name"})
    row = with_children(row, edges.where(F.col("SourceLayerId") == key), "SourceLayerId", "OutgoingDependencies", edge, ["Id"])
    row = with_children(row, edges.where(F.col("TargetLayerId") == key), "TargetLayerId", "IncomingDependencies", edge, ["Id"])
    row = with_children(row, own_name(t["code_templates"].where(F.col("LayerId") == key)), "LayerId", "Templates", F.struct(*TEMPLATE), ["Id"])
    row = with_children(row, own_name(t["naming_conventions"].where(F.col("LayerId") == key)), "LayerId", "NamingConventions", F.struct(*CONVENTION), ["Id"])
    return row.select("Id", "PatternId", "PatternName", "Name", "Description", "Responsibility", "Contains", "Order", "OutgoingDependencies", "IncomingDependencies", "Templates", "NamingConventions")


def layer_dependency(t: Tables, key: int) -> DataFrame:
    return _named_dependencies(t, lookup(t["layer_dependencies"], "Id", key)).select(*DEPENDENCY, "Rationale")


def code_template(t: Tables, key: int) -> DataFrame:
    row = with_parent(lookup(t["code_templates"], "Id", key), t["architecture_layers"], "LayerId", {"LayerName": "Name"})
    return row.select("Id", "Name", "Description", "Language", "Category", "Template", "LayerId", "LayerName", "CreatedAt")


def naming_convention(t: Tables, key: int) -> DataFrame:
    row = with_parent(lookup(t["naming_conventions"], "Id", key), t["architecture_layers"], "LayerId", {"LayerName": "Name"})
    return row.select("Id", "Context", "Pattern", "Example", "Description", "LayerId", "LayerName", "CreatedAt")


# facets

FACETS = {
    "coding_pattern_categories": ("coding_patterns", "Category"),
    "design_preference_categories": ("design_preferences", "Category"),
    "avoidance_rule_categories": ("avoidance_rules", "Category"),
    "code_template_categories": ("code_templates", "Category"),
    "code_template_languages": ("code_templates", "Language"),
    "naming_convention_contexts": ("naming_conventions", "Context"),
}


def facet_values(t: Tables, name: str) -> DataFrame:
    table, column = FACETS[name]
    return facet(t[table], column)


def next_layer_order(t: Tables, pattern_id: int) -> DataFrame:
    """The order offered for a pattern's next layer: how many it has."""
    return t["architecture_layers"].where(F.col("PatternId") == pattern_id).agg(F.count("*").alias("next_order"))


# search and reports


def search(t: Tables, needle: str, cap: int | None = CAP) -> DataFrame:
    """Hits in patterns (inactive ones too), preferences and avoidance rules, in this order; examples and rationales aren't searched."""
    parts = [
        Searched("CodingPattern", t["coding_patterns"], ["Name", "Description", "Category"], ["Name", "Category", "Description", "IsActive"]),
        Searched("DesignPreference", t["design_preferences"], ["Preference", "Category"], ["Category", "Preference", "Priority"]),
        Searched("AvoidanceRule", t["avoidance_rules"], ["Name", "Description", "Category"], ["Name", "Category", "Description", "Severity"]),
    ]
    return search_union(parts, needle, cap).orderBy("source_order", "hit_key")


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def coding_context(t: Tables, names_only: bool = False, cap: int | None = CAP) -> DataFrame:
    """One row: the text of patterns, preferences and things to avoid. names_only: the short export.

    A category whose patterns are all inactive keeps its heading; severities go from strictest to mildest.
    """
    c = F.col
    example = F.when(has_text(c("Example")), _line("  ```\n  ", c("Example"), "\n  ```\n")).otherwise("")
    reason = F.when(has_text(c("Rationale")), _line("  - *Rationale: ", c("Rationale"), "*\n")).otherwise("")
    pattern = _line("- ", c("Name"), "\n") if names_only else F.concat(_line("- **", c("Name"), "**: ", c("Description"), "\n"), example)
    preference = _line("- ", c("Preference"), "\n") if names_only else F.concat(_line("- ", c("Preference"), "\n"), reason)
    rule = _line("- ", c("Name"), "\n") if names_only else _line("- **", c("Name"), "**: ", c("Description"), "\n")
    spark = t["coding_patterns"].sparkSession
    return joined([
        spark.sql("SELECT '# Coding Context\n\n' AS text"),
        grouped_section(coding_patterns(t, cap), "## Coding Patterns", "Category", pattern, [c("Id")], c("IsActive")),
        grouped_section(design_preferences(t, cap), "## Design Preferences", "Category", preference, [-c("Priority"), c("Id")]),
        grouped_section(keyset_page(t["avoidance_rules"], "Id", None, cap), "## Things to Avoid", "Severity", rule, [c("Id")], group_rank=-rank_of(c("group"), SEVERITY_RANK)),
    ])


def architecture_context(t: Tables, cap: int | None = CAP) -> DataFrame:
    """One row: the text of the active pattern, its layers and dependencies, and of all templates and conventions."""
    spark, c = t["architecture_patterns"].sparkSession, F.col
    head = spark.sql("SELECT '# Architecture Context\n\n' AS text")
    found = active_pattern(t).select("Id", "Name", "Description", "Diagram").first()  # one row at most
    if found is None:
        return joined([head, spark.sql("SELECT 'No active architecture pattern defined.\n' AS text")])
    pattern = lookup(t["architecture_patterns"], "Id", found["Id"])
    diagram = F.when(has_words(c("Diagram")), _line("### Diagram\n```\n", c("Diagram"), "\n```\n\n")).otherwise("")
    about = text_of(pattern, F.concat(_line("## ", c("Name"), "\n\n", c("Description"), "\n\n"), diagram), [c("Id")])
    layers = t["architecture_layers"].where(c("PatternId") == found["Id"])
    layers = text_of(layers, _line("#### ", c("Order"), ". ", c("Name"), "\n- **Responsibility**: ", c("Responsibility"), "\n- **Description**: ", c("Description"), "\n\n"), [c("Order"), c("Id")])
    edges = layer_dependencies(t, cap, pattern_id=found["Id"])
    ends = _line("- ", c("SourceLayerName"), " → ", c("TargetLayerName"), "\n")
    blocks = [text_of(edges.where(w), ends, [c("Id")]).select(_titled(f"**{name}:**\n", "\n")) for name, w in (("Allowed", c("IsAllowed")), ("Forbidden", ~c("IsAllowed")))]
    template = _line("- **", c("Name"), "** (", c("Language"), "): ", c("Description"), "\n")
    convention = _line("- `", c("Pattern"), "` → e.g., `", c("Example"), "`\n")
    return joined([
        head,
        about,
        layers.select(_titled("### Layers (Top to Bottom)\n\n")),
        joined(blocks).select(_titled("### Layer Dependencies\n\n")),
        grouped_section(keyset_page(t["code_templates"], "Id", None, cap), "### Code Templates", "Category", template, [c("Id")], mark="####"),
        grouped_section(keyset_page(t["naming_conventions"], "Id", None, cap), "### Naming Conventions", "Context", convention, [c("Id")], mark="####"),
    ])


def _titled(title: str, end: str = "") -> Column:
    """The text with a title before it and an end after it, or nothing if it is empty."""
    return F.when(F.col("text") != "", F.concat(F.lit(title), "text", F.lit(end))).otherwise("").alias("text")
