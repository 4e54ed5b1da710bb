"""The catalog's tools: named functions from plain arguments to text, over a store.

TOOLS holds the registered tools by name. The five updates that have no registered tool are methods alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from lorekeep.functions.text import parse_name
from lorekeep.operators import dml
from lorekeep.plans import catalog as plan
from lorekeep.schemas import SEVERITY_RANK
from lorekeep.sources.store import Store

TOOLS: dict[str, tuple[str, Callable[..., str]]] = {}


def tool(name: str, about: str):
    def add(method):
        TOOLS[name] = (about, method)
        return method

    return add


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x.isoformat() if isinstance(x, datetime) else x


def _ranked(row: dict) -> dict:
    """Lists and details give a severity as its number."""
    return row | {"Severity": SEVERITY_RANK[row["Severity"]]} if "Severity" in row else row


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a capped list or a detail."""
    return [_plain(r.asDict(recursive=True)) for r in df.collect()]


def _json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _link(value: int | None) -> int | None:
    """A link of 0 or less is none."""
    return value if value is not None and value > 0 else None


class Tools:
    def __init__(self, store: Store, clock: Callable[[], datetime] | None = None, cap: int | None = plan.CAP, validate: bool = False):
        """validate: writes are held to what forms ask for as well (dml.check_values)."""
        self.store, self.cap, self.validate = store, cap, validate
        self.clock = clock or (lambda: datetime.now(UTC).replace(tzinfo=None))

    def call(self, name: str, /, **arguments) -> str:
        return TOOLS[name][1](self, **arguments)

    @property
    def t(self) -> dict[str, DataFrame]:
        return self.store.tables()

    def _list(self, rows: DataFrame) -> str:
        return _json([_ranked(r) for r in _rows(rows)])

    def _detail(self, row: DataFrame, missing: str) -> str:
        found = _rows(row)
        return _json(_ranked(found[0])) if found else missing

    def _create(self, table: str, detail, values: dict) -> str:
        if self.validate:
            dml.check_values(table, values)
        key = self.store.write(lambda t, last: dml.create_row(self.store.spark, t, table, values, self.clock(), last.get(table, 0)))
        return self._detail(detail(self.t, key), "")

    def _update(self, table: str, what: str, detail, key: int, values: dict) -> str:
        if self.validate:
            dml.check_values(table, values)

        def change(t, _):
            changed = dml.update_row(t, table, key, values)
            return changed, changed is not None

        return self._detail(detail(self.t, key), "") if self.store.write(change) else f"{what} with id {key} not found"

    def _delete(self, table: str, what: str, key: int) -> str:
        def change(t, _):
            changed = dml.delete_row(t, table, key)
            return changed, changed is not None

        return f"{what} {key} deleted" if self.store.write(change) else f"{what} with id {key} not found"

    # context

    @tool("get_coding_context", "All coding patterns, preferences and avoidance rules as markdown")
    def get_coding_context(self) -> str:
        return plan.coding_context(self.t, cap=self.cap).first()["text"]

    @tool("get_coding_patterns", "All coding patterns as JSON")
    def get_coding_patterns(self) -> str:
        return self._list(plan.coding_patterns(self.t, self.cap))

    @tool("get_design_preferences", "All design preferences as JSON")
    def get_design_preferences(self) -> str:
        return self._list(plan.design_preferences(self.t, self.cap))

    @tool("get_avoidance_rules", "All avoidance rules as JSON")
    def get_avoidance_rules(self) -> str:
        return self._list(plan.avoidance_rules(self.t, self.cap))

    @tool("search_context", "Patterns, preferences and avoidance rules that hold a word")
    def search_context(self, query: str) -> str:
        fields = {"CodingPattern": ["Type", "Name", "Category", "Description", "IsActive"], "DesignPreference": ["Type", "Category", "Preference", "Priority"], "AvoidanceRule": ["Type", "Name", "Category", "Description", "Severity"]}
        return _json([{k: r[k] for k in fields[r["Type"]]} for r in _rows(plan.search(self.t, query, self.cap))])

    def export_names(self) -> str:
        """The settings export: headings and names alone."""
        return plan.coding_context(self.t, names_only=True, cap=self.cap).first()["text"]

    # coding patterns

    @tool("add_coding_pattern", "Add a coding pattern")
    def add_coding_pattern(self, name: str, description: str, category: str, example: str | None = None) -> str:
        return self._create("coding_patterns", plan.coding_pattern, {"Name": name, "Description": description, "Category": category, "Example": example, "IsActive": True})

    @tool("update_coding_pattern", "Replace a coding pattern")
    def update_coding_pattern(self, id: int, name: str, description: str, category: str, example: str | None, is_active: bool) -> str:
        return self._update("coding_patterns", "Pattern", plan.coding_pattern, id, {"Name": name, "Description": description, "Category": category, "Example": example, "IsActive": is_active})

    @tool("delete_coding_pattern", "Delete a coding pattern")
    def delete_coding_pattern(self, id: int) -> str:
        return self._delete("coding_patterns", "Pattern", id)

    # design preferences

    @tool("add_design_preference", "Add a design preference; priority 0 if not given")
    def add_design_preference(self, category: str, preference: str, rationale: str | None = None, priority: int = 0) -> str:
        return self._create("design_preferences", plan.design_preference, {"Category": category, "Preference": preference, "Rationale": rationale, "Priority": priority})

    @tool("update_design_preference", "Replace a design preference")
    def update_design_preference(self, id: int, category: str, preference: str, rationale: str | None, priority: int) -> str:
        return self._update("design_preferences", "Preference", plan.design_preference, id, {"Category": category, "Preference": preference, "Rationale": rationale, "Priority": priority})

    @tool("delete_design_preference", "Delete a design preference")
    def delete_design_preference(self, id: int) -> str:
        return self._delete("design_preferences", "Preference", id)

    # avoidance rules

    def _rule(self, name, description, category, severity, preferred_alternative_id) -> dict:
        return {"Name": name, "Description": description, "Category": category, "Severity": parse_name(severity, SEVERITY_RANK), "PreferredAlternativeId": _link(preferred_alternative_id)}

    @tool("add_avoidance_rule", "Add an avoidance rule (Avoid, StronglyAvoid or Never)")
    def add_avoidance_rule(self, name: str, description: str, category: str, severity: str, preferred_alternative_id: int | None = None) -> str:
        return self._create("avoidance_rules", plan.avoidance_rule, self._rule(name, description, category, severity, preferred_alternative_id))

    @tool("update_avoidance_rule", "Replace an avoidance rule")
    def update_avoidance_rule(self, id: int, name: str, description: str, category: str, severity: str, preferred_alternative_id: int | None = None) -> str:
        return self._update("avoidance_rules", "Avoidance rule", plan.avoidance_rule, id, self._rule(name, description, category, severity, preferred_alternative_id))

    @tool("delete_avoidance_rule", "Delete an avoidance rule")
    def delete_avoidance_rule(self, id: int) -> str:
        return self._delete("avoidance_rules", "Avoidance rule", id)

    # architecture patterns

    @tool("get_architecture_context", "The active pattern with layers, dependencies, templates and conventions as markdown")
    def get_architecture_context(self) -> str:
        return plan.architecture_context(self.t, self.cap).first()["text"]

    @tool("get_active_architecture_pattern", "The active architecture pattern as JSON")
    def get_active_architecture_pattern(self) -> str:
        return self._detail(plan.active_pattern(self.t), "No active architecture pattern")

    @tool("get_architecture_patterns", "All architecture patterns as JSON")
    def get_architecture_patterns(self) -> str:
        return self._list(plan.architecture_patterns(self.t, self.cap))

    @tool("get_architecture_pattern", "One architecture pattern as JSON")
    def get_architecture_pattern(self, id: int) -> str:
        return self._detail(plan.architecture_pattern(self.t, id), f"Pattern with id {id} not found")

    @tool("add_architecture_pattern", "Add an architecture pattern, not active")
    def add_architecture_pattern(self, name: str, description: str, diagram: str | None = None) -> str:
        return self._create("architecture_patterns", plan.architecture_pattern, {"Name": name, "Description": description, "Diagram": diagram, "IsActive": False})

    def update_architecture_pattern(self, id: int, name: str, description: str, diagram: str | None, is_active: bool) -> str:
        return self._update("architecture_patterns", "Pattern", plan.architecture_pattern, id, {"Name": name, "Description": description, "Diagram": diagram, "IsActive": is_active})

    @tool("set_active_architecture_pattern", "Make one pattern active and all others not")
    def set_active_architecture_pattern(self, id: int) -> str:
        def change(t, _):
            patterns = t["architecture_patterns"]
            if plan.lookup(patterns, "Id", id).isEmpty():
                return None, False
            return {"architecture_patterns": dml.set_exclusive(patterns, "IsActive", "Id", id)}, True

        return f"Pattern {id} set as active" if self.store.write(change) else f"Pattern with id {id} not found"

    @tool("delete_architecture_pattern", "Delete a pattern with its layers")
    def delete_architecture_pattern(self, id: int) -> str:
        return self._delete("architecture_patterns", "Pattern", id)

    # layers

    @tool("get_layers_by_pattern", "A pattern's layers as JSON")
    def get_layers_by_pattern(self, pattern_id: int) -> str:
        return self._list(plan.architecture_layers(self.t, self.cap, pattern_id=pattern_id))

    @tool("get_architecture_layer", "One layer as JSON")
    def get_architecture_layer(self, id: int) -> str:
        return self._detail(plan.architecture_layer(self.t, id), f"Layer with id {id} not found")

    @tool("add_architecture_layer", "Add a layer; order 0 is the top")
    def add_architecture_layer(self, pattern_id: int, name: str, description: str, responsibility: str, contains: str | None, order: int) -> str:
        return self._create("architecture_layers", plan.architecture_layer, {"PatternId": pattern_id, "Name": name, "Description": description, "Responsibility": responsibility, "Contains": contains, "Order": order})

    def update_architecture_layer(self, id: int, name: str, description: str, responsibility: str, contains: str | None, order: int) -> str:
        return self._update("architecture_layers", "Layer", plan.architecture_layer, id, {"Name": name, "Description": description, "Responsibility": responsibility, "Contains": contains, "Order": order})

    @tool("delete_architecture_layer", "Delete a layer that no dependency points to")
    def delete_architecture_layer(self, id: int) -> str:
        return self._delete("architecture_layers", "Layer", id)

    # dependencies

    @tool("get_layer_dependencies", "The dependencies of a pattern's layers as JSON")
    def get_layer_dependencies(self, pattern_id: int) -> str:
        return self._list(plan.layer_dependencies(self.t, self.cap, pattern_id=pattern_id))

    @tool("add_layer_dependency", "Allow or forbid a dependency between layers")
    def add_layer_dependency(self, source_layer_id: int, target_layer_id: int, is_allowed: bool, rationale: str | None = None) -> str:
        return self._create("layer_dependencies", plan.layer_dependency, {"SourceLayerId": source_layer_id, "TargetLayerId": target_layer_id, "IsAllowed": is_allowed, "Rationale": rationale})

    def update_layer_dependency(self, id: int, is_allowed: bool, rationale: str | None) -> str:
        return self._update("layer_dependencies", "Dependency", plan.layer_dependency, id, {"IsAllowed": is_allowed, "Rationale": rationale})

    @tool("delete_layer_dependency", "Delete a dependency")
    def delete_layer_dependency(self, id: int) -> str:
        return self._delete("layer_dependencies", "Dependency", id)

    # templates

    @tool("get_code_templates", "All code templates as JSON")
    def get_code_templates(self) -> str:
        return self._list(plan.code_templates(self.t, self.cap))

    @tool("get_code_template", "One code template as JSON")
    def get_code_template(self, id: int) -> str:
        return self._detail(plan.code_template(self.t, id), f"Template with id {id} not found")

    @tool("get_code_templates_by_category", "The code templates of a category as JSON")
    def get_code_templates_by_category(self, category: str) -> str:
        return self._list(plan.code_templates(self.t, self.cap, category=category))

    @tool("get_code_templates_by_language", "The code templates of a language as JSON")
    def get_code_templates_by_language(self, language: str) -> str:
        return self._list(plan.code_templates(self.t, self.cap, language=language))

    def _template(self, name, description, language, category, template, layer_id) -> dict:
        return {"Name": name, "Description": description, "Language": language, "Category": category, "Template": template, "LayerId": _link(layer_id)}

    @tool("add_code_template", "Add a code template")
    def add_code_template(self, name: str, description: str, language: str, category: str, template: str, layer_id: int | None = None) -> str:
        return self._create("code_templates", plan.code_template, self._template(name, description, language, category, template, layer_id))

    def update_code_template(self, id: int, name: str, description: str, language: str, category: str, template: str, layer_id: int | None) -> str:
        return self._update("code_templates", "Template", plan.code_template, id, self._template(name, description, language, category, template, layer_id))

    @tool("delete_code_template", "Delete a code template")
    def delete_code_template(self, id: int) -> str:
        return self._delete("code_templates", "Template", id)

    # naming conventions

    @tool("get_naming_conventions", "All naming conventions as JSON")
    def get_naming_conventions(self) -> str:
        return self._list(plan.naming_conventions(self.t, self.cap))

    @tool("get_naming_convention", "One naming convention as JSON")
    def get_naming_convention(self, id: int) -> str:
        return self._detail(plan.naming_convention(self.t, id), f"Convention with id {id} not found")

    @tool("get_naming_conventions_by_context", "The naming conventions of a context as JSON")
    def get_naming_conventions_by_context(self, context: str) -> str:
        return self._list(plan.naming_conventions(self.t, self.cap, context=context))

    def _convention(self, context, pattern, example, description, layer_id) -> dict:
        return {"Context": context, "Pattern": pattern, "Example": example, "Description": description, "LayerId": _link(layer_id)}

    @tool("add_naming_convention", "Add a naming convention")
    def add_naming_convention(self, context: str, pattern: str, example: str, description: str | None = None, layer_id: int | None = None) -> str:
        return self._create("naming_conventions", plan.naming_convention, self._convention(context, pattern, example, description, layer_id))

    def update_naming_convention(self, id: int, context: str, pattern: str, example: str, description: str | None, layer_id: int | None) -> str:
        return self._update("naming_conventions", "Convention", plan.naming_convention, id, self._convention(context, pattern, example, description, layer_id))

    @tool("delete_naming_convention", "Delete a naming convention")
    def delete_naming_convention(self, id: int) -> str:
        return self._delete("naming_conventions", "Convention", id)
