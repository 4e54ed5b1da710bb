"""The catalog on small hand-made tables: lists, details, facets, search, reports, writes, tools."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import dml
from lorekeep.plans import catalog as plan
from lorekeep.schemas import REFERENCES, SCHEMAS
from lorekeep.sources.endpoint import listed, reply, server
from lorekeep.sources.store import Conflict, Store, read_sqlite, write_text
from lorekeep.streaming.delivery import delivered
from lorekeep.tools import TOOLS, Tools

NOW = datetime(2024, 5, 6, 7, 8, 9)

ROWS = {
    "coding_patterns": [
        (1, "Guard", "Check early", "api", "if (x)\n  return", True, NOW),
        (2, "Old", "Gone", "Zed", None, False, NOW),
        (3, "Upper", "Straße 100%_x", "API", "", True, NOW),
        (4, "Umlaut", "nothing", "Ärger", None, True, NOW),
    ],
    "design_preferences": [(1, "style", "short names", "needle", 5, NOW), (2, "style", "long names", None, 8, NOW), (3, "style", "tie", "", 5, NOW)],
    "avoidance_rules": [(1, "Mild", "m", "c", "Avoid", NOW, None), (2, "Hard", "h", "c", "Never", NOW, 2), (3, "Mid", "x", "d", "StronglyAvoid", NOW, None)],
    "architecture_patterns": [(1, "Onion", "rings", "   ", False, NOW), (2, "Layers", "stack", "A\nB", True, NOW), (3, "Bare", "none", None, True, NOW)],
    "architecture_layers": [(1, 2, "Data", "d", "stores", None, 1), (2, 2, "UI", "u", "shows", "pages", 0), (3, 1, "Core", "c", "rules", None, 0), (4, 2, "Mid", "m", "binds", None, 1)],
    "layer_dependencies": [(1, 2, 1, True, None), (2, 1, 2, False, "no"), (3, 2, 3, True, "across"), (4, 3, 3, True, None)],
    "code_templates": [(1, "Dto", "d", "C#", "DTO", "record {{Entity}}", 1, NOW), (2, "Dto", "d", "Python", "DTO", "class", None, NOW), (3, "Repo", "r", "C#", "Data", "x", 2, NOW)],
    "naming_conventions": [(1, "class", "I{Name}", "IThing", None, 1, NOW), (2, "file", "I{Name}", "IThing.cs", "d", None, NOW)],
}


@pytest.fixture(scope="module")
def t(spark):
    return {n: spark.createDataFrame(ROWS[n], s).cache() for n, s in SCHEMAS.items()}


@pytest.fixture
def tools(spark, tmp_path, t):
    store = Store(spark, str(tmp_path / "catalog"))
    store.commit(t)
    return Tools(store, clock=lambda: NOW)


def ids(df):
    return [r["Id"] for r in df.collect()]


def test_lists_filter_seek_and_limit(t):
    assert ids(plan.coding_patterns(t)) == [1, 2, 3, 4]
    assert ids(plan.coding_patterns(t, 2, 1)) == [2, 3]
    assert ids(plan.coding_patterns(t, category="api")) == [1]
    assert ids(plan.coding_patterns(t, category="  ")) == [1, 2, 3, 4]
    assert ids(plan.coding_patterns(t, 0)) == []
    with pytest.raises(ValueError):
        plan.coding_patterns(t, -1)
    assert ids(plan.avoidance_rules(t, severity="Never")) == [2]
    assert ids(plan.architecture_layers(t, pattern_id=2)) == [1, 2, 4]
    assert ids(plan.layer_dependencies(t, pattern_id=2)) == [1, 2, 3]
    assert ids(plan.layer_dependencies(t, layer_id=3)) == [3, 4]
    assert ids(plan.code_templates(t, category="DTO", language="C#")) == [1]
    assert ids(plan.code_templates(t, layer_id=0)) == []
    assert ids(plan.naming_conventions(t, context="file")) == [2]


def test_pages_joined_are_the_whole_list(t):
    whole, got, after = ids(plan.code_templates(t, None)), [], None
    while page := ids(plan.code_templates(t, 2, after)):
        got += page
        after = page[-1]
    assert got == whole


def test_projections(t):
    alternative = {r["Id"]: r["PreferredAlternative"] for r in plan.avoidance_rules(t).collect()}
    assert alternative[1] is None and alternative[2]["Preference"] == "long names"
    assert [(r["Id"], r["LayerCount"]) for r in plan.architecture_patterns(t).collect()] == [(1, 1), (2, 3), (3, 0)]
    assert [x["Name"] for x in plan.architecture_pattern(t, 2).first()["Layers"]] == ["UI", "Data", "Mid"]
    assert plan.architecture_pattern(t, 3).first()["Layers"] == []
    assert plan.active_pattern(t).first()["Id"] == 2
    layer = plan.architecture_layer(t, 3).first()
    assert layer["PatternName"] == "Onion" and [x["Id"] for x in layer["IncomingDependencies"]] == [3, 4]
    assert [x["Id"] for x in layer["OutgoingDependencies"]] == [4] and layer["Templates"] == [] and layer["NamingConventions"] == []
    assert plan.layer_dependency(t, 3).first()["TargetLayerName"] == "Core"
    assert plan.code_template(t, 2).first()["LayerName"] is None
    assert plan.naming_convention(t, 1).first()["LayerName"] == "Data"
    assert plan.coding_pattern(t, 99).isEmpty()
    assert plan.next_layer_order(t, 2).first()["next_order"] == 3


def test_facets_are_in_binary_order(t):
    assert [r[0] for r in plan.facet_values(t, "coding_pattern_categories").collect()] == ["API", "Zed", "api", "Ärger"]
    for name in plan.FACETS:
        assert plan.facet_values(t, name).count() >= 1


@pytest.mark.parametrize(("needle", "found"), [("", 10), ("%", 1), ("_", 1), ("STRASSE", 0), ("straße", 1), ("NEEDLE", 0), ("names", 2), ("zed", 1)])
def test_search(t, needle, found):
    assert plan.search(t, needle).count() == found


def test_search_looks_at_the_first_rows_alone(t):
    assert plan.search(t, "umlaut", cap=3).count() == 0


def test_coding_context(t):
    assert plan.coding_context(t).first()["text"] == (
        "# Coding Context\n\n## Coding Patterns\n\n### api\n- **Guard**: Check early\n  ```\n  if (x)\n  return\n  ```\n\n### API\n- **Upper**: Straße 100%_x\n\n### Ärger\n- **Umlaut**: nothing\n\n### Zed\n\n"
        "## Design Preferences\n\n### style\n- long names\n- short names\n  - *Rationale: needle*\n- tie\n\n"
        "## Things to Avoid\n\n### Never\n- **Hard**: h\n\n### StronglyAvoid\n- **Mid**: x\n\n### Avoid\n- **Mild**: m\n\n"
    )


def test_short_export_and_empty_sections(spark, t):
    text = plan.coding_context(t, names_only=True).first()["text"]
    assert "- Guard\n" in text and "Check early" not in text
    empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    assert plan.coding_context(empty).first()["text"] == "# Coding Context\n\n"
    assert plan.architecture_context(empty).first()["text"] == "# Architecture Context\n\nNo active architecture pattern defined.\n"


def test_architecture_context(t):
    assert plan.architecture_context(t).first()["text"] == (
        "# Architecture Context\n\n## Layers\n\nstack\n\n### Diagram\n```\nA\nB\n```\n\n### Layers (Top to Bottom)\n\n"
        "#### 0. UI\n- **Responsibility**: shows\n- **Description**: u\n\n#### 1. Data\n- **Responsibility**: stores\n- **Description**: d\n\n#### 1. Mid\n- **Responsibility**: binds\n- **Description**: m\n\n"
        "### Layer Dependencies\n\n**Allowed:**\n- UI → Data\n- UI → Core\n\n**Forbidden:**\n- Data → UI\n\n"
        "### Code Templates\n\n#### Data\n- **Repo** (C#): r\n\n#### DTO\n- **Dto** (C#): d\n- **Dto** (Python): d\n\n"
        "### Naming Conventions\n\n#### class\n- `I{Name}` → e.g., `IThing`\n\n#### file\n- `I{Name}` → e.g., `IThing.cs`\n\n"
    )


def test_deletes_follow_references(t):
    with pytest.raises(dml.ReferenceViolation):
        dml.delete_row(t, "architecture_layers", 1)  # a dependency points to it
    after = t | dml.delete_row(t, "architecture_layers", 4)
    assert ids(after["architecture_layers"]) == [1, 2, 3]
    after = t | dml.delete_row(t, "design_preferences", 2)
    assert after["avoidance_rules"].where("Id = 2").first()["PreferredAlternativeId"] is None
    # edges inside a pattern go with it, whatever they point to
    after = t | dml.delete_row(t, "architecture_patterns", 2)
    assert ids(after["architecture_layers"]) == [3] and ids(after["layer_dependencies"]) == [4]
    assert [r["LayerId"] for r in after["code_templates"].orderBy("Id").collect()] == [None] * 3
    with pytest.raises(dml.ReferenceViolation):
        dml.delete_row(t, "architecture_patterns", 1)  # an edge from elsewhere points into it
    for r in REFERENCES:
        assert after[r.child].where(F.col(r.column).isNotNull()).join(after[r.parent], F.col(r.column) == after[r.parent]["Id"], "left_anti").isEmpty()
    assert dml.delete_row(t, "coding_patterns", 77) is None


def test_unique_keys_and_dangling_links(spark, t):
    with pytest.raises(dml.UniqueViolation):
        dml.create_row(spark, t, "code_templates", dict(zip(SCHEMAS["code_templates"].fieldNames(), ROWS["code_templates"][0], strict=True)), NOW)
    with pytest.raises(dml.ReferenceViolation):
        dml.create_row(spark, t, "layer_dependencies", {"SourceLayerId": 1, "TargetLayerId": 99, "IsAllowed": True}, NOW)
    with pytest.raises(dml.UniqueViolation):
        dml.update_row(t, "architecture_patterns", 1, {"Name": "Layers"})


def test_set_exclusive_leaves_one_or_changes_nothing(t):
    flags = lambda df: [r["IsActive"] for r in df.orderBy("Id").collect()]
    assert flags(dml.set_exclusive(t["architecture_patterns"], "IsActive", "Id", 1)) == [True, False, False]
    assert flags(dml.set_exclusive(t["architecture_patterns"], "IsActive", "Id", 2)) == [False, True, False]
    assert flags(dml.set_exclusive(t["architecture_patterns"], "IsActive", "Id", 9)) == [False, True, True]


def test_tools_are_all_there():
    assert len(TOOLS) == 39 and len(listed()) == 39
    assert sum(not n.startswith("_") and n not in TOOLS and n.startswith("update_") for n in dir(Tools)) == 5


def test_tools_read(tools):
    rules = json.loads(tools.call("get_avoidance_rules"))
    assert [r["Severity"] for r in rules] == [0, 2, 1] and rules[0]["PreferredAlternative"] is None
    hits = json.loads(tools.call("search_context", query="hard"))
    assert hits == [{"Type": "AvoidanceRule", "Name": "Hard", "Category": "c", "Description": "h", "Severity": "Never"}]
    assert json.loads(tools.call("get_active_architecture_pattern"))["Id"] == 2
    assert tools.call("get_code_template", id=9) == "Template with id 9 not found"
    assert len(json.loads(tools.call("get_code_templates_by_language", language="C#"))) == 2
    assert json.loads(tools.call("get_architecture_layer", id=1))["PatternName"] == "Layers"
    for name in ("get_coding_context", "get_coding_patterns", "get_design_preferences", "get_architecture_context", "get_architecture_patterns", "get_code_templates", "get_naming_conventions"):
        assert tools.call(name)
    answer = reply(tools, {"id": 1, "method": "tools/call", "params": {"name": "get_layers_by_pattern", "arguments": {"pattern_id": 2}}})
    assert len(json.loads(answer["result"]["content"][0]["text"])) == 3
    assert "error" in reply(tools, {"id": 2, "method": "tools/call", "params": {"name": "nothing"}})


def test_tools_write(tools):
    made = json.loads(tools.call("add_coding_pattern", name="n", description="d", category="c"))
    assert made["Id"] == 5 and made["IsActive"] and made["CreatedAt"] == NOW.isoformat()
    changed = json.loads(tools.call("update_coding_pattern", id=5, name="m", description="d", category="c", example="e", is_active=False))
    assert changed["Name"] == "m" and changed["CreatedAt"] == made["CreatedAt"]
    assert tools.call("delete_coding_pattern", id=5) == "Pattern 5 deleted"
    assert tools.call("delete_coding_pattern", id=5) == "Pattern with id 5 not found"
    rule = json.loads(tools.call("add_avoidance_rule", name="n", description="d", category="c", severity="never", preferred_alternative_id=0))
    assert rule["Severity"] == 2 and rule["PreferredAlternativeId"] is None
    with pytest.raises(ValueError):
        tools.call("add_avoidance_rule", name="n", description="d", category="c", severity="2")
    assert json.loads(tools.call("add_architecture_pattern", name="New", description="d"))["IsActive"] is False
    assert tools.call("set_active_architecture_pattern", id=4) == "Pattern 4 set as active"
    assert json.loads(tools.call("get_active_architecture_pattern"))["Id"] == 4
    assert tools.call("set_active_architecture_pattern", id=44) == "Pattern with id 44 not found"
    assert json.loads(tools.call("add_code_template", name="n", description="d", language="l", category="c", template="t", layer_id=-1))["LayerId"] is None
    assert json.loads(tools.update_layer_dependency(1, False, "r"))["IsAllowed"] is False
    assert "design preference" not in tools.call("add_design_preference", category="c", preference="p")


def test_store_text_sink_delivery_and_sqlite(spark, tmp_path, tools):
    import sqlite3

    empty = Store(spark, str(tmp_path / "fresh"))
    empty.create_missing()
    empty.create_missing()
    assert {n: d.count() for n, d in empty.tables().items()} == {n: 0 for n in SCHEMAS}
    write_text(spark, str(tmp_path / "out.md"), tools.export_names())
    assert (tmp_path / "out.md").read_text().startswith("# Coding Context")
    with delivered(tools.store.table("coding_patterns")) as rows:
        assert next(rows)["Id"] == 1
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE coding_patterns (Id INTEGER PRIMARY KEY, Name TEXT, Description TEXT, Category TEXT, Example TEXT, IsActive INTEGER, CreatedAt TEXT)")
        db.execute("INSERT INTO coding_patterns VALUES (1, 'n', 'd', 'c', NULL, 1, '2024-01-02 03:04:05.1234567')")
    got = read_sqlite(spark, str(tmp_path / "x.db"))
    assert got["coding_patterns"].first()["CreatedAt"] == datetime(2024, 1, 2, 3, 4, 5, 123456) and got["code_templates"].isEmpty()


def test_ids_never_come_back(tools):
    add = lambda: json.loads(tools.call("add_design_preference", category="c", preference="p"))["Id"]
    first = add()
    assert tools.call("delete_design_preference", id=first) == f"Preference {first} deleted"
    assert add() == first + 1


def test_concurrent_writers_lose_nothing(spark, tmp_path, t):
    """Threads on one store, and a second store on the same folder: each write is kept, under its own id."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "shared")
    Store(spark, root).commit(t)
    writers = [Tools(Store(spark, root), clock=lambda: NOW) for _ in range(2)]
    with ThreadPoolExecutor(4) as pool:
        answers = list(pool.map(lambda k: json.loads(writers[k % 2].call("add_coding_pattern", name=f"p{k}", description="d", category="c")), range(6)))
    assert sorted(x["Id"] for x in answers) == list(range(5, 11))
    rows = Store(spark, root).table("coding_patterns").collect()
    assert {r["Name"] for r in rows if r["Id"] > 4} == {f"p{k}" for k in range(6)}
    state = writers[0].store.state()
    with pytest.raises(Conflict):
        writers[1].store.commit({"coding_patterns": t["coding_patterns"]}, type(state)(state.number - 1, state.folders, state.last_ids))


def test_optional_validation(spark, tmp_path, t):
    store = Store(spark, str(tmp_path / "checked"))
    store.commit(t)
    strict = Tools(store, clock=lambda: NOW, validate=True)
    for name, arguments in [
        ("add_coding_pattern", {"name": " ", "description": "d", "category": "c"}),
        ("add_design_preference", {"category": "c", "preference": "p", "priority": 11}),
        ("add_layer_dependency", {"source_layer_id": 4, "target_layer_id": 4, "is_allowed": True}),
        ("add_layer_dependency", {"source_layer_id": 0, "target_layer_id": 4, "is_allowed": True}),
    ]:
        with pytest.raises(ValueError):
            strict.call(name, **arguments)
    assert json.loads(strict.call("add_coding_pattern", name="n", description="d", category="c"))["Example"] is None


def test_tools_of_preferences_rules_and_patterns(tools):
    call = lambda tool, /, **a: json.loads(tools.call(tool, **a))
    assert call("update_design_preference", id=1, category="a", preference="b", rationale=None, priority=9) == {"Id": 1, "Category": "a", "Preference": "b", "Rationale": None, "Priority": 9, "CreatedAt": NOW.isoformat()}
    assert tools.call("update_design_preference", id=99, category="a", preference="b", rationale=None, priority=9) == "Preference with id 99 not found"
    changed = call("update_avoidance_rule", id=1, name="n", description="d", category="c", severity="never", preferred_alternative_id=2)
    assert (changed["Severity"], changed["PreferredAlternative"]["Id"]) == (2, 2)
    assert tools.call("delete_design_preference", id=2) == "Preference 2 deleted"
    assert json.loads(tools.call("get_avoidance_rules"))[0]["PreferredAlternative"] is None
    assert tools.call("delete_avoidance_rule", id=1) == "Avoidance rule 1 deleted" and tools.call("delete_avoidance_rule", id=1) == "Avoidance rule with id 1 not found"
    assert [x["Id"] for x in call("get_architecture_pattern", id=2)["Layers"]] == [2, 1, 4]
    assert tools.call("get_architecture_pattern", id=9) == "Pattern with id 9 not found"
    assert tools.call("delete_architecture_pattern", id=3) == "Pattern 3 deleted" and tools.call("delete_architecture_pattern", id=3) == "Pattern with id 3 not found"


def test_tools_of_layers_dependencies_templates_and_conventions(tools):
    call = lambda tool, /, **a: json.loads(tools.call(tool, **a))
    added = call("add_architecture_layer", pattern_id=2, name="New", description="d", responsibility="r", contains=None, order=5)
    assert (added["Id"], added["Order"]) == (5, 5)
    edge = call("add_layer_dependency", source_layer_id=5, target_layer_id=1, is_allowed=False, rationale="r")
    assert edge["Id"] == 5 and 5 in [x["Id"] for x in call("get_layer_dependencies", pattern_id=2)]
    assert tools.call("delete_layer_dependency", id=5) == "Dependency 5 deleted" and 5 not in [x["Id"] for x in call("get_layer_dependencies", pattern_id=2)]
    assert tools.call("delete_architecture_layer", id=5) == "Layer 5 deleted" and tools.call("delete_architecture_layer", id=5) == "Layer with id 5 not found"
    assert [x["Id"] for x in call("get_code_templates_by_category", category="DTO")] == [1, 2]
    assert tools.call("delete_code_template", id=1) == "Template 1 deleted" and [x["Id"] for x in call("get_code_templates_by_category", category="DTO")] == [2]
    assert call("get_naming_convention", id=1)["Pattern"] == "I{Name}" and tools.call("get_naming_convention", id=7) == "Convention with id 7 not found"
    assert [x["Id"] for x in call("get_naming_conventions_by_context", context="file")] == [2]
    made = call("add_naming_convention", context="test", pattern="T{Name}", example="TX", layer_id=0)
    assert (made["Id"], made["LayerId"]) == (3, None)
    assert tools.call("delete_naming_convention", id=3) == "Convention 3 deleted" and tools.call("delete_naming_convention", id=3) == "Convention with id 3 not found"


def test_handshake_and_errors(tools):
    ask = lambda **r: reply(tools, {"jsonrpc": "2.0", "id": 1} | r)
    begun = ask(method="initialize", params={"protocolVersion": "2024-11-05", "capabilities": {}})["result"]
    assert begun["protocolVersion"] == "2024-11-05" and "tools" in begun["capabilities"]
    assert ask(method="initialize", params={"protocolVersion": "1999-01-01"})["result"]["protocolVersion"] != "1999-01-01"
    assert reply(tools, {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None and ask(method="ping")["result"] == {}
    assert [ask(method=m, params=p)["error"]["code"] for m, p in (("none", {}), ("tools/call", {"name": "none"}), ("tools/call", {"name": "add_avoidance_rule", "arguments": {"name": "n", "description": "d", "category": "c", "severity": "x"}}))] == [-32601, -32602, -32000]
    assert reply(tools, [])["error"]["code"] == -32600

    class Broken:
        def call(self, name):
            raise RuntimeError("gone")

    assert reply(Broken(), {"id": 1, "method": "tools/call", "params": {"name": "x"}})["error"]["code"] == -32603


def test_endpoint_answers_over_http(tools):
    import threading
    import urllib.error
    import urllib.request

    http = server(tools, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{http.server_address[1]}"

        def post(path, body):
            return urllib.request.urlopen(urllib.request.Request(base + path, body if isinstance(body, bytes) else json.dumps(body).encode()), timeout=60)

        def session():
            events = urllib.request.urlopen(f"{base}/sse", timeout=60)
            assert events.readline() == b"event: endpoint\n"
            return events, events.readline()[6:].strip().decode()

        def message(events):
            return next(json.loads(line[6:]) for line in iter(events.readline, b"") if line.startswith(b"data: {"))

        (one, to_one), (two, to_two) = session(), session()
        ask = {"method": "tools/call", "params": {"name": "get_code_template", "arguments": {"id": 9}}}
        assert post(to_one, ask | {"id": 7}).status == 202 and post(to_two, ask | {"id": 8}).status == 202
        # each session hears its own replies alone
        assert (message(one)["id"], message(two)["id"]) == (7, 8)
        answer = json.loads(post("/", ask | {"id": 9}).read())
        assert answer["id"] == 9 and answer["result"]["content"][0]["text"] == "Template with id 9 not found"
        assert post("/", {"method": "notifications/initialized"}).status == 202
        assert json.loads(post("/", b"{").read())["error"]["code"] == -32700
        with pytest.raises(urllib.error.HTTPError):
            post("/message?sessionId=none", ask)
    finally:
        http.shutdown()
