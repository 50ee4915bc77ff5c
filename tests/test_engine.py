"""The engine, stored facts, streams, SQL and patterns, rendering; and the parsers of other languages."""

import json

import pytest

from symgraph.config import Config
from symgraph.engine import Engine
from symgraph.parsers import clones, code, schema
from symgraph.parsers.diff import parse_unified_diff
from symgraph.streaming.watch import Watcher, read_events
from tests.test_workspace import FILES


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    e = Engine(spark, str(root), Config(warehouse=str(tmp_path_factory.mktemp("wh"))))
    e.index()
    return e


def test_ask(engine):
    assert [r["name"] for r in engine.ask("code_find_function_callers", symbol="refill").collect()] == ["openValve"]
    out = engine.markdown("callers", symbol="refill")
    assert sorted(out) == ["action", "content", "kind"] and "openValve" in out["content"]
    assert "openValve" in engine.markdown("blast_radius", symbol="refill")["content"]
    with pytest.raises(ValueError):
        engine.ask("no_such_action")


def test_sql_and_patterns(engine):
    assert engine.ask("cypher", query="SELECT count(*) AS n FROM symbols").first()["n"] == 16
    q = "MATCH (a:Symbol)-[r:CALLS]->(b:Symbol) WHERE b.name = $n RETURN a.name AS caller, r.count AS n ORDER BY caller LIMIT 5"
    assert [tuple(r) for r in engine.ask("cypher", query=q, n="openValve").collect()] == [("opensTheValve", 1), ("prime", 1)]
    q = "MATCH (s:Symbol) WHERE s.isExported AND NOT (s)<-[:CALLS]-(:Symbol) AND s.name CONTAINS 'Quota' RETURN DISTINCT s.name AS name ORDER BY name"
    assert [r["name"] for r in engine.ask("cypher", query=q).collect()] == ["dayQuota", "nightQuota"]
    q = "MATCH (a:Symbol {name: 'openValve'})-[:CALLS*1..2]->(b:Symbol) RETURN b.name AS name ORDER BY name"
    assert [r["name"] for r in engine.ask("cypher", query=q).collect()] == ["prime", "refill"]
    with pytest.raises(ValueError):
        engine.ask("cypher", query="MATCH (a) DELETE a")


def test_rescan_and_stream(engine, spark, tmp_path):
    watcher = Watcher(spark, engine.warehouse)
    import os

    os.remove(f"{engine.root}/app/attic.ts")
    with open(f"{engine.root}/app/new.ts", "w") as f:
        f.write("import { openValve } from './valve';\nexport function fresh() { return openValve(); }\n")
    counts = watcher.rescan(engine.root)
    assert counts["added"] >= 1 and counts["deleted"] == 1
    names = {r["name"] for r in watcher.graph().symbols.collect()}
    assert "fresh" in names and "forgotten" not in names
    assert sum(r["callee_name"] == "openValve" for r in watcher.graph().calls.collect()) == 3

    events = [{"path": "app/new.ts", "seq": 1, "event": "change", "content": "x"}, {"path": "app/new.ts", "seq": 2, "event": "unlink", "content": None}, {"path": "app/tank.ts", "seq": 3, "event": "change", "content": FILES["app/tank.ts"]}, {"path": "app/drip.ts", "seq": 4, "event": "add", "content": "export function drip() { return 1; }\n"}]
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "1.json").write_text("\n".join(map(json.dumps, events)))
    query = watcher.start(read_events(spark, str(tmp_path / "events")), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    names = {r["name"] for r in watcher.graph().symbols.collect()}
    assert "drip" in names and "fresh" not in names and "refill" in names and watcher.batches == 1


def test_config():
    assert Config.of({"blast_depth": 5, "max_file_size": "big", "ignored": ["x"], "other": 1}) == Config(blast_depth=5, ignored=("x",))


@pytest.mark.parametrize(
    ("language", "path", "text", "symbols", "heritage"),
    [
        ("python", "a.py", "import numpy as np\nclass A(Base):\n    def f(self):\n        return np.g(1)\n\ndef h():\n    pass\n", [("A", "class", 2, 4), ("A.f", "method", 3, 4), ("h", "function", 6, 7)], [("Base", "extends")]),
        ("python", "bad.py", "class A:\n    def f(self):\n        return (\n", [("A", "class", 1, 3), ("A.f", "method", 2, 3)], []),
        ("go", "a.go", "package x\ntype S struct {\n\tn int\n}\nfunc (s *S) Run() int {\n\treturn helper(s)\n}\nfunc helper(s *S) int { return 1 }\n", [("S", "struct", 2, 4), ("S.Run", "method", 5, 7), ("helper", "function", 8, 8)], []),
        ("rust", "a.rs", "pub struct Timer { x: i32 }\npub trait Runner { fn run(&self); }\nimpl Runner for Timer {\n    fn run(&self) { go(); }\n}\n", [("Timer", "struct", 1, 1), ("Runner", "trait", 2, 2), ("Timer.run", "method", 4, 4)], [("Runner", "implements")]),
        ("java", "A.java", "package a;\nimport java.util.List;\npublic class A extends B implements C, D {\n    public int f(int x) {\n        return g(x);\n    }\n}\n", [("A", "class", 3, 7), ("A.f", "method", 4, 6)], [("B", "extends"), ("C", "implements"), ("D", "implements")]),
        ("c_sharp", "a.cs", "namespace Garden.Beds;\npublic class Plan : Base {\n    public void Water() {\n        Go();\n    }\n}\n", [("Garden.Beds.Plan", "class", 2, 6), ("Garden.Beds.Plan.Water", "method", 3, 5)], [("Base", "extends")]),
        ("c", "a.c", "#include <stdio.h>\nint add(int a, int b) {\n  return a + b;\n}\n", [("add", "function", 2, 4)], []),
        ("ruby", "a.rb", "class A < B\n  def f\n    g(1)\n  end\nend\n", [("A", "class", 1, 5), ("A.f", "method", 2, 4)], [("B", "extends")]),
        ("typescript", "a.ts", "export class U extends B implements L {\n  run(a: string): void {\n    const q = 'x(y)';\n    log(q);\n  }\n}\n", [("U", "class", 1, 6), ("U.run", "method", 2, 5)], [("B", "extends"), ("L", "implements")]),
    ],
)
def test_languages(language, path, text, symbols, heritage):
    p = code.parse(path, text, language)
    assert [(s["qname"], s["kind"], s["start_line"], s["end_line"]) for s in p.symbols] == symbols
    assert [(h["super_name"], h["rel"]) for h in p.heritage] == heritage


def test_awkward_inputs():
    for text in ("", "{", "}}}}", "class", "function (", "'unclosed", "/* open", "`${", "export default", "((((", "def f(:\n", "\x00\x01"):
        for language in [*code.LANGUAGES, "haskell"]:
            code.parse("x", text, language)
    p = code.parse("a.ts", "function f() { const s = \"SELECT count(x) FROM t\"; return `call(${1})`; }", "typescript")
    assert p.calls == []


def test_clones_and_diff():
    a = "function waterBed(bed, dry) {\n  if (dry) { return bed.soak(1); }\n}"
    b = "function waterRow(row, isParched) {\n  if (isParched) { return row.soak(22); } // note\n}"
    assert clones.structural_hash(a) == clones.structural_hash(b) != clones.structural_hash(a.replace("soak", "drain"))
    text = "diff --git a/app/hose.ts b/app/hose.ts\n--- a/app/hose.ts\n+++ b/app/hose.ts\n@@ -10,4 +10,6 @@ x\ndiff --git a/n.ts b/n.ts\nnew file mode 100644\n--- /dev/null\n+++ b/n.ts\n@@ -0,0 +1,5 @@\n"
    assert [tuple(r.values()) for r in parse_unified_diff(text)] == [("app/hose.ts", "modified", 10, 15), ("n.ts", "added", 1, 5)]


def test_schemas():
    proto = "message GardenBed {\n string bed_code = 1;\n string soil_kind = 2;\n repeated float embedding = 4;\n}"
    (e,), _ = schema.parse_schema("a.proto", proto)
    assert [(f["name"], f["raw_type"], f["is_list"], f["tag_number"]) for f in e["fields"]] == [("bed_code", "string", False, 1), ("soil_kind", "string", False, 2), ("embedding", "float", True, 4)]
    xsd = '<xs:complexType name="PlantRow"><xs:sequence><xs:element name="RowNumber" type="xs:int"/><xs:element name="Label" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType>'
    (e,), _ = schema.parse_schema("a.xsd", xsd)
    assert [(f["name"], f["raw_type"], f["is_required"], f["is_list"]) for f in e["fields"]] == [("RowNumber", "xs:int", True, False), ("Label", "xs:string", False, True)]
    (e,), _ = schema.parse_schema("openapi.json", json.dumps({"components": {"schemas": {"P": {"required": ["id"], "properties": {"id": {"type": "string"}, "o": {"$ref": "#/x/Other"}}}}}}))
    assert [(f["name"], f["raw_type"], f["is_required"]) for f in e["fields"]] == [("id", "string", True), ("o", "Other", False)]
    _, (c,) = schema.parse_schema("s.prisma", 'datasource db { provider = "postgresql" }\nmodel Bed {\n  id Int @id\n  label String?\n  owner Person @relation(fields: [a])\n}')
    assert [(a["name"], a["attribute_role"], a["is_nullable"]) for a in c["attributes"]] == [("id", "primary_key", False), ("label", "column", True), ("owner", "foreign_key", False)]
    _, (c,) = schema.parse_schema("bed-mapping.json", json.dumps({"mappings": {"properties": {"v": {"type": "dense_vector", "dims": 3}, "k": {"type": "keyword"}}}}))
    assert [(a["name"], a["attribute_role"], a["vector_dimension"]) for a in c["attributes"]] == [("v", "vector", 3), ("k", "keyword", None)]
    (e,), _ = schema.parse_schema("a.graphql", "type Query { x: Int }\ntype T {\n  id: ID!\n  tags: [String]\n}")
    assert [(f["name"], f["is_required"], f["is_list"]) for f in e["fields"]] == [("id", True, False), ("tags", False, True)]
    (c,) = schema.parse_mongoose("m.ts", "const PlotSchema = new Schema({\n  label: String,\n  age: { type: Number },\n});")
    assert (c["name"], c["engine"], [a["data_type"] for a in c["attributes"]]) == ("plots", "mongodb", ["ObjectId", "String", "Number"])
    assert schema.parse_schema("broken.json", "{") == ([], [])


def test_import_candidates():
    assert "src/math.ts" in code.resolve_candidates("tests/math.test.ts", "../lib/math.js")
    assert "src/util/index.ts" in code.resolve_candidates("src/main.ts", "./util")
    assert code.resolve_candidates("src/main.ts", "node:fs") == []
