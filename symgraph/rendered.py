"""Queries over a workspace written from the suppliers: a source file of each language, schemas and documentation for each of them.

The tables hold no source code, so files are rendered from templates, and the SQL states what has to be found in them: a
template's expected rows are written beside it, and DuckDB makes them for every supplier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract
from .functions import text
from .operators import ingest, knowledge, porting, storage
from .parsers import code
from .parsers.diff import HUNKS, parse_unified_diff
from .plans.graph import SymGraph, build
from .sources import discovery
from .sources.scratch import cut, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


class Source:
    """A template of a language and what is in it; ``{k}`` is the supplier's key."""

    def __init__(self, extension: str, lines: str, symbols=(), calls=(), imports=(), heritage=()):
        self.extension, self.text = extension, lines
        self.symbols, self.calls, self.imports, self.heritage = symbols, calls, imports, heritage

    def path(self, language: str) -> str:
        return f"{language}/unit{{k}}.{self.extension}"


#: Symbols: (qname, kind, first line, last line, exported). Calls: (name, qname, line). Imports: (module, names). Inheritance: (supertype, relation).
SOURCES = {
    "python": Source(
        "py", "import numpy as np\nfrom .base{k} import Base{k}\n\nclass Unit{k}(Base{k}):\n    def weigh(self, x):\n        return np.round(_scale{k}(x))\n\ndef _scale{k}(x):\n    return x * {k}\n",
        [("Unit{k}", "class", 4, 6, True), ("Unit{k}.weigh", "method", 5, 6, True), ("_scale{k}", "function", 8, 9, False)], [("round", "np.round", 6), ("_scale{k}", "_scale{k}", 6)], [("numpy", ["np"]), (".base{k}", ["Base{k}"])], [("Base{k}", "extends")],
    ),
    "typescript": Source(
        "ts", "import { send{k}, type Mail } from './post{k}';\nimport lib from 'shiplib';\nexport interface Parcel{k} {\n  weight(): number;\n}\nexport class Box{k} extends Case implements Parcel{k} {\n  weight(): number {\n    const text = 'call(1)'; // skip(2)\n    return send{k}(text);\n  }\n}\nexport const pack{k} = (n: number) => {\n  return new Box{k}();\n};\nfunction hidden{k}() { return lib.wrap({k}); }\n",
        [("Parcel{k}", "interface", 3, 5, True), ("Parcel{k}.weight", "method", 4, 4, True), ("Box{k}", "class", 6, 11, True), ("Box{k}.weight", "method", 7, 10, False), ("pack{k}", "function", 12, 14, True), ("hidden{k}", "function", 15, 15, False)],
        [("send{k}", "send{k}", 9), ("Box{k}", "Box{k}", 13), ("wrap", "lib.wrap", 15)], [("./post{k}", ["send{k}", "Mail"]), ("shiplib", ["lib"])], [("Case", "extends"), ("Parcel{k}", "implements")],
    ),
    "javascript": Source(
        "js", "import * as tools from './tools{k}.js';\nexport function load{k}(list) {\n  return tools.each(list);\n}\n", [("load{k}", "function", 2, 4, True)], [("each", "tools.each", 3)], [("./tools{k}.js", ["tools"])],
    ),
    "go": Source(
        "go", "package dock\n\nimport (\n\t\"fmt\"\n)\n\ntype Crane{k} struct {\n\tload int\n}\n\nfunc (c *Crane{k}) Lift() int {\n\tfmt.Println(c.load)\n\treturn helper{k}(c)\n}\n\nfunc helper{k}(c *Crane{k}) int {\n\treturn {k}\n}\n",
        [("Crane{k}", "struct", 7, 9, True), ("Crane{k}.Lift", "method", 11, 14, True), ("helper{k}", "function", 16, 18, False)], [("Println", "fmt.Println", 12), ("helper{k}", "helper{k}", 13)], [("fmt", ["fmt"])],
    ),
    "rust": Source(
        "rs", "use crate::dock::{Crane, Hook};\n\npub struct Ship{k} {\n    load: i32,\n}\n\npub trait Float{k} {\n    fn float(&self);\n}\n\nimpl Float{k} for Ship{k} {\n    fn float(&self) {\n        Crane::lift(self.load);\n    }\n}\n",
        [("Ship{k}", "struct", 3, 5, True), ("Float{k}", "trait", 7, 9, True), ("Ship{k}.float", "method", 12, 14, False)], [("lift", "Crane.lift", 13)], [("crate::dock", ["Crane", "Hook"])], [("Float{k}", "implements")],
    ),
    "java": Source(
        "java", "package dock;\n\nimport java.util.List;\n\npublic class Order{k} extends Base implements Priced, Named {\n    public int price(int n) {\n        return rate(n);\n    }\n\n    private int rate(int n) {\n        return n * {k};\n    }\n}\n",
        [("Order{k}", "class", 5, 13, True), ("Order{k}.price", "method", 6, 8, True), ("Order{k}.rate", "method", 10, 12, False)], [("rate", "rate", 7)], [("java.util.List", ["List"])], [("Base", "extends"), ("Priced", "implements"), ("Named", "implements")],
    ),
    "c_sharp": Source(
        "cs", "using System.Text;\n\nnamespace Dock.Yard;\n\npublic class Gate{k} : Door {\n    public void Open() {\n        Slide();\n    }\n}\n",
        [("Dock.Yard.Gate{k}", "class", 5, 9, True), ("Dock.Yard.Gate{k}.Open", "method", 6, 8, True)], [("Slide", "Slide", 7)], [("System.Text", ["Text"])], [("Door", "extends")],
    ),
    "c": Source("c", "#include <stdio.h>\n\nint add{k}(int a, int b) {\n  return clip(a + b);\n}\n", [("add{k}", "function", 3, 5, True)], [("clip", "clip", 4)], [("stdio.h", [])]),
    "cpp": Source("cpp", "#include \"yard.hpp\"\n\nclass Rope{k} {\n public:\n  int pull(int n) {\n    return hold(n);\n  }\n};\n", [("Rope{k}", "class", 3, 8, True), ("Rope{k}.pull", "method", 5, 7, True)], [("hold", "hold", 6)], [("yard.hpp", [])]),
    "ruby": Source("rb", "require 'set'\n\nclass Boat{k} < Hull\n  def sail\n    wind({k})\n  end\nend\n", [("Boat{k}", "class", 3, 7, True), ("Boat{k}.sail", "method", 4, 6, True)], [("wind", "wind", 5)], [("set", [])], [("Hull", "extends")]),
    "php": Source("php", "<?php\nuse App\\Mail\\Sender;\n\nclass Note{k} extends Paper implements Sealed {\n    public function post($x) {\n        return stamp($x);\n    }\n}\n", [("Note{k}", "class", 4, 8, True), ("Note{k}.post", "method", 5, 7, True)], [("stamp", "stamp", 6)], [("App\\Mail\\Sender", ["Sender"])], [("Paper", "extends"), ("Sealed", "implements")]),
    "kotlin": Source("kt", "import dock.Crane\n\nclass Tug{k} : Vessel {\n    fun tow(n: Int): Int {\n        return pull(n)\n    }\n}\n", [("Tug{k}", "class", 3, 7, True), ("Tug{k}.tow", "method", 4, 6, True)], [("pull", "pull", 5)], [("dock.Crane", ["Crane"])], [("Vessel", "extends")]),
    "solidity": Source("sol", "import \"./Base.sol\";\n\ncontract Vault{k} is Owned {\n    function store(uint n) public {\n        seal(n);\n    }\n}\n", [("Vault{k}", "class", 3, 7, True), ("Vault{k}.store", "method", 4, 6, True)], [("seal", "seal", 5)], [("./Base.sol", [])], [("Owned", "extends")]),
    "lua": Source("lua", "local function dip{k}(x)\n  return half(x)\nend\n\nfunction rise{k}(x)\n  return x\nend\n", [("dip{k}", "function", 1, 3, False), ("rise{k}", "function", 5, 7, True)], [("half", "half", 2)]),
    "zig": Source("zig", "const std = @import(\"std\");\n\npub fn knot{k}(n: u8) u8 {\n    return tie(n);\n}\n", [("knot{k}", "function", 3, 5, True)], [("tie", "tie", 4)], [("std", [])]),
    "bash": Source("sh", "#!/bin/sh\nmoor{k}() {\n  echo \"tied {k}\"\n}\n", [("moor{k}", "function", 2, 4, True)]),
    # no table of patterns: the generic ones
    "scala": Source("scala", "object Port{k} {\n  def berth{k}(n: Int): Int = {\n    n + {k}\n  }\n}\n", [("berth{k}", "function", 2, 4, True)]),
}
_UNIT = "supplier"
#: Suppliers whose files are rendered by one task.
UNITS = 250


def literal(v) -> str:
    """As DuckDB has it, the supplier's key put in."""
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, str):
        return "'" + v.replace("'", "''").replace("{k}", "' || s_suppkey || '") + "'"
    return str(v)


def rows_sql(columns: str, rows, where: str = "true") -> str:
    """A row of each kind for every supplier."""
    names = columns.split()
    return " union all ".join("select " + ", ".join(f"{literal(v)} as {n}" for n, v in zip(names, row)) + f" from {_UNIT} where {where}" for row in rows)


def filled(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), F.col("k").cast("string"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the hundred: the table is small enough for one task, the files that are rendered from it are not."""
    units = spark.read.parquet(f"{sf_dir}/{_UNIT}.parquet").select(F.col("s_suppkey").alias("k"))
    return units.repartition(max(1, -(-units.count() // UNITS)), "k")


def files_of(units: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """Files as a scan gives them, of ``(path, content)`` templates."""
    each = F.explode(F.array(*[F.struct(filled(p).alias("path"), filled(t).alias("content")) for p, t in templates]))
    rows = units.select(each.alias("f")).select("f.*")
    path, size = F.col("path"), F.octet_length("content").cast("long")
    return rows.select(
        "path", "content", F.sha2("content", 256).alias("hash"), size.alias("size"), F.size(F.split("content", "\n")).alias("line_count"), F.lit(0.0).alias("mtime_ms"),
        text.language(path, code.custom_extensions()).alias("language"), text.is_test_file(path).alias("is_test"), discovery.skip_reason(path, size, F.lit(False)).alias("reason"),
    )


def facts_of(spark: SparkSession, sf_dir: str, *languages: str) -> dict[str, DataFrame]:
    return extract.facts(files_of(keys(spark, sf_dir), [(SOURCES[x].path(x), SOURCES[x].text) for x in languages or SOURCES]))


def _symbols(language: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return facts_of(s, d, language)["symbols"].select(F.col("file").alias("path"), "qname", "kind", "start_line", "end_line", "is_exported")

    return run


for _language, _source in SOURCES.items():
    query(f"parse_{_language}", rows_sql("path qname kind start_line end_line is_exported", [(_source.path(_language), *x) for x in _source.symbols]))(_symbols(_language))


@query("parse_calls", rows_sql("path name qname line", [(x.path(n), *c) for n, x in SOURCES.items() for c in x.calls]))
def parse_calls(s, d):
    return facts_of(s, d)["raw_calls"].select(F.col("file").alias("path"), F.col("callee_name").alias("name"), F.col("callee_qname").alias("qname"), "line")


@query("parse_imports", rows_sql("path module names", [(x.path(n), m, ",".join(names)) for n, x in SOURCES.items() for m, names in x.imports]))
def parse_imports(s, d):
    return facts_of(s, d)["raw_imports"].select(F.col("src_path").alias("path"), F.col("imported_path").alias("module"), F.array_join("specifiers", ",").alias("names"))


@query("parse_heritage", rows_sql("path super_name rel", [(x.path(n), *h) for n, x in SOURCES.items() for h in x.heritage]))
def parse_heritage(s, d):
    return facts_of(s, d)["raw_heritage"].select(F.col("file").alias("path"), "super_name", "rel")


@query("import_candidates", "select 'typescript/unit' || a.s_suppkey || '.ts' as src_path, 'typescript/post' || a.s_suppkey || '.ts' as dst_path from supplier a where s_suppkey % 2 = 0 union all select 'javascript/unit' || s_suppkey || '.js', 'javascript/tools' || s_suppkey || '.ts' from supplier union all select 'python/unit' || s_suppkey || '.py', 'python/base' || s_suppkey || '/__init__.py' from supplier")
def import_candidates(s, d):
    """Relative imports that meet a file: with an extension, with another one than written, as a package. Every other TypeScript module is missing."""
    raw = facts_of(s, d, "typescript", "javascript", "python")["raw_imports"]
    u = keys(s, d)
    paths = u.where("k % 2 = 0").select(filled("typescript/post{k}.ts").alias("path")).union(u.select(filled("javascript/tools{k}.ts"))).union(u.select(filled("python/base{k}/__init__.py")))
    return ingest.resolve_imports(raw, paths).where("not is_external").select("src_path", "dst_path")


@query("heritage_edges", rows_sql("sub super_name rel is_external", [("Box{k}", "Parcel{k}", "implements", False), ("Box{k}", "Case", "extends", True), ("Ship{k}", "Float{k}", "implements", False)]))
def heritage_edges(s, d):
    """Supertypes by id (a class's own clause) and by name (an ``impl`` block apart from its type), inside and outside of the workspace."""
    f = facts_of(s, d, "typescript", "rust")
    edges = ingest.resolve_heritage(f["raw_heritage"], f["symbols"])
    return edges.join(f["symbols"].select(F.col("id").alias("sub_id"), F.col("name").alias("sub")), "sub_id").select("sub", "super_name", "rel", "is_external")


_ALIASED = ("typescript/use{k}.ts", "import { open{k}, shut } from 'harbour{k}';\nimport { near } from './near';\nconst door{k} = open{k}(1);\n// const no = open{k}(2);\nlet plain = near(3);\nconst other = shutter(4);\n")


@query("library_aliases", rows_sql("path alias module", [(_ALIASED[0], "door{k}", "harbour{k}")]))
def library_aliases(s, d):
    f = extract.facts(files_of(keys(s, d), [_ALIASED]))["files"]
    return f.select("path", F.explode("library_aliases").alias("a")).select("path", "a.alias", "a.module")


def _twin(body: str) -> str:
    return "export function total{k}(list, start) {\n  let sum = start;\n  for (const x of list) {\n    " + body + "\n  }\n  return sum;\n}\n"


@query("clone_hashes", "select case when s_suppkey % 3 = 0 then 'minus' else 'plus' end as form, count(*)::bigint as members from supplier group by all having count(*) > 1")
def clone_hashes(s, d):
    """Functions that differ in names, numbers and notes have one structural hash; another operator gives another hash."""
    u = keys(s, d)
    same = files_of(u.where("k % 3 = 1"), [("w/a{k}.js", _twin("sum += x * {k}; // note {k}"))]).union(files_of(u.where("k % 3 = 2"), [("w/a{k}.js", _twin("sum += x * 7;").replace("sum", "acc{k}").replace("list", "rows"))]))
    other = files_of(u.where("k % 3 = 0"), [("w/a{k}.js", _twin("sum -= x * {k};"))])
    symbols = cut(extract.facts(same.union(other))["symbols"], "symbols")
    groups = code_groups(symbols)
    form = symbols.select(F.col("id").alias("first_id"), F.when(F.regexp_extract("file", r"(\d+)", 1).cast("long") % 3 == 0, "minus").otherwise("plus").alias("form"))
    return groups.join(form, "first_id").select("form", "members")


def code_groups(symbols: DataFrame) -> DataFrame:
    from .operators.code import clone_groups

    return clone_groups(symbols)


#: (format, path, content, entities: (entity, field, type, required, list, tag) or containers: (container, attribute, type, role, nullable, dimension))
SCHEMAS = {
    "protobuf": ("s/unit{k}.proto", 'syntax = "proto3";\nmessage Crate{k} {\n  string code = 1;\n  repeated int32 marks = 2;\n}\n', [("Crate{k}", "code", "string", False, False, 1), ("Crate{k}", "marks", "int32", False, True, 2)], None),
    "xsd": ("s/unit{k}.xsd", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="Crate{k}"><xs:sequence><xs:element name="Code" type="xs:int"/><xs:element name="Mark" type="xs:string" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:schema>', [("Crate{k}", "Code", "xs:int", True, False, 0), ("Crate{k}", "Mark", "xs:string", False, True, 0)], None),
    "openapi": ("s{k}/openapi.json", '{"openapi": "3.0.0", "components": {"schemas": {"Crate{k}": {"type": "object", "required": ["code"], "properties": {"code": {"type": "string"}, "owner": {"$ref": "#/components/schemas/Person"}, "marks": {"type": "array", "items": {"type": "integer"}}}}}}}', [("Crate{k}", "code", "string", True, False, 0), ("Crate{k}", "owner", "Person", False, False, 0), ("Crate{k}", "marks", "array", False, True, 0)], None),
    "graphql": ("s/unit{k}.graphql", "type Query {\n  x: Int\n}\n\ntype Crate{k} {\n  code: ID!\n  marks: [String]\n}\n", [("Crate{k}", "code", "ID", True, False, 0), ("Crate{k}", "marks", "String", False, True, 0)], None),
    "sql": ("s/unit{k}.sql", "CREATE TABLE crates{k} (\n  id SERIAL PRIMARY KEY,\n  label VARCHAR(20) NOT NULL,\n  weight INTEGER\n);\n", None, [("crates{k}", "id", "primary_key", False, 0), ("crates{k}", "label", "column", False, 0), ("crates{k}", "weight", "column", True, 0)]),
    "prisma": ("s/unit{k}.prisma", 'datasource db {\n  provider = "postgresql"\n}\n\nmodel Crate{k} {\n  id Int @id\n  label String?\n  owner Person @relation(fields: [a])\n}\n', None, [("Crate{k}", "id", "primary_key", False, 0), ("Crate{k}", "label", "column", True, 0), ("Crate{k}", "owner", "foreign_key", False, 0)]),
    "elasticsearch": ("s/unit{k}-mapping.json", '{"mappings": {"properties": {"vector": {"type": "dense_vector", "dims": 3}, "code": {"type": "keyword"}}}}', None, [("unit{k}", "vector", "vector", True, 3), ("unit{k}", "code", "keyword", True, 0)]),
    "mongoose": ("s/unit{k}.ts", "import mongoose, { Schema } from 'mongoose';\nconst Crate{k}Schema = new Schema({\n  label: String,\n  weight: { type: Number },\n});\n", None, [("crate{k}s", "_id", "primary_key", False, 0), ("crate{k}s", "label", "column", True, 0), ("crate{k}s", "weight", "column", True, 0)]),
}


def _schema(format_: str) -> Query:
    path, content, entities, _ = SCHEMAS[format_]

    def run(s: SparkSession, d: str) -> DataFrame:
        f = extract.facts(files_of(keys(s, d), [(path, content)]))
        if entities is not None:
            return f["contract_fields"].join(f["contract_entities"].select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id").select("entity", F.col("name").alias("field"), "raw_type", "is_required", "is_list", "tag_number")
        return f["storage_attributes"].join(f["storage_containers"].select(F.col("id").alias("container_id"), F.col("name").alias("container")), "container_id").select("container", F.col("name").alias("attribute"), F.col("attribute_role").alias("role"), "is_nullable", F.coalesce("vector_dimension", F.lit(0)).alias("vector_dimension"))

    return run


for _format, (_path, _content, _entities, _containers) in SCHEMAS.items():
    _columns = "entity field raw_type is_required is_list tag_number" if _entities is not None else "container attribute role is_nullable vector_dimension"
    query(f"schema_{_format}", rows_sql(_columns, _entities if _entities is not None else _containers))(_schema(_format))


@query("json_schema_fields", "select 'Event' || event_id as entity, key as field, case when json_type(props, '$.' || key) in ('UBIGINT', 'BIGINT') then 'integer' when json_type(props, '$.' || key) = 'DOUBLE' then 'number' else 'string' end as raw_type from (select event_id, props, unnest(json_keys(props)) as key from events where event_id % 10 = 0)")
def json_schema_fields(s, d):
    """Each tenth event's properties as a JSON schema, through the schema parser."""
    e = s.read.parquet(f"{d}/events.parquet").where("event_id % 10 = 0")
    props = F.from_json("props", "map<string,string>")
    kind = lambda v: F.when(v.rlike(r"^-?\d+$"), "integer").when(v.rlike(r"^-?\d+\.\d+"), "number").otherwise("string")
    fields = F.transform_values(props, lambda _, v: F.struct(kind(v).alias("type")))
    content = F.to_json(F.struct(F.concat(F.lit("Event"), F.col("event_id").cast("string")).alias("title"), F.lit("object").alias("type"), fields.alias("properties")))
    files = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".schema.json")).alias("path"), content.alias("content"))
    files = files.select("path", "content", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"), F.lit(1).alias("line_count"), F.lit(0.0).alias("mtime_ms"), F.lit(None).cast("string").alias("language"), F.lit(False).alias("is_test"), F.lit("ok").alias("reason"))
    f = extract.facts(files)
    return f["contract_fields"].join(f["contract_entities"].select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id").select("entity", F.col("name").alias("field"), "raw_type")


# documentation

_DOC = ("docs/guide{k}.md", "Preface {k}\n# Dock `{k}` Guide\nUse `Unit{k}` and CargoHold or load{k}().\n\n## Rules\n- Crates MUST be dry.\n- You SHOULD weigh twice.\n- AVOID ropes.\nRULE: ask {k}\nplain\n### Deep\nend\n")


def _doc_facts(s, d):
    return extract.facts(files_of(keys(s, d), [_DOC]))


@query("doc_sections", rows_sql("path title level start_line end_line content", [(_DOC[0], "guide{k}.md", 1, 1, 1, "Preface {k}"), (_DOC[0], "Dock {k} Guide", 1, 2, 4, "Use `Unit{k}` and CargoHold or load{k}()."), (_DOC[0], "Rules", 2, 5, 10, "- Crates MUST be dry.\n- You SHOULD weigh twice.\n- AVOID ropes.\nRULE: ask {k}\nplain"), (_DOC[0], "Deep", 3, 11, 13, "end")]))
def doc_sections(s, d):
    return _doc_facts(s, d)["sections"].select(F.col("document_path").alias("path"), "title", "level", "start_line", "end_line", "content")


@query("doc_rules", rows_sql("path title content priority", [(_DOC[0], "Rules", "- Crates MUST be dry.", "must"), (_DOC[0], "Rules", "- You SHOULD weigh twice.", "should"), (_DOC[0], "Rules", "- AVOID ropes.", "avoid"), (_DOC[0], "Rules", "RULE: ask {k}", "should")]))
def doc_rules(s, d):
    return _doc_facts(s, d)["rules"].select(F.col("source_doc").alias("path"), "title", "content", "priority")


@query("doc_references", rows_sql("path title symbol", [(_DOC[0], "Dock {k} Guide", "Unit{k}"), (_DOC[0], "Dock {k} Guide", "CargoHold"), (_DOC[0], "Dock {k} Guide", "load{k}")]))
def doc_references(s, d):
    found = _doc_facts(s, d)["sections"].select(F.col("document_path").alias("path"), "title", F.explode("referenced_symbols").alias("symbol"))
    return found.where("not symbol rlike '^[0-9]+$'")  # a key of three digits or more in the heading's back-ticks is one as well


@query("doc_titles", rows_sql("path title category", [(_DOC[0], "Dock {k} Guide", "Guidelines")]))
def doc_titles(s, d):
    return _doc_facts(s, d)["documents"].select("path", "title", "category")


def _graph(s, d, *languages: str) -> SymGraph:
    """The rendered workspace with its documentation as a graph."""
    f = facts_of(s, d, *languages)
    docs = _doc_facts(s, d)
    return build(f | {n: docs[n] for n in ("documents", "sections", "rules")})


@query("knowledge_search", "select 'section' as kind, 'docs/guide' || s_suppkey || '.md' as path, 'Rules' as title, '' as symbols from supplier union all select 'rule', 'docs/guide' || s_suppkey || '.md', 'Rules', '' from supplier")
def knowledge_search(s, d):
    found = knowledge.knowledge_search(_graph(s, d, "python"), "MUST be dry", limit=None)
    return found.select("kind", "path", "title", F.array_join("symbols", ",").alias("symbols"))


@query("doc_links", rows_sql("path symbol", [(_DOC[0], "Unit{k}"), (_DOC[0], "load{k}")]))
def doc_links(s, d):
    """Sections to the symbols they name, and both through ``build``."""
    g = _graph(s, d, "python", "javascript")
    named = g.documents_edges.join(g.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol")), "symbol_id")
    return named.join(g.sections.select(F.col("id").alias("section_id"), F.col("document_path").alias("path")), "section_id").select("path", "symbol")


@query("porting_contract", "select 'member' as part, 'price' as name, 'public' as detail union all select 'member', 'rate', 'private' union all select 'super', 'Base', 'extends' union all select 'super', 'Priced', 'implements' union all select 'super', 'Named', 'implements' union all select 'import', 'java.util.List', 'external' union all select 'language', 'typescript', ''")
def porting_contract(s, d):
    """Of the first supplier's Java class. The language is told apart for .py, .go and .rs only."""
    out = porting.porting_contract(_graph(s, d, "java"), "Order1")
    part = lambda df, kind, name, detail: df.select(F.lit(kind).alias("part"), F.col(name).alias("name"), detail.alias("detail"))
    return (
        part(out["members"], "member", "name", F.col("visibility")).unionByName(part(out["supertypes"], "super", "super_name", F.col("rel")))
        .unionByName(part(out["imports"], "import", "imported_path", F.when(F.col("is_external"), "external"))).unionByName(part(out["definition"], "language", "language", F.lit("")))
    )


@query("blueprint", "select unnest(['Named', 'Priced']) as trait, 'Order1Error' as error, 'price,rate' as methods")
def blueprint(s, d):
    made = porting.blueprint(_graph(s, d, "java"), "Order1")
    traits = [t for t in made["traits"] if t != "Base"]
    return s.createDataFrame([(t, made["error_enum"], ",".join(m[0] for m in made["methods"])) for t in traits], "trait string, error string, methods string")


@query("contract_storage_mapping", "select * from (values ('mapping', 'code', 'code'), ('mapping', 'weight', 'weight'), ('unmapped', 'marks', null), ('summary', 'medium', null)) t(part, name, detail)")
def contract_storage_mapping(s, d):
    """A message of the first supplier against the table of its name among all suppliers' tables."""
    f = extract.facts(files_of(keys(s, d), [("s/box{k}.proto", "message Box{k} {\n  string code = 1;\n  repeated int32 marks = 2;\n  int32 weight = 3;\n}\n"), ("s/box{k}.sql", "CREATE TABLE box{k} (\n  id SERIAL PRIMARY KEY,\n  code TEXT,\n  weight INTEGER\n);\n")]))
    out = storage.contract_storage_mapping(build(f), "Box1")
    row = lambda df, part, name, detail: df.select(F.lit(part).alias("part"), F.col(name).alias("name"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    return row(out["mappings"], "mapping", "field", F.col("attribute")).unionByName(row(out["unmapped_fields"], "unmapped", "field", none)).unionByName(row(out["summary"], "summary", "compatibility", none))


@query("render_mermaid", "select 'first' as part, '```mermaid' as line union all select 'edge', '  Lift --> helper1' union all select 'edge', '  helper1' where false")
def render_mermaid(s, d):
    """The call of the first supplier's Go method, from the section that names it to the rendered diagram."""
    from .render import mermaid

    g = _graph(s, d, "go")
    g = g.with_tables(
        sections=s.createDataFrame([("d:1", "d.md", "Lifting", "Lift", 2, 1, 2, ["Lift"])], "id string, document_path string, title string, content string, level int, start_line int, end_line int, referenced_symbols array<string>"),
        documents_edges=g.symbols.where("qname = 'Crane1.Lift'").select(F.lit("d:1").alias("section_id"), F.col("id").alias("symbol_id")),
    )
    lines = mermaid(knowledge.spec_code_flow(g, "Lifting", 1)["edges"]).split("\n")
    return s.createDataFrame([("first", lines[0])] + [("edge", x) for x in lines[2:-1]], "part string, line string")


# scanning, incremental changes and streams

_CHANGED = ("python/unit{k}.py", "def fresh{k}():\n    return _scale{k}(2)\n")
_AFTER = (
    "select 'python/unit' || s_suppkey || '.py' as path, 'fresh' || s_suppkey as qname from supplier where s_suppkey % 3 = 0 union all select 'python/unit' || s_suppkey || '.py', q from (select s_suppkey, unnest(['Unit' || s_suppkey, 'Unit' || s_suppkey || '.weigh', '_scale' || s_suppkey]) as q from supplier where s_suppkey % 3 <> 0 {gone}) "
    "union all select 'rust/unit' || s_suppkey || '.rs', q from (select s_suppkey, unnest(['Ship' || s_suppkey, 'Float' || s_suppkey, 'Ship' || s_suppkey || '.float']) as q from supplier)"
)


@query("ingest_upsert", _AFTER.format(gone="and s_suppkey % 5 <> 0"))
def ingest_upsert(s, d):
    """A third of the Python files is replaced, a fifth of the others deleted; what came from other paths stays."""
    facts, u = facts_of(s, d, "python", "rust"), keys(s, d)
    fresh = extract.facts(files_of(u.where("k % 3 = 0"), [_CHANGED]))
    gone = u.where("k % 5 = 0 and k % 3 <> 0").select(filled(_CHANGED[0]).alias("path"))
    out = ingest.upsert(ingest.delete_paths(facts, gone), {k: v for k, v in fresh.items() if k in facts}, u.where("k % 3 = 0").select(filled(_CHANGED[0]).alias("path")))
    return out["symbols"].select(F.col("file").alias("path"), "qname")


@query("ingest_upsert_heritage", "select 'Ship' || s_suppkey as sub, 'Float' || s_suppkey as super_name from supplier")
def ingest_upsert_heritage(s, d):
    """Inheritance that is declared apart from its type outlives changes of other files."""
    facts, u = facts_of(s, d, "python", "rust"), keys(s, d)
    fresh = extract.facts(files_of(u, [_CHANGED]))
    out = ingest.upsert(facts, {k: v for k, v in fresh.items() if k in facts}, u.select(filled(_CHANGED[0]).alias("path")))
    edges = ingest.resolve_heritage(out["raw_heritage"], out["symbols"]).where("not is_external")
    return edges.join(out["symbols"].select(F.col("id").alias("sub_id"), F.col("name").alias("sub")), "sub_id").select("sub", "super_name")


def _folder(s, name: str, files: dict[str, str]) -> str:
    """A few files in the shared folder, written through the file system that it is in."""
    import uuid

    root = f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    for path, content in files.items():
        target = s._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        sink = target.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        try:
            sink.write(bytearray(content.encode()))
        finally:
            sink.close()
    return root


def _nations(s, d) -> list[int]:
    return [r[0] for r in s.read.parquet(f"{d}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows


_TEXT = "'x = ' || n_nationkey || chr(10)"


@query("scan_workspace", f"""select 'src/n' || n_nationkey || '.py' as path, 'ok' as reason, 'python' as language, false as is_test, length({_TEXT})::bigint as size, 2 as line_count, sha256({_TEXT}) as hash from nation where n_nationkey % 5 = 0
union all select 'tests/n' || n_nationkey || '.py', 'ok', 'python', true, length({_TEXT})::bigint, 2, sha256({_TEXT}) from nation where n_nationkey % 5 = 1
union all select 'n' || n_nationkey || '.sql', 'ok', null, false, length({_TEXT})::bigint, 2, sha256({_TEXT}) from nation where n_nationkey % 5 = 2""")
def scan_workspace(s, d):
    """A fifth each of sources, tests, schemas, binary files, and files of ignored folders, other kinds or too great a size."""
    files = {}
    for k in _nations(s, d):
        body = f"x = {k}\n"
        path, content = [(f"src/n{k}.py", body), (f"tests/n{k}.py", body), (f"n{k}.sql", body), (f"src/b{k}.py", "x\x00y"), ((f"node_modules/n{k}.py", body) if k % 2 else (f"n{k}.sqlite", body))][k % 5]
        files[path] = content
    files |= {"src/large.py": "#" * 3000, "src/n.dat": "x", "kept/out/n.py": "x\n"}
    found = discovery.scan(s, _folder(s, "scan", files), 2000, ["kept"])
    return found.where("reason <> 'binary'").select("path", "reason", "language", "is_test", "size", "line_count", "hash")


@query("stored_rescan", "select 'added' as change, count(*)::bigint as files from nation where n_nationkey % 4 = 0 union all select 'changed', count(*) from nation where n_nationkey % 4 = 1 union all select 'deleted', count(*) from nation where n_nationkey % 4 = 2 union all select 'symbol', count(*) from nation where n_nationkey % 4 <> 2 union all select 'stale', 0")
def stored_rescan(s, d):
    """A stored index catches up with a folder: what was added, changed and deleted, what it holds then, and that nothing is left to do."""
    from .sources.warehouse import Warehouse
    from .streaming.watch import Watcher, index_once

    ks = _nations(s, d)
    content = lambda k, name: f"def {name}{k}():\n    pass\n" if k % 3 else f"CREATE TABLE {name}{k} (id INTEGER);\n"  # noqa: E731  files of either kind
    path = lambda k: f"src/n{k}.py" if k % 3 else f"db/n{k}.sql"
    root = _folder(s, "rescan", {path(k): content(k, "old") for k in ks if k % 4 != 0})
    wh = Warehouse(s, f"{root}-stored")
    index_once(s, root, wh)
    fs = s._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for k in ks:
        target = s._jvm.org.apache.hadoop.fs.Path(f"{root}/{path(k)}")
        if k % 4 in (0, 1):
            sink = fs.create(target, True)
            sink.write(bytearray(content(k, "fresh").encode()))
            sink.close()
            fs.setTimes(target, 4_000_000_000_000, -1)
        elif k % 4 == 2:
            fs.delete(target, False)
    watcher = Watcher(s, wh)
    counts, again = watcher.rescan(root), watcher.rescan(root)
    facts = wh.read()
    held = facts["symbols"].count() + facts["storage_containers"].count()
    return s.createDataFrame([(c, counts.get(c, 0)) for c in ("added", "changed", "deleted")] + [("symbol", held), ("stale", sum(again.values()))], "change string, files long")


@query("stream_apply", "select 'drip' || n_nationkey as name from nation where n_nationkey % 3 <> 1")
def stream_apply(s, d):
    """Events of all nations through a running stream: added twice, the last content counts; a third is deleted again in the same batch."""
    import json

    from .sources.warehouse import Warehouse
    from .streaming.watch import Watcher, read_events

    events = []
    for k in _nations(s, d):
        events.append({"path": f"src/n{k}.py", "seq": 3 * k, "event": "add", "content": f"def early{k}():\n    pass\n"})
        events.append({"path": f"src/n{k}.py", "seq": 3 * k + 1, "event": "change", "content": f"def drip{k}():\n    pass\n"})
        if k % 3 == 1:
            events.append({"path": f"src/n{k}.py", "seq": 3 * k + 2, "event": "unlink", "content": None})
    root = _folder(s, "events", {"in/1.json": "\n".join(map(json.dumps, events))})
    watcher = Watcher(s, Warehouse(s, f"{root}/stored"))
    running = watcher.start(read_events(s, f"{root}/in"), f"{root}/checkpoint")
    running.processAllAvailable()
    running.stop()
    return watcher.warehouse.read()["symbols"].select("name")


@query("diff_hunks", "select 'app/n' || n_nationkey || '.py' as file, case when n_nationkey % 3 = 2 then 'deleted' when n_nationkey % 3 = 1 then 'added' else 'modified' end as change_type, case when n_nationkey % 3 = 2 then -1 when n_nationkey % 3 = 1 then 1 else 10 + n_nationkey end as start, case when n_nationkey % 3 = 2 then -1 when n_nationkey % 3 = 1 then 5 else 12 + n_nationkey end as \"end\" from nation")
def diff_hunks(s, d):
    parts = []
    for k in _nations(s, d):
        f = f"app/n{k}.py"
        parts.append(f"diff --git a/{f} b/{f}\n" + [f"--- a/{f}\n+++ b/{f}\n@@ -{k + 1},2 +{10 + k},3 @@ def x\n+a\n@@ -40,2 +50,0 @@\n-b\n", f"new file mode 100644\n--- /dev/null\n+++ b/{f}\n@@ -0,0 +1,5 @@\n+a\n", f"deleted file mode 100644\n--- a/{f}\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-a\n"][k % 3])
    return s.createDataFrame(parse_unified_diff("".join(parts)), HUNKS).fillna(-1, ["start", "end"])


@query("registered_language", "select 'x/unit' || s_suppkey || '.hull' as path, 'keel' || s_suppkey as name, 'function' as kind from supplier")
def registered_language(s, d):
    """A parser that is registered with its extension takes part in discovery and extraction."""
    code.register("hull", parse_hull, (".hull",))
    f = extract.facts(files_of(keys(s, d), [("x/unit{k}.hull", "plank keel{k}\nnail\n")]).withColumn("reason", F.lit("ok")))
    return f["symbols"].select(F.col("file").alias("path"), "name", "kind")


def parse_hull(path: str, content: str) -> code.Parsed:
    out = code.Parsed()
    for number, line in enumerate(content.split("\n"), 1):
        if line.startswith("plank "):
            out.symbols.append(code._symbol(path, line[6:], line[6:], "function", number, number, line, True))
    return out
