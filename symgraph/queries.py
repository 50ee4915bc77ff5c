"""Queries over graphs derived from the star-schema tables, each with its SQL.

The tables hold no source code, so operators run on views: parts are symbols, parts of one order that are near in key call each
other, suppliers are files, documents are documentation. Every derived set is distinct, so the SQL is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rendered
from .functions import names, text
from .operators import code, impact, ingest, knowledge, link, porting, storage
from .plans import pattern
from .plans.graph import SymGraph
from .plans.traverse import cycles, reach, shortest_paths, trails
from .sources import discovery, snapshot
from .sources.scratch import cut

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WANTED = "small ring"

#: Views that the SQL of several queries shares.
VIEWS = {
    "sym": "select p_partkey as id, p_name as name, p_brand || '.' || p_name as qname, p_type as kind, p_brand as file, p_size as start_line, p_size + 3 as end_line, p_partkey % 3 = 0 as is_exported from part",
    "pairs": "select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where b.l_partkey - a.l_partkey between 1 and greatest(10, (select count(*) from part) // 200)",
    "calls": "select src, dst from pairs",
    "near": "select distinct a.l_suppkey as src, b.l_suppkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where b.l_suppkey - a.l_suppkey between 1 and 2",
    "imp": "select src, dst from near union select dst, src from near where (src + dst) % 7 = 0",
    "fil": "select s_suppkey as key, case when s_suppkey % 5 = 0 then 'tests/' || (s_suppkey - 1) || '.test.ts' else s_suppkey || '.ts' end as path, s_suppkey % 5 = 0 as is_test from supplier",
    "impf": "select a.path as src_path, b.path as dst_path from imp join fil a on a.key = src join fil b on b.key = dst",
}
_NEEDS = {"calls": ["pairs"], "imp": ["near"], "impf": ["imp", "fil"]}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            wanted: list[str] = []

            def need(v: str) -> None:
                for x in _NEEDS.get(v, []):
                    need(x)
                if v not in wanted:
                    wanted.append(v)

            for v in views.split():
                need(v)
            ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in wanted)
            body = sql.strip()
            if ctes and body.startswith("with recursive "):
                _SQL[name] = f"with recursive {ctes}, {body[15:]}"
            elif ctes and body.startswith("with "):
                _SQL[name] = f"with {ctes}, {body[5:]}"
            else:
                _SQL[name] = f"with {ctes} {body}" if ctes else body
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qname"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"),
        (F.col("p_size") + 3).alias("end_line"), (F.col("p_partkey") % 3 == 0).alias("is_exported"), F.lit("").alias("signature"), F.lit("").alias("structural_hash"),
    )


def _near_pairs(spark: SparkSession, sf_dir: str, key: str, width) -> DataFrame:
    """Distinct pairs of keys of one order whose difference is 1 to ``width``: equal orders, then a band on the key."""
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", key).distinct()
    a, b = one.select("l_orderkey", F.col(key).alias("src")), one.select("l_orderkey", F.col(key).alias("dst"))
    return a.join(b, "l_orderkey").where((F.col("dst") - F.col("src")).between(1, width)).select("src", "dst").distinct()


def g_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_pairs(spark, sf_dir, "l_partkey", max(10, table(spark, sf_dir, "part").count() // 200))


def g_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_edges(spark, sf_dir).select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit(1).alias("line"), F.lit(1).cast("long").alias("cnt"))


def g_import_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near_pairs(spark, sf_dir, "l_suppkey", 2)
    return near.union(near.where((F.col("src") + F.col("dst")) % 7 == 0).select("dst", "src")).distinct()


def g_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    test = k % 5 == 0
    path = F.when(test, F.concat(F.lit("tests/"), (k - 1).cast("string"), F.lit(".test.ts"))).otherwise(F.concat(k.cast("string"), F.lit(".ts")))
    return table(spark, sf_dir, "supplier").select(k.alias("key"), path.alias("path"), test.alias("is_test"))


def g_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e = g_files(spark, sf_dir), g_import_keys(spark, sf_dir)
    a, b = f.select(F.col("key").alias("src"), F.col("path").alias("src_path")), f.select(F.col("key").alias("dst"), F.col("path").alias("dst_path"))
    return e.join(a, "src").join(b, "dst").select("src_path", "dst_path", F.lit(False).alias("is_external"), F.col("dst_path").alias("imported_path"))


def graph(spark: SparkSession, sf_dir: str) -> SymGraph:
    return SymGraph(files=g_files(spark, sf_dir), symbols=g_symbols(spark, sf_dir), calls=g_calls(spark, sf_dir), imports=g_imports(spark, sf_dir), heritage=g_heritage(spark, sf_dir))


def g_heritage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts extend the part of a tenth of their key; each seventh implements an external type."""
    p = table(spark, sf_dir, "part").where("p_partkey >= 10")
    sup = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("super_id"), F.col("p_name").alias("super_name"))
    inside = p.select(F.col("p_partkey").alias("sub_id"), F.floor(F.col("p_partkey") / 10).alias("super_id")).join(sup, "super_id").select("sub_id", "super_id", "super_name", F.lit("extends").alias("rel"), F.lit(False).alias("is_external"))
    outside = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("sub_id"), F.lit(None).cast("long").alias("super_id"), F.lit("Widget").alias("super_name"), F.lit("implements").alias("rel"), F.lit(True).alias("is_external"))
    return inside.unionByName(outside)


VIEWS["her"] = "select p.p_partkey as sub_id, s.p_partkey as super_id, s.p_name as super_name, 'extends' as rel, false as is_external from part p join part s on s.p_partkey = p.p_partkey // 10 where p.p_partkey >= 10 union all select p_partkey, null, 'Widget', 'implements', true from part where p_partkey >= 10 and p_partkey % 7 = 0"


@query("hubs", "select name, kind, file, count(*)::bigint as in_degree from calls join sym on id = dst group by all", "calls sym")
def hubs(s, d):
    return code.hubs(g_symbols(s, d), g_calls(s, d), limit=None)


@query("hubs_top", "select name, kind, file, count(*)::bigint as in_degree from calls join sym on id = dst group by all order by in_degree desc, file, name, kind limit 25", "calls sym")
def hubs_top(s, d):
    return code.hubs(g_symbols(s, d), g_calls(s, d))


_NEIGHBOUR = "select o.id, o.name, o.qname, o.kind, o.file, o.start_line, 1 as line, 1::bigint as cnt, t.name as target_name from calls join sym t on t.id = {at} join sym o on o.id = {other} where t.name = '%s' or t.qname = '%s'" % (WANTED, WANTED)


@query("callers", _NEIGHBOUR.format(at="dst", other="src"), "calls sym")
def callers(s, d):
    return code.callers(graph(s, d), WANTED)


@query("callees", _NEIGHBOUR.format(at="src", other="dst"), "calls sym")
def callees(s, d):
    return code.callees(graph(s, d), WANTED)


@query("entry_points", "select id, name, qname, kind, file, start_line from sym where is_exported and id not in (select dst from calls)", "calls sym")
def entry_points(s, d):
    return code.entry_points(g_symbols(s, d), g_calls(s, d), limit=None, candidates=None)


@query("interface_member_antijoin", "with m as (select id, qname, file, case when kind = 'ECONOMY' then 'interface' else kind end as kind, case when kind = 'ECONOMY' then file else name end as name from sym) select id from m where not exists (select 1 from m o where o.kind = 'interface' and o.file = m.file and m.qname = o.name || '.' || m.name)", "sym")
def interface_member_antijoin(s, d):
    """Parts of type ECONOMY are interfaces named like their file."""
    m, economy = g_symbols(s, d), F.col("kind") == "ECONOMY"
    m = m.withColumn("name", F.when(economy, F.col("file")).otherwise(F.col("name"))).withColumn("kind", F.when(economy, "interface").otherwise(F.col("kind")))
    return m.join(code.interface_members(m).select(F.col("id").alias("_m")), F.col("id") == F.col("_m"), "left_anti").select("id")


@query("definition_lookup", f"select id, name, qname, kind, file, start_line from sym where name = '{WANTED}' or qname = '{WANTED}' order by file, start_line, id limit 1", "sym")
def definition_lookup(s, d):
    return code.definition(g_symbols(s, d), WANTED).select("id", "name", "qname", "kind", "file", "start_line")


_TRAILS = f"""with recursive walk as (
  select id as seed, src as node, 1 as depth, [src || '>' || dst] as e from sym join calls on dst = id where name = '{WANTED}'
  union all select seed, c.src, depth + 1, list_append(e, c.src || '>' || c.dst) from walk join calls c on c.dst = node where depth < 3 and not list_contains(e, c.src || '>' || c.dst)) """


@query("blast_paths_d3", _TRAILS + "select depth, a.id as caller_id, a.name as caller_name, a.qname as caller_qname, a.file as caller_file, a.start_line as caller_line, t.id as target_id, t.name as target_name, t.file as target_file from walk join sym a on a.id = node join sym t on t.id = seed", "calls sym")
def blast_paths_d3(s, d):
    return impact.blast_paths(graph(s, d), WANTED, 3)


@query("blast_risk", _TRAILS + """, k as (select count(*)::bigint as callers, count(distinct a.file)::bigint as files from walk join sym a on a.id = node)
select callers, files, case when callers = 0 then 'low' when callers < 5 and files <= 2 then 'medium' when callers < 20 then 'high' else 'critical' end as level, least(100, callers * 5 + files * 10)::bigint as score from k""", "calls sym")
def blast_risk(s, d):
    return impact.blast_radius(graph(s, d), WANTED, 3)["risk"].drop("tests")


@query("reach_min_depth", """with recursive r as (select distinct src as seed, src as node, 0 as depth from calls union select seed, c.dst, depth + 1 from r join calls c on c.src = node where depth < 3)
select seed, node, min(depth) as depth from r where depth > 0 group by all""", "calls")
def reach_min_depth(s, d):
    e = g_edges(s, d)
    return reach(e, e.select(F.col("src").alias("seed")).distinct(), 3)


@query("trails_d3", """with recursive r as (select src as seed, dst as node, 1 as depth, [src || '>' || dst] as e from calls union all select seed, c.dst, depth + 1, list_append(e, c.src || '>' || c.dst) from r join calls c on c.src = node where depth < 3 and not list_contains(e, c.src || '>' || c.dst))
select seed, node, depth, count(*)::bigint as paths from r group by all""", "calls")
def trails_d3(s, d):
    e = g_edges(s, d)
    seeds = e.select(F.col("src").alias("seed")).distinct()
    return trails(e, seeds, 3).groupBy("seed", "node", "depth").agg(F.count("*").alias("paths"))


@query("call_path_shortest", """with recursive r as (select distinct src as source, src as node, 0 as hops from calls union select source, c.dst, hops + 1 from r join calls c on c.src = node where hops < 12)
select source, node as target, min(hops) as hops from r where hops > 0 group by all""", "calls")
def call_path_shortest(s, d):
    e = cut(g_edges(s, d), "edges")
    nodes = e.select(F.col("dst").alias("target")).distinct()
    return shortest_paths(e, e.select(F.col("src").alias("source")).distinct(), nodes, 12).select("source", "target", "hops")


_CYCLES = "with recursive r as (select src as first, dst as node, 1 as length, [src || '>' || dst] as e, [src, dst] as n from imp union all select first, i.dst, length + 1, list_append(e, i.src || '>' || i.dst), list_append(n, i.dst) from r join imp i on i.src = node where length < 6 and not list_contains(e, i.src || '>' || i.dst)) select length, array_to_string(n, '>') as nodes from r where node = first and length >= 2"


@query("import_cycles", _CYCLES, "imp")
def import_cycles(s, d):
    return cycles(g_import_keys(s, d), 2, 6).select("length", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"))


@query("import_cycles_canonical", _CYCLES + " and first = list_min(n)", "imp")
def import_cycles_canonical(s, d):
    return cycles(g_import_keys(s, d), 2, 6, canonical=True).select("length", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"))


_NAMES = "contains(t.path, replace(s.path, '.ts', '.test.ts')) or contains(t.path, replace(s.path, '.js', '.test.js')) or contains(t.path, replace(s.path, '.go', '_test.go')) or contains(t.path, replace(s.path, '.py', '_test.py')) or contains(t.path, 'test_' || s.path)"


@query("affected_tests_naming", f"select t.path as test_path, s.path as src_path from fil t join fil s on t.is_test and not s.is_test and ({_NAMES})", "fil")
def affected_tests_naming(s, d):
    return link.tests_by_naming(g_files(s, d))


@query("affected_tests_import", "select distinct src_path as test_path, dst_path as src_path from impf join fil a on a.path = src_path and a.is_test join fil b on b.path = dst_path and not b.is_test", "impf fil")
def affected_tests_import(s, d):
    return link.tests_by_import(g_files(s, d), g_imports(s, d))


@query("tests_for_union", f"select t.path as test_path, s.path as src_path from fil t join fil s on t.is_test and not s.is_test and ({_NAMES}) union select src_path, dst_path from impf join fil a on a.path = src_path and a.is_test join fil b on b.path = dst_path and not b.is_test", "impf fil")
def tests_for_union(s, d):
    return link.link_all(graph(s, d)).tests_for


@query("affected_tests", "with ch as (select path as file from fil where key % 11 = 3) select file, src_path as test_path from impf join ch on dst_path = file join fil a on a.path = src_path and a.is_test where file <> src_path union select file, path from ch join fil on is_test and contains(path, regexp_replace(file, '\\.[^.]*$', '')) where file <> path", "impf fil")
def affected_tests(s, d):
    changed = g_files(s, d).where("key % 11 = 3").select(F.col("path").alias("file"))
    return impact.affected_tests(graph(s, d), changed)


@query("unused_symbols", "select id, name, qname, kind, file, start_line from sym where not is_exported and id not in (select dst from calls) and not contains(file, 'test') and not contains(file, 'spec') and name not in ('constructor', '__init__')", "calls sym")
def unused_symbols(s, d):
    return code.unused_symbols(graph(s, d), limit=None)


@query("subtypes", "select distinct s.id, s.name, s.qname, s.kind, s.file, s.start_line, rel, super_name from her h join sym s on s.id = h.sub_id left join sym u on u.id = h.super_id where (not is_external and (u.name = 'red widget' or u.qname = 'red widget')) or (is_external and super_name = 'red widget')", "her sym")
def subtypes(s, d):
    return code.subtypes(graph(s, d), "red widget")


@query("search_symbols", "select id, name, qname from sym where contains(lower(name), 'ring') or contains(lower(qname), 'ring') order by length(name), name, file, start_line, id limit 25", "sym")
def search_symbols(s, d):
    return code.search_symbols(g_symbols(s, d), "RING").select("id", "name", "qname")


@query("search_symbols_kind_precedence", "select id, name, kind from sym where contains(lower(name), 'ring') or (contains(lower(qname), 'brand#1') and kind = 'ECONOMY')", "sym")
def search_symbols_kind_precedence(s, d):
    m = g_symbols(s, d)
    by_name = code.search_symbols(m, "ring", None, None)
    by_qname = code.search_symbols(m, "brand#1", "ECONOMY", None, kind_binds_qname_only=True)
    return by_name.union(by_qname).select("id", "name", "kind").distinct()


def _raw_calls(s, d):
    """Calls by name; each thirteenth callee is a name that no symbol bears."""
    e, m = g_edges(s, d), g_symbols(s, d).select(F.col("id").alias("dst"), F.col("name").alias("n"))
    name = F.when(F.col("dst") % 13 == 0, F.concat(F.lit("ext_"), (F.col("dst") % 10).cast("string"))).otherwise(F.col("n"))
    return e.join(m, "dst").select(F.col("src").alias("caller_id"), name.alias("callee_name"), name.alias("callee_qname"), F.lit("f").alias("file"), F.col("dst").cast("int").alias("line"))


VIEWS["raw"] = "select src as caller_id, case when dst % 13 = 0 then 'ext_' || (dst % 10) else name end as callee_name, dst as line from calls join sym on id = dst"
_NEEDS["raw"] = ["calls", "sym"]


@query("call_edge_counts", "select caller_id as src_id, id as dst_id, min(line)::integer as line, count(*)::bigint as cnt from raw join sym on name = callee_name group by all", "raw sym")
def call_edge_counts(s, d):
    return ingest.resolve_calls(_raw_calls(s, d), g_symbols(s, d)).where("dst_id is not null").select("src_id", "dst_id", "line", "cnt")


@query("external_calls", "select callee_name as name, count(distinct caller_id)::bigint as callers, count(*)::bigint as calls from raw where starts_with(callee_name, 'ext_') group by all", "raw sym")
def external_calls(s, d):
    e = ingest.resolve_calls(_raw_calls(s, d), g_symbols(s, d)).where("dst_id is null")
    return e.groupBy(F.col("dst_external").alias("name")).agg(F.countDistinct("src_id").alias("callers"), F.sum("cnt").alias("calls"))


@query("hunk_overlap", "select distinct s.id, s.file from sym s join (select distinct p_brand as file, p_size as a, p_size + 1 as b from part where p_partkey % 50 = 1) h on h.file = s.file and h.a <= s.end_line and h.b >= s.start_line", "sym")
def hunk_overlap(s, d):
    return impact.touched_symbols(g_symbols(s, d), _hunks(s, d)).select("id", "file")


def _hunks(s, d):
    p = table(s, d, "part").where("p_partkey % 50 = 1")
    return p.select(F.col("p_brand").alias("file"), F.lit("modified").alias("change_type"), F.col("p_size").alias("start"), (F.col("p_size") + 1).alias("end")).distinct()


@query("diff_risk", """with t as (select distinct s.* from sym s join (select distinct p_brand as file, p_size as a, p_size + 1 as b from part where p_partkey % 50 = 1) h on h.file = s.file and h.a <= s.end_line and h.b >= s.start_line),
n as (select name, file, count(*) as callers from calls join sym on id = dst group by all), k as (select coalesce(sum(coalesce(callers, 0)), 0)::bigint as callers, count(*)::bigint as symbols from t left join n using (name, file)), f as (select count(distinct p_brand)::bigint as files from part where p_partkey % 50 = 1)
select callers, symbols, files, case when callers > 20 or files > 10 then 'critical' when callers > 8 or files > 4 then 'high' when callers > 2 or files > 1 then 'medium' else 'low' end as level from k, f""", "calls sym")
def diff_risk(s, d):
    return impact.diff_impact(graph(s, d), _hunks(s, d))["risk"].drop("tests")


def _bodies(s, d):
    t = table(s, d, "documents")
    h = F.substring(F.sha2(F.lower("text"), 256), 1, 16)
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("source").alias("qname"), F.col("lang").alias("file"), F.lit("").alias("signature"), h.alias("structural_hash"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))


VIEWS["bod"] = "select doc_id as id, source as name, lang as file, substr(sha256(lower(text)), 1, 16) as h from documents"


@query("clone_members", "select b.id, first_id, members, case when b.name = f.name then 'Type-1' else 'Type-2' end as clone_type from bod b join (select h, count(*)::bigint as members, min(id) as first_id from bod group by h having count(*) > 1) g on g.h = b.h join bod f on f.id = first_id", "bod")
def clone_members(s, d):
    return code.clone_members(_bodies(s, d))


@query("clone_pairs_top", "select a.id as id_1, b.id as id_2, a.name as name_1, b.name as name_2, case when a.name = b.name then 'Type-1' else 'Type-2' end as clone_type, case when a.name = b.name then 100 else 95 end as similarity from bod a join bod b on a.h = b.h and a.id < b.id order by id_1, id_2 limit 25", "bod")
def clone_pairs_top(s, d):
    return code.similar_functions(_bodies(s, d)).drop("file_1", "file_2")


@query("clone_groups", "select h as structural_hash, count(*)::bigint as members, min(id) as first_id from bod group by h having count(*) > 1", "bod")
def clone_groups(s, d):
    return code.clone_groups(_bodies(s, d))


@query("clone_type_counts", "select case when a.name = b.name then 'Type-1' else 'Type-2' end as clone_type, count(*)::bigint as pairs from bod a join bod b on a.h = b.h and a.id < b.id group by all", "bod")
def clone_type_counts(s, d):
    return code.clone_type_counts(_bodies(s, d))


@query("dice_similarity", """with p as (select a.item_id as pair, a.text as a, b.text as b from benchmark a join benchmark b on b.item_id = a.item_id + 1),
ga as (select pair, w[i] || ' ' || w[i + 1] as g, count(*) as n from (select pair, w, unnest(range(1, len(w))) as i from (select pair, string_split(a, ' ') as w from p)) group by all), gb as (select pair, w[i] || ' ' || w[i + 1] as g, count(*) as n from (select pair, w, unnest(range(1, len(w))) as i from (select pair, string_split(b, ' ') as w from p)) group by all),
j as (select coalesce(ga.pair, gb.pair) as pair, sum(least(coalesce(ga.n, 0), coalesce(gb.n, 0))) as c, sum(coalesce(ga.n, 0) + coalesce(gb.n, 0)) as t from ga full join gb on ga.pair = gb.pair and ga.g = gb.g group by all)
select p.pair, round(case when a = b then 1.0 when a = '' or b = '' or t is null then 0.0 else 2.0 * c / t end, 9)::double as similarity from p left join j using (pair)""")
def dice_similarity(s, d):
    b = table(s, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("pair"), F.col("text").alias("a")).join(b.select((F.col("item_id") - 1).alias("pair"), F.col("text").alias("b")), "pair")
    return text.dice(pairs).withColumn("similarity", F.round("similarity", 9))


def _docs(s, d):
    return table(s, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


def _sections(s, d):
    """Every line of a document is a section."""
    return text.lines_of(_docs(s, d)).select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("id"), F.col("path").alias("document_path"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"), F.lit(1).alias("level"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))


VIEWS["doc"] = "select source || '/' || doc_id || '.md' as path, text as content from documents"
VIEWS["lin"] = "select path, unnest(range(1, len(l) + 1))::integer as line, unnest(l) as text from (select path, string_split(content, chr(10)) as l from doc)"
_NEEDS["lin"] = ["doc"]


@query("knowledge_doc_rank", "select path, case when path = '3.md' then 0 when ends_with(path, '/3.md') then 2 end as rank from doc where path = '3.md' or ends_with(path, '/3.md') order by rank, path limit 1", "doc")
def knowledge_doc_rank(s, d):
    return knowledge.find_document(_docs(s, d).select("path", F.col("path").alias("title")), "3.md").select("path", "rank")


@query("doc_category", "select case when contains(p, 'adr') or contains(p, 'decision') then 'ADR' when contains(p, 'arch') or contains(p, 'design') then 'Architecture' when contains(p, 'guide') or contains(p, 'rule') or contains(p, 'standard') then 'Guidelines' when contains(p, 'api') or contains(p, 'spec') then 'API Spec' else 'Documentation' end as category, count(*)::bigint as pages from (select lower(url) as p from pages) group by all")
def doc_category(s, d):
    return table(s, d, "pages").groupBy(text.doc_category(F.col("url")).alias("category")).agg(F.count("*").alias("pages"))


@query("doc_symbol_link", """with w as (select path, unnest(list_distinct(string_split(content, ' '))) as w from doc), m as (select item_id as id, string_split(text, ' ') as l from benchmark)
select path as section_id, id as symbol_id from w join m on w = l[1] union select path, id from w join m on w = l[-1]""", "doc")
def doc_symbol_link(s, d):
    """Benchmark items stand for symbols here, since parts' names are in no document: the first word is the name, the last one the qname."""
    refs = _docs(s, d).select(F.col("path").alias("id"), F.array_distinct(F.split("content", " ")).alias("referenced_symbols"))
    words = F.split("text", " ")
    return link.sections_to_symbols(refs, table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.get(words, F.lit(0)).alias("name"), F.element_at(words, -1).alias("qname")))


@query("spec_flow", f"""with recursive f as (select id as node, 0 as depth from sym where name = '{WANTED}' union select c.dst, depth + 1 from f join calls c on c.src = node where depth < 3),
m as (select node, min(depth) as depth from f group by all), r as (select s.*, depth, row_number() over (partition by file, name order by depth, start_line, id) as n from m join sym s on s.id = node)
select id, name, qname, kind, file, start_line, depth from r where n = 1""", "calls sym")
def spec_flow(s, d):
    m = g_symbols(s, d)
    g = graph(s, d).with_tables(
        documents=s.createDataFrame([("d.md", "D", "API Spec", "")], "path string, title string, category string, hash string"),
        sections=s.createDataFrame([("d.md:1", "d.md", "Feature", "text", 1, 1, 2, [WANTED])], "id string, document_path string, title string, content string, level int, start_line int, end_line int, referenced_symbols array<string>"),
        documents_edges=m.where(F.col("name") == WANTED).select(F.lit("d.md:1").alias("section_id"), F.col("id").alias("symbol_id")),
    )
    return knowledge.spec_code_flow(g, "Feature", 3)["flow"]


@query("symbol_features_union", "select 'section' as kind, path, '' as title, substr(content, 1, 180) as snippet from doc where contains(content, 'Apache') union select 'rule', path, '', substr(content, 1, 180) from doc where contains(content, 'GNU')", "doc")
def symbol_features_union(s, d):
    docs, target = _docs(s, d), g_symbols(s, d).where(F.col("name") == WANTED).select(F.col("id").alias("symbol_id"))
    part = docs.select(F.col("path").alias("id"), F.col("path").alias("document_path"), F.col("path").alias("source_doc"), F.lit("").alias("title"), "content")
    ids = lambda word, name: part.where(F.col("content").contains(word)).select(F.col("id").alias(name)).crossJoin(target.limit(1))  # noqa: E731  one symbol
    g = graph(s, d).with_tables(sections=part, rules=part, documents_edges=ids("Apache", "section_id"), governs=ids("GNU", "rule_id"))
    return knowledge.symbol_spec_features(g, WANTED, search_callers=False)["direct"]


@query("normalise_identifier", r"select c_name as name, lower(regexp_replace(regexp_replace(c_name || 'Of' || c_mktsegment, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[-\s]', '_', 'g')) as normal from customer")
def normalise_identifier(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_name").alias("name"), names.normalize_identifier(F.concat("c_name", F.lit("Of"), "c_mktsegment")).alias("normal"))


#: Fields by nation, attributes by region: names made of the nations' and regions' names.
VIEWS["fld"] = "select n_regionkey as entity_id, n_nationkey as field_id, case n_nationkey % 4 when 0 then 'id' when 1 then n_name when 2 then lower(n_name) else n_name || 'Key' end as field from nation"
VIEWS["att"] = "select n_regionkey as entity_id, n_nationkey as attribute_id, case n_nationkey % 3 when 0 then 'row_id' when 1 then lower(n_name) else n_name end as attribute from nation"


def _mapping(s, d):
    n = table(s, d, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    f = n.select(F.col("n_regionkey").alias("entity_id"), k.alias("field_id"), F.when(k % 4 == 0, "id").when(k % 4 == 1, name).when(k % 4 == 2, F.lower(name)).otherwise(F.concat(name, F.lit("Key"))).alias("field"), F.lit("int").alias("raw_type"))
    a = n.select(F.col("n_regionkey").alias("entity_id"), k.alias("attribute_id"), F.when(k % 3 == 0, "row_id").when(k % 3 == 1, F.lower(name)).otherwise(name).alias("attribute"), F.lit("BIGINT").alias("data_type"), F.lit("column").alias("attribute_role"), F.lit("sql").alias("engine"))
    return f, a


_N = "lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[-\\s]', '_', 'g'))"
_BEST = """with p as (select f.*, a.attribute_id, a.attribute, %s as x, %s as y from fld f join att a using (entity_id)),
c as (select *, case when field = attribute then 1.0 when x = y then 0.95 when (x = 'id' and ends_with(y, '_id')) or (y = 'id' and ends_with(x, '_id')) or (y = '_id' and ends_with(x, 'id')) then 0.9 when contains(x, y) or contains(y, x) then 0.7 else 0 end::double as confidence from p),
b as (select *, row_number() over (partition by entity_id, field_id order by confidence desc, attribute_id) as r from c where confidence >= 0.7) """ % (_N.format("field"), _N.format("attribute"))


@query("field_match_best", _BEST + "select entity_id, field_id, field, attribute, confidence, case confidence when 1.0 then 'exact_name' when 0.95 then 'case_normalized' when 0.9 then 'identifier_convention' else 'substring_heuristic' end as rule from b where r = 1", "fld att")
def field_match_best(s, d):
    return storage.best_matches(*_mapping(s, d)).select("entity_id", "field_id", "field", "attribute", "confidence", "rule")


@query("unmapped_fields", _BEST + "select entity_id, field_id, field from fld where field_id not in (select field_id from b)", "fld att")
def unmapped_fields(s, d):
    f, a = _mapping(s, d)
    return f.join(storage.best_matches(f, a).select("field_id"), "field_id", "left_anti").select("entity_id", "field_id", "field")


@query("mapping_compat", _BEST + ", k as (select entity_id, count(*)::bigint as fields, count(distinct b.field_id)::bigint as mapped from fld left join (select field_id from b where r = 1) b using (field_id) group by all) select entity_id, fields, mapped, case when mapped / fields >= 0.8 then 'high' when mapped / fields >= 0.5 then 'medium' else 'low' end as compatibility from k", "fld att")
def mapping_compat(s, d):
    f, a = _mapping(s, d)
    best = storage.best_matches(f, a).groupBy("entity_id").agg(F.count("*").alias("mapped"))
    k = f.groupBy("entity_id").agg(F.count("*").alias("fields")).join(best, "entity_id", "left").withColumn("mapped", F.coalesce("mapped", F.lit(0)).cast("long"))
    return k.withColumn("compatibility", names.compatibility(F.col("mapped") / F.col("fields")))


@query("migration_impact", "select (select count(*) from fld where contains(%s, 'in') or contains('in', %s))::bigint as contracts, (select count(*) from sym where contains(name, 'in'))::bigint as symbols, 'critical' as level" % (_N.format("field"), _N.format("field")), "fld sym")
def migration_impact(s, d):
    f, _ = _mapping(s, d)
    entities = table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("file"))
    g = graph(s, d).with_tables(contract_fields=f.select("entity_id", F.col("field").alias("name"), "raw_type"), contract_entities=entities)
    return storage.storage_migration_impact(g, "orders", "in", "drop", limit=None)["risk"].drop("tests")


@query("url_imports", """select page_id, h as imported_path from (select page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) as h from pages)""")
def url_imports(s, d):
    p = table(s, d, "pages")
    raw = p.select(F.col("page_id").cast("string").alias("src_path"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("imported_path"))
    raw = raw.withColumn("candidates", F.array("imported_path")).withColumn("specifiers", F.array().cast("array<string>"))
    files = p.select(F.col("url").alias("path"))
    return ingest.resolve_imports(raw, files).where("is_external").select(F.col("src_path").cast("long").alias("page_id"), "imported_path")


@query("library_slice", "select name, count(*)::bigint as call_edges, count(distinct file)::bigint as files from (select c.*, s.file, t.name from calls c join sym s on s.id = src join sym t on t.id = dst) where file in (select file from sym where id % 40 = 0) and name in (select name from sym where id % 25 = 0) group by all", "calls sym")
def library_slice(s, d):
    """The files of each fortieth symbol import the names of each twenty-fifth."""
    m = g_symbols(s, d)
    names_ = m.where("id % 25 = 0").groupBy().agg(F.collect_set("name").alias("specifiers"))  # 64 names at most
    imports = m.where("id % 40 = 0").select(F.col("file").alias("src_path")).distinct().crossJoin(names_).withColumn("imported_path", F.lit("lib")).withColumn("dst_path", F.lit("lib"))
    calls = g_calls(s, d).join(m.select(F.col("id").alias("dst_id"), F.col("name").alias("callee_name")), "dst_id").withColumn("callee_qname", F.col("callee_name"))
    files = m.select(F.col("file").alias("path")).distinct().withColumn("library_aliases", F.array().cast("array<struct<alias:string,module:string>>"))
    used = porting.third_party_slice(graph(s, d).with_tables(files=files, imports=imports, calls=calls), "lib")["usage"]
    return used.select("name", "call_edges", F.size("files").cast("long").alias("files"))


@query("stats_by_language", "select lang as language, count(*)::bigint as files from documents group by all")
def stats_by_language(s, d):
    g = graph(s, d).with_tables(files=table(s, d, "documents").select(F.col("lang").alias("language")))
    return code.stats(g)["languages"]


_EXT = "'.' || case doc_id % 6 when 0 then 'ts' when 1 then 'py' when 2 then 'rs' when 3 then 'md' when 4 then 'json' else 'xyz' end"


def _paths(s, d):
    k = F.col("doc_id") % 6
    ext = F.when(k == 0, "ts").when(k == 1, "py").when(k == 2, "rs").when(k == 3, "md").when(k == 4, "json").otherwise("xyz")
    folder = F.when(F.col("doc_id") % 9 == 0, "node_modules").when(F.col("doc_id") % 9 == 1, "tests").otherwise("src")
    return table(s, d, "documents").select("doc_id", F.concat(folder, F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.octet_length("text").cast("long").alias("length"))


VIEWS["pth"] = "select doc_id, case doc_id % 9 when 0 then 'node_modules' when 1 then 'tests' else 'src' end || '/f' || doc_id || " + _EXT + " as path, octet_length(encode(text))::bigint as length from documents"


@query("language_detect", "select path, case doc_id % 6 when 0 then 'typescript' when 1 then 'python' when 2 then 'rust' end as language from pth", "pth")
def language_detect(s, d):
    return _paths(s, d).select("path", text.language(F.col("path")).alias("language"))


@query("is_test_file", "select path, (contains(path, '.test.') or contains(path, '/tests/') or starts_with(path, 'tests/') or starts_with(path, 'test/') or starts_with(path, 'test_') or contains(path, '.spec.') or contains(path, '_test.') or contains(path, '/__tests__/') or contains(path, '/test/')) as is_test from pth", "pth")
def is_test_file(s, d):
    return _paths(s, d).select("path", text.is_test_file(F.col("path")).alias("is_test"))


@query("skip_reason", "select path, case when doc_id % 9 = 0 then 'ignored' when doc_id % 6 in (4, 5) then 'extension' when length > 4000 then 'too-large' else 'ok' end as reason from pth", "pth")
def skip_reason(s, d):
    return _paths(s, d).select("path", discovery.skip_reason(F.col("path"), F.col("length"), F.lit(False), 4000).alias("reason"))


_SNAP = """with o as (select doc_id as path, 1 as mtime, sha256(text) as hash from documents where doc_id % 10 <> 3),
n as (select doc_id as path, case when doc_id % 4 = 0 then 2 else 1 end as mtime, case when doc_id % 8 = 0 then 'x' else sha256(text) end as hash from documents where doc_id % 10 <> 7) """


def _snapshots(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("h"))
    old = t.where("path % 10 <> 3").select("path", F.lit(1).alias("mtime_ms"), F.col("h").alias("hash"))
    new = t.where("path % 10 <> 7").select("path", F.when(F.col("path") % 4 == 0, 2).otherwise(1).alias("mtime_ms"), F.when(F.col("path") % 8 == 0, "x").otherwise(F.col("h")).alias("hash"))
    return old, new


@query("stale_diff", _SNAP + "select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' else 'changed' end as change from o full join n on o.path = n.path where o.path is null or n.path is null or (o.mtime <> n.mtime and o.hash <> n.hash)")
def stale_diff(s, d):
    return snapshot.stale(*_snapshots(s, d))


@query("manifest_dedup", _SNAP + "select n.path from n left join o on o.path = n.path where o.hash is distinct from n.hash")
def manifest_dedup(s, d):
    old, new = _snapshots(s, d)
    return snapshot.unseen(new, old).select("path")


# the pattern language


def _pattern(name: str, text: str, sql: str, views: str = "calls sym", **parameters) -> None:
    query(name, sql, views)(lambda s, d: pattern.match(s, graph(s, d), text, **parameters))


_pattern("pattern_match", "MATCH (a:Symbol)-[r:CALLS]->(b:Symbol) WHERE b.name = $n AND a.isExported RETURN a.name AS caller, r.count AS n, type(r) AS t", "select a.name as caller, 1::bigint as n, 'CALLS' as t from calls join sym a on a.id = src join sym b on b.id = dst where b.name = 'small ring' and a.is_exported", n=WANTED)
_pattern("pattern_optional", "MATCH (a:Symbol) WHERE a.name = $n OPTIONAL MATCH (a)-[:CALLS]->(b:Symbol) WHERE b.isExported RETURN a.id AS id, b.id AS other, head(labels(a)) AS l", "select a.id, b.id as other, 'Symbol' as l from sym a left join (calls join sym b on b.id = dst and b.is_exported) on src = a.id where a.name = 'small ring'", n=WANTED)
_pattern("pattern_trails", "MATCH p = (a:Symbol)<-[:CALLS*1..3]-(b:Symbol) WHERE a.name = $n RETURN a.id AS seed, b.id AS node, length(p) AS depth", _TRAILS + "select seed, node, depth from walk", n=WANTED)
_pattern("pattern_union", "MATCH (a:Symbol) WHERE a.kind = 'ECONOMY' RETURN a.file AS x UNION MATCH (a:Symbol) WHERE a.startLine > 45 RETURN a.name AS x", "select file as x from sym where kind = 'ECONOMY' union select name from sym where start_line > 45", "sym")
_pattern("pattern_with", "MATCH (a:Symbol)-[:CALLS]->(b:Symbol) WITH a, count(b) AS n WHERE n >= 2 MATCH (a)-[:EXTENDS]->(c:Symbol) RETURN a.id AS id, n, c.name AS parent", "select a.id, n, c.name as parent from (select src, count(*)::bigint as n from calls group by all having count(*) >= 2) join sym a on a.id = src join her h on h.sub_id = a.id and not is_external join sym c on c.id = super_id", "calls sym her")
_pattern("pattern_lists", "MATCH (a:Symbol) WHERE a.name IN $names AND NOT a.kind IN ['ECONOMY'] RETURN a.kind AS kind, count(*) AS n, size(collect(DISTINCT a.name)) AS names", "select kind, count(*)::bigint as n, count(distinct name)::integer as names from sym where name in ('small ring', 'red widget') and kind <> 'ECONOMY' group by all", "sym", names=[WANTED, "red widget"])
_pattern("pattern_conditions", "MATCH (a:Symbol) WHERE a.isExported AND NOT (a)<-[:CALLS]-(:Symbol) AND (a)-[:CALLS]->(:Symbol) AND (a.name CONTAINS 'ring' OR a.qname STARTS WITH 'Brand#1') RETURN a.id AS id", "select id from sym where is_exported and id not in (select dst from calls) and id in (select src from calls) and (contains(name, 'ring') or starts_with(qname, 'Brand#1'))")
_pattern("pattern_order", "MATCH (a:Symbol) RETURN DISTINCT a.kind AS kind, CASE WHEN a.kind = 'PROMO' THEN 0 ELSE 1 END AS r ORDER BY r, kind DESC SKIP 1 LIMIT 3", "select distinct kind, case when kind = 'PROMO' then 0 else 1 end as r from sym order by r, kind desc limit 3 offset 1", "sym")
_pattern("pattern_any_direction", "MATCH (a:Symbol {name: $n})-[:CALLS|EXTENDS]-(b:Symbol) RETURN toUpper(b.name) AS name, count(*) AS n", "select upper(b.name) as name, count(*)::bigint as n from (select src, dst from calls union all select dst, src from calls union all select sub_id, super_id from her where not is_external union all select super_id, sub_id from her where not is_external) join sym a on a.id = src join sym b on b.id = dst where a.name = 'small ring' group by all", "calls sym her", n=WANTED)


def queries() -> dict[str, Query]:
    return _QUERIES | rendered.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | rendered.SQL
