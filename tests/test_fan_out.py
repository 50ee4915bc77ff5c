"""Steps whose rows fan out: results as by plain loops, and nothing grouped or shuffled where all rows have been made."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symgraph import extract, rendered
from symgraph.operators import code, ingest

SYMBOLS = "id string, name string, qname string"
RAW = "caller_id string, callee_name string, callee_qname string, file string, line int"


def _before_joins(df) -> str:
    """What the optimized plan does after its last join."""
    return df._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]


def _edges(raw, symbols):
    """One edge per (caller, callee), by loops."""
    out = {}
    for caller, name, qname, _, line in raw:
        for src in [i for i, _, _ in symbols if i == caller] or [i for i, n, _ in symbols if n == caller]:
            hits = sorted({i for i, n, q in symbols if name is not None and name in (n, q)})
            for key in [(src, h, None) for h in hits] or [(src, None, name)]:
                out.setdefault(key, []).append((line or 0, name or "", qname or ""))
    return sorted(((*k, min(v)[0], len(v), *min(v)[1:]) for k, v in out.items()), key=repr)


@pytest.mark.parametrize("most", [1000, 3])
def test_calls_fan_out_last(spark, monkeypatch, most):
    monkeypatch.setattr(ingest, "BEARERS", most, raising=False)
    rng = random.Random(most)
    names = ["a", "b", "c.a", "b.a", "c", "d.b"]
    symbols = [(f"s{i}", rng.choice(names), rng.choice([*names, None, f"c.{i % 3}"])) for i in range(40)] + [("n1", None, "d.b"), ("n2", None, None), ("x", "a.a", "a.a")]
    callees = [*names, "a.a", "c.1", "out", "far.out", None]
    raw = [(rng.choice(["s1", "s2", "s3", "x", "a", "c.a", "nobody"]), n := rng.choice(callees), f"q.{n}", "f", rng.choice([None, 1, 2, 7, 9])) for _ in range(150)]
    found = ingest.resolve_calls(spark.createDataFrame(raw, RAW), spark.createDataFrame(symbols, SYMBOLS))
    rows = [tuple(r) for r in found.select("src_id", "dst_id", "dst_external", "line", "cnt", F.coalesce("callee_name", F.lit("")), F.coalesce("callee_qname", F.lit(""))).collect()]
    assert sorted(rows, key=repr) == _edges(raw, symbols)
    assert "Aggregate" not in _before_joins(found)


def test_parsing_is_spread(spark, tmp_path, monkeypatch):
    """Keys in one small file, as the suppliers are: rendering and parsing take many tasks."""
    spark.range(1, 2001, 1, 1).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    keys = rendered.keys(spark, str(tmp_path))
    assert keys.rdd.getNumPartitions() >= 8 and keys.count() == 2000
    files = rendered.files_of(keys.coalesce(1), [(rendered.SOURCES["bash"].path("bash"), rendered.SOURCES["bash"].text)])
    monkeypatch.setattr(extract, "FILES", 100, raising=False)
    facts = extract.facts(files)
    ok, parsed = facts["errors"].of_cut
    assert ok.count() == 2000 and facts["symbols"].count() == 2000
    sizes = [r["count"] for r in ok.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 100
    assert parsed.select(F.input_file_name()).distinct().count() > 1


@pytest.mark.parametrize("name, rows", [("parse_imports", 16), ("parse_heritage", 13), ("parse_calls", 19), ("heritage_edges", 3)])
def test_rendered_queries_are_spread(spark, tmp_path, monkeypatch, name, rows):
    monkeypatch.setattr(rendered, "UNITS", 10, raising=False)
    spark.range(1, 81, 1, 1).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = rendered.QUERIES[name](spark, str(tmp_path))
    assert found.count() == 80 * rows and len(found.inputFiles()) > 1


def test_members_are_found_by_owner(spark):
    """Members by file and owner, as by loops, and by no join on the file alone."""
    rng = random.Random(4)
    names = ["a", "b", "a.b", "", "c"]
    symbols = [(i, n := rng.choice(names), rng.choice([n, *(f"{o}.{n}" for o in names), f".{n}", f"{n}.", None]), rng.choice(["interface", "class"]), f"f{i % 3}") for i in range(120)]
    heritage = sorted({(rng.randrange(120), rng.randrange(120)) for _ in range(60)})
    df = spark.createDataFrame(symbols, "id long, name string, qname string, kind string, file string")
    by = {s[0]: s for s in symbols}
    interfaces = {s[0] for s in symbols if any(o[3] == "interface" and o[4] == s[4] and s[2] == f"{o[1]}.{s[1]}" for o in symbols)}
    asked = {m[0] for sub, sup in heritage for m in symbols if m[4] == by[sub][4] and m[2] == f"{by[sub][1]}.{m[1]}" and any(d[2] == f"{by[sup][1]}.{m[1]}" for d in symbols)}
    members = code.contract_members(df, spark.createDataFrame([(a, b, False) for a, b in heritage], "sub_id long, super_id long, is_external boolean"))
    assert interfaces and asked
    for found, want in ((code.interface_members(df), interfaces), (members, asked)):
        assert sorted(r["id"] for r in found.collect()) == sorted(want)
        assert not re.search(r"Join [^\n]*(?:Inner|LeftSemi),[^\n]*concat_ws", found._jdf.queryExecution().executedPlan().toString())


def test_heritage_fans_out_last(spark):
    """Names that many symbols bear: each edge once, and nothing grouped after the last join."""
    symbols = [(f"p:{n}:{i}", n, q) for i, (n, q) in enumerate([("a", "a"), ("a", "c.a"), ("b", "a"), ("c", None), ("c", "c")])]
    raw = [("p:a:0", "a", "extends", "p"), ("p:a:0", "a", "extends", "p"), ("p:c", "a", "implements", "p"), ("p:c:3", "a", "implements", "p"), ("p:b:2", "out", "extends", "p"), ("p:gone", "a", "extends", "p")]
    found = ingest.resolve_heritage(spark.createDataFrame(raw, "sub_id string, super_name string, rel string, file string"), spark.createDataFrame(symbols, SYMBOLS))
    bear = lambda ref: {i for i, n, q in symbols if ref in (n, q)}
    want = {(s, t, n, rel) for sub, n, rel, _ in raw for s in ({sub} & {x[0] for x in symbols} or bear(sub.split(":")[1])) for t in bear(n) or {None}}
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(((*w, w[1] is None) for w in want), key=repr)
    assert "Aggregate" not in _before_joins(found)
