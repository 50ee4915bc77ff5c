"""Every query against its SQL in DuckDB, at the smallest scale; traversal against a plain search on random graphs."""

import os
import random

import pandas as pd
import pytest

from symgraph import queries
from symgraph.plans.traverse import clamp, cycles, reach, shortest_paths, trails

SF = "/root/testdata/sf0.001"


def _rows(df, columns):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else bool(v) if type(v).__name__ == "bool_" else v if isinstance(v, (str, bool)) else float(v)
    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the star-schema tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    have, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert _rows(have, sorted(have.columns)) == _rows(want, sorted(have.columns))


def test_traversal(spark):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(22)})
    df, seeds = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,), (5,)], "seed int")
    found = []

    def walk(seed, node, used):
        for e in edges:
            if e[0] == node and e not in used:
                found.append((seed, e[1], len(used) + 1))
                if len(used) < 3:
                    walk(seed, e[1], [*used, e])

    for s in (0, 5):
        walk(s, s, [])
    assert sorted((r["seed"], r["node"], r["depth"]) for r in trails(df, seeds, 4).collect()) == sorted(found)
    least = {}
    for s, n, d in found:
        least[s, n] = min(d, least.get((s, n), 99))
    assert {(r["seed"], r["node"]): r["depth"] for r in reach(df, seeds, 4).collect()} == least
    targets = spark.createDataFrame([(i,) for i in range(12)], "target int")
    paths = {(r["source"], r["target"]): r for r in shortest_paths(df, seeds.withColumnRenamed("seed", "source"), targets, 4).collect()}
    assert {k: r["hops"] for k, r in paths.items()} == least
    assert all(tuple(r["path"][i : i + 2]) in set(edges) for r in paths.values() for i in range(r["hops"]))
    assert cycles(df, 2, 3).where("size(nodes) <> length + 1").count() == 0


def test_tests_holding(spark):
    from symgraph.operators.link import tests_holding

    rng = random.Random(5)
    path = lambda: "/".join(rng.choice(["", "a", "ab", "src", "index", "b.c", "a_long_segment_of_a_path", "_"]) for _ in range(rng.randint(1, 4)))
    files = sorted({path() + rng.choice([".ts", "", ".d.ts"]) for _ in range(90)} | {".env", "x/.env", "", "é.ts", "c.ts"})
    tests = sorted({path() + rng.choice([".test.ts", "_x", ""]) for _ in range(90)} | {"tests/é.test.ts", "", "tests/src/index/index.test.ts"})
    want = {(f, t) for f in files for t in tests if (f[: f.rindex(".")] if "." in f else f) in t}
    found = tests_holding(spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame([(t,) for t in tests], "test_path string"))
    assert {tuple(r) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_clamp():
    assert [clamp(x) for x in (0, float("nan"), -4, 11, 2.9, None, "x")] == [3, 3, 1, 10, 2, 3, 3]
