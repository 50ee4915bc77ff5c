"""The corpus queries that SQL can express, against it in DuckDB; the quality rules also on texts with edge cases."""

import os

import pytest

from symgraph.llm import quality_rules, queries

SF = "/root/testdata/sf0.001"


def _rows(df, columns):
    import pandas as pd

    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    have, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert _rows(have, sorted(have.columns)) == _rows(want, sorted(have.columns))


def test_quality_rules_sql_on_edge_cases(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    texts = [None, "", " \n\t ", "one two", "a b c a b c", "a a a a a", "x\nx\n\n \nx y\nx\r\n" * 9, "the # of | and $ <a> " * 30, "Ünï ÇA é漢😀 " * 60, "die für und der " + " ".join(f"Wort{i}" for i in range(60)), "a\x1cb\u0085c d " * 20]
    rows = pd.DataFrame({"doc_id": list(range(len(texts))) + [3], "text": texts + ["one two"]})
    have = quality_rules.quality_rules(spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "doc_id long, text string")).toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    want = con.execute(quality_rules.ORACLE_SQL).df()
    assert _rows(have, sorted(have.columns)) == _rows(want, sorted(have.columns))
    assert have["kept"].any() and not have["kept"].all()
