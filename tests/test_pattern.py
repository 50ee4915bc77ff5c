"""The pattern language over a graph that can be read off, and what it has to reject."""

import pytest

from symgraph.plans.graph import SymGraph
from symgraph.plans.pattern import match


@pytest.fixture(scope="module")
def graph(spark):
    symbols = [(i, n, f"m.{n}", "function", f"f{i % 2}.py", i, i + 2, i % 2 == 0) for i, n in enumerate("abcde")]
    return SymGraph(
        files=spark.createDataFrame([("f0.py", False), ("f1.py", True)], "path string, is_test boolean"),
        symbols=spark.createDataFrame(symbols, "id int, name string, qname string, kind string, file string, start_line int, end_line int, is_exported boolean"),
        calls=spark.createDataFrame([(0, 1, 3, 1), (1, 0, 4, 2), (1, 2, 5, 1), (2, 3, 6, 1), (0, 3, 7, 4)], "src_id int, dst_id int, line int, cnt long"),
        imports=spark.createDataFrame([], "src_path string, dst_path string"),
        heritage=spark.createDataFrame([(0, 4, "e", "extends", False), (1, 4, "e", "implements", False)], "sub_id int, super_id int, super_name string, rel string, is_external boolean"),
    )


@pytest.mark.parametrize(
    ("text", "parameters", "rows"),
    [
        ("MATCH (a:Symbol)-[r:CALLS]->(b:Symbol) WHERE b.name = $n RETURN a.name AS caller, r.count AS n ORDER BY caller LIMIT 5", {"n": "d"}, [("a", 4), ("c", 1)]),
        ("MATCH (a) OPTIONAL MATCH (a)-[:CALLS]->(b) RETURN a.name AS a, count(b) AS n ORDER BY a", {}, [("a", 2), ("b", 2), ("c", 1), ("d", 0), ("e", 0)]),
        ("MATCH (a) OPTIONAL MATCH (a)-[:CALLS]->(b) WHERE b.name = 'd' RETURN a.name AS a, b.name AS b ORDER BY a", {}, [("a", "d"), ("b", None), ("c", "d"), ("d", None), ("e", None)]),
        # a two-cycle: no edge repeats in a trail
        ("MATCH (a {name: 'a'})-[:CALLS*1..4]->(b) RETURN b.name AS name ORDER BY name", {}, [("a",), ("b",), ("c",), ("d",), ("d",), ("d",)]),
        ("MATCH p = (a {name: 'a'})-[:CALLS*1..3]->(b {name: 'd'}) RETURN length(p) AS n, nodes(p) AS ids ORDER BY n, ids", {}, [(1, [0, 3]), (3, [0, 1, 0, 3]), (3, [0, 1, 2, 3])]),
        ("MATCH (a) WHERE a.name IN $l RETURN a.name AS x UNION MATCH (b) WHERE b.isExported RETURN b.name AS x", {"l": ["a", "b"]}, [("a",), ("b",), ("c",), ("e",)]),
        ("MATCH (a {name: 'a'}) RETURN a.name AS x UNION ALL MATCH (b {name: 'a'}) RETURN b.name AS x", {}, [("a",), ("a",)]),
        ("MATCH (a) WHERE a.name IN $l RETURN a.name AS x", {"l": []}, []),
        ("MATCH (s) WHERE s.isExported AND NOT (s)<-[:CALLS]-(:Symbol) AND s.name CONTAINS 'e' RETURN DISTINCT s.name AS name", {}, [("e",)]),
        ("MATCH (a)-[r:EXTENDS|IMPLEMENTS]->(b) RETURN a.name, type(r) AS t, labels(b) AS l ORDER BY t", {}, [("a", "EXTENDS", ["Symbol"]), ("b", "IMPLEMENTS", ["Symbol"])]),
        ("MATCH (a)-[:CALLS]->(b) WITH a, count(*) AS n WHERE n > 1 MATCH (a)-[:CALLS]->(c) RETURN a.name AS a, n, c.name AS c ORDER BY a, c", {}, [("a", 2, "b"), ("a", 2, "d"), ("b", 2, "a"), ("b", 2, "c")]),
        ("MATCH (f:File)-[:CONTAINS]->(s) RETURN f.path AS p, collect(s.name) AS names, CASE WHEN count(*) > 2 THEN 'many' ELSE 'few' END AS k ORDER BY p DESC", {}, [("f1.py", ["b", "d"], "few"), ("f0.py", ["a", "c", "e"], "many")]),
        ("MATCH (s) RETURN s.name AS n ORDER BY CASE WHEN s.name = 'c' THEN 0 ELSE 1 END, n SKIP 1 LIMIT 2", {}, [("a",), ("b",)]),
        # AND before OR; what is in a literal is no clause and no parameter
        ("MATCH (s) WHERE s.name = 'a' AND s.startLine > 9 OR s.name = 'b' RETURN s.name AS n", {}, [("b",)]),
        ("MATCH (s) WHERE s.name = 'x MATCH $n RETURN' OR s.startLine >= 3 AND NOT s.isExported RETURN s.name AS n", {"n": 1}, [("d",)]),
        ("MATCH (s {name: $q}) RETURN s.name AS n", {"q": "a' OR 'a' = 'a"}, []),
        ("MATCH (a)-[:CALLS]-(b {name: 'b'}) RETURN a.name AS n, count(*) AS k ORDER BY n", {}, [("a", 2), ("c", 1)]),
        ("MATCH (a)-[:CALLS]->(b), (b)-[:CALLS]->(c) WHERE a.name = 'a' RETURN c.name AS c ORDER BY c", {}, [("a",), ("c",)]),
        ("MATCH (a {name: 'a'})-[:CALLS]->(b) MATCH (b)-[:CALLS]->(a) RETURN b.name AS b", {}, [("b",)]),
        ("MATCH (a) RETURN count(*) AS n, max(a.endLine) - min(a.startLine) AS span", {}, [(5, 6)]),
        ("MATCH (a {name: 'a'}) RETURN toUpper(a.qname) AS u, substring(a.qname, 2) AS s, split(a.file, '.') AS p, size(a.qname) AS z, 'x' + a.name AS w", {}, [("M.A", "a", ["f0", "py"], 3, "xa")]),
        ("MATCH (a) WHERE a.name =~ '[ab]' AND a.file ENDS WITH '0.py' AND a.docstring IS NULL RETURN a.name AS n", {}, None),
    ],
)
def test_queries(spark, graph, text, parameters, rows):
    if rows is None:
        with pytest.raises(Exception):  # a column that the table lacks
            match(spark, graph, text, **parameters).collect()
        return
    got = [tuple(r) for r in match(spark, graph, text, **parameters).collect()]
    assert (got if "ORDER BY" in text else sorted(got)) == rows


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a) DELETE a", "CREATE (a)", "MATCH (a) SET a.x = 1 RETURN a", "MERGE (a) RETURN a", "MATCH (a) REMOVE a.x RETURN a", "MATCH (a), (b) RETURN a.name", "MATCH (a:Nope) RETURN a.name", "MATCH (a)-[:NOPE]->(b) RETURN a.name", "MATCH (a) RETURN foo(a)",
        "MATCH (a) RETURN a.name EXTRA", "MATCH (a) WHERE a.name = $missing RETURN a.name", "MATCH (a)-[:CALLS*1..99]->(b) RETURN b.name", "MATCH (a)-[:CALLS*0..2]->(b) RETURN b.name", "MATCH (a) WHERE (a)-[:CALLS]->(:Symbol) OR a.name = 'x' RETURN a.name", "MATCH (a) RETURN DISTINCT a.name AS n ORDER BY a.file",
        "OPTIONAL MATCH (a) RETURN a.name", "MATCH (a)<-[:CALLS]->(b) RETURN a.name", "MATCH (a) RETURN 'open", "RETURN 1", "MATCH (a) RETURN a.name UNION MATCH (b) RETURN b.name UNION ALL MATCH (c) RETURN c.name", "", "UNWIND [1] AS x RETURN x", "CALL db.labels()",
    ],
)
def test_what_cannot_be_translated_is_an_error(spark, graph, text):
    with pytest.raises(ValueError):
        match(spark, graph, text).collect()
