"""Impact: transitive callers and their risk, affected tests, call paths, cycles, changes of a diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import SymGraph, name_or_qname
from ..plans.traverse import clamp, cycles, reach, shortest_paths, trails
from .link import tests_holding


def call_edges(calls: DataFrame) -> DataFrame:
    return calls.where("dst_id is not null").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def affected_tests(g: SymGraph, changed: DataFrame) -> DataFrame:
    """``changed(file)`` -> ``(file, test_path)``: tests that import the file, or whose path holds the file's path without its extension."""
    tests = g.files.where("is_test").select(F.col("path").alias("test_path"))
    importing = g.imports.where("not is_external").join(tests, F.col("src_path") == F.col("test_path"), "left_semi").select(F.col("dst_path").alias("file"), F.col("src_path").alias("test_path"))
    by_import = changed.select("file").distinct().join(importing, "file")
    by_name = tests_holding(changed.select("file").distinct(), tests)
    return by_import.unionByName(by_name).where("file <> test_path").distinct()


def risk_level(callers: Column, files: Column) -> Column:
    return F.when(callers == 0, "low").when((callers < 5) & (files <= 2), "medium").when(callers < 20, "high").otherwise("critical")


def blast_paths(g: SymGraph, wanted: str, depth=3) -> DataFrame:
    """A row per call path into the target: ``(depth, caller_id, caller_name, caller_qname, caller_file, caller_line, target_id, target_name)``."""
    target = g.symbols.where(name_or_qname(g.symbols, wanted)).select(F.col("id").alias("seed"))
    paths = trails(call_edges(g.calls), target, clamp(depth), backwards=True).select("seed", "node", "depth")
    s = g.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("qname").alias("caller_qname"), F.col("file").alias("caller_file"), F.col("start_line").alias("caller_line"))
    t = g.symbols.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("file").alias("target_file"))
    return paths.join(s, F.col("node") == F.col("caller_id")).join(t, F.col("seed") == F.col("target_id")).drop("seed", "node")


def blast_radius(g: SymGraph, wanted: str, depth=3) -> dict[str, DataFrame]:
    """``chain``: the paths; ``tests``; ``risk``: one row of counts, level and score; ``reach``: callers with least depth."""
    chain = blast_paths(g, wanted, depth)
    target = g.symbols.where(name_or_qname(g.symbols, wanted))
    files = chain.select(F.col("caller_file").alias("file")).union(target.select("file")).distinct()
    tests = affected_tests(g, files).select("test_path").distinct()
    counts = chain.agg(F.count("*").alias("callers"), F.countDistinct("caller_file").alias("files")).crossJoin(tests.agg(F.count("*").alias("tests")))  # one row each
    score = F.least(F.lit(100), F.col("callers") * 5 + F.col("files") * 10)
    risk = counts.select("callers", "files", "tests", risk_level(F.col("callers"), F.col("files")).alias("level"), score.alias("score"))
    near = reach(call_edges(g.calls), target.select(F.col("id").alias("seed")), clamp(depth), backwards=True)
    return {"chain": chain, "tests": tests, "risk": risk, "reach": near}


def detect_cycles(g: SymGraph, limit: int | None = 20, canonical: bool = False) -> DataFrame:
    """Import cycles of 2 to 6 edges, each rotation a row unless ``canonical``; self-imports are none."""
    edges = g.imports.where("not is_external").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    found = cycles(edges, canonical=canonical).distinct()
    return found if limit is None else found.orderBy("length", F.array_join("nodes", ">")).limit(limit)


def call_path(g: SymGraph, source: str, target: str, most: int = 12) -> DataFrame:
    """The shortest call path of 1 to ``most`` edges between any symbols of these names: one row or none."""
    ids = lambda wanted, column: g.symbols.where(name_or_qname(g.symbols, wanted)).select(F.col("id").alias(column))
    found = shortest_paths(call_edges(g.calls), ids(source, "source"), ids(target, "target"), most, nearest=True)
    return found.orderBy("hops", F.array_join("path", ">")).limit(1)


def path_nodes(g: SymGraph, path: DataFrame) -> DataFrame:
    """The symbols of a call path in order."""
    return path.select(F.posexplode("path").alias("position", "_n")).join(g.symbols, F.col("_n") == F.col("id")).select("position", "id", "name", "qname", "file", "start_line").orderBy("position")


def touched_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """``hunks(file, change_type, start, end)``, null range: the whole file. Symbols whose lines overlap a hunk: an equality on file and two inequalities on lines."""
    h = hunks.select(F.col("file").alias("_f"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    overlap = (F.col("file") == F.col("_f")) & (F.col("_a").isNull() | ((F.col("_a") <= F.col("end_line")) & (F.col("_b") >= F.col("start_line"))))
    return symbols.join(h, overlap, "left_semi")


def diff_risk(callers: Column, files: Column) -> Column:
    return F.when((callers > 20) | (files > 10), "critical").when((callers > 8) | (files > 4), "high").when((callers > 2) | (files > 1), "medium").otherwise("low")


def diff_impact(g: SymGraph, hunks: DataFrame) -> dict[str, DataFrame]:
    """``symbols`` touched with their direct callers by name and file, ``tests`` of the files, ``risk``: one row."""
    touched = touched_symbols(g.symbols, hunks)
    into = g.calls.where("dst_id is not null").groupBy("dst_id").agg(F.count("*").alias("n"))
    by_name = into.join(g.symbols, F.col("dst_id") == F.col("id")).groupBy(F.col("name").alias("_n"), F.col("file").alias("_f")).agg(F.sum("n").alias("callers"))
    counted = touched.join(by_name, (F.col("name") == F.col("_n")) & (F.col("file") == F.col("_f")), "left").select("id", "name", "qname", "kind", "file", "start_line", "end_line", F.coalesce("callers", F.lit(0)).cast("long").alias("callers"))
    tests = affected_tests(g, hunks.select("file")).select("test_path").distinct()
    one = counted.agg(F.coalesce(F.sum("callers"), F.lit(0)).alias("callers"), F.count("*").alias("symbols")).crossJoin(hunks.agg(F.countDistinct("file").alias("files"))).crossJoin(tests.agg(F.count("*").alias("tests")))
    return {"symbols": counted, "tests": tests, "risk": one.withColumn("level", diff_risk(F.col("callers"), F.col("files")))}
