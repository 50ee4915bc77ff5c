"""Derived edges: tests to sources, sections to symbols, rules to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import match_names


def tests_by_import(files: DataFrame, imports: DataFrame) -> DataFrame:
    tests = files.where("is_test").select(F.col("path").alias("test_path"))
    sources = files.where("not is_test").select(F.col("path").alias("src_path"))
    edges = imports.where("not is_external").select(F.col("src_path").alias("a"), F.col("dst_path").alias("b"))
    return edges.join(tests, F.col("a") == F.col("test_path")).join(sources, F.col("b") == F.col("src_path")).select("test_path", "src_path").distinct()


def names_test(test: Column, src: Column) -> Column:
    """Whether a test path names a source path by convention. A path without the suffix replaces nothing, so a test path that holds it whole matches as well."""
    swapped = lambda a, b: test.contains(F.replace(src, F.lit(a), F.lit(b)))
    return swapped(".ts", ".test.ts") | swapped(".js", ".test.js") | swapped(".go", "_test.go") | swapped(".py", "_test.py") | test.contains(F.concat(F.lit("test_"), src))


def tests_by_naming(files: DataFrame) -> DataFrame:
    """``names_test`` over all pairs, without comparing all pairs.

    A test path that holds a source path, renamed or not, holds the last word of the source's base name, which a dot
    follows in it. So sources join by that word with the suffixes of the words of test paths, and the condition verifies.
    """
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    suffixes = F.array_distinct(F.flatten(F.transform(words(F.col("test_path")), lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.length(x))))))
    stem = F.regexp_replace(F.element_at(F.split("src_path", "/"), -1), r"\.[^.]*$", "")
    tests = files.where("is_test").select(F.col("path").alias("test_path")).withColumn("w", F.explode(suffixes))
    sources = files.where("not is_test").select(F.col("path").alias("src_path")).withColumn("w", F.try_element_at(words(stem), F.lit(-1)))
    return tests.join(sources, "w").where(names_test(F.col("test_path"), F.col("src_path"))).select("test_path", "src_path").distinct()


#: Characters of a path segment, and of a path without segments, that a key holds at most.
_PREFIX, _GRAM = 16, 3


def tests_holding(files: DataFrame, tests: DataFrame) -> DataFrame:
    """``files(file)``, ``tests(test_path)`` -> ``(file, test_path)`` where the test's path holds the file's path without its extension; no pair of them all is compared.

    Where that stem has a slash, some segment of the test's path begins with the stem's last segment, and, from three segments on,
    the one before it is the same in both; without a slash, the stem's first letters are somewhere in the path. These are keys of
    an equality, and the condition verifies. An empty stem is in every path.
    """
    parts, stem = F.split("stem", "/"), F.col("stem")
    last, before = F.substring(F.element_at(parts, -1), 1, _PREFIX), F.try_element_at(parts, F.lit(-2))
    key = F.when(F.size(parts) == 1, F.concat(F.lit("any:"), F.substring(stem, 1, _GRAM))).when(F.size(parts) == 2, F.concat(F.lit("last:"), last)).otherwise(F.concat(F.lit("two:"), before, F.lit("/"), last))
    wanted = files.select("file", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem")).distinct().withColumn("key", key)

    own = F.split("test_path", "/")
    starts = lambda x: F.transform(F.sequence(F.lit(0), F.least(F.length(x), F.lit(_PREFIX))), lambda n: F.substring(x, F.lit(1), n))
    grams = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("test_path") - n + 1, F.lit(1))), lambda i: F.concat(F.lit("any:"), F.substring(F.col("test_path"), i, n)))))
    inner = F.transform(own, lambda x, i: F.when(i > 0, F.flatten(F.transform(starts(x), lambda p: F.array(F.concat(F.lit("last:"), p), F.concat(F.lit("two:"), F.get(own, i - 1), F.lit("/"), p))))).otherwise(F.array().cast("array<string>")))
    keyed = tests.select("test_path", F.explode(F.array_distinct(F.concat(grams, F.flatten(inner)))).alias("key"))
    return wanted.join(keyed, "key").where(F.col("test_path").contains(stem)).select("file", "test_path").distinct()


def sections_to_symbols(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    refs = sections.select(F.col("id").alias("section_id"), F.explode("referenced_symbols").alias("ref"))
    return refs.join(match_names(refs.select("ref").distinct(), symbols), "ref").select("section_id", "symbol_id").distinct()


def rules_to_symbols(rules: DataFrame, symbols: DataFrame) -> DataFrame:
    """Optional: a rule governs the symbols whose name is a word of its text."""
    words = rules.select(F.col("id").alias("rule_id"), F.explode(F.array_distinct(F.split(F.concat_ws(" ", "title", "content"), r"[^A-Za-z0-9_$.]+"))).alias("ref")).where("length(ref) > 2")
    return words.join(match_names(words.select("ref").distinct(), symbols), "ref").select("rule_id", "symbol_id").distinct()


def link_all(g):
    tests = tests_by_import(g.files, g.imports).unionByName(tests_by_naming(g.files)).distinct()
    more = {"tests_for": tests}
    if g.sections is not None:
        more["documents_edges"] = sections_to_symbols(g.sections, g.symbols)
    if g.rules is not None:
        more["governs"] = rules_to_symbols(g.rules, g.symbols)
    return g.with_tables(**more)
