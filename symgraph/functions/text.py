"""Paths, documents and rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by extension (fixed values).
EXTENSIONS = {
    "typescript": "ts mts cts tsx", "javascript": "js mjs cjs jsx", "python": "py pyw", "go": "go", "rust": "rs", "java": "java", "c": "c h", "cpp": "cpp hpp cc cxx hh hxx", "c_sharp": "cs csx",
    "ruby": "rb rake gemspec", "php": "php phtml php3 php4 php5 php7 php8", "kotlin": "kt kts", "scala": "scala sc", "swift": "swift", "lua": "lua", "zig": "zig", "bash": "sh bash zsh",
    "elixir": "ex exs", "solidity": "sol", "ocaml": "ml mli", "rescript": "res resi", "objc": "m mm", "vue": "vue", "embedded_template": "erb", "elisp": "el", "systemrdl": "rdl", "tlaplus": "tla",
}
NEVER_CODE = "json yaml yml toml html htm css scss md txt sql proto".split()
DOC_EXTENSIONS = "md mdx markdown txt adoc rst".split()


def extension(path: Column) -> Column:
    """Lower-cased, without its dot; empty where the base name has none or only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column, custom: dict[str, str] | None = None) -> Column:
    """By extension, or null; data and schema formats are never code, and registered extensions come first."""
    known = {e: lang for lang, names in EXTENSIONS.items() for e in names.split()} | (custom or {})
    known = {e: lang for e, lang in known.items() if e not in NEVER_CODE}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), extension(path))


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(r"[._]test\.|\.spec\.|/tests/|/__tests__/|/test/|^test_|^tests?/")


def is_doc_file(path: Column) -> Column:
    return extension(path).isin(DOC_EXTENSIONS)


def doc_category(path: Column) -> Column:
    p = F.lower(path)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: p.contains(w))
    return F.when(has("adr", "decision"), "ADR").when(has("arch", "design"), "Architecture").when(has("guide", "rule", "standard"), "Guidelines").when(has("api", "spec"), "API Spec").otherwise("Documentation")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines_of(docs: DataFrame) -> DataFrame:
    """``docs(path, content)`` -> ``(path, line int, text)``, lines from 1."""
    return docs.select("path", F.posexplode(F.split("content", "\n")).alias("_p", "text")).select("path", (F.col("_p") + 1).alias("line"), "text")


def _numbered(docs: DataFrame, heading: str) -> DataFrame:
    """Lines with the number and the heading of the section they are in; a section begins at each heading, and text before the first is one too."""
    trimmed = js_trim(F.col("text"))
    mark = F.regexp_extract(trimmed, heading, 1)
    lines = lines_of(docs).withColumn("is_heading", F.length(mark) > 0).withColumn("level", F.length(mark)).withColumn("heading", F.regexp_replace(js_trim(F.regexp_extract(trimmed, heading, 2)), r"[#*`_]", ""))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))


def sections(docs: DataFrame, heading: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """``docs(path, content)`` -> sections ``(id, document_path, title, content, level, start_line, end_line)``.

    One window by document cuts it at its headings; text before the first heading is a level-1 section under the base name, if there is any.
    """
    lines = _numbered(docs, heading)
    base = F.element_at(F.split("path", "/"), -1)
    body = F.when(~F.col("is_heading"), F.struct("line", "text"))
    grouped = lines.groupBy("path", "section").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.max(F.when(F.col("is_heading"), F.col("level"))).alias("level"), F.max(F.when(F.col("is_heading"), F.col("heading"))).alias("heading"),
        F.sort_array(F.collect_list(body)).alias("body"),
    )
    content = js_trim(F.array_join(F.transform("body", lambda x: x["text"]), "\n"))
    out = grouped.select(F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("id"), F.col("path").alias("document_path"), F.coalesce("heading", base).alias("title"), content.alias("content"), F.coalesce("level", F.lit(1)).alias("level"), "start_line", "end_line", "section")
    return out.where("section > 0 or content <> ''").drop("section")


def document_titles(docs: DataFrame, heading: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """``(path, title, category, hash)``: the title is the first level-1 heading, or the base name."""
    first = _numbered(docs, heading).where("is_heading and level = 1").groupBy("path").agg(F.min_by("heading", "line").alias("_h"))
    base = F.element_at(F.split("path", "/"), -1)
    return docs.join(first, "path", "left").select("path", F.coalesce("_h", base).alias("title"), doc_category(F.col("path")).alias("category"), F.sha2("content", 256).alias("hash"))


def rules(docs: DataFrame, musts=("MUST", "NEVER"), shoulds=("SHOULD", "AVOID"), heading: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """Rule lines outside headings: ``(id, title, content, priority, source_doc)``; the title is the section's."""
    lines = _numbered(docs, heading)
    title = F.last(F.when(F.col("is_heading"), F.col("heading")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = js_trim(F.col("text"))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: t.contains(w))
    is_rule = has(*musts, *shoulds) | t.startswith("RULE:") | t.startswith("- [ ]") | t.startswith("- **Rule")
    priority = F.when(has(*musts), "must").when(has("AVOID", "SHOULD NOT"), "avoid").otherwise("should")
    base = F.element_at(F.split("path", "/"), -1)
    return lines.withColumn("title", F.coalesce(title, base)).where(~F.col("is_heading") & is_rule).select(F.concat_ws(":", "path", F.lit("rule"), F.col("line").cast("string")).alias("id"), "title", t.alias("content"), priority.alias("priority"), F.col("path").alias("source_doc"))


#: Words in back-ticks or camel case that are no references (fixed values).
NOT_SYMBOLS = ["true", "false", "null", "undefined", "string", "number", "boolean"]
NOT_NAMES = ["TypeScript", "JavaScript", "Python", "Markdown"]


def references(content: Column, quoted: str = r"`([A-Za-z0-9_$.]+)(?:\(\))?`", camel: str = r"(?<![A-Za-z0-9_])([A-Z][a-z0-9]+[A-Z][a-zA-Z0-9]*)(?![A-Za-z0-9_])", called: str = r"(?<![A-Za-z0-9_])([a-z][a-zA-Z0-9]+)\(\)") -> Column:
    """Names that a text refers to: in back-ticks, in camel case, or with call brackets. ASCII word boundaries are written out, as Java's are not."""
    find = lambda p: F.regexp_extract_all(content, F.lit(p), F.lit(1))
    a = F.filter(find(quoted), lambda x: (F.length(x) > 2) & ~x.isin(NOT_SYMBOLS))
    b = F.filter(find(camel), lambda x: ~x.isin(NOT_NAMES))
    c = F.filter(find(called), lambda x: F.length(x) > 3)
    return F.array_distinct(F.concat(a, b, c))


def dice(pairs: DataFrame) -> DataFrame:
    """``pairs(pair, a, b)`` -> ``(pair, similarity)``: Dice over multisets of bigrams of words split at blanks; 1 for equal texts, 0 if one is empty."""
    def bigrams(side: str) -> DataFrame:
        words = pairs.select("pair", F.split(side, " ").alias("w"))
        return words.select("pair", F.explode(F.expr("transform(sequence(0, greatest(size(w) - 2, 0)), i -> case when i + 1 < size(w) then w[i] || ' ' || w[i + 1] end)")).alias("g")).where("g is not null").groupBy("pair", "g").agg(F.count("*").alias(f"n_{side}"))

    both = bigrams("a").join(bigrams("b"), ["pair", "g"], "full_outer")
    sums = both.groupBy("pair").agg(F.sum(F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))).alias("common"), F.sum(F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("total"))
    value = F.when(F.col("a") == F.col("b"), 1.0).when((F.col("a") == "") | (F.col("b") == "") | F.col("total").isNull(), 0.0).otherwise(2.0 * F.col("common") / F.col("total"))
    return pairs.join(sums, "pair", "left").select("pair", value.alias("similarity"))
