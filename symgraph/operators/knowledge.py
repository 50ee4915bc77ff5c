"""Documentation: search, lookup, and tracing between specifications and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import SymGraph, name_or_qname
from ..plans.traverse import clamp, reach
from .impact import call_edges


def knowledge_search(g: SymGraph, query: str, limit: int | None = 10) -> DataFrame:
    """Case-sensitive substring of title or content: sections with their symbols, then rules, each up to the limit."""
    hit = F.col("title").contains(query) | F.col("content").contains(query)
    links = g.documents_edges.join(g.symbols, F.col("symbol_id") == F.col("id")).groupBy(F.col("section_id").alias("_s")).agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    cut = lambda df, order: df if limit is None else df.orderBy(*order).limit(limit)
    sections = cut(g.sections.where(hit), ["document_path", "start_line", "id"]).join(links, F.col("id") == F.col("_s"), "left")
    rules = cut(g.rules.where(hit), ["source_doc", "id"])
    out = lambda df, kind, path, symbols: df.select(F.lit(kind).alias("kind"), F.col(path).alias("path"), "title", F.substring("content", 1, 300).alias("snippet"), symbols.alias("symbols"))
    none = F.array().cast("array<string>")
    return out(sections, "section", "document_path", F.coalesce("symbols", none)).unionByName(out(rules, "rule", "source_doc", none))


def find_document(documents: DataFrame, query: str) -> DataFrame:
    """Exact path before exact title before path suffix: one row or none."""
    rank = F.when(F.col("path") == query, 0).when(F.col("title") == query, 1).when(F.col("path").endswith(f"/{query}"), 2)
    return documents.withColumn("rank", rank).where("rank is not null").orderBy("rank", "path").limit(1)


def knowledge_doc(g: SymGraph, query: str) -> dict[str, DataFrame]:
    doc = find_document(g.documents, query)
    path = doc.select(F.col("path").alias("_p"))
    return {"document": doc.drop("rank"), "sections": g.sections.join(path, F.col("document_path") == F.col("_p"), "left_semi").orderBy("start_line"), "rules": g.rules.join(path, F.col("source_doc") == F.col("_p"), "left_semi").orderBy("id")}


def spec_code_flow(g: SymGraph, query: str, depth=3) -> dict[str, DataFrame]:
    """From a section to the symbols it documents and what they call.

    ``section``: the first whose title, content or path holds the query, else the first section of a document whose title or path does.
    A level-1 section stands for its whole document. ``entries``; ``flow``: (name, file, depth), the least depth first.
    """
    d = clamp(depth, 1, 6)
    hit = F.col("title").contains(query) | F.col("content").contains(query) | F.col("document_path").contains(query)
    docs = g.documents.where(F.col("title").contains(query) | F.col("path").contains(query)).select(F.col("path").alias("_p"))
    ranked = g.sections.where(hit).withColumn("_r", F.lit(0)).unionByName(g.sections.join(docs, F.col("document_path") == F.col("_p"), "left_semi").withColumn("_r", F.lit(1)))
    section = ranked.orderBy("_r", "document_path", "start_line", "id").limit(1).drop("_r")
    own = section.select(F.col("id").alias("_id"), F.col("document_path").alias("_d"), F.col("level").alias("_l"))
    scope = g.sections.join(own, (F.col("document_path") == F.col("_d")) & ((F.col("_l") == 1) | (F.col("id") == F.col("_id"))), "left_semi").select(F.col("id").alias("_s"))
    ids = g.documents_edges.join(scope, F.col("section_id") == F.col("_s"), "left_semi").select("symbol_id").distinct()
    entries = g.symbols.join(ids, F.col("id") == F.col("symbol_id"), "left_semi")
    seeds = entries.select(F.col("id").alias("seed"))
    steps = reach(call_edges(g.calls), seeds, d).groupBy("node").agg(F.min("depth").alias("depth")).unionByName(seeds.select(F.col("seed").alias("node"), F.lit(0).alias("depth")))
    named = steps.join(g.symbols, F.col("node") == F.col("id"))
    w = Window.partitionBy("file", "name").orderBy("depth", "start_line", "id")
    flow = named.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "name", "qname", "kind", "file", "start_line", "depth")
    return {"section": section, "entries": entries, "flow": flow, "edges": mermaid_edges(g, flow)}


def mermaid_edges(g: SymGraph, flow: DataFrame) -> DataFrame:
    """Distinct ``a --> b`` lines between flow symbols, ids reduced to word characters."""
    clean = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    node = lambda i, n: flow.select(F.col("id").alias(i), F.col("name").alias(n))
    e = call_edges(g.calls).join(node("_a", "a"), F.col("src") == F.col("_a")).join(node("_b", "b"), F.col("dst") == F.col("_b"))
    return e.select(F.concat(clean("a"), F.lit(" --> "), clean("b")).alias("line")).distinct()


def symbol_spec_features(g: SymGraph, wanted: str, search_callers: bool = True, limit: int = 15) -> dict[str, DataFrame]:
    """``direct``: sections that document the symbol and rules that govern it; ``indirect``: sections of callers up to 4 calls away."""
    target = g.symbols.where(name_or_qname(g.symbols, wanted)).select(F.col("id").alias("_t"))
    s = g.sections.select(F.col("id").alias("_s"), F.col("document_path").alias("path"), "title", F.substring("content", 1, 180).alias("snippet"))
    by_section = g.documents_edges.join(target, F.col("symbol_id") == F.col("_t"), "left_semi").join(s, F.col("section_id") == F.col("_s")).select(F.lit("section").alias("kind"), "path", "title", "snippet")
    direct = by_section
    if g.governs is not None:
        r = g.rules.select(F.col("id").alias("_r"), F.col("source_doc").alias("path"), "title", F.substring("content", 1, 180).alias("snippet"))
        direct = direct.union(g.governs.join(target, F.col("symbol_id") == F.col("_t"), "left_semi").join(r, F.col("rule_id") == F.col("_r")).select(F.lit("rule").alias("kind"), "path", "title", "snippet"))
    out = {"direct": direct.distinct()}
    if search_callers:
        roots = reach(call_edges(g.calls), target.select(F.col("_t").alias("seed")), 4, backwards=True).groupBy("node").agg(F.min("depth").alias("depth"))
        via = g.documents_edges.join(roots, F.col("symbol_id") == F.col("node")).join(s, F.col("section_id") == F.col("_s")).join(g.symbols.select(F.col("id").alias("_i"), F.col("name").alias("root")), F.col("node") == F.col("_i"))
        out["indirect"] = via.select("root", "depth", "path", "title", "snippet").distinct().orderBy("depth", "path", "title", "root").limit(limit)
    return out
