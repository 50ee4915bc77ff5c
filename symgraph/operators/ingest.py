"""Ingest and mutation: partition replacement by path, and resolution of raw references to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PATH_KEY

#: Bearers of a name that are met in one place, and the most places for a name: what is copied stays within so many times the symbols.
BEARERS, SHARES = 1000, 64


def delete_paths(facts: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Facts without what came from ``paths(path)``: every table names the path of each row, so what other paths hold is not looked at."""
    gone, out = paths.select(F.col("path").alias("_gone")).distinct(), dict(facts)
    for name, key in PATH_KEY.items():
        if name in facts:
            out[name] = facts[name].join(gone, facts[name][key] == F.col("_gone"), "left_anti")
    return out


def upsert(facts: dict[str, DataFrame], fresh: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Replace all that came from ``paths`` by ``fresh``; what comes from other paths stays."""
    kept = delete_paths(facts, paths)
    return {name: t.unionByName(fresh[name]) if name in fresh else t for name, t in kept.items()}


def merge_by_key(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Key upsert: rows of ``fresh`` replace those of the same key; of repeated fresh keys one stays."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.dropDuplicates([key]))


def match_names(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """``names(ref)`` -> ``(ref, symbol_id)`` where ref is a symbol's name or qname: two equi-joins, never an OR."""
    by = lambda column: names.join(symbols.select(F.col("id").alias("symbol_id"), F.col(column).alias("_n")), F.col("ref") == F.col("_n")).select("ref", "symbol_id")
    return by("name").union(by("qname")).distinct()


def _bearers(symbols: DataFrame) -> DataFrame:
    """``(_n, _q, symbol_id, qname)``: a symbol under its name (``_q`` null), and under its name and qname where these differ."""
    own = F.struct(F.col("name").alias("_n"), F.lit(None).cast("string").alias("_q"))
    both = F.struct(F.col("name").alias("_n"), F.col("qname").alias("_q"))
    rows = symbols.select("id", "name", "qname").distinct()
    return rows.select(F.col("id").alias("symbol_id"), "qname", F.explode(F.when(F.col("name") != F.col("qname"), F.array(own, both)).when(F.col("name").isNull(), F.array(both)).otherwise(F.array(own))).alias("_k")).select("_k._n", "_k._q", "symbol_id", "qname").where("_n is not null or _q is not null")


def resolve_calls(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """One edge per (caller, callee) with the first call's line and names and the number of calls.

    A caller is named by id or by name. A callee name without a symbol becomes an external edge; a name that
    several symbols bear fans out to all of them.

    Edges can be as many as callers times bearers of a name, so all that is grouped is grouped by caller and name, before names fan out, and edges leave the
    last join as they are made. A symbol can be called by name and by qname; calls by qname go with those by name as a map, whose entry is added where the qname is met.
    """
    order = F.struct(F.coalesce("line", F.lit(0)).alias("line"), "callee_qname")  # the name is what rows are grouped by
    once = raw.groupBy("caller_id", "callee_name").agg(F.count("*").alias("cnt"), F.min(order).alias("first"))
    ids = symbols.select(F.col("id").alias("src_id")).distinct()
    by_id = once.join(ids, once["caller_id"] == F.col("src_id"))
    rest = once.join(ids, once["caller_id"] == F.col("src_id"), "left_anti")
    by_name = rest.join(symbols.select(F.col("id").alias("src_id"), "name").distinct(), rest["caller_id"].cast("string") == F.col("name")).drop("name")
    callers = by_id.unionByName(by_name).drop("caller_id")

    bearers = _bearers(symbols)
    meant = bearers.select(F.coalesce("_q", "_n").alias("ref"), "_n", "_q").distinct()
    linked = callers.join(meant, F.col("callee_name") == F.col("ref"), "left")
    external = F.when(F.col("ref").isNull(), F.col("callee_name")).alias("dst_external")
    hit = lambda named, what: F.when(F.col("_q").isNull() if named else F.col("_q").isNotNull(), what)
    units = linked.groupBy("src_id", F.col("ref").isNull().alias("_ext"), "_n", external).agg(
        F.sum(hit(True, F.col("cnt"))).alias("cnt"), F.min(hit(True, F.col("first"))).alias("first"), F.collect_list(hit(False, F.struct("_q", "cnt", "first"))).alias("_by")
    )
    qnames = F.array_distinct(F.transform("_by", lambda h: h["_q"]))
    total = lambda q: F.aggregate(F.filter("_by", lambda h: h["_q"] == q), F.lit(0).cast("long"), lambda n, h: n + h["cnt"])
    least = lambda q: F.array_min(F.transform(F.filter("_by", lambda h: h["_q"] == q), lambda h: h["first"]))
    more = F.when(F.size("_by") > 0, F.map_from_arrays(qnames, F.transform(qnames, lambda q: F.struct(total(q).alias("cnt"), least(q).alias("first")))))
    units = units.select("src_id", "_ext", "_n", "dst_external", "cnt", "first", more.alias("_more"))
    # by name: all its bearers; by qname alone: those of name and qname
    wanted = F.explode(F.when(F.col("_ext") | F.col("cnt").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.map_keys("_more")))
    units = units.select("*", wanted.alias("_w")).select(
        "src_id", "_n", "_w", "dst_external", F.coalesce("cnt", F.col("_more")[F.col("_w")]["cnt"]).alias("cnt"), F.coalesce("first", F.col("_more")[F.col("_w")]["first"]).alias("first"), F.when(F.col("_w").isNull(), F.col("_more")).alias("_more")
    )

    # what many symbols bear is met in several places, each with a share of the callers
    shares = bearers.groupBy(F.col("_n").alias("_hn"), F.col("_q").alias("_hq")).agg(F.least(F.ceil(F.count("*") / BEARERS), F.lit(SHARES)).cast("int").alias("_shares")).where("_shares > 1")
    at = lambda df, q: df.join(F.broadcast(shares), F.col("_n").eqNullSafe(F.col("_hn")) & F.col(q).eqNullSafe(F.col("_hq")), "left").drop("_hn", "_hq")
    share = F.pmod(F.xxhash64("src_id"), F.when(F.col("dst_external").isNotNull(), F.lit(SHARES)).otherwise(F.coalesce("_shares", F.lit(1)))).cast("int")
    left = at(units, "_w").select("src_id", "_n", "_w", "dst_external", "cnt", "first", "_more", share.alias("_s"))
    right = at(bearers, "_q").select(F.col("_n").alias("_bn"), F.col("_q").alias("_bq"), "symbol_id", "qname", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)).alias("_bs"))
    edges = left.join(right, F.col("_n").eqNullSafe(F.col("_bn")) & F.col("_w").eqNullSafe(F.col("_bq")) & (F.col("_s") == F.col("_bs")), "left")
    also = F.col("_more")[F.col("qname")]
    named = lambda first, name: F.struct(first["line"].alias("line"), name.alias("callee_name"), first["callee_qname"].alias("callee_qname"))
    cnt = F.col("cnt") + F.coalesce(also["cnt"], F.lit(0).cast("long"))
    first = F.least(named(F.col("first"), F.coalesce("dst_external", "_w", "_n")), F.when(also.isNotNull(), named(also["first"], F.col("qname"))))
    edges = edges.select("src_id", F.col("symbol_id").alias("dst_id"), "dst_external", cnt.alias("cnt"), first.alias("first"))
    return edges.select("src_id", "dst_id", "dst_external", F.col("first.line").alias("line"), "cnt", F.col("first.callee_name").alias("callee_name"), F.col("first.callee_qname").alias("callee_qname"))


def resolve_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """An edge to every file that a candidate path names, else one to an external package."""
    paths = files.select(F.col("path").alias("dst_path"))
    met = raw.select("src_path", "imported_path", "specifiers", F.explode("candidates").alias("_c")).join(paths, F.col("_c") == F.col("dst_path"))
    hit = met.select("src_path", "dst_path", F.lit(False).alias("is_external"), "specifiers", "imported_path").dropDuplicates(["src_path", "dst_path"])
    miss = raw.join(met.select("src_path", "imported_path").distinct(), ["src_path", "imported_path"], "left_anti").dropDuplicates(["src_path", "imported_path"])
    return hit.unionByName(miss.select("src_path", F.col("imported_path").alias("dst_path"), F.lit(True).alias("is_external"), "specifiers", "imported_path"))


def resolve_heritage(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sub by id, or by the name or qname that its id ends in; super by name or qname, else external. Both sides of the last join are distinct, so its rows are."""
    rows = raw.select("sub_id", "super_name", "rel").distinct()
    ids = symbols.select(F.col("id").alias("_id"))
    by_id = rows.join(ids, rows["sub_id"] == F.col("_id"), "left_semi")
    rest = rows.join(ids, rows["sub_id"] == F.col("_id"), "left_anti").withColumn("ref", F.regexp_extract("sub_id", r"([^:]+)(?::\d+)?$", 1))
    by_name = rest.join(match_names(rest.select("ref").distinct(), symbols), "ref").select(F.col("symbol_id").alias("sub_id"), "super_name", "rel")
    subs = by_id.select("sub_id", "super_name", "rel").unionByName(by_name).distinct()
    matched = match_names(subs.select(F.col("super_name").alias("ref")).distinct(), symbols)
    return subs.join(matched, F.col("super_name") == F.col("ref"), "left").select("sub_id", F.col("symbol_id").alias("super_id"), "super_name", "rel", F.col("symbol_id").isNull().alias("is_external"))
