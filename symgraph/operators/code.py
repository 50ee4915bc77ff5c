"""Questions about code: overview, definitions, callers and callees, subtypes, search, dead code, clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import SymGraph, name_or_qname

_CALLER = ["name", "qname", "kind", "file", "start_line"]


def stats(g: SymGraph) -> dict[str, DataFrame]:
    """``totals``: one row of counts; ``languages``: files by language."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    languages = g.files.groupBy("language").agg(F.count("*").alias("files"))
    parts = [count(g.files, "code_files"), count(g.symbols, "symbols"), count(g.calls, "calls")] + [count(t, n) for t, n in ((g.documents, "documents"), (g.sections, "sections"), (g.rules, "rules")) if t is not None]
    totals = parts[0]
    for p in parts[1:]:
        totals = totals.crossJoin(p)  # one row each
    return {"totals": totals.withColumn("total_files", F.col("code_files") + (F.col("documents") if g.documents is not None else 0)), "languages": languages}


def hubs(symbols: DataFrame, calls: DataFrame, limit: int | None = 25) -> DataFrame:
    """Symbols by the number of incoming call edges."""
    into = calls.where("dst_id is not null").groupBy("dst_id").agg(F.count("*").alias("n"))
    out = into.join(symbols, F.col("dst_id") == F.col("id")).groupBy("name", "kind", "file").agg(F.sum("n").alias("in_degree"))
    return out if limit is None else out.orderBy(F.desc("in_degree"), "file", "name", "kind").limit(limit)


def _owner() -> Column:
    """What stands in the qname before a dot and the name, else null: a key to join owners on, where a qname put together from both sides would leave the file alone to join on."""
    return F.when(F.col("qname").endswith(F.concat(F.lit("."), F.col("name"))), F.expr("left(qname, length(qname) - length(name) - 1)"))


def interface_members(symbols: DataFrame) -> DataFrame:
    """Symbols that an interface of the same file declares: qname is the interface's name, a dot and their name."""
    owners = symbols.where("kind = 'interface'").select(F.col("name").alias("_o"), F.col("file").alias("_f")).distinct()
    return symbols.join(owners, (F.col("file") == F.col("_f")) & (_owner() == F.col("_o")), "left_semi")


def without_callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    return symbols.join(calls.select(F.col("dst_id").alias("_d")).where("_d is not null").distinct(), F.col("id") == F.col("_d"), "left_anti")


def entry_points(symbols: DataFrame, calls: DataFrame, limit: int | None = 15, candidates: int | None = 25) -> DataFrame:
    """Exported symbols that nothing calls, without interface members."""
    found = without_callers(symbols.where("is_exported"), calls)
    if candidates is not None:
        found = found.orderBy("file", "start_line", "id").limit(candidates)
    found = found.join(interface_members(symbols).select(F.col("id").alias("_m")), F.col("id") == F.col("_m"), "left_anti").select("id", *_CALLER)
    return found if limit is None else found.orderBy("file", "start_line", "id").limit(limit)


def explore(g: SymGraph, limit: int = 25) -> dict[str, DataFrame]:
    return {"files": g.files.orderBy("path").limit(20), "hubs": hubs(g.symbols, g.calls, limit), "entry_points": entry_points(g.symbols, g.calls)}


def definition(symbols: DataFrame, wanted: str, file: str | None = None, limit: int | None = 1) -> DataFrame:
    found = symbols.where(name_or_qname(symbols, wanted))
    if file is not None:
        found = found.where(F.col("file") == file)
    return found if limit is None else found.orderBy("file", "start_line", "id").limit(limit)


def _neighbours(g: SymGraph, wanted: str, at: str, other: str) -> DataFrame:
    """An equality on a literal is a filter here, so name and qname need no second join."""
    target = g.symbols.where(name_or_qname(g.symbols, wanted)).select(F.col("id").alias("_t"), F.col("name").alias("target_name"))
    edges = g.calls.where("dst_id is not null").join(target, F.col(at) == F.col("_t")).select(F.col(other).alias("_o"), "line", "cnt", "target_name")
    return edges.join(g.symbols, F.col("_o") == F.col("id")).select("id", *_CALLER, "line", "cnt", "target_name")


def callers(g: SymGraph, wanted: str) -> DataFrame:
    return _neighbours(g, wanted, "dst_id", "src_id")


def callees(g: SymGraph, wanted: str) -> DataFrame:
    return _neighbours(g, wanted, "src_id", "dst_id")


def subtypes(g: SymGraph, wanted: str) -> DataFrame:
    """Direct subtypes of a symbol, or of an external type of that name, ordered by file and line."""
    inside = g.heritage.where("not is_external").join(g.symbols.where(name_or_qname(g.symbols, wanted)).select(F.col("id").alias("_s")), F.col("super_id") == F.col("_s"), "left_semi")
    outside = g.heritage.where(F.col("is_external") & (F.col("super_name") == wanted))
    return inside.unionByName(outside).join(g.symbols, F.col("sub_id") == F.col("id")).select("id", *_CALLER, "rel", "super_name").distinct().orderBy("file", "start_line", "id")


def search_symbols(symbols: DataFrame, pattern: str, kind: str | None = None, limit: int | None = 25, kind_binds_qname_only: bool = False) -> DataFrame:
    """Case-insensitive substring of name or qname, the shortest names first.

    ``kind`` holds for both; with ``kind_binds_qname_only`` it restricts matches by qname alone.
    """
    part = pattern.lower()
    by_name, by_qname = F.lower("name").contains(part), F.lower("qname").contains(part)
    is_kind = F.lit(True) if kind is None else F.col("kind") == kind
    found = symbols.where(by_name | (by_qname & is_kind) if kind_binds_qname_only else (by_name | by_qname) & is_kind)
    return found if limit is None else found.orderBy(F.length("name"), "name", "file", "start_line", "id").limit(limit)


def contract_members(symbols: DataFrame, heritage: DataFrame) -> DataFrame:
    """Members that a supertype asks for: their owner has a supertype with a member of the same name."""
    named = heritage.where("not is_external").join(symbols.select(F.col("id").alias("_si"), F.col("name").alias("_sn")), F.col("super_id") == F.col("_si"))
    owners = named.join(symbols.select(F.col("id").alias("_oi"), F.col("name").alias("_on"), F.col("file").alias("_of")), F.col("sub_id") == F.col("_oi")).select("_sn", "_on", "_of").distinct()
    declared = symbols.select(F.col("qname").alias("_dq")).distinct()
    members = symbols.join(owners, (F.col("file") == F.col("_of")) & (_owner() == F.col("_on")))
    return members.join(declared, F.concat_ws(".", "_sn", "name") == F.col("_dq"), "left_semi").select("id").distinct()


def unused_symbols(g: SymGraph, limit: int | None = 50, include_exported: bool = False) -> DataFrame:
    """Symbols without callers outside tests, constructors excepted; members that a supertype asks for are removed after the limit."""
    found = without_callers(g.symbols, g.calls).where("not contains(file, 'test') and not contains(file, 'spec') and name not in ('constructor', '__init__')")
    if not include_exported:
        found = found.where("not coalesce(is_exported, false)")
    if limit is not None:
        found = found.orderBy("file", "start_line", "id").limit(limit)
    return found.join(contract_members(g.symbols, g.heritage).select(F.col("id").alias("_m")), F.col("id") == F.col("_m"), "left_anti").select("id", *_CALLER)


def similar_functions(symbols: DataFrame, wanted: str | None = None, min_lines: int = 3, limit: int | None = 25) -> DataFrame:
    """The first pairs of functions or methods with the same structural hash; equal name and signature is Type-1.

    Of the first ``limit`` pairs each has one of the first ``limit`` members of a group on the left, so no more are paired; a symbol's own pairs are linear in its group. Without
    a limit and a symbol all pairs are made, as many as the squares of the groups: ``clone_members`` and ``clone_type_counts`` are linear.
    """
    f = symbols.where("kind in ('function', 'method') and structural_hash is not null and structural_hash <> ''")
    a = f.where(F.col("end_line") - F.col("start_line") >= min_lines).select(*[F.col(c).alias(f"{c}_1") for c in ("id", "name", "qname", "file", "signature", "structural_hash")])
    b = f.select(*[F.col(c).alias(f"{c}_2") for c in ("id", "name", "qname", "file", "signature", "structural_hash")])
    if limit is not None and wanted is None:
        a = a.withColumn("_r", F.row_number().over(Window.partitionBy("structural_hash_1").orderBy("id_1"))).where(F.col("_r") <= limit).drop("_r")
    pairs = a.join(b, (F.col("structural_hash_1") == F.col("structural_hash_2")) & (F.col("id_1") < F.col("id_2")))
    if wanted is not None:
        pairs = pairs.where((F.col("name_1") == wanted) | (F.col("name_2") == wanted) | (F.col("qname_1") == wanted) | (F.col("qname_2") == wanted))
    exact = (F.col("name_1") == F.col("name_2")) & F.col("signature_1").eqNullSafe(F.col("signature_2"))
    out = pairs.select("id_1", "id_2", "name_1", "name_2", "file_1", "file_2", F.when(exact, "Type-1").otherwise("Type-2").alias("clone_type"), F.when(exact, 100).otherwise(95).alias("similarity"))
    return out if limit is None else out.orderBy("id_1", "id_2").limit(limit)


def _hashed(symbols: DataFrame, min_lines: int) -> DataFrame:
    return symbols.where("kind in ('function', 'method') and structural_hash <> ''").where(F.col("end_line") - F.col("start_line") >= min_lines)


def clone_members(symbols: DataFrame, min_lines: int = 3) -> DataFrame:
    """``(id, first_id, members, clone_type)``: of each function that has clones the group's first one, and what kind of clone of it this one is."""
    f = _hashed(symbols, min_lines)
    groups = f.groupBy(F.col("structural_hash").alias("_h")).agg(F.count("*").alias("members"), F.min(F.struct("id", "name", "signature")).alias("_f")).where("members > 1")
    met = f.join(groups, F.col("structural_hash") == F.col("_h"))
    exact = (F.col("name") == F.col("_f.name")) & F.col("signature").eqNullSafe(F.col("_f.signature"))
    return met.select("id", F.col("_f.id").alias("first_id"), "members", F.when(exact, "Type-1").otherwise("Type-2").alias("clone_type"))


def clone_type_counts(symbols: DataFrame, min_lines: int = 3) -> DataFrame:
    """``(clone_type, pairs)``: from the sizes of groups, by hash and by hash, name and signature; no pair is made."""
    pairs = lambda *by: _hashed(symbols, min_lines).groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
    exact, every = pairs("structural_hash", "name", "signature"), pairs("structural_hash")
    both = exact.select(F.lit("Type-1").alias("clone_type"), "pairs").unionByName(every.crossJoin(exact.select(F.col("pairs").alias("_e"))).select(F.lit("Type-2").alias("clone_type"), (F.col("pairs") - F.col("_e")).alias("pairs")))  # one row each
    return both.where("pairs > 0")


def clone_groups(symbols: DataFrame) -> DataFrame:
    """Sizes of groups of equal structural hash: linear where pairs would be quadratic."""
    f = symbols.where("kind in ('function', 'method') and structural_hash <> ''")
    return f.groupBy("structural_hash").agg(F.count("*").alias("members"), F.min("id").alias("first_id")).where("members > 1")
