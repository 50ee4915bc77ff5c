"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source has a weight and may be repeated ``max_epochs`` times at most. With all sources sorted
by cap over weight, the level at which the first k are held at their caps and the rest share what
is left by weight is ``(total - caps of the first k) / weights of the rest``; its greatest value over
k is the level at which no source is above its cap, so no iteration is needed. A source's rate is
its target over its size: every document is taken ``floor(rate)`` times, and the fraction is made up
by documents in a seeded random order, up to the one at which the running size comes nearest to the
target. The order is cut into bins by its leading bits; sums by bin tell in which one the
target falls, and only that bin, one of 4,096, is ordered, to find the place where its source is cut. Documents are compared with their source's
cut where they are: no row of the table moves, and a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, stash, text_or_empty, unstash

BINS_HEX = 3


def word_count(column) -> F.Column:
    return F.regexp_count(text_or_empty(column), F.lit(f"[^{ASCII_SPACE}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sizes(source, size long)``, a row per source -> with ``weight`` and ``target double``.

    Weights go round the sources by code point, null last. The one window without partitions is
    over sources, not documents.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    capped = sizes.withColumn("weight", cycle).withColumn("cap", F.col("size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = capped.withColumn("level", left.cast("double") / rest).withColumn("level", F.max("level").over(all_rows))
    return level.select("source", "size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``(id, source, t, draw, doc)``: the draw is a hash of seed, id and text."""
    t = text_or_empty(F.col(text_col))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), t).cast("binary"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), t.alias("t"), F.substring(drawn, 1, 15).alias("draw"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """``(source, source_size, target, whole, cut)``, a row per source: its documents are taken ``whole`` times, and once more those whose ``draw`` is at most ``cut``."""
    rows = _measured(docs, id_col, text_col, source_col, seed).withColumn("bin", F.substring("draw", 1, BINS_HEX))
    by_bin = stash(rows.groupBy("source", "bin").agg(F.sum(word_count(F.col("t"))).alias("bin_size")), "mix-bins")
    goal = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("size")), weights, max_epochs)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    goal = goal.select("source", F.col("size").alias("source_size"), "target", F.floor(rate).cast("int").alias("whole"), ((rate - F.floor(rate)) * F.col("size")).alias("need"))
    goal = stash(goal, "mix-goals")
    end = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    bins = by_bin.withColumn("start", end - F.col("bin_size"))
    named = goal.select(F.col("source").alias("s"), "need")
    bins = bins.join(named, F.col("source").eqNullSafe(F.col("s"))).where("need > 0 and start <= need")
    # the last bin that begins before the cut; the bins before it are whole
    last = bins.groupBy("s").agg(F.max(F.struct("bin", "start", "need")).alias("b")).select("s", F.col("b.bin").alias("b"), F.col("b.start").alias("start"), F.col("b.need").alias("need"))
    last = stash(last, "mix-cut-bins")
    here = rows.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    draws = here.groupBy("source", "draw", "start", "need").agg(F.sum(word_count(F.col("t"))).alias("size"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("draw")) + F.col("start")
    cuts = draws.withColumn("middle", running - F.col("size") / 2).groupBy(F.col("source").alias("s")).agg(F.max(F.when(F.col("middle") <= F.col("need"), F.col("draw"))).alias("cut"), F.first("start").alias("start"))
    before = last.select(F.col("s").alias("s2"), "b")
    cuts = cuts.join(before, F.col("s").eqNullSafe(F.col("s2"))).select("s", F.coalesce("cut", F.col("b")).alias("cut"))  # no draw is as short as a bin's name
    out = stash(goal.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut"), "mix-plan")
    for old in (by_bin, goal, last):
        unstash(old)
    return out


def _taken(docs: DataFrame, goals: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = _measured(docs, id_col, text_col, source_col, seed)
    goals = goals.withColumnRenamed("source", "s")
    return rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).withColumn("repeats", F.col("whole") + F.coalesce(F.col("draw") <= F.col("cut"), F.lit(False)).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """``(id, size, source_size, target, repeats int, taken long)``, a row per input row.

    ``size`` is the number of words, 0 for a null text; ``target`` is the source's; a null source is
    one of the sources. ``repeats`` is how often the mix takes the document and ``taken`` is
    ``size * repeats``. The same rows give the same mix however they are laid out. Repeated ids and null ids are drawn by their texts; rows that are equal in id and
    text are taken alike. Columns besides the three named are ignored. An empty table gives an empty result.
    """
    placed = _taken(docs, plan(docs, id_col, text_col, source_col, weights, max_epochs, seed), id_col, text_col, source_col, seed)
    return placed.select(F.col("id").alias(id_col), word_count(F.col("t")).alias("size"), "source_size", "target", "repeats").withColumn("taken", F.col("size") * F.col("repeats"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: each row, with all its columns, as often as ``mix`` takes it. A text without words counts nothing and is taken as often as its source's others."""
    placed = _taken(docs, plan(docs, id_col, text_col, source_col, weights, max_epochs, seed), id_col, text_col, source_col, seed)
    return placed.where("repeats > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("doc.*")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         substr(md5('42:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(text, '')), 1, 15) as draw
  from documents),
s as (select source, sum(size)::bigint as size from d group by source),
w as (select source, size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, size * 3 as cap from s),
v as (
  select *, (sum(size) over () - coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as level
  from w),
t as (select source, size as source_size, least(cap::double, weight * max(level) over ()) as target from v),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t),
g as (select source, source_size, target, floor(rate)::bigint as whole, (rate - floor(rate)) * source_size as need from r),
a as (select source, draw, sum(size)::bigint as size from d group by source, draw),
m as (select source, draw, sum(size) over (partition by source order by draw) - size / 2.0::double as middle from a)
select d.doc_id, d.size, g.source_size, g.target, (d.size * (g.whole + case when g.need > 0 and m.middle <= g.need then 1 else 0 end))::bigint as taken
from d join g on d.source is not distinct from g.source join m on d.source is not distinct from m.source and d.draw = m.draw
"""
