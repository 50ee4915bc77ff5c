"""Helpers shared by the corpus operators: scratch tables, and small column utilities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definitions, as a Java regex class body.
ASCII_SPACE = r"\x20\x09-\x0D"


#: A key that over one in ``HOT`` rows bear is hot; there are at most ``HOT`` such keys.
HOT = 1000
#: A key of fewer rows burdens no task, whatever its share of a small table. This decides how rows are laid out, not which.
LEAST_HOT = 200


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary one is set in local mode; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, **measures) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    ``measures``: aggregates that are taken while it is written; they are in ``seen`` of the result.
    """
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, label), df.schema
    if measures:
        seen = Observation()
        df = df.observe(seen, *[m.alias(n) for n, m in measures.items()])
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    out.seen = dict(seen.get) if measures else {}
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any longer."""
    remove(df.sparkSession, df._scratch)


def settle(df: DataFrame, label: str) -> DataFrame:
    """``stash`` of what reads a stashed table that nothing else reads, and that is then deleted."""
    out = stash(df, label)
    unstash(df)
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique, by that column; no task gets all rows of a hot key.

    ``counts(key, _n)``: the rows of ``left`` by key; without it they are counted, so both should be stored tables. Keys that over one in
    ``HOT`` of the rows bear, ``HOT`` at most, are joined by a broadcast of their rows of ``right``, the others by
    Catalyst's choice. Null keys find nothing and are not sent anywhere. ``how``: left or inner. ``sizes``: the sum and the greatest of the counts, where they are known.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total, most = sizes or counts.where(F.col(key).isNotNull()).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    least = max(total / HOT, LEAST_HOT)
    hot = [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("_n") > least)).select(key).collect()] if most > least else []
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = left.where(F.col(key).isNotNull() & ~is_hot).join(right, key, how)
    if hot:
        out = out.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
    fresh = [c for c in right.columns if c != key]
    if how == "left":
        out = out.unionByName(left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in fresh]))
    return out.select(*left.columns, *fresh)


def dealt(keyed: DataFrame, sample: DataFrame, node: str, block: int, one_in: int = 64) -> DataFrame:
    """``keyed(key, node)`` with ``salt``, ``salts``, ``low`` and ``high``: buckets of well over ``block`` rows are dealt into several of about that size.

    ``sample``: the same for nodes of which one in ``one_in`` is taken by a hash. It decides how rows are laid out, not which. Of a bucket that is dealt out,
    ``low`` and ``high`` are two of its nodes, for all its parts to compare with, so that what belongs together is joined over the parts.
    """
    some = sample.groupBy("key").agg(F.count("*").alias("_n"), F.min(node).alias("low"), F.max(node).alias("high")).where(F.col("_n") >= max(2, 2 * block // one_in))
    large = stash(some.select("key", F.ceil(F.col("_n") * one_in / block).cast("int").alias("salts"), "low", "high"), "large-buckets")
    salts = F.coalesce("salts", F.lit(1))
    out = keyed.join(large, "key", "left").select(*keyed.columns, F.pmod(F.xxhash64(node), salts).cast("int").alias("salt"), salts.alias("salts"), "low", "high")
    out._scratch = large._scratch
    return out


def one_in(column: str, n: int = 64):
    return F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(n)) == 0


def blocks(rows: DataFrame, node: str, left: dict[str, str], right: dict[str, str]) -> DataFrame:
    """All pairs of rows of a key that come from different components, found block against block.

    ``rows`` has key, salts, the node and the columns named; both sides of a bucket are dealt into ``salts`` blocks, so a task compares
    two blocks, whatever the size of the bucket.
    """
    own, every = F.pmod(F.xxhash64(node), F.col("salts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    one = rows.select("key", own.alias("i"), every.alias("j"), *[F.col(c).alias(n) for c, n in left.items()])
    two = rows.select("key", every.alias("i"), own.alias("j"), *[F.col(c).alias(n) for c, n in right.items()])
    return one.join(two, ["key", "i", "j"]).where("c < c2")


def text_or_empty(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def hamming(a, b) -> F.Column:
    return F.bit_count(a.bitwiseXOR(b))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
