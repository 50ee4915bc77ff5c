"""Embedding near-duplicates over an inverted multi-index.

Each half of the unit vectors has a codebook of its own (k-means in numpy on a bounded sample); the
two codes of a vector name its home cell in the product grid. A vector visits the nearest cells in
the order of the summed squared distances of its halves (the multi-sequence order). The number of
visits is calibrated: for sampled vectors, partners are drawn at exactly the wanted cosine, the
hardest ones to find, and as many cells are visited as find ``recall`` of them. Every vector is
indexed and every vector visits; what meets in a cell is verified by its cosine in double precision.

Neighbouring codes of each half form groups, and a vector is sent once to each group of cells that it visits, as it
came, with a bit for each cell of the group. Equal vectors of a label are one class with a multiplicity. A group's members and visitors are dealt into
blocks of bounded size, and a block returns counts and a spanning forest of the links it found, not the
pairs. A pair whose two vectors visit each other's cells is counted in one of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle, stash, unstash
from .components import connected_components

MEMBERS, VISITORS = 2048, 8192
#: Codes of a half in a group, on average; a group has 62 cells at most, a bit each.
GROUP = 4
_MOST_CODES = 7


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    if not x.shape[1]:
        return x[:1].copy()
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(x, centres).argmin(axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def code_groups(centres: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group) of each code: neighbours together, at most ``_MOST_CODES`` of them."""
    centre = kmeans(centres, max(1, len(centres) // GROUP), seed)
    near = distances(centres, centre).argmin(axis=1)
    group, place, groups = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), 0
    for g in range(len(centre)):
        own = np.flatnonzero(near == g)
        for at in range(0, len(own), _MOST_CODES):
            part = own[at : at + _MOST_CODES]
            group[part], place[part] = groups, np.arange(len(part))
            groups += 1
    return group, place


class Index:
    """Codebooks of vectors of one dimension, and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, dim: int, codes: int, cosine: float, recall: float, seed: int):
        self.half = dim // 2  # a vector of one component has an empty first half
        self.books = kmeans(sample[:, : self.half], codes if self.half else 1, seed), kmeans(sample[:, self.half :], codes, seed + 1)
        self.groups = [code_groups(b, seed) for b in self.books]
        self.visits = self._calibrate(sample[:2000], cosine, recall, seed)

    def near(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(unit[:, : self.half], self.books[0]), distances(unit[:, self.half :], self.books[1])

    def home(self, unit: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(axis=1) for d in self.near(unit))
        return a * len(self.books[1]) + b

    def rank(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Place of a cell in each vector's order, from one; cells at the same distance come first."""
        out = np.zeros(len(unit), np.int64)
        a, b = cells // len(self.books[1]), cells % len(self.books[1])
        for at in range(0, len(unit), 64):
            d0, d1 = self.near(unit[at : at + 64])
            own = np.arange(len(d0))
            bound = d0[own, a[at : at + 64]] + d1[own, b[at : at + 64]]
            out[at : at + 64] = (d0[:, :, None] + d1[:, None, :] <= bound[:, None, None]).sum(axis=(1, 2))
        return out

    def _calibrate(self, unit: np.ndarray, cosine: float, recall: float, seed: int) -> int:
        """Visits after which the share ``recall`` of partners at the given cosine have been met."""
        rng = np.random.default_rng(seed)
        noise = rng.normal(size=unit.shape)
        noise -= (noise * unit).sum(axis=1)[:, None] * unit
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        partner = cosine * unit + np.sqrt(1 - cosine * cosine) * noise
        rank = np.sort(self.rank(unit, self.home(partner)))
        return int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)])

    def traverse(self, unit: np.ndarray) -> np.ndarray:
        """[n, visits] cells in multi-sequence order. The cell at ranks (a, b) comes after the (a+1)(b+1) - 1 cells at lower ranks, so cells with a greater product cannot be among the first."""
        d = self.near(unit)
        order = [np.argsort(x, axis=1, kind="stable") for x in d]
        near = [np.take_along_axis(x, o, axis=1) for x, o in zip(d, order)]
        sizes = [len(b) for b in self.books]
        visits = min(self.visits, sizes[0] * sizes[1])
        a = np.repeat(np.arange(min(visits, sizes[0])), [min(visits // (x + 1), sizes[1]) for x in range(min(visits, sizes[0]))])
        b = np.concatenate([np.arange(min(visits // (x + 1), sizes[1])) for x in range(min(visits, sizes[0]))])
        out = np.empty((len(unit), visits), np.int64)
        step = max(1, (1 << 22) // len(a))
        for at in range(0, len(unit), step):
            part = slice(at, at + step)
            first = np.argsort(near[0][part][:, a] + near[1][part][:, b], axis=1, kind="stable")[:, :visits]
            out[part] = np.take_along_axis(order[0][part], a[first], axis=1) * sizes[1] + np.take_along_axis(order[1][part], b[first], axis=1)
        return out

    def grouped(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, bit of the cell in it) of each cell."""
        a, b = cells // len(self.books[1]), cells % len(self.books[1])
        (ga, pa_), (gb, pb) = self.groups
        return ga[a] * (int(gb.max()) + 1) + gb[b], np.int64(1) << (pa_[a] * _MOST_CODES + pb[b])


def unit_rows(flat: list, dim: int) -> np.ndarray:
    x = np.array(flat, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest with the sets of a and b merged; ``parent`` of each node is its root, the least of its set."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up


def _block(cosine: float):
    def links(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        """(class, links, root): the links found between visitors and members of one group."""
        out = pd.DataFrame({"cls": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if not len(members) or not len(visitors):
            return out
        dim = int(members["dim"].iloc[0])
        vectors = lambda df: unit_rows(np.concatenate(df["e"].to_numpy()), dim)
        m, v = vectors(members), vectors(visitors)
        mid, vid = members["cls"].to_numpy(), visitors["cls"].to_numpy()
        mcopies, vcopies, vhome = members["copies"].to_numpy(), visitors["copies"].to_numpy(), visitors["home"].to_numpy()
        mbit, vbits = members["bits"].to_numpy(), visitors["bits"].to_numpy()
        path = np.sort(np.stack(members["visits"].to_numpy()), axis=1)
        base = np.arange(len(path), dtype=np.int64) * (int(max(path.max(), vhome.max())) + 1)
        flat, width = (path + base[:, None]).ravel(), int(max(path.max(), vhome.max())) + 1
        ids = np.unique(np.concatenate((mid, vid)))
        count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        mi, vi = np.searchsorted(ids, mid), np.searchsorted(ids, vid)
        for at in range(0, len(v), 512):
            q, x = np.nonzero(v[at : at + 512] @ m.T >= cosine)
            q += at
            keep = (vid[q] != mid[x]) & (vbits[q] & mbit[x] != 0)
            q, x = q[keep], x[keep]
            # met from the other side as well: the smaller one counts it
            wanted = x * np.int64(width) + vhome[q]
            place = np.minimum(np.searchsorted(flat, wanted), len(flat) - 1)
            keep = (vid[q] < mid[x]) | (flat[place] != wanted)
            q, x = q[keep], x[keep]
            count += np.bincount(vi[q], mcopies[x], len(ids)).astype(np.int64) + np.bincount(mi[x], vcopies[q], len(ids)).astype(np.int64)
            label = merge(label, vi[q], mi[x])
        some = np.flatnonzero((count > 0) | (label != np.arange(len(ids))))
        return pd.DataFrame({"cls": ids[some], "links": count[some], "root": ids[label[some]]})

    return links


def fit_indexes(classes: DataFrame, cosine: float, recall: float, fit_rows: int, codes: int | None, seed: int) -> dict[int, Index]:
    """An index for each dimension that occurs; they share ``fit_rows`` sampled classes."""
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    out = {}
    for dim, total in sorted(sizes.items()):
        rows = classes.where(F.col("dim") == dim).select("e", "cls").orderBy(F.xxhash64("e"), "cls").limit(max(200, fit_rows // len(sizes))).toArrow()
        sample = unit_rows(rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
        out[dim] = Index(sample, dim, codes or int(min(256, max(8, np.sqrt(total / 100)))), cosine, recall, seed)
    return out


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, recall: float = 0.99, fit_rows: int = 20_000, codes: int | None = None, seed: int = 42) -> DataFrame:
    """``(id, n_links long, component_id long, kept boolean)``, a row per input row.

    Rows are compared with rows of the same, not null label and the same dimension. Null, empty and zero vectors and those
    with null or non-finite components, and rows without an id, link with nothing: no links, their own component, kept. Equal rows link with
    each other; where ids repeat, each row counts, and all rows of a component's smallest id are kept. Codebooks and calibration use at most ``fit_rows`` classes (200 of
    each dimension at least), the first by a hash of the vector; ``codes`` per half is the square root of a hundredth of the
    number of classes, 8 to 256, by default. Columns besides the three named are ignored. An empty table gives an empty result.
    """
    e = F.col(vector_col) if "array<float>" in vectors.schema[vector_col].dataType.simpleString() else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), e.alias("e"))
    fine = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & fine & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("hash", F.when(usable, F.xxhash64("label", "e")))
    classes = rows.where("hash is not null").groupBy("label", "e").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("dim", F.size("e")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    indexes = fit_indexes(classes, cosine, recall, fit_rows, codes, seed)
    sent = vectors.sparkSession.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                index, own = sent.value[dim], batch.filter(pa.compute.equal(batch.column("dim"), dim))
                for at in range(0, own.num_rows, 1000):
                    part = own.slice(at, 1000)
                    unit = unit_rows(part.column("e").flatten().to_numpy(zero_copy_only=False), dim)
                    home, path = index.home(unit), index.traverse(unit)
                    path[~(path == home[:, None]).any(axis=1), 0] = home[~(path == home[:, None]).any(axis=1)]  # of equally near cells
                    group, bit = index.grouped(path)
                    sets = []
                    for g, b in zip(group, bit):
                        order = np.argsort(g, kind="stable")
                        g, b = g[order], b[order]
                        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                        sets.append([{"group": x, "bits": y} for x, y in zip(g[first].tolist(), np.bitwise_or.reduceat(b, first).tolist())])
                    at_home, home_bit = index.grouped(home)
                    columns = [*(part.column(c) for c in ("cls", "label", "dim", "copies", "e")), pa.array(home), pa.array(at_home), pa.array(home_bit), pa.array([p.astype(np.int32) for p in path], pa.list_(pa.int32())), pa.array(sets, pa.list_(pa.struct([("group", pa.int64()), ("bits", pa.int64())])))]
                    yield pa.RecordBatch.from_arrays(columns, ["cls", "label", "dim", "copies", "e", "home", "group", "bits", "visits", "to"])

    kind, vector = (classes.schema[c].dataType.simpleString() for c in ("label", "e"))
    placed = stash(classes.select("cls", "label", "dim", "copies", "e").mapInArrow(place, f"cls long, label {kind}, dim int, copies long, e {vector}, home long, group long, bits long, visits array<int>, to array<struct<group:long,bits:long>>"), "vector-cells")
    key = ["label", "dim", "group"]
    probes = placed.select("cls", "label", "dim", "copies", "home", "e", F.explode("to").alias("x")).select("cls", "label", "dim", "copies", "home", "e", F.col("x.group").alias("group"), F.col("x.bits").alias("bits"))
    members = placed.groupBy(*key).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("mb"))
    sizes = stash(members.join(probes.groupBy(*key).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("vb")), key), "vector-blocks")
    dealt = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = placed.drop("to").join(sizes, key).select(*key, dealt("mb").alias("m"), every("vb").alias("v"), "cls", "copies", "bits", "visits", "e")
    there = probes.join(sizes, key).select(*key, every("mb").alias("m"), dealt("vb").alias("v"), "cls", "copies", "home", "bits", "e")
    group = [*key, "m", "v"]
    there = there.select(*[F.col(c).alias(c) for c in there.columns])  # columns of its own, for the analyser
    here = here.select(*[F.col(c).alias(c) for c in here.columns])
    found = here.groupBy(*group).cogroup(there.groupBy(*group)).applyInPandas(_block(cosine), "cls long, links long, root long")
    found = stash(found, "vector-links")
    components = settle(connected_components(found.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")), "vector-edges"), "vector-components")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "label", "e", "least", "copies").join(components.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    named = stash(named.select(F.xxhash64("label", "e").alias("hash"), F.col("label").alias("l2"), F.col("e").alias("e2"), "least", "copies", F.coalesce("component", "cls").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-counted")
    least = stash(named.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")), "vector-least")
    full = stash(lookup(named, least.select("c", "component_id"), "c", "inner", least.select("c", "_n")), "vector-named")
    linked = rows.where("hash is not null")
    # rows of a hot vector stay where they are; should two classes have the same hash, the vectors themselves decide
    joined = lookup(linked, full.select("hash", "l2", "e2", "n_links", "component_id"), "hash", "inner", full.groupBy("hash").agg(F.sum("copies").alias("_n"))).where("label = l2 and e = e2")
    for old in (classes, placed, sizes, found, components, named, least):
        unstash(old)
    alone = rows.where("hash is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
