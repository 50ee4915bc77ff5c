"""Near copies by the similarity of shingle sets, searched by SimHash and Golay-code fuzzy hashing, and verified exactly.

A text is the set of its runs of five words (lower-cased, ASCII white space). Two texts are near
copies where the Jaccard similarity of their sets is 0.8 or more. About 0.15 of their SimHashes' bits
differ there, ten of 64, too many for the keys of ``simhash``, which are complete up to four. So the SimHash is
longer here, ``WORDS`` words of 23 bits, and each word alone is fuzzily hashed: its keys are its codeword indices in the binary
Golay code [23, 12, 7], as in ``simhash``.

* Words that differ in at most 2 bits always share an index, so SimHashes that differ in at most 3 * ``WORDS`` - 1 bits share a key (pigeonhole).
* Beyond, a word of two texts of similarity 0.8 has an index in common with probability 0.6, so all of them fail for one pair in 30 million (sets of 4 and 5 shingles: in 140,000).
* Rows of a key are compared by the Hamming distance of ``CHECKED`` blocks of 64 bits: near copies differ in over ``BITS`` of them
  in one case of 10^8 (sets of 4 and 5 shingles: 10^5), unrelated texts in at most that many in one of 10^7.

Equal sets are one node from the start. What the Hamming distance links under a key is a *bucket*, and what buckets link is a *group*. Copies of one text share a hundred buckets, each
with other members, so work by buckets would repeat itself. A group is compared as a whole, by the sets themselves: each node with the group's anchor, the node that is in most buckets;
then what is outside of the group's main component with all of the group, block against block. Every two nodes of a bucket are of one group, so no pair is left out.

Only where that would move more rows than the group has in its buckets (very large groups of chains), its buckets are searched one by one. Large buckets are dealt into parts, each node is
compared with its last few predecessors in its part and with two nodes of the whole bucket. Where that is not every pair and leaves several components,

* all are compared with the bucket's anchor, the node that is in most such buckets: copies of one text that hardly resemble each
  other meet their model there;
* then, what is outside of the bucket's main component is compared with all of that component, once for all buckets that say so, and with the rest
  outside, block against block.

A block counts shared shingles by a product of two incidence matrices.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, lookup, one_in, settle, stash, text_or_empty, unstash
from .components import connected_components
from .simhash import codeword_indices, error_patterns

#: Words of a SimHash, of 23 bits each, and the blocks of 64 bits that they are cut from.
WORDS, BLOCKS64 = 19, 7
#: Blocks that rows of a key are compared by, and the most bits that differ there.
CHECKED, BITS = 3, 60
#: Rows of a key from which on a group that makes up much of it is taken out first; pairs compared at a time.
MANY, _PAIRS = 1024, 1 << 14
#: A row under a key; keys whose indices agree but for the lowest bits travel together.
_ROW, _LOW = np.dtype([("index", "<u2"), ("node", "<i8"), ("print", "<u8", CHECKED)]), 5
#: Predecessors that a node is compared with in a bucket; anchors and main components do the rest.
LAGS = 1
#: Rows of a part of a bucket, and of a block of those compared with each other.
BLOCK, COMPARED = 256, 1024
_RNG = np.random.default_rng(42)
_FLIPS = _RNG.integers(0, 2**64, BLOCKS64, np.uint64)
_FACTORS = _RNG.integers(0, 2**64, 2, np.uint64) | np.uint64(1)
_patterns = functools.cache(error_patterns)


def shingle_hashes(text: str | None, shingle_words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the word runs; a text of fewer words is one run, one of none has no hash."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line, k = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([xxh64_intdigest(line[x:y], seed) for x, y in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64))


def simhash_blocks(hashes: np.ndarray) -> np.ndarray:
    """[BLOCKS64] the SimHash of a set: a bit is 1 where over half of the set's elements have it. Each block hashes the elements anew."""
    ones = np.zeros(64 * BLOCKS64, np.int64)
    for at in range(0, len(hashes), 255):
        mixed = hashes[at : at + 255, None] ^ _FLIPS
        for factor in _FACTORS:
            mixed = (mixed ^ mixed >> np.uint64(32)) * factor
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def word_indices(blocks: np.ndarray) -> np.ndarray:
    """[n, BLOCKS64] -> [n, WORDS, 6] the codeword indices of each word, or -1."""
    bits = np.unpackbits(np.ascontiguousarray(blocks).view(np.uint8), axis=1, bitorder="little")[:, : 23 * WORDS]
    words = (bits.reshape(-1, 23).astype(np.float32) @ (1 << np.arange(23)).astype(np.float32)).astype(np.int64)  # below 2 ** 23, so exact
    return codeword_indices(words, _patterns()).reshape(len(blocks), WORDS, -1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set, its words' codeword indices; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    indices = word_indices(simhash_blocks(hashes)[None])[0]
    word, slot = np.nonzero(indices >= 0)
    return word << 12 | indices[word, slot]


def _signed(rows: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """``(row, id, t)`` -> ``(row, id, node, print)``; texts of equal sets have the same node, and those without words no print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            nodes, prints = [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), shingle_words, seed)
                nodes.append(xxh64_intdigest(hashes.tobytes(), seed))
                prints.append(simhash_blocks(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.binary())], ["row", "id", "node", "print"])

    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, node long, print binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    """``(node, print)`` -> ``(g, rows)``: the rows under keys, packed by a word and the higher bits of its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            blocks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BLOCKS64)
            indices = word_indices(blocks)
            row, word, slot = np.nonzero(indices >= 0)
            index = indices[row, word, slot]
            g = word << (12 - _LOW) | index >> _LOW
            order = np.argsort(g, kind="stable")
            packed, g = np.empty(len(g), _ROW), g[order]
            packed["index"], packed["node"], packed["print"] = index[order], own[row[order]], blocks[row[order], :CHECKED]
            starts = np.flatnonzero(np.diff(g, prepend=-1))
            ends = np.append(starts[1:], len(g))
            yield pa.RecordBatch.from_arrays([pa.array(g[starts].astype(np.int32)), pa.array([packed[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist())], pa.binary())], ["g", "rows"])

    return nodes.mapInArrow(run, "g int, rows binary")


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)] whether at most ``BITS`` bits differ."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    bits = np.bitwise_count(a[0][:, None] ^ b[0])
    for x, y in zip(a[1:], b[1:]):
        bits += np.bitwise_count(x[:, None] ^ y)
    return bits <= BITS


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """[n] the least place of each place's component, over links (i, j)."""
    least, before = np.arange(n), None
    while len(i) and not np.array_equal(least, before):
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
    return least


def linked(prints: np.ndarray) -> np.ndarray:
    """[n, CHECKED] -> [n] the place of one row of each row's component, over links of at most ``BITS`` differing bits."""
    label, rest = np.arange(len(prints)), np.arange(len(prints))
    while len(rest) > MANY:  # a component that is much of what is left meets the rest of it once, not each of its own rows
        some = rest[:: max(1, len(rest) // 8)][:8]
        near = _close(prints[some], prints[rest])
        most = near[np.argmax(near.sum(axis=1))]
        if 8 * most.sum() < len(rest):
            break
        front, rest = rest[most], rest[~most]
        root = front[0]
        while len(front):
            label[front], hit = root, np.zeros(len(rest), bool)
            step = max(8, _PAIRS // max(1, len(rest)))
            for at in range(0, len(front) if len(rest) else 0, step):
                hit |= _close(prints[front[at : at + step]], prints[rest]).any(axis=0)
            front, rest = rest[hit], rest[~hit]
    own, ends = prints[rest], [np.zeros((2, 0), np.int64)]
    step = max(8, _PAIRS // max(1, len(rest)))
    for at in range(0, len(rest), step):
        i, j = np.nonzero(_close(own[at : at + step], own[at:]))
        ends.append(np.stack((i[i < j], j[i < j])) + at)
    label[rest] = rest[_least(*np.concatenate(ends, axis=1), len(rest))]
    return label


def _buckets(table: pa.Table) -> pa.Table:
    """The packed rows of a few keys -> ``(key, node, first)`` of those that link under a key, ``first`` the least of them; the same nodes under another key are the same bucket."""
    from xxhash import xxh64_intdigest

    rows = np.frombuffer(b"".join(table["rows"].to_pylist()), _ROW)
    rows = rows[np.argsort(rows["index"], kind="stable")]
    starts = np.flatnonzero(np.diff(rows["index"].astype(np.int64), prepend=-1))
    found: dict[int, np.ndarray] = {}
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        if y - x < 2:
            continue
        label = linked(rows["print"][x:y])
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order], prepend=-1))
        sizes = np.diff(np.append(cuts, len(order)))
        for at, n in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            nodes = np.sort(rows["node"][x:y][order[at : at + n]])
            found[xxh64_intdigest(nodes.tobytes())] = nodes
    of_each = [np.array(list(found), np.uint64).view(np.int64), np.array([n[0] for n in found.values()], np.int64)]
    keys, firsts = (np.repeat(x, [len(n) for n in found.values()]) for x in of_each)
    return pa.table({"key": pa.array(keys, pa.int64()), "node": pa.array(np.concatenate([*found.values(), np.empty(0, np.int64)]), pa.int64()), "first": pa.array(firsts, pa.int64())})


def _sets(texts: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """``(node, t)`` -> ``(node, set)``, sorted as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.sort(shingle_hashes(t.as_py(), shingle_words, seed).view(np.int64)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "set"])

    return texts.mapInArrow(run, "node long, set array<long>")


def _similar(a: str, b: str, similarity: float) -> Column:
    one, two = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return (F.least(one, two) / F.greatest(one, two) >= similarity) & (shared / (one + two - shared) >= similarity)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """[len(a), len(b)] sizes of the intersections of sorted distinct sets, by matrix products over a part of the elements at a time."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(both), width):
        part, sides = both[at : at + width], []
        for side in (a, b):
            marks = np.zeros((len(side), len(part)), np.float32)
            for i, x in enumerate(side):
                own = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
                place = np.minimum(np.searchsorted(part, own), len(part) - 1)
                marks[i, place[part[place] == own]] = 1
            sides.append(marks)
        out += sides[0] @ sides[1].T
    return out


def _links(similarity: float):
    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(u, v) of components: whatever similar texts on the left and the right join, each with the least of what it is joined to."""
        out = []
        if len(left) and len(right):
            a, b = ([np.asarray(x, np.int64) for x in df["set"]] for df in (left, right))
            lc, rc = left["c"].to_numpy(), right["c"].to_numpy()
            sizes_b = np.array([len(x) for x in b], np.float64)
            for at in range(0, len(a), 128):
                shared = shared_counts(a[at : at + 128], b).astype(np.float64)
                total = np.array([len(x) for x in a[at : at + 128]], np.float64)[:, None] + sizes_b[None, :] - shared
                i, j = np.nonzero((shared >= similarity * total) & (lc[at : at + 128, None] != rc[None, :]))
                out.append(np.unique(np.stack((lc[i + at], rc[j]), axis=1), axis=0))
        ends, place = np.unique(np.concatenate([*out, np.zeros((0, 2), np.int64)]), return_inverse=True)
        least = ends[_least(*place.reshape(-1, 2).T, len(ends))]
        return pd.DataFrame({"u": ends[ends != least], "v": least[ends != least]})

    return of


def compare(left: DataFrame, right: DataFrame, sets: DataFrame, group: str, similarity: float) -> DataFrame:
    """``left(group, node, c)`` against ``right(group, node, c)``, whatever is in a group: links (u, v) of components, found block against block."""
    sizes = lambda df, n: df.groupBy(group).agg(F.ceil(F.count("*") / COMPARED).cast("int").alias(n))
    grid = stash(sizes(left, "m").join(sizes(right, "n"), group), "near-grid")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = lambda df: df.join(grid, group).join(sets, "node")
    one = full(left).select(F.col(group).alias("g"), own("m").alias("i"), every("n").alias("j"), "c", "set")
    two = full(right).select(F.col(group).alias("g"), every("m").alias("i"), own("n").alias("j"), "c", "set")
    one, two = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (one, two))  # columns of their own, for the analyser
    return one.groupBy("g", "i", "j").cogroup(two.groupBy("g", "i", "j")).applyInPandas(_links(similarity), "u long, v long")


def _whole(nodes: Column, rows: Column) -> Column:
    """Whether a group is compared as a whole: the grid of its blocks moves at most as many rows as it has in buckets, as it does up to ``COMPARED`` nodes. Both ways compare every pair."""
    return nodes * F.ceil(nodes / COMPARED) <= rows


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(u, v)``, stored, whose sets are similar."""
    return lookup(pairs, sets.toDF("v", "b"), "v", "inner").join(sets.toDF("u", "a"), "u").where(_similar("a", "b", similarity)).select("u", "v")


def _with_links(stars: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links; as they are if there is none."""
    found = stash(links.distinct(), "near-links", n=F.count("*"))
    as_edges = stars.select(F.col("node").alias("u"), F.col("component").alias("v"))
    out = settle(connected_components(as_edges.unionByName(found), "near-edges"), "near-components") if found.seen["n"] else stars
    unstash(found)
    return out


def _drop(tables: list[DataFrame], but: DataFrame | None = None) -> None:
    for path, old in {x._scratch: x for x in tables}.items():
        if but is None or path != but._scratch:
            unstash(old)


def _by_groups(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``members(g, node, n, anchor)`` -> ``(node, component)``, each group compared as a whole."""
    pairs = stash(members.where("node <> anchor").select(F.col("node").alias("u"), F.col("anchor").alias("v")), "near-pairs")
    first = settle(connected_components(_verified(pairs, sets, similarity), "near-edges"), "near-first")
    placed = stash(members.where("n > 2").join(first, "node", "left").select("g", "node", F.coalesce("component", "node").alias("c")), "near-placed")
    counted = placed.groupBy("g", "c").agg(F.count("*").alias("n"))
    main = stash(counted.groupBy("g").agg(F.max(F.struct("n", "c")).alias("x"), F.sum("n").alias("_n"), F.count("*").alias("parts")).where("parts > 1"), "near-main")
    open_ = stash(lookup(placed, main.select("g", F.col("x.c").alias("main")), "g", "inner", main.select("g", "_n")), "near-open")
    outside = stash(open_.where("c <> main").select("g", "node", "c"), "near-outside")
    joined = _with_links(first, compare(outside, open_.select("g", "node", "c"), sets, "g", similarity))
    _drop([pairs, first, placed, main, open_, outside], joined)
    return joined


def _by_buckets(one_each: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``one_each(node, key)`` -> ``(node, component)``, each bucket searched by itself."""
    w = Window.partitionBy("key", "salt").orderBy("node")
    keyed = dealt(one_each, one_each.where(one_in("node")), "node", BLOCK)
    seen = keyed.select("key", "node", "salts", "low", "high", F.row_number().over(w).alias("n"), *[F.lag("node", k).over(w).alias(f"p{k}") for k in range(1, LAGS + 1)], *[F.lead("node", k).over(w).alias(f"s{k}") for k in range(1, LAGS + 2)])
    big = (F.col("salts") > 1) | (F.col("n") > LAGS + 1)
    for n in range(1, LAGS + 2):
        big = big | ((F.col("n") == n) & F.col(f"s{LAGS + 2 - n}").isNotNull())
    to = F.array_distinct(F.array_compact(F.array(*[F.col(f"p{k}") for k in range(1, LAGS + 1)], *[F.when(F.col(k) != F.col("node"), F.col(k)) for k in ("low", "high")])))
    found = stash(seen.where("salts > 1 or n > 1 or s1 is not null").select("key", "node", to.alias("to"), F.coalesce(big, F.lit(False)).alias("big")), "near-buckets")

    pairs = stash(found.select(F.col("node").alias("u"), F.explode("to").alias("v")).distinct(), "near-pairs")
    first = settle(connected_components(_verified(pairs, sets, similarity), "near-edges"), "near-first")

    def open_buckets(stars: DataFrame) -> DataFrame:
        """(key, node, c) of large buckets whose nodes are in several components."""
        members = stash(found.where("big").join(stars, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "near-members")
        split = stash(members.groupBy("key").agg(F.count("*").alias("_n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high"), "near-split")
        out = stash(lookup(members, split.select("key"), "key", "inner", split.select("key", "_n")), "near-open")
        _drop([members, split])
        return out

    open_ = open_buckets(first)
    weighed = open_.join(open_.groupBy("node").agg(F.count("*").alias("weight")), "node")
    anchors = stash(weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "c")).alias("x"), F.count("*").alias("_n")), "near-anchors")
    met = lookup(open_, anchors.select("key", F.col("x.node").alias("v"), F.col("x.c").alias("other")), "key", "inner", anchors.select("key", "_n"))
    more = stash(met.where("c <> other").select(F.col("node").alias("u"), "v").distinct(), "near-more")
    second = _with_links(first, _verified(more, sets, similarity))

    rest = open_buckets(second)
    counted = rest.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = stash(counted.groupBy("key").agg(F.max(F.struct("n", "c")).alias("x"), F.sum("n").alias("_n")), "near-main")
    outside = lookup(rest, main.select("key", F.col("x.c").alias("main")), "key", "inner", main.select("key", "_n")).where("c <> main")
    outside = stash(outside, "near-outside")
    to_main = stash(outside.select("main", "node", "c").distinct(), "near-to-main")
    of_main = second.join(to_main.select(F.col("main").alias("component")).distinct(), "component", "left_semi").select(F.col("component").alias("main"), "node", F.col("component").alias("c"))
    # a main component of one node is no row of the components' table
    alone = to_main.select("main").distinct().join(second.select(F.col("component").alias("main")), "main", "left_anti").select("main", F.col("main").alias("node"), F.col("main").alias("c"))
    of_main = stash(of_main.unionByName(alone), "near-of-main")
    among = outside.select("key", "node", "c")
    across = compare(to_main, of_main, sets, "main", similarity).unionByName(compare(among, among, sets, "key", similarity))
    joined = _with_links(second, across)
    _drop([keyed, found, pairs, first, open_, anchors, more, second, rest, main, outside, to_main, of_main], joined)
    return joined


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One row of each component of near copies, the one of the smallest id, with all columns.

    Null and empty texts are copies of each other. Rows count as such: repeated ids with different texts
    all take part, and a null id comes after all others. Of rows equal in id and text one stays.
    A row is told by its place in the table, which has to give the same rows when it is read again, as files do.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    of_id, of_text = F.col("doc").getField(id_col).alias("id"), text_or_empty(F.col("doc").getField(text_col)).alias("t")
    prints = stash(_signed(rows.select(F.col("_row").alias("row"), of_id, of_text), shingle_words, seed), "near-prints")
    nodes = stash(prints.groupBy("node").agg(F.min("row").alias("row"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("best"), F.first("print").alias("print")), "near-nodes")

    packed = _keyed(nodes.where("print is not null").select("node", "print"))  # equal sets have equal keys
    one_each = stash(packed.groupBy("g").applyInArrow(lambda t: _buckets(t.select(["rows"])), "key long, node long, first long").distinct(), "near-linked")
    grouped = settle(connected_components(one_each.select(F.col("node").alias("u"), F.col("first").alias("v")), "near-edges"), "near-grouped")
    weighed = stash(one_each.groupBy("node").agg(F.count("*").alias("weight")).join(grouped, "node").select(F.col("component").alias("g"), "node", "weight"), "near-weighed")
    groups = weighed.groupBy("g").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("x"), _whole(F.count("*"), F.sum("weight")).alias("whole"))
    groups = stash(groups.select("g", "n", F.col("x.node").alias("anchor"), "whole"), "near-groups", apart=F.count_if(~F.col("whole")))
    members = stash(lookup(weighed.select("g", "node"), groups, "g", "inner", groups.select("g", F.col("n").alias("_n"))), "near-members")

    # what meets the texts here and at the end grows with the corpus: joined by a shuffle, at every size
    wanted = stash(nodes.join(members.select("node"), "node").select("node", F.col("row").alias("_row")), "near-wanted")
    sets = stash(_sets(rows.select("_row", of_text).join(wanted.hint("merge"), "_row").select("node", "t"), shingle_words, seed), "near-sets")
    parts = [_by_groups(members.where("whole"), sets, similarity)]
    apart = None
    if groups.seen["apart"]:
        apart = stash(one_each.select("node", "key").join(members.where("not whole").select("node"), "node", "left_semi"), "near-apart")
        parts.append(_by_buckets(apart, sets, similarity))
    joined = functools.reduce(DataFrame.unionByName, parts)  # no link leaves a group

    kept = nodes.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("_row"))
    kept = stash(kept, "near-kept")
    _drop([prints, nodes, one_each, grouped, weighed, groups, members, wanted, sets, *parts, *([apart] if apart is not None else [])])
    return rows.join(kept.hint("merge"), "_row", "left_semi").select("doc.*")
