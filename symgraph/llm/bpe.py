"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-token boundaries are found without a regex engine. A table maps each code point to a class
(letter, number, white space, other), a look at the next two code points turns classes into one of
nine symbols, and a finite automaton over the symbols, which restarts at each text, says where a
piece begins. An automaton step is a function from states to states, and functions compose
associatively: the reachable compositions form a small monoid with a multiplication table, so the
state before every code point comes from a blocked prefix scan over monoid elements, in numpy, for
many texts at once. The pieces are then slices of the UTF-8 buffer; each distinct piece is merged
once and kept in a bounded cache of packed ids. The offset of every token is kept beside the ids: decoding
writes each token at its offset, so any range of a text can be decoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Symbols of the automaton. WS_MID: white space before white space or an end; WS_GLUE: the last one of a run, a blank; WS_LAST: the last one, no blank; TICK1, TICK2: an apostrophe before a contraction's 1 or 2 letters.
S_LETTER, S_NUMBER, S_OTHER, S_TICK1, S_TICK2, S_WS_MID, S_WS_GLUE, S_WS_LAST, S_RESET = range(9)
#: States: a new piece must begin; after a blank that joins what follows; in a run of letters, numbers, others, white space; a contraction lacks 1 or 2 letters.
BEGIN, GLUE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, NEED1, NEED2 = range(8)
#: Code points scanned together; a longer text is scanned alone.
SCAN = 1 << 19
BLOCK = 256
CACHE_PIECES, CACHE_PIECE_BYTES = 400_000, 48
_END = 0x110000
_NONE = 1 << 62


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins here."""
    if symbol == S_RESET:
        return BEGIN, True
    if state == NEED2:
        return NEED1, False
    if state == NEED1:
        return BEGIN, False
    if symbol in (S_TICK1, S_TICK2) and state not in (GLUE, IN_OTHERS):
        return (NEED1 if symbol == S_TICK1 else NEED2), True
    if symbol in (S_LETTER, S_NUMBER, S_OTHER, S_TICK1, S_TICK2):
        run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
        return run, state not in (GLUE, run)
    if symbol == S_WS_MID:
        return IN_SPACE, state != IN_SPACE
    return (GLUE if symbol == S_WS_GLUE else BEGIN), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product table, image of BEGIN under each element, begins[state, symbol])."""
    steps = [tuple(_step(state, symbol)[0] for state in range(8)) for symbol in range(9)]
    elements = {tuple(range(8)): 0}
    queue = list(elements)
    for f in queue:
        for g in steps:
            if (fg := tuple(g[x] for x in f)) not in elements:
                elements[fg] = len(elements)
                queue.append(fg)
    product = np.array([[elements[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16)
    begins = np.array([[_step(state, symbol)[1] for symbol in range(9)] for state in range(8)])
    return np.array([elements[f] for f in steps], np.uint16), product, np.array([f[BEGIN] for f in elements], np.uint8), begins


def scan(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Exclusive prefix products: element i of the result composes all before i."""
    n, width = len(elements), len(product)
    flat = product.ravel().astype(np.uint16 if width * width < 1 << 16 else np.uint32)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint32)
    padded[:n] = elements
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    out, now = np.empty_like(grid), np.zeros(rows, np.uint32)
    for k in range(BLOCK):  # down the blocks, all of them at once
        out[k] = now
        now = flat[now * width + grid[k]].astype(np.uint32)
    before = np.zeros(rows, np.uint32) if rows <= 1 else _scan_small(now, flat, width) if rows <= BLOCK else scan(now, product).astype(np.uint32)
    return flat[before[None, :] * width + out].T.ravel()[:n]


def _scan_small(totals: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    out, now = [], 0
    for x in totals.tolist():
        out.append(now)
        now = int(flat[now * width + x])
    return np.array(out, np.uint32)


@cache
def codepoint_classes() -> np.ndarray:
    """uint8[0x110001], as the encoder's own regex library has the classes: it is asked once per process for all code points."""
    import tiktoken

    valid = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ranks = {bytes([b]): b for b in range(256)}
    out = np.full(0x110001, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        own = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for at in range(0, len(valid), 1 << 16):
            found = own.decode_bytes(own.encode_ordinary("".join(valid[at : at + (1 << 16)]))).decode("utf-8")
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``_END`` stands between texts."""
    kinds = codepoint_classes()[points]
    out = np.array([S_LETTER, S_NUMBER, S_WS_MID, S_OTHER], np.uint8)[kinds]
    space = kinds == SPACE
    solid = ~space & (points != _END)
    last = np.zeros(len(points), bool)
    last[:-1] = space[:-1] & solid[1:]
    out[last] = np.where(points[last] == 32, S_WS_GLUE, S_WS_LAST)
    ticks = np.flatnonzero(points == 39)
    if len(ticks):
        tail = np.concatenate((points, np.array([_END, _END], points.dtype)))
        a, b = tail[ticks + 1], tail[ticks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[ticks[one]], out[ticks[two]] = S_TICK1, S_TICK2
    out[points == _END] = S_RESET
    return out


def boundaries(points: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins; positions of ``_END`` are among them."""
    of_symbol, product, image, begins = automaton()
    sym = symbols(points)
    states = image[scan(of_symbol[sym], product)]
    return np.flatnonzero(begins[states, sym])


def pieces(texts: list[str]) -> Iterator[tuple[list[bytes], int]]:
    """The pieces of each text, as UTF-8 bytes, and the length of the text in bytes."""
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) < SCAN):
            total += len(texts[to]) + 1
            to += 1
        yield from _pieces_together(texts[at:to])
        at = to


def _pieces_together(texts: list[str]) -> Iterator[tuple[list[bytes], int]]:
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    ends = np.cumsum(lengths + 1) - 1
    points = np.full(int(ends[-1]) + 1, _END, np.uint32)
    inside = np.ones(len(points), bool)
    inside[ends] = False
    points[inside] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = boundaries(points)
    # UTF-8 offsets of the piece starts: an end mark has no bytes
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[ends] = 0
    offset = np.concatenate(([0], np.cumsum(width)))[starts]
    data = joined.encode("utf-8", "surrogatepass")
    cut = np.searchsorted(starts, ends)
    offsets, first = offset.tolist(), 0
    for last in cut.tolist():
        own = offsets[first : last + 1]  # up to the start of the end mark
        yield [data[a:b] for a, b in zip(own, own[1:])], own[-1] - own[0]
        first = last + 1


class Ranks:
    """A rank file, with cached pair merging. ``ids`` are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, lines: Iterable[bytes]):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = sorted((i, t) for t, i in self.rank.items())
        top = tokens[-1][0] + 1 if tokens else 0
        self.sizes, self.starts = np.full(top, -1, np.int64), np.zeros(top, np.int64)
        self.sizes[[i for i, _ in tokens]] = [len(t) for _, t in tokens]
        self.starts[[i for i, _ in tokens]] = np.cumsum([0, *(len(t) for _, t in tokens)])[:-1]
        self.bytes = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        self._cache: dict[bytes, bytes] = {}

    @classmethod
    @cache
    def from_file(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls(f.read().splitlines())

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of the lowest rank, leftmost first, until no pair has a rank."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= 64 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        """Quadratic, over lists that are scanned in C."""
        get, n = self.rank.get, len(piece)
        cuts, found = list(range(n + 1)), [get(piece[i : i + 2], _NONE) for i in range(n - 1)]
        while found and (low := min(found)) < _NONE:
            i = found.index(low)
            del cuts[i + 1], found[i]
            if i < len(found):
                found[i] = get(piece[cuts[i] : cuts[i + 2]], _NONE)
            if i:
                found[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], _NONE)
        return [self.rank[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """O(n log n)"""
        rank, n = self.rank, len(piece)
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != to:
                continue  # one of the two has been merged since
            alive[j], end[i], nxt[i] = False, to, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := rank.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (h := prev[i]) >= 0 and (r := rank.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = nxt[i]
        return out

    def _packed(self, piece: bytes) -> bytes:
        out = np.array(self.merge(piece), "<u4").tobytes()
        if len(piece) <= CACHE_PIECE_BYTES:
            if len(self._cache) >= CACHE_PIECES:
                self._cache.clear()
            self._cache[piece] = out
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Of each text the packed ids, and the byte offset in the text at which each token begins, with the end of the last."""
        known = self._cache.get
        for own, length in pieces(texts):
            packed = b"".join([known(p) or self._packed(p) for p in own])
            offsets = np.zeros(len(packed) // 4 + 1, np.int64)
            np.cumsum(self.sizes[np.frombuffer(packed, "<u4")], out=offsets[1:])
            if offsets[-1] != length:
                raise ValueError("the tokens do not cover the text")
            yield packed, offsets

    def decode(self, ids: bytes, offsets: np.ndarray) -> bytes:
        """Each token's bytes at its offset, counted from the first; an unknown id, or offsets that are not those of the ids, are an error."""
        own = np.frombuffer(ids, "<u4")
        if len(own) and int(own.max()) >= len(self.sizes) or (self.sizes[own] != np.diff(offsets)).any():
            raise ValueError("ids and offsets do not belong together")
        at = offsets - offsets[0]
        return self.bytes[np.repeat(self.starts[own] - at[:-1], np.diff(at)) + np.arange(at[-1])].tobytes()

    def decode_range(self, ids: bytes, offsets: np.ndarray, start: int, end: int) -> bytes:
        """The bytes ``start`` to ``end`` of the text, from the tokens that cover them alone."""
        first = max(0, int(np.searchsorted(offsets, start, "right")) - 1)
        last = min(len(offsets) - 1, int(np.searchsorted(offsets, end, "left")))
        own = self.decode(ids[4 * first : 4 * last], offsets[first : last + 1]) if first < last else b""
        return own[start - offsets[first] : max(0, end - offsets[first])]


def _local(path: str) -> str:
    """A vocabulary file is installed on every machine, or was sent by ``addFile`` (then its bare name is given)."""
    return path if "/" in path else SparkFiles.get(path)


def bpe_encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, offsets array<long>)``, a row per input row.

    ``offsets`` are byte offsets in the UTF-8 text, one for each token, and the length of the text. A null or empty text gives
    no ids; ids repeat as they do in the input; columns besides the two named are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.from_file(_local(ranks_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(ranks.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in found], pa.list_(pa.int32())), pa.array([o for _, o in found], pa.list_(pa.int64()))], ["id", "ids", "offsets"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, offsets array<long>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """``(id, decoded binary)``: the bytes of the ids at their offsets; null ids count as none. An unknown id, or offsets of other ids, are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.from_file(_local(ranks_path))
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            decoded = [ranks.decode(np.array(x or [], "<u4").tobytes(), np.array(o or [0], np.int64)) for x, o in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), F.col(offsets_col).alias("offsets"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens long, ids_sha256, decoded_sha256)``: encodes and decodes where the text is, and keeps digests only; see ``bpe_encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, digest = Ranks.from_file(_local(ranks_path)), lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            counts, ids, texts = [], [], []
            for at in range(0, batch.num_rows, 256):
                for packed, offsets in ranks.encode(batch.column(1).slice(at, 256).to_pylist()):
                    counts.append(len(packed) // 4)
                    ids.append(digest(packed))
                    texts.append(digest(ranks.decode(packed, offsets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
