"""Near copies against brute force over all pairs of shingle sets."""

import random

import pytest

from symgraph.llm.near_copies import band_keys, drop_near_copies, shingle_hashes
from symgraph.llm.simhash import fingerprint
from tests.llm.test_operators import frame, union_find, words


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(text, rng, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"x{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng, base = random.Random(4), [" ".join(words(s)) for s in (11, 12, 13)]
    star = [edited(base[0], rng, 4) for _ in range(40)]  # similar to the base, hardly to each other
    chain = [base[1]]
    for _ in range(30):
        chain.append(edited(chain[-1], rng, 3))
    around = [edited(base[2], rng, k) for k in range(1, 9)]
    out = [None, "", " \n", "one", "ONE", "one two", *base, base[0].upper(), *star, *chain, *around, *[" ".join(words(s, 60)) for s in range(20, 40)]]
    rng.shuffle(out)
    return out


def test_near_copies(spark, texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    far = [(i, j) for i, j in links if (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 4]
    assert far, "some near copies are beyond four bits of SimHash"
    assert [r["doc_id"] for r in drop_near_copies(frame(spark, texts)).orderBy("doc_id").collect()] == sorted(set(union_find(len(texts), links)))
    assert drop_near_copies(frame(spark, [])).count() == 0


def test_shared_counts():
    import numpy as np

    from symgraph.llm.near_copies import shared_counts

    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(-(2**62), 2**62, 5).repeat(1).tolist() + rng.integers(0, 60, n).tolist()).astype(np.int64) for n in sizes] for sizes in ((0, 1, 9, 40, 40), (30, 5, 0, 40)))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert shared_counts(a, b, 7).tolist() == shared_counts(a, b).tolist() == want


@pytest.mark.parametrize("small", [False, True])
def test_large_groups_of_copies(spark, monkeypatch, small):
    """Groups whose members resemble their model, and hardly each other; members of members; passages that many share; in buckets beyond all bounds."""
    from symgraph.llm import near_copies

    if small:  # parts, blocks and grids of a few rows
        monkeypatch.setattr(near_copies, "BLOCK", 8)
        monkeypatch.setattr(near_copies, "COMPARED", 10)
    rng, out = random.Random(11), []
    for g, n in enumerate((150, 60)):
        base = " ".join(words(100 + g, 150))
        out.append(base)
        star = [edited(base, rng, 3) for _ in range(n)]
        out += star + [edited(rng.choice(star), rng, 3) for _ in range(n // 3)]  # some of these resemble their own model alone
    shared = " ".join(words(200, 60))
    out += [shared + " " + " ".join(words(300 + i, 60)) for i in range(80)]  # alike, but not copies
    rng.shuffle(out)
    sets = [shingles(t) for t in out]
    links = [(i, j) for i in range(len(out)) for j in range(i) if similar(sets[i], sets[j])]
    assert sorted(r["doc_id"] for r in drop_near_copies(frame(spark, out)).collect()) == sorted(set(union_find(len(out), links)))


def test_stage_drops_copies_at_the_bound(spark):
    import corpus_pipeline as cp

    base, rng = " ".join(words(7)), random.Random(1)
    near = next(t for t in (edited(base, rng, 4) for _ in range(1000)) if similar(shingles(base), shingles(t)) and (fingerprint(base) ^ fingerprint(t)).bit_count() > 4)
    below = next(t for t in (edited(base, rng, 6) for _ in range(1000)) if not similar(shingles(base), shingles(t)) and not similar(shingles(near), shingles(t)))
    kept = cp.near_duplicates(spark, frame(spark, [base, near, below]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(words(s)) for s in (1, 2, 3))
    rows = [(1, a), (1, b), (1, a), (2, b), (None, c), (None, b), (None, None)]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (1, b), (None, c), (None, None)], key=repr)


def test_keys_meet_at_the_bound():
    rng, met = random.Random(9), 0
    for _ in range(300):
        base = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        other = [*base[:182], *(f"v{rng.randrange(10**9)}" for _ in range(22))]
        a, b = shingle_hashes(" ".join(base)), shingle_hashes(" ".join(other))
        assert len(set(a.tolist()) & set(b.tolist())) == 178 and len(a) == len(b) == 200
        met += bool(set(band_keys(a).tolist()) & set(band_keys(b).tolist()))
    assert met == 300


def test_keys_are_codeword_indices_of_simhash_words():
    """By plain loops: bits by majority, and for each word the data bits of the Golay codewords that ``simhash`` gives it."""
    import numpy as np

    from symgraph.llm import near_copies as nc
    from symgraph.llm.simhash import codeword_indices, error_patterns

    hashes = shingle_hashes(" ".join(words(5, 400)))
    one = [int(nc.simhash_blocks(np.array([h], np.uint64)).tobytes()[::-1].hex(), 16) for h in hashes]  # of one element: its own bits
    want = sum(1 << i for i in range(64 * nc.BLOCKS64) if 2 * sum(x >> i & 1 for x in one) > len(one))
    assert int(nc.simhash_blocks(hashes).tobytes()[::-1].hex(), 16) == want
    parts = np.array([want >> 23 * k & (1 << 23) - 1 for k in range(nc.WORDS)])
    found = codeword_indices(parts, error_patterns())
    assert sorted(band_keys(hashes).tolist()) == sorted(k << 12 | i for k in range(nc.WORDS) for i in found[k].tolist() if i >= 0)


def test_rows_link_by_hamming_distance(monkeypatch):
    import numpy as np

    from symgraph.llm import near_copies as nc

    rng = np.random.default_rng(2)

    def flipped(row, n):
        bits = np.unpackbits(row.view(np.uint8))
        bits[rng.choice(len(bits), n, replace=False)] ^= 1
        return np.packbits(bits).view(np.uint64)

    rows = list(rng.integers(0, 2**64, (40, nc.CHECKED), np.uint64))
    rows += [flipped(rows[0], int(n)) for n in rng.integers(20, 70, 60)] + [flipped(rows[1], nc.BITS), flipped(rows[2], nc.BITS + 1)]
    for _ in range(10):
        rows.append(flipped(rows[-1], nc.BITS))
    rows = np.array([rows[i] for i in rng.permutation(len(rows))])
    want = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if int(np.bitwise_count(rows[i] ^ rows[j]).sum()) <= nc.BITS])
    for many in (1024, 4):
        monkeypatch.setattr(nc, "MANY", many)
        label = nc.linked(rows).tolist()
        assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_groups_of_copies_are_not_compared_bucket_by_bucket(spark, monkeypatch):
    """Copies of one text that hardly resemble each other, and texts that share a passage: the rows compared grow with the nodes, not with their buckets."""
    from symgraph.llm import near_copies

    rng, base, shared = random.Random(21), " ".join(words(400, 150)), " ".join(words(401, 60))
    out = [base, *(edited(base, rng, rng.randrange(2, 9)) for _ in range(150)), *(shared + " " + " ".join(words(500 + i, 30)) for i in range(100))]
    made, stash = {}, near_copies.stash

    def counting(df, label, **measures):
        table = stash(df, label, **measures)
        made[label] = made.get(label, 0) + table.count()
        return table

    monkeypatch.setattr(near_copies, "stash", counting)
    kept = sorted(r["doc_id"] for r in drop_near_copies(frame(spark, out)).collect())
    sets = [shingles(t) for t in out]
    assert kept == sorted(set(union_find(len(out), [(i, j) for i in range(len(out)) for j in range(i) if similar(sets[i], sets[j])])))
    assert made["near-linked"] > 10 * len(out), "they share many buckets"
    for label in ("near-pairs", "near-more", "near-open", "near-outside", "near-to-main", "near-links"):
        assert made.get(label, 0) <= len(out), label


@pytest.mark.parametrize("small", [False, True])
def test_groups_searched_by_buckets(spark, monkeypatch, small):
    from symgraph.llm import near_copies

    monkeypatch.setattr(near_copies, "_whole", lambda nodes, rows: nodes < 3)  # groups of both kinds
    test_large_groups_of_copies(spark, monkeypatch, small)


def test_sets_are_sorted_as_they_are_compared(spark):
    """Hashes of the upper half are negative as longs; ``shared_counts`` takes parts of the elements by their order."""
    import numpy as np

    from symgraph.llm.near_copies import _sets, shared_counts

    texts = [" ".join(words(600 + i % 3, 300)) + f" end{i}" for i in range(9)]
    found = {r["node"]: np.array(r["set"]) for r in _sets(spark.createDataFrame(list(enumerate(texts)), "node long, t string"), 5, 42).collect()}
    assert all((np.diff(x) > 0).all() and x[0] < 0 < x[-1] for x in found.values())
    own = [found[i] for i in range(9)]
    assert shared_counts(own, own, 64).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in own] for x in own]
