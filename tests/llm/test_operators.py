"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import bpe, mixing, pii, simhash
from symgraph.llm.components import connected_components
from symgraph.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, t string, fp long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = "byte_bpe_multi_50k.tiktoken"


def frame(spark, texts, sources=None):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", sources[i] if sources else "s", 0, 7, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(seed, n=200):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = " ".join(words(1))
    near = base.replace(words(1)[50], "changed", 1)
    return [base, near, base.upper(), None, "", " \n ", "one", "one two three", " ".join(words(2)), base, "z" * 20000, " ".join(words(3, 3000)), "é漢 " * 100, "a\x1cb\u0085c"]


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, texts):
    from xxhash import xxh64_intdigest

    def brute(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [brute(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    found = {r["doc_id"]: r for r in simhash.simhash_components(frame(spark, texts)).collect()}
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [found[i]["component_id"] for i in range(len(texts))] == union_find(len(texts), links)
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_golay_keys_find_every_link():
    """Every pair within 4 bits shares a key, over random fingerprints and error patterns."""
    rng, patterns = np.random.default_rng(0), simhash.error_patterns()
    assert sorted(Counter((patterns >= 0).sum(axis=1).tolist()).items()) == [(1, 277), (6, 1771)]
    for k in range(5):
        a = rng.integers(-(2**63), 2**63, 400)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in a], np.uint64).view(np.int64)
        keys = [dict.fromkeys(range(len(a))) for _ in range(2)]
        for out, fps in zip(keys, (a, a ^ flips)):
            row, key = simhash.fuzzy_keys(fps, patterns)
            for i in out:
                out[i] = set(key[row == i].tolist())
        assert all(keys[0][i] & keys[1][i] for i in keys[0])


@pytest.mark.parametrize("block", [1024, 20])
def test_large_buckets(spark, monkeypatch, block):
    """Chains and clusters in one bucket, beyond the lags, whole or dealt into many parts: components as brute force has them."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    fps = {rng.getrandbits(21) << 42 | 12345 for _ in range(3000)} | {(1 << 60) + sum(1 << rng.randrange(42, 62) for _ in range(3)) for _ in range(200)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    found = {r["node"]: r["component"] for r in simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    x = np.array(fps, np.int64).view(np.uint64)
    links = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 4)]
    roots = union_find(len(fps), links)
    assert all(found.get(fps[i], fps[i]) == fps[r] for i, r in enumerate(roots))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(5, 5), (None, 3)]
    want = union_find(600, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: want[n] for n in got} and set(got) == {n for e in edges if None not in e and e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.Ranks.from_file(tokenizer_file(RANKS)).rank), special_tokens={})


def test_bpe(spark, texts):
    rng = random.Random(1)
    parts = ["'", "s", "'s", "'ll", "re", "ve", " ", "  ", "\n", "\t", " ", "a", "é", "漢", "1", "²", "!", "😀", "́", "<|endoftext|>", "\x1c", "abc"]
    texts = texts + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    own, path = library(), tokenizer_file(RANKS)
    found = {r["doc_id"]: r for r in bpe.bpe_digests(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.bpe_encode(frame(spark, texts[:14]), path)
    for r in bpe.bpe_decode(encoded, path).collect():
        assert bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "")
    one = encoded.where("doc_id = 7").first()
    assert one["offsets"][0] == 0 and len(one["offsets"]) == len(one["ids"]) + 1
    ranks = bpe.Ranks.from_file(path)
    for t in [texts[0], texts[12], "", "é漢😀 's"]:
        (ids, offsets), data = next(iter(ranks.encode([t]))), t.encode()
        for _ in range(30):
            a, b = sorted(rng.randrange(len(data) + 2) for _ in range(2))
            assert ranks.decode_range(ids, offsets, a, b) == data[a:b]
    with pytest.raises(ValueError):
        ranks.decode(np.array([0, 1], "<u4").tobytes(), np.array([0, 1, 7]))
    with pytest.raises(ValueError):
        ranks.decode(np.array([10**6], "<u4").tobytes(), np.array([0, 1]))
    assert bpe.bpe_digests(frame(spark, []), path).count() == 0


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    from symgraph.llm.token_counts import token_counts

    texts = texts + ["It's, (really) END. word,word <|endoftext|> x<|ENDOFTEXT|>", "é, é. ß! ÷, ×.", "a b c d"]
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for head in (0, 50, 200_000):
        found = {r["doc_id"]: r for r in token_counts(frame(spark, texts), tokenizer_file("word_bpe_49k.json"), head=head, limit=100).collect()}
        for i, x in enumerate(texts):
            n = len(t.encode(x or "", add_special_tokens=False).ids)
            assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((x or "").encode()), n > 100), (i, head)
    assert token_counts(frame(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_quality_rules(spark, texts):
    from symgraph.llm.quality_rules import quality_rules

    rng = random.Random(3)
    texts = texts + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["x\nx\n\n \nx y\nx\r\n" * 5, "the # of | and $ <a>"]

    def brute(t):
        w = WORD.findall(t or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        repeat = {p for i, x in enumerate(windows) if n[x] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat)

    found = {r["doc_id"]: r for r in quality_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = found[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules(frame(spark, [])).count() == 0


def test_repeated_words_by_either_way(spark, monkeypatch):
    """Texts of more words than positions fit into a packed number are counted by the windows themselves."""
    from symgraph.llm import quality_rules

    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(100)]
    counts = lambda: {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    plain = counts()
    monkeypatch.setattr(quality_rules, "_POSITION_BITS", 4)
    assert counts() == plain and len(set(plain.values())) > 5


def test_lookup(spark):
    """Hot keys, null keys and keys without a match, joined as a plain join would."""
    from symgraph.llm.common import lookup

    rows = [(7, i) for i in range(900)] + [(None, i) for i in range(50)] + [(i, i) for i in range(300)]
    left, right = spark.createDataFrame(rows, "k long, x long"), spark.createDataFrame([(i, f"v{i}") for i in range(0, 200)], "k long, v string")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "k", how).select("k", "x", "v").collect()), key=str)
        assert sorted(map(tuple, lookup(left, right, "k", how).collect()), key=str) == want
    counts = left.groupBy("k").count().withColumnRenamed("count", "_n")
    assert lookup(left, right, "k", "inner", counts).count() == 900 + 200 and lookup(left.limit(0), right, "k").count() == 0


def test_pii(spark):
    rng = random.Random(3)
    parts = [*"a1@.-_ +()%", "a@b.c", "1.2.3.4", "4303624562121775", "+1 (767) 555-5699", "256.1.1.1", "\n", "é", "4303 6245 6212 1775", "😀", "@x..y", "0001.2.3.4"]
    texts = [None, "", "a" * 5000 + "@x.yy", "1" * 9000, "1-" * 5000 + "1", "a@" + "b." * 5000 + "c", "+1" + "(" * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in pii.detect_pii(docs).collect()}
    for i, t in enumerate(texts):
        base = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if valid(kind, m.group()))
        listed = [f"{kind}:{a}:{b}" for a, _, b, kind in base]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), i
        assert [found[i][f"n_{k}"] for k in kinds] == [sum(x[3] == k for x in base) for k in kinds]
        assert set(listed) <= set(found[i]["spans"].split(",")) | {""}
    assert pii.detect_pii(frame(spark, [])).count() == 0
    # a text's result depends on that text alone; rows and ids repeat as they do in the input
    few = spark.createDataFrame([(5, texts[10]), (5, texts[11]), (None, texts[10]), (5, texts[10])], "doc_id long, text string")
    again = sorted(r["spans"] for r in pii.detect_pii(few).collect())
    assert again == sorted([found[10]["spans"]] * 3 + [found[11]["spans"]])


def test_pii_zero_parts(spark):
    texts = ["10.0.0.1", "0.0.0.0", "000.1.1.1", "127.0.0.1", "192.168.00.10", "0255.1.1.1", "0256.0.0.0", "1.0.0.00256", "1.0.0"]
    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in pii.detect_pii(docs).collect()}
    assert [found[i]["n_ip"] for i in range(len(texts))] == [1] * 6 + [0] * 3
    assert [found[i]["spans"] for i in range(6)] == [f"ip:0:{len(t)}" for t in texts[:6]]
    assert [r["text"] for r in pii.redacted(docs).where("doc_id < 6").collect()] == ["[ip]"] * 6


def test_redaction(spark):
    docs = frame(spark, ["Mail a@b.c or +1 (767) 555-5699, 😀 1.2.3.4.", "nothing", None, "x 4303624562121775 1.2.3.4"])
    out = pii.redacted(docs).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["Mail [email] or [phone], 😀 [ip].", "nothing", None, "x [card] [ip]"]
    assert [r["n_chars"] for r in out] == [len(out[0]["text"]), 0, 0, len(out[3]["text"])]
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs.limit(0)).count() == 0
    assert [r["id"] for r in out] == [7] * 4  # other columns stay


def test_redaction_of_overlapping_spans(spark):
    rng, text = random.Random(2), "".join(chr(97 + i % 26) for i in range(400))
    for n in (0, 1, 5, 150):
        found = sorted((a := rng.randrange(390), "phone", min(400, a + rng.randint(1, 9))) for _ in range(n))
        want, at = "", 0
        for a, kind, b in found:
            if a >= at:
                want += text[at:a] + f"[{kind}]"
            at = max(at, b)
        rows = spark.createDataFrame([(text, [(a, b, kind) for a, kind, b in found])], "text string, found array<struct<start:int,end:int,kind:string>>")
        assert rows.select(pii.redact(F.col("text"), F.col("found")).alias("x")).first()["x"] == want + text[at:]


def test_pii_running_states(spark):
    values = [random.Random(1).randint(-9, 9) for _ in range(1000)]
    for n in (0, 1, 63, 64, 65, 128, 1000):
        rows = spark.createDataFrame([(values[:n],)], "v array<int>")
        got = rows.select(pii.running(F.col("v"), F.lit(3), "int", lambda now, x: now + x).alias("x")).first()["x"]
        assert got == [3 + sum(values[: k + 1]) for k in range(n)]


def test_pii_many_spans_and_long_texts(spark):
    """Offsets far into a text of thousands of candidates, and a base span among added ones, are right."""
    text = "é 10.0.0.1, tel. (030) 123-4567; " * 3000
    r = pii.detect_pii(frame(spark, [text])).first()
    assert r["n_ip"] == 3000
    spans = [(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in r["spans"].split(","))]
    assert Counter(spans) == {("ip", "10.0.0.1"): 3000, ("phone", "(030) 123-4567"): 3000}


def test_pii_finds_disguised_data(spark):
    """What the base patterns miss, in any case and whatever else the text holds; and what only looks like it."""
    yes = {
        "please write to john.doe at example dot com today": ("email", "john.doe at example dot com"), "mail: JOHN (AT) EXAMPLE (DOT) ORG now": ("email", "JOHN (AT) EXAMPLE (DOT) ORG"), "maria [at] firma.es": ("email", "maria [at] firma.es"),
        "contact john at example.com please": ("email", "john at example.com"), "my Visa is 4303.6245.6212.1775, thanks": ("card", "4303.6245.6212.1775"), "7536784127813051 4845168114407329 x": ("card", "4845168114407329"),
        "Tel.: (030) 123-4567 oder": ("phone", "(030) 123-4567"), "server 10[.]0[.]0[.]12 is down": ("ip", "10[.]0[.]0[.]12"),
    }
    no = ["on 12.03.2024 we met", "order 12345678 of 2023-10-11", "look at home.Then he left", "1234-5678-1234-5678 is no phone", "total 1.234.567", "server 300[.]1[.]1[.]1", "version 10.2.1", "978-3-16-148410-1", "0.12345678", "he was at the table. Dot came", "", None]
    got = {r["text"]: r["spans"] for r in frame(spark, [*yes, *no]).join(pii.detect_pii(frame(spark, [*yes, *no])).select("doc_id", "spans"), "doc_id").collect()}
    for text, (kind, item) in yes.items():
        assert got[text] == f"{kind}:{text.index(item)}:{text.index(item) + len(item)}", (text, got[text])
    assert {t: got[t] for t in no} == dict.fromkeys(no, "")


def test_pii_added_spans_on_held_out_examples(spark):
    """Precision and recall of what the trees add, on made examples that neither the trees nor the thresholds saw."""
    models = pii.fit(spark)
    rows = pii.labelled(pii.examples(spark)).where("part = 4")
    found = rows.select("kind", pii.verdict(F.col("x"), F.col("source"), models).alias("found")).groupBy("kind", "found").count().collect()
    n = Counter({(r["kind"], r["found"]): r["count"] for r in found})
    right = sum(c for (k, f), c in n.items() if f is not None and k == f)
    assert right / sum(c for (_, f), c in n.items() if f is not None) >= 0.93
    assert right / sum(c for (k, _), c in n.items() if k is not None) >= 0.75
    for kind in pii.KINDS:
        assert n[kind, kind] > 0.5 * sum(c for (k, _), c in n.items() if k == kind), kind


def test_pii_trees(spark):
    """The compiled model equals the plain one, and boosting separates what one feature and a pair of features decide."""
    table = [((a, b), float(10 * (a == 1 and b < 2)), float(10 * (not (a == 1 and b < 2)))) for a in range(3) for b in range(4)]
    model = pii.boost(table)
    plain = {x: model[0] + sum(pii.evaluate(t, x) for t in model[1]) for x, _, _ in table}
    assert all((plain[x] > 0) == (p > 0) for x, p, _ in table)
    rows = spark.createDataFrame([(x,) for x, _, _ in table], "x struct<a:int,b:int>")
    got = {tuple(r["x"]): r["s"] for r in rows.select("x", pii.compiled(model, ("a", "b"), F.col("x")).alias("s")).collect()}
    assert all(abs(got[x] - plain[x]) < 1e-9 for x in plain)
    assert pii.calibrated(model, table, 0.95) <= min(plain[x] for x, p, _ in table if p)
    assert pii.calibrated(model, [(x, 1.0, 99.0) for x, _, _ in table], 0.95) == float("inf")


def test_mixing(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randint(0, 40)) or None for _ in range(600)]
    sources = [None if i % 50 == 0 else "tiny" if i % 100 == 1 else "big" if i % 3 else "Ä" for i in range(600)]
    a = mixing.mix(frame(spark, texts, sources)).collect()
    b = mixing.mix(frame(spark, texts, sources).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    total, by = sum(r["size"] for r in a), {}
    for r in a:
        assert r["taken"] in (r["size"] * k for k in range(4)) and r["target"] <= 3 * r["source_size"] + 1e-6
        s = by.setdefault(sources[r["doc_id"]], [0, r["target"], 0])
        s[0], s[2] = s[0] + r["taken"], max(s[2], r["size"])
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6 * total
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())
    assert mixing.mix(frame(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(frame(spark, [None, ""])).collect())


def test_mixing_repeats_and_nulls(spark):
    """Repeated and null ids with different texts are drawn apart, repeated rows alike, and the mix itself holds each row as often as told."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, i]), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) or None, rng.choice(["x", "y", None]), i) for i in range(900)]
    rows += rows[:100]
    docs = spark.createDataFrame([(*r, "d", 1, 2, "b") for r in rows], "doc_id long, text string, source string, n_chars int, draw string, repeats int, size int, doc string")
    by_row = {(r["doc_id"], r["text"], r["source"]): set() for r in docs.collect()}
    plain = mixing._taken(docs, mixing.plan(docs), "doc_id", "text", "source", 42).select("doc.doc_id", "doc.text", "doc.source", F.col("repeats").alias("k")).collect()
    for r in plain:
        by_row[r["doc_id"], r["text"], r["source"]].add(r["k"])
    assert all(len(k) == 1 for k in by_row.values())
    nulls = {k for (i, t, s), ks in by_row.items() if i is None and s == "x" and t for k in ks}
    assert len(nulls) > 1, "null ids are not all taken alike"
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter((r["doc_id"], r["text"], r["source"]) for r in plain for _ in range(r["k"]))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == want
    assert mixing.mixed(docs.limit(0)).count() == 0


def links_of(rows, cosine=0.93):
    """Brute force: (vectors linked, component) of each row (id, vector, label)."""
    n = len(rows)
    usable = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = []
    for key in {(len(v), label) for (_, v, label), u in zip(rows, usable) if u}:
        own = [i for i in range(n) if usable[i] and (len(rows[i][1]), rows[i][2]) == key]
        x = np.array([rows[i][1] for i in own], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T
        links += [(own[i], own[j]) for i, j in zip(*np.nonzero(np.tril(near >= cosine, -1)))]
    count = Counter(k for pair in links for k in pair)
    order = sorted(range(n), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    roots = union_find(n, [(place[a], place[b]) for a, b in links])
    return [count[i] for i in range(n)], [rows[order[roots[place[i]]]][0] for i in range(n)], len(links)


def test_embeddings(spark):
    """Counts, components and kept rows against brute force, over clusters, chains, copies, dimensions and vectors that link with nothing."""
    from symgraph.llm.embed_dedup import embedding_links

    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    x[50:80] = x[0] + rng.normal(scale=0.05, size=(30, 16))
    x[100:105] = x[3]
    x[200:260] = x[200] + rng.normal(scale=0.17, size=(60, 16))
    for i in range(300, 360):  # a chain: each links with the next alone or so
        x[i] = x[i - 1] + rng.normal(scale=0.3, size=16)
    rows = [(i, [float(v) for v in v_], i % 2 if not 50 <= i < 80 and not 300 <= i < 360 else 0) for i, v_ in enumerate(x.astype(np.float32))]
    y = rng.normal(size=(60, 5))
    y[:30] = y[0] + rng.normal(scale=0.1, size=(30, 5))
    rows += [(1000 + i, [float(v) for v in v_], 1) for i, v_ in enumerate(y.astype(np.float32))]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [1.0] * 16, None), (905, [2.0, 1.0], 0), (906, [4.0, 2.0], 0), (907, [float("inf")] * 16, 0), (908, [], 0), (909, [3.0], 0), (910, [5.0], 0), (911, [-1.0], 0)]
    count, component, total = links_of(rows)
    docs = spark.createDataFrame([(*r, "h", 1, "c", 2) for r in rows], "vec_id long, embedding array<float>, label int, hash string, id int, cls string, e int").repartition(3)
    got = {r["vec_id"]: r for r in embedding_links(docs, recall=1.0).collect()}
    assert len(got) == len(rows) and total > 1000
    have = [got[r[0]] for r in rows]
    assert all(h["n_links"] <= c for h, c in zip(have, count)) and sum(h["n_links"] for h in have) >= 0.995 * sum(count)
    if [h["n_links"] for h in have] == count:
        assert [h["component_id"] for h in have] == component
    same = [h["component_id"] == c for h, c in zip(have, component)]
    assert np.mean(same) > 0.99 and all(h["kept"] == (h["vec_id"] == h["component_id"]) for h in have)
    for i in (900, 901, 902, 903, 904, 907, 908, 911):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[906]["n_links"], got[906]["component_id"], got[906]["kept"]) == (1, 905, False) and got[910]["component_id"] == 909
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_with_repeated_ids_and_rows(spark):
    from symgraph.llm.embed_dedup import embedding_links

    a, b, c = [1.0, 0.0, 0.0, 0.1], [1.0, 0.1, 0.0, 0.1], [0.0, 1.0, 1.0, 0.0]
    rows = [(3, a, 0), (3, a, 0), (3, c, 0), (5, b, 0), (5, c, 1), (2, c, 0), (None, a, 0)]
    got = sorted(map(tuple, embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (3, 1, 2, False), (5, 2, 3, False), (5, 0, 5, True), (2, 1, 2, True), (None, 0, None, True)], key=str)


def test_embedding_blocks_and_recall(spark, monkeypatch):
    """Small blocks give what one block gives, and the calibrated visits find partners at the bound."""
    from symgraph.llm import embed_dedup

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=(1000, 32))
    noise -= (noise * x[:1000]).sum(axis=1)[:, None] * x[:1000]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    x[1000:2000] = 0.932 * x[:1000] + np.sqrt(1 - 0.932**2) * noise
    x[2000:2300] = x[2000] + 0.02 * rng.normal(size=(300, 32))
    rows = [(i, [float(v) for v in v_], 0) for i, v_ in enumerate(x.astype(np.float32))]
    count, component, total = links_of(rows)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    first = {r["vec_id"]: tuple(r) for r in embed_dedup.embedding_links(docs).collect()}
    found = sum(first[i][1] for i in range(3000))
    pairs = sum(first[i][1] > 0 for i in range(2000))
    assert found <= 2 * total and all(first[i][1] <= count[i] for i in range(3000))
    assert pairs >= 0.97 * 2000, pairs
    monkeypatch.setattr(embed_dedup, "MEMBERS", 40)
    monkeypatch.setattr(embed_dedup, "VISITORS", 70)
    assert {r["vec_id"]: tuple(r) for r in embed_dedup.embedding_links(docs).collect()} == first


def test_warc(spark):
    from symgraph.llm.warc import warc_round_trip

    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, None, "", "short", "short", "x\r\n\r\ny WARC/1.1\r\n" * 20, "é" * 300, "x\r\n\r\ny WARC/1.1\r\n" * 20, "b" * 3_000_000]
    schema = "page_id long, url string, html string, payload string, digest string, key string"
    pages = spark.createDataFrame([(10 - i, None if i == 4 else f"http://h/{i}\n", h, "p", "d", "k") for i, h in enumerate(html)], schema)
    got = {r["page_id"]: r for r in warc_round_trip(pages).collect()}
    first = {}
    for i in range(len(html) - 1, -1, -1):
        first.setdefault(html[i], 10 - i)
    for i, h in enumerate(html):
        body, r = (h or "").encode(), got[10 - i]
        again = len(body) >= 100 and first[h] != 10 - i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if again else ("response", None))
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_warc_repeated_rows_and_hot_payloads(spark):
    """As many rows as pages, also for equal ids and payloads and where most pages share a payload; the SQL says which."""
    import duckdb
    import pandas as pd

    from symgraph.llm import warc

    long, rng = "<p>" + "long " * 40, random.Random(3)
    rows = [(1, "http://a", long), (1, "http://a", long), (1, "http://b", long), (2, "http://a", long), (2, "http://a", long), (3, None, None), (3, None, None), (4, "u", "s"), (None, "u", long), (None, "u", long)]
    rows += [(i, f"http://h/{i}", long if i % 3 else f"page {rng.randrange(50)} " * 30) for i in range(10, 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    have = warc.warc_round_trip(pages).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = con.execute(warc.ORACLE_SQL).df()
    plain = lambda df: sorted((tuple(None if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df[sorted(want.columns)].astype(object).values.tolist()), key=repr)
    assert len(have) == len(rows) and plain(have) == plain(want)


def test_warc_archives(spark, tmp_path):
    import gzip

    from symgraph.llm.warc import inflated, parse_records, read_archive

    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 7\r\n\r\nx\r\n\r\n\xffz\r\n\r\n"
    payload = b"x\r\n\r\n\xffz"
    for content in (one + one, gzip.compress(one) + gzip.compress(one), gzip.compress(one + one)):
        assert [r["payload"] for r in parse_records(inflated(content, 50))] == [payload] * 2
    assert [r["record_id"] for r in parse_records(inflated(one + one[:-9]))] == ["<a>"]
    (tmp_path / "a.warc").write_bytes(one * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) * 4)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one + one[:-9]))
    assert [bytes(r["payload"]) for r in read_archive(spark, f"file://{tmp_path}").collect()] == [payload] * 8


def test_warc_assembly(spark):
    """Requests and metadata that name the response, that it names, and that name another record of it; over repeats and strays."""
    from symgraph.llm.warc import assemble

    rows = [
        ("response", "r1", [], 1), ("request", "q1", ["r1"], 2), ("metadata", "m1", ["q1"], 3),
        ("response", "r2", ["q2", "m2"], 4), ("request", "q2", [], 5), ("metadata", "m2", [], 6), ("metadata", "m3", ["q2"], 7),
        ("revisit", "r3", [], 8), ("request", "q4", ["nobody"], 9), ("warcinfo", "w", ["r1"], 10), ("metadata", "m4", ["r1", "q1"], 11),
        ("response", "r5", None, 12), ("response", "r5", None, 13), ("request", "q5", ["r5"], 14),
    ]
    records = spark.createDataFrame(rows, "type string, record_id string, concurrent_to array<string>, capture_id int")
    got = sorted((r["capture_id"], r["response"]["capture_id"], [x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for r in assemble(records).collect())
    assert got == [("r1", 1, ["q1"], ["m1", "m4"]), ("r2", 4, ["q2"], ["m2", "m3"]), ("r3", 8, [], []), ("r5", 12, ["q5"], []), ("r5", 13, ["q5"], [])]
    assert assemble(records.limit(0)).count() == 0


def test_classifiers(spark):
    from symgraph.llm.quality_classifier import quality_filter, quality_scores
    from symgraph.llm.toxicity import toxicity_scores

    rng = random.Random(6)
    vocabulary = words(9, 300)
    good = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))
    texts, toxic, quality = [], [], []
    for i in range(900):
        t, bad, junk = good().split(), i % 6 == 0, i % 5 == 0
        if bad:
            for _ in range(3):
                t[rng.randrange(60)] = rng.choice(["vilefoo", "vilebar", "vilequx"])
        texts.append(" ".join(w + "***" if junk else w for w in t))
        toxic.append(int(bad))
        quality.append(int(not junk))
    docs = frame(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, quality[i], toxic[i]) for i in range(900)] + [(None, 1, 1), (3, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    for scores, want in ((toxicity_scores, toxic), (quality_scores, quality)):
        rows = scores(docs, labels).collect()
        held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
        assert len(rows) == 902 and all(0 <= r["score"] <= 1 for r in rows) and held
        assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.97
        assert scores(docs.limit(0), labels).count() == 0
        assert scores(docs, labels.limit(0)).count() == 902
    kept = {r["doc_id"] for r in quality_filter(docs, labels).collect()}
    assert np.mean([(i in kept) == bool(quality[i]) for i in range(900)]) > 0.97
