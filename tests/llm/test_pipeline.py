"""Each pipeline stage against a brute-force version over its own input; rows with repeated and null ids and columns of any name."""

import os
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}"]


def key(r):
    return (-1 if r["doc_id"] is None or r["doc_id"] != r["doc_id"] else int(r["doc_id"]), r["text"] or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """The documents, and rows of null, repeated and clashing kinds, with columns that stages could use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = [r["text"] for r in docs.where("n_chars between 500 and 3000").orderBy("doc_id").limit(3).collect()]
    more = [(None, "no id", "en", "src0", 5), (None, first[0] + " mail me: x.y@example.com", "en", None, 5), (10**9, None, None, None, None), (10**9 + 1, "", "en", None, 0), (7, first[1], "en", "src1", 9), (7, first[2] + " +1 (767) 555-5699 zz", "en", "src1", 9), (7, first[2] + " +1 (767) 555-5699 zz", "en", "src1", 9)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def test_stages(spark, odd):
    import duckdb
    import pandas as pd

    import corpus_pipeline as cp
    from symgraph.llm import mixing, pii
    from symgraph.llm.common import stash
    from symgraph.llm.quality_classifier import quality_scores
    from tests.llm.test_near_copies import shingles, similar
    from tests.llm.test_operators import library, union_find

    assert [name for name, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "pii", "mixing sources", "byte-level bpe"]
    docs, out = odd, []
    for _, stage in cp.STAGES:
        docs = stash(stage(spark, docs, SF), "test-stage")
        assert docs.columns == (COLUMNS if len(out) < 4 else ["doc_id", "ids", "n_tokens"])
        out.append(rows(docs))

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    accepted = {r["doc_id"] for r in quality_scores(odd, labels).where("predicted = 1 and doc_id is not null and doc_id <> 7").collect()}
    assert {r["doc_id"] for r in out[0] if r["doc_id"] not in (None, 7)} == accepted
    assert Counter(map(key, out[0])) - Counter(map(key, rows(odd))) == Counter()

    order = sorted(range(len(out[0])), key=lambda i: (out[0][i]["doc_id"] is None, out[0][i]["doc_id"] or 0))
    sets = [shingles(out[0][i]["text"]) for i in order]
    roots = union_find(len(order), [(i, j) for i in range(len(order)) for j in range(i) if similar(sets[i], sets[j])])
    groups: dict[int, list] = {}
    for i, root in enumerate(roots):
        groups.setdefault(root, []).append(out[0][order[i]])
    kept = Counter(map(key, out[1]))
    assert sum(kept.values()) == len(groups)
    for own in groups.values():  # one of the smallest id; which one, where rows share it, is open
        least = [r for r in own if r["doc_id"] == own[0]["doc_id"]]
        assert any(kept[key(r)] for r in least)

    spans = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(out[1])], "doc_id long, text string")
    spans = {r["doc_id"]: r["found"] for r in pii.detect_pii(spans).collect()}
    want = Counter()
    for i, r in enumerate(out[1]):
        text, at, new = r["text"] or "", 0, ""
        for s in spans[i]:
            if s["start"] >= at:
                new += text[at : s["start"]] + f"[{s['kind']}]"
            at = max(at, s["end"])
        want[key({**r, "text": new + text[at:]})] += 1
    assert Counter(map(key, out[2])) == want
    assert not any(re.search(p, r["text"] or "") for r in out[2] for p in BASE)

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(out[2]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    taken = con.execute(mixing.ORACLE_SQL.replace("select d.doc_id, d.size,", "select d.doc_id, d.text, d.size,").replace("select doc_id, source, len(", "select doc_id, text, source, len(")).df()
    copies = Counter(map(key, out[3]))
    for _, row in taken.iterrows():
        if row["size"]:
            assert copies[key({"doc_id": None if pd.isna(row["doc_id"]) else row["doc_id"], "text": row["text"]})] == row["taken"] // row["size"]

    own = library()
    want = Counter((key(r)[0], tuple(own.encode_ordinary(r["text"] or ""))) for r in out[3])
    assert Counter((key({**r, "text": ""})[0], tuple(r["ids"])) for r in out[4]) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in out[4])


def test_stages_on_an_empty_table(spark, odd):
    import corpus_pipeline as cp

    docs = odd.limit(0)
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns == (COLUMNS if i < 4 else ["doc_id", "ids", "n_tokens"])


def test_stages_with_columns_of_clashing_names(spark, odd):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    names = ["found", "_id", "_n", "_k", "_row", "row", "doc", "new", "id", "t", "s", "key", "node", "repeats", "draw", "size", "whole", "cut", "base", "score"]
    docs = odd.select("*", *[F.lit(n).alias(n) for n in names])
    for i, (_, stage) in enumerate(cp.STAGES):
        plain, more = rows(stage(spark, odd, SF)), rows(stage(spark, docs, SF))
        assert Counter((key({**r, "text": r.get("text")}), str(r.get("ids"))) for r in plain) == Counter((key({**r, "text": r.get("text")}), str(r.get("ids"))) for r in more)
        if i < 4:
            assert all(r[n] == n for r in more for n in names)
