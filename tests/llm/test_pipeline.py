"""The pipeline's stages against plain Python over the same documents."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tuplewright.llm import langid, mixing, packing, pii, simhash


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "x", 0), (90_003, "12 34 56", "en", None, 8), (90_004, "the of and to in is", None, None, None)], docs.schema)
    out = [docs.unionByName(odd)]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"file://{folder}/{k}")
        out.append(spark.read.parquet(f"file://{folder}/{k}"))
    return out


def test_columns(stages):
    assert all(tuple(s.columns) == P.COLUMNS for s in stages[1:-1])


def test_language(stages):
    before, after = stages[0], stages[1]
    model = langid.train(before.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id"))))
    rows = before.collect()
    names, score = langid.Scorer(model).predict([r["text"] or "" for r in rows])
    want = {(r["doc_id"], n) for r, n, s in zip(rows, names, score, strict=True) if n != "und" and s >= P.LEAST_SCORE}
    assert {(r["doc_id"], r["lang"]) for r in after.collect()} == want
    assert not {k for k, _ in want} & {90_001, 90_002, 90_003}


def test_near_copies(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    words = [t.encode().lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    label = np.array([k for k, _ in rows])
    while True:
        new = np.where(near, label[None], 1 << 60).min(1)
        if (new == label).all():
            break
        label = new
    want = {k for (k, _), least in zip(rows, label, strict=True) if k == least}
    got = {r["doc_id"] for r in stages[2].collect()}
    assert got == want and len(got) < len(rows)


def test_masking(stages):
    after = {r["doc_id"]: r for r in stages[3].collect()}
    rows = stages[2].collect()
    found = pii.find([r["text"] for r in rows], pii.trained())
    assert after.keys() == {r["doc_id"] for r in rows} and any(b for b, _ in found)
    for r, (base, added) in zip(rows, found, strict=True):
        text = pii.masked(r["text"], sorted(base + added, key=lambda s: (s[0], s[2])))
        assert (after[r["doc_id"]]["text"], after[r["doc_id"]]["n_chars"]) == (text, len(text))


def test_mix(stages):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    assert Counter(r["doc_id"] for r in stages[4].collect()) == {k: n for k, n in want.items() if n}


def test_packed(spark, sf, stages):
    encode = packing.Encoder()
    tokens, copies = {}, Counter()
    for r in stages[4].collect():
        tokens[r["doc_id"]] = len(encode(r["text"])) + 1
        copies[r["doc_id"]] += 1
    held, sequences = Counter(), defaultdict(int)
    for r in stages[5].collect():
        held[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
    assert held == {k: n * copies[k] for k, n in tokens.items()}
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sequences.values())
    assert P.run(spark, sf).select("doc_id").distinct().count() > 0


def test_packed_ids(stages):
    encode = packing.Encoder()
    want = {r["doc_id"]: [*encode(r["text"]).tolist(), packing.END] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert rows and all(r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in rows)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0
