"""Each operator against brute force, a round trip or held-out truth, with nulls, ties, repeats and empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tuplewright.llm import ann, chat, html_extract, langid, mixing, neardup_embedding, packing, pii, sharding, simhash
from tuplewright.llm._common import components, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat and the dog ate", "en", "a", 1, "x", 1, "y"),
        (2, "the cat sat on the mat and the dog ate", "en", "a", 1, "x", 1, "y"),
        (2, "the cat sat on the mat and the dog ate", "en", "a", 1, "x", 1, "y"),
        (3, None, None, None, None, None, None, None),
        (4, "", "de", "b", 0, "x", 1, "y"),
        (5, " \t\n", "de", None, 3, "x", 1, "y"),
        (6, "1234 5678 !!", "de", "b", 3, "x", 1, "y"),
        (7, "der hund und die katze " * 3000, "de", "b", 3, "x", 1, "y"),
        (8, "a" * 200_000, "en", "c", 3, "x", 1, "y"),
        (9, "one", None, "c", 3, "x", 1, "y"),
        (None, "no id here", "en", "c", 3, "x", 1, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * all_segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    lattices = langid.Lattices(pieces)
    rng = np.random.default_rng(0)
    p = np.append(rng.random(len(pieces)), [0, langid.UNKNOWN])
    known = dict(zip(pieces, p, strict=False)) | {"z": langid.UNKNOWN}
    words = ["▁abab", "▁a", "▁bazab", "▁"]
    got = np.exp(lattices.log_words(words, p[:, None]))[:, 0]
    assert np.allclose(got, [all_segmentations(w, known) for w in words], rtol=1e-12)


def test_forward_takes_whole_words_and_long_pieces(monkeypatch):
    pieces = [p for p in langid.vocabulary() if len(p) > 8]
    assert len(pieces) > 3000
    monkeypatch.setattr(langid, "BLOCK", 7)
    pieces = ["▁", "a", "b", "abba", "abbaabba", "baabbaabb", "ab" * 8]
    lattices = langid.Lattices(pieces)
    p = np.append(np.random.default_rng(1).random((len(pieces), 2)) / 9, [[0, 0], [langid.UNKNOWN] * 2], axis=0)
    for word in ("▁" + "abba" * 9, "▁" + "ab" * 20, "▁abz" + "ba" * 13):
        want = [langid.np.log(all_segmentations_fast(word, dict(zip(pieces, p[:, k], strict=False)) | {"z": langid.UNKNOWN})) for k in range(2)]
        assert np.allclose(lattices.log_words([word], p)[0], want, rtol=1e-9)
    long = "▁" + "abba" * 5000  # its probability is far below the smallest double
    assert np.isfinite(lattices.log_words([long, long], p)).all()
    assert np.allclose(lattices.log_words([long], p) - lattices.log_words([long[:-4000]], p), lattices.log_words([long[:-4000]], p) - lattices.log_words([long[:-8000]], p))


def all_segmentations_fast(word, p):
    a = [1.0]
    for j in range(1, len(word) + 1):
        a.append(sum(a[i] * p[word[i:j]] for i in range(j) if word[i:j] in p))
    return a[-1]


def test_many_languages(spark):
    rows = [(k, " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}" * 3] * 5), f"l{k % 80:02}") for k in range(800)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 80


def test_training_raises_likelihood():
    counts = {"▁hello": 5, "▁help": 3, "▁yellow": 2}
    lattices = langid.Lattices(langid.vocabulary())
    scores = [sum(n * lattices.log_words([w], lattices.fit(counts, r)[:, None])[0, 0] for w, n in counts.items()) for r in (0, 1, 3)]
    assert scores[0] < scores[1] < scores[2]


def test_language_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    sure = [r for r in got if r["lang_pred"] != "und"]
    assert len(sure) > 200 and sum(r["lang_pred"] == r["lang"] for r in sure) / len(sure) > 0.97


def test_language_odd(spark):
    got = {r["doc_id"]: r for r in rows_of(langid.identify(odd_docs(spark)))}
    assert [got[k]["lang_pred"] for k in (3, 4, 5, 6)] == ["und"] * 4 and got[3]["score"] == 0
    assert got[7]["lang_pred"] == "de" and got[1]["lang_pred"] == "en" and 0 <= got[9]["score"] <= 1
    assert langid.identify(odd_docs(spark).limit(0)).count() == 0
    unlabelled = langid.identify(odd_docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_is_the_same_in_pieces():
    text = " ".join(["hund katze maus"] * 100)
    model = langid.Model(langid.vocabulary(), {"de": {"hund": 3, "maus": 1}, "en": {"dog": 2}})
    whole = langid.Scorer(model).totals([text])[0]
    small = langid.Scorer(model, most=1)
    assert np.allclose(whole, sum(small.totals([t])[0] for t in text.split()))


# 2


def vectors(spark, x, extra=()):
    rows = [(k, None if v is None else [float(c) for c in v]) for k, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_search_recall_and_scores(spark, sf):
    df = table(spark, sf, "embeddings")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids = sorted(data)
    x = np.stack([data[k] / np.linalg.norm(data[k]) for k in ids])
    got = defaultdict(list)
    for r in ann.contract(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in [k for k in ids if k % 50 == 0]:
        s = x @ x[ids.index(q)]
        want = sorted((-s[j], k) for j, k in enumerate(ids) if k != q)[:5]
        assert [r for r in got[q]] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(v - s[ids.index(k)]) < 1e-12 for k, v in got[q])
        hits += len({k for _, k in want} & {k for k, _ in got[q]})
        total += 5
    assert hits / total >= 0.97


def test_search_odd(spark):
    nan, inf = float("nan"), float("inf")
    df = vectors(spark, [[1, 0], [1, 0], [1, 0], None, [0, 0], [nan, 1], [inf, 1], [1, 2, 3]], [(8, [None, 1.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])])
    got = rows_of(ann.search(df, F.col("vec_id") == 0, k=5))
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)] and [r["rank"] for r in got] == [1, 2]
    assert ann.contract(df.limit(0)).count() == 0 and ann.search(df, F.lit(None).cast("boolean")).count() == 0


def test_search_with_clashing_columns(spark):
    df = vectors(spark, [[1, 0], [1, 0.1], [0, 1]])
    more = df.select("*", *(F.lit("own").alias(c) for c in ("id", "x", "asks", "query_id", "rank", "score")))
    asked = F.col("vec_id") == 0
    got = ann.search(more, asked)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.collect() == ann.search(df, asked).collect()
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2]


def test_search_in_blocks_is_the_same(spark, sf):
    df = table(spark, sf, "embeddings")
    whole = ann.search(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id")
    cut = ann.search(df, F.col("vec_id") % 50 == 0, query_bytes=4000).select("query_id", "rank", "vec_id")
    assert whole.exceptAll(cut).count() == 0 and whole.count() == cut.count() == 50


def test_search_with_heavily_repeated_ids(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(256)
    x = [base, *rng.standard_normal((900, 256))]
    again = [(ident, [float(c) for c in base + rng.standard_normal(256) * 0.01]) for ident in (0, 2000) for _ in range(300)]
    df = vectors(spark, x, again).coalesce(1)
    got = [r["vec_id"] for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    u = np.stack([v / np.linalg.norm(v) for v in [*x, *(np.array(v) for _, v in again)]])
    ids = np.array([*range(len(x)), *(k for k, _ in again)])
    s = (u[ids == 0] @ u.T).max(0)
    best = {k: s[ids == k].max() for k in set(ids.tolist()) - {0}}
    assert got == sorted(best, key=lambda k: (-best[k], k))[:5]


def test_bounds_hold_for_almost_all():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = ann.rotation(64)
    codes, c = ann.encode(x, turn)
    signs = (np.unpackbits(codes, axis=1).astype(float) * 2 - 1) / 8
    off = np.abs((x[:50] @ turn.T) @ signs.T / c - x[:50] @ x.T)
    assert (off <= ann.EPSILON * np.sqrt(1 - c**2) / c / np.sqrt(63)).mean() > 0.98


# 3


@pytest.mark.parametrize("seed", range(3))
def test_mix_reaches_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randint(1, 400)) if rng.random() > 0.05 else None, rng.choice("aaaaabcd") if rng.random() > 0.1 else None) for k in range(600)]
    got = rows_of(mixing.contract(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    source = {k: s for k, _, s in rows}
    size = {k: len(WORD.findall(t or "")) for k, t, _ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    sums = Counter()
    for k, n in size.items():
        sums[source[k]] += n
    want = fill(sums)
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sums[s] and abs(r["target"] - want[s]) < 1e-6 * want[s]
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 2 for s in sums)


def fill(sums):
    """Water filling by repeated resharing."""
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sums.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sums[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sums[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_odd(spark):
    docs = odd_docs(spark)
    got = rows_of(mixing.contract(docs))
    assert len(got) == 11 and {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    again = rows_of(mixing.contract(docs.repartition(3)))
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix(docs))}
    each = Counter(r["doc_id"] for r in out.collect())
    assert all(each[k] == n * (2 if k == 2 else 1) for k, n in copies.items())
    assert mixing.contract(docs.limit(0)).count() == 0
    assert {r["taken"] for r in rows_of(mixing.contract(docs.where("doc_id in (3, 4)")))} == {0}


def test_unequal_inclusion_probabilities(spark):
    """Over many seeds, sources are sampled at their own rates, and documents of a source alike."""
    rows = [(k, "a b c d", "ab"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    n = Counter()
    for seed in range(6):
        for r in rows_of(mixing.mix(docs, seed=str(seed), weights=(3.0, 1.0), share=0.75)):
            n[r["doc_id"]] += r["copies"]
    a, b = (sum(v for k, v in n.items() if k % 2 == j) / 600 for j in (0, 1))
    assert abs(a - 1.125) < 0.02 and abs(b - 0.375) < 0.02 and max(n[k] for k in range(1, 200, 2)) <= 6


# 4


def regex_spans(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k == 1 and any(int(g) > 255 for g in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_the_patterns():
    rnd = random.Random(1)
    bits = ["1", "2", "55", "0", ".", ".", "-", " ", "@", "a", "b.c", "+1", "(", ")", "%", "@x.y", "4111111111111111", "é", "255", "\n"]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 24)))
        assert regex_spans(t) == pii.base_spans(t), t


def test_chain_decodes_as_brute_force():
    from itertools import product

    from tuplewright.llm.crf import Chain

    rng = np.random.default_rng(0)
    c = Chain(5, 3)
    c.emit, c.move, c.first = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    c.emit[-1] = 0
    seqs = [rng.integers(0, 6, (n, 2)) for n in (1, 4, 2, 5)]
    for s, got in zip(seqs, c.decode(seqs), strict=True):
        e = c.scores(s[None])[0]
        score = lambda y, e=e: c.first[y[0]] + sum(e[i, y[i]] for i in range(len(y))) + sum(c.move[a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(got) == max(product(range(3), repeat=len(s)), key=score)


def test_tagger_on_held_out_table():
    table_ = pii.labelled(150, 99)
    tags = pii.trained().tag([w for w, _ in table_])
    assert sum((a == b).all() for a, (_, b) in zip(tags, table_, strict=True)) / len(table_) > 0.93


def test_added_spans():
    text = "write to joe.doe [at] example.com or call (216) 555-4155 today, card 4111.1111.1111.1111 from 10[.]0[.]0[.]1 in 2024-05-06"
    [(base, added)] = pii.find([text], pii.trained())
    assert not base
    assert [(pii.KINDS[k], text[s:e]) for s, e, k in sorted(added)] == [("email", "joe.doe [at] example.com"), ("phone", "(216) 555-4155"), ("card", "4111.1111.1111.1111"), ("ip", "10[.]0[.]0[.]1")]


def test_personal_data_contract(spark, sf):
    # brute force takes quadratic time on the one long word; test_personal_data_is_linear has such words
    odd = odd_docs(spark).where("doc_id is null or doc_id <> 8").select("doc_id", "text", "lang", "source", "n_chars")
    docs = table(spark, sf, "documents").unionByName(odd)
    text = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = pii.contract(docs).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(k or -1 for k, _ in text)
    want = Counter((k, hashlib.sha256(pii.written(regex_spans(t)).encode()).hexdigest(), *(sum(s[2] == j for s in regex_spans(t)) for j in range(4))) for k, t in text)
    assert Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    assert pii.contract(docs.limit(0)).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.detect(docs, mask=True).collect()}
    assert not any(regex_spans(t or "") for t in masked.values())


def test_long_spans_and_windows(monkeypatch):
    tagger = pii.trained()
    for n in (180, 190, 1000, 5000):
        assert pii.find(["write to " + "j" * n + " [at] example.com now"], tagger)[0][1] == [(9, n + 26, 0)]
    text = "12 34 call (216) 555-4155 x7 or joe@example.com " * 400
    whole = pii.find([text], tagger)
    assert len(whole[0][1]) == 400
    monkeypatch.setattr(pii, "TAGGED", 100)
    assert pii.find([text], tagger) == whole


def test_personal_data_is_linear():
    import time

    start = time.time()
    for t in ("1" * 300_000, "1." * 200_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" * 100_000, "+1 " * 100_000, "1 " * 150_000):
        pii.find([t], pii.trained())
    assert time.time() - start < 60


# 5


def test_escape_is_reversible(spark):
    rnd = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "é", "\n", "$1"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in got)
    assert not any(c in r["e"] for r in got for c in chat.CONTROLS)


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "hi", "é", ""]
    talk = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 5)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "</s>"]), rnd.choice([None, talk(), talk()]), "x") for c in range(60) for t in range(rnd.randint(1, 8))]
    rows += [(None, 1, "user", "a", "x"), (99, None, "assistant", "z", "x"), (99, 1, "user", "b", "x"), (99, 1, "user", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks string")
    want = defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append(((t is not None, t or 0), r or "", x or ""))
    want[-7] = [((True, 0), "user", "</s>[INST] ok [/INST]"), ((True, 1), "assistant", "</s>[INST] ok [/INST]")]
    out = chat.contract(df).collect()
    assert len(out) == len(want)
    for r in out:
        turns = sorted(want[r["conv_id"]])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat.format_chats(df).collect():
        at, counted = 0, ""
        for chars, counts in r["loss_runs"]:
            counted += r["formatted"][at : at + chars] if counts else ""
            at += chars
        assert at == len(r["formatted"])
        turns = sorted(want[r["conv_id"]])
        assert re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", counted).replace("\\\\", "\\") .count("hi") == "".join(x for _, role, x in turns if role == "assistant").count("hi")
        roles = [role for _, role, _ in turns]
        assert r["formatted"].count("<s>") == 1 + sum(a != b for a, b in zip(roles, roles[1:], strict=False))
    assert chat.format_chats(df.limit(0)).count() == 0 and chat.contract(df.limit(0)).count() == 1


# 6


def brute_links(x, ids, least):
    s = x @ x.T >= least
    np.fill_diagonal(s, False)
    label = list(range(len(ids)))
    for _ in ids:
        label = [min([label[k], *(label[j] for j in np.flatnonzero(s[k]))]) for k in range(len(ids))]
    return s.sum(1), [ids[k] for k in label]


@pytest.mark.parametrize("margin", [None, "exact"])
def test_vector_links(spark, sf, margin):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((120, 16))
    x = [base[k % 120] + rng.standard_normal(16) * (0.05 if k < 300 else 0.2) for k in range(420)] + [base[0] * 7] * 40
    df = vectors(spark, x, [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (None, [1.0] * 16), (1004, [None] * 16)])
    got = {r["vec_id"]: r for r in neardup_embedding.link(df, margin=margin).collect()}
    u = np.stack([v / np.linalg.norm(v) for v in x])
    n, c = brute_links(u, list(range(len(x))), 0.95)
    assert n.max() > 39 and (n == 0).any()
    if margin:
        assert [got[k]["n_links"] for k in range(len(x))] == list(n) and [got[k]["component_id"] for k in range(len(x))] == c
    else:
        assert sum(got[k]["n_links"] for k in range(len(x))) >= 0.98 * n.sum()
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(1000, 1005)) and None in got
    assert neardup_embedding.link(df.limit(0)).count() == 0


def test_vector_links_over_lists_and_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup_embedding, "MEMBERS", 40)
    monkeypatch.setattr(neardup_embedding, "VISITORS", 50)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((500, 8))
    x = [base[k % 500] + rng.standard_normal(8) * 0.08 for k in range(1500)] + [base[3] + rng.standard_normal(8) * 0.05 for _ in range(300)]
    got = {r["vec_id"]: r for r in neardup_embedding.link(vectors(spark, x), margin="exact").collect()}
    u = np.stack([v / np.linalg.norm(v) for v in x])
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    assert [got[k]["n_links"] for k in range(len(x))] == list(s.sum(1))
    assert all(got[a]["component_id"] == got[b]["component_id"] for a, b in zip(*np.nonzero(s), strict=True))


def test_vector_links_of_repeated_ids_and_clashing_columns(spark):
    df = vectors(spark, [[1, 0], [1, 0], [0, 1]], [(0, [1.0, 0.0]), (0, [0.0, 1.0])])
    more = df.select("*", *(F.lit("own").alias(c) for c in ("id", "x", "node", "home", "list", "n_links", "component", "component_id", "kept")))
    got = {r["vec_id"]: tuple(r)[1:] for r in neardup_embedding.contract(more).collect()}
    # rows of one id don't link with each other; their links to other ids add up, and join both sides
    assert got == {0: (3, 0, True), 1: (2, 0, False), 2: (1, 0, False)}


def test_vector_links_of_few_intrinsic_dimensions(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 4)) @ np.linalg.qr(rng.standard_normal((64, 4)))[0].T
    got = {r["vec_id"]: r["n_links"] for r in neardup_embedding.contract(vectors(spark, x)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    n = (s >= 0.95).sum(1) - 1
    unsure = (abs(s - 0.95) < 1e-12).any(1)
    assert n.sum() > 100_000 and all(got[k] == n[k] for k in np.flatnonzero(~unsure))


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(k, k + 1) for k in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(30)] + [(200, k) for k in range(201, 240)] + [(7, 7), (None, 3)]
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for k in sorted(near):
        todo = [k] if k not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = k
                todo += near[n]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items()) and set(got) <= set(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def plain_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_contract(spark, sf):
    docs = table(spark, sf, "documents").unionByName(odd_docs(spark).select(F.col("doc_id") + 10_000, "text", "lang", "source", "n_chars").toDF("doc_id", "text", "lang", "source", "n_chars"))
    rows = docs.collect()
    fp = [(r["doc_id"], plain_fingerprint(r["text"], 3)) for r in rows]
    label = {f: f for _, f in fp}
    least = {}
    for k, f in fp:
        least[f] = min(least.get(f, math.inf), math.inf if k is None else k)
    name = dict(least)
    for _ in range(9):
        name = {f: min(name[g] for g in label if (f ^ g).bit_count() <= 3) for f in label}
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.contract(docs).collect())
    assert got == Counter((k, f"{f:016x}", None if name[f] == math.inf else name[f]) for k, f in fp)
    assert simhash.contract(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket,part", [(4096, 8192), (16, 8192), (16, 20), (1, 5)])
def test_simhash_links_lose_nothing(spark, monkeypatch, bucket, part):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "PART", part)
    rnd = random.Random(6)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for k in range(250):
        f = rnd.choice(fps[: 30 if k < 100 else None])
        for _ in range(rnd.randint(0, 4)):
            f ^= 1 << rnd.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {r["fp"]: r["component"] for r in simhash.groups(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    group = [got.get(f, f) for f in signed]
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                assert group[a] == group[b]
    label = list(range(len(fps)))
    for _ in range(60):
        label = [min(label[b] for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 3) for a in range(len(fps))] if _ < 12 else label
    assert len(set(group)) == len(set(label))


def test_planes_against_popcount():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    q = a[:70] ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64))
    for radius in (0, 1, 2, 3, 6, 30):
        got = set(zip(*(x.tolist() for x in simhash.Planes(a).within(q, radius)), strict=True))
        assert got == {(i, j) for i in range(70) for j in range(300) if int(q[i] ^ a[j]).bit_count() <= radius}


def test_wide_planes_against_popcount():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, (200, 4), dtype=np.uint64)
    q = a[:50].copy()
    for k in range(50):
        for b in rng.integers(0, 256, 2 * k):
            q[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    count = lambda x, y: sum(int(u ^ v).bit_count() for u, v in zip(x, y, strict=True))
    for radius in (0, 5, 30, 51, 63, 64):
        got = set(zip(*(x.tolist() for x in simhash.Planes(a).within(q, radius)), strict=True))
        assert got == {(i, j) for i in range(50) for j in range(200) if count(q[i], a[j]) <= radius}


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, near, whole = [], defaultdict(list), []
    for k in range(1500):
        w = [word() for _ in range(rng.choice([8, 60, 300]))]
        docs.append((len(docs), " ".join(w)))
        whole.append(w)
    for k in range(0, 1500, 5):
        w = list(whole[k])
        if len(w) > 20:
            for _ in range(max(1, len(w) // 90)):
                w[rng.randrange(len(w))] = word()
        docs.append((len(docs), " ".join(w)))
        near[k].append(len(docs) - 1)
    for bucket in (simhash.WIDE_BUCKET, 32):
        old, simhash.WIDE_BUCKET = simhash.WIDE_BUCKET, bucket
        try:
            kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        finally:
            simhash.WIDE_BUCKET = old
        assert set(range(1500)) <= kept
        assert len(kept - set(range(1500))) <= 0.02 * 300


def test_exact_forest_against_sets():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, 80, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(80) < rng.choice([0, 0.05, 0.12, 0.2]), rng.integers(0, 2**63, 80, dtype=np.uint64), base[k % 6])) for k in range(90)]
    sets += [sets[0][:0], sets[0][:0], sets[1][:40]]
    n = len(sets)
    near = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets])

    def reached(pairs):
        label = list(range(n))
        for _ in range(n):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    bits = np.zeros((n, 4), np.uint64)
    want = [(i, j) for i in range(n) for j in range(i) if near[i, j]]
    first = np.arange(n) % 3 == 0
    for mask, pairs in ((None, want), (first, [(i, j) for i, j in want if first[i] != first[j]])):
        a, b = simhash.exact_forest(bits, sets, mask, 0, 0.8)
        assert reached(list(zip(a.tolist(), b.tolist(), strict=True))) == reached(pairs) and len(set(a.tolist())) == len(a)


def test_only_links_of_the_similarity_count(spark):
    word = [f"w{k}" for k in range(400)]
    docs = [(1, word), (2, [*word[:390], *"abcdefghij"]), (3, [*word[:350], *(f"x{k}" for k in range(50))]), (4, word[:5]), (5, word[:5]), (6, word[:4]), (7, [])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    for size in (simhash.PART_BYTES, 3000):
        old, simhash.PART_BYTES = simhash.PART_BYTES, size
        try:
            assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == [1, 3, 4, 6, 7]
        finally:
            simhash.PART_BYTES = old


def test_near_copies_that_fingerprints_miss(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(6)]
    texts = [[word() for _ in range(8)] for _ in range(200)] + [[word() for _ in range(48)] + line for _ in range(100)]
    docs = texts + [[*w, word()] if len(w) == 8 else [word(), *w[1:]] for w in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in docs]
    near = [[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    assert all(sum(x) == 2 and x[k] and x[(k + 300) % 600] for k, x in enumerate(near))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == list(range(300))


def test_prefixes_and_parities_lose_nothing():
    rng = np.random.default_rng(12)
    for n in (1, 4, 5, 9, 60, 1500, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            some = rng.random(len(a)) < rng.choice([0.8, 0.9, 1])
            b = np.unique(np.append(a[some], rng.integers(0, 2**64, rng.integers(0, n // 9 + 2), dtype=np.uint64)))
            both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            assert simhash.differing(simhash.parities(a), simhash.parities(b)) <= every - both
            common = np.sort(rng.choice(a, len(a) // 2, replace=False))
            if 5 * both >= 4 * every:
                assert len(np.intersect1d(*(simhash.prefix(x, 0.8, (common, np.arange(len(common)) % 7 + 2)) for x in (a, b))))


def test_rows_without_an_id_go_by_their_text(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(50)) for c in "xyz")
    rows = [(None, x, "a"), (5, x, "b"), (None, y, "c"), (9, z, "d"), (9, x, "e"), (None, y, "c"), (11, None, "f"), (12, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted(r["_id"] for r in simhash.deduplicated(docs).collect())
    assert got == ["b", "c", "d", "f"]


def test_long_text_shingles():
    text = " ".join(f"Word{k % 9973}" for k in range(300_000))
    w = text.lower().encode().split()
    assert simhash.shingles(text, 5).tolist() == sorted({xxhash.xxh64_intdigest(b" ".join(w[k : k + 5]), 42) for k in range(len(w) - 4)})


def test_long_text_fingerprint():
    text = " ".join(f"word{k % 977}" for k in range(300_000))
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text, 3)


def test_deduplicated(spark):
    docs = odd_docs(spark).where("doc_id is not null")
    got = sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect())
    assert got == [1, 3, 6, 7, 8, 9]


# 8


def test_fast_ids_are_the_tokenizers():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.Encoder()

    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=60) | st.text("aé 1'\n\t<|endoftext|>  s٣", max_size=60))
    def same(text):
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|>", "a<|endoftext|> b", "", "  \n\n x", "don't 12345 é𝟙ß"):
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_packing_contract(spark, sf):
    docs = table(spark, sf, "documents").unionByName(odd_docs(spark).where("doc_id <> 2").select(F.col("doc_id") + 10_000, "text", "lang", "source", "n_chars").toDF("doc_id", "text", "lang", "source", "n_chars"))
    encode = packing.Encoder()
    ids = {r["doc_id"]: [*encode(r["text"] or "").tolist(), 0] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert own == r["ids"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["step_group"]))
    assert pieces.keys() == ids.keys()
    for k, p in pieces.items():
        assert [s for s, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) == len(ids[k])
    groups = Counter()
    for s in sequences.values():
        total = sum(n for _, n, _ in s)
        assert [o for o, _, _ in sorted(s)] == [0, *np.cumsum([n for _, n, _ in sorted(s)])[:-1]]
        assert total <= 1024 and total & (total - 1) == 0
        groups[s[0][2]] += total
    assert max(groups.values()) <= packing.STEP
    assert packing.contract(docs.limit(0)).count() == 0


# 9


def test_extraction_on_held_out_pages():
    ex = html_extract.trained()
    right = total = 0
    for page in html_extract.labelled(80, 99):
        clean = re.sub("[" + "".join(html_extract.MARKS) + "]", "", page)
        want = [t.replace(html_extract.MARKS[1], "") for t, _, _ in html_extract.blocks(page) if t[0] == html_extract.MARKS[1]]
        right += ex.extract([clean]) == ["\n".join(want)]
        total += 1
    assert right / total > 0.9


def test_extraction_details():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>"
        "<article><h1>The  title &amp; more</h1><p>First<br>line\n of <b>te</b>xt.<script>var t='</p>';</script><p>Second one, é &lt;x&gt; &#8364;.<!-- no --><div class=ad>Buy this now.</div></article>"
        "<section class=comments><p>I like it very much.</p></section><aside><p>Related things.</p></aside><form><p>Sign up</p></form><footer>&copy; me</footer>"
    )
    assert html_extract.trained().extract([page, "", "<", "<p", "plain"])[:4] == ["The title & more\nFirst line of text.\nSecond one, é <x> €.", "", "", ""]


def test_pages_with_open_elements():
    ex = html_extract.trained()
    say = "Some words here, as a text that is main."
    assert ex.extract([f"<html><head><title>x</title><article><p>{say}</article></html>", f"<html><head><meta x><article><p>{say}", f"<title>x<article><p>{say}</article>"]) == [say] * 3
    math = f"<article><p>Before <object data=x>an object <math><mi>x</mi><mo>=</mo><mn>2</mn></math> after it.<p>{say}</article>"
    assert ex.extract([math]) == [f"Before an object x=2 after it.\n{say}"]
    for tag in ("svg", "select", "noscript", "template", "textarea", "iframe"):  # never closed
        assert say in ex.extract([f"<article><p>{say}</p><{tag}><p>{say}</p></article>"])[0]
    assert ex.extract([f"<article><p>{say}</p><script>var x = 1;<p>{say}</p></article>"]) == [say]


def test_reading_pages_is_linear():
    import time

    def spent(page):
        start = time.process_time()
        html_extract.blocks(page)
        return time.process_time() - start

    for page in ("<div>x", "<b><a>y", "<x-y>z", "<select><ul><li>w", "<p class='a'>v</i>"):
        assert spent(page * 60_000) < 12 * spent(page * 10_000) + 0.5
    linked = html_extract.blocks("<p>" + "<b>" * 200 + "<a>in a link</a>")
    assert linked[0][1] == 1.0


def test_extraction_odd(spark):
    page = "<article><p>Some words here, as text.</p></article>"
    df = spark.createDataFrame([(1, page, "old", 5), (1, page, "old", 5), (2, None, None, None)], "page_id long, html string, text string, n_chars long")
    got = [tuple(r) for r in html_extract.extract(df).orderBy("page_id").collect()]
    assert got == [(1, "Some words here, as text.", 25)] * 2 + [(2, "", 0)]


def test_extraction_contract(spark, sf):
    pages = table(spark, sf, "pages")
    odd = spark.createDataFrame([(900, None, None), (901, "u", ""), (None, "u", "<article><p>Some words here, as text.</p></article>"), (902, "u", "<b>" * 50_000 + "<div>" * 3000 + "x")], "page_id long, url string, html string")
    got = html_extract.contract(pages.unionByName(odd)).collect()
    assert len(got) == pages.count() + 4
    by = {r["page_id"]: r for r in got}
    assert by[900]["text"] == "" and by[901]["n_chars"] == 0 and by[None]["text"] == "Some words here, as text."
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert by[r["page_id"]]["text"] == "\n".join(b for b in want if b) and by[r["page_id"]]["n_chars"] == len(by[r["page_id"]]["text"])


# 10


def check_shards(rows, sizes, shards, near):
    loads, places = Counter(), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values() if len(loads) == shards else [0]) <= near
    assert Counter(r["size"] for r in rows) == Counter(sizes)


def test_sharding_contract(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = sharding.contract(docs).collect()
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["size"] == len(text[r["doc_id"]]) + 8 for r in got)
    total = sum(map(len, text.values()))
    check_shards(got, [len(t) + 8 for t in text.values()], 24, 0.02 * total / 24)


def test_sharding_odd(spark):
    docs = odd_docs(spark)
    got = sharding.contract(docs).collect()
    check_shards(got, [len((r["text"] or "").encode()) + 8 for r in docs.collect()], 24, math.inf)
    assert sharding.contract(docs.limit(0)).count() == 0
    same = spark.range(6000).select(F.lit(5).alias("doc_id"), F.lit("the same row").alias("text")).union(spark.range(3000).select(F.col("id") + 10, F.concat(F.lit("t"), "id")))
    got = sharding.contract(same).collect()
    check_shards(got, [20] * 6000 + [len(f"t{k}") + 8 for k in range(3000)], 24, 0.05 * 147_000 / 24)


def test_slot_maps_are_stored_and_read(spark, sf, tmp_path):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    maps = sharding.SlotMaps(spark, f"file://{tmp_path}/maps")
    assert maps.newest() == 0
    first = {r["virtual_slot"]: r["shard"] for r in sharding.shard(docs, 24, 512, maps).collect()}
    assert maps.newest() == 1
    # a second run reads the map: edited by hand (two shards change names), it decides
    swap = F.when(F.col("shard") == 0, 1).when(F.col("shard") == 1, 0).otherwise(F.col("shard"))
    maps.save(maps.load(1).withColumn("shard", swap), 2)
    got = sharding.shard(docs, 24, 512, maps).collect()
    assert {r["version"] for r in got} == {2} and maps.newest() == 2
    assert all(r["shard"] == {0: 1, 1: 0}.get(first[r["virtual_slot"]], first[r["virtual_slot"]]) for r in got)
    grown = sharding.shard(docs, 25, 512, maps).collect()
    assert maps.newest() == 3 and {r["shard"] for r in grown} == set(range(25))
    before = {r["virtual_slot"]: r["shard"] for r in got}
    moved = sum(before[r["virtual_slot"]] != r["shard"] for r in grown)
    assert 0 < moved < 0.2 * len(grown)
    with pytest.raises(ValueError):
        maps.save(maps.load(1), 2)


def test_rebalance_moves_little(spark, sf):
    rows = sharding.records(table(spark, sf.replace("0.001", "0.01"), "documents"), 512)
    sizes = sharding.slot_sizes(rows)
    old = sharding.assign(sizes, 24)
    new = sharding.rebalance(old, sizes, 25)
    before, after = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (old, new))
    assert before.keys() == after.keys() and {r["version"] for r in new.collect()} == {2}
    assert sum(before[k] != after[k] for k in before) / len(before) < 0.2
    loads = Counter()
    for r in sizes.collect():
        loads[after[r["virtual_slot"]]] += r["bytes"]
    assert len(loads) == 25 and max(loads.values()) < 1.1 * sum(loads.values()) / 25


def test_a_wrong_mask_fails(spark):
    rows = [(1, 0, "user", "ask <s>"), (1, 1, "assistant", "say [INST] it"), (1, 2, "assistant", ""), (1, 3, "assistant", "more"), (2, 0, "user", "only")]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text = lambda runs: {r["conv_id"]: r["t"] for r in done.select("conv_id", chat.under_mask(F.col("formatted"), runs).alias("t")).collect()}
    runs = F.col("loss_runs")
    assert text(runs) == {1: "say [INST] itmore", 2: ""}
    turned = F.transform(runs, lambda r: F.struct(r["chars"].alias("chars"), (~r["counts"]).alias("counts")))
    assert text(turned)[1] != text(runs)[1] and text(turned)[2]
    shifted = F.transform(runs, lambda r, k: F.struct((r["chars"] + F.when(k < 2, 1 - 2 * k).otherwise(0)).alias("chars"), r["counts"].alias("counts")))
    assert text(shifted) == {1: None, 2: None}
    assert text(F.slice(runs, 1, 2)) == {1: None, 2: None}


def test_native_operators_have_no_python(spark, sf):
    for df in (chat.contract(table(spark, sf, "conversations")), sharding.contract(table(spark, sf, "documents"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_registered():
    from tuplewright.llm import queries

    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert json.dumps(sorted(queries.oracle_sql()))
