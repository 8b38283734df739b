"""Language identification with segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the
sum, over all its segmentations into pieces, of the product of the pieces' probabilities (a forward pass); the
probability of a text is the product over its words. Piece probabilities come from expectation maximisation over
the same lattices.

Words are the maximal runs of letters of the lower-cased text, with the vocabulary's word mark in front, whole however
long they are. A character outside the vocabulary is a piece of its own at a small fixed probability.

Cases: a null, empty or letterless text gets `und` with score 0; with no labelled row at all every text does.
Repeated rows are predicted alike; ties between languages go to the smaller name. Null ids hash as ''.
"""

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SEGMENT, bounded, runs, segments

LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of a word that training takes at once (a bound of the training sample; prediction takes whole words).
TRAINED = 32
#: Letters of a word whose pieces are looked up at once, and letters of all words compared at once.
BLOCK = 4096
CELLS = 400_000
UNKNOWN = 1e-8
TINY, HUGE = 1e-100, 1e100
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-cased pieces of letters of a sentencepiece model; path None: the public 32k model."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return sorted(p for p in found if p and all(c.isalpha() or c == "▁" for c in p))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


class Lattices:
    """Finds the pieces in words: pieces of one length are a sorted array of 64-bit hashes."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.none, self.unknown = self.size, self.size + 1
        self.by_length = {}
        self.longest = max(map(len, pieces), default=1)
        for n in range(1, self.longest + 1):
            own = [(k, p) for k, p in enumerate(pieces) if len(p) == n]
            if own:
                codes = _codes([p for _, p in own])
                h = np.zeros(len(own), np.uint64)
                for i in range(n):
                    h = h * _BASE + codes[:, i] + np.uint64(1)
                order = np.argsort(h)
                self.by_length[n] = h[order], np.array([k for k, _ in own])[order]

    def spans(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length n from 1, the piece (words, starts) of n characters; codes: (words, characters)."""
        long = codes.shape[1]
        h, out = np.zeros_like(codes), []
        for n in range(1, min(self.longest, long) + 1):
            h = h[:, : long - n + 1] * _BASE + codes[:, n - 1 :] + np.uint64(1)
            found = np.full(h.shape, self.unknown if n == 1 else self.none, np.int32)
            if n in self.by_length:
                keys, ids = self.by_length[n]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = keys[at] == h
                found[same] = ids[at[same]]
            out.append(found)
        return out

    def forward(self, spans: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """(length + 1, words, languages): probability of each prefix. p: (pieces + 2, languages)."""
        n, long = spans[0].shape
        a = np.zeros((long + 1, n, p.shape[1]))
        a[0] = 1
        for j in range(1, long + 1):
            for m in range(1, min(len(spans), j) + 1):
                a[j] += a[j - m] * p[spans[m - 1][:, j - m]]
        return a

    def log_forward(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(words, languages) log probability of whole words, summed over all segmentations.

        Holds the last columns that a piece can reach back to, scaled up where they get tiny, and the pieces of one block.
        """
        n, long = codes.shape
        log, ring = np.zeros((n, p.shape[1])), [np.ones((n, p.shape[1]))]  # newest column first
        for start in range(0, long, BLOCK):
            low, stop = max(0, start - self.longest + 1), min(long, start + BLOCK)
            spans = self.spans(codes[:, low:stop])
            ends: list[list[int]] = [[] for _ in range(stop - start + 1)]  # lengths of the pieces that end there
            for m in range(2, len(spans) + 1):
                for c in np.flatnonzero((spans[m - 1] != self.none).any(0)).tolist():
                    if c + m + low > start:
                        ends[c + m + low - start].append(m)
            for j in range(start + 1, stop + 1):
                new = ring[0] * p[spans[0][:, j - 1 - low]]
                for m in ends[j - start]:
                    at = spans[m - 1][:, j - m - low]
                    some = np.flatnonzero(at != self.none)
                    new[some] += ring[m - 1][some] * p[at[some]]
                ring = [new, *ring[: self.longest - 1]]
                if new.size and new.min() < TINY:
                    up = np.where(new < TINY, HUGE, 1.0)
                    ring = [c * up for c in ring]
                    log -= np.log(up)
        return log + np.log(ring[0])

    def groups(self, words: list[str]):
        """Numbers of words of one length, about CELLS letters at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            own, most = np.flatnonzero(lengths == n), max(1, CELLS // max(int(n), 1))
            for k in range(0, len(own), most):
                yield own[k : k + most]

    def log_words(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), p.shape[1]))
        for own in self.groups(words):
            out[own] = self.log_forward(_codes([words[k] for k in own]), p)
        return out

    def fit(self, counts: dict[str, int], rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
        """Piece probabilities by expectation maximisation; the last two entries: no piece, unknown character. Words of
        at most TRAINED letters."""
        words = list(counts)
        weight = np.array([counts[w] for w in words], float)
        p = np.append(np.full(self.size, 1 / max(self.size, 1)), [0, UNKNOWN])
        lattice = [(own, self.spans(_codes([words[k] for k in own]))) for own in self.groups(words)]
        for _ in range(rounds):
            seen = np.zeros(self.size + 2)
            for own, spans in lattice:
                a = self.forward(spans, p[:, None])[..., 0]
                long = len(a) - 1
                b = np.zeros_like(a)
                b[long] = 1
                for i in range(long - 1, -1, -1):
                    for m in range(1, min(len(spans), long - i) + 1):
                        b[i] += p[spans[m - 1][:, i]] * b[i + m]
                each = weight[own] / a[long]
                for m, ids in enumerate(spans, 1):
                    flow = a[: long - m + 1].T * p[ids] * b[m:].T * each[:, None]
                    seen += np.bincount(ids.ravel(), flow.ravel(), self.size + 2)
            seen = seen[: self.size] + smooth
            p = np.append(seen / seen.sum(), [0, UNKNOWN])
        return p


class Model:
    def __init__(self, pieces: list[str], counts: dict[str, dict[str, int]]):
        self.lattices = Lattices(pieces)
        self.languages = sorted(counts)
        own = [self.lattices.fit(_cut(counts[k])) for k in self.languages]
        self.p = np.stack(own, 1) if own else np.zeros((self.lattices.size + 2, 0))

    def score(self, words: list[str]) -> np.ndarray:
        return self.lattices.log_words(["▁" + w for w in words], self.p)


def _cut(counts: dict[str, int]) -> Counter:
    """Words with the word mark, cut every TRAINED letters."""
    out: Counter = Counter()
    for word, n in counts.items():
        word = "▁" + word
        for k in range(0, len(word), TRAINED):
            out[word[k : k + TRAINED]] += n
    return out


class Scorer:
    """Scores texts; remembers the words seen, up to a bound on their number and another on their letters."""

    def __init__(self, model: Model, most: int = 400_000, letters: int = 8_000_000):
        self.model, self.most, self.letters, self.held = model, most, letters, 0
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log probability, and words of each text. Holds the words of about SEGMENT characters."""
        total, count = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        bits = [(k, s) for k, t in enumerate(texts) for s in segments(t)]
        for start, stop in runs([len(s) for _, s in bits], SEGMENT):
            found = [LETTERS.findall(s.lower()) for _, s in bits[start:stop]]
            if len(self.known) > self.most or self.held > self.letters:
                self.known, self.table, self.held = {}, self.table[:0], 0
            if new := sorted(set(chain.from_iterable(found)) - self.known.keys()):
                self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
                self.table = np.concatenate([self.table, self.model.score(new)])
                self.held += sum(map(len, new))
            sizes = np.array([len(f) for f in found])
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
            some = np.flatnonzero(sizes)
            if len(some):
                sums = np.add.reduceat(self.table[at], np.cumsum(np.append(0, sizes[some][:-1])))
                np.add.at(total, [bits[start + k][0] for k in some], sums)
                np.add.at(count, [bits[start + k][0] for k in some], sizes[some])
        return total, count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total, count = self.totals(texts)
        if not total.shape[1]:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.model.languages[b] if n else "und" for b, n in zip(best, count, strict=True)], np.where(count > 0, score, 0.0)


def held_out(key) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(3)) == 1


def train(labelled: DataFrame, per_language: int = 1500, words: int = 50_000, vocabulary_path: str | None = None) -> Model:
    """A model from (id, text, lang) rows.

    Bounds of the sample: about per_language whole texts of each language, chosen by a hash of the id, and of those the
    commonest words words of each. The number of languages has no bound; the model holds pieces x languages numbers.
    """
    rows = labelled.toDF("id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Model(vocabulary(vocabulary_path), {})
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, per_language / n))) for k, n in sizes.items()))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                for s in segments(text.as_py()):
                    seen.setdefault(lang, Counter()).update(LETTERS.findall(s.lower()))
            flat = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            yield pa.record_batch([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counted = bounded(picked.select("lang", "text")).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the limit is taken in each partition before the shuffle, so a language's task gets few words of each
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= words)
    counts: dict[str, dict[str, int]] = {}
    for r in ranked.select("lang", "word", "n").toArrow().to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in r.columns), strict=True):
            counts.setdefault(lang, {})[word] = n
    return Model(vocabulary(vocabulary_path), counts)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred string and score double (posterior of that language, all equally likely before) appended.

    Columns of df by these names are replaced.
    """
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces x languages: bounded by the vocabulary

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            names, score = scorer.predict([t or "" for t in batch[text].to_pylist()])
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return bounded(df).mapInArrow(run, schema)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.where(~held_out(F.col("doc_id"))), **bounds)
    out = predict(rows.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
