"""SimHash near-duplicates with a bit-sliced comparison.

A document's fingerprint has bit i set if more than half of its shingles' XXH64 hashes have it. Fingerprints within
`radius` bits are linked. Candidates come from the pigeonhole principle: two such fingerprints agree on at least
`choose` of `radius + choose` blocks of bits, so they share a bucket of some table, one table for each choice of
blocks; a bucket's key is the first bits of the blocks, as many as make buckets of about BUCKET fingerprints. No
pair is lost, at any size. Only distinct fingerprints are compared, so copies cost nothing; large buckets are
dealt over cells of two parts of at most PART fingerprints each.

In a cell the fingerprints lie as bit planes, 64 fingerprints to a word. Planes are compared in turn; the
differences are counted in carry-save form (ones, twos, fours, ..., over), and a block of queries is abandoned as
soon as every candidate is over the radius. A cell returns a spanning forest of its links, never its pairs.

`deduplicated` looks for less similar copies: texts whose sets of five-word shingles have a Jaccard similarity of
SIMILARITY or more. Candidates come from fingerprints of WORDS x 64 bits over those sets: pairs in which CLOSE of the
bits agree, which texts of that similarity do but for three standard deviations. No choice of blocks is exact at such
a radius, so its tables take their keys from random bits, as many tables as find a pair of Jaccard similarity 0.8 with
probability RECALL; their number grows with n as a power under a quarter. An exact check follows within each class
of candidates, over one set for each name of a set, in cells of about PART_BYTES: a larger class is dealt over several,
and one set of each group that a cell finds goes on to the next level, until the class fits a cell.

What that misses, by its fingerprints or between cells, is found by an exact route over the different shingle sets
(`rest`): in any one order of all shingles, two sets of that similarity share a shingle among the first
n - ceil(SIMILARITY n) + 1 of each. The order puts shingles that are common in a sample last, so that few sets share
one; the sample decides about the cost, never the links. Pairs that meet in such a shingle and aren't joined yet are
dropped where their sizes, the shingle's places or the parities of their shingles by residue rule the similarity out,
and the others are compared set by set. So RECALL and PART_BYTES decide about the cost too, not the links.

Cases: null text is empty text; a document without words has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle of all words; repeated rows have equal fingerprints; null ids don't become a
component's name unless nothing else is in it; an empty table gives an empty result.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded, components, durable, merge_labels, small

BUCKET = 4096
PART = 8192
BITS = 64
#: Of `deduplicated`: words of a fingerprint, Jaccard similarity of a link, share of equal bits of a candidate, chance
#: that a pair meets in a table, bucket size, bytes of shingle sets in a part of a cell.
WORDS = 4
SIMILARITY = 0.8
CLOSE = 0.78
RECALL = 0.9
WIDE_BUCKET = 1024
PART_BYTES = 8 << 20
#: Of the exact route: bits of a set's sketch, and of its parities at least, sampled documents (at least; and a share of all), common shingles
#: that are told apart at most.
SKETCH = 512
PARITY = 1024
SAMPLED = 8192
SAMPLED_SHARE = 1 / 12
COMMON = 1 << 19
#: Share of equal bits of two texts with Jaccard similarity 0.8: 1 - acos(2 J / (1 + J)) / pi.
AGREE = 0.849


def words_of(text: str):
    """Lists of words of the text, A-Z lowered; a long text comes in several lists that overlap in nothing."""
    data = text.encode("utf-8", "surrogatepass")
    start, n, limit = 0, len(data), 1 << 20
    while n - start > limit:
        cut = start + limit
        while cut < n and data[cut] not in b" \t\n\v\f\r":
            cut += 1
        yield data[start:cut].lower().split()
        start = cut
    yield data[start:].lower().split()


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted hashes of the text's different shingles."""
    found, tail = [], []
    for part in words_of(text):
        w = tail + part
        found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(w[k:] for k in range(width)), strict=False)), "<u8")))
        tail = w[max(0, len(w) - width + 1) :]
    found = np.unique(np.concatenate(found))
    return found if len(found) or not tail else np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], "<u8")


def _more(h: np.ndarray, words: int) -> list[np.ndarray]:
    """h, and words - 1 further hashes mixed from it (modulo 2^64)."""
    out = [h]
    for k in range(1, words):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return out


def wide_fingerprint(text: str, width: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """words x 64 bits, as uint64; the first word is `fingerprint`. distinct: each shingle counts once."""
    ones, total, tail = np.zeros((words, BITS), np.int64), 0, []
    seen: list[np.ndarray] = []
    hash64 = xxhash.xxh64_intdigest

    def add(h: np.ndarray) -> None:
        for k in range(0, len(h), 1 << 16):
            for j, more in enumerate(_more(h[k : k + (1 << 16)], words)):
                ones[j] += np.unpackbits(more.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)

    for part in words_of(text):
        w = tail + part
        if len(w) >= width:
            h = np.array([hash64(b" ".join(s), 42) for s in zip(*(w[k:] for k in range(width)), strict=False)], "<u8")
            if distinct:
                seen.append(np.unique(h))
            else:
                add(h)
                total += len(h)
            tail = w[len(w) - width + 1 :] if width > 1 else []
        else:
            tail = w
    if seen:
        h = np.unique(np.concatenate(seen))
        add(h)
        total = len(h)
    if not total and tail:
        add(np.array([hash64(b" ".join(tail), 42)], "<u8"))
        total = 1
    return np.packbits((2 * ones > total).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def _bits(h: np.ndarray, words: int) -> np.ndarray:
    """`wide_fingerprint` of the different shingles h."""
    ones = np.zeros((words, BITS), np.int64)
    for k in range(0, len(h), 1 << 16):
        for j, more in enumerate(_more(h[k : k + (1 << 16)], words)):
            ones[j] += np.unpackbits(more.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * ones > len(h)).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str, width: int) -> int:
    return int(wide_fingerprint(text, width)[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """df without its text, with fp: the fingerprint as a signed long."""
    rest = [f for f in df.schema.fields if f.name not in (text, "fp")]

    def run(batches):
        for batch in batches:
            seen: dict[str, int] = {}
            out = []
            for t in batch[text].to_pylist():
                t = t or ""
                if t not in seen:
                    seen[t] = fingerprint(t, width)
                out.append(seen[t])
            fp = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.record_batch([*(batch[f.name] for f in rest), fp], [*(f.name for f in rest), "fp"])

    return bounded(df).mapInArrow(run, T.StructType([*rest, T.StructField("fp", T.LongType())]))


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry and sum of three bits."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


class Planes:
    """Fingerprints (n, words) as bit planes of packed words."""

    def __init__(self, fps: np.ndarray):
        fps = fps.reshape(len(fps), -1)
        self.n, self.bits = len(fps), BITS * fps.shape[1]
        width = -(-self.n // 64) * 64
        bits = np.zeros((self.bits, width), np.uint8)
        bits[:, : self.n] = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little").T
        self.planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        live = np.zeros(width, np.uint8)
        live[: self.n] = 1
        self.live = np.packbits(live, bitorder="little").view("<u8")

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) positions at most radius bits apart.

        Counters hold up to radius + 1 differences in binary digits. Eight planes at a time are added by carry-save
        adders to the digits of one, two and four; their carry goes on to the higher digits.
        """
        queries = queries.reshape(len(queries), -1)
        every = ~np.uint64(0)
        masks = np.where((np.repeat(queries, BITS, axis=1) >> np.tile(np.arange(BITS, dtype=np.uint64), queries.shape[1])) & np.uint64(1), every, np.uint64(0))
        shape = (len(queries), len(self.live))
        digits = max(3, (radius + 1).bit_length())
        start = (1 << digits) - 1 - radius  # the counter overflows with difference number radius + 1
        count = [np.full(shape, every if start >> k & 1 else np.uint64(0)) for k in range(digits)]
        over = np.broadcast_to(~self.live, shape).copy()
        for b in range(0, self.bits, 8):
            x = [self.planes[b + k][None] ^ masks[:, b + k, None] for k in range(8)]
            two_a, one = _csa(count[0], x[0], x[1])
            two_b, one = _csa(one, x[2], x[3])
            four_a, two = _csa(count[1], two_a, two_b)
            two_a, one = _csa(one, x[4], x[5])
            two_b, count[0] = _csa(one, x[6], x[7])
            four_b, count[1] = _csa(two, two_a, two_b)
            carry, count[2] = _csa(count[2], four_a, four_b)
            for k in range(3, digits):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b + 8 > radius and (over == every).all():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = ~over
        q, w = np.nonzero(near)
        hit = np.unpackbits(near[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(hit)
        return q[row], w[row] * 64 + bit


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, a_bits: np.ndarray | None = None, b_bits: np.ndarray | None = None, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, smaller node), of the links between nodes a and b; within a if b is None.

    bits: the nodes' fingerprints, if they are not the nodes themselves.
    """
    a_bits = a if a_bits is None else a_bits
    b_bits = b if b_bits is None else b_bits
    nodes, where = np.unique(a if b is None else np.append(a, b), return_inverse=True)
    label = np.arange(len(nodes))
    in_a = where[: len(a)]
    in_q = in_a if b is None else where[len(a) :]
    if not len(in_a) or not len(in_q):
        return nodes[:0], nodes[:0]
    planes, queries = Planes(a_bits), a_bits if b is None else b_bits
    for at in range(0, len(queries), step):
        q, m = planes.within(queries[at : at + step], radius)
        other = in_q[at + q] != in_a[m]
        q, m = q[other], m[other]
        if len(q):
            for g in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                merge_labels(label, np.append(in_a[m[g]], in_q[at + q[g[0]]]))
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays without repeats have in common."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)) if len(x) else 0


def exact_forest(bits: np.ndarray, sets: list[np.ndarray], first: np.ndarray | None, radius: int, similarity: float, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions (node, smaller node), of the pairs at most radius bits apart whose sets (sorted
    arrays) have that Jaccard similarity; between the first and the others, or among all if first is None.

    Pairs that the forest already joins are not looked at, so a class of true copies costs little more than its bits.
    """
    label = np.arange(len(sets))
    members, queries = (label, label) if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    sizes = np.array([len(x) for x in sets], np.int64)
    if not len(members) or not len(queries):
        return label[:0], label[:0]
    label, planes = label.copy(), Planes(bits[members])
    for at in range(0, len(queries), step):
        q, m = planes.within(bits[queries[at : at + step]], radius)
        for g in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
            if not len(g):
                continue
            me = queries[at + q[g[0]]]
            others = members[m[g]]
            low, high = np.minimum(sizes[others], sizes[me]), np.maximum(sizes[others], sizes[me])
            others, most = others[low >= similarity * high], 1
            while len(others := others[label[others] != label[me]]):
                some, others = others[:most], others[most:]
                most = min(64, 2 * most)
                common = np.array([shared(sets[x], sets[me]) for x in some])
                near = some[common >= similarity * (sizes[some] + sizes[me] - common) - 1e-9]
                if len(near):
                    merge_labels(label, np.append(near, me))
    child = np.flatnonzero(label != np.arange(len(sets)))
    return child, label[child]


def tables(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """For n fingerprints: each table's key as (first bit, bits) pieces."""
    need = max(0, int(np.ceil(np.log2(max(n, 1) / BUCKET))))
    if not need:
        return [[]]
    choose = 1
    while choose * (BITS // (radius + choose)) < need and choose < BITS - radius:
        choose += 1
    blocks = radius + choose
    cuts = np.linspace(0, BITS, blocks + 1).astype(int)
    out = []
    for some in combinations(range(blocks), choose):
        left, key = need, []
        for k, block in enumerate(some):
            take = min(-(-left // (choose - k)), int(cuts[block + 1] - cuts[block]))
            key.append((int(cuts[block]), take))
            left -= take
        out.append(key)
    return out


def groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component) for distinct fingerprints (column fp) that have a link to another; component is a fingerprint."""
    n = fps.count()
    parts = []
    for number, key in enumerate(tables(n, radius)):
        value = F.lit(number).cast("long")
        for first, bits in key:
            value = F.shiftleft(value, bits) + F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        parts.append(value)
    keyed = fps.select("fp", F.posexplode(F.array(*parts)).alias("table", "key"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        fp = cell["fp"].to_numpy().view(np.uint64)
        first = (cell["own"] == cell["i"]).to_numpy()
        a, b = forest(fp[first], None if cell["i"].iloc[0] == cell["j"].iloc[0] else fp[~first], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return components(_cells(keyed, PART).applyInPandas(compare, "a long, b long").distinct()).toDF("fp", "component")


def _cells(keyed: DataFrame, part: int):
    """keyed (table, key, fp, ...) grouped into cells: a bucket of over part rows is cut, and each two of its cuts meet."""
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > part)
    sizes = small(durable(sizes.select(F.col("table").alias("t"), F.col("key").alias("k"), F.ceil(F.col("n") / F.lit(max(1, part * 3 // 4))).cast("int").alias("s"))))
    dealt = keyed.join(sizes, (F.col("table") == F.col("t")) & (F.col("key") == F.col("k")), "left").withColumn("s", F.coalesce("s", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("t", "k", "s", "other")
    return dealt.groupBy("table", "key", "i", "j")


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most COMMON shingles that several texts of a sample of docs (doc_id, text, text_hash) share, sorted, and how many
    do. Copies of a text count once, as they are one set."""
    share = max(SAMPLED_SHARE, SAMPLED / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64(F.lit("common"), "text_hash"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    again = some.groupBy(F.col("text_hash").alias("_hash")).agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n")).where("_n > 1")
    again = small(durable(again.select("_hash", "_id")))
    some = some.join(again, F.col("text_hash") == F.col("_hash"), "left").where(F.col("_hash").isNull() | F.col("doc_id").eqNullSafe(F.col("_id")))

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            for k in range(0, len(texts), 256):
                h, n = np.unique(np.concatenate([shingles(t or "", width) for t in texts[k : k + 256]]), return_counts=True)
                yield pa.record_batch([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    found = bounded(some.select("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    got = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = (np.asarray(got[c].combine_chunks()).astype(np.int64) for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def prefix(h: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of the set h, in the order of all shingles: any set of that similarity has one of them among its own."""
    names, counts = common
    if not len(h):
        return h
    n = np.zeros(len(h), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        n = np.where(names[at] == h, counts[at], 0)
    return h[np.lexsort((h, n))][: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def parities(h: np.ndarray, bits: int = 0) -> bytes:
    """For each residue modulo bits (a power of two, by the size of h), whether an odd number of shingles has it: sets differ
    in as many shingles as parities, or more."""
    bits = bits or max(PARITY, 1 << len(h).bit_length())
    return np.packbits((np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """How many parities of two sets differ, modulo the fewer bits of the two."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) != len(b):
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, min(len(a), len(b))), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def set_prints(docs: DataFrame, width: int, similarity: float, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text, text_hash) without text, with what is known of their shingle sets: bits, node (a name of the
    set), n (its size), first (`prefix`), parity (`parities`) and sketch (the same modulo SKETCH)."""
    common_of = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))  # COMMON shingles at most
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        common = common_of.value
        for batch in batches:
            seen: dict[str, tuple] = {}
            out = []
            for t in batch["text"].to_pylist():
                t = t or ""
                if t not in seen:
                    h = shingles(t, width).astype(np.uint64)
                    name = xxhash.xxh64_intdigest(h.astype("<u8").tobytes())
                    seen[t] = (_bits(h, words).astype("<u8").tobytes(), name - (1 << 64) if name >> 63 else name, len(h), prefix(h, similarity, common).view(np.int64), parities(h), np.frombuffer(parities(h, SKETCH), np.int64))
                out.append(seen[t])
            bits, node, n, first, parity, sketch = zip(*out, strict=True) if out else ((),) * 6
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, first)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            yield pa.record_batch([*(batch[f.name] for f in rest), pa.array(bits, pa.binary()), pa.array(node, pa.int64()), pa.array(n, pa.int32()), lists, pa.array(parity, pa.binary()), pa.array(list(sketch), pa.list_(pa.int64()))], [*(f.name for f in rest), "bits", "node", "n", "first", "parity", "sketch"])

    more = T.StructType.fromDDL("bits binary, node long, n int, first array<long>, parity binary, sketch array<long>").fields
    return bounded(docs).mapInArrow(run, T.StructType([*rest, *more]))


def samples(n: int, bits: int, agree: float = AGREE, recall: float = RECALL, seed: int = 1) -> np.ndarray:
    """(tables, bits of a key): the random bit positions that key each table, for n fingerprints."""
    size = max(0, int(np.ceil(np.log2(max(n, 1) / WIDE_BUCKET))))
    if not size:
        return np.zeros((1, 0), np.int64)
    number = int(np.ceil(np.log(1 - recall) / np.log(1 - agree**size)))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(bits, size, replace=False) for _ in range(number)])


def wide_groups(nodes: DataFrame, close: float = CLOSE, words: int = WORDS) -> DataFrame:
    """(node, class) of the nodes (node, bits) that candidate pairs join; a class's name is one of its nodes."""
    at = samples(nodes.count(), BITS * words)
    radius = int((1 - close) * BITS * words)

    def keys(batches):
        for batch in batches:
            n = batch.num_rows
            bits = np.unpackbits(np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint8).reshape(n, -1), axis=1, bitorder="little")
            key = np.stack([bits[:, p].astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)) for p in at], 1)
            ends = np.arange(n + 1, dtype=np.int32) * len(at)
            yield pa.record_batch([batch["fp"], batch["bits"], pa.ListArray.from_arrays(ends, pa.array(key.ravel()))], ["fp", "bits", "keys"])

    keyed = bounded(nodes.select(F.col("node").alias("fp"), "bits")).mapInArrow(keys, "fp long, bits binary, keys array<long>").select("fp", "bits", F.posexplode("keys").alias("table", "key"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        fp = cell["fp"].to_numpy()
        bits = np.frombuffer(b"".join(cell["bits"]), "<u8").reshape(len(cell), -1)
        first = (cell["own"] == cell["i"]).to_numpy()
        if cell["i"].iloc[0] == cell["j"].iloc[0]:
            a, b = forest(fp, None, radius, bits)
        else:
            a, b = forest(fp[first], fp[~first], radius, bits[first], bits[~first])
        return pd.DataFrame({"a": a, "b": b})

    found = components(_cells(keyed, PART // 2).applyInPandas(compare, "a long, b long")).toDF("node", "class")
    return durable(found.union(found.select("class", "class").distinct()))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted (node, one, ...) without one, with hashes: the shingle set, read again from the text of row one."""
    rest = [f for f in wanted.schema.fields if f.name != "one"]
    wanted = small(durable(wanted.select(*(f.name for f in rest), F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash"))))
    own = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))

    def hashed(batches):
        seen: set[int] = set()  # rows that repeat row one bring their set once a task
        for batch in batches:
            new = [k for k, node in enumerate(batch["node"].to_pylist()) if not (node in seen or seen.add(node))]
            batch = batch.take(pa.array(new, pa.int32()))
            sets = [shingles(t or "", width).astype("<u8").tobytes() for t in batch["text"].to_pylist()]
            yield pa.record_batch([*(batch[f.name] for f in rest), pa.array(sets, pa.binary())], [*(f.name for f in rest), "hashes"])

    return bounded(own.select(*(f.name for f in rest), "text")).mapInArrow(hashed, T.StructType([*rest, T.StructField("hashes", T.BinaryType())]))


def verified(nodes: DataFrame, near: DataFrame, docs: DataFrame, width: int, similarity: float, close: float = CLOSE, words: int = WORDS) -> DataFrame:
    """(a, b) links of that similarity between nodes of one class of near (node, class), in a forest for each cell.

    nodes: (node, bits, n, one).
    """
    radius = int((1 - close) * BITS * words)
    near = small(near).toDF("_node", "class")
    left = durable(nodes.select("node", "bits", "n", "one").join(near, F.col("node") == F.col("_node")).drop("_node"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("node").sort_values("node")
        node = cell["node"].to_numpy()
        bits = np.frombuffer(b"".join(cell["bits"]), "<u8").reshape(len(cell), -1)
        a, b = exact_forest(bits, [np.frombuffer(x, "<u8") for x in cell["hashes"]], None, radius, similarity)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    found, before = None, None
    while True:
        sizes = left.groupBy("class").agg(F.ceil(F.sum(F.col("n") * 8 + 1024) / F.lit(PART_BYTES)).cast("int").alias("cells"), F.count("*").alias("held"))
        sizes = durable(sizes.toDF("_class", "cells", "held"))
        dealt = left.join(small(sizes.select("_class", "cells")), F.col("class") == F.col("_class")).drop("_class")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("cells")).cast("int"))
        sets = sets_of(docs, dealt.select("node", "bits", "class", "part", "one"), width)
        links = durable(sets.groupBy("class", "part").applyInPandas(compare, "a long, b long"))
        found = links if found is None else found.union(links)
        more = sizes.where("cells > 1").agg(F.sum("held").alias("held")).first()["held"]
        if not more or more == before:
            return found
        before = more
        gone = small(links.select(F.col("a").alias("_a")))
        left = durable(left.join(small(sizes.where("cells > 1").select("_class")), F.col("class") == F.col("_class")).drop("_class").join(gone, F.col("node") == F.col("_a"), "left_anti"))


def rest(nodes: DataFrame, docs: DataFrame, linked: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): the links of that similarity between nodes (node, n, first, parity, sketch, one) that linked (node,
    component) doesn't join.

    Nodes that meet in a shingle are held against each other where they lie: a pair leaves the join only if sizes, places
    and sketches leave the similarity open. Shingles that the same nodes hold (those of a passage) make the same pairs, so
    only the first of them in the order of all shingles is joined: the first shingle that two nodes share is the first
    of its holders' for both.
    """
    classed = nodes.join(small(linked).toDF("_node", "component"), F.col("node") == F.col("_node"), "left").withColumn("class", F.coalesce("component", "node"))
    spread = classed.select("node", "n", "class", "sketch", F.posexplode("first").alias("at", "shingle"))
    # only shingles of several classes matter; few rows of numbers tell them, and who holds each
    holders = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(k) for k in ("s", "t")]
    several = spread.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), *holders).where("low < high")
    several = small(durable(several.select(F.col("shingle").alias("_shingle"), "s", "t")), 1_000_000)
    spread = spread.join(several, F.col("shingle") == F.col("_shingle"))
    spread = durable(spread.groupBy("node", "s", "t").agg(*(F.first(c).alias(c) for c in ("n", "class", "sketch")), F.min("at").alias("at")))
    a, b = (spread.select(*(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "class", "sketch", "at", "s", "t"))) for k in "ab")
    least = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-6  # shingles in common
    meet = (F.col("s_a") == F.col("s_b")) & (F.col("t_a") == F.col("t_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("class_a") != F.col("class_b"))
    apart = sum((F.bit_count(F.get("sketch_a", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
    open_ = (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least) & (apart <= F.col("n_a") + F.col("n_b") - 2 * least)
    pairs = durable(a.join(b, meet & open_).select("node_a", "node_b").distinct())

    def possible(batches):
        for batch in batches:
            most = (1 - similarity) / (1 + similarity) * (np.asarray(batch["n_a"]).astype(float) + np.asarray(batch["n_b"])) + 1e-6
            apart = np.array([differing(x, y) for x, y in zip(batch["p_a"].to_pylist(), batch["p_b"].to_pylist(), strict=True)])
            yield batch.select(["node_a", "node_b"]).filter(pa.array(apart <= most, pa.bool_()))

    for k in "ab":
        pairs = small(pairs).join(nodes.select(F.col("node").alias(f"node_{k}"), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"p_{k}")), f"node_{k}")
        pairs = durable(pairs) if k == "a" else pairs
    pairs = durable(bounded(pairs).mapInArrow(possible, "node_a long, node_b long"))
    wanted = pairs.select(F.col("node_a").alias("w")).union(pairs.select("node_b")).distinct()
    wanted = nodes.join(small(durable(wanted)), F.col("node") == F.col("w")).select("node", "one")
    sets = durable(sets_of(docs, wanted, width).dropDuplicates(["node"]))
    for k in "ab":
        pairs = pairs.join(sets.toDF(f"node_{k}", f"hashes_{k}"), f"node_{k}")

    def compare(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch["hashes_a"], batch["hashes_b"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                common = shared(x, y)
                near.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.record_batch([batch["node_a"], batch["node_b"]], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return durable(bounded(pairs).mapInArrow(compare, "a long, b long").distinct())


def classes(prints: DataFrame, id_col: str, radius: int = 3) -> DataFrame:
    """prints (id, fp) with component_id, the smallest id of a document reachable by links."""
    least = durable(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    return _named(prints, least, groups(least.select("fp"), radius))


def wide_classes(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, component_id) of docs (doc_id, text): the smallest doc_id reachable by links of that similarity.

    Texts are read again only for one document of each set in a class of candidates, found by id and text hash, so
    that copies bring one row.
    """
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    prints = durable(set_prints(texts, width, similarity))
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("one"), *(F.first(c).alias(c) for c in ("bits", "n", "first", "parity", "sketch")))
    nodes = durable(nodes)
    linked = components(verified(nodes, wide_groups(nodes.select("node", "bits")), texts, width, similarity))
    more = rest(nodes, texts, linked, width, similarity)
    if not more.isEmpty():
        linked = components(linked.toDF("a", "b").union(more))
    return _named(prints.select("doc_id", "text_hash", F.col("node").alias("fp")), nodes.select(F.col("node").alias("fp"), "least"), linked)


def _named(prints: DataFrame, least: DataFrame, linked: DataFrame) -> DataFrame:
    linked = linked.toDF("f", "component")
    named = least.join(linked, least["fp"] == linked["f"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = durable(named.join(names.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "component_id"))
    return prints.join(of, F.col("fp") == F.col("f")).drop("f")


def contract(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    prints = durable(fingerprints(docs.select("doc_id", "text"), "text", width))
    return classes(prints, "doc_id", radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near copies, that of the smallest doc_id; rows that repeat an id and text
    count as one.

    The rows that go are named by id and text hash, so rows that share an id, or have none, go or stay by their own
    text. A class without any id keeps all its texts, as does an id whose own texts are near copies; rows that repeat
    both, if there are any, are the only ones grouped with their texts.
    """
    of = durable(wide_classes(docs.select("doc_id", "text"), width, similarity).select("doc_id", "text_hash", "component_id"))
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    def those(rows: DataFrame, kind: str, some: DataFrame) -> DataFrame:
        return rows.join(some, docs["doc_id"].eqNullSafe(some["_id"]) & (own == some["_hash"]), kind)

    gone = of.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    out = those(docs, "left_anti", gone)
    again = of.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id", "_hash")
    if again.isEmpty():
        return out
    return those(out, "left_anti", again).unionByName(those(out, "left_semi", again).dropDuplicates(["doc_id", "text"]))
