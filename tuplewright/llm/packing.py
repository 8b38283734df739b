"""Hierarchical packing of tokenised documents into windows of several lengths.

Tiers are powers of two up to the longest window. A document's whole longest windows are sequences of their own.
What remains is routed to the smallest tier that holds it. Each tier is packed from the longest down: a remainder
opens a window, its gap is filled with the largest remainders of shorter tiers that fit, and what is still open is
filled by cutting a shorter remainder to size. A window that nothing is left to fill is split at powers of two, so
every sequence's length is a power of two and none is padded.

Sequences of a tier are dealt to step groups of STEP tokens in the order they close, so that the groups of a task
hold equal numbers of tokens (but for the last of each tier).

Packing is local: a task packs the documents of its own partition, POOL remainders at a time. Nothing is shuffled,
a retried task gives the same sequences, and a task's memory is bounded by POOL remainders and one document.
Sequence and group ids hold the partition's number in their upper bits.

Token ids are those of the byte-level BPE file, special tokens off, found with tiktoken over the same ranks; texts
that hold a special token's string go through the tokenizers library itself.

Cases: null text is empty text, which is the end id alone; repeated rows are packed each; an empty table gives an
empty result.
"""

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import bounded

LONGEST = 1024
TIERS = (1024, 512, 256, 128)
END = 0
POOL = 4096
STEP = 32 * 1024


class Encoder:
    """Ids of texts. ranks: tiktoken's file; plain: the tokenizers file that the ids are defined by."""

    def __init__(self, plain: str | None = None, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.plain = plain or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if "<|endoftext|>" not in text:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.plain)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Packs remainders (document, start, length); closed sequences go to out as (tier, pieces)."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers, reverse=True)
        self.out: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.left: dict[int, list] = {}  # by length, the remainders that are left

    def add(self, doc: int, length: int) -> None:
        top = self.tiers[0]
        whole = length // top * top
        for start in range(0, whole, top):
            self.out.append((top, [(doc, start, top)]))
        if length > whole:
            self.left.setdefault(length - whole, []).append((doc, whole, length - whole))

    def _take(self, most: int, lengths: list[int]) -> tuple | None:
        """The largest remainder of at most most, from the sorted lengths."""
        k = bisect_right(lengths, most)
        if not k:
            return None
        n = lengths[k - 1]
        piece = self.left[n].pop()
        if not self.left[n]:
            del self.left[n]
            del lengths[k - 1]
        return piece

    def flush(self) -> None:
        lengths = sorted(self.left)
        for tier, below in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            while lengths and lengths[-1] > below:
                pieces = [self._take(tier, lengths)]
                gap = tier - pieces[0][2]
                while gap and (p := self._take(gap, lengths)):
                    pieces.append(p)
                    gap -= p[2]
                if gap and lengths:  # every remainder is longer than the gap: cut the shortest
                    doc, start, n = self._take(lengths[0], lengths)
                    pieces.append((doc, start, gap))
                    if n - gap not in self.left:
                        insort(lengths, n - gap)
                    self.left.setdefault(n - gap, []).append((doc, start + gap, n - gap))
                    gap = 0
                self._close(tier, pieces, gap)

    def _close(self, tier: int, pieces: list, gap: int) -> None:
        if not gap:
            self.out.append((tier, pieces))
            return
        total = tier - gap
        pieces = pieces[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            own, room = [], size
            while room:
                doc, start, n = pieces.pop()
                if n > room:
                    pieces.append((doc, start + room, n - room))
                    n = room
                own.append((doc, start, n))
                room -= n
            self.out.append((size, own))
            total -= size


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_ids: bool = True, tiers=TIERS, plain: str | None = None, ranks: str | None = None, step: int = STEP) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, and its ids if keep_ids."""
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    fields += [T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        encode, packer = Encoder(plain, ranks), Packer(tiers)
        first = TaskContext.get().partitionId() << 32
        names: dict[int, object] = {}
        held: dict[int, tuple[int, dict]] = {}  # of a document with pieces to come: its length and their tokens
        counts = {"sequence": 0, "group": 0}
        room: dict[int, list[int]] = {}  # tier: its open group and the tokens it can take

        def closed():
            rows: list[tuple] = []
            bits: list = []
            for tier, pieces in packer.out:
                group = room.get(tier)
                if group is None or group[1] < tier:
                    group = room[tier] = [counts["group"], max(step, tier)]
                    counts["group"] += 1
                group[1] -= tier
                offset = 0
                for doc, start, n in pieces:
                    size, ids = held[doc]
                    own = ids[start : start + n]
                    rows.append((doc, start, n, zlib.crc32(own.astype("<u4").tobytes()), size, first + counts["sequence"], offset, tier, first + group[0]))
                    if keep_ids:
                        bits.append(own.astype(np.int32))
                    offset += n
                counts["sequence"] += 1
            packer.out = []
            if not rows:
                return None
            cols = [pa.array([names[r[0]] for r in rows], arrow_id)]
            cols += [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7)] + [pa.array([r[7] for r in rows], pa.int32()), pa.array([r[8] for r in rows], pa.int64())]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, bits)]).astype(np.int32), pa.array(np.concatenate(bits))))
            return pa.record_batch(cols, [f.name for f in fields])

        doc, pooled, waiting = 0, 0, 0
        arrow_id = None
        for batch in batches:
            arrow_id = batch.schema.field(id_col).type
            for key, value in zip(batch[id_col].to_pylist(), batch[text].to_pylist(), strict=True):
                ids = np.append(encode(value or ""), np.uint32(END))
                names[doc], held[doc] = key, (len(ids), ids)
                packer.add(doc, len(ids))
                doc, pooled, waiting = doc + 1, pooled + 1, waiting + len(ids)
                if pooled >= POOL or waiting >= POOL * LONGEST:
                    packer.flush()
                    if (out := closed()) is not None:
                        yield out
                    names, held, pooled, waiting = {}, {}, 0, 0
        packer.flush()
        if (out := closed()) is not None:
            yield out

    return bounded(docs.select(id_col, text)).mapInArrow(run, T.StructType(fields))


def contract(docs: DataFrame) -> DataFrame:
    return pack(docs, keep_ids=False)
