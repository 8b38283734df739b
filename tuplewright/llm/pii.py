"""Personal data in text: fixed patterns, and a linear-chain CRF over word shapes that adds what they miss.

Kinds: email, ip, card, phone. The base spans follow the patterns of `base_spans` exactly. The CRF labels words
(maximal runs without white space) and is trained on the small table that `labelled` makes by rule. It reads
every word that holds a digit or an at sign (also spelled in brackets) with CONTEXT words on either side; any
other word is label O by constraint, so the rest of the text needs no lattice. Its spans are kept where they pass
the checks of `plausible` and don't touch a base span. Decoding is Viterbi in numpy batches. What the rule costs: personal
data spelled without any digit, at sign or bracketed at or dot, more than CONTEXT words from such a word, isn't looked for.

All scans are linear in the text, however long its words and digit runs are.

Cases: null text is empty text; empty text has no spans, and base_sha256 is the digest of the empty string;
repeated rows give equal results. Offsets are code points, ends exclusive.
"""

import functools
import hashlib
import re
from array import array
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded
from .crf import Chain, Index

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 3
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|AT|dot|DOT)[\])}]")
WORDS = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1  # no later run crosses an at sign
            at = text.find("@", last)


def _ips(text: str):
    """Runs of digit groups joined by single dots match in fours from the left, as a greedy leftmost pattern does."""
    for m in DOTTED.finditer(text):
        run = m[0]
        if run.count(".") < 3:
            continue
        groups, start = run.split("."), m.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, e, 0) for s, e in _emails(text)]
    if DIGIT.search(text):
        out += [(s, e, 1) for s, e in _ips(text)]
        for m in CARD.finditer(text):
            if 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out.append((*m.span(), 2))
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                out.append((*m.span(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def shape(word: str) -> str:
    """Letters to x or X, digits to 9, repeats collapsed; long words by their ends."""
    if len(word) > 40:
        word = word[:20] + word[-20:]
    out = []
    for c in word:
        s = "9" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)[:12]


_CUES = frozenset("tel telephone phone call fax mobile cell ring sms whatsapp mail email e-mail contact write ip host server address addr gateway ping card visa mastercard amex credit debit cc payment password token key order ref version date invoice id no nr isbn price total page".split())


def word_features(word: str) -> list[str]:
    bare = word.strip(".,;:!?()[]{}<>\"'#*$%&")
    digits = only_digits(bare)
    n = len(digits)
    low = bare.lower().rstrip(":")
    shaped = shape(bare)
    return [
        "s:" + shaped,
        "r:" + shape(word),
        f"n:{min(n, 20)}",
        "c:" + (low if low in _CUES else "at" if word.lower() in ("[at]", "(at)", "{at}", "@") else "dot" if word.lower() in ("[dot]", "(dot)", "{dot}") else "domain" if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z]{2,10})+", bare) else "-"),
        "d:" + str(bool(n) and n == len(bare)) + str("@" in word) + str("=" in word) + str(bare.count(".")) + str("/" in bare),
        "l:" + str(12 <= n <= 19 and luhn(digits)) + str("[.]" in word or "(.)" in word) + str("[at]" in word.lower() or "(at)" in word.lower()),
    ]


def features(words: list[str]) -> list[list[str]]:
    own = [word_features(w) for w in words]
    edge = ["s:^", "r:^", "n:^", "c:^", "d:^", "l:^"]
    out = []
    for k, f in enumerate(own):
        before, after = own[k - 1] if k else edge, own[k + 1] if k + 1 < len(own) else edge
        second = own[k - 2] if k > 1 else edge
        out.append([*f, "-" + before[0], "-" + before[3], "-" + before[2], "+" + after[0], "+" + after[3], "+" + after[2], "--" + second[3], "-+" + before[0] + f[0]])
    return out


def labelled(n: int = 360, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """A labelled table by rule: words and labels (0: O, 1 + 2 k: first word of kind k, 2 + 2 k: further words)."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    dig = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    name = lambda: "".join(pick(*"abcdefghiklmnoprstu") for _ in range(rng.integers(3, 9)))

    def card() -> str:
        body = pick("4", "51", "37", "6011") + dig(11)
        return next(body[:15] + str(k) for k in range(10) if luhn(body[:15] + str(k)))

    def cut(s: str, sep: str) -> str:
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    def positive() -> tuple[int, str]:
        kind = int(rng.integers(4))
        host = f"{name()}{pick('', dig(1))}.{pick('com', 'org', 'net', 'example.com', 'co.uk', 'de', 'fr', 'es')}"
        user = name() + pick("", "." + name(), "." + dig(2), "_" + dig(1))
        octet = lambda: str(rng.integers(256))
        if kind == 0:
            return 0, pick(f"{user}@{host}", f"{user} @ {host}", f"{user} [at] {host}", f"{user} (at) {host}", f"{user}[at]{host}", f"{user} [at] {name()} [dot] {pick('com', 'org', 'net')}", f"{user}(at){host}")
        if kind == 1:
            o = [octet() for _ in range(4)]
            return 1, pick(".".join(o), ".".join(o), "[.]".join(o), "(.)".join(o), " . ".join(o))
        if kind == 2:
            c = card()
            return 2, pick(c, cut(c, " "), cut(c, "-"), cut(c, "."), cut(c, "/"), cut(c, "_"))
        a, b, c = dig(3), dig(3), dig(4)
        return 3, pick(f"+1 ({a}) {b}-{c}", f"+{dig(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{dig(2)}/{b}{c}", f"00{dig(2)} {a} {b}{c}", f"({a}){b}-{c}", f"{a}/{b}-{c}")

    def negative() -> str:
        y, m, d = rng.integers(1900, 2100), rng.integers(1, 13), rng.integers(1, 29)
        return pick(
            f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{rng.integers(24)}:{rng.integers(60):02}", f"{dig(2)}.{dig(2)}", f"{dig(1)},{dig(3)}", f"{dig(1)},{dig(3)},{dig(3)}", str(rng.integers(10**6)),
            f"v{dig(1)}.{dig(1)}.{dig(1)}", f"version {dig(1)}.{dig(1)}.{dig(2)}", f"password={''.join(pick(*'0123456789abcdef') for _ in range(18))}", f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"',
            f"{dig(3)}.{dig(3)}.{dig(3)}.{pick('300', '999', '256')}", f"order {dig(8)}", f"no {dig(5)}", f"isbn 978-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}", f"page {dig(2)}-{dig(2)}", f"{dig(4)}-{dig(4)}", f"@{name()}", f"{dig(2)}%", f"${dig(3)}", f"{dig(1)} {name()} {dig(2)}",
            f"({y})", f"{y}", f"mail9.{name()}", f"{name()}.{dig(2)}", f"{name()}{dig(2)}", f"{dig(3)} {dig(3)} {dig(2)}", f"{dig(16)[:15]}x", f"{dig(20)}", f"[{dig(1)}]", f"({dig(1)})", f"{dig(10)}", f"{dig(7)}", f"id {dig(12)}", f"{dig(3)}-{dig(3)}",
        )

    def plain(k: int) -> list[str]:
        return [pick(name(), name(), name().capitalize(), name() + pick(",", ".", ";", "###", "***", "%%%", "$$$", "&&&"), pick("the", "of", "at", "in", "und", "la", "de")) for _ in range(k)]

    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(int(rng.integers(1, 4))):
            w = plain(int(rng.integers(1, 4)))
            words += w
            tags += [0] * len(w)
            if rng.random() < 0.55:
                kind, s = positive()
                if rng.random() < 0.35:
                    cue = pick(*(("email:", "mail", "contact"), ("ip", "host", "server"), ("card", "visa:", "cc"), ("tel:", "phone", "call", "Tel."))[kind])
                    words.append(cue)
                    tags.append(0)
                w = (pick("", "", "", "(", "<") + s + pick("", "", "", ".", ",", ";", ")", "###", "***", "%%%")).split()
                tags += [1 + 2 * kind, *[2 + 2 * kind] * (len(w) - 1)]
            else:
                w = (negative() + pick("", "", ".", ",", "###", "&&&")).split()
                tags += [0] * len(w)
            words += w
        w = plain(int(rng.integers(1, 3)))
        out.append((words + w, tags + [0] * len(w)))
    return out


#: Words that are tagged at once; a longer window is tagged in blocks of so many.
TAGGED = 16_384


class Tagger:
    def __init__(self, table: list[tuple[list[str], list[int]]], steps: int = 100):
        self.index = Index()
        rows = [self.index.rows(features(w)) for w, _ in table]
        self.index.open = False
        self.chain = Chain(len(self.index.of), 1 + 2 * len(KINDS)).fit(rows, [np.array(t) for _, t in table], steps=steps)

    def tag(self, windows: list[list[str]]) -> list[np.ndarray]:
        return self.chain.decode([self.index.rows(features(w)) for w in windows])

    def tag_long(self, text: str, spans: array) -> np.ndarray:
        """The labels of one window of any length; holds the words of one block, and a few bytes a word."""
        n = len(spans) // 2

        def blocks():
            for k in range(0, n, TAGGED):
                low, stop = max(0, k - 2), min(n, k + TAGGED)
                words = [text[spans[2 * i] : spans[2 * i + 1]] for i in range(low, min(n, stop + 1))]
                yield self.index.rows(features(words)[k - low : stop - low])

        return self.chain.decode_blocks(blocks(), n)


@functools.lru_cache
def trained(n: int = 600, seed: int = 5) -> Tagger:
    return Tagger(labelled(n, seed))


def windows(text: str):
    """Starts and ends, in turn, of the words around triggers, CONTEXT either side; overlapping windows are one."""
    last = -1
    m = TRIGGER.search(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        left = []
        at = start
        for _ in range(CONTEXT):
            end = at
            while end > 0 and text[end - 1].isspace():
                end -= 1
            begin = end
            while begin > 0 and not text[begin - 1].isspace():
                begin -= 1
            if begin == end or begin < last:
                break
            left.append((begin, end))
            at = begin
        own = array("q", chain.from_iterable(left[::-1]))
        quiet = 0
        for w in WORDS.finditer(text, start):
            own.extend(w.span())
            quiet = 0 if TRIGGER.search(text, *w.span()) else quiet + 1
            if quiet == 2 * CONTEXT:  # the next window's words before its trigger are then its own
                break
        del own[len(own) - 2 * max(0, quiet - CONTEXT) :]
        last = own[-1]
        m = TRIGGER.search(text, last)
        yield own


_STRIP = "([{<\"'", ".,;:!?)]}>\"'#*$%&"


def plausible(kind: int, s: str) -> bool:
    d = only_digits(s)
    if kind == 0:
        s = " ".join(s.split())
        plain = re.sub(r"\s*(?:\[at\]|\(at\)|\{at\}|@)\s*", "@", s, flags=re.I)
        plain = re.sub(r"\s*(?:\[dot\]|\(dot\)|\{dot\})\s*", ".", plain, flags=re.I)
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain) is not None
    if kind == 1:
        parts = re.split(r" ?(?:\[\.\]|\(\.\)|\.) ?", " ".join(s.split()))
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return re.fullmatch(r"[0-9][0-9 ._/-]+[0-9]", s) is not None and 12 <= len(d) <= 19 and luhn(d)
    return re.fullmatch(r"\+?[(0-9][0-9 ()./-]+[0-9]", s) is not None and 9 <= len(d) <= 15 and len(d) < len(s)


def reach(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The starts of base spans, in order, and how far the spans up to each reach."""
    return [b[0] for b in base], list(accumulate((b[1] for b in base), max))


def added_spans(text: str, base: tuple[list[int], list[int]], spans: array, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """The plausible spans that tags say, where they touch no base span (as `reach` has them)."""
    out, n, stop = [], len(tags), 0
    starts, ends = base
    for k in np.flatnonzero(tags).tolist():
        if k < stop:
            continue
        kind = (int(tags[k]) - 1) // 2
        stop = k + 1
        while stop < n and tags[stop] == 2 + 2 * kind:
            stop += 1
        s, e = spans[2 * k], spans[2 * stop - 1]
        while s < e and text[s] in _STRIP[0] and not (kind == 3 and text[s] == "("):
            s += 1
        while e > s and text[e - 1] in _STRIP[1]:
            e -= 1
        before = bisect_left(starts, e)  # base spans that begin before the end
        if plausible(kind, text[s:e]) and (not before or ends[before - 1] <= s):
            out.append((s, e, kind))
    return out


def find(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; windows of about TAGGED words go through Viterbi together."""
    base = [base_spans(t) for t in texts]
    held_by = [reach(b) for b in base]
    added: list[list] = [[] for _ in texts]
    jobs: list[tuple[int, array]] = []

    def finish() -> None:
        tags = tagger.tag([[texts[k][w[i] : w[i + 1]] for i in range(0, len(w), 2)] for k, w in jobs])
        for (k, w), t in zip(jobs, tags, strict=True):
            added[k] += added_spans(texts[k], held_by[k], w, t)
        jobs.clear()

    held = 0
    for k, text in enumerate(texts):
        for w in windows(text):
            if len(w) > 2 * TAGGED:
                added[k] += added_spans(text, held_by[k], w, tagger.tag_long(text, w))
                continue
            jobs.append((k, w))
            held += len(w) // 2
            if held >= TAGGED:
                finish()
                held = 0
    finish()
    return list(zip(base, added, strict=True))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def detect(df: DataFrame, text: str = "text", mask: bool = False) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256, spans (all); with mask, text masked."""
    new = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"]
    df = df.drop(*new)
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch[text].to_pylist()]
            found = find(texts, shared.value)
            every = [sorted(b + a, key=lambda s: (s[0], s[2])) for b, a in found]
            cols = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in range(4)]
            cols += [pa.array([len(a) for _, a in found], pa.int64())]
            cols += [pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([written(s) for s in every], pa.string())]
            old = list(batch.columns)
            if mask:
                at = batch.schema.get_field_index(text)
                old[at] = pa.array([None if v is None else masked(v, s) for v, s in zip(batch[text].to_pylist(), every, strict=True)], pa.string())
            yield pa.record_batch([*old, *cols], [*batch.schema.names, *new])

    kinds = [T.LongType()] * 5 + [T.StringType()] * 2
    return bounded(df).mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))]))


def contract(docs: DataFrame) -> DataFrame:
    return detect(docs.select("doc_id", "text")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
