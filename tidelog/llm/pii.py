"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) give the base spans. The field tags every word of every line by shape
features of it and its two neighbours (digits, letters, signs, length), is trained on the driver from a small
labelled table made here, and adds spans that the patterns miss (a number written like a card or a phone, a
national number, an address with a spelled-out sign). It is decoded by Viterbi in numpy over all words of a batch:
words whose best tag is "none" by more than any transition could make up for are fixed, and only the runs between
them go through the recursion. That is the same path as without the shortcut.

Cases: a null or empty text has no spans; repeated rows are alike; words and texts of any length are taken whole; ids of
any type come back as they are, null ones too; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import lean_batches

# The base patterns, in the order of the kinds.
KINDS = ("email", "ip", "card", "phone", "number")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, from one @ to the next: linear in any text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# --- shapes -----------------------------------------------------------------------------------------------------

# Fields of a character's packed counts, nine bits each: digits, letters, capitals, @, full stops, hyphens, + and brackets.
_BITS, _LONG = 9, 400
_FIELDS = 7
#: Values of each feature of a shape: digits, letters, @, full stops, hyphens, + or brackets, length.
SIZES = (11, 4, 2, 4, 4, 2, 4)
SHAPES = int(np.prod(SIZES))


def _char_table() -> np.ndarray:
    out = np.zeros(129, np.int64)
    for c in range(128):
        ch = chr(c)
        fields = (ch.isdigit(), ch.isalpha(), ch.isupper(), ch == "@", ch == ".", ch == "-", ch in "+()")
        out[c] = sum(int(f) << (_BITS * i) for i, f in enumerate(fields))
    out[128] = 1 << _BITS  # anything else counts as a letter
    return out


_CHARS = _char_table()
_SPACE = np.zeros(129, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGITS = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 7, 10, 13, 16, 20], np.arange(1 << _BITS), side="right"), SIZES[0] - 1)


def tokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and shapes of the words of a text given as code points."""
    small = np.minimum(codes, 128).astype(np.uint8)
    word = ~_SPACE[small]
    edge = np.flatnonzero(np.diff(np.r_[np.int8(0), word.view(np.int8), np.int8(0)]))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, starts
    length = ends - starts
    chars = _CHARS[small]
    packed = np.add.reduceat(chars, starts)
    for i in np.flatnonzero(length > _LONG):  # counts may run over: saturated one by one
        own = chars[starts[i] : ends[i]]
        sums = [int(((own >> (_BITS * f)) & 1).sum()) for f in range(_FIELDS)]
        if sums[2] < sums[1]:
            sums[2] = min(sums[2], _LONG - 1)  # not all letters are capitals
        packed[i] = sum(min(n, _LONG) << (_BITS * f) for f, n in enumerate(sums))
    field = lambda i: (packed >> (_BITS * i)) & ((1 << _BITS) - 1)
    letters, capitals = field(1), field(2)
    values = (
        _DIGITS[field(0)], np.where(letters == 0, 0, np.where(capitals == 0, 1, np.where(capitals == letters, 3, 2))), np.minimum(field(3), 1),
        np.minimum(field(4), 3), np.minimum(field(5), 3), np.minimum(field(6), 1), np.searchsorted([3, 8, 14], length, side="right"))
    return starts, ends, np.ravel_multi_index(values, SIZES)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


# --- the labelled table -----------------------------------------------------------------------------------------

# Parts of the labelled sentences. A word before a colon names its tag; # stands for a random digit.
FILLER = "the of and then order total from page see at in by was item chapter line der die und la el le que Room Monday Paris OK A".split()
PLAIN = "12 7 2024 1999 3.14 100% 15,000 $20 12:30 v2.1 1.2.3 2024-05-17 #42 (3) 9th B52 3-4 50-60 ### *** && p.17 10/12 1,234.56 ISBN 0.5 x86 H2O U.S. e.g. well-known (see) a.m. 4a8fd03e 24be64439e3e49cf46b2d7c90f3602a3d0b907ff 5f2a9c http://a.example/en/12 #### #####".split()
PII = (
    "email:aa.##@mail#.example.com", "email:jo_#@site.org", "email:x@y.net", "email:aaa@aaaa.example.co",
    "ip:1##.##.#.1##", "ip:10.0.#.#", "ip:##.1##.##.#",
    "card:####-####-####-####", "card:################", "card:#### card:#### card:#### card:####", "card:###############", "card:#### card:###### card:#####",
    "phone:+1 phone:(###) phone:###-####", "phone:+## phone:## phone:#### phone:####", "phone:(###) phone:###-####", "phone:###-###-####", "phone:+1###.###.####", "phone:+#-###-###-####",
    "number:###-##-####", "number:##-#######",
)
LABELLED = 900


def labelled(seed: int = 11) -> list[list[tuple[str, int]]]:
    """The labelled table: LABELLED sentences of (word, tag), tag 0 for none, else 1 + the kind's place."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]

    def some(n: int) -> list[tuple[str, int]]:
        out = []
        for _ in range(n):
            w = pick(FILLER) if rng.random() < 0.75 else "".join(str(rng.integers(10)) if c == "#" and rng.random() < 0.5 else c for c in pick(PLAIN))
            out.append((w + (pick([".", ",", ";"]) if rng.random() < 0.15 else ""), 0))
        return out

    rows = []
    for i in range(LABELLED):
        row = some(int(rng.integers(0 if i % 3 else 1, 8)))
        if i % 3:
            for part in PII[i % len(PII)].split():
                kind, word = part.split(":", 1)
                row.append(("".join(str(rng.integers(10)) if c == "#" else chr(97 + rng.integers(26)) if c == "a" and kind == "email" else c for c in word), 1 + KINDS.index(kind)))
            if rng.random() < 0.2:
                row[-1] = (row[-1][0] + pick([".", ","]), row[-1][1])
            row += some(int(rng.integers(0, 6)))
        rows.append(row)
    return rows


# --- the field --------------------------------------------------------------------------------------------------

TAGS = 1 + len(KINDS)
_OFFSETS = np.r_[0, np.cumsum(SIZES)]
_WIDTH = int(_OFFSETS[-1])
#: Stands for "no neighbour" (the ends of a line).
EDGE = SHAPES


def _features(shapes: np.ndarray) -> np.ndarray:
    """One-hot features of shapes; EDGE has one of its own."""
    out = np.zeros((len(shapes), _WIDTH + 1))
    inner = shapes < SHAPES
    for i, v in enumerate(np.unravel_index(np.where(inner, shapes, 0), SIZES)):
        out[np.flatnonzero(inner), _OFFSETS[i] + v[inner]] = 1
    out[~inner, _WIDTH] = 1
    return out


@lru_cache(1)
def train(steps: int = 160, rate: float = 0.1, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """(emission scores of [place, shape, tag], transition scores), by gradient ascent on the labelled table.

    place: 0 the word's own shape, 1 the one before, 2 the one after.
    """
    rows = labelled()
    n, t = len(rows), max(map(len, rows))
    shape, tag, mask = np.full((n, t + 2), EDGE), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, row in enumerate(rows):
        text = " ".join(w for w, _ in row)
        shape[i, 1 : len(row) + 1] = tokens(codes_of(text))[2]
        tag[i, : len(row)], mask[i, : len(row)] = [x for _, x in row], True
    feats = np.concatenate([_features(shape[:, 1:-1].ravel()), _features(shape[:, :-2].ravel()), _features(shape[:, 2:].ravel())], axis=1).reshape(n, t, -1)
    w, a = np.zeros((feats.shape[2], TAGS)), np.zeros((TAGS, TAGS))
    gold, last = np.eye(TAGS)[tag] * mask[:, :, None], mask.sum(axis=1) - 1
    gold_a = sum(gold[:, i - 1, :].T @ gold[:, i, :] for i in range(1, t))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, a)]
    for step in range(1, steps + 1):
        e = feats @ w
        alpha, beta, keep = np.zeros((n, t, TAGS)), np.zeros((n, t, TAGS)), mask[:, :, None]
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(keep[:, i], e[:, i] + np.logaddexp.reduce(alpha[:, i - 1, :, None] + a, axis=1), alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(keep[:, i + 1], np.logaddexp.reduce(a[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[np.arange(n), last], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * keep
        pairs = sum((np.exp(alpha[:, i - 1, :, None] + a + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None]) * keep[:, i, :, None]).sum(axis=0) for i in range(1, t))
        slopes = [np.einsum("ntf,ntk->fk", feats, gold - p) / n - decay * w, (gold_a - pairs) / n - decay * a]
        for x, slope, m in zip((w, a), slopes, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * slope
            m[1] = 0.99 * m[1] + 0.01 * slope**2
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    every = _features(np.arange(SHAPES + 1))
    return np.stack([every @ part for part in np.split(w, 3)]).astype(np.float32), a.astype(np.float32)


def viterbi(scores: np.ndarray, a: np.ndarray, first: np.ndarray, count: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Best tags of runs of words: run r has words first[r] to first[r] + count[r] - 1.

    before and after tell which runs have a word tagged "none" at that side; the others end a line there.
    """
    best = np.zeros(len(scores), np.int8)
    order = np.argsort(-count, kind="stable")
    for at in range(0, len(order), 4096):
        runs = order[at : at + 4096]
        f, c = first[runs], count[runs]
        value = scores[f] + np.where(before[runs, None], a[0], 0)
        back = []
        for i in range(1, int(c[0])):
            live = int(np.searchsorted(-c, -i, side="left"))  # runs longer than i
            step = value[:live, :, None] + a
            back.append(step.argmax(axis=1).astype(np.int8))
            value[:live] = step.max(axis=1) + scores[f[:live] + i]
        tag = (value + np.where(after[runs, None], a[:, 0], 0)).argmax(axis=1)
        best[f + c - 1] = tag
        for i in range(int(c[0]) - 1, 0, -1):
            live = len(back[i - 1])
            tag[:live] = back[i - 1][np.arange(live), tag[:live]]
            best[f[:live] + i - 1] = tag[:live]
    return best


def decode(shapes: np.ndarray, new_line: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tags of words in a row; new_line marks those that begin a sequence."""
    e, a = model
    n = len(shapes)
    if not n:
        return np.zeros(0, np.int8)
    ends = np.r_[new_line[1:], True]
    prev, nxt = np.where(new_line, EDGE, np.r_[EDGE, shapes[:-1]]), np.where(ends, EDGE, np.r_[shapes[1:], EDGE])
    sure = 2 * float(a.max() - a.min())
    margin = e[:, :, 0] - e[:, :, 1:].max(axis=2)  # a lower bound, by place, that needs no sum over tags
    free = np.flatnonzero(margin[0][shapes] + margin[1][prev] + margin[2][nxt] <= sure)
    out = np.zeros(n, np.int8)
    if not len(free):
        return out
    scores = e[0][shapes[free]] + e[1][prev[free]] + e[2][nxt[free]]
    head = np.r_[True, (np.diff(free) > 1)] | new_line[free]
    first = np.flatnonzero(head)
    count = np.diff(np.r_[first, len(free)])
    last = first + count - 1
    out[free] = viterbi(scores, a, first, count, ~ends[free[last]], ~new_line[free[first]])
    return out


_TRIM = ".,;:!?\"'*#%&$"


def added_spans(texts: list[str], model) -> list[list[Span]]:
    """What the field finds in each text: runs of one tag, without the punctuation around them."""
    joined = "\n".join(texts)
    codes = codes_of(joined)
    starts, ends, shapes = tokens(codes)
    lines = np.flatnonzero(codes == 10)
    line = np.searchsorted(lines, starts)
    new_line = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
    tags = decode(shapes, new_line, model)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    out: list[list[Span]] = [[] for _ in texts]
    hit = np.flatnonzero(tags)
    if not len(hit):
        return out
    head = np.r_[True, (np.diff(hit) > 1) | (tags[hit[1:]] != tags[hit[:-1]])] | new_line[hit]
    at = np.flatnonzero(head)
    for i, j in zip(hit[at], hit[np.r_[at[1:] - 1, len(hit) - 1]], strict=True):
        s, e = int(starts[i]), int(ends[j])
        while s < e and joined[s] in _TRIM:
            s += 1
        while e > s and joined[e - 1] in _TRIM:
            e -= 1
        if s < e:
            doc = int(np.searchsorted(begin, s, side="right")) - 1
            out[doc].append((s - int(begin[doc]), int(tags[i]) - 1, e - int(begin[doc])))
    return out


def clear_of(added: list[Span], base: list[Span], text: str) -> list[Span]:
    """What of the added spans no base span covers: the words between, if they hold a digit or an @."""
    out = []
    for start, kind, end in added:
        at = start
        for s, _, e in [*(b for b in base if b[0] < end and b[2] > start), (end, 0, end)]:
            piece = text[at:s]
            lo = at + len(piece) - len(piece.lstrip(f"{_TRIM} \t\r"))
            hi = at + len(piece.rstrip(f"{_TRIM} \t\r"))
            if lo < hi and s > at and (DIGIT.search(piece) or "@" in piece):
                out.append((lo, kind, hi))
            at = max(at, e)
    return out


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

#: Characters whose words are tagged at once.
BATCH_CHARS = 1_500_000


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and added: arrays of (start, kind, end) for each row; code points, end exclusive."""
    lean_batches(df.sparkSession)
    model = train()  # a few hundred kilobytes

    def scan(batches):
        for batch in batches:
            lengths = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to, chars = at, 0
                while to < batch.num_rows and (to == at or chars + lengths[to] <= BATCH_CHARS):
                    chars += lengths[to]
                    to += 1
                texts = batch.column("text").slice(at, to - at).to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, model)
                more = [clear_of(m, own, t) if m and own else m for m, own, t in zip(more, base, texts, strict=True)]
                as_rows = lambda spans: pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in own] for own in spans], SPANS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(at, to - at), as_rows(base), as_rows(more), pa.array([_shown(b) for b in base], pa.string()),
                     pa.array([_shown(sorted(b + m)) if m else _shown(b) for b, m in zip(base, more, strict=True)], pa.string())],
                    ["_id", "base", "added", "base_text", "all_text"])
                at = to

    kind, spans = df.schema[id_col].dataType.simpleString(), "array<struct<start:int,kind:string,end:int>>"
    rows = df.select(df[id_col].alias("_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(scan, f"_id {kind}, base {spans}, added {spans}, base_text string, all_text string").withColumnRenamed("_id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *(count(k) for k in KINDS[:4]), F.sha2("base_text", 256).alias("base_sha256"), F.col("all_text").alias("spans"), F.size("added").cast("long").alias("n_added"))


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(_shown(spans).encode()).hexdigest()
