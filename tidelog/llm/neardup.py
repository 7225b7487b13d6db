"""Near-duplicate documents: MinHash bands for candidates, signatures and full sets to verify, components.

1. Each text becomes its set of word shingles; equal word sequences are one class, of which one row goes on.
2. A class has 112 universal hash minima in 28 bands of 4; two sets of similarity 0.8 miss all bands with a
   probability of 4e-7.
3. In each bucket every member is paired with the least one: as many pairs as members. Pairs whose
   signatures agree enough are confirmed on the full sets, and confirmed links joined into components.
4. Buckets whose members lie in several components may still hide links. Their members are compared in blocks, each
   with the hashes of its full set; what links two components there is confirmed on the texts as well. A block
   gives no more links than it has members, yet no candidate pair between components goes untested.

Cases: a null text or one without words has an empty set, is linked with nothing and is its own class; ids of any
type come back as they are; a null id never stands for a group that has another; repeated rows are one class; rows that
share an id but not the text count as different nodes; texts of any length are taken whole; an empty table gives an empty
table; further columns are ignored, in ``deduplicate`` they stay, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, free_name
from tidelog.llm.graph import components

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Signatures of sets of similarity 0.8 agree in fewer places than this once in a million pairs.
AGREE = 0.62
#: Members of a bucket compared at once, and their hashes.
BLOCK, BLOCK_HASHES = 512, 400_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A_COLUMN, _B_COLUMN = _A[:, None].copy(), _B[:, None].copy()


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case: bytes know ASCII letters and white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The distinct k-word shingles; with fewer words the whole sequence as one; without words none."""
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k)), strict=False))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def _shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out += h[i : len(out) + i] * _MIX[i]
    return _mixed(out)


#: Words hashed together.
WORDS_AT_ONCE = 1 << 16


def _sets(texts: list[list[bytes]], k: int, known: dict):
    total = sum(map(len, texts))
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, total)
    # over all texts at once: what begins in one and ends in the next is passed over
    windows, at = _shingle_hashes(h, k), 0
    for w in texts:
        yield w, _distinct(windows[at : at + len(w) - k + 1] if len(w) >= k else _shingle_hashes(h[at : at + len(w)], len(w)) if w else windows[:0])
        at += len(w)


def shingle_sets(texts, k: int, known: dict):
    """(words, distinct 64-bit hashes of the shingles) of each text, in their order."""
    some, size = [], 0
    for text in texts:
        some.append(words(text))
        size += len(some[-1])
        if size >= WORDS_AT_ONCE:
            yield from _sets(some, k, known)
            some, size = [], 0
    yield from _sets(some, k, known)


_SPACES = b" \t\n\v\f\r"
_IS_SPACE = bytes(b in _SPACES for b in range(256))
_ONE_SPACE = bytes(32 if b in _SPACES else b for b in range(256))
#: Bytes of a word that are hashed eight at a time, over all words at once; longer words are hashed by themselves.
WIDE_WORD = 64
#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _word_hashes(data: bytes, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``data``, by their bytes and sizes."""
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=data + bytes(8), strides=(1,))
    h = _mixed((eight[begins] & _FIRST[np.minimum(sizes, 8)]) * _MIX[16] + sizes.astype(np.uint64) * _MIX[17])
    for at in range(8, WIDE_WORD, 8):
        more = np.flatnonzero(sizes > at)
        if not len(more):
            break
        h[more] = _mixed((h[more] + (eight[begins[more] + at] & _FIRST[np.minimum(sizes[more] - at, 8)])) * _MIX[18])
    for i in np.flatnonzero(sizes > WIDE_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begins[i] : begins[i] + sizes[i]])
    return h


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Hashes of the words of all texts, the place where each text's begin (and the end), and a digest of each text's words,
    null where there are none. The same words as ``words`` gives, found in the bytes of all texts together."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]]).lower()
    at = at - at[0]
    space = np.frombuffer(data.translate(_IS_SPACE), bool)
    word = ~space
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    # a word ends where its text does
    begin, end, kept = word.copy(), word.copy(), word.copy()
    begin[1:] &= space[:-1]
    begin[first] = word[first]
    end[:-1] &= space[1:]
    end[last] = word[last]
    begins = np.flatnonzero(begin)
    sizes = np.flatnonzero(end) + 1 - begins
    places = np.searchsorted(begins, at)
    # words with one space after each: all digested from one buffer
    kept[1:] |= word[:-1]
    kept[first] = word[first]
    plain = np.frombuffer(data.translate(_ONE_SPACE), np.uint8)[kept].tobytes()
    spaced = np.zeros(len(texts), np.int64)
    spaced[at[:-1] < at[1:]] = word[last]
    cuts = (np.concatenate([[0], np.cumsum(sizes)])[places] + places - np.concatenate([[0], np.cumsum(spaced)])).tolist()
    digests = [xxhash.xxh3_128_digest(memoryview(plain)[a : b - (not whole)]) if a < b else None for a, b, whole in zip(cuts, cuts[1:], spaced.tolist(), strict=False)]
    return _word_hashes(data, begins, sizes), places, digests


def minima(x: np.ndarray) -> np.ndarray:
    """The least values of the universal hashes a x + b of the upper halves of ``x``."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1024):
        y = x[at : at + 1024] * _A_COLUMN
        y += _B_COLUMN
        np.minimum(out, y.min(axis=1), out=out)
    return out


def _bands(sigs: np.ndarray) -> np.ndarray:
    """The band hashes of each row of signatures."""
    wide = sigs.astype(np.uint64).reshape(-1, BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(wide), 1))
    for j in range(ROWS):
        out = _mixed(out * _MIX[j + 8] + wide[:, :, j])
    return out.view(np.int64)


#: Texts whose sets are in memory at once in a Python worker.
ROWS_AT_ONCE = 1024


def _pieces(batches):
    """Arrow batches in pieces of few rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _signed(k: int):
    def sign(batches):
        for batch in _pieces(batches):
            h, places, same = hashed_words(batch.column("text"))
            windows, cuts = _shingle_hashes(h, k), places.tolist()
            sizes, sigs = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                # windows that begin in one text and end in the next are passed over
                x = _distinct(windows[a : b - k + 1] if b - a >= k else _shingle_hashes(h[a:b], b - a)) if a < b else h[:0]
                sizes.append(len(x))
                if a < b:
                    sigs.append(minima(x))
            sigs = np.array(sigs, np.uint32).reshape(-1, HASHES)
            rows, bands = iter(sigs), pa.array(_bands(sigs).ravel())
            some = np.diff(places) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]) * BANDS, pa.int32(), mask=np.append(~some, False)), bands)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.diff(places), pa.int64()), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array([next(rows).tobytes() if n else None for n in sizes], pa.binary()), lists],
                [*(c for c in batch.schema.names if c != "text"), "words", "n", "same", "sig", "bands"])

    return sign


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), HASHES) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) >= AGREE)


def _confirm(k: int, percent: int):
    def confirm(batches):
        last, mine = None, set()
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["ta"], pdf["tb"], strict=True):
                if a != last:
                    last, mine = a, shingles(a, k)
                other = shingles(b, k)
                both = len(mine & other)
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pdf.loc[keep, ["u", "v"]]

    return confirm


def _agreeing(pairs: DataFrame, sigs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures allow a link."""
    side = lambda c: sigs.select(F.col("_row").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    pairs = pairs.join(side("u"), "u").join(side("v"), "v").filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    return scratch.save(pairs.filter(F.pandas_udf(_alike, "boolean")("su", "sv")).select("u", "v"), narrow=True)


#: Bits of a sketch of keys, in bitmaps of 32768: 8 MB at most, whatever the input.
SKETCH_BITS = 1 << 26


def _sketch(rows: DataFrame, key: str = "_row") -> DataFrame:
    """A bitmap of the hashes of a key: (part, bits)."""
    at = rows.select(F.pmod(F.xxhash64(key), F.lit(SKETCH_BITS)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg((F.col("at") % 32768)).alias("bits"))


def _sketched(rows: DataFrame, sketch: DataFrame, key: str = "_row", within: bool = True) -> DataFrame:
    """The rows whose key is in the sketch, and a few others: what is not wanted need not be shuffled. within: or else the rest."""
    at = F.pmod(F.xxhash64(key), F.lit(SKETCH_BITS))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    # broadcast: SKETCH_BITS bits at most
    found = rows.withColumn("part", F.floor(at / 32768)).withColumn("_bit", (at % 32768).cast("int")).join(F.broadcast(sketch), "part", "inner" if within else "left")
    bit = F.get(F.array(*(F.lit(1 << i) for i in range(8))), F.col("_bit") % 8).bitwiseAND(byte)
    return found.filter(bit != 0 if within else F.coalesce(bit, F.lit(0)) == 0).select(*rows.columns)


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are links on their full sets."""
    texts = _sketched(texts, _sketch(pairs.select(F.explode(F.array("u", "v")).alias("_row"))))
    text = lambda c, t: texts.select(F.col("_row").alias(c), F.col("text").alias(t))
    both = pairs.join(text("u", "ta"), "u").join(text("v", "tb"), "v").select("u", "v", "ta", "tb")
    return both.mapInPandas(_confirm(k, percent), "u long, v long")


def _first_rows(signed: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``signed`` that stand for their class. Only those that may have copies are shuffled to find out."""
    signed = signed.filter("n > 0")
    copied = scratch.save(_sketch(classes.filter("c > 1"), "same"), narrow=True)
    # an inner join, as _class is distinct: a semi join would be pushed below the sketch
    firsts = _sketched(signed, copied, "same").join(classes.select(F.col("_class").alias("_row")), "_row").select(*signed.columns)
    return _sketched(signed, copied, "same", within=False).unionByName(scratch.save(firsts))


def _hashes(k: int, wide: bool):
    def hashes(batches):
        known = _WordHashes()
        for pdf in batches:
            sets = [x for _, x in shingle_sets(pdf["text"], k, known)]
            short = sets if wide else [np.unique((x >> np.uint64(32)).astype(np.uint32)) for x in sets]
            yield pd.DataFrame({"_row": pdf["_row"], "n": [len(x) for x in sets], "h": [x.tobytes() for x in short]})

    return hashes


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of hashes.

    Only what stands in two sets can count, so the rest is dropped and the others make 0/1 matrices, taken in strips.
    """
    sets = left + right
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keep = count[at] > 1
    owner, at = owner[keep], (np.cumsum(count > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, [low, low + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[i:j], at[i:j] - low] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _joining(group: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between components among the members (own, row, comp, set size, hashes) of a block pair: a spanning forest.

    Hashes that two shingles of a set share are made good: no link is lost by them.
    """
    own = min(g[0] for g in group)
    left = [g for g in group if g[0] == own]
    right = [g for g in group if g[0] != own]
    same = not right
    right = right or left
    comps = sorted({g[2] for g in group})
    label = {c: i for i, c in enumerate(comps)}
    lc, rc = np.array([label[g[2]] for g in left]), np.array([label[g[2]] for g in right])
    ln, rn = np.array([g[3] for g in left]), np.array([g[3] for g in right])
    lost_l, lost_r = ln - [len(g[4]) for g in left], rn - [len(g[4]) for g in right]
    both = overlaps([g[4] for g in left], [g[4] for g in right]) + lost_l[:, None] + lost_r[None, :]
    link = 100 * both >= percent * (ln[:, None] + rn[None, :] - both) - 0.01
    out = []
    for i in range(len(left)):
        while True:
            j = np.flatnonzero(link[i] & (rc != lc[i]))
            if not len(j):
                break
            out.append((left[i][1], right[j[0]][1]))
            old, new = rc[j[0]], lc[i]
            rc[rc == old] = new
            if not same:
                lc[lc == old] = new
            else:
                lc = rc
    return out


def _compare(percent: int, wide: bool):
    """Goes through members in the order of their block pairs and gives the links between components."""
    def compare(batches):
        key, group = None, []
        for pdf in batches:
            out = []
            for b, i, j, own, row, comp, n, h in zip(*(pdf[c] for c in ("bucket", "bi", "bj", "own", "_row", "comp", "n", "h")), strict=True):
                if (b, i, j) != key:
                    out += _joining(group, percent) if len(group) > 1 else []
                    key, group = (b, i, j), []
                group.append((own, row, comp, n, np.frombuffer(h, np.uint64 if wide else np.uint32)))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        if len(group) > 1:
            yield pd.DataFrame(_joining(group, percent), columns=["u", "v"], dtype="int64")

    return compare


def _open_buckets(members: DataFrame, links: DataFrame, texts: DataFrame, k: int, percent: int, wide: bool, scratch: Scratch) -> DataFrame:
    """Links (u, v) between components, from the buckets whose members lie in several."""
    placed = scratch.save(members.join(links, F.col("_row") == F.col("u"), "left").select("_row", "bucket", "n", F.coalesce("v", "_row").alias("comp")))
    several = placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c"), F.sum("n").alias("h"), F.bit_xor(F.xxhash64("_row")).alias("x"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("y")).filter("a < b")
    # one of the buckets with the same members is enough
    several = several.groupBy("c", "h", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("h") / BLOCK_HASHES)).cast("int").alias("nb"))
    open_ = scratch.save(placed.drop("n").join(several, "bucket").withColumn("own", F.pmod(F.xxhash64("_row"), "nb").cast("int")))
    scratch.drop(placed)
    hashed = scratch.save(_sketched(texts, _sketch(open_)).mapInPandas(_hashes(k, wide), "_row long, n long, h binary"))
    spread = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).join(hashed, "_row")
    spread = spread.select("bucket", F.least("own", "o").alias("bi"), F.greatest("own", "o").alias("bj"), "own", "_row", "comp", "n", "h")
    spread = spread.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "_row")
    pairs = scratch.save(spread.mapInPandas(_compare(percent, wide), "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), narrow=True)
    scratch.drop(open_)
    scratch.drop(hashed)
    return pairs


def near_duplicates(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, also: tuple[str, ...] | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of ``df``.

    component_id is the least id reachable by links; kept marks the rows that carry it.
    row_col names a column of distinct numbers of the rows of ``df``, which must be a written table then; the result has
    it as _row, and comp, a number of the component, null for a row without words.
    also: columns of ``df`` that the result has as well, with comp and n_words, so that no join need find them again.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("text"), (df[row_col] if row_col else F.monotonically_increasing_id()).alias("_row"), *(df[c].alias(f"_also{i}") for i, c in enumerate(also or ())))
    rows = rows if row_col else scratch.save(rows)
    kind = rows.schema["_id"].dataType.simpleString()
    more = [f for f in rows.schema if f.name.startswith("_also")]
    signed = rows.select("_row", "_id", *(f.name for f in more), "text").mapInArrow(_signed(k), "".join(["_row long, _id ", kind, *(f", {f.name} {f.dataType.simpleString()}" for f in more), ", words long, n long, same binary, sig binary, bands array<long>"]))
    signed = scratch.save(signed)
    # the least id; where all are null, the first row stands for the class
    least = [F.min("_id").alias("_least"), F.min(F.when(F.col("_id").isNull(), F.col("_row"))).alias("_unnamed")]
    classes = scratch.save(signed.filter("n > 0").groupBy("same").agg(F.min("_row").alias("_class"), F.count("*").alias("c"), *least))
    members = _first_rows(signed.select("_row", "n", "same", "bands"), classes, scratch).select("_row", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("_row").alias("lead"), F.count("*").alias("c")).filter("c > 1").select("bucket", "lead")
    members = scratch.save(members.join(shared, "bucket"))
    sketch = scratch.save(_sketch(members), narrow=True)
    texts = scratch.save(_sketched(rows.select("_row", "text"), sketch))
    if not row_col:
        scratch.drop(rows)
    sigs = scratch.save(_sketched(signed.select("_row", "n", "sig"), sketch))
    pairs = members.filter("_row > lead").select(F.col("lead").alias("u"), F.col("_row").alias("v")).distinct()
    links = components(_links(_agreeing(pairs, sigs, percent, scratch), texts, k, percent), scratch)
    scratch.drop(sigs)

    for wide in (False, True):  # the second time only if a link of the short hashes was none
        pairs = _open_buckets(members.select("_row", "n", "bucket"), links, texts, k, percent, wide, scratch)
        more = scratch.save(_links(pairs, texts, k, percent), narrow=True)
        n_more = more.count()
        links = components(links.unionByName(more), scratch) if n_more else links
        if n_more == pairs.count():
            break

    comps = classes.join(links, F.col("_class") == F.col("u"), "left").select("same", "_least", "_unnamed", F.coalesce("v", "_class").alias("comp"))
    least = comps.groupBy("comp").agg(F.min("_least").alias("_to"), F.min("_unnamed").alias("_to_row"))
    comps = comps.join(least, "comp").select("same", "comp", "_to", F.when(F.col("_to").isNull(), F.col("_to_row")).alias("_to_row"))
    out = signed.drop("sig", "bands").join(comps, "same", "left")
    no_words = F.col("comp").isNull()
    out = out.withColumn("_to", F.when(no_words, F.col("_id")).otherwise(F.col("_to")))
    kept = no_words | F.when(F.col("_to").isNull(), F.col("_row") == F.col("_to_row")).otherwise(F.col("_id").eqNullSafe(F.col("_to")))
    beside = [] if also is None else [*([] if row_col else ["comp"]), F.col("words").alias("n_words"), *(F.col(f"_also{i}").alias(c) for i, c in enumerate(also))]
    out = out.select(*(["_row", "comp"] if row_col else []), F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_to").alias("component_id"), kept.alias("kept"), *beside)
    out = scratch.save(out)
    scratch.keep_only(out)
    return out


def deduplicate(df: DataFrame, **kwargs) -> DataFrame:
    """``df`` with one row of each group of near-duplicates; columns and their values stay as they are."""
    row = free_name(df, "_row")
    rows = Scratch(df.sparkSession).save(df.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(rows, row_col=row, **kwargs).filter("kept").select("comp", F.col("_row").alias(row))
    # a row without words is no copy of another; of rows that share an id and a component one stays
    kept = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(row).alias(row)).select(row).unionByName(found.filter("comp IS NULL").select(row))
    return rows.join(kept, row, "left_semi").select(*df.columns)
