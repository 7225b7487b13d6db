"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame expressions.

A text's paragraphs are its non-empty lines, where a long line counts as several: it is cut at the first end of a
sentence after PIECE characters, or after LONGEST. Each distinct one has a digest of 44 bits and 20 bits of check.
A sketch has three parts of ``width`` cells, a power of 2; a digest enters one cell of each part, and a cell
holds the XOR of its digests. So the subtraction of two sketches is the XOR of their cells, what both have is gone, and a
sketch of half the width is the XOR of the halves of each part. A cell that holds one digest shows it by the check and its
place; taking it out frees others (peeling), until the differing digests are recovered and all cells are empty.

The stored fingerprint is a sketch with room for about as many differences as the text has paragraphs. Two stored ones are
brought to the narrower width, subtracted and peeled. Where the cells in use show that there are too many differences, or
peeling gets stuck, larger sketches are made and tried, each twice as wide, and after RETRIES of them the digests are
compared one by one: every likeness is exact as to the digests.

Cases: a null text is an empty one and has no paragraphs (likeness 1 to another such text) and the fingerprint ""; equal
texts have equal fingerprints; very long texts are taken whole, in time that grows little faster than their
length; a null id sorts first; rows that share an id are each followed by the next greater
id, of whose texts the smallest counts; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, let, ordered_blocks, text_of

PARTS, CHECK_BITS, PLACE_BITS = 3, 20, 20
#: Least cells in each part; cells of a part for each paragraph, before rounding up to a power of 2.
LEAST, SHARE = 8, 0.6
#: Differences for each cell of a part up to which peeling is tried; those that a larger sketch is made for.
MOST_LOAD, GOOD_LOAD = 2.3, 1.8
ROUNDS = 32
#: Larger sketches that are tried before digests are compared.
RETRIES = 4
#: Cells that are put together at once.
RUN = 256

#: Least characters of a line's piece that ends with a sentence, and the most of any piece.
PIECE, LONGEST = 80, 400
PARAGRAPH = rf"[^\n]{{{PIECE},{LONGEST}}}?[.!?]+(?![^\x20\n])|[^\n]{{1,{LONGEST}}}"

LONGS = "array<bigint>"
_MASK = (1 << CHECK_BITS) - 1
xor = lambda a, b: a.bitwiseXOR(b)


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(29), F.shiftright(digest, CHECK_BITS)).bitwiseAND(F.lit(_MASK))


def paragraphs(text: Column) -> Column:
    """Digests of the distinct paragraphs, each with its check in the low bits."""
    checked = lambda h: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(_check(h))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: let(F.xxhash64(p), checked)))


def width_of(n: Column) -> Column:
    """Cells in each part of a stored sketch of n digests."""
    return _power(F.greatest(F.lit(float(LEAST)), n * SHARE))


def _power(cells: Column) -> Column:
    """The least power of 2 from ``cells`` on, as far as places have bits."""
    return F.pow(F.lit(2.0), F.least(F.lit(float(PLACE_BITS)), F.ceil(F.log2(cells)))).cast("int")


def _place(digest: Column, part: Column, width: Column) -> Column:
    return F.call_function("shiftright", F.xxhash64(F.lit(17), digest), part * PLACE_BITS).bitwiseAND(width - 1).cast("int")


def sketch(digests: Column, width: Column) -> Column:
    """The three parts: arrays of ``width`` cells. Digests that stand twice cancel out."""
    def one_part(j):
        placed = F.array_sort(F.transform(digests, lambda d: F.struct(_place(d, j, width).alias("c"), d.alias("d"))))
        first = F.struct(F.array().cast(f"array<{LONGS}>").alias("done"), F.lit(0).alias("base"), F.array().cast(LONGS).alias("out"), F.lit(0).cast("long").alias("cell"))

        def step(a, x):
            gap = x["c"] - a["base"] - F.size(a["out"])
            same = F.struct(a["done"].alias("done"), a["base"].alias("base"), a["out"].alias("out"), xor(a["cell"], x["d"]).alias("cell"))
            longer = lambda out: F.when(F.size(out) < RUN, F.struct(a["done"].alias("done"), a["base"].alias("base"), out.alias("out"), x["d"].alias("cell"))).otherwise(
                F.struct(F.array_append(a["done"], out).alias("done"), x["c"].alias("base"), F.array().cast(LONGS).alias("out"), x["d"].alias("cell")))
            return F.when(gap == 0, same).otherwise(let(F.concat(a["out"], F.array(a["cell"]), F.array_repeat(F.lit(0).cast("long"), gap - 1)), longer))

        rest = lambda a: F.array_repeat(F.lit(0).cast("long"), width - 1 - a["base"] - F.size(a["out"]))
        return F.aggregate(placed, first, step, lambda a: F.concat(F.flatten(a["done"]), a["out"], F.array(a["cell"]), rest(a)))

    return F.transform(F.array(*(F.lit(j) for j in range(PARTS))), one_part)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, xor))


def narrowed(parts: Column, width: Column, to: Column) -> Column:
    """The sketch of ``to`` cells a part that holds the same digests."""
    halve = lambda p: let((F.size(p) / 2).cast("int"), lambda h: F.zip_with(F.slice(p, F.lit(1), h), F.slice(p, h + 1, h), xor))
    times = F.log2(width / to).cast("int")
    return F.when(width == to, parts).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), parts, lambda now, _: F.transform(now, halve)))


def stored(digests: Column) -> Column:
    """A text's fingerprint: struct(n, width, parts)."""
    return let(F.size(digests), lambda n: let(width_of(n), lambda w: F.struct(n.alias("n"), w.alias("width"), sketch(digests, w).alias("parts"))))


def as_text(fingerprint: Column) -> Column:
    """n;width;place:cell,... in hexadecimal, of the cells in use; "" without paragraphs."""
    cells = F.transform(F.flatten(fingerprint["parts"]), lambda c, i: F.when(c != 0, F.concat_ws(":", i, F.hex(c))))
    return F.when(fingerprint["n"] == 0, "").otherwise(F.concat_ws(";", fingerprint["n"], fingerprint["width"], F.array_join(cells, ",")))  # skips the empty ones


def peel(parts: Column, width: Column) -> Column:
    """The digests that a sketch holds, or null if it does not peel."""
    alone = lambda j: lambda d, i: (d != 0) & (d.bitwiseAND(F.lit(_MASK)) == _check(d)) & (_place(d, j, width) == i)
    pure = lambda now: F.array_distinct(F.flatten(F.transform(now, lambda p, j: F.filter(p, alone(j)))))
    state = lambda cells, got, more: F.struct(cells.alias("cells"), got.alias("got"), more.alias("more"))

    def one_round(a, _):
        take = lambda found: F.when(F.size(found) == 0, state(a["cells"], a["got"], F.lit(False))).otherwise(
            state(subtract(a["cells"], sketch(found, width)), F.concat(a["got"], found), F.lit(True)))
        return F.when(a["more"], let(pure(a["cells"]), take)).otherwise(a)

    empty = lambda cells: ~F.exists(cells, lambda p: F.exists(p, lambda d: d != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(parts, F.array().cast(LONGS), F.lit(True)), one_round, lambda a: F.when(empty(a["cells"]), a["got"]))


def _differences(parts: Column, width: Column) -> Column:
    """About how many digests a sketch holds, by its cells in use; infinite if all are."""
    used = F.size(F.array_remove(F.get(parts, F.lit(0)), F.lit(0).cast("long")))
    return F.when(used >= width, F.lit(float("inf"))).otherwise(-width * F.log(1 - used / width))


def difference(a: Column, b: Column, fa: Column | None = None, fb: Column | None = None) -> Column:
    """Digests in just one of two arrays of distinct digests. fa, fb: their fingerprints, if they are there.

    The fingerprints are subtracted and peeled. Where that fails, larger sketches of both are (made as one, for
    subtraction is XOR).
    """
    n = F.size(a) + F.size(b)
    plainly = F.concat(F.array_except(a, b), F.array_except(b, a))

    def larger(width):
        again = lambda found, t: F.when(found.isNotNull(), found).otherwise(let(F.least(width * F.pow(F.lit(2), t), F.lit(2.0**PLACE_BITS)).cast("int"), lambda w: let(F.concat(a, b), lambda both: peel(sketch(both, w), w))))
        tries = F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES - 1)), F.lit(None).cast(LONGS), again)
        return F.coalesce(tries, plainly)

    def at(x, y, w):
        cells = subtract(narrowed(x["parts"], x["width"], w), narrowed(y["parts"], y["width"], w))

        def attempt(z):
            wide = lambda d: _power(F.greatest(w * 2.0, F.least(d, n.cast("double")) / GOOD_LOAD))
            found = lambda d: F.when(d <= w * MOST_LOAD, peel(z, w))
            return let(_differences(z, w), lambda d: let(found(d), lambda got: F.when(got.isNotNull(), got).otherwise(let(wide(d), larger))))

        return let(cells, attempt)

    pair = lambda x: lambda y: let(F.least(x["width"], y["width"]), lambda w: at(x, y, w))
    return let(stored(a) if fa is None else fa, lambda x: let(stored(b) if fb is None else fb, pair(x)))


def likeness(a: Column, b: Column, fa: Column | None = None, fb: Column | None = None) -> Column:
    """Shared part of all distinct paragraphs of both, from their numbers and their difference; 1 for two empty ones."""
    n = F.size(a) + F.size(b)
    return let(F.size(difference(a, b, fa, fb)), lambda d: F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d)))


def _followers(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(_id, _next, _half) for each distinct id, and whether ids repeat. Narrow: no text is moved."""
    scratch = Scratch(df.sparkSession)
    narrow = df.select(df[id_col].alias("_id"), F.length(text_of(df[text_col])).alias("_n"))
    ids = narrow.groupBy("_id").agg(F.max("_n").alias("_n"), F.count("*").alias("_rows"))
    ids = ordered_blocks(ids, ["_id"], scratch)
    repeated = not ids.filter("_rows > 1").isEmpty()
    firsts = ids.groupBy("_block").agg(F.min(F.struct("_id")).alias("f"))  # a struct keeps a null id
    whole = Window.orderBy("_block")  # one row a block
    firsts = firsts.select("_block", F.lead("f").over(whole).alias("_after"), F.first("f").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"))
    inside = Window.partitionBy("_block").orderBy(F.col("_id").asc_nulls_first())
    # broadcast: one row for each of the range blocks
    out = ids.join(F.broadcast(firsts), "_block").select("_id", F.coalesce(F.lead(F.struct("_id")).over(inside), "_after", "_first")["_id"].alias("_next"), F.floor(F.col("_n") / 2).cast("int").alias("_half"))
    return scratch.save(out), repeated


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against its edited text's and the next document's.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document's.
    Texts are shuffled once by id; of the next document only the piece that is used and the digests move on.
    """
    follow, repeated = _followers(df, id_col, text_col)
    rows = df.select(df[id_col].alias("_id"), text_of(df[text_col]).alias("_text"))
    heads = rows.groupBy("_id").agg(F.min("_text").alias("_text")) if repeated else rows
    give = follow.select(F.col("_id").alias("_to"), F.col("_next").alias("_from"), "_half")
    give = heads.join(give, heads["_id"].eqNullSafe(give["_from"])).select("_to", F.expr("substring(_text, 1, _half)").alias("_head"), paragraphs(F.col("_text")).alias("_next_digests"))
    both = rows.join(give, rows["_id"].eqNullSafe(give["_to"]))
    n, text = F.length("_text"), F.col("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.col("_head"), F.lit(1), half))
    done = both.select("_id", n.cast("long").alias("n_chars"), paragraphs(text).alias("_a"), edited.alias("_edited"), "_next_digests")
    done = done.select("_id", "n_chars", "_a", F.sha2("_edited", 256).alias("edited_sha256"), paragraphs(F.col("_edited")).alias("_b"), F.col("_next_digests").alias("_c"))
    done = done.select("*", *(stored(F.col(f"_{c}")).alias(f"_f{c}") for c in "abc"))
    return done.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("_fa")).alias("fingerprint"), as_text(F.col("_fb")).alias("edited_fingerprint"),
        *(likeness(F.col("_a"), F.col(f"_{c}"), F.col("_fa"), F.col(f"_f{c}")).alias(name) for c, name in (("b", "near_edited"), ("c", "near_next"))),
        F.size("_a").cast("long").alias("n_paragraphs"),
    )
