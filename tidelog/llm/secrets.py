"""Secret scan with corpus-wide ownership of every candidate, in DataFrame expressions only.

Each text is scanned once; what remains of it is a narrow row of candidate spans with a SHA-256 of
each candidate. Ownership is counted over the whole corpus: a candidate's hash is first aggregated by
(hash, owner, repository), then by hash, so that a credential pasted into a third of all rows is
summed where it is read. An "example" is copied widely: it stands in many documents of more than few owners, or in
very many documents of more than few repositories, whoever owns them. Of the others, those that look live (a mix of
characters) are "owned", the rest "plain".

Besides the base kinds (assign, access, hex) the method adds spans of kind "owned": long mixed tokens
that no base span touches, with few owners. Secrets themselves are never returned.

Cases: a null text has no spans; a null owner or repository counts as one of its own; repeated rows
and equal ids are kept apart; texts of any length are scanned whole, and a text's matches are placed and compared in chunks,
so that time grows little faster than their number; an empty table gives an empty table; further columns are
ignored, in ``redact`` they stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, free_name, let, text_of

# The kinds in their order, their patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_GUARD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A candidate with at most so many owners is theirs, and so is one in at most so many documents.
FEW_OWNERS, FEW_SEEN = 2, 3
#: One in more repositories than these and more documents than these is an example, even with few owners.
FEW_REPOS, MANY_SEEN = 2, 100

#: Matches of a text that are placed or compared at once.
CHUNK = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches, as what stands between them tells their places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.zip_with(F.arrays_zip(between.alias("b"), found.alias("m")), value, lambda x, v: F.struct(F.length(x["b"]).alias("skip"), F.length(x["m"]).alias("n"), v.alias("v")))
    rows = F.filter(rows, lambda x: x["n"].isNotNull())
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    step = lambda a, x: F.struct(
        (a["at"] + x["skip"] + x["n"]).alias("at"),
        F.array_append(a["out"], F.struct((a["at"] + x["skip"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["skip"] + x["n"]).alias("end"), x["v"].alias("value"))).cast(SPAN).alias("out"),
    )
    # by chunks: places inside one, then moved by what the chunks before have passed over
    parts = let(rows, lambda r: _chunks(r, lambda part: F.aggregate(part, first, step)))
    moved = lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.array_append(a["out"], F.transform(c["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value")))).cast(f"array<{SPAN}>").alias("out"))
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), moved, lambda a: F.flatten(a["out"]))
    return F.filter(spans, keep) if keep else spans


def _chunks(items: Column, then) -> Column:
    """``then`` of each run of CHUNK items."""
    n = F.ceil(F.size(items) / CHUNK).cast("int")
    return F.when(n == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: then(F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))))


def _apart(long: Column, base: Column) -> Column:
    """The long spans that no base span touches. Base spans are looked at by chunks, in order of their starts."""
    bounds = lambda part: F.struct(F.element_at(part, 1)["start"].alias("low"), F.array_max(F.transform(part, lambda b: b["end"])).alias("high"), part.alias("part"))
    near = lambda s: lambda c: (c["low"] < s["end"]) & (c["high"] > s["start"]) & F.exists(c["part"], lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    chunks = let(F.array_sort(base), lambda b: _chunks(b, lambda part: let(part, bounds)))
    return F.when((F.size(long) == 0) | (F.size(base) == 0), long).otherwise(let(chunks, lambda cs: F.filter(long, lambda s: ~F.exists(cs, near(s)))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang", few_owners: int = FEW_OWNERS) -> DataFrame:
    """A row for each row of ``df``: id_col and ``found``, its spans in order of (start, kind).

    A span has start, kind (0 to 3, see KINDS), end (code points, end exclusive), class ("owned", "example",
    "plain"), n_owners, n_repos and n_seen (documents) of its candidate. A repository is (owner_col, repo_col).
    """
    scratch = Scratch(df.sparkSession)
    text = F.col("_text")
    none = F.array().cast(SPAN)
    rows = df.select(df[id_col].alias("_id"), df[owner_col].cast("string").alias("_owner"), (df[repo_col] if repo_col else F.lit(None)).cast("string").alias("_repo"), text_of(df[text_col]).alias("_text"))
    base = F.concat(
        F.when(text.rlike(ASSIGN_GUARD), _spans(text, ASSIGN, 0, lambda s: F.length(s["value"]) >= 6, 2)).otherwise(none),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none),
    )
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    long = F.when(text.rlike(LONG), _spans(text, LONG, 3, mixed)).otherwise(none)
    hashed = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), (
        (F.length(s["value"]) >= 12) & s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 8)).alias("live"))
    found = scratch.save(
        rows.withColumn("_base", base).withColumn("_long", long)
        .withColumn("_long", _apart(F.col("_long"), F.col("_base")))
        .select("_id", "_owner", "_repo", F.transform(F.array_sort(F.concat("_base", "_long")), hashed).alias("_all"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    each = found.filter(F.size("_all") > 0).select("_row", "_owner", "_repo", F.inline("_all"))
    part = each.select("hash", "_owner", "_repo", "_row").distinct().groupBy("hash", "_owner", "_repo").agg(F.count("*").alias("n"))
    owners = part.groupBy("hash", "_owner").agg(F.sum("n").alias("n"), F.count("*").alias("r")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_seen"))
    copied = ((F.col("n_owners") > few_owners) & (F.col("n_seen") > FEW_SEEN)) | ((F.col("n_repos") > FEW_REPOS) & (F.col("n_seen") > MANY_SEEN))
    judged = each.join(owners, "hash").select("_row", F.struct("start", "kind", "end", F.when(copied, "example").when(F.col("live"), "owned").otherwise("plain").alias("class"), "n_owners", "n_repos", "n_seen").alias("s"))
    judged = judged.filter((F.col("s.kind") < 3) | (F.col("s.class") == "owned"))
    by_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("found"))  # one text's spans
    return found.select("_row", F.col("_id").alias(id_col)).join(by_row, "_row", "left").select(id_col, F.coalesce("found", F.array().cast(by_row.schema["found"].dataType)).alias("found"))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans as text, and the most repositories and
    documents that one of the row's candidates stands in."""
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    of = lambda c: F.size(F.filter("found", lambda s: s["class"] == c)).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.transform("found", lambda s: s[c])), F.lit(0)).cast("long").alias(c)
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"), of("owned").alias("n_owned"), of("example").alias("n_example"), most("n_repos"), most("n_seen"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "<SECRET>", **columns) -> DataFrame:
    """``df`` with its owner-specific secrets replaced by ``mark``; rows, columns and clean texts stay.

    The texts keep their places: spans are joined by a row number taken before the scan.
    """
    scratch, at = Scratch(df.sparkSession), free_name(df, "_at")
    rows = scratch.save(df.withColumn(at, F.monotonically_increasing_id()))
    spans = scan(rows, id_col=at, text_col=text_col, **columns)
    cuts, text = free_name(df, "_cut"), text_of(text_col)
    theirs = spans.select(at, F.filter("found", lambda s: s["class"] == "owned").alias(cuts)).filter(F.size(cuts) > 0)
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.array_append(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("out"), s["end"].alias("at")))
    cut = F.aggregate(cuts, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step, lambda a: F.array_join(F.array_append(a["out"], F.substring(text, a["at"] + 1, F.length(text))), mark))
    return rows.join(theirs, at, "left").withColumn(text_col, F.when(F.col(cuts).isNotNull(), cut).otherwise(F.col(text_col))).select(*df.columns)
