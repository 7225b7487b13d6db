"""Toxicity of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over every word of every text.
2. Words that may be disguised (signs, digits or separators among letters, a letter twice or more in a row, single
   letters set apart), of any length, become a lattice of what they may stand for; Viterbi takes the likeliest letters
   under the model and the channel's costs. A separator may hide inside a word or end it: such tokens are read both
   as one word and with the likeliest word boundaries. Words with nothing of the kind have one reading.
3. The restored words and their openings are the features. Their weights come from document counts in labelled
   texts; a logistic regression on the strongest of them gives the score. The labelled texts are a bounded sample
   (LABELLED of each class, by a hash of the id; of rows that share an id the smallest text), which bounds the number
   of features as well; rows whose crc32(id as text) mod 5 is 0 are never learnt from.
   Where a class is sampled, the intercept is shifted by the log of the sampling rates, so that a score is the
   chance of being toxic among all labelled texts, whatever their number. G is a test against chance among the
   texts seen, so it keeps their shares.

Cases: a null or empty text has no features and gets the score of the intercept, below 0.5; rows whose label is
null are not learnt from; without labels of both classes every score is 0; repeated rows are alike; texts of any
length are read whole; ids of any type come back as they are, null ones too; an empty table gives an empty table; further
columns are ignored, in ``reject`` they stay.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, lean_batches

#: Labelled texts of each class that the classifier is fitted on.
LABELLED = 20_000
#: Documents that a feature must stand in, and its least log-odds.
LEAST_DOCS, LEAST_WEIGHT = 4, 1.5
#: Least G statistic of a feature against chance: among millions of rare words some stand in toxic texts only.
LEAST_G = 28.0
OPENING = 5
FOLDS, HELD_OUT = 5, 0

# Letters that a sign may stand for, besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou"}
SEPARATORS = " .-_*~"

LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER = 27  # any other letter
N = 28  # 0 is the edge of a word
#: Costs in nats: reading a sign as a letter, dropping a sign, reading a run of one letter as fewer.
COST_LEET, COST_DROP, COST_RUN = 0.7, 3.0, 0.4

WORDS = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"([^\W\d_])\1")
SAME = re.compile(r"(.)\1+", re.S)
#: What is taken off a token's ends before it is looked at; none of it stands for a letter.
AROUND = ".,;:?\"'[]{}"
SPACED = re.compile(r"""(?<![^\s(\[{"'.,;:])(?:[^\W_]|[@$!|])(?:[ .*_~-]{1,3}(?:[^\W_]|[@$!|])){2,}(?![^\s)\]}"'.,;:!?])""")
#: The last two units of such a run and what stands before them.
MAYBE_SPACED = re.compile(r"[ .*_~-](?:[^\W_]|[@$!|])[ .*_~-]{1,3}(?:[^\W_]|[@$!|])(?![^\W_])")
SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
SEPARATOR = re.compile(r"[\W_]")
#: What stands around a token and is neither letter nor sign.
ENDS = re.compile(r"^(?:(?!%s)[\W_])+|(?:(?!%s)[\W_])+$" % ((SIGN.pattern,) * 2))

_CODE = np.full(0x10000, -1, np.int8)
for _i in range(0x10000):
    _c = chr(_i)
    if _c.isalpha() and not 0xD800 <= _i < 0xE000:
        _l = _c.lower()
        _CODE[_i] = LETTERS.index(_l) + 1 if len(_l) == 1 and _l in LETTERS else OTHER


@cache
def letter_code(c: str) -> int:
    return LETTERS.find(c) + 1 or OTHER


def trigrams(text: str) -> np.ndarray:
    """Counts of the letter trigrams of the words of ``text``, edges included: N^3 numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(codes < 0x10000, _CODE[np.minimum(codes, 0xFFFF)], OTHER).astype(np.int32)
    c = np.maximum(c, 0)
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]] if len(c) else c  # one edge between two words
    c = np.r_[np.zeros(2, np.int32), c, np.zeros(1, np.int32)]
    one, two = c[:-2].copy(), c[1:-1]
    one[two == 0] = 0  # a word begins without memory of the last
    return np.bincount((one * N + two) * N + c[2:], minlength=N**3)


@dataclass
class CharModel:
    """log P(third | first two) with add-half smoothing."""

    logp: np.ndarray

    def __post_init__(self):
        self.flat: list[float] = self.logp.ravel().tolist()  # many times faster to read one by one

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        c = counts.reshape(N, N, N) + 0.5
        return cls(np.log(c / c.sum(axis=2, keepdims=True)))


def lattice(unit: str, bounds: bool = False) -> list[list[tuple[str, float]]]:
    """Readings of each piece of ``unit`` (lower case): (letters, cost).

    A piece is a run of one letter or of one sign; separators between letters may be dropped for nothing.
    bounds: what is no letter may also end a word, read as a space: a separator for nothing, a sign at the cost of a
    reading, a digit at that of dropping it. Dropping has a cost where a separator stands twice or seldom hides in words.
    """
    out, i = [], 0
    while i < len(unit):
        c, j = unit[i], i + 1
        while j < len(unit) and unit[j] == c:
            j += 1
        out.append(_readings(c, min(j - i, 3), bounds))
        i = j
    return out


@cache
def _readings(c: str, n: int, bounds: bool) -> list[tuple[str, float]]:
    if c.isalpha():
        return [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, COST_RUN)] if n == 2 else [(c, COST_RUN), (c * 2, COST_RUN * 2)]
    if c not in LEET:
        return [("", 0.0 if n == 1 and c in SEPARATORS else COST_DROP), (" ", 0.0)] if bounds else [("", 0.0)]
    readings = [("", COST_DROP * min(n, 2))]
    for letter in LEET[c]:
        readings.append((letter, COST_LEET + (COST_RUN if n > 1 else 0)))
        if n > 1:
            readings.append((letter * 2, COST_LEET + COST_RUN))
    if bounds:
        readings.append((" ", COST_DROP if c.isdigit() else COST_LEET))
    return readings


@cache
def _coded(c: str, n: int, bounds: bool) -> list[tuple[str, tuple[int, ...], float]]:
    return [(letters, tuple(0 if x == " " else letter_code(x) for x in letters), cost) for letters, cost in _readings(c, n, bounds)]


def decode(unit: str, model: CharModel, bounds: bool = False) -> str:
    """The likeliest letters for ``unit``: Viterbi over the lattice, with the last two letters as state.

    bounds: with spaces where words end. Time grows with the length alone: where one state is left, what led
    to it is settled, so a unit of any length falls into exact parts.
    """
    flat, done, length = model.flat, [], len(unit)
    states: dict[int, tuple[float, tuple | None]] | None = None  # by N * the last letter but one + the last
    only = i = 0  # the one state, while there is no other
    while i < length:
        c, j = unit[i], i + 1
        while j < length and unit[j] == c:
            j += 1
        n, i = j - i, j
        if states is None:
            if n == 1 and c.isalpha():
                done.append(c)
                only = only % N * N + letter_code(c)
                continue
            states = {only: (0.0, None)}
        after: dict[int, tuple[float, tuple | None]] = {}
        readings = _coded(c, min(n, 3), bounds)
        for state, (score, path) in states.items():
            for letters, codes, cost in readings:
                s, k, p = score - cost, state, path
                for z in codes:
                    if z:
                        s += flat[k * N + z]
                        k = k % N * N + z
                    elif k:  # a word has begun: it ends, and the next begins without memory of it
                        s += flat[k * N]
                        k = 0
                    else:
                        letters = ""
                if letters:
                    p = (p, letters)
                old = after.get(k)
                if old is None or s > old[0]:
                    after[k] = (s, p)
        states = after
        if len(states) == 1:
            (only, (_, path)), = states.items()
            done += _letters(path)
            states = None
    if states is not None:
        closed = lambda k, p: 0.0 if bounds and not k and (done or p) else flat[k * N]
        done += _letters(max(((s + closed(k, p), p) for k, (s, p) in states.items()), key=lambda t: t[0])[1])
    return "".join(done).strip()


def _letters(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return out[::-1]


class Reader(dict):
    """The words that a token (lower case, without white space) is read as; remembers the recent ones."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(token) > 64:  # seldom met again
            return self.read(token)
        if len(self) > 100_000:
            self.clear()
        words = self[token] = self.read(token)
        return words

    def read(self, token: str) -> tuple[str, ...]:
        if token.isalpha():
            return (token, decode(token, self.model)) if RUN.search(token) else (token,)
        core = token.strip(AROUND)
        if core.isalpha():
            return self[core]
        plain = WORDS.findall(token)
        if not plain and not SIGN.search(token):
            return ()
        core = token.strip(".,;:!?\"'()[]{}")
        inner, cut = core.strip("%&#*$@!|+~-_.,;:"), core.strip("%&#*~-_.,;:")  # a sign at an end may be a letter or not
        units = (ENDS.sub("", token), *((inner, cut) if len(cut) - len(inner) <= 2 else (cut, inner)))
        return (*plain, *(w for unit in dict.fromkeys(units) if unit for w in self.readings(unit)))

    def readings(self, unit: str) -> list[str]:
        """``unit`` as one word, then with its likeliest word boundaries."""
        signs = SIGN.search(unit)
        word = unit if signs else "".join(WORDS.findall(unit))
        out = [decode(word, self.model) if signs or RUN.search(word) else word]
        if not unit.isalpha():
            if SEPARATOR.search(unit):
                out += decode(unit, self.model, bounds=True).split()
        elif out[0] != unit:
            out.insert(0, unit)
        return out

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            out.update(self[token])
        for unit in spaced(low):
            out.update(self.readings(unit))
        out.discard("")
        return out


def spaced(low: str) -> list[str]:
    """The runs of single letters set apart, without those of one letter again and again."""
    if not MAYBE_SPACED.search(low):
        return []
    return [m.group() for m in SPACED.finditer(low) if len(set(m.group())) > 2]


def restore(text: str, model: CharModel) -> str:
    """The text with each disguised word replaced by its reading."""
    reader, low = Reader(model), text.lower()
    low = SPACED.sub(lambda m: decode(m.group(), model, bounds=True) if len(set(m.group())) > 2 else m.group(), low)
    return re.sub(r"\S+", lambda m: (reader[m.group()] or (m.group(),))[-1], low)


def features_of(words: set[str]) -> set[str]:
    return words | {f"{w[:OPENING]}*" for w in words if len(w) > OPENING}


# --- learning ---------------------------------------------------------------------------------------------------


@dataclass
class Model:
    chars: CharModel
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)  # documents with the feature: toxic, others
    totals: tuple[int, int] = (0, 0)
    coef: np.ndarray | None = None

    def weight(self, toxic: int, other: int, t: int, c: int) -> float:
        return float(np.log((toxic + 0.25) / (t + 0.5)) - np.log((other + 0.25) / (c + 0.5)))

    def evidence(self, features: set[str], label: int | None = None) -> list[float]:
        """What a text shows by its features, all of them in ``counts``: its strongest weights and how many are strong.

        label: that of a labelled text, which is then left out of the counts.
        """
        (t, c), out = self.totals, []
        t, c = t - (label == 1), c - (label == 0)
        for f in features:
            x, y = self.counts[f]
            out.append(self.weight(x - (label == 1), y - (label == 0), t, c))
        out = sorted((w for w in out if w > 0), reverse=True)
        top = (out + [0.0, 0.0])[:2]
        return [top[0], top[1], float(np.log1p(sum(w > 4 for w in out)))]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.coef is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(evidence @ self.coef[1:] + self.coef[0], -30, 30)))


class Finder(dict):
    """The features of a model in texts; as a table, those that a token with signs shows. It remembers the recent ones.

    Letters alone can be read as a feature only if both are alike with their runs taken as one letter each.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.reader, self.known = Reader(model.chars), frozenset(model.counts)
        letters = {f: SAME.sub(r"\1", f.rstrip("*")) for f in self.known}
        self.whole = {c for f, c in letters.items() if f[-1] != "*"}
        self.openings = {c for f, c in letters.items() if f[-1] == "*"}
        self.lengths = sorted({len(c) for c in self.openings})
        self.trie: dict = {}
        for c in {*self.whole, *self.openings}:
            node = self.trie
            for x in c:
                node = node.setdefault(x, {})
            node[""] = True

    def shown(self, words) -> frozenset[str]:
        return self.known.intersection(features_of(set(words)))

    def possible(self, unit: str) -> bool:
        """Whether a reading of ``unit`` may hold a feature; never False where one does.

        The states are places in the trie, with the letter that led there; a letter that fits nowhere ends them.
        """
        root, states = self.trie, []
        for c in unit:
            as_letters = c if c.isalpha() else c + LEET.get(c, "")
            after = [] if c.isalpha() else states[:]
            for x in as_letters:
                for last, node in states:
                    if x == last:
                        after.append((last, node))
                    if x in node:
                        after.append((x, node[x]))
                if x in root:
                    after.append((x, root[x]))
            if len(after) > 1:
                after = list({id(node): (last, node) for last, node in after}.values())
            for _, node in after:
                if "" in node:
                    return True
            states = after
        return False

    def __missing__(self, token: str) -> frozenset[str]:
        found = self.shown(self.reader.read(token)) if self.possible(token) else NOTHING
        if len(token) <= 64:  # longer ones are seldom met again
            if len(self) > 100_000:
                self.clear()
            self[token] = found
        return found

    def in_letters(self, words: list[str]) -> set[str]:
        """The features of words of nothing but letters."""
        once = SAME.sub(r"\1", "\n".join(words)).split("\n")
        whole = self.whole.intersection(once)
        openings = set().union(*(self.openings.intersection({w[:n] for w in once}) for n in self.lengths))
        if not whole and not openings:
            return set()
        near = [w for w, o in zip(words, once, strict=True) if o in whole or any(o[:n] in openings for n in self.lengths)]
        return set().union(*(self.shown(self.reader[w]) for w in near))

    def features(self, text: str) -> set[str]:
        low = text.lower()
        tokens = set(low.split())
        odd = [t for t in tokens if not t.isalpha()]
        tokens.difference_update(odd)
        cores = [(t, t.strip(AROUND)) for t in odd]
        tokens.update(core for _, core in cores if core.isalpha())
        out = self.in_letters(list(tokens))
        for token, core in cores:
            if not core.isalpha():
                out |= self[token]
        for unit in spaced(low):
            if self.possible(unit):
                out |= self.shown(self.reader.readings(unit))
        return out


NOTHING: frozenset[str] = frozenset()


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, decay: float = 1e-2) -> np.ndarray:
    """Coefficients, the intercept first, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = decay * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def fold(id_col: str | Column) -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def char_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts of ``df``: each batch sends the trigrams it has; N^3 sums at most."""
    def count(batches):
        for pdf in batches:
            total = np.zeros(N**3, np.int64)
            texts = pdf["text"].tolist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < 1_000_000):
                    chars += len(texts[to])
                    to += 1
                total += trigrams("\n".join(texts[at:to]))
                at = to
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"g": seen, "n": total[seen]})

    rows = df.select(df[text_col].alias("text")).filter("text IS NOT NULL").mapInPandas(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(N**3, np.int64)
    out[rows["g"].to_numpy(dtype=int)] = rows["n"].to_numpy()
    return out


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", corpus: DataFrame | None = None) -> Model:
    """Fits the model: characters on all of ``corpus`` (``df`` by default), the classifier on at most
    LABELLED labelled rows of each class of ``df``."""
    scratch = Scratch(df.sparkSession)
    chars = CharModel.of(char_counts(df if corpus is None else corpus, text_col))
    model = Model(chars)
    truth = labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("_id")).agg(F.max(labels[label_col]).cast("int").alias("y"))
    truth = truth.filter(fold("_id") != HELD_OUT)
    some = [truth.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(LABELLED) for y in (0, 1)]
    some = scratch.save(some[0].unionByName(some[1]))
    labelled, sampled = (dict(x.groupBy("y").count().collect()) for x in (truth, some))
    # broadcast: at most 2 * LABELLED rows of an id and a label
    learn = df.select(df[id_col].alias("_id"), F.coalesce(df[text_col], F.lit("")).alias("text")).join(F.broadcast(some), "_id")
    learn = scratch.save(learn.groupBy("_id", "y").agg(F.min("text").alias("text")))

    def count(batches):
        reader = Reader(chars)
        for pdf in batches:
            sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                sums[y].update(features_of(reader.words(text)))
            keys = list(sums[0].keys() | sums[1].keys())
            yield pd.DataFrame({"f": keys, "toxic": [sums[1][k] for k in keys], "other": [sums[0][k] for k in keys]})

    n = dict(learn.groupBy("y").count().collect())
    model.totals = (n.get(1, 0), n.get(0, 0))
    if not all(model.totals):
        return model
    t, c = model.totals
    weight = F.log((F.col("toxic") + 0.25) / (t + 0.5)) - F.log((F.col("other") + 0.25) / (c + 0.5))
    found = learn.select("text", "y").mapInPandas(count, "f string, toxic long, other long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((F.col("toxic") + F.col("other")) * share))).otherwise(0.0)
    g = 2 * (part(F.col("toxic"), t / (t + c)) + part(F.col("other"), c / (t + c)))
    found = found.filter((F.col("toxic") >= LEAST_DOCS) & (weight >= LEAST_WEIGHT) & (g >= LEAST_G))
    # at most so many as 2 * LABELLED texts have words in LEAST_DOCS toxic ones
    model.counts = {r["f"]: (r["toxic"], r["other"]) for r in sorted(found.collect(), key=lambda r: r["f"])}

    def show(batches):
        finder = Finder(model)
        for pdf in batches:
            rows = [model.evidence(finder.features(t), int(y)) for t, y in zip(pdf["text"], pdf["y"], strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", "c"]).assign(y=pdf["y"].to_numpy())

    # one row for each labelled id that was taken
    shown = learn.select("text", "y").mapInPandas(show, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    model.coef = logistic(shown[["a", "b", "c"]].to_numpy(), shown["y"].to_numpy())
    model.coef[0] += np.log(sampled[0] / labelled[0]) - np.log(sampled[1] / labelled[1])
    scratch.keep_only()
    return model


def _scores(model: Model, finder: Finder, texts: pa.Array) -> np.ndarray:
    rows = [model.evidence(finder.features(t.as_py() or "")) for t in texts]  # one text at a time in Python's memory
    return model.score(np.array(rows).reshape(-1, 3))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for each row of ``df``. The model (at most a few MB) is sent to the tasks."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        finder = Finder(sent.value)
        for batch in batches:
            scores = _scores(sent.value, finder, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores)], ["_id", "score"])

    lean_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("text")).mapInArrow(judge, f"_id {kind}, score double")
    return rows.select(F.col("_id").alias(id_col), (fold("_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(df: DataFrame, model: Model, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``most``; columns and their values stay as they are."""
    sent, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def judge(batches):
        finder = Finder(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, finder, batch.column(place)) < most))

    lean_batches(df.sparkSession)
    return df.mapInArrow(judge, df.schema)
