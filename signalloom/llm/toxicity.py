"""Toxicity scores from a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits that stand for letters, hidden characters), an Aho-Corasick
automaton finds the terms at word starts, exception phrases cancel the hits inside them, and the weight is related to
the length of the text. Terms, weights, exceptions and the final curve are learned from labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from signalloom.llm.common import append_columns

# Letters that look like a Latin one, and signs that stand for a letter. The letters i and l are one,
# since the digit 1 stands for both.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k",
    "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "һ": "h", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ε": "e", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
PREFIXES = range(4, 8)


# Letters in signs without a decomposition: the first code of each alphabet.
LETTER_SIGNS = (0x1F150, 0x1F170, 0x1F1E6)


class _Folding(dict):
    """What each character becomes, over all of Unicode, worked out when it is first met."""

    def __missing__(self, code: int) -> int | str | None:
        self[code] = found = self._fold(code)
        return found

    @staticmethod
    def _fold(code: int) -> int | str | None:
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            return code
        if unicodedata.category(c) in ("Mn", "Cf"):
            return None
        if c in SIGNS:
            return SIGNS[c]
        if c in LOOK_ALIKES:
            return SIGNS.get(LOOK_ALIKES[c], LOOK_ALIKES[c])
        if code > 127:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn").lower()
            for first in LETTER_SIGNS:
                if first <= code < first + 26:
                    plain = chr(ord("a") + code - first)
            # Circled and squared letters are signs; they count as the letter.
            if c.isalnum() or len(plain) == 1 and plain.isalpha():
                return "".join(SIGNS.get(x, LOOK_ALIKES.get(x, x)) for x in plain) or code
        return code if c.isalnum() else " "


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Words of a text in their folded form, between single or several spaces, with one at each end."""
    return f" {(text or '').lower().translate(_FOLDING)} "


def _features(folded: str) -> set[str]:
    """Whole words, and the beginnings of words, each after a space."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        for n in PREFIXES:
            if len(word) >= n:
                out.add(" " + word[:n])
    return out


class Lexicon:
    """At most ``max_terms`` terms and as many exceptions, so it can be sent to every task."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        self.weights, self.exceptions, self.curve, self._automaton = weights, exceptions, curve, None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """Start and term of each hit: the heaviest term at a word start, unless an exception covers it."""
        if not self.weights:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term in self.weights:
                self._automaton.add_word(term, (term, False))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (phrase, True))
            self._automaton.make_automaton()
        found, spared = {}, []
        for end, (term, spares) in self._automaton.iter(folded):
            start = end + 1 - len(term)
            if spares:
                spared.append((start, end))
            elif start not in found or self.weights[term] > self.weights[found[start]]:
                found[start] = term
        out = sorted(found.items())
        if spared:
            out = [(s, t) for s, t in out if not any(a <= s and s + len(t.rstrip()) - 1 <= b for a, b in spared)]
        return out

    def load(self, text: str | None) -> tuple[float, int]:
        """Weight of all hits, each term counting up to eight times, and the number of words."""
        folded = fold(text)
        times = Counter(t for _, t in self.hits(folded))
        return sum(self.weights[t] * min(n, 8) for t, n in sorted(times.items())), len(folded.split())

    def score(self, text: str | None) -> float:
        load, words = self.load(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.curve, _inputs(load, words)))))))


def _inputs(load: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(load), math.log1p(100 * load / (words + 20))


def _counted(sample: DataFrame, features) -> DataFrame:
    """Documents of either class that have a feature; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, Counter] = defaultdict(Counter)
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update(features(fold(text)))
            names = sorted(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([counts[1][n] for n in names], pa.int64()),
                    pa.array([counts[0][n] for n in names], pa.int64()),
                ],
                ["feature", "bad", "good"],
            )

    counted = sample.select("text", "toxic").mapInArrow(run, "feature string, bad long, good long")
    return counted.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn(
    documents: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 3_000, held_out: int | None = 2
) -> Lexicon:
    """Learn a lexicon from labelled rows.

    ``labels`` has doc_id and toxic (0 or 1); null labels are left out, and a document is toxic if any of its rows says
    so. Rows with crc32(doc_id as text) mod 4 = ``held_out`` are never used. At most ``max_rows`` labelled documents
    are used, those with the smallest hash of their id, which bounds what the driver and each task hold.

    Without labelled rows of both classes the lexicon is empty and every text gets the share of toxic rows.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if held_out is not None:
        usable = usable.filter(fold_of("doc_id") != held_out)
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # max_rows bounds the broadcast side.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").persist()
    try:
        totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        bad, good = totals.get(1, 0), totals.get(0, 0)
        base = (bad + 0.5) / (bad + good + 1) if bad + good else 0.01
        flat = (math.log(base / (1 - base)), 0.0, 0.0)
        if not bad or not good:
            return Lexicon({}, [], flat)

        counted = _counted(sample, _features)
        weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        share = F.lit(bad / (bad + good))
        total = F.col("bad") + F.col("good")

        def term(observed, expected):
            return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

        evidence = 2 * (term(F.col("bad"), total * share) + term(F.col("good"), total * (1 - share)))
        # The bar grows with the number of features that are tried.
        tried = counted.count()
        rows = (
            counted.withColumn("weight", weight).withColumn("evidence", evidence)
            .filter((F.col("weight") > 1) & (F.col("evidence") > 2 * math.log(tried + 1)))
            .orderBy(F.desc("evidence"), "feature").limit(max_terms).collect()
        )
        weights: dict[str, float] = {}
        for row in sorted(rows, key=lambda r: (len(r["feature"].rstrip()), r["feature"])):
            shorter = [weights[row["feature"][:n]] for n in range(2, len(row["feature"])) if row["feature"][:n] in weights]
            if not shorter or row["weight"] > max(shorter) + 0.7:
                weights[row["feature"]] = row["weight"]
        lexicon = Lexicon(weights, [], flat)

        # Words and pairs of words around a hit that speak for a clean text are its exceptions.
        def around(folded: str) -> set[str]:
            words = folded.split()
            line, out = f" {' '.join(words)} ", set()
            for start, _ in lexicon.hits(line):
                at = line.count(" ", 0, start)
                out.add(f" {words[at]} ")
                out.update(f" {a} {b} " for a, b in zip(words[max(0, at - 1) : at + 1], words[at : at + 2]) if at or a != b)
                if at + 1 < len(words):
                    out.add(f" {words[at]} {words[at + 1]} ")
            return out

        spared = (
            _counted(sample, around).withColumn("weight", weight)
            .filter((F.col("good") >= 5) & (F.col("weight") < 0) & ~F.col("feature").isin(list(weights)))
            .orderBy(F.desc("good"), "feature").limit(max_terms).collect()
        )
        lexicon = Lexicon(weights, [r["feature"] for r in spared], flat)

        def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [lexicon.load(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), batch.column("toxic")],
                    ["load", "words", "toxic"],
                )

        points = sample.mapInArrow(loads, "load double, words long, toxic int").collect()
    finally:
        sample.unpersist()
    x = np.array([_inputs(r["load"], r["words"]) for r in sorted(points)])
    y = np.array([r["toxic"] for r in sorted(points)], float)
    curve = _fitted(x, y)
    return Lexicon(weights, lexicon.exceptions, tuple(float(round(c, 9)) for c in curve))


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a light ridge; each Newton step is halved until the loss falls."""
    ridge = np.array([1e-3, 1e-2, 1e-2])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2)

    curve = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
        slope = x.T @ (p - y) + ridge * curve
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), slope)
        size, now = 1.0, loss(curve)
        while size > 1e-9 and loss(curve - size * step) > now:
            size /= 2
        curve = curve - size * step
        if size * np.abs(step).max() < 1e-9:
            break
    return curve


def fold_of(doc_id: str):
    """crc32(doc_id as text) mod 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def score_texts(df: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Whole texts are read. A null or empty text has no hits and gets the score of a text without any. Rows are
    independent; columns called score or predicted are replaced, all others stay.
    """
    lexicon_sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = [lexicon_sent.value.score(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]

    return append_columns(df, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], run)
