"""Keyword extraction, variant merging, ranking and totals."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from signalloom.functions import lexicons
from signalloom.functions import text as T
from signalloom.operators.dataset import has_modality, with_run
from signalloom.operators.ranking import numbered, top_k
from signalloom.operators.sentiment import text_coverage, warning_list
from signalloom.session import materialize, small_side

# Noise removed before words are read, and the word pattern.
LINK_NOISE = rf"(?i)https?://{T.NOT_SPACE}+"
MENTION_NOISE = rf"@[{T.WORD}_]+"
NUMBER_NOISE = rf"(?=\p{{Nd}})(?<![{T.WORD}_])\p{{Nd}}+(?![{T.WORD}_])"
WORD_PATTERN = rf"([{T.WORD}]+(?:'[{T.WORD}]+)?)"
SEGMENT_PATTERN = r"[.!?;:\n]+"

# Shortest word, and the widest gaps inside a pair and a triple.
# (The least lengths of a phrase, 4 and 6, follow from the shortest word.)
MIN_WORD = 2
PAIR_GAP, TRIPLE_GAP = 2, 4

# Warning codes in the order they are reported.
KEYWORD_WARNINGS = (
    "NO_APPLICABLE_TEXT",
    "NO_VALID_TEXT",
    "INVALID_TEXT_SKIPPED",
    "UNSUPPORTED_LANGUAGE_SKIPPED",
    "NO_KEYWORDS_FOUND_SKIPPED",
)

EXCLUSION = ("_exclude", "_exclude_lengths")

# Sources that share one integer as bits; more sources take further integers.
BITS = 62

# Places of the candidates of a text are below this: a text has fewer characters, and a word or phrase takes three.
PLACES = 1 << 31

# Room for the size and the kind of a phrase in one number with the source behind them.
SIZED = 1 << 34

# Stored words, in bytes, whose phrases one task takes; more tasks than a shuffle has by default from there on.
DEALT_BYTES = 4 << 20

# Stored words, in bytes, that a task takes apart at a time.
PIECE_BYTES = 4 << 20

# Mentions of phrases that a task holds before it counts them together with those it has counted.
HELD_ROWS = 1 << 20


def clean_for_extraction(col: Column) -> Column:
    """Text without links, mentions, hash signs, free-standing numbers and emoji."""
    for pattern in (LINK_NOISE, MENTION_NOISE, "#", NUMBER_NOISE, T.EMOJI_PATTERN):
        col = F.regexp_replace(col, pattern, " ")
    return T.collapse(col)


def exclusion_keys(keyword: Column) -> Column:
    """Normalized run keyword and its parts, which may not become keywords."""
    parts = F.split(T.collapse(keyword), " ")
    keys = F.transform(F.concat(parts, F.array(keyword)), T.normalize_key)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def run_exclusions(runs: DataFrame) -> DataFrame:
    """Excluded terms of every run. They are derived here, on the run side of the
    joins, so that no text row derives them again. ``_exclude_lengths`` serves
    as a cheap first test: a word and its normalized key are equally long."""
    keys = runs.select("run_id", exclusion_keys(F.col("keyword")).alias("_exclude"))
    return keys.withColumn("_exclude_lengths", F.array_distinct(F.transform("_exclude", F.length)))


def _excluded(term: Column, lowered: Column, exclude: str) -> Column:
    # Terms hold single blanks only, so this is their normalized key.
    same_length = F.array_contains(F.col(f"{exclude}_lengths"), F.length(term))
    return same_length & F.array_contains(F.col(exclude), T.strip_accents(lowered))


def _phrases(kept: Column, words: int, widest_gap: int) -> Column:
    """Phrases of ``words`` neighbouring kept words that stand close together."""

    def build(start: Column) -> Column:
        items = [F.get(kept, start + i) for i in range(words)]
        close = items[-1]["place"] - items[0]["place"] <= widest_gap
        return F.when(close, F.concat_ws(" ", *[item["word"] for item in items]))

    built = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(kept) - words), build))
    return F.when(F.size(kept) >= words, built).otherwise(F.array().cast("array<string>"))


def _with_kept(df: DataFrame, text: str, exclude: str | None, compose: bool, keyed: bool = False) -> DataFrame:
    """Columns of ``df`` plus ``_kept``: per segment of the text, its words that may become keywords, with their places.

    ``keyed`` adds the normalized form of every word that is not normalized itself.
    """
    source = T.compose_accents(F.col(text)) if compose else F.col(text)

    def meaningful(word: Column) -> Column:
        lowered = F.lower(word)
        # Only a word that does not start with a basic letter can be a number.
        maybe_number = (word < ":") | (word > "z")
        verdict = (
            (F.length(word) >= MIN_WORD)
            & ~lowered.isin(*lexicons.STOP_WORDS)
            & ~lowered.contains("redacted")
            & ~(maybe_number & word.rlike(r"^\p{Nd}+$"))
        )
        if exclude is not None:
            verdict = verdict & ~_excluded(word, lowered, exclude)
        return verdict

    def kept_words(segment: Column) -> Column:
        words = F.regexp_extract_all(segment, F.lit(WORD_PATTERN), F.lit(1))
        placed = F.transform(words, lambda w, i: F.struct(i.alias("place"), w.alias("word")))
        found = F.filter(placed, lambda x: meaningful(x["word"]))
        if not keyed:
            return found
        return F.transform(found, lambda x: F.struct(x["place"].alias("place"), x["word"].alias("word"), F.nullif(T.strip_accents(F.lower(x["word"])), x["word"]).alias("key")))

    # One projection per step, so that no costly expression is evaluated twice.
    df = df.withColumn("_clean", clean_for_extraction(source))
    return df.withColumn("_kept", F.transform(F.split("_clean", SEGMENT_PATTERN), kept_words)).drop("_clean")


def _all_terms(kept: Column) -> Column:
    words = F.transform(kept, lambda x: x["word"])
    return F.concat(words, _phrases(kept, 2, PAIR_GAP), _phrases(kept, 3, TRIPLE_GAP))


def term_mentions(df: DataFrame, text: str = "cleaned_text", exclude: str | None = None, *, compose: bool = True) -> DataFrame:
    """One row per candidate term: columns of ``df`` plus ``place`` and ``term``.

    ``place`` counts the candidates of a text from 0; per segment the words come
    first, then pairs, then triples. ``exclude`` names the column of
    :func:`run_exclusions` with the words to leave out. Phrases are judged by :func:`is_term`, which
    can wait until equal phrases have been counted together.
    """
    df = _with_kept(df, text, exclude, compose)
    df = df.withColumn("_terms", F.flatten(F.transform("_kept", _all_terms))).drop("_kept")
    # The outer form keeps the optimizer from building the terms a second time in a filter.
    return df.select("*", F.posexplode_outer("_terms").alias("place", "term")).drop("_terms").filter("term IS NOT NULL")


def word_mentions(kept: DataFrame) -> DataFrame:
    """One row per word of :func:`_with_kept`: the other columns plus ``place`` and ``term``.

    Places order the words, pairs and triples of a text as those of :func:`term_mentions` do, and the first word has 0;
    other values differ, as these leave gaps. They stay below the number of characters.
    """
    return _mentions(kept, lambda words: F.transform(words, lambda x, i: F.struct(x["word"].alias("term"), i.alias("i"), F.size(words).alias("size")))).select(
        *_others(kept), _word_place().alias("place"), F.col("_start.term").alias("term")
    )


def _starting(kept: pa.ListArray) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """The pairs and triples of texts, taken apart as in :func:`phrase_mentions`: the texts they stand in, and their rows.

    Once those that are a triple, and once those that are a pair only.
    """
    segments = kept.flatten()
    words = segments.flatten()
    if not len(words):
        return
    place, word, key = (words.field(c) for c in ("place", "word", "key"))
    place = place.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.fill_null(pc.list_value_length(segments), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    held = pc.fill_null(pc.list_value_length(kept), 0).to_numpy(zero_copy_only=False)
    segment = np.repeat(np.arange(len(size)), size)
    text = np.repeat(np.arange(len(held)), held)[segment]
    i = np.arange(len(segment)) - (np.cumsum(size) - size)[segment]
    number = np.arange(len(segment)) - np.searchsorted(text, text)

    def close(words: int, widest: int) -> np.ndarray:
        out = np.zeros(len(place), bool)
        n = len(place) - words + 1
        if n > 0:
            out[:n] = (segment[words - 1 :] == segment[:n]) & (place[words - 1 :] - place[:n] <= widest)
        return out

    is_pair, is_triple = close(2, PAIR_GAP), close(3, TRIPLE_GAP)
    other = pc.is_valid(key).to_numpy(zero_copy_only=False)
    key = pc.coalesce(key, word)
    for rows, length in ((np.flatnonzero(is_triple), 3), (np.flatnonzero(is_pair & ~is_triple), 2)):
        if not len(rows):
            continue
        at = [pa.array(rows + k) for k in range(length)]
        joined, normal = (pc.binary_join_element_wise(*[c.take(a) for a in at], " ") for c in (word, key))
        changed = np.logical_or.reduce([other[rows + k] for k in range(length)])
        yield text[rows], pa.table(
            {
                "words": joined, "key": pc.if_else(pa.array(changed), normal, pa.scalar(None, normal.type)),
                "kind": is_pair[rows].astype(np.int64) + 2 * is_triple[rows], "size": size[segment[rows]],
                "place": number[rows] * 3 - i[rows] * 2 + size[segment[rows]],
            }
        )


def phrase_mentions(kept: DataFrame) -> DataFrame:
    """The pairs and triples of a keyed :func:`_with_kept`, a pair and the triple that starts with it in one row.

    Adds ``words``, the words of the longer one, ``key``, their normalized form where it is another text, and ``kind``:
    1 if only the pair counts, 2 if only the triple counts, as its first words stand too far apart, or 3. ``place`` is that
    of the pair, ``place`` + ``size`` that of the triple. They order the words, pairs and triples of a text as those of
    :func:`term_mentions` do; see :func:`word_mentions`. The words of some texts at a time are put together as columns.
    """
    carried = [f for f in kept.schema.fields if f.name != "_kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
            for batch in (whole.slice(k, rows) for k in range(0, whole.num_rows, rows)):
                others = batch.select([f.name for f in carried])
                for text, found in _starting(batch.column("_kept")):
                    made = pa.table(others.take(pa.array(text)).columns + [c.combine_chunks() for c in found.columns], [f.name for f in carried] + found.column_names)
                    yield from made.combine_chunks().to_batches(max_chunksize=20_000)

    added = {"words": StringType(), "key": StringType(), "kind": LongType(), "size": LongType(), "place": LongType()}
    return kept.mapInArrow(run, StructType([*carried, *[StructField(c, t) for c, t in added.items()]]))


def _lead(words: str | Column = "words") -> Column:
    """The first two words of a row of :func:`phrase_mentions`; words hold no blanks.

    Normal forms are made letter by letter, so those of the first words are the first words of the normal form.
    """
    return F.substring_index(words, " ", 2)


# Behind the words of a dealt row, which hold none, and before their normalized form.
BEHIND = "\n"


def _normal() -> Column:
    """The normalized words of a dealt row; it stands behind the words unless they are plain letters or normalized."""
    behind = F.when(F.contains("words", F.lit(BEHIND)), F.substring_index("words", BEHIND, -1))
    return behind.when(F.octet_length("words") == F.length("words"), F.lower("words")).otherwise(F.col("words"))


def _dealt_phrases(mentions: DataFrame, kept: DataFrame) -> DataFrame:
    """``mentions`` dealt by run and normalized first two words.

    ``kept`` is the stored table that they come from. The tasks grow in number with it, so that what one of them counts
    does not.
    """
    spark = mentions.sparkSession
    by = ["run_id", _lead(_normal())]
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = -(-size // DEALT_BYTES)
    return mentions.repartition(tasks, *by) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else mentions.repartition(*by)


def _others(kept: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in kept.columns if c != "_kept"]


def _mentions(kept: DataFrame, build: Callable[[Column], Column]) -> DataFrame:
    """One row per element that ``build`` makes of a segment, with its number in the text."""
    built = kept.withColumn("_starts", F.flatten(F.transform("_kept", build))).drop("_kept")
    return built.select("*", F.posexplode_outer("_starts").alias("_no", "_start")).drop("_starts").filter("_start IS NOT NULL")


def _word_place() -> Column:
    # Three places for every word of the segments before; of a segment first all words, then its pairs, its triples.
    return F.col("_no").cast("bigint") * 3 - F.col("_start.i") * 2


def _allowed(mentions: DataFrame) -> DataFrame:
    """``mentions`` without the pairs and triples that :func:`is_term` drops: ``kind`` says which of them stay."""
    normal = F.coalesce("key", "words")
    stops = sorted({"".join(d for d in unicodedata.normalize("NFD", t) if unicodedata.category(d) != "Mn") for t in lexicons.COMPOUND_STOP_WORDS})

    def allowed(term: Column, key: Column) -> Column:
        # The normalized term, which is there already, tells most phrases from a stop phrase.
        stop = key.isin(*stops) & F.lower(term).isin(*lexicons.COMPOUND_STOP_WORDS)
        same_length = F.array_contains("_exclude_lengths", F.length(term))
        return ~stop & ~(same_length & F.array_contains("_exclude", key))

    kind = F.col("kind")
    pair = F.when((kind != 2) & allowed(_lead(), _lead(normal)), 1).otherwise(0)
    triple = F.when((kind >= 2) & allowed(F.col("words"), normal), 2).otherwise(0)
    return mentions.withColumn("kind", pair + triple).filter("kind > 0")


def _spelled_and_keyed(dealt: DataFrame, kind: Column) -> DataFrame:
    """The pair and the triple of a row, and the normalized term of each if it is another text."""
    pair, triple = kind != 2, kind >= 2
    named = dealt.withColumn("_normal", _normal()).withColumn("words", F.substring_index("words", BEHIND, 1))
    named = named.withColumns({"_pair": _lead(), "_pair_normal": _lead("_normal")})
    return named.withColumns(
        {
            "pair": F.when(pair, F.col("_pair")), "pair_key": F.when(pair, F.nullif(F.col("_pair_normal"), F.col("_pair"))),
            "triple": F.when(triple, F.col("words")), "triple_key": F.when(triple, F.nullif(F.col("_normal"), F.col("words"))),
        }
    )


def _summed(starts: np.ndarray, order: np.ndarray, values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
    return how.reduceat(values[order], starts) if len(starts) else values[:0]


def _groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by their codes, and where each code begins in it."""
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.diff(codes[order], prepend=-1))


class PhraseCount:
    """Mentions of phrases counted by run and spelling, a few batches at a time.

    ``rows`` has a row per run and spelling: ``run``, ``term``, ``key`` (null where the term is normalized itself), how
    often all texts and usable signals have it, where it stands first and the bits of its sources.
    """

    # Behind every place that a bigint or a decimal holds: no usable signal has the spelling.
    NOWHERE = {"int64": (1 << 63) - 1, "decimal": 10**38}

    def __init__(self, first: pa.DataType, bits: int):
        self.first, self.bits = first, [f"bits_{k}" for k in range(bits)]
        self.nowhere = self.NOWHERE["decimal" if pa.types.is_decimal(first) else "int64"]
        self.rows: pa.Table | None = None
        self.numbers: dict[str, np.ndarray] = {}
        self.waiting: list[tuple[pa.Table, dict[str, np.ndarray]]] = []
        self.held = 0

    def places(self, values: pa.Array) -> np.ndarray:
        if pa.types.is_decimal(self.first):
            return np.array([self.nowhere if v is None else int(v) for v in values.to_pylist()], object)
        return pc.fill_null(values, self.nowhere).to_numpy(zero_copy_only=False)

    def add(self, batch: pa.RecordBatch) -> None:
        seen = batch.column("seen").to_numpy(zero_copy_only=False) - 1
        marks = {c: np.where((seen >= k * BITS) & (seen < (k + 1) * BITS), 1 << (np.maximum(seen - k * BITS, 0) % BITS), 0) for k, c in enumerate(self.bits)}
        for name in ("pair", "triple"):
            wanted = pc.is_valid(batch.column(name))
            some = wanted.to_numpy(zero_copy_only=False)
            first = self.places(batch.column(f"{name}_first").filter(wanted))
            texts = pa.table({"run": batch.column("run_id"), "term": batch.column(name), "key": batch.column(f"{name}_key")}).filter(wanted)
            numbers = {"n_all": np.ones(len(first), np.int64), "n": (first != self.nowhere).astype(np.int64), "first": first}
            self.waiting.append((texts, numbers | {c: m[some] for c, m in marks.items()}))
            self.held += len(first)
        if self.held > max(HELD_ROWS, 2 * (self.rows.num_rows if self.rows is not None else 0)):
            self.fold()

    def fold(self) -> None:
        """Count what waits together with what is counted."""
        parts = ([(self.rows, self.numbers)] if self.rows is not None else []) + self.waiting
        self.waiting, self.held = [], 0
        if not parts:
            return
        texts = pa.concat_tables([t for t, _ in parts]).combine_chunks()
        numbers = {c: np.concatenate([n[c] for _, n in parts]) for c in parts[0][1]}
        runs, terms = (texts.column(c).combine_chunks() for c in ("run", "term"))
        # The null run, if there is one, counts as a run.
        runs, terms = runs.dictionary_encode("encode"), terms.dictionary_encode()
        code = runs.indices.to_numpy().astype(np.int64) * max(len(terms.dictionary), 1) + terms.indices.to_numpy()
        order, starts = _groups(code)
        how = {"first": np.minimum} | dict.fromkeys(self.bits, np.bitwise_or)
        self.numbers = {c: _summed(starts, order, v, how.get(c, np.add)) for c, v in numbers.items()}
        self.rows = texts.take(pa.array(order[starts]))

    def result(self) -> pa.Table:
        """The spellings, those of a normalized term side by side; on one row of each term stands what it has in all."""
        self.fold()
        if self.rows is None:
            return None
        runs, terms, keys = (self.rows.column(c).combine_chunks() for c in ("run", "term", "key"))
        keys = pc.coalesce(keys, terms)
        coded = keys.dictionary_encode()
        code = runs.dictionary_encode("encode").indices.to_numpy().astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        order, starts = _groups(code)
        n, n_all, first = (self.numbers[c][order] for c in ("n", "n_all", "first"))
        terms = terms.take(pa.array(order))
        sizes = np.diff(starts, append=len(order))
        # The rows, in this order, that name the keyword and the spelling of each term; only terms with several are compared.
        keyword, spelling = starts.copy(), starts.copy()
        several = np.flatnonzero(sizes > 1)
        if len(several):
            group = np.repeat(np.arange(len(starts)), sizes)
            rows = np.flatnonzero(sizes[group] > 1)
            place, letter = (np.empty(len(rows), np.int64) for _ in range(2))
            place[np.argsort(first[rows], kind="stable")] = np.arange(len(rows))
            some = terms.take(pa.array(rows))
            letter[pc.sort_indices(some).to_numpy()] = np.arange(len(rows))
            length = pc.utf8_length(some).to_numpy()
            for chosen, by in ((keyword, (place, -n[rows])), (spelling, (-letter, -length, -n_all[rows]))):
                found = rows[np.lexsort((*by, group[rows]))]
                chosen[several] = found[np.flatnonzero(np.diff(group[found], prepend=-1))]
        leads = np.zeros(len(order), bool)
        leads[starts] = True
        keys = keys.take(pa.array(order))

        def of_form(values: np.ndarray) -> pa.Array:
            out = np.zeros(len(order), np.int64)
            out[starts] = values
            return pa.array(out)

        def named(rows: np.ndarray, than: np.ndarray | None) -> pa.Array:
            """The term of a row for each form; null where it is the normalized one, or the term of another row."""
            at = np.zeros(len(order), np.int64)
            at[starts] = rows
            found = terms.take(pa.array(at))
            same = pc.equal(found, keys).to_numpy(zero_copy_only=False) if than is None else np.zeros(len(order), bool)
            if than is not None:
                same[starts] = rows == than
            return pc.if_else(pa.array(leads & ~same), found, pa.scalar(None, found.type))

        def at_first(values: np.ndarray) -> pa.Array:
            if pa.types.is_decimal(self.first):
                return pa.array([None if v == self.nowhere else Decimal(int(v)) for v in values], self.first)
            return pa.array(values, self.first, mask=values == self.nowhere)

        first_of = np.full(len(order), self.nowhere, first.dtype)
        first_of[starts] = np.minimum.reduceat(first, starts)
        return pa.table(
            {"run_id": runs.take(pa.array(order)), "term": terms, "n_all": n_all, "n": n, "first": at_first(first), "openings": np.zeros(len(order), np.int64)}
            | {c: self.numbers[c][order] for c in self.bits}
            | {
                "canonical_form": pc.if_else(pa.array(leads), keys, pa.scalar(None, keys.type)), "form_keyword": named(keyword, None),
                "form_frequency": of_form(np.add.reduceat(n, starts)), "form_first": at_first(first_of),
            }
            | {f"form_{c}": of_form(np.bitwise_or.reduceat(self.numbers[c][order], starts)) for c in self.bits}
            | {"form_spelling": named(spelling, keyword), "form_count": of_form(np.add.reduceat(n_all, starts))}
        )


def _counted_phrases(dealt: DataFrame, bits: int) -> DataFrame:
    """One row per run and spelling of ``dealt``, whose tasks hold all spellings of their terms; see :class:`PhraseCount`."""
    kind = dealt.schema["pair_first"].dataType
    arrow = pa.decimal128(38, 0) if kind.typeName() == "decimal" else pa.int64()
    names = [f"bits_{k}" for k in range(bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PhraseCount(arrow, bits)
        for batch in batches:
            count.add(batch)
        found = count.result()
        if found is not None:
            yield from found.combine_chunks().to_batches(max_chunksize=20_000)

    text, number = StringType(), LongType()
    columns = {"run_id": text, "term": text, "n_all": number, "n": number, "first": kind, "openings": number, **dict.fromkeys(names, number)}
    columns |= {"canonical_form": text, "form_keyword": text, "form_frequency": number, "form_first": kind}
    columns |= {f"form_{c}": number for c in names} | {"form_spelling": text, "form_count": number}
    return dealt.mapInArrow(run, StructType([StructField(c, t) for c, t in columns.items()]))


def is_term(exclude: str | None = None, term: str | Column = "term") -> Column:
    """False for stop phrases and for phrases that the run excludes."""
    term = F.col(term) if isinstance(term, str) else term
    lowered = F.lower(term)
    allowed = ~lowered.isin(*lexicons.COMPOUND_STOP_WORDS)
    if exclude is not None:
        allowed = allowed & ~_excluded(term, lowered, exclude)
    return allowed


def extract_terms(df: DataFrame, text: str = "cleaned_text", exclude: str | None = None, *, compose: bool = True) -> DataFrame:
    """One row per term of a text, in order; see :func:`term_mentions`."""
    return term_mentions(df, text, exclude, compose=compose).filter(is_term(exclude))


def keyword_inputs(
    sealed: DataFrame, languages: tuple[str, ...] = lexicons.SUPPORTED_LANGUAGES
) -> DataFrame:
    """Text signals with the reason why one is left out, if any."""
    status = (
        F.when(~T.supports_language(F.col("language"), languages), F.lit("unsupported"))
        .when(T.is_blank(F.col("cleaned_text")), F.lit("invalid"))
        .otherwise(F.lit("usable"))
    )
    known = sealed.filter(F.coalesce(has_modality("text"), F.lit(False)))
    return known.withColumn("text_status", status)


def source_names(signals: DataFrame) -> list[str]:
    """Sorted names of the collectors in the data: one per platform, however many signals there are."""
    return sorted(row[0] for row in signals.select("source").distinct().filter("source IS NOT NULL").collect())


def spellings(
    sealed: DataFrame,
    runs: DataFrame,
    sources: list[str],
    languages: tuple[str, ...] = lexicons.SUPPORTED_LANGUAGES,
    compose: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Every spelling of a run's texts, words and phrases, with its counts: the one extraction that all keyword results start from.

    ``n_all`` counts the mentions in all texts; the other columns count those of usable signals. ``first`` is the
    signal's number in its run and the place of the term in the signal as one number, ``openings`` counts the signals
    whose first term this is, and the bits of ``bits_0``, ``bits_1``... stand for the sources. Phrases that
    :func:`is_term` drops are left out.

    The words that count are stored once. Words repeat, so each task counts them before they are shuffled. Most phrases
    occur once: their mentions are shuffled as they are, a pair and its triple in one row, with their normalized form where
    it has more to it than lower case, and dealt by the normalized pair. Terms with one normalized key have such pairs in common, because keys are made
    letter by letter. So a task has all spellings of its terms: it counts them without sorting texts, and one spelling of
    each term also carries, in ``canonical_form`` and the columns ``form_...``, what :func:`keyword_forms` gives for it.
    """
    usable = F.coalesce(has_modality("text"), F.lit(False)) & T.supports_language(F.col("language"), languages)
    number = F.array_position(F.array(*[F.lit(name) for name in sources]).cast("array<string>"), F.col("source"))

    def marks(seen: Column) -> list[Column]:
        """The bits of a source, which ``seen`` numbers from 1; none for 0."""
        place = (seen - 1).cast("int")
        return [
            F.when((place >= at) & (place < at + BITS), F.call_function("shiftleft", F.lit(1).cast("bigint"), place - at))
            .otherwise(F.lit(0).cast("bigint")).alias(f"bits_{at // BITS}")
            for at in range(0, len(sources), BITS)
        ]

    # Beyond 2**32 signals the number and the place need more than a bigint.
    kind = "bigint" if sealed.count() < 1 << 32 else "decimal(38,0)"
    chosen = sealed.filter(~T.is_blank(F.col("cleaned_text"))).select(
        "run_id", "cleaned_text", F.when(usable, F.col("signal_no").cast(kind) * F.lit(PLACES).cast(kind)).alias("_base"),
        F.coalesce(F.when(usable, number), F.lit(0)).cast("bigint").alias("_seen"),
    )
    keyed = with_run(chosen, run_exclusions(runs), *EXCLUSION)
    # The exclusions are few texts, one list for each run, and take no room in the files.
    kept = _with_kept(keyed, "cleaned_text", "_exclude", compose, keyed=True).drop("cleaned_text")
    kept = materialize(kept, "keyword-words", compression="zstd")
    bits = [f"bits_{at // BITS}" for at in range(0, len(sources), BITS)]
    single = word_mentions(kept).select("*", *marks(F.col("_seen"))).groupBy("run_id", "term").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count("_base").alias("n"),
        F.min(F.col("_base") + F.col("place")).alias("first"),
        F.count_if(F.col("_base").isNotNull() & (F.col("place") == 0)).alias("openings"),
        *[F.bit_or(b).alias(b) for b in bits],
    )
    packed = F.col("_seen") * SIZED + F.col("size") * 4 + F.col("kind")
    words = F.concat_ws(BEHIND, "words", F.when(F.octet_length("words") != F.length("words"), F.col("key"))).alias("words")
    mentions = _allowed(phrase_mentions(kept)).select("run_id", words, (F.col("_base") + F.col("place")).alias("first"), packed.alias("packed"))
    size = F.floor(F.pmod(F.col("packed"), F.lit(SIZED)) / 4).cast("bigint")
    dealt = _spelled_and_keyed(_dealt_phrases(mentions, kept), F.pmod(F.col("packed"), F.lit(4))).select(
        "run_id", "pair", "pair_key", "triple", "triple_key", F.col("first").cast(kind).alias("pair_first"),
        (F.col("first") + size).cast(kind).alias("triple_first"), F.call_function("shiftright", "packed", F.lit(SIZED.bit_length() - 1)).alias("seen"),
    )
    return single, _counted_phrases(dealt, len(bits))


def keyword_forms(spelled: tuple[DataFrame, DataFrame], runs: DataFrame) -> DataFrame:
    """Per run and normalized term, what all keyword results need, from :func:`spellings` in one pass.

    Words are merged here, accents stripped once per spelling; phrases come merged. ``keyword`` is
    the spelling that usable signals have most, the first one seen of equal ones; ``spelling`` the one that all texts
    have most, of equal ones the longer and then the alphabetically later one. A signal's first term is always a single
    word, which nothing drops, so ``openings`` counts signals with a term.
    """
    single, phrases = spelled
    kept = with_run(single, run_exclusions(runs), *EXCLUSION).filter(is_term("_exclude"))
    bits = [c for c in phrases.columns if c.startswith("bits_")]
    # Terms hold single blanks only, so this is their normalized key.
    keyed = kept.withColumn("canonical_form", T.strip_accents(F.lower("term")))
    # Few spellings share a term, so a partial aggregate saves nothing; rows dealt by the term are sorted once.
    words = keyed.repartition("run_id", "canonical_form").groupBy("canonical_form", "run_id").agg(
        F.max_by("term", F.struct(F.col("n"), -F.col("first"))).alias("keyword"),
        F.sum("n").alias("frequency"),
        F.min("first").alias("first"),
        F.sum("openings").alias("openings"),
        *[F.bit_or(c).alias(c) for c in bits],
        F.max_by("term", F.struct(F.col("n_all"), F.length("term"), F.col("term"))).alias("spelling"),
        F.sum("n_all").alias("count"),
    )
    named = F.coalesce("form_keyword", "canonical_form")
    found = phrases.filter("canonical_form IS NOT NULL").select(
        "canonical_form", "run_id", named.alias("keyword"), F.col("form_frequency").alias("frequency"), F.col("form_first").alias("first"), "openings",
        *[F.col(f"form_{c}").alias(c) for c in bits], F.coalesce(F.col("form_spelling"), named).alias("spelling"), F.col("form_count").alias("count"),
    )
    # A word is never a phrase, so no term is in both.
    return words.unionByName(found)


# Spellings that most terms share with another column, and that need not be stored a second time.
SPELLED = {"spelling": "keyword", "keyword": "canonical_form"}


def packed_forms(forms: DataFrame) -> DataFrame:
    """:func:`keyword_forms` for storage: NULL for a spelling that is the keyword, or the normalized term, itself."""
    return forms.withColumns({c: F.nullif(F.col(c), F.col(same)) for c, same in SPELLED.items() if c in forms.columns})


def unpacked_forms(stored: DataFrame) -> DataFrame:
    for c, same in reversed(SPELLED.items()):
        if c in stored.columns:
            stored = stored.withColumn(c, F.coalesce(F.col(c), F.col(same)))
    return stored


def signal_terms(df: DataFrame, compose: bool = True) -> DataFrame:
    """Per signal: number of terms, of distinct ones, and the last one in the alphabet.

    An id that one text has is answered in its own row. Only texts of an id that repeats are taken apart and grouped.
    """
    counts = df.groupBy("signal_id").agg(F.count(F.lit(1)).alias("_texts"))
    again = small_side(counts.filter("_texts > 1").select(F.col("signal_id").alias("_id")))
    on = F.col("signal_id").eqNullSafe(F.col("_id"))
    kept = _with_kept(df.join(again, on, "left_anti"), "cleaned_text", None, compose)
    terms = kept.select("signal_id", F.filter(F.flatten(F.transform("_kept", _all_terms)), lambda t: is_term(term=t)).alias("_terms"))
    own = terms.select(
        "signal_id", F.size("_terms").cast("bigint").alias("n_terms"),
        F.size(F.array_distinct("_terms")).cast("bigint").alias("n_distinct"), F.array_max("_terms").alias("last_term"),
    ).filter("n_terms > 0")
    grouped = extract_terms(df.join(again, on, "left_semi"), compose=compose).groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.count_distinct("term").alias("n_distinct"), F.max("term").alias("last_term")
    )
    return own.unionByName(grouped)


def keyword_table(forms: DataFrame, sources: list[str]) -> DataFrame:
    """Frequency, sources and most common spelling per normalized term and run, over usable signals."""
    seen = [
        F.when(F.col(f"bits_{i // BITS}").bitwiseAND(F.lit(1 << i % BITS)) != 0, F.lit(name)) for i, name in enumerate(sources)
    ]
    found = F.array_compact(F.array(*seen)).cast("array<string>")
    return forms.filter("frequency > 0").select("run_id", "canonical_form", "keyword", "frequency", "first", "openings", found.alias("sources"))


def keywords_of(
    sealed: DataFrame, runs: DataFrame, languages: tuple[str, ...] = lexicons.SUPPORTED_LANGUAGES, compose: bool = True
) -> DataFrame:
    """:func:`keyword_table` of sealed signals."""
    sources = source_names(sealed)
    return keyword_table(keyword_forms(spellings(sealed, runs, sources, languages, compose), runs), sources)


def ranked_keywords(table: DataFrame) -> DataFrame:
    """Full ranking per run: frequency, then first mention.

    Ranges are found in the rows before these are dealt to them, so the rows, which are costly to make, are stored first.
    """
    order = [F.col("frequency").desc(), F.col("first"), F.col("canonical_form")]
    table = materialize(packed_forms(table), "keyword-rows", compression="zstd")
    return unpacked_forms(numbered(table, ["run_id"], order, "rank", "keywords"))


def top_keywords(table: DataFrame, k: int = 30) -> DataFrame:
    return top_k(table, ["run_id"], [F.col("frequency").desc(), F.col("first"), F.col("canonical_form")], k)


def keyword_sums(table: DataFrame) -> DataFrame:
    """Unique keywords, mentions and signals with a keyword per run."""
    return table.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_unique_keywords"),
        F.sum("frequency").alias("total_mentions"),
        F.sum("openings").alias("processed_signal_count"),
    )


def sums_and_top(table: DataFrame, k: int = 30) -> tuple[DataFrame, DataFrame]:
    """:func:`keyword_sums` and :func:`top_keywords` of a table that is made once and not stored.

    The table takes more room than the texts. Each task adds up its rows and keeps ``k`` of each run, batch by batch; only
    these rows are stored: sums without a keyword, and leading keywords without sums.
    """
    sums = {"n": "frequency_count", "total_mentions": "frequency_sum", "processed_signal_count": "openings_sum"}
    kept = ["run_id", "canonical_form", "keyword", "frequency", "first"]
    order = [("run_id", "ascending"), ("frequency", "descending"), ("first", "ascending"), ("canonical_form", "ascending")]

    def leading(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        runs = rows.column("run_id").combine_chunks().dictionary_encode().indices.to_numpy()
        begins = np.flatnonzero(np.diff(runs, prepend=-1))
        place = np.arange(len(runs)) - np.repeat(begins, np.diff(begins, append=len(runs)))
        return rows.filter(pa.array(place < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, best = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            found = rows.group_by("run_id").aggregate([("frequency", "count"), ("frequency", "sum"), ("openings", "sum")])
            found = found.select(["run_id", *sums.values()])
            if added is not None:
                both = pa.concat_tables([added, found]).group_by("run_id").aggregate([(c, "sum") for c in sums.values()])
                found = pa.table({"run_id": both.column("run_id"), **{c: both.column(f"{c}_sum") for c in sums.values()}})
            added = found
            rows = rows.select(kept)
            best = leading(rows if best is None else pa.concat_tables([best, rows]))
        if best is None:
            return
        empty = {c: pa.nulls(added.num_rows, best.schema.field(c).type) for c in kept[1:]}
        blank = pa.nulls(best.num_rows, pa.int64())
        of_sums = pa.table({"run_id": added.column("run_id"), **empty, **{c: added.column(old).cast(pa.int64()) for c, old in sums.items()}})
        of_best = pa.table({**{c: best.column(c) for c in kept}, **dict.fromkeys(sums, blank)})
        for part in (of_sums, of_best):
            yield from part.combine_chunks().to_batches()

    fields = [table.schema[c] for c in kept]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField(c, LongType()) for c in sums])
    parts = materialize(table.select(*kept, "openings").mapInArrow(run, schema), "keyword-parts")
    totals = parts.filter("n IS NOT NULL").groupBy("run_id").agg(
        F.sum("n").alias("total_unique_keywords"), *[F.sum(c).alias(c) for c in list(sums)[1:]]
    )
    return totals, top_keywords(parts.filter("n IS NULL").select(*kept), k)


def keyword_totals(sealed: DataFrame, table: DataFrame, languages=lexicons.SUPPORTED_LANGUAGES) -> DataFrame:
    """Module result per run: unique keywords, mentions, processed and skipped signals."""
    return totals_with(sealed, keyword_sums(table), languages)


def totals_with(sealed: DataFrame, found: DataFrame, languages=lexicons.SUPPORTED_LANGUAGES) -> DataFrame:
    """:func:`keyword_totals` out of :func:`keyword_sums`."""
    inputs = keyword_inputs(sealed, languages)
    status = F.col("text_status")
    by_source = inputs.groupBy("run_id", "source").agg(
        F.count(F.lit(1)).alias("applicable_count"),
        F.count_if(status == "invalid").alias("invalid_text_count"),
        F.count_if(status == "unsupported").alias("unsupported_language_count"),
    )
    applied = by_source.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in by_source.columns if c.endswith("_count")],
        F.count(F.lit(1)).alias("source_count"),
    )
    every = sealed.groupBy("run_id").agg(F.count(F.lit(1)).alias("signal_count"))
    joined = every.join(applied, "run_id", "left").join(found, "run_id", "left").fillna(0)
    done, applicable = F.col("processed_signal_count"), F.col("applicable_count")
    joined = joined.withColumn("skipped_signal_count", applicable - done).withColumn(
        "no_keywords_count",
        F.col("skipped_signal_count") - F.col("invalid_text_count") - F.col("unsupported_language_count"),
    )
    skipped = F.col("skipped_signal_count")
    return joined.withColumns(
        {
            "status": F.when(done > 0, F.lit("completed")).otherwise(F.lit("skipped")),
            "coverage_status": text_coverage(done > 0, skipped),
            "coverage": F.when(applicable > 0, done / applicable).otherwise(F.lit(0.0)),
            "warnings": warning_list(
                (KEYWORD_WARNINGS[0], applicable == 0, F.lit(0)),
                (KEYWORD_WARNINGS[1], (applicable > 0) & (done == 0), skipped),
                (KEYWORD_WARNINGS[2], F.col("invalid_text_count") > 0, F.col("invalid_text_count")),
                (KEYWORD_WARNINGS[3], F.col("unsupported_language_count") > 0, F.col("unsupported_language_count")),
                (KEYWORD_WARNINGS[4], F.col("no_keywords_count") > 0, F.col("no_keywords_count")),
            ),
        }
    )


def drop_run_keyword(table: DataFrame, runs: DataFrame, column: str = "keyword") -> DataFrame:
    """Remove terms that are the run keyword itself or one of its parts."""
    joined = with_run(table, run_exclusions(runs), "_exclude")
    return joined.filter(~F.array_contains("_exclude", T.normalize_key(F.col(column)))).drop("_exclude")


def spelling_counts(signals: DataFrame, runs: DataFrame, compose: bool = True) -> DataFrame:
    """Mentions per run and exact spelling over all non-spam texts of any language."""
    texts = signals.filter(~F.col("spam_flag") & (F.col("cleaned_text") != "")).select("run_id", "cleaned_text")
    keys = run_exclusions(runs)
    keyed = with_run(texts, keys, *EXCLUSION)
    terms = term_mentions(keyed, "cleaned_text", "_exclude", compose=compose)
    counted = terms.groupBy("run_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return with_run(counted, keys, *EXCLUSION).filter(is_term("_exclude")).drop(*EXCLUSION)


def merge_keywords(spellings: DataFrame, k: int | None = 30) -> DataFrame:
    """Merge spellings by normalized key; keep the top ``k`` per run, or all.

    The most frequent spelling names the group; ties go to the longer and then
    to the alphabetically later one.
    """
    merged = spellings.groupBy("run_id", T.normalize_key(F.col("term")).alias("_key")).agg(
        F.max_by("term", F.struct(F.col("n"), F.length("term"), F.col("term"))).alias("keyword"),
        F.sum("n").alias("count"),
    )
    return leading_keywords(merged.drop("_key"), k)


def merged_forms(forms: DataFrame) -> DataFrame:
    """The same groups (run_id, keyword, count) out of :func:`keyword_forms`."""
    return forms.select("run_id", F.col("spelling").alias("keyword"), "count")


def leading_keywords(merged: DataFrame, k: int | None = 30) -> DataFrame:
    """The ``k`` most counted keywords of every run with their rank, or all."""
    order = [F.col("count").desc(), F.col("keyword")]
    if k is None:
        return numbered(merged, ["run_id"], order, "rank", "merged")
    return top_k(merged, ["run_id"], order, k)


def export_keywords(keywords: DataFrame, min_count: int = 9, count: str = "count") -> DataFrame:
    """Keywords counted more than ``min_count`` times, ranked from 1. Only these are sorted, so pass them unranked."""
    strong = keywords.filter(F.col(count) > min_count).drop("rank")
    ranked = numbered(strong, ["run_id"], [F.col(count).desc(), F.col("keyword")], "rank", "export")
    return ranked.select(
        "run_id", F.col("rank").alias("Rank"), F.col("keyword").alias("Keyword"), F.col(count).alias("Count")
    )


def keyword_match_scores(top: DataFrame, sentiment_score: DataFrame, k: int = 4) -> DataFrame:
    """Heuristic match score of the leading keywords of a run."""
    lead = top.filter(F.col("rank") <= k).join(sentiment_score, "run_id", "left")
    mood = F.coalesce("average_score", F.lit(50.0))
    bonus = F.when(mood > 60, 10).when(mood < 40, -10).otherwise(0)
    score = F.lit(65) + F.least(F.lit(25), F.col("count") * 2) + bonus - (F.col("rank") - 1) * 5
    return lead.select(
        "run_id",
        "rank",
        "keyword",
        F.concat(F.upper(F.substring("keyword", 1, 1)), F.substring("keyword", 2, 2**30), F.lit(" Topic Crossover")).alias("name"),
        F.least(F.lit(99), F.greatest(F.lit(40), score)).cast("bigint").alias("match_score"),
    )
