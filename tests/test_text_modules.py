import unicodedata

import pytest
from pyspark.sql import functions as F

from signalloom.functions.lexicons import Lexicon
from signalloom.operators import dataset, keywords, sentiment
from signalloom.plans import modules
from signalloom.sources.payloads import paragraphs

from conftest import START, one


def scores(spark, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [(r.label, r.score, r.confidence) for r in sentiment.classify_sentiment(df, "t", **options).orderBy("i").collect()]


def test_classification(spark):
    got = scores(
        spark, "I love this great song", "bad and boring", "good but bad", "nothing here", "  ", None,
        "Tuyệt vời, rất hài lòng", "kém chất lượng", "LOVE's", "good good bad",
    )
    assert got == [
        ("positive", 99.99, 0.9999), ("negative", 0.0, 1.0), ("neutral", 50.0, 0.5), ("neutral", 50.0, 0.5),
        (None, None, None), (None, None, None), ("positive", 99.99, 0.9999), ("negative", 0.0, 1.0),
        ("neutral", 50.0, 0.5), ("positive", 66.6667, pytest.approx(0.666667)),
    ]


def test_phrases_count_once_and_hide_their_words(spark):
    lexicon = Lexicon(("very good",), ("good",), ("not good",), ("bad",))
    assert scores(spark, "very good very good bad", "not good", lexicon=lexicon) == [
        ("positive", 66.6667, pytest.approx(0.666667)), ("negative", 0.0, 1.0),
    ]


def test_summary_counts_skips(make):
    signals = make.signals(
        {"signal_id": "a", "cleaned_text": "great"}, {"signal_id": "b", "cleaned_text": "bad"}, {"signal_id": "c", "cleaned_text": "great", "language": "fr"},
        {"signal_id": "d", "cleaned_text": " "}, {"signal_id": "e", "modalities": ["engagement"]}, {"signal_id": "f", "cleaned_text": "ok", "modalities": [], "language": None},
    )
    row = one(sentiment.sentiment_summary(sentiment.classified_signals(signals)))
    assert (row.signal_count, row.applicable_count, row.processed_count, row.skipped_count) == (6, 5, 3, 2)
    assert (row.positive_count, row.neutral_count, row.negative_count, row.positive_pct) == (1, 1, 1, 33.33)
    assert (row.average_score, row.overall_label, row.coverage_status) == (49.9967, "neutral", "degraded")
    assert [(w["code"], w["count"]) for w in row.warnings] == [("INVALID_TEXT_SKIPPED", 1), ("UNSUPPORTED_LANGUAGE_SKIPPED", 1)]


def test_summary_without_text(make):
    row = one(sentiment.sentiment_summary(sentiment.classified_signals(make.signals({"signal_id": "a", "modalities": ["engagement"]}))))
    assert (row.status, row.coverage_status, row.average_score, row.overall_label) == ("skipped", "no_data", None, None)
    assert row.warnings[0]["code"] == "NO_APPLICABLE_TEXT"


def test_aspects_and_rollup(make):
    signals = make.signals({"signal_id": "a", "cleaned_text": "great song and art"}, {"signal_id": "b", "cleaned_text": "bad song"}, {"signal_id": "c", "cleaned_text": "start"})
    scored = sentiment.stored_sentiment(signals.withColumn("spam_flag", F.lit(False)))
    rows = sentiment.aspect_rollup(sentiment.aspect_sentiments(scored)).orderBy("rank").collect()
    # "art" is found inside "start": aspects are plain substrings.
    assert [(r.aspect, r.mention_count, r.avg_score) for r in rows] == [("music", 2, round(99.99 / 2, 2)), ("visuals", 2, round(149.99 / 2, 2))]


def test_daily_sentiment_defaults_to_neutral(make):
    signals = make.signals({"signal_id": "a", "cleaned_text": "great work"}, {"signal_id": "b", "published_at": None}).withColumn("spam_flag", F.lit(False))
    scored = sentiment.stored_sentiment(signals).filter("signal_id = 'x'")
    row = one(sentiment.daily_sentiment(signals, scored))
    assert (row.volume, row.sentiment) == (1, 50.0)


def terms(spark, text, **options):
    df = spark.createDataFrame([(text,)], "cleaned_text string")
    return [r.term for r in keywords.extract_terms(df, **options).orderBy("place").collect()]


def test_terms_in_order(spark):
    assert terms(spark, "Python programming language") == [
        "Python", "programming", "language", "Python programming", "programming language", "Python programming language",
    ]


def test_terms_skip_noise_and_stop_at_sentences(spark):
    assert terms(spark, "See https://x.y/z @joe #Dune 2024 trailer! Wow") == ["Dune", "trailer", "Dune trailer", "Wow"]
    # A gap of one stop word is bridged, a wider one is not.
    assert terms(spark, "king of hearts") == ["king", "hearts", "king hearts"]
    assert terms(spark, "king of the hearts") == ["king", "hearts"]
    assert terms(spark, "the of redacted a 12") == []
    assert terms(spark, "hình ảnh") == ["ảnh"] and "hướng dẫn" not in terms(spark, "hướng dẫn viên")


def test_loose_accents_match_the_stop_words(spark):
    assert terms(spark, unicodedata.normalize("NFD", "không phim")) == ["phim"]


def test_keyword_table_merges_spellings(make):
    signals = make.signals(
        {"signal_id": "a", "cleaned_text": "Hùng. hung. HÙNG", "published_at": START}, {"signal_id": "b", "cleaned_text": "Hùng zed", "source": "hype"},
        {"signal_id": "c", "cleaned_text": "slayer the demon"}, {"signal_id": "d", "cleaned_text": "zed", "language": "de"},
    )
    runs = make.runs()
    sealed = dataset.seal(signals)
    table = keywords.keywords_of(sealed, runs)
    rows = {r.canonical_form: r for r in keywords.ranked_keywords(table).collect()}
    assert set(rows) == {"hung", "zed", "hung zed"}  # the run keyword and its parts are left out
    assert (rows["hung"].keyword, rows["hung"].frequency, rows["hung"].sources, rows["hung"]["rank"]) == ("Hùng", 4, ["hype", "youtube"], 1)
    totals = one(keywords.keyword_totals(signals, table))
    assert (totals.total_unique_keywords, totals.total_mentions, totals.processed_signal_count, totals.skipped_signal_count) == (3, 6, 2, 2)
    assert [(w["code"], w["count"]) for w in totals.warnings] == [("UNSUPPORTED_LANGUAGE_SKIPPED", 1), ("NO_KEYWORDS_FOUND_SKIPPED", 1)]


def test_any_number_of_sources(make):
    signals = make.signals(*({"signal_id": f"{i:03}", "cleaned_text": "zed", "source": f"s{i:03}"} for i in range(140)))
    row = one(keywords.keywords_of(dataset.seal(signals), make.runs()))
    assert (row.frequency, row.sources) == (140, [f"s{i:03}" for i in range(140)])


def test_most_common_spelling_is_the_first_seen_on_ties(make):
    signals = make.signals({"signal_id": "b", "cleaned_text": "ZED. zed"}, {"signal_id": "a", "cleaned_text": "zed. ZED", "source": "a-first"})
    row = one(keywords.keywords_of(dataset.seal(signals), make.runs()))
    assert (row.keyword, row.frequency) == ("zed", 4)


def test_merge_prefers_frequent_then_long_spellings(spark):
    df = spark.createDataFrame([("r", "quang hung", 2), ("r", "Quang Hùng", 2), ("r", "zed", 3)], "run_id string, term string, n bigint")
    assert [(r.keyword, r["count"], r["rank"]) for r in keywords.merge_keywords(df).orderBy("rank").collect()] == [("quang hung", 4, 1), ("zed", 3, 2)]
    everything = keywords.merge_keywords(df, None)
    assert [(r.Rank, r.Keyword, r.Count) for r in keywords.export_keywords(everything, 3).collect()] == [(1, "quang hung", 4)]


def test_paragraphs(spark):
    row = one(spark.range(1).select(paragraphs(F.lit("a"), F.lit("")).alias("x"), paragraphs(F.lit("a"), F.lit("b")).alias("y")))
    assert (row.x, row.y) == ("a", "a\n\nb")


def exchanged(df):
    """The physical plan as text, with its joins as they are chosen without broadcasts."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keyword_forms_equal_a_count_of_all_mentions(make, spark):
    texts = [
        "Red fox jumps. red FOX runs far\nRéd fox jumps", "king of hearts; king hearts won", "zed", "fox of the red hearts won won won",
        "Ἀγάπη ΟΔΟΣ ὁδός", "a. fox", "",
    ]
    signals = make.signals(*({"signal_id": f"s{i}", "cleaned_text": t, "language": "de" if i == 3 else "en"} for i, t in enumerate(texts)))
    runs = make.runs()
    sealed = dataset.seal(signals)
    forms = keywords.keyword_forms(keywords.spellings(sealed, runs, keywords.source_names(sealed), ("en",)), runs)
    got = {r.canonical_form: r for r in keywords.unpacked_forms(keywords.packed_forms(forms)).collect()}
    mentions = keywords.extract_terms(signals.select("signal_id", "language", "cleaned_text")).withColumn("key", keywords.T.normalize_key(F.col("term")))
    # signal_id is also the order of the signals here, and place the order in a text.
    rows = sorted(mentions.collect(), key=lambda r: (r.signal_id, r.place))
    assert set(got) == {r.key for r in rows}
    for key, form in got.items():
        every = [r for r in rows if r.key == key]
        usable = [r for r in every if r.language == "en"]
        assert (form["count"], form.frequency) == (len(every), len(usable)), key
        assert form.openings == sum(r.place == 0 for r in usable), key
        spelled = [r.term for r in usable]
        assert form.keyword == (max(dict.fromkeys(spelled), key=spelled.count) if spelled else form.keyword), key
    seen = [r.key for r in rows if r.language == "en"]
    ordered = sorted((f for f in got.values() if f.frequency), key=lambda f: f.first)
    assert [f.canonical_form for f in ordered] == list(dict.fromkeys(seen))


def test_phrases_are_dealt_once_with_a_pair_and_its_triple_in_a_row(make):
    sealed, runs = dataset.seal(make.signals({"signal_id": "a", "cleaned_text": "red fox jumps"})), make.runs()
    single, phrases = keywords.spellings(sealed, runs, ["youtube"])
    merged = keywords.keyword_forms((phrases.limit(0), phrases), runs)
    assert merged.count() == 3
    assert exchanged(phrases).count("Exchange") == 1


def test_a_phrase_is_dealt_as_its_words_and_two_numbers(make, spark):
    sealed, runs = dataset.seal(make.signals({"signal_id": "a", "cleaned_text": "red fox jumps"})), make.runs()
    dealt = [line for line in exchanged(keywords.spellings(sealed, runs, ["youtube"])[1]).splitlines() if "Project" in line and "packed" in line]
    assert dealt and "lead" not in dealt[-1] and "bits_0" not in dealt[-1] and "third" not in dealt[-1]


def test_a_spelling_equal_to_the_keyword_is_not_stored_twice(spark):
    rows = [("r", "hung", "Hung", "Hung"), ("r", "zed", "zed", "ZED"), ("r", "fox", "fox", "fox"), ("r", "eau", "Eau", "eau")]
    forms = spark.createDataFrame(rows, "run_id string, canonical_form string, keyword string, spelling string")
    packed = keywords.packed_forms(forms)
    assert [(r.keyword, r.spelling) for r in packed.collect()] == [("Hung", None), (None, "ZED"), (None, None), ("Eau", "eau")]
    assert sorted(map(tuple, keywords.unpacked_forms(packed).collect())) == sorted(rows)


def test_many_words_are_dealt_to_more_tasks(make, spark, monkeypatch):
    sealed, runs = dataset.seal(make.signals({"signal_id": "a", "cleaned_text": "red fox jumps. red fox won"})), make.runs()
    monkeypatch.setattr(keywords, "DEALT_BYTES", 1)
    phrases = keywords.spellings(sealed, runs, ["youtube"])[1]
    assert phrases.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.term, r.n) for r in phrases.collect()} == {("red fox", 2), ("fox jumps", 1), ("fox won", 1), ("red fox jumps", 1), ("red fox won", 1)}


def test_terms_of_a_signal_need_no_shuffle_of_terms(spark):
    rows = [(1, "red fox red"), (2, "one two"), (2, "two fox"), (None, "zed"), (None, "zed zed"), (3, "of the"), (4, None)]
    df = spark.createDataFrame(rows, "signal_id long, cleaned_text string")
    found = keywords.signal_terms(df)
    plain = keywords.extract_terms(df).groupBy("signal_id").agg(F.count("term").alias("n_terms"), F.count_distinct("term").alias("n_distinct"), F.max("term").alias("last_term"))
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert len(found.collect()) == 3


def test_texts_are_not_sorted_to_get_flags_and_numbers(make, spark):
    signals = make.signals({"signal_id": "a", "cleaned_text": "red"}, {"signal_id": "b", "cleaned_text": "fox"}).drop("modalities")
    metrics = make.metrics(("a", "views", 1, 0))
    tagged = dataset.tag_modalities(signals, metrics)
    for df in (tagged, dataset.seal(tagged)):
        plan = exchanged(df)
        assert "SortMergeJoin [signal_id" not in plan and "ShuffledHashJoin [signal_id" in plan
    assert {r.signal_id: r.modalities for r in tagged.collect()} == {"a": ["engagement", "text"], "b": ["text"]}


def test_sums_and_top_keywords_are_found_in_one_pass(spark, make):
    rows = [("r%d" % (i % 3), f"k{i % 40:02d}-{i}", f"K{i}", 1 + i * 7 % 5, (1 << 33) - i, i % 2) for i in range(300)]
    rows.append(("alone", "x", "X", 9, 1, 1))
    schema = "run_id string, canonical_form string, keyword string, frequency bigint, first bigint, openings bigint"
    for kind in ("bigint", "decimal(38,0)"):
        table = spark.createDataFrame(rows, schema).withColumn("first", F.col("first").cast(kind)).repartition(5)
        size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        sums, top = keywords.sums_and_top(table, 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, keywords.keyword_sums(table).collect()))
        want = keywords.top_keywords(table.drop("openings"), 4)
        assert top.columns == want.columns and dict(top.dtypes)["first"] == kind
        assert sorted(map(tuple, top.collect())) == sorted(map(tuple, want.collect()))
    sums, top = keywords.sums_and_top(table.limit(0), 4)
    assert sums.collect() == top.collect() == []


def test_analysis_does_not_store_the_keyword_table(spark, make, monkeypatch):
    stored = []
    for module in (modules, keywords):
        monkeypatch.setattr(module, "materialize", lambda df, name, *a, kept=module.materialize, **o: (stored.append((name, df.columns)), kept(df, name, *a, **o))[1])
    signals = make.signals({"signal_id": "a", "cleaned_text": "Alpha beta. Alpha gamma"}, {"signal_id": "b", "cleaned_text": "alpha"})
    found = modules.analyze(signals, make.metrics(("a", "views", 1, 1)), make.runs())
    assert one(found.results["keywords"]).total_mentions == sum(r.frequency for r in found.keyword_table.collect())
    assert not [name for name, columns in stored if "openings" in columns]


def test_phrases_are_counted_batch_by_batch_without_a_sort_of_texts(make, monkeypatch):
    import pyarrow as pa

    sealed, runs = dataset.seal(make.signals({"signal_id": "a", "cleaned_text": "red fox jumps"})), make.runs()
    phrases = keywords.spellings(sealed, runs, ["youtube"])[1]
    assert "Sort" not in exchanged(phrases) and "Aggregate" not in exchanged(phrases)
    rows = [
        # run, pair, normalized, triple, normalized, place of the pair, of the triple, source
        ("r", "Red fox", "red fox", "Red fox won", "red fox won", 5, 7, 1), ("r", "red fox", None, None, None, 9, 11, 2), ("r", "RED fox", "red fox", None, None, 3, 5, 0),
        ("r", "red fox", None, None, None, 20, 22, 2), (None, "red fox", None, None, None, None, None, 0), ("r", "Red fox", "red fox", None, None, None, None, 0),
        ("q", None, None, "Réd fox won", "red fox won", 1, 2, 64), ("q", "a b", None, "red fox won", None, 8, 9, 1),
    ]
    names = ["run_id", "pair", "pair_key", "triple", "triple_key", "pair_first", "triple_first", "seen"]
    for kind, held in ((pa.int64(), 1 << 20), (pa.int64(), 1), (pa.decimal128(38, 0), 1), (pa.decimal128(38, 0), 1 << 20)):
        monkeypatch.setattr(keywords, "HELD_ROWS", held)
        types = [pa.string()] * 5 + [kind, kind, pa.int64()]
        count = keywords.PhraseCount(kind, 2)
        for k in range(0, len(rows), 3):
            columns = [list(c) for c in zip(*rows[k : k + 3])]
            count.add(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) if t == kind else pa.array(c, t) for c, t in zip(columns, types)], names))
        out = count.result().to_pylist()
        assert sorted((r["run_id"] or "", r["term"], r["n_all"], r["n"], r["first"] and int(r["first"])) for r in out) == [
            ("", "red fox", 1, 0, None), ("q", "Réd fox won", 1, 1, 2), ("q", "a b", 1, 1, 8), ("q", "red fox won", 1, 1, 9),
            ("r", "RED fox", 1, 1, 3), ("r", "Red fox", 2, 1, 5), ("r", "Red fox won", 1, 1, 7), ("r", "red fox", 2, 2, 9),
        ]
        forms = {(r["run_id"], r["canonical_form"]): r for r in out if r["canonical_form"]}
        assert len(forms) == 5
        fox = forms["r", "red fox"]
        assert (fox["form_keyword"], fox["form_frequency"], int(fox["form_first"]), fox["form_count"], fox["form_bits_0"]) == (None, 4, 3, 5, 3)
        # Two spellings are counted twice in all texts and are equally long: the later one in the alphabet names the group.
        assert fox["form_spelling"] is None
        won = forms["q", "red fox won"]
        assert (won["form_keyword"], won["form_spelling"], won["form_bits_0"], won["form_bits_1"]) == ("Réd fox won", "red fox won" if "red" > "Réd" else None, 1, 2)
        assert forms["r", "red fox won"]["form_keyword"] == "Red fox won" and forms[None, "red fox"]["form_first"] is None
