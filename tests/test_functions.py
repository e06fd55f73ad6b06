import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from signalloom.functions import identity
from signalloom.functions import text as T
from signalloom.functions.rounding import clamp, exact_round, ratio
from signalloom.functions.scoring import momentum, growth_rate, sentiment_label
from signalloom.operators.quality import is_bot, is_spam

from conftest import one


def strings(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def applied(spark, function, *values):
    df = strings(spark, *values).select("i", function(F.col("t")).alias("out"))
    return [r.out for r in sorted(df.collect(), key=lambda r: r.i)]


@pytest.mark.parametrize("digits", [0, 1, 2, 4, 6])
def test_rounding_agrees_with_exact_decimal_rounding(spark, digits):
    rng = random.Random(digits)
    values = [2.675, 0.125, 3.125, 1.005, -2.675, -0.125, 0.5, 1.5, 2.5, 99.99, 0.0, 12345678.9]
    values += [rng.randint(-(10**7), 10**7) / 10 ** rng.randint(1, 8) for _ in range(3000)]
    values += [k / n * 100 for k in range(1, 40) for n in (7, 32, 160, 800, 4000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", exact_round(F.col("x"), digits).alias("y"))
    assert [(r.x, r.y) for r in rows.collect() if r.y != round(r.x, digits)] == []


def test_rounding_and_clamping_keep_null(spark):
    row = one(spark.range(1).select(
        exact_round(F.lit(None).cast("double"), 2).alias("a"), clamp(F.lit(None).cast("double"), 0.0, 1.0).alias("b"),
        ratio(F.lit(1.0), F.lit(0.0)).alias("c"), ratio(F.lit(None).cast("double"), F.lit(2.0)).alias("d"),
        ratio(F.lit(1.0), F.lit(3.0)).alias("e"),
    ))
    assert (row.a, row.b, row.c, row.d, row.e) == (None, None, None, None, 0.333333)


def test_clean_text(spark):
    got = applied(
        spark, T.clean_text, None, "", "<p>Hello</p>  world\n\n!", "see https://x.y/z?a=1 and www.site.org now", "a <b\nc> d", "  "
    )
    assert got == ["", "", "Hello world !", "see and now", "a <b c> d", ""]


def test_spam_rules(spark):
    df = spark.createDataFrame(
        [("A perfectly fine post", "A perfectly fine post"), ("short", "short"), ("Big GIVEAWAY for all of you", "x" * 20), (None, None)],
        "raw string, cleaned string",
    )
    assert [r[0] for r in df.select(is_spam(F.col("raw"), F.col("cleaned"))).collect()] == [False, True, True, True]


def test_bot_rules(spark):
    df = spark.createDataFrame(
        [("automated bot post here", "hype"), ("Robotics research", "hype"), ("a bot here", "serp_result"),
         ("AUTOMATED   feed", None), ("feed-puller", "hype"), ("botany", "hype")],
        "t string, s string",
    )
    assert [r[0] for r in df.select(is_bot(F.col("t"), F.col("s"))).collect()] == [True, False, False, True, True, False]


def test_redaction_order_and_boundaries(spark):
    got = applied(spark, T.redact, "mail a.b@c.com now", "hi @joe_x!", "call +84 912 345 678 today", "id 1234567 ok", "x@y")
    assert got == ["mail redacted now", "hi @redacted!", "call redacted today", "id 1234567 ok", "x@y"]


def test_redaction_of_known_identifiers(spark):
    known = F.array(F.lit("joe"), F.lit("Joe Doe"), F.lit("a/b"), F.lit("  "))
    got = applied(spark, lambda c: T.redact(c, known), "JOE and joe.x", "by joe doe!", "see a/b", None)
    assert got == ["redacted and joe.x", "by redacted!", "see redacted", None]


def test_accents_and_keys(spark):
    assert applied(spark, T.strip_accents, "Quang Hùng", "đường", "naïve café", "plain") == ["Quang Hung", "đuong", "naive cafe", "plain"]
    assert applied(spark, T.normalize_key, "  Quang\t Hùng ") == ["quang hung"]
    loose = unicodedata.normalize("NFD", "Tuyệt vời")
    assert applied(spark, T.compose_accents, loose, "plain", None) == ["Tuyệt vời", "plain", None]


def test_language_support(spark):
    assert applied(spark, T.supports_language, None, " ", "en", "EN-us", "vi_VN", "fr", "eng") == [True, True, True, True, True, False, False]


def test_canonical_url_and_owner(spark):
    got = applied(spark, identity.canonical_url, "HTTP://Ex.COM/A?q=1#f", "https://h", "ftp://x/y", "nothing", "https:///p")
    assert got == ["http://ex.com/A?q=1", "https://h/", None, None, None]
    got = applied(spark, identity.url_owner, "https://github.com//joe/r", "https://www.github.com/", "https://x.com/joe")
    assert got == ["joe", None, None]


def test_hashes_match_their_definition(spark):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    row = one(spark.range(1).select(
        identity.content_hash(F.lit("youtube"), F.lit("m1"), F.lit("x")).alias("content"),
        identity.search_result_id(F.lit(" The  Query"), F.lit("Google"), F.lit("https://h/")).alias("hit"),
        identity.cache_key(
            keyword=F.lit("k"), text=F.lit(" é x"), language=F.lit(None).cast("string"), provider="p", model="m",
            prompt_hash="h", prompt_version="v", response_schema_version="1",
        ).alias("key"),
    ))
    assert row.content == sha("youtube:m1:x")
    assert row.hit == "serpex:" + sha("the query\0google\0https://h/")
    fields = dict(input_hash=sha("é x"), keyword_hash=sha("k"), language="", provider="p", model="m", prompt_hash="h", prompt_version="v", response_schema_version="1")
    assert row.key == sha(json.dumps(fields, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def test_timestamps(spark):
    def shown(c):
        return F.date_format(identity.parse_timestamp(c), "yyyy-MM-dd HH:mm")

    assert applied(spark, shown, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+07:00", "2024-01-01T05:00:00", "x", None) == [
        "2024-01-01 00:00", "2023-12-31 17:00", "2024-01-01 05:00", None, None,
    ]


@pytest.mark.parametrize(
    "earlier, recent, growth, state",
    [(0.0, 100.0, None, "emerging"), (0.0, 0.0, 0.0, "stable"), (100.0, 150.0, 50.0, "rising"), (100.0, 50.0, -50.0, "fading"), (100.0, 120.0, 20.0, "stable")],
)
def test_momentum(spark, earlier, recent, growth, state):
    row = one(spark.range(1).select(growth_rate(F.lit(earlier), F.lit(recent)).alias("g"), momentum(F.lit(earlier), F.lit(recent)).alias("m")))
    assert (row.g, row.m) == (growth, state)


def test_sentiment_label_bounds(spark):
    df = spark.createDataFrame([(60.0,), (60.0001,), (60.00004,), (40.0,), (39.9999,), (None,)], "s double")
    assert [r[0] for r in df.select(sentiment_label(F.col("s"))).collect()] == ["neutral", "positive", "neutral", "neutral", "negative", None]
