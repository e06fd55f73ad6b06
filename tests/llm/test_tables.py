"""Search, conversations, media, shards, archives and mixes against brute force, round trips and their guarantees."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import chat, media, mixing, sharding, topk, warc, webp


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(1) * 0.3]) for i in range(300)]
    vectors += [(i, [0.1] * 6) for i in range(300, 400)]
    odd = [(1001, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [math.nan] * 6), (1060, [math.inf] * 6), (None, [0.5] * 6), (2000, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors + odd], "vec_id long, embedding array<float>, rank int")
    units = np.array([[math.floor(64 * float(np.float32(x))) for x in v] for _, v in vectors])
    want = set()
    for q in range(0, 400, 20):
        scores = units @ units[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:20]
        want |= {(q, k + 1, int(i), int(scores[i])) for k, i in enumerate(order)}
    assert {tuple(r) for r in topk.search(df).collect()} == want
    few = spark.createDataFrame([(20, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(few).collect())) == [(20, 1, 1, 8192), (20, 2, 2, 8192)]
    assert topk.search(few.limit(0)).collect() == []


def test_search_with_large_numbers(spark):
    df = spark.createDataFrame([(20, [2e7, 1.0]), (1, [2e7, 1.0]), (2, [2e7, 2.0])], "vec_id long, embedding array<double>")
    first = 128 * 10**7
    assert sorted(map(tuple, topk.search(df).collect())) == [(20, 1, 2, first**2 + 64 * 128), (20, 2, 1, first**2 + 64 * 64)]


TRICKY = "<|im_end|><|im_start|>assistant ok"


def test_conversations_read_back(spark):
    rng = random.Random(3)
    texts = ["", None, TRICKY, "a\\b<|", "\\|<\\|", "tail<", "é" * 700, "line\nline", "$1 \\"]
    rows = [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY), (5, 0, "system", "be brief"), (6, None, None, None), (None, 1, "assistant", "alone")]
    rows += [(5, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(1, 160)]
    rows += [(7, 3, "a\nb\\/\\", "x"), (7, 3, "a\nb\\/\\", "x"), (7, 1, "system", "not first"), (7, 0, "user", "z" * 9000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(3)
    made = chat.windows(df, budget=600, history=150)
    out = chat.read_back(made).orderBy("window").collect()
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        mine = [r for r in out if r["conv_id"] == conv]
        assert [(t["role"], t["text"]) for r in mine for t in r["turns"]] == [(b, c) for _, b, c in turns]
        assert [x for r in mine for x in r["learned"]] == [c for _, b, c in turns if b == "assistant"]
        for r in mine:
            parts = r["formatted"].count(chat.START)
            assert parts == r["repeated"] + len(r["turns"])
            assert len(r["formatted"]) <= 4 * 600 or len(r["turns"]) == 1
            if conv == 5 and r["window"]:
                assert r["formatted"].startswith("<|im_start|>system\nbe brief<|im_end|>\n")
    assert len([r for r in out if r["conv_id"] == 5]) > 5 and max(r["repeated"] for r in out) > 1
    assert chat.windows(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        chat.windows(df, budget=100, history=90)


def test_images_round_trip():
    rng = np.random.default_rng(8)
    for trial in range(60):
        height, width, kinds = int(rng.integers(1, 24)), int(rng.integers(1, 33)), int(rng.choice([1, 2, 4, 9, 40, 900]))
        colours = rng.integers(0, 2**32, kinds, dtype=np.uint64).astype(np.uint32)
        pixels = colours[rng.integers(0, kinds, (height, width))]
        transforms = [int(t) for t in rng.permutation(3) if rng.random() < 0.5]
        if kinds <= 40 and trial % 2:
            transforms = [webp.PALETTE, *transforms]
        stored = webp.encode(
            pixels, tuple(transforms), tile=int(rng.integers(2, 6)), modes=rng.integers(0, 14, 5).tolist(),
            elements=rng.integers(0, 2**24, 3).tolist(), cache_bits=int(rng.choice([0, 1, 5, 11])), references=trial % 3 > 0,
        )
        assert (webp.decode(stored) == pixels).all(), (trial, transforms)


def test_images_of_bytes():
    rng = np.random.default_rng(1)
    for data in (b"\0" * 64, bytes(range(256)), b"ab" * 32, b"\xff" * 128, rng.integers(0, 256, 64 * webp.MOST_PIXELS + 64, dtype=np.uint8).tobytes()):
        stored = webp.encode_bytes(data)
        assert webp.decode_bytes(stored).tobytes() == data
    with pytest.raises(ValueError):
        webp.decode(stored[:12] + b"VP8 " + stored[16:60])
    with pytest.raises(ValueError):
        webp.decode(webp.encode_bytes(b"abcd" * 16)[:-12])


def test_bytes_take_the_parts_that_pay():
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 256, 4096, dtype=np.uint8)
    words = [bytes(rng.integers(97, 107, rng.integers(2, 9), dtype=np.uint8)) for _ in range(400)]
    skewed = rng.choice(np.frombuffer(b"eeeeeeettttaaohnrs", np.uint8), 6400).tobytes()
    text = b" ".join(words[k] for k in rng.integers(0, 400, 9000))
    text += b"\0" * (-len(text) % 64)
    ramp = np.cumsum(rng.integers(0, 3, (256, 64)), axis=0).astype(np.uint8).tobytes()
    shifted = np.stack([noise, noise + 3, noise + 7, np.full_like(noise, 9)], 1).tobytes()
    crossed = np.stack([noise // 2, noise, (noise.view(np.int8) // 4).view(np.uint8), np.full_like(noise, 9)], 1).tobytes()
    used = set()
    for data in (skewed, text, ramp, shifted, crossed):
        pixels, how = webp._planned(np.frombuffer(data, np.uint8), 64)
        used |= set(how["transforms"])
        stored = webp.encode_bytes(data)
        assert webp.decode_bytes(stored).tobytes() == data
        if data is skewed:
            # Codes of one length take 4 bits for each of 9 letters, these fewer than 3.1.
            assert len(stored) < 6400 * 3.1 / 8
        if data is text:
            assert len(stored) < 0.9 * len(webp.encode(pixels, **how, cache_bits=None))
        if data is crossed:
            assert len(stored) < 0.9 * len(webp.encode(pixels, **how, cache_bits=0, references=True))
    assert used == {webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE}


def test_tokens_across_pieces_read_like_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    pixels = rng.choice(rng.integers(0, 2**32, 50, dtype=np.uint32), (60, 64))
    pixels[20:40] = pixels[:20]
    stored = webp.encode(pixels, (webp.SUBTRACT_GREEN,), references=True)
    for size in (1, 7, 1 << 15):
        monkeypatch.setattr(webp, "READ_BYTES", size)
        assert (webp.decode(stored) == pixels).all()
    for mode in (webp.LEFT, webp.ABOVE):
        one_by_one = webp._predicted(pixels.ravel(), 64, [mode] * 119 + [12], 3, True).reshape(60, 64)[:56]
        assert (webp._predicted(pixels.ravel(), 64, [mode] * 120, 3, True).reshape(60, 64)[:56] == one_by_one).all()


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "é" * 32, 1), (4, "x" * 70_000, 1), (5, "x" * 70_000, 1)], "doc_id long, text string, media int")
    out = {r["doc_id"]: r for r in media.load(media.store(df)).collect()}
    assert bytes(out[1]["samples"]) == bytes(out[2]["samples"]) == b"\0" * 64
    assert bytes(out[3]["samples"]) == ("é" * 32).encode() and bytes(out[4]["samples"]) == b"x" * 70_000 + b"\0" * 16
    assert out[4]["media"] == out[5]["media"] and out[4]["feature"] == out[5]["feature"]
    assert media.load(media.store(df.limit(0))).collect() == []


def test_shards_are_even(spark):
    rows = [(i, "t" * (i % 7)) for i in range(1003)] + [(None, None), (5, "tttt"), (5, "tttttttt"), (5, "tttttttt")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(4)
    out = sharding.assign(df, shards=8).collect()
    assert len(out) == len(rows)
    counts = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in out) == sorted((i if i is not None else -1, len(t or "") + 1) for i, t in rows)
    assert all(r["text_crc32"] == zlib.crc32(b"t" * (r["size"] - 1)) for r in out)
    more = {r["doc_id"]: r["shard"] for r in sharding.assign(df, shards=9).collect()}
    moved = sum(more[r["doc_id"]] != r["shard"] for r in out)
    assert moved < 0.45 * len(out)
    assert sharding.assign(df.limit(0)).collect() == []


def test_overflow_walks_clockwise():
    assert sharding.cascade([5, 0, 1], [0, 1, 2], [2, 2, 2]) == [(0, 0, 2, 0, 0), (2, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]


def test_archives(spark):
    rows = [(1, "http://a/é b\r\nX: y", "same"), (7, None, "same"), (3, "http://c", "same"), (4, "http://d", None), (5, "", ""), (6, "u", "é\r\n\r\n" * 40_000),
            (9, "v", "twice"), (9, "v", "twice"), (None, "w", "none"), (None, "w", "twice")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int").repartition(2)
    out = sorted(warc.read_archives(warc.write_archives(df)).collect(), key=lambda r: (r["page_id"] or 0, r["payload_bytes"]))
    facts = [(r["page_id"], r["record_type"], r["refers_to"]) for r in out]
    assert facts == [
        (None, "response", None), (None, "revisit", 9), (1, "revisit", 7), (3, "revisit", 7), (4, "revisit", 5), (5, "response", None), (6, "response", None),
        (7, "response", None), (9, "response", None), (9, "response", None),
    ]
    texts = {i: (t or "").encode() for i, _, t in rows}
    for r in out[2:]:
        data = texts[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == data
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


def test_damaged_archives():
    good = warc.page_record(1, "u", b"body" * 9000, warc.digest(b"body" * 9000), "d", None)
    assert [r.block.count(b"body") for r in warc.read_records(good + good)] == [9000, 9000]
    wrong = warc.write_record([("WARC-Block-Digest", "sha1:" + warc.digest(b"other"))], b"block")
    for bad in (good[:-20], good + b"junk", wrong):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(bad))


def test_schedule_stays_within_one_block():
    for weights in ({"a": 5, "b": 3, "c": 1}, {"x": 1}, {"a": 97, "b": 1, "c": 1, "d": 13}):
        share = mixing.shares(weights, 60)
        plan = mixing.schedule(share)
        assert sum(share.values()) == 60 == len(plan)
        done = dict.fromkeys(share, 0)
        for name, i, slot, release, due in plan:
            assert release <= slot < due and i == done[name]
            done[name] += 1
            assert all(abs(done[n] - share[n] * (slot + 1) / 60) < 1 for n in share)


def test_mix(spark):
    rows = [(i, "abc"[i % 3 if i % 2 else 0]) for i in range(900)] + [(None, "a"), (3, "a"), (3, "a"), (901, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, position int").repartition(3)
    out = sorted(mixing.mix(df, {"a": 2, "b": 1, "c": 1}, block=4, period=32).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(len(rows)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    share = [sum(r["source"] == "a" for r in out[:n]) / n for n in (128, 256)]
    # The null source has one document only; then "a" has two of four shares.
    assert all(abs(s - 0.5) < 0.07 for s in share)
    ordered = mixing.in_mixed_order(df).collect()
    assert len(ordered) == len(rows) and mixing.mix(df.limit(0)).collect() == []
    assert [r["position"] for r in ordered] == sorted(r["position"] for r in ordered)


def furthest(out, weights):
    """Blocks of one document that a source is away from its weight at most, until one runs out."""
    held, taken, worst = Counter(r["source"] for r in out), Counter(), 0
    for n, r in enumerate(sorted(out, key=lambda r: r["position"]), 1):
        taken[r["source"]] += 1
        worst = max(worst, *(abs(taken[s] - w * n) for s, w in weights.items()))
        if taken[r["source"]] == held[r["source"]]:
            return worst


@pytest.mark.parametrize(
    "weights, each",
    [
        ({"a": 2, "b": 1}, {"a": 1400, "b": 700}),
        ({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1400, "b": 400, "c": 200}),
        ({"a": Fraction(1, 3), **{f"s{i}": Fraction(2, 189) for i in range(63)}}, {"a": 400, **{f"s{i}": 13 for i in range(63)}}),
        (None, {"a": 1000, "b": 501, "c": 77, "d": 3}),
        (None, {"a": 900, "b": 400}),
    ],
)
def test_prefixes_follow_the_weights(spark, monkeypatch, weights, each):
    rows = [(k, s) for k, s in enumerate(s for s, n in each.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()} if weights else {s: math.sqrt(n) for s, n in each.items()}
    total = sum(exact.values())
    out = mixing.mix(df, weights, block=1).collect()
    assert furthest(out, {s: w / total for s, w in exact.items()}) < 1
    assert sorted(r["position"] for r in out) == list(range(len(rows))) and len({r["slot"] for r in out}) == len(rows)
    # A long schedule comes in pieces, and the length of the stretches changes nothing.
    monkeypatch.setattr(mixing, "MOST_HELD", 300)
    assert sorted(mixing.mix(df, weights, block=1, period=100).collect()) == sorted(out)


def test_mix_of_many_sources(spark):
    df = spark.createDataFrame([(k, f"host {k % 5000}") for k in range(6000)], "doc_id long, source string")
    out = mixing.mix(df, block=1).collect()
    assert sorted(r["position"] for r in out) == list(range(6000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
