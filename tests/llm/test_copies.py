"""Quotient filters and exact duplicates against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from signalloom.llm import common, exact_dedup, jaccard_join
from signalloom.llm.quotient import QuotientFilter, add_up, merge

LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.mark.parametrize("bits", [1, 4, 8, 9, 20, 33, 64])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 5, 400, 5000):
        some = [rng.integers(0, 2 ** min(bits, 63), n, dtype=np.uint64) * np.uint64(2 if bits == 64 else 1) for _ in range(3)]
        filters, total = [], Counter()
        for values in some:
            values, times = add_up(values, rng.choice([1, 1, 2, 300, 2**33], n))
            total.update(dict(zip(values.tolist(), times.tolist())))
            filters.append(QuotientFilter.from_bytes(QuotientFilter.build(bits, values, times).to_bytes()))
            found, counts = filters[-1].entries()
            assert found.tolist() == values.tolist() and counts.tolist() == times.tolist()
        found, counts = merge(filters).entries()
        assert list(zip(found.tolist(), counts.tolist())) == sorted(total.items())


def test_full_quotients_shift_their_runs():
    values = np.array([0, 1, 2, 3, 4, 250, 255], np.uint64)
    made = QuotientFilter.build(8, values, np.full(7, 70_000))
    assert len(made.slots) > 1 << made.quotient_bits  # runs of large counts reach beyond the last quotient
    assert made.entries()[0].tolist() == values.tolist() and set(made.entries()[1].tolist()) == {70_000}


def plain(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = ids.index(keep)
        out += [(i, keep, len(ids), k == first, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(2)
    texts = ["A b", "a B", "É", "é", "", None, "x" * 70_000, "X" * 70_000, *(f"u{k}" for k in range(200))]
    out = [(i, pick.choice(texts)) for i in range(600)] + [(i, "Hot") for i in range(600, 900)]
    return out + [(None, "zz"), (None, "ZZ"), (None, "u3"), (3, "hello"), (3, "Hello"), (3, "other"), (2**62, "hot"), (-5, "zz")]


@pytest.mark.parametrize("bits", [64, 40, 3])
def test_duplicates_equal_brute_force(spark, rows, bits):
    df = spark.createDataFrame([(i, t, "?") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df, bits=bits).collect()), key=str) == plain(rows)


def test_duplicates_with_small_limits(spark, rows, monkeypatch):
    for name, value in (("BROADCAST_FINGERPRINTS", 0), ("RANGE_ROWS", 50), ("HELD", 60), ("HEAVY_SHARE", 20)):
        monkeypatch.setattr(exact_dedup, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df, bits=30).collect()), key=str) == plain(rows)


def test_empty_tables_and_other_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A")], "key int, body string")
    assert exact_dedup.exact_duplicates(df.limit(0), "key", "body").collect() == []
    assert [tuple(r)[:4] for r in exact_dedup.exact_duplicates(df, "key", "body").orderBy("doc_id").collect()] == [(1, 2, 2, False), (2, 2, 2, True)]
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(df, "key", "body", bits=65)


def test_workers_give_memory_back_after_the_sets(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "shed", lambda: calls.append(len(out)))
    out = []
    for x in common.shedding(lambda batches: (b + 1 for b in batches))(iter([1, 2, 3])):
        out.append(x)
    assert out == [2, 3, 4] and calls == [3]
    wrapped = []
    monkeypatch.setattr(jaccard_join, "shedding", lambda run: wrapped.append(run.__qualname__) or run)
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "x y")], "doc_id long, text string")
    assert jaccard_join.join_similar(df, 5, 80).count() == 3
    assert {name.split(".")[0] for name in wrapped} >= {"_frequent", "_entries", "_verified"}
