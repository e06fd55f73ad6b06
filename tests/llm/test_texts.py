"""Pieces, repeats, near copies and toxicity against libraries, brute force and small known cases."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from signalloom.llm import jaccard_join, pieces, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, ids string, score string, kept string"


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def table(spark, texts):
    """Rows with ids, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA).repartition(3)


def test_pieces_equal_the_library(model, library):
    rng = random.Random(5)
    signs = list("ab \n\t▁  ehing012日本語😀é\x00�<s>") + ["the ", " and", "    ", "ß"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert model.encode(text).tolist() == library.encode(text)
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)
    for text in (" " * 40 + "a", "a" * 1000, "word " * 3000, "zß" * 999):
        assert model.encode(text).tolist() == library.encode(text)


def test_pieces_of_a_small_model_without_bytes():
    tiny = pieces.PieceModel(["<unk>", "a", "b", "ab", "aba"], [0, -1, -1, -2, -1], [2, 1, 1, 1, 1], False)
    assert tiny.merge(list("ababa")) == ["aba", "b", "a"] and tiny.encode("ababa").tolist() == [4, 2, 1]
    assert tiny.encode("xxa").tolist() == [0, 1]
    with pytest.raises(ValueError):
        pieces.PieceModel(["<unk>", "a"], [0, 0], [2, 4], False)


def test_piece_columns(spark, model, library):
    sent = spark.sparkContext.broadcast(model)
    rows = [(1, None), (2, ""), (3, "over there"), (3, "over there"), (None, "x" * 50_000)]
    out = pieces.decode_ids(pieces.encode_texts(table(spark, rows), sent), sent).collect()
    assert len(out) == 5
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") and r["score"] == "y"
    empty = pieces.encode_texts(table(spark, rows).limit(0), sent)
    assert empty.collect() == [] and empty.columns[-1] == "ids"


def removed(rows, length=50):
    first = {}
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in texts:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def test_cover_has_every_difference():
    n = suffix_dedup.MODULUS
    assert {(a - b) % n for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(n))


@pytest.mark.parametrize("chunk_bytes", [3 << 20, 700])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk_bytes)
    rng = random.Random(9)
    words = ["ein", "zwei", "drü", "vier", "fünf", "日本"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, exact = line(40), line(30)
    cut = passage.encode()[11:61].decode("utf-8", "ignore")
    rows = [(5, passage), (6, line(9) + passage + line(7)), (7, exact), (8, exact), (9, exact[:49]), (10, None), (11, ""), (12, "a" * 400),
            (13, "b" + "a" * 120 + "c" + "a" * 49), (14, passage[3:60] + "|" + cut + "|" + exact), (-4, "q" + passage[:80]), (15, "x\0" * 60), (16, "\0x" * 40)]
    rows += [(20 + k, line(rng.randint(1, 60)) + (passage[k : k + 55] if k % 3 else "") + line(5)) for k in range(25)]
    want = removed(rows)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, rows), 50).collect()}
    assert set(got) == set(want)
    for i, (size, runs, digest) in want.items():
        r = got[i]
        assert (sum(s["size"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) == (size, runs, digest), i
        assert r["ids"] == "x"


def test_repeats_of_odd_tables(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(None, text), (1, text), (1, text)]
    out = suffix_dedup.remove_repeats(table(spark, rows), 50).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in out) == [(0, 0), (1, len(text)), (1, len(text))]
    assert suffix_dedup.remove_repeats(table(spark, rows).limit(0), 50).collect() == []
    assert [len(r["spans"]) for r in suffix_dedup.remove_repeats(table(spark, [(1, None), (2, "a")]), 50).collect()] == [0, 0]


def linked(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_similar_documents_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "oNE  TWO"), (6, "one"), (7, "É é"), (8, "é é")]
    for size in (8, 14, 22, 27, 40, 90, 200):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for k in range(9):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            copy = copy[rng.choice([0, 0, 1]) :] + [rng.choice(vocabulary)] * rng.choice([0, 0, 1])
            rows.append((len(rows) * 7 % 101 + 1000 * len(rows), " ".join(copy)))
    got = jaccard_join.join_similar(table(spark, rows), words, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == linked(rows, words, percent)


@pytest.mark.parametrize("percent, sizes, light", [(85, {6: 100, 7: 5}, 8), (80, {4: 100, 5: 10}, 6)])
def test_short_documents_equal_brute_force(spark, percent, sizes, light):
    assert jaccard_join.choose_boundary(sizes, percent) == light
    rows = []
    for size, number in sizes.items():
        for k in range(number):
            # Neighbours share all words but the first or the last one.
            words = [f"v{k // 5}x{i}" for i in range(size)]
            if k % 5:
                words[-(k % 2)] = f"own{size}x{k}"
            rows.append((len(rows) * 7 % 11 + 100 * len(rows), " ".join(words)))
    got = jaccard_join.join_similar(table(spark, rows), 1, percent)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == linked(rows, 1, percent)


def test_similar_documents_of_odd_tables(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F")]
    out = sorted(((r[0] or 0, r[2]) for r in jaccard_join.join_similar(table(spark, rows)).collect()), key=str)
    assert out == [(0, None), (3, 3), (3, 3), (9, 3)]
    assert jaccard_join.join_similar(table(spark, rows).limit(0)).collect() == []


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(4)
    x, y, z = ([f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(3))
    rows = [(5, x), (5, y), (6, [*x, "more"]), (9, [*y, "more"]), (11, z), (11, [*z, "more"]), (None, x), (None, y), (12, [])]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = Counter((r[0], r[2]) for r in jaccard_join.join_similar(table(spark, rows), 4, 85).collect())
    assert got == Counter([(5, 5), (5, 5), (6, 5), (9, 5), (11, 11), (11, 11), (None, None), (None, None), (12, 12)])
    first = jaccard_join.first_of_groups(table(spark, rows), 5, 80)
    assert first.columns == ["doc_id", "text", "ids", "score", "kept"]
    kept = {(r["doc_id"], r["text"]) for r in first.collect()}
    assert first.count() == 6 and {rows[0], rows[1], rows[6], rows[7], rows[8]} < kept and kept & {rows[4], rows[5]}


def test_links_without_broadcast_joins(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 4000]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(words)
            words[rng.randrange(len(words))] = "other"
            rows.append((len(rows) * 7 % 113 + 1000 * len(rows), " ".join(words)))
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard_join.join_similar(table(spark, rows), 4, 85).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert {r[0]: (r[1], r[2]) for r in got} == linked(rows, 4, 85)


def test_filter_of_nodes_keeps_them_all(spark, monkeypatch):
    base = spark.range(5000).select(F.col("id").alias("node"), F.lit("t").alias("text"))
    nodes = base.filter("node % 7 = 0").select("node")
    found = jaccard_join._possible(base, nodes)
    assert found.columns == ["node", "text"] and nodes.subtract(found.select("node")).count() == 0 and found.count() < 800
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 64)
    assert jaccard_join._possible(base, nodes).count() == 5000


def test_boundary_follows_the_costs():
    assert jaccard_join.choose_boundary({}, 85) == 0
    assert jaccard_join.choose_boundary({300: 1000}, 85) == 0
    assert jaccard_join.choose_boundary({5: 1000}, 85) >= 5
    assert jaccard_join.subset_sizes(5, 5, 85) == [5]


def test_folding():
    assert toxicity.fold("ÏD1ОT").split() == toxicity.fold("idiot").split()
    assert toxicity.fold(None).split() == [] and toxicity.fold("l0ser​").split() == toxicity.fold("loser").split()


def test_folding_reaches_all_planes():
    def shifted(first):
        return "".join(chr(first + ord(x) - ord("a")) for x in "idiot")

    # Mathematical bold, script and sans-serif, squared, negative circled and squared, regional, circled letters.
    for first in (0x1D400, 0x1D41A, 0x1D4D0, 0x1D5BA, 0x1F130, 0x1F150, 0x1F170, 0x1F1E6, 0x24B6, 0x24D0):
        assert toxicity.fold(shifted(first)).split() == toxicity.fold("idiot").split(), hex(first)
    assert toxicity.fold("id\U000e0001\U000e0101iot").split() == toxicity.fold("idiot").split()
    assert toxicity.fold("so \U0001f600 \U00020000").split() == ["so", "\U00020000"]


def test_toxicity(spark):
    rng = random.Random(2)
    calm = ["house", "river", "stone", "cloud", "garden", "window", "paper", "scumble"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [rng.choice(calm) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["vile", "v1le", "grubworm", "grubw0rms"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    known = spark.createDataFrame(labels + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    documents = table(spark, rows + [(1000, None), (1001, ""), (1002, "river " * 5000), (None, "a vile house")])
    lexicon = toxicity.learn(documents, known)
    assert 0 < len(lexicon.weights) <= 3000
    out = {r["doc_id"]: r for r in toxicity.score_texts(documents, lexicon).collect()}
    assert len(out) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    wrong = [i for i, _, toxic in labels if out[i]["predicted"] != toxic]
    assert len(wrong) <= 4
    assert out[1000]["predicted"] == out[1001]["predicted"] == out[1002]["predicted"] == 0 and out[None]["predicted"] == 1


def test_toxicity_without_labels(spark):
    documents = table(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_texts(documents, toxicity.learn(documents, none)).collect()
    assert [r["predicted"] for r in out] == [0, 0]


def test_exceptions_spare_hits():
    lexicon = toxicity.Lexicon({" " + toxicity.fold("scum").strip(): 3.0}, [f" {toxicity.fold('scumble').strip()} "], (0.0, 1.0, 0.0))
    assert lexicon.hits(toxicity.fold("a scum here")) and not lexicon.hits(toxicity.fold("a scumble here"))
