"""Alignment of tokenizers against a plain version that looks at every pair of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from signalloom.llm import alignment
from signalloom.llm.catalog import BYTE_LEVEL, piece_model_path

MIXED = ["", None, " ", "  two  spaces ", "<|endoftext|> and <s>", "naïve café 日本語 🙂🙂", "▁ marks", "\x00\x01\t\n\r\n", "Don't we're 1234567890", "é", "a" * 3000, "<0x41>"]


def plain(rows):
    a = Tokenizer.from_file(piece_model_path(BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    letters = alignment.byte_letters()

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found, links = [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a, parts_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [b_bytes(i) for i in ids_b]
        if text and not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            ids_a, ids_b, parts_a, parts_b = [], [], [], []
        spans = []
        for ids, parts in ((ids_a, parts_a), (ids_b, parts_b)):
            at, side = 0, []
            for i, p in zip(ids, parts):
                side.append((at, at + len(p), i))
                at += len(p)
            spans.append(side)
        pairs = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        cut, start = [], 0
        for end in ends:
            cut.append("|".join(",".join(str(t[2]) for t in side if start <= t[0] and t[1] <= end) for side in spans))
            start = end
        links.update(pairs)
        found.append((doc, ids_a, ids_b, cut, pairs))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (
            (
                doc, len(x), len(y), len(cut), len(pairs), sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs),
                hashlib.sha256(";".join(cut).encode()).hexdigest() if cut else "",
            )
            for doc, x, y, cut, pairs in found
        ),
        key=str,
    )


@pytest.fixture(scope="module")
def pair(spark):
    return spark.sparkContext.broadcast(alignment.TokenizerPair.load(piece_model_path(BYTE_LEVEL), piece_model_path()))


@pytest.mark.parametrize("size", [1, 700, 4 << 20])
def test_alignment_equals_plain_version(spark, pair, size, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", size)
    pick = random.Random(7)
    words = ["signal", "loom", "Überraschung", "データ", "x1", "...", "👍🏽", "\t", "über", "the", "of", "don't"]
    rows = list(enumerate(MIXED)) + [(k, " ".join(pick.choices(words, k=pick.randrange(1, 60)))) for k in range(20, 70)]
    rows += [(None, "no id"), (3, "id again"), (3, "id again")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_a int").repartition(4)
    got = sorted((tuple(r) for r in alignment.align(df, pair).collect()), key=str)
    assert got == plain(rows)
    assert any(r[1] == 0 for r in got) and any(r[3] for r in got)


def test_texts_that_tokens_do_not_give_back(spark, pair):
    # The mark of the model stands for a space, so a text that holds it cannot come back.
    df = spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, pair).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "") and got[2][0] > 0
    assert alignment.align(df.limit(0), pair).collect() == []


def test_overlaps_equal_all_pairs():
    rng = np.random.default_rng(5)

    def side(total):
        ends = np.concatenate([o + np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n - 1), replace=False)), n) for o, n in total])
        docs = np.concatenate([[k] * int(((ends > o) & (ends <= o + n)).sum()) for k, (o, n) in enumerate(total)])
        return pd.DataFrame({"doc": docs, "at": np.concatenate([[0], ends[:-1]]), "id": 0, "end": ends})

    for _ in range(20):
        total = [(0, 30), (30, 7), (37, 50)]
        a, b = side(total), side(total)
        want = {(i, j) for i, x in enumerate(a.itertuples()) for j, y in enumerate(b.itertuples()) if x.at < y.end and y.at < x.end}
        found = list(zip(*(x.tolist() for x in alignment.overlaps(a, b))))
        assert len(found) == len(set(found)) and set(found) == want


def test_both_engines_give_the_same_ids():
    loaded = alignment.TokenizerPair.load(piece_model_path(BYTE_LEVEL), piece_model_path())
    fast, _ = loaded.byte_level_encoder()
    slow = Tokenizer.from_str(loaded.byte_level)
    slow.encode_special_tokens = True
    texts = [" " + t for t in MIXED if t] + [" " + "".join(random.Random(k).choices("ab \n'sé日🙂1<|> 　", k=400)) for k in range(300)]
    assert fast(texts) == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
