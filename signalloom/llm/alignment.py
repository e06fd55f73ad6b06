"""Alignment of two tokenizers by an as-of merge of token starts.

1. Each batch of texts is encoded by both tokenizers; its tokens are rows (document, start, number). For every token
   start, ``merge_asof`` by document finds the other side's last token that starts at or before it, the covering one.
   The union of both directions holds every overlapping pair, since of two overlapping tokens the later start lies in
   the other token; pairs with equal starts come from both and count once. Equal ends cut the tokens into groups.
2. A batch becomes one row: facts of its documents, the distinct id pairs with their counts, and the links of each
   document as numbers into these pairs. Only distinct pairs of a batch are shuffled, not links.
3. Counts of pairs are added up over all batches; the highest count of each B id needs a row per vocabulary entry.
4. The totals of its pairs go back to each batch, which adds them up over the links of its documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import materialize, pack, unpack

# Bytes of text in a batch. A longer text is a batch of its own.
BATCH_BYTES = 2 << 20
# B ids are below this, so that a pair of ids is one long.
WIDTH = 1 << 31

# Fixed value: how a byte-level tokenizer with its regular expression switched on cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FACTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters stand for themselves,
    the other bytes in turn for the code points from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _piece_bytes(piece: str) -> bytes:
    found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()


@dataclass
class TokenizerPair:
    """The contents of both tokenizer files; tasks build the encoders from them once per worker."""

    byte_level: str
    pieces: bytes

    @classmethod
    def load(cls, byte_level_path: str, pieces_path: str) -> "TokenizerPair":
        with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
            return cls(a.read(), b.read())

    def byte_level_encoder(self):
        """(function from texts to id lists, bytes of each id) of the byte-level tokenizer.

        Where the ids follow the order of the merges, they are ranks, and the merges by rank of tiktoken give the same
        ids several times faster; any other file goes to the tokenizers library.
        """
        letters, spec = byte_letters(), json.loads(self.byte_level)
        special = {t["id"]: t["content"] for t in spec.get("added_tokens") or [] if t.get("special")}
        vocabulary = {i: t for t, i in spec["model"]["vocab"].items() if i not in special}
        table = {i: bytes(letters[c] for c in t) for i, t in vocabulary.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"].get(a + b) for a, b in merges]
        ranked = (
            None not in ids and ids == sorted(set(ids)) and min(ids, default=256) >= 256 and len(table) == 256 + len(ids)
            and not spec["model"].get("ignore_merges") and spec["normalizer"] is None
            and spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex")
            and not spec["pre_tokenizer"].get("add_prefix_space")
        )
        if ranked:
            import tiktoken

            encoding = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks={b: i for i, b in table.items()}, special_tokens={})
            return (lambda texts: [encoding.encode_ordinary(t) for t in texts]), table
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(self.byte_level)
        whole.encode_special_tokens = True
        return (lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]), table

    def piece_encoder(self):
        """(function from texts to id lists, bytes of each id) of the sentencepiece model."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
        return (lambda texts: model.encode(texts, num_threads=1)), {i: _piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())}


_encoders: dict[str, tuple] = {}


def _encoder(pair: Broadcast):
    """The encoders of this worker."""
    key = hashlib.sha256(pair.value.pieces + pair.value.byte_level.encode()).hexdigest()
    if key not in _encoders:
        sides = []
        for encode, table in (pair.value.byte_level_encoder(), pair.value.piece_encoder()):
            entries = [table.get(i, b"") for i in range(max(table) + 1)]
            lengths = np.array([len(e) for e in entries], np.int64)
            words = [np.array([f"{i}{mark}" for i in range(len(entries))], object) for mark in ",|;"]
            sides.append((encode, entries, lengths, words))
        _encoders[key] = tuple(sides)
    return _encoders[key]


def _tokens(sides, texts: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The tokens (doc, at, id, end) of both sides, in order. ``doc`` numbers the texts, ``at`` and ``end`` are byte places
    with all texts end to end; texts whose bytes the tokens do not give back have none."""
    (encode_a, bytes_a, _, _), (encode_b, bytes_b, _, _) = sides
    spaced = [" " + t for t in texts]
    whole = [[encode_a([s])[0], encode_b([t])[0], s.encode()] if t else [[], [], b""] for s, t in zip(spaced, texts)]
    for found in whole:
        if found[2] and not all(b"".join(map(table.__getitem__, ids)) == found[2] for ids, table in zip(found, (bytes_a, bytes_b))):
            found[:] = [], [], b""
    frames = []
    for side, (_, _, lengths, _) in enumerate(sides):
        counts = [len(w[side]) for w in whole]
        ids = np.fromiter((i for w in whole for i in w[side]), np.int64, sum(counts))
        # Tokens cover a text from its first byte to its last, so ends add up over all texts.
        end = np.cumsum(lengths[ids])
        frames.append(pd.DataFrame({"doc": np.repeat(np.arange(len(whole)), counts), "at": end - lengths[ids], "id": ids, "end": end}))
    return frames[0], frames[1]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions in ``a`` and ``b`` whose tokens share a byte of one document, in the order of the text."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left = pd.DataFrame({"at": a["at"].to_numpy(), "doc": a["doc"].to_numpy(), "a": np.arange(len(a))})
    right = pd.DataFrame({"at": b["at"].to_numpy(), "doc": b["doc"].to_numpy(), "b": np.arange(len(b))})
    covering_b = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy().astype(np.int64)
    covering_a = pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy().astype(np.int64)
    # The second direction adds the B tokens that start after the A token they lie in.
    later = right["at"].to_numpy() > left["at"].to_numpy()[covering_a]
    return np.concatenate([left["a"].to_numpy(), covering_a[later]]), np.concatenate([covering_b, right["b"].to_numpy()[later]])


def groups(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each token: groups end where a token of either side does."""
    end_a, end_b = a["end"].to_numpy(), b["end"].to_numpy()
    cuts = end_a[np.isin(end_a, end_b, assume_unique=True)]
    return np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)


def _group_digests(sides, a, b, group_a, group_b, size: int) -> list[str]:
    """Per document, the digest of its groups as ``a1,a2|b1;...``; '' without tokens."""
    group, doc = np.concatenate([group_a, group_b]), np.concatenate([a["doc"].to_numpy(), b["doc"].to_numpy()])
    if not len(group):
        return [""] * size
    side = np.repeat([0, 1], [len(a), len(b)])
    ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
    order = np.argsort(group * 2 + side, kind="stable")
    group, side, ids, doc = group[order], side[order], ids[order], doc[order]
    last = np.empty(len(group), bool)
    last[-1] = True
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    words = np.empty(len(ids), object)
    for k, (_, _, _, (comma, bar, semicolon)) in enumerate(sides):
        mine = side == k
        words[mine & ~last] = comma[ids[mine & ~last]]
        words[mine & last] = (semicolon if k else bar)[ids[mine & last]]
    edges = np.searchsorted(doc, np.arange(size + 1)).tolist()
    words = words.tolist()
    texts = ("".join(words[x:y])[:-1] for x, y in zip(edges, edges[1:]))
    return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]


def _aligned(sides, ids: pa.Array, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The packed facts and links of a batch, its distinct pairs, and how many links have each."""
    size = len(texts)
    a, b = _tokens(sides, texts)
    link_a, link_b = overlaps(a, b)
    group_a, group_b = groups(a, b)
    digests = _group_digests(sides, a, b, group_a, group_b, size)
    doc = a["doc"].to_numpy()[link_a]
    at, pairs = pd.factorize(a["id"].to_numpy()[link_a] * WIDTH + b["id"].to_numpy()[link_b])
    counts = np.bincount(at, minlength=len(pairs)).astype(np.int64)
    # A document's links as the pairs that it has and how often.
    width = max(len(pairs), 1)
    held, times = np.unique(doc * width + at, return_counts=True)

    def per_doc(docs):
        return np.bincount(docs, minlength=size).astype(np.int64)

    known = np.array([i is not None for i in ids.to_pylist()])
    first_of_group = np.flatnonzero(np.diff(group_a, prepend=-1))
    facts = [
        pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), per_doc(a["doc"]), per_doc(b["doc"]),
        per_doc(a["doc"].to_numpy()[first_of_group]), per_doc(doc),
    ]
    text = np.frombuffer("".join(d or " " * 64 for d in digests).encode(), np.uint8)
    data = pack(known, *facts, text, per_doc(held // width), (held % width).astype(np.int32), times.astype(np.int32))
    return data, pairs, counts


def align(df: DataFrame, tokenizers: Broadcast, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``df``.

    Side A encodes a space and the text, side B the text, to which its model adds the space; strings of special tokens
    are plain text. Null and empty texts, and texts that the tokens of a side do not give back byte by byte, have no
    tokens: their numbers are zero and the digest is ''. Rows with null or repeated ids are rows of their own; further
    columns are not read, whatever their names. An empty table gives no rows. A text is encoded as a whole, so one
    task must hold the tokens of its longest text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, nth = _encoder(tokenizers), 0
        task = TaskContext.get().partitionId()
        held_ids, held, size = [], [], 0

        def made():
            nonlocal held_ids, held, size, nth
            data, pairs, counts = _aligned(sides, pa.array(held_ids, pa.int64()), held)
            key = (task << 32) + nth
            held_ids, held, size, nth = [], [], 0, nth + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([data], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                ["batch", "links", "pairs", "counts"],
            )

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py() or ""
                if held and size + len(t) > BATCH_BYTES:
                    yield made()
                held_ids.append(i.as_py())
                held.append(t)
                size += len(t)
        if held:
            yield made()

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    encoded = materialize(rows.mapInArrow(encode, "batch long, links binary, pairs array<long>, counts array<long>"), "aligned")
    each = encoded.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    totals = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total"))
    totals = materialize(totals, "pairs")
    # At most one row for each entry of the B vocabulary.
    best = totals.groupBy(F.pmod("pair", F.lit(WIDTH)).alias("b")).agg(F.max("total").alias("best"))
    judged = totals.join(F.broadcast(best), F.pmod("pair", F.lit(WIDTH)) == F.col("b")).select(
        "pair", "total", (F.col("total") == F.col("best")).alias("is_best")
    )
    asked = encoded.select("batch", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(judged, "pair").select(F.col("batch").alias("of"), "at", "total", "is_best")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        total, is_best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("at").to_numpy()
        total[at], is_best[at] = right.column("total").to_numpy(), right.column("is_best").to_numpy()
        for data in left.column("links").to_pylist():
            known, ids, n_a, n_b, n_groups, n_links, text, held, pair_of, times = unpack(data)
            size = len(ids)
            doc_of = np.repeat(np.arange(size), held)
            n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(n_best, doc_of, times * is_best[pair_of])
            np.add.at(count_sum, doc_of, times * total[pair_of])
            text = text.tobytes().decode()
            digests = [text[64 * k : 64 * k + 64].strip() for k in range(size)]
            facts = [pa.array(ids, mask=~known), *map(pa.array, (n_a, n_b, n_groups, n_links, n_best, count_sum, digests))]
            out.append(pa.Table.from_arrays(facts, names))
        return pa.concat_tables(out)

    names = [*FACTS, "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{n} long" for n in names[:-1]) + ", groups_sha256 string"
    return encoded.select("batch", "links").groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(tell, schema)
