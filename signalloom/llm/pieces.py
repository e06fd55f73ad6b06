"""Merge-type (BPE) SentencePiece encoding with a prefix table, and decoding.

For every prefix of a text there is one last token of its encoding. An automaton gives all tokens that end at a
position; the right one is that whose left neighbour, the last token of the prefix before it, stays apart from it when
the two are merged on their own. The table holds the length of that token, and the ids are read off it from the end.

The merge order (score, then leftmost) restricted to two neighbouring tokens is the order inside the whole text up to
the first merge across them. So a sequence is an encoding if and only if each neighbouring pair is, which makes the
pair test exact.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from signalloom.llm.common import append_columns

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# Entries that a Python worker remembers before it starts anew. They bound memory and do not change results; a model
# that shares its workers with other work can be given less in ``most_words`` and ``most_pairs``.
REMEMBERED_WORDS = 250_000
REMEMBERED_PAIRS = 200_000


class PieceModel:
    """Vocabulary of a merge-type model; small enough to broadcast, since a vocabulary does not grow with the data."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], kinds: Sequence[int], dummy_prefix: bool):
        unknown = set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}
        if unknown:
            raise ValueError(f"piece types {sorted(unknown)} are not supported")
        self.pieces, self.scores, self.kinds, self.dummy_prefix = list(pieces), list(scores), list(kinds), dummy_prefix
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        self.unknown_id = kinds.index(UNKNOWN)
        if len(self.byte_ids) not in (0, 256):
            raise ValueError("byte pieces must be complete or absent")
        self.reachable = [p for p in self.ids if len(p) > 1 and self.merge(list(p)) == [p]]
        self.most_words, self.most_pairs = REMEMBERED_WORDS, REMEMBERED_PAIRS
        self._ready = False

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rule = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only merge-type models are supported")
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("only models that keep texts as they are are supported")
        return cls(
            [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], rule.add_dummy_prefix
        )

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready = False

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols: best score first, then leftmost."""
        ids, scores = self.ids, self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _prepare(self) -> None:
        self._automaton = ahocorasick.Automaton()
        for piece in self.reachable:
            self._automaton.add_word(piece, piece)
        self._any = bool(self.reachable)
        if self._any:
            self._automaton.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        inner = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:]))
        # Characters of no longer piece stand alone, and without pieces that go on after a word, words are independent.
        known = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        if inner:
            self._cut = re.compile(f"[{SPACE}{known}]+|[^{SPACE}{known}]" if known else ".", re.DOTALL)
        elif known:
            self._cut = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{SPACE}{known}]")
        else:
            self._cut = re.compile(f"{SPACE}+|[^{SPACE}]")
        self._controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self._words: dict[str, bytes] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._bytes = [
            b"" if k == CONTROL
            else bytes([int(p[1:-1], 16)]) if k == BYTE
            else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self._ready = True

    def _apart(self, key: tuple[str, str]) -> bool:
        if len(self._pairs) >= self.most_pairs:
            self._pairs.clear()
        found = self._pairs[key] = self.merge(list(key[0] + key[1])) == list(key)
        return found

    def _tokens(self, word: str) -> list[str]:
        """Tokens of a stretch by the prefix table.

        Exactly one token can end a prefix, so a character stands for itself where no longer match fits.
        """
        n = len(word)
        last = [""] + list(word)
        pairs, done = self._pairs, 0
        for at, piece in self._automaton.iter(word) if self._any else ():
            if at == done - 1:
                continue
            start = at + 1 - len(piece)
            if start:
                key = (last[start], piece)
                fits = pairs.get(key)
                if fits is None:
                    fits = self._apart(key)
                if not fits:
                    continue
            last[at + 1] = piece
            done = at + 1
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _word(self, word: str) -> bytes:
        out: list[int] = []
        for token in self._tokens(word):
            found = self.ids.get(token)
            if found is not None:
                out.append(found)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in token.encode())
            else:
                out.append(self.unknown_id)
        return array("i", out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or an empty one."""
        if not self._ready:
            self._prepare()
        if not text:
            return np.empty(0, np.int32)
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        words, parts = self._words, []
        for word in self._cut.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= 64:
                    if len(words) >= self.most_words:
                        words.clear()
                    words[word] = ids
            parts.append(ids)
        ids = np.frombuffer(b"".join(parts), np.int32)
        if not self.byte_ids and len(ids):
            # A run of unknown characters is one piece.
            unknown = ids == self.unknown_id
            ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids. Bytes that are no UTF-8 become U+FFFD one by one; the added leading space goes."""
        if not self._ready:
            self._prepare()
        ids = list(ids)
        strip = 0
        if self.dummy_prefix:
            for i in ids:
                if self.kinds[i] != CONTROL:
                    strip = int(self.kinds[i] == NORMAL and self.pieces[i].startswith(SPACE))
                    break
        parts, start = [], 0
        for end in [at for at, i in enumerate(ids) if i in self._controls] + [len(ids)]:
            # Bytes on both sides of a control piece do not form one character.
            joined = b"".join(map(self._bytes.__getitem__, ids[start:end]))
            try:
                parts.append(joined.decode())
            except UnicodeDecodeError:
                parts.append(_decode_loosely(joined))
            start = end
        return "".join(parts)[strip:]


def _decode_loosely(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


def encode_texts(df: DataFrame, model: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of ``text`` as ``ids``; a null or empty text has none.

    Rows are independent, so nothing is shuffled and repeated rows, ties and an empty table need no care. All other
    columns stay; one that is called like ``ids`` is replaced.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_ids(batch.column(batch.schema.get_field_index(text)), model.value)]

    return append_columns(df, [StructField(ids, ArrayType(IntegerType()))], run)


def decode_ids(df: DataFrame, model: Broadcast, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of the token ids as ``text``; a null list gives a null text, an empty one an empty text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(batch.schema.get_field_index(ids))
        return [_texts(lists, model.value)]

    return append_columns(df, [StructField(text, StringType())], run)


def round_trip(df: DataFrame, model: Broadcast, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode_texts`` and ``decode_ids`` of its ids in one pass, in one worker per task."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = _ids(batch.column(batch.schema.get_field_index(text)), model.value)
        return [lists, _texts(lists, model.value)]

    return append_columns(df, [StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())], run)


def _ids(texts: pa.Array, model: PieceModel) -> pa.ListArray:
    found = [model.encode(t.as_py()) for t in texts]
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    values = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _texts(lists: pa.ListArray, model: PieceModel) -> pa.Array:
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    valid = lists.is_valid().to_pylist()
    out = [model.decode(values[ends[i] : ends[i + 1]].tolist()) if valid[i] else None for i in range(len(lists))]
    return pa.array(out, pa.string())
