"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file."""
from __future__ import annotations

import base64
import functools
import gc
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .layout import slices, texts
from .pieces import Pieces

# White space of the pre-token pattern (Unicode White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def byte_letters() -> str:
    """One visible character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a tiktoken rank file in the order of their ranks, which must run from 0 without a gap."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A ModelProto: byte-mapped pieces scored by negative rank (ids are ranks, the unknown piece follows), identity normaliser."""
    letters = byte_letters()
    pieces = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(rank))) for rank, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(tokens))  # model type BPE
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to little-endian 32-bit ids and back."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.find = regex.compile(pattern).findall
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.pieces = [bytes(byte_of[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.pieces)}  # a pre-token that is itself a piece is one id
        self.four = [struct.pack("<I", i) for i in range(len(tokens))]
        self.unsafe = [c + " " for c in SPACES]
        self.unsafe_ascii = [c for c in self.unsafe if c.isascii()]
        self.first, self.later = Pieces(self._words, 50_000), Pieces(lambda words: self._words(words, " "), 300_000)

    def _words(self, words: list[str], before: str = "") -> dict[str, bytes]:
        found = [self.find(before + w) for w in words]
        known, rest = {}, []
        for token in set().union(*found):
            raw = token.encode()
            if raw in self.whole:
                known[token] = self.whole[raw]
            else:
                rest.append((token, raw.decode("latin-1").translate(self.letters)))
        for (token, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1) if rest else []):
            known[token] = b"".join(map(self.four.__getitem__, ids))
        return {w: b"".join(map(known.__getitem__, tokens)) for w, tokens in zip(words, found)}

    def encode(self, values: list[str]) -> list[bytes]:
        """The pattern never joins a space to a non-space before it, so a text is cut at its spaces and words are looked up one by
        one. A text with a space after other white space is matched as a whole."""
        heads, tails, whole = [], [], {}
        for i, value in enumerate(values):
            if any(s in value for s in (self.unsafe_ascii if value.isascii() else self.unsafe)):
                whole[i] = self._words([value])[value]
                heads.append([])
                tails.append([])
            else:
                words = value.split(" ")
                heads.append(words[:1])
                tails.append(words[1:])
        heads, tails = self.first.join(heads), self.later.join(tails)
        return [whole.get(i, heads[i] + tails[i]) for i in range(len(values))]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, one row per row of ``docs``.

    A null or empty text has no ids; repeated rows and null doc_ids stay; other columns are left out; an empty table gives an empty
    one. ``path`` is a rank file that every executor can open, ``pattern`` splits pre-tokens."""
    def work(batches):
        own = codec(path, pattern)
        for batch, values in slices(batches):
            ids = own.encode(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                             ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to (doc_id, n_tokens, ids) by the inverse of the model's pieces; null ids give null."""
    def work(batches):
        own = codec(path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                out = [None if x is None else own.decode(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``encode`` and ``decode`` in one pass, so that a task needs one worker with one word table.

    ``keep``: the worker holds model and table for its next task. Without it a task builds them anew and leaves nothing behind, for
    jobs whose workers go on to other work."""
    def work(batches):
        own = codec(path, pattern) if keep else Codec(path, pattern)
        for batch, values in slices(batches):
            ids = own.encode(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
        if not keep:
            del own
            gc.collect()  # the tables and the codec refer to each other

    return texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the round trip; ``keep`` as there."""
    return round_trip(docs, path, pattern, keep).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
