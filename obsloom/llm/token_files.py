"""Token-id files: one id array per shard, document boundaries and keys as Elias-Fano sequences."""
from __future__ import annotations

import functools
import operator
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import fresh_path, stage
from .layout import NO_KEY, bounds, range_of, slices, texts
from .pieces import Pieces

MAGIC = b"EFTOKEN1"
EVERY = 64  # one select sample for so many entries


class EliasFano:
    """A non-decreasing sequence of n integers in [0, universe]: low bits packed, high bits in unary, sampled select.

    Takes n * (2 + log2(universe / n)) bits and the samples, instead of 64 n."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        lows = values & np.uint64((1 << low_bits) - 1)
        bits = (lows[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"),
                   ones[::EVERY].astype("<u4" if n and ones[-1] < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<QQBBQQQ", self.n, self.universe, self.low_bits, self.samples.dtype.itemsize, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, universe, low_bits, width, *sizes = struct.unpack_from("<QQBBQQQ", raw, at)
        at += struct.calcsize("<QQBBQQQ")
        parts = []
        for size, kind in zip(sizes, ("u1", "u1", f"<u{width}")):
            parts.append(np.frombuffer(raw[at:at + size], kind))
            at += size
        return cls(n, universe, low_bits, *parts), at

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a].reshape(-1, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Entry i: from the sample before it, a few bytes of high bits are scanned."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte, skip, span = at >> 3, at & 7, EVERY
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + span], bitorder="little")[skip:])
            if len(ones) > left:
                return (at + int(ones[left]) - i << self.low_bits) | int(self._lows(i, i + 1)[0])
            span *= 2

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        return (ones - np.arange(self.n, dtype=np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n)


def pack(keys: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One shard: header, Elias-Fano keys (nulls first), Elias-Fano ends of documents, ids of ``width`` bytes."""
    nulls = sum(k is None for k in keys)
    real = np.array(keys[nulls:], np.int64)
    base = int(real[0]) if len(real) else 0
    parts = EliasFano.build((real - base).view(np.uint64)), EliasFano.build(np.cumsum(lengths, dtype=np.uint64) if lengths else [])
    return MAGIC + struct.pack("<QqB", nulls, base, width) + parts[0].to_bytes() + parts[1].to_bytes() + ids


class Shard:
    """Reads what ``pack`` wrote; a document is found by two selects, without a table of offsets."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(raw)
        self.nulls, self.base, self.width = struct.unpack_from("<QqB", raw, 8)
        self.keys, at = EliasFano.from_bytes(view, 8 + struct.calcsize("<QqB"))
        self.ends, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view[at:], f"<u{self.width}")

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.all().view(np.int64) + self.base).tolist()


class WordTokenizer:
    """The tokenizers library over words. Its normaliser, pre-tokeniser and merges never look across a space or a line end, and not
    across a full stop or comma after a letter; so the ids of a text are those of its words, and each new word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cores, self.words = Pieces(self._encode, 700_000), Pieces(self._words, 1_000_000)

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Plain Latin words go to the library a hundred to a text; each is one pre-token, so the ids that end a word tell them apart."""
        kind, out = f"<u{self.width}", {}
        plain, alone = [], []
        for w in words:
            (plain if w.isalpha() and (w.isascii() or max(w) < "\u0100") else alone).append(w)
        some = [plain[i:i + 100] for i in range(0, len(plain), 100)]
        for group, e in zip(some, self.model.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
            ids = np.array(e.ids, kind)
            cuts = (np.flatnonzero(self.final[ids]) + 1).tolist()
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                alone += group
                continue
            raw, size = ids.tobytes(), self.width
            out.update(zip(group, [raw[a * size:b * size] for a, b in zip([0, *cuts], cuts)]))
        out.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(alone, self.model.encode_batch_fast(alone, add_special_tokens=False)))
        return out

    def _words(self, words: list[str]) -> dict[str, bytes]:
        whole, forms, ended, heads, tails = [], [], [], [], []
        for w in words:
            if w.isalpha():
                whole.append(w)
                forms.append(w.lower() if w.isascii() else w)
                continue
            core = w.rstrip(".,")
            if core and core != w and core[-1].isalpha():
                ended.append(w)
                heads.append(core.lower() if core.isascii() else core)
                tails.append(w[len(core):])
            else:
                whole.append(w)
                forms.append(w)
        ids = self.cores.each(forms + heads + tails)
        first, last = len(forms), len(forms) + len(heads)
        out = dict(zip(whole, ids))
        out.update(zip(ended, map(operator.add, ids[first:last], ids[last:])))
        return out

    def encode(self, values: list[str]) -> list[bytes]:
        return self.words.join([v.replace("\n", " ").split(" ") for v in values])


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def open_folder(path: str):
    """(file system, path below it) of a folder that may be local, in HDFS or in an object store."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, shard_bytes: int = 24 << 20) -> DataFrame:
    """Writes the ids of every text and ``end_id``, in ascending doc_id order (nulls first, ties by text), as token files.

    Returns the manifest (shard, file, n_docs, n_tokens, start). Shards are doc_id ranges; a task streams one sorted range into one
    file under a name of its own, so a repeated task writes a new file and the manifest names the one that counts. A null or empty
    text is just ``end_id``; an empty table gives an empty manifest."""
    spark = docs.sparkSession
    folder = (folder or fresh_path(spark, "tokens")).replace("file:///", "/", 1)
    plain = texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(NO_KEY)))
    total = plain.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-total // shard_bytes))
    cuts = bounds(plain.select("_key"), "_key", parts)
    if not cuts:
        return spark.createDataFrame([], "shard int, file string, n_docs long, n_tokens long, start long")
    rows = plain.withColumn("_shard", range_of("_key", cuts))
    rows = rows.repartitionById(len(cuts), F.col("_shard")).sortWithinPartitions("_key", "text").select("_shard", "doc_id", "text")

    def work(batches):
        own, keys, lengths, ids, shard = tokenizer(path), [], [], [], None
        end = end_id.to_bytes(own.width, "little")
        for batch, values in slices(batches):
            shard = batch.column(0)[0].as_py()
            keys += batch.column(1).to_pylist()
            for x in own.encode(values):
                ids += x, end
                lengths.append(len(x) // own.width + 1)
        if shard is None:
            return
        where, top = open_folder(folder)
        where.create_dir(top, recursive=True)
        name = f"{top}/shard-{shard:07d}-{uuid.uuid4().hex}.eft"
        with where.open_output_stream(name) as out:
            out.write(pack(keys, lengths, b"".join(ids), own.width))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name.rpartition("/")[2], "n_docs": len(keys), "n_tokens": sum(lengths)}],
                                         pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    made = stage(rows.mapInArrow(work, "shard int, file string, n_docs long, n_tokens long"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return made.select("shard", F.concat(F.lit(folder + "/"), "file").alias("file"), "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))


def read(manifest: DataFrame, parallel: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone: offsets by select on the boundaries."""
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                where, name = open_folder(row["file"])
                with where.open_input_stream(name) as f:
                    shard = Shard(f.read())
                keys = shard.doc_ids()
                starts, lengths, sums, before = [], [], [], 0
                for i in range(len(shard)):
                    end = shard.ends.select(i)
                    starts.append(row["start"] + before)
                    lengths.append(end - before)
                    sums.append(zlib.crc32(shard.ids[before:end].astype("<u4").tobytes()))
                    before = end
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("file", "start").repartition(parallel or max(1, manifest.count()))
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
