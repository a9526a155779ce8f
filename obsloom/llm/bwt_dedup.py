"""Removal of repeated byte strings through merged Burrows-Wheeler transforms.

Three passes over staged blocks of whole texts. (1) Every window of LENGTH bytes names an anchor, the GRAM bytes of least hash inside it; equal
windows name equal anchors, so only windows whose anchor occurs twice can repeat. (2) The text under consecutive windows of one anchor
is a chunk; chunks travel to the owner of their anchor, equal chunks of a block once. (3) An owner builds the transforms of two shards of the
chunks that differ, merges them by interleave refinement, and reads from the block boundaries which windows share LENGTH bytes."""
from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import fresh_path
from .layout import NO_KEY, slices, texts

GRAM = 32
PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_LOW = np.uint64((1 << 24) - 1)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _ODD)), np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INV))])


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram`` bytes, from prefix sums."""
    n = len(raw)
    powers, back = _powers(PIECE + 4096) if n <= PIECE + 4096 else _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    h = (prefix[gram:] - prefix[:-gram]) * back[1:n - gram + 2]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(blob: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor, none across documents: (anchor hash, first window, number of windows)."""
    n = len(blob)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    out = []
    for at in range(0, n - window + 1, PIECE):
        raw = blob[at:at + PIECE + window - 1]
        hashes = gram_hashes(raw)
        own = (sliding_min(hashes & ~_LOW | np.arange(len(hashes), dtype=np.uint64), window - GRAM + 1) & _LOW).astype(np.int64)
        m = len(own)
        own[doc[at:at + m] != doc[at + window - 1:at + window - 1 + m]] = -1
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(first, m))
        good = own[first] >= 0
        out.append((hashes[own[first[good]]], first[good] + at, count[good]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a shard by their first ``depth`` codes, by doubling; then by place. Runs over zero end marks are harmless."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i:i + n]
    order = np.argsort(key, kind="stable")
    have = 8
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[:-have] = rank[have:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        have *= 2


def transform(codes: np.ndarray, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, Burrows-Wheeler transform) of strings that each end in code 0. End marks rank by their string's place; before a
    string's first code stands its end mark."""
    order = suffix_order(codes, depth)
    ends = codes[order] == 0
    order = np.concatenate([np.sort(order[ends]), order[~ends]])
    before = codes[order - 1].copy()
    before[np.isin(order, strings)] = 0
    return order, before


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms by refinement: (shard of each row, block of each row), rows sorted by their first ``depth`` codes.

    Round by round the rows are dealt, in the order so far, to their preceding code: sorted by k codes they come out sorted by k + 1.
    A boundary that appears in round k separates rows whose common prefix is k - 1 long, so after ``depth`` rounds a block is a repeated
    interval of ``depth`` codes. Only the shard of each row is kept; no suffix is compared again."""
    n = [len(t) for t in transforms]
    shard = np.repeat(np.array([0, 1], np.uint8), n)
    block = np.zeros(sum(n), np.int32)
    ends = [int((t == 0).sum()) for t in transforms]
    marks = np.repeat(np.array([0, 1], np.uint8), ends)
    codes = np.empty(sum(n), np.uint8)
    edge = np.empty(sum(n), bool)
    edge[:1] = True
    for _ in range(depth):
        second = shard.view(bool)
        codes[second] = transforms[1]
        codes[~second] = transforms[0]
        order = np.argsort(codes, kind="stable")
        shard, block, codes = shard[order], block[order], codes[order]
        shard[:len(marks)] = marks
        np.not_equal(codes[1:], codes[:-1], out=edge[1:])
        edge[1:] |= block[1:] != block[:-1]
        edge[:len(marks) + 1] = True
        block = np.cumsum(edge, dtype=np.int32)
    return shard, block


def merge_shared(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``merge`` that repeats are read from: (row, block) of the suffixes that have ``depth`` codes before their end mark and share
    these with another, sorted by them. Rows of the second transform are numbered on from those of the first.

    The rounds are those of ``merge``, but each row goes on as the row of the suffix that starts one code earlier. So suffixes with too few
    codes drop out by themselves, and rows alone in their block can be left out: what is longer is alone too."""
    n = [len(t) for t in transforms]
    codes = np.concatenate(transforms)
    ends = [int((t == 0).sum()) for t in transforms]
    back, starts = [], []
    for at, t in zip((0, n[0]), transforms):
        order = np.argsort(t, kind="stable")
        to = np.empty(len(t), np.int32)  # the row of the suffix that starts one code earlier: rows by preceding code, as in every round
        to[order] = np.arange(at, at + len(t), dtype=np.int32)
        back.append(to)
        starts.append(t[order])
    back = np.concatenate(back)
    # by their first code; rows of end marks stand first in each transform
    first = np.concatenate([s[e:] for s, e in zip(starts, ends)])
    row = np.concatenate([np.arange(at + e, at + k, dtype=np.int32) for at, e, k in zip((0, n[0]), ends, n)])
    order = np.argsort(first, kind="stable")
    row, first = row[order], first[order]
    edge = np.concatenate([[True], first[1:] != first[:-1]]) if len(row) else np.zeros(0, bool)
    for turn in range(1, depth):
        if not len(row):
            break
        if turn % 4 == 0:
            shared = ~edge
            shared[:-1] |= ~edge[1:]
            row, edge = row[shared], edge[shared]
        block = np.cumsum(edge, dtype=np.int32)
        code = codes[row]
        order = np.argsort(code, kind="stable")[np.count_nonzero(code == 0):]
        row, block, code = back[row[order]], block[order], code[order]
        edge = np.empty(len(row), bool)
        edge[:1] = True
        np.not_equal(code[1:], code[:-1], out=edge[1:])
        edge[1:] |= block[1:] != block[:-1]
    shared = ~edge
    shared[:-1] |= ~edge[1:]
    return row[shared], np.cumsum(edge, dtype=np.int32)[shared]


def repeats(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that share ``window`` bytes with another: (block, string, offset), by block. ``strings`` are UTF-8 slices, so 255 does not occur."""
    half = (len(strings) + 1) // 2
    orders, bwts, where = [], [], []
    for part in (strings[:half], strings[half:]):
        sizes = np.array([len(s) + 1 for s in part], np.int64)
        starts = np.cumsum(sizes) - sizes
        # byte + 1 as a code; 0 ends a string. No UTF-8 byte is 255, so codes fit eight bits.
        codes = np.frombuffer(b"\xff".join(part) + b"\xff" if part else b"", np.uint8) + np.uint8(1)
        order, bwt = transform(codes, starts, window) if len(codes) else (np.zeros(0, np.int64), codes)
        orders.append(order)
        bwts.append(bwt)
        where.append(starts)
    row, block = merge_shared(bwts, window)
    string, offset = (np.empty(len(row), np.int64) for _ in range(2))
    for k, starts in enumerate(where):
        mine = row >= len(bwts[0]) if k else row < len(bwts[0])
        place = orders[k][row[mine] - k * len(bwts[0])]
        name = np.searchsorted(starts, place, side="right") - 1
        string[mine], offset[mine] = name + k * half, place - starts[name]
    return block, string, offset


def _keep(df: DataFrame, stem: str) -> tuple[DataFrame, str]:
    """Written to the shared folder and read again, compressed well; shuffle files of the steps before may go then."""
    spark = df.sparkSession
    path = fresh_path(spark, stem)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def _squeeze(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _blob(row: dict) -> bytes:
    """Bytes of all texts of a block row."""
    size = int(_array(row["lengths"], np.int64).sum())
    return pa.decompress(row["blob"], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, blob, doc_ids, lengths): whole texts of a partition joined to blocks of about ``block_bytes``, compressed."""
    schema = pa.schema([("block", pa.int64()), ("blob", pa.binary()), ("doc_ids", pa.binary()), ("lengths", pa.binary())])

    def work(batches):
        keys, values, size, part, serial = [], [], 0, 0, 0

        def close():
            return pa.RecordBatch.from_pylist([{"block": part << 32 | serial, "blob": _squeeze(b"".join(values)), "doc_ids": np.array(keys, np.int64).tobytes(),
                                                "lengths": np.array([len(v) for v in values], np.int64).tobytes()}], schema)

        for batch, found in slices(batches):
            part = batch.column(2)[0].as_py()
            for key, value in zip(batch.column(0).to_pylist(), found):
                raw = value.encode()
                if values and size + len(raw) > block_bytes:
                    yield close()
                    keys, values, size, serial = [], [], 0, serial + 1
                keys.append(NO_KEY if key is None else key)
                values.append(raw)
                size += len(raw)
        if values:
            yield close()

    return texts(docs).withColumn("part", F.spark_partition_id()).mapInArrow(work, "block long, blob binary, doc_ids binary, lengths binary")


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes & _LOW) % np.uint64(owners)).astype(np.int64)


def _array(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(raw, kind)


def anchors(staged: DataFrame, window: int, owners: int) -> DataFrame:
    """(block, hashes): of each block, the anchors that occur twice or more in the corpus."""
    def name(batches):
        schema = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("many", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                found, count = np.unique(runs(_array(_blob(row), np.uint8), _array(row["lengths"], np.int64), window)[0], return_counts=True)
                owner = _owner(found, owners)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(owners + 1))
                yield pa.RecordBatch.from_pylist([{"owner": q, "block": row["block"], "hashes": found[order[a:b]].tobytes(), "many": (count[order[a:b]] > 1).tobytes()}
                                                  for q, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a], schema)

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_array(x, np.uint64) for x in group["hashes"]]
        every, many = np.concatenate(parts), np.concatenate([_array(x, bool) for x in group["many"]])
        values, place, count = np.unique(every, return_inverse=True, return_counts=True)
        twice = count > 1
        twice[place[many]] = True
        hit = np.split(twice[place], np.cumsum([len(p) for p in parts])[:-1])
        out = [(b, p[h].tobytes()) for b, p, h in zip(group["block"], parts, hit) if h.any()]
        return pd.DataFrame(out, columns=["block", "hashes"]).astype({"block": "int64"})

    named = staged.select("block", "blob", "lengths").mapInArrow(name, "owner long, block long, hashes binary, many binary")
    return named.groupBy("owner").applyInPandas(judge, "block long, hashes binary")


_CHUNKS = "owner long, block long, serials binary, hashes binary, sizes binary, chunks binary, docs binary, rows binary, places binary, uses binary"


def chunks(staged: DataFrame, repeated: DataFrame, window: int, owners: int) -> DataFrame:
    """One row (owner, block, ...) with the different chunks of a block that an owner judges, each with its first place; and one row (null
    owner, block, uses) with the places of all its chunks."""
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.binary()) for c in _CHUNKS.split(", ")])

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, lengths, doc_ids = _blob(row), _array(row["lengths"], np.int64), _array(row["doc_ids"], np.int64)
                blob = _array(raw, np.uint8)
                wanted = np.sort(np.concatenate([_array(h, np.uint64) for h in row["found"]]))
                hashes, first, count = runs(blob, lengths, window)
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                hit = wanted[at] == hashes
                hashes, first, count = hashes[hit], first[hit], count[hit]
                starts = np.cumsum(lengths) - lengths
                doc = np.searchsorted(starts, first, side="right") - 1
                while (skip := lengths[doc] == 0).any():  # empty texts share their start with the next one
                    doc = doc + skip
                order = np.lexsort((first - starts[doc], doc, doc_ids[doc]))  # by (doc_id, place in the block, offset): first come, first kept
                serial_of: dict[bytes, int] = {}
                lead, serial = [], np.empty(len(first), np.int32)
                for i, a, size in zip(order.tolist(), first[order].tolist(), (count[order] + window - 1).tolist()):
                    text = raw[a:a + size]
                    s = serial_of.setdefault(text, len(serial_of))
                    serial[i] = s
                    if s == len(lead):
                        lead.append(i)
                lead, content = np.array(lead, np.int64), list(serial_of)
                first_here = np.zeros(len(first), bool)
                first_here[lead] = True
                uses = np.rec.fromarrays([serial, first_here, first, count], names="serial,lead,first,count").astype([("serial", "<i4"), ("lead", "?"), ("first", "<i8"), ("count", "<i4")])
                rows = [dict.fromkeys(schema.names) | {"block": row["block"], "uses": uses.tobytes()}]
                owner = _owner(hashes[lead], owners)
                by = np.argsort(owner, kind="stable")
                cuts = np.flatnonzero(np.diff(owner[by])) + 1
                for some in np.split(by, cuts):
                    i = lead[some]
                    rows.append({"owner": int(owner[some[0]]), "block": row["block"], "serials": some.astype("<i4").tobytes(), "hashes": hashes[i].tobytes(),
                                 "sizes": (count[i] + window - 1).astype("<i4").tobytes(), "chunks": _squeeze(b"".join(content[s] for s in some.tolist())),
                                 "docs": doc_ids[doc[i]].tobytes(), "rows": doc[i].astype("<i4").tobytes(), "places": (first[i] - starts[doc[i]]).tobytes(), "uses": None})
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[k:k + 64], schema)

    joined = staged.join(repeated.groupBy("block").agg(F.collect_list("hashes").alias("found")), "block")
    return joined.select("block", "blob", "doc_ids", "lengths", "found").mapInArrow(work, _CHUNKS)


def judged(rows: DataFrame, window: int) -> DataFrame:
    """(block, serials, masks): for each chunk of a block, which of its windows are repeats at its first place in that block (bit masks).

    Equal chunks of several blocks are one string; the first of its places keeps what no other string has earlier. Strings that share
    an anchor but differ go through the merged transforms."""
    wide = (window - GRAM + 1 + 7) // 8

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        blocks_, serials, names, strings, hashes = [], [], [], [], []
        index: dict[bytes, int] = {}
        for r in group.itertuples():
            at, text_of = 0, pa.decompress(r.chunks, decompressed_size=int(_array(r.sizes, "<i4").sum()), codec="zstd", asbytes=True)
            for s, h, size in zip(_array(r.serials, "<i4").tolist(), _array(r.hashes, np.uint64).tolist(), _array(r.sizes, "<i4").tolist()):
                text = text_of[at:at + size]
                at += size
                k = index.setdefault(text, len(index))
                if k == len(strings):
                    strings.append(text)
                    hashes.append(h)
                blocks_.append(r.block)
                serials.append(s)
                names.append(k)
        names, blocks_, serials = np.array(names), np.array(blocks_, np.int64), np.array(serials, np.int32)
        docs = np.concatenate([_array(x, np.int64) for x in group["docs"]])
        rows_ = np.concatenate([_array(x, "<i4") for x in group["rows"]]).astype(np.int64)
        places = np.concatenate([_array(x, np.int64) for x in group["places"]])
        order = np.lexsort((places, rows_, blocks_, docs))  # documents by id, rows of one id as they lie
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lead = np.full(len(strings), len(order), np.int64)
        np.minimum.at(lead, names, rank)
        lead = order[lead]  # entry at which each string occurs first
        windows = np.array([len(s) for s in strings]) - window + 1
        flag = np.zeros((len(strings), wide * 8), bool)  # repeats at the string's first place
        _, which, variants = np.unique(np.array(hashes, np.uint64), return_inverse=True, return_counts=True)
        varied = np.flatnonzero(variants[which] > 1)
        # shards of owners' strings: all strings of an anchor are judged together
        for some in _portions(varied, which, windows + window - 1):
            block, string, offset = repeats([strings[i] for i in some.tolist()], window)
            if not len(block):
                continue
            string = some[string]
            entry = lead[string]
            by = np.lexsort((places[entry] + offset, rows_[entry], blocks_[entry], docs[entry], block))
            earliest = np.concatenate([[True], block[by][1:] != block[by][:-1]])
            late = by[~earliest]
            flag[string[late], offset[late]] = True
        inside = np.arange(wide * 8) < windows[:, None]
        masks = np.where((lead[names] == np.arange(len(names)))[:, None], flag[names], True) & inside[names]
        packed = np.packbits(masks, axis=1, bitorder="little")
        by = np.argsort(blocks_, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks_[by])) + 1
        out = [(int(blocks_[i[0]]), serials[i].astype("<i4").tobytes(), packed[i].tobytes()) for i in np.split(by, cuts)]
        return pd.DataFrame(out, columns=["block", "serials", "masks"])

    return rows.where("owner is not null").drop("uses").groupBy("owner").applyInPandas(judge, "block long, serials binary, masks binary")


def _portions(varied: np.ndarray, which: np.ndarray, sizes: np.ndarray, most: int = 2 << 20):
    """``varied`` by anchor, in portions of about ``most`` bytes that keep an anchor whole."""
    varied = varied[np.argsort(which[varied], kind="stable")]
    total = np.cumsum(sizes[varied])
    at = 0
    while at < len(varied):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most)) + 1
        while end < len(varied) and which[varied[end]] == which[varied[end - 1]]:
            end += 1
        yield varied[at:end]
        at = end


def remove_repeats(docs: DataFrame, window: int = 100, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each whole text without the bytes covered by ``window`` bytes that also start earlier.

    Earlier is a smaller doc_id, or the same document and a smaller start; rows that share a doc_id count in the order they are read,
    null doc_ids before all. Strings never cross documents and are judged on the input. A null or short text keeps all it has; an empty
    table gives an empty one. ``kept`` holds the remaining bytes. ``window`` is above GRAM."""
    staged, _ = _keep(blocks(docs, block_bytes), "blocks")
    count = staged.select("block").count()
    owners = max(4, count)
    repeated, _ = _keep(anchors(staged, window, max(4, count // 8)), "anchors")
    found, _ = _keep(chunks(staged, repeated, window, owners), "chunks")
    answers, _ = _keep(judged(found, window), "answers")
    wide = (window - GRAM + 1 + 7) // 8
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, lengths, keys = _blob(row), _array(row["lengths"], np.int64), _array(row["doc_ids"], np.int64)
                cover = np.zeros(len(raw) + 1, np.int32)
                if row["uses"] is not None:
                    uses = np.frombuffer(row["uses"], [("serial", "<i4"), ("lead", "?"), ("first", "<i8"), ("count", "<i4")])
                    masks = np.zeros((int(uses["serial"].max()) + 1, wide), np.uint8)
                    for part in row["answers"]:
                        masks[_array(part["serials"], "<i4")] = _array(part["masks"], np.uint8).reshape(-1, wide)
                    again, lead = uses[~uses["lead"]], uses[uses["lead"]]
                    np.add.at(cover, again["first"], 1)
                    np.add.at(cover, again["first"] + again["count"] + window - 1, -1)
                    which, offset = np.nonzero(np.unpackbits(masks[lead["serial"]], axis=1, bitorder="little"))
                    np.add.at(cover, lead["first"][which] + offset, 1)
                    np.add.at(cover, lead["first"][which] + offset + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                out, at = [], 0
                for key, size in zip(keys.tolist(), lengths.tolist()):
                    mine = gone[at:at + size]
                    n = int(mine.sum())
                    left = np.frombuffer(raw, np.uint8, size, at)[~mine].tobytes() if n else raw[at:at + size]
                    out.append({"doc_id": None if key == NO_KEY else key, "n_bytes": size, "n_removed": n,
                                "n_spans": int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()) if n else 0, "kept": left})
                    at += size
                for k in range(0, len(out), 256):
                    yield pa.RecordBatch.from_pylist(out[k:k + 256], schema)

    replies = answers.groupBy("block").agg(F.collect_list(F.struct("serials", "masks")).alias("answers"))
    known = found.where("owner is null").select("block", "uses").join(replies, "block", "left")
    return staged.join(known, "block", "left").select("block", "blob", "doc_ids", "lengths", "uses", "answers").mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
