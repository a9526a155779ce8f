"""Exact dedup by an extendible-hash index kept as files in the shared folder."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from .layout import NO_KEY, range_of, texts

BITS = 62  # of the hash that the directory may use
STEP = 4  # bits by which one round of counting can deepen a bucket


def local_copies(docs: DataFrame, hold_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Folds equal texts of an input partition before anything is shuffled.

    Returns staged (representatives, members): a representative is one text of a partition with its largest doc_id and row count, a
    member is a row with the id of its representative. Memory is bounded: at ``hold_bytes`` of texts the fold starts afresh, which only
    leaves more representatives. Nulls in doc_id sort lowest and stay."""
    plain = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 64 - BITS)).withColumn("part", F.spark_partition_id())
    schema = pa.schema([("rep", pa.int64()), ("h", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("size", pa.int64())])

    def work(batches):
        held: dict[str, list] = {}
        size = serial = 0

        def flush():
            rows = [{"rep": r, "h": h, "text": t, "doc_id": None, "best": best, "n": n, "size": len(t.encode())} for t, (r, h, best, n) in held.items()]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k:k + 256], schema)

        for batch in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            members = []
            for row in batch.to_pylist():
                key = NO_KEY if row["doc_id"] is None else row["doc_id"]
                mine = held.get(row["text"])
                if mine is None:
                    mine = held[row["text"]] = [row["part"] << 40 | serial, row["h"], key, 0]
                    serial += 1
                    size += len(row["text"])
                mine[2], mine[3] = max(mine[2], key), mine[3] + 1
                members.append({"rep": mine[0], "h": None, "text": None, "doc_id": row["doc_id"], "best": None, "n": None, "size": None})
            yield pa.RecordBatch.from_pylist(members, schema)
            if size > hold_bytes:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    both = stage(plain.mapInArrow(work, "rep long, h long, text string, doc_id long, best long, n long, size long"))
    return both.where("n is not null").select("rep", "h", "text", "best", "n", "size"), both.where("n is null").select("rep", "doc_id")


def directory(reps: DataFrame, bucket_bytes: int) -> list[tuple[int, int]]:
    """Buckets of an extendible hash as (prefix, depth), in key order: a bucket over ``bucket_bytes`` is split by doubling.

    Each round counts bytes below the overfull buckets STEP bits deeper, so a bucket is read once for STEP doublings. A bucket that
    holds one hash value alone (copies, collisions) is not split further: it is chained. The directory has about as many entries
    as the index has files; no key reaches the driver."""
    leaves, open_, depth = [], {0}, 0
    sized = reps.select("h", "size")
    while open_:
        depth += STEP
        prefix = F.shiftright("h", BITS - depth)
        # below an open bucket: its parent prefix is among the open ones; closed buckets were cut off in earlier rounds
        near = sized if depth == STEP else sized.join(F.broadcast(reps.sparkSession.createDataFrame([(p,) for p in sorted(open_)], "p long")),
                                                      F.shiftright("h", BITS - depth + STEP) == F.col("p"), "left_semi")
        found = {r[0]: (r[1], r[2]) for r in near.groupBy(prefix.alias("p")).agg(F.sum("size"), F.min("h") == F.max("h")).collect()}
        deeper = set()
        for parent in open_:
            stack = [(parent, depth - STEP)]
            while stack:
                p, d = stack.pop()
                shift = depth - d
                inside = [found[c] for c in range(p << shift, p + 1 << shift) if c in found]
                size = sum(x[0] for x in inside)
                if not inside:
                    continue
                if size <= bucket_bytes or d == BITS:
                    leaves.append((p, d))
                elif d < depth:
                    stack += [(p << 1, d + 1), (p << 1 | 1, d + 1)]
                elif inside[0][1]:
                    leaves.append((p, d))
                else:
                    deeper.add(p)
        open_ = deeper
    return sorted(leaves, key=lambda x: x[0] << BITS - x[1])


def build_index(reps: DataFrame, bucket_bytes: int) -> DataFrame:
    """Index files (owner, h, chain, rep, best, n, text_sha256): an owner task takes a run of directory slots, sorts its keys by hash and gives equal hashes
    a chain number for each different text, by comparing bytes."""
    leaves = directory(reps, bucket_bytes)
    starts = [p << BITS - d for p, d in leaves]
    if not starts:
        return reps.sparkSession.createDataFrame([], "owner int, h long, chain int, rep long, best long, n long, text_sha256 string")
    rows = reps.withColumn("text_sha256", F.sha2("text", 256)).withColumn("owner", range_of("h", starts)).repartitionById(len(starts), F.col("owner"))
    schema = pa.schema([("owner", pa.int32()), ("h", pa.int64()), ("chain", pa.int32()), ("rep", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("text_sha256", pa.string())])

    def work(batches):
        last, chain = None, []
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            out = []
            for row in batch.to_pylist():
                if row["h"] != last:
                    last, chain = row["h"], []
                if row["text"] not in chain:
                    chain.append(row["text"])
                out.append({k: row[k] for k in ("owner", "h", "rep", "best", "n", "text_sha256")} | {"chain": chain.index(row["text"])})
            yield pa.RecordBatch.from_pylist(out, schema)

    ordered = rows.sortWithinPartitions("owner", "h").select("owner", "h", "text", "rep", "best", "n", "text_sha256")
    return stage(ordered.mapInArrow(work, "owner int, h long, chain int, rep long, best long, n long, text_sha256 string"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when their bytes are; a null text is the empty one. Of equal texts the row with the largest doc_id stays (null is lowest);
    of rows that share that doc_id and text, all carry kept = true, as no column tells them apart. An empty table gives an empty one."""
    plain = texts(docs, key, text)
    reps, members = local_copies(plain)
    index = build_index(reps, bucket_bytes)
    groups = index.groupBy("owner", "h", "chain").agg(F.max("best").alias("keep"), F.sum("n").alias("group_size"))
    resolved = index.select("owner", "h", "chain", "rep", "text_sha256").join(groups, ["owner", "h", "chain"]).select("rep", "keep", "group_size", "text_sha256")
    own = F.coalesce("doc_id", F.lit(NO_KEY))
    return members.join(resolved, "rep").select(
        "doc_id", F.when(F.col("keep") != NO_KEY, F.col("keep")).alias("keep_id"), "group_size", (own == F.col("keep")).alias("kept"), "text_sha256")
