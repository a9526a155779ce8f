"""SimHash fingerprints linked within a Hamming radius by meet-in-the-middle ball hashing."""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from ..runtime import stage
from .layout import slices, texts

BITS = 64
SEED = 42


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; zero without words."""
    import xxhash
    parts = text.encode().lower().split()  # splits at x20 and x09 to x0D, lowers ASCII only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(parts) - words + 1
    for at in range(0, n, 1 << 16):
        end = min(n, at + (1 << 16))
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:end].tolist(), ends[at + words - 1:end + words - 1].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(total * 2 > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a signed long."""
    def work(batches):
        for batch, values in slices(batches):
            fps = np.array([fingerprint(v, words) for v in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(work, "doc_id long, fp long")


def masks(bits: int, flips: int) -> np.ndarray:
    """All words of at most ``flips`` set bits among the lowest ``bits``."""
    out = [sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in itertools.combinations(range(bits), k)]
    return np.array(out, np.uint64)


def _cell(fps: np.ndarray, left: np.ndarray, bits: int, tables: dict, most: int, radius: int):
    """Links among the fingerprints of one cell of the variant space: (a, b) index pairs, b in the cell's spanning forest under a.

    ``left`` is how many of the lowest ``bits`` bits a fingerprint may still flip. A cell of more than ``most`` variants is cut by
    its next bits, so memory stays bounded whatever the group of near copies."""
    sizes = np.array([len(tables.setdefault((bits, t), masks(bits, t))) for t in range(int(left.max()) + 1)])
    if sizes[left].sum() > most and bits > 8:
        step = 4
        top = fps >> np.uint64(bits - step) & np.uint64((1 << step) - 1)
        for sub in range(1 << step):
            flips = np.bitwise_count(top ^ np.uint64(sub)).astype(np.int64)
            here = np.flatnonzero(flips <= left)
            if len(here) > 1:
                for a, b in _cell(fps[here], left[here] - flips[here], bits - step, tables, most, radius):
                    yield here[a], here[b]
        return
    low = fps & np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for t in range(len(sizes)):
        here = np.flatnonzero(left == t)
        if len(here):
            variants.append((low[here][:, None] ^ tables[bits, t]).ravel())
            owners.append(np.repeat(here.astype(np.int32), sizes[t]))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    same = variants[1:] == variants[:-1]
    if not same.any():
        return
    start = np.flatnonzero(np.concatenate([[True], ~same]))  # a run is one variant; its smallest owner is the hub
    run = np.cumsum(np.concatenate([[False], ~same]))
    hub = np.minimum.reduceat(owners, start)[run]
    pair = np.unique((hub.astype(np.int64) << 32 | owners)[hub != owners])
    a, b = pair >> 32, pair & 0xFFFFFFFF
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    a, b = a[near], b[near]
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    yield label[moved], moved


def links(distinct: DataFrame, n: int, radius: int = 4, cell_variants: int = 1 << 21) -> DataFrame:
    """(src, dst) links that connect what pairs within ``radius`` bits connect, from distinct fingerprints (fp).

    Meet in the middle: every fingerprint emits all variants within radius / 2 flips, and two are within the radius exactly when they share one
    (``radius`` must be even). The variants are shuffled by their first ``b`` bits. As
    all variants of a fingerprint in one cell of that shuffle follow from it, one row (cell, fp) stands for them there: 1 + b + b(b-1)/2 rows
    instead of 2 081 travel, and the owner of the cell unfolds, sorts and dedupes the variants. Two members of one variant are at
    most ``radius`` apart, which is verified, so a variant's members hang on its smallest one and no pairs of a group are made; each
    cell returns a spanning forest."""
    if radius % 2:
        raise ValueError("radius must be even")
    half = radius // 2
    whole = sum(math.comb(BITS, k) for k in range(half + 1))
    b = max(6, math.ceil(math.log2(max(1, n * whole / cell_variants))))
    flips = [int(m) for m in masks(b, half)]
    prefix = F.shiftrightunsigned("fp", BITS - b)
    rows = distinct.select("fp", F.explode(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda m: prefix.bitwiseXOR(m))).alias("cell"))
    rows = rows.repartition(max(8, min(1 << b, n * len(flips) // 100_000 + 8)), "cell").sortWithinPartitions("cell")

    def work(batches):
        tables: dict = {}

        def close(cell, fps):
            fps = np.concatenate(fps).view(np.uint64)
            left = half - np.bitwise_count(fps >> np.uint64(BITS - b) ^ np.uint64(cell)).astype(np.int64)
            found = list(_cell(fps, left, BITS - b, tables, cell_variants, radius)) if len(fps) > 1 else []
            if found:
                a, c = (np.concatenate(x) for x in zip(*found))
                # forests join members of one variant through others of their tree; the hub pairs themselves were within the radius
                yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[c].view(np.int64))], ["src", "dst"])

        now, held = None, []
        for batch in batches:
            cells, fps = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for part, first in zip(np.split(fps, cuts), [0, *cuts.tolist()]):
                if len(part) and cells[first] != now:
                    if held:
                        yield from close(now, held)
                    now, held = int(cells[first]), []
                held.append(part)
        if held:
            yield from close(now, held)

    return rows.mapInArrow(work, "src long, dst long").distinct()


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): the smallest doc_id reachable over links of at most ``radius`` differing bits.

    A text without words (null, empty, white space) has fingerprint zero and is linked like any other. Repeated rows stay; a null doc_id
    is in a component but never names one, unless it is alone (null then). An empty table gives an empty one."""
    marked = stage(fingerprints(docs, words))
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = distinct.count()
    edges = stage(links(distinct.select("fp"), n, radius))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    label = components(nodes, edges).select(F.col("node").alias("fp"), "component")
    joined = distinct.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    table = joined.join(lowest, "component").select("fp", "component_id")
    return marked.join(table, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
