"""Near copies by Jaccard likeness of word shingles: SimHash blocks matched by ball hashing give candidates, shingle sets decide."""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from ..runtime import stage
from .layout import slices, small_side, texts
from .simhash_ball import SEED

CHECK = 128  # leading bits of a signature, compared inside a cell; the blocks follow
SMALL = 128  # members of a variant up to which all its pairs are compared at once; larger ones have leaders
SPREAD = 5.0  # standard deviations by which a pair at the bound may exceed its expected Hamming distance
FALSE = 4096  # unlike candidates a text may meet in all blocks before its check bits are compared
COUNTERS = 1 << 20  # shingle counts by hash, which order the shingles of a crowd from rare to common
PARITY = 512  # bits of a set's parity map, which bounds from below by how many shingles two sets differ
PARITY_ROWS = 500_000  # parity maps that go to every executor, about 50 MB there; more are joined by a shuffle
AT_ONCE = 1 << 16  # pairs, and rows of whole shingles, that a task compares at a time
MEETINGS = 4  # pairs a row of a rare shingle may have before some of its pairs go first
GAIN = 0.1  # share of its pairs that a round of some must spare to be followed by another one
NEAR, CHAIN = range(2)  # two texts that may be alike; two leaders of a large variant, which are not


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; a shorter text is one shingle, one without words has none."""
    import xxhash
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - words + 1
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1:].tolist())), np.uint64, n))


def signature(hashes: np.ndarray, wide: int) -> np.ndarray:
    """SimHash of ``wide`` 64-bit words over a set of hashes; all zero for the empty set."""
    total = np.zeros(64 * wide, np.int64)
    salt = np.arange(1, wide + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):
        h = hashes[at:at + 255, None] ^ salt  # one digest a shingle; the words come from it by mixing
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        total += np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")


def plan(n: int, least: float, recall: float) -> tuple[int, int, float]:
    """(bits a block, blocks, share of bits that differ at likeness ``least``) for ``n`` texts.

    Sets of one size with Jaccard s have cosine 2s / (1 + s), unequal ones more. Blocks grow with the texts, so that unlike ones
    seldom meet, and their number follows from ``recall``: some block must differ by at most two bits."""
    q = math.acos(2 * least / (1 + least)) / math.pi
    for bits in range(16, 49, 2):
        meets = sum(math.comb(bits, k) * q ** k * (1 - q) ** (bits - k) for k in range(3))
        blocks = math.ceil(math.log(1 - recall) / math.log(1 - meets))
        if n * blocks * sum(math.comb(bits, k) for k in range(3)) / 2 ** bits <= FALSE:
            break
    return bits, blocks, q


def _most(bits: int, q: float) -> int:
    return math.floor(bits * q + SPREAD * math.sqrt(bits * q * (1 - q)))


def _runs(value: np.ndarray, left: np.ndarray, low_bits: int):
    """(owner, start, size): members of each variant that several of a cell share, ascending within the variant."""
    low = value & np.int64((1 << low_bits) - 1)
    may = np.flatnonzero(left == 1)
    flips = np.int64(1) << np.arange(low_bits, dtype=np.int64)
    variant = np.concatenate([low, (low[may][:, None] ^ flips).ravel()])
    owner = np.concatenate([np.arange(len(value)), np.repeat(may, low_bits)])
    order = np.lexsort((owner, variant))
    variant, owner = variant[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    size = np.diff(np.concatenate([start, [len(owner)]]))
    return owner, start[size > 1], size[size > 1]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of edges (a < b) that connect what all of them connect, a small number of the nodes each: first every node's edge to its
    smallest neighbour, then edges between the trees so far, until none is left."""
    order = np.lexsort((b, a))
    label, chosen, left = np.arange(n), [], order
    while len(left):
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, low, high = left[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        if not len(left):
            break
        _, first = np.unique(high, return_index=True)  # each tree but the lowest takes one edge to a lower one, so no ring closes
        chosen.append(left[first])
        root = np.arange(n)
        root[high[first]] = low[first]
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def _found(check: np.ndarray, runs, most: int):
    """(a, b, kind) of a cell: a forest over the near pairs of small variants; leaders with their followers and the next leader in large ones."""
    owner, start, size = runs

    def differ(a, b):
        return np.bitwise_count(check[a] ^ check[b]).sum(axis=-1)

    small, pairs = size <= SMALL, []
    for d in range(1, int(size[small].max(initial=1))):
        has = start[small][size[small] > d]
        reps = size[small][size[small] > d] - d
        at = np.repeat(has, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        a, b = owner[at], owner[at + d]
        near = differ(a, b) <= most
        pairs.append(np.unique(a[near].astype(np.int64) << 32 | b[near]))
    if pairs:
        pair = np.unique(np.concatenate(pairs))
        a, b = pair >> 32, pair & 0xFFFFFFFF
        kept = _forest(a, b, len(check))
        yield a[kept], b[kept], np.full(len(kept), NEAR)
    for s, m in zip(start[~small].tolist(), size[~small].tolist()):
        members, last = owner[s:s + m], None
        while len(members):
            lead, rest = members[0], members[1:]
            near = differ(rest, lead) <= most
            yield np.full(int(near.sum()), lead), rest[near], np.full(int(near.sum()), NEAR)
            if last is not None:
                yield np.array([last]), np.array([lead]), np.array([CHAIN])
            last, members = lead, rest[~near]


def candidates(signs: DataFrame, n: int, bits: int, blocks: int, most: int, cell_variants: int = 1 << 20) -> DataFrame:
    """(src, dst, kind), src < dst: nodes of ``signs`` (node, sign) that share a block up to two flips and agree in the check bits.

    A block's value and its one-flip variants are shuffled by block and first ``p`` bits, where 1 + p rows stand for the 1 + ``bits``
    variants. A cell gives a forest over its near pairs, not all of them: where a pair of the forest turns out unlike, ``regrouped``
    compares the groups on both sides."""
    p = min(bits - 8, max(2, math.ceil(math.log2(max(1, n * (1 + bits) / cell_variants)))))
    power = np.int64(1) << np.arange(bits, dtype=np.int64)
    masks = np.array([0, *(1 << i for i in range(p))], np.int64)
    names = ["cell", "value", "check0", "check1", "node"]

    def spread(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
                check = sign[:, :CHECK // 64].astype(np.uint64).view(np.int64)
                flat = np.unpackbits(sign.view(np.uint8), axis=1, bitorder="little")
                for k in range(blocks):
                    value = flat[:, CHECK + k * bits:CHECK + (k + 1) * bits].astype(np.int64) @ power
                    cell = (np.int64(k << p) | (value >> (bits - p))[:, None] ^ masks).ravel()
                    each = [np.repeat(x, len(masks)) for x in (value, check[:, 0], check[:, 1], batch.column(0).to_numpy())]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, each)], names)

    def work(batches):
        def close(cell, held):
            value, check0, check1, node = (np.concatenate(x) for x in zip(*held))
            if len(node) < 2:
                return
            order = np.argsort(node)
            value, node, check = value[order], node[order], np.column_stack([check0, check1])[order].view(np.uint64)
            left = 1 - np.bitwise_count(value >> (bits - p) ^ (cell & (1 << p) - 1)).astype(np.int64)
            found = list(_found(check, _runs(value, left, bits - p), most))
            if found:
                a, b, kind = (np.concatenate(x).astype(np.int64) for x in zip(*found))
                first = np.unique(np.stack([a, b, kind]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(node[first[0]]), pa.array(node[first[1]]), pa.array(first[2])], ["src", "dst", "kind"])

        now, held = None, []
        for batch in batches:
            cells, *rest = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and cells[a] != now:
                    if held:
                        yield from close(now, held)
                    now, held = int(cells[a]), []
                held.append([x[a:b] for x in rest])
        if held:
            yield from close(now, held)

    rows = signs.mapInArrow(spread, ", ".join(f"{c} long" for c in names))
    parts = max(8, min(blocks << p, n * blocks * (1 + p) // 200_000 + 8))
    found = rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(work, "src long, dst long, kind long")
    return found.groupBy("src", "dst").agg(F.max("kind").alias("kind"))


def parity(hashes: np.ndarray) -> np.ndarray:
    """``PARITY`` bits: whether an odd number of the set's shingles falls on each. Two maps differ in at most as many bits as their sets in shingles."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def rare_shingles(open_nodes: DataFrame, plain: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, hashes, bits), the shingle sets of ``open_nodes`` (node, ...) and their parity maps, and (shingle, node, n, place), the first
    shingles of each set.

    Sets with Jaccard ``least`` share a shingle among their first ones in any order of all shingles, as many as a set can lose plus
    one. Common shingles come last (by counters shared by hash, so the order is the same everywhere): what a crowd has in common, a
    licence or a template, is not among the first, and its members meet only through what is rare."""
    held = plain.join(small_side(open_nodes.select("node")), "node", "left_semi").select("node", "text").dropDuplicates(["node"])

    def sets(batches):
        for batch, values in slices(batches):
            made = [shingles(v, words) for v in values]
            each = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (made, map(parity, made))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *each], ["node", "hashes", "bits"])

    hashed = stage(held.mapInArrow(sets, "node long, hashes binary, bits binary"))

    def tally(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(total, np.frombuffer(raw.as_py(), np.uint64).astype(np.int64) & (COUNTERS - 1), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    common = np.zeros(COUNTERS, np.int64)
    for r in hashed.select("hashes").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toLocalIterator():
        common[r["slot"]] = r["n"]

    def first_ones(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, out = batch.slice(at, 512), []
                for node, raw in zip(part.column(0).to_pylist(), part.column(1)):
                    h = np.frombuffer(raw.as_py(), np.uint64).view(np.int64)
                    n = len(h)
                    h = h[np.lexsort((h, common[h & (COUNTERS - 1)]))][:n - math.ceil(least * n - 1e-9) + 1]
                    out.append((h, np.full(len(h), node), np.full(len(h), n), np.arange(len(h))))
                cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["shingle", "node", "n", "place"])

    return hashed, stage(hashed.select("node", "hashes").mapInArrow(first_ones, "shingle long, node long, n long, place long"))


def _whole(batches, key: int = 0):
    """Lists of columns that hold whole shingles, ``AT_ONCE`` rows or more at a time, of batches sorted by shingle; binary ones as 64-bit words."""
    def columns(batch):
        return [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = columns(batch)
        held.append(own)
        rows += batch.num_rows
        if rows >= AT_ONCE and own[key][0] != own[key][-1]:
            cut = int(np.searchsorted(own[key], own[key][-1]))
            yield [np.concatenate([*x[:-1], x[-1][:cut]]) for x in zip(*held)]
            held, rows = [[c[cut:] for c in own]], len(own[0]) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _shingle_runs(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    return start, np.diff(np.concatenate([start, [len(shingle)]]))


def _may(i: np.ndarray, j: np.ndarray, grp, n, place, bits, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows (i, j) of different groups that by sizes, places and parity maps may have Jaccard ``least``; none that has it is lost."""
    both = n[i] + n[j]
    top = np.minimum(n[i] - place[i], n[j] - place[j])
    ok = (grp[i] != grp[j]) & (top * (1 + least) >= least * both - 1e-6)
    i, j, both = i[ok], j[ok], both[ok]
    ok = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= both * (1 - least) / (1 + least) + 1e-6
    return i[ok], j[ok]


def _possible(shingle, grp, n, place, bits, least: float):
    """(i, j), i < j: pairs of rows of one shingle that ``_may`` lets pass, for whole shingles; at most ``AT_ONCE`` pairs are looked at together."""
    start, size = _shingle_runs(shingle)
    small = size <= SMALL
    for d in range(1, int(size[small].max(initial=1))):
        far = size[small] > d
        first, reps = start[small][far], size[small][far] - d
        i = np.repeat(first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        for at in range(0, len(i), AT_ONCE):
            yield _may(i[at:at + AT_ONCE], i[at:at + AT_ONCE] + d, grp, n, place, bits, least)
    for s, m in zip(start[~small].tolist(), size[~small].tolist()):
        for i in range(s, s + m - 1):
            for at in range(i + 1, s + m, AT_ONCE):
                j = np.arange(at, min(at + AT_ONCE, s + m))
                yield _may(np.full(len(j), i), j, grp, n, place, bits, least)


def _by_shingle(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("shingle", "node", "grp", *names).repartition("shingle").sortWithinPartitions("shingle", "grp", "node")


def _across(rare: DataFrame, groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Rows of ``rare`` with the group and the parity map of their node and ``pairs``, how many rows after them in their shingle may be alike and
    are of another group; rows without such a pair are left out. A shingle is brought together once for it."""
    def shared(batches):
        for shingle, *rest in _whole(batches):
            start, size = _shingle_runs(shingle)
            grp = rest[1]
            keep = np.repeat(grp[start] != grp[start + size - 1], size)  # groups ascend within a shingle
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (shingle, *rest)], ["shingle", "node", "grp", "n", "place"])

    def tally(batches):
        for shingle, node, grp, n, place, bits in _whole(batches):
            pairs, met = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
            for i, j in _possible(shingle, grp, n, place, bits, least):
                np.add.at(pairs, i, 1)
                met[i] = met[j] = True
            if met.any():
                each = [c[met] for c in (shingle, node, grp, n, place, pairs)]
                raw = pa.array([x.tobytes() for x in bits[met]], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, each), raw], ["shingle", "node", "grp", "n", "place", "pairs", "bits"])

    maps, names = sets.select("node", "bits"), ("n", "place")
    rows = _by_shingle(rare.join(small_side(groups), "node"), *names).mapInArrow(shared, "shingle long, node long, grp long, n long, place long")
    if maps.count() <= PARITY_ROWS:  # such a join leaves the rows in their places
        rows = rows.join(F.broadcast(maps), "node").select("shingle", "node", "grp", *names, "bits")
    else:
        rows = _by_shingle(rows.join(maps.hint("shuffle_hash"), "node"), *names, "bits")
    return rows.mapInArrow(tally, "shingle long, node long, grp long, n long, place long, pairs long, bits binary")


def _crossing(rows: DataFrame) -> tuple[int, int]:
    """How many pairs of different groups may be alike, all shingles together, and how many rows they come from."""
    r = rows.agg(F.sum("pairs").alias("pairs"), F.count("*").alias("n")).first()
    return int(r["pairs"] or 0), int(r["n"])


def meetings(rows: DataFrame, least: float, every: bool) -> DataFrame:
    """(src, dst): pairs of different groups that share a shingle and by sizes, places and parity maps may have Jaccard ``least``.

    All of them, or in proportion to the rows: each group's first member with the group before it and with a member of the largest
    group of the shingle, another one from shingle to shingle."""
    def some(shingle, *own):
        for s, m in zip(*(x.tolist() for x in _shingle_runs(shingle))):
            grp = own[0][s:s + m]
            first = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            size = np.diff(np.concatenate([first, [m]]))
            big = int(size.argmax())
            mid = int(first[big]) + int(shingle[s]) % int(size[big])
            yield _may(s + np.concatenate([first[1:] - 1, np.full(len(first), mid)]), s + np.concatenate([first[1:], first]), *own, least)

    def batch(node, found):
        i, j = (node[np.concatenate(x)] for x in zip(*found))
        pair = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["src", "dst"])

    def meet(batches):
        for shingle, node, *own in _whole(batches):
            found, n = [], 0
            for pair in _possible(shingle, *own, least) if every else some(shingle, *own):
                found.append(pair)
                n += len(pair[0])
                if n >= 8 * AT_ONCE:
                    yield batch(node, found)
                    found, n = [], 0
            if n:
                yield batch(node, found)

    return _by_shingle(rows, "n", "place", "bits").mapInArrow(meet, "src long, dst long").distinct()


def regrouped(open_nodes: DataFrame, plain: DataFrame, words: int, least: float) -> DataFrame:
    """(src, dst): pairs of different groups among ``open_nodes`` (node, grp) whose shingle sets by sizes and places alone may have Jaccard ``least``."""
    sets, rare = rare_shingles(open_nodes, plain, words, least)
    blank = sets.select("node", F.lit(bytes(PARITY // 8)).alias("bits"))
    return meetings(_across(rare, open_nodes.select("node", "grp"), blank, least), least, True)


def links_across(open_nodes: DataFrame, plain: DataFrame, words: int, least: float) -> DataFrame:
    """(src, dst): links that connect all groups of ``open_nodes`` (node, grp) which any pair with Jaccard ``least`` connects.

    While far more pairs may be alike than rows meet, and a round cuts them by a tenth, some pairs in proportion to the rows are judged and the
    groups they link are made one, whose members need not meet any more; then all pairs that are left are judged."""
    sets, rare = rare_shingles(open_nodes, plain, words, least)
    groups, found, before, rows = open_nodes.select("node", "grp"), [], None, rare
    while True:
        rows = stage(_across(rows.select(*rare.columns), groups, sets, least))
        pairs, n = _crossing(rows)
        if not pairs:
            break
        every = pairs <= MEETINGS * n or before is not None and pairs > (1 - GAIN) * before
        links, before = judged(meetings(rows, least, every), sets, least), pairs
        found.append(links)
        if every:
            break
        joined = links.join(groups.select(F.col("node").alias("src"), F.col("grp").alias("a")), "src").join(groups.select(F.col("node").alias("dst"), F.col("grp").alias("b")), "dst")
        label = _labels(stage(joined.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()))
        groups = stage(groups.join(label, F.col("grp") == label["node"], "left").select(groups["node"], F.coalesce("component", "grp").alias("grp")))
    none = open_nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
    return reduce(DataFrame.union, found, none)


def _of(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return table.select(F.col("node").alias(key), F.col(value).alias(name))


def judged(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingle sets in ``sets`` (node, hashes) have Jaccard ``least`` or more."""
    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(_of(sets, "src", "hashes", "a"), "src").join(_of(sets, "dst", "hashes", "b"), "dst").select("src", "dst", "a", "b")
    return stage(joined.mapInArrow(judge, "src long, dst long"))


def alike(pairs: DataFrame, signs: DataFrame, plain: DataFrame, words: int, least: float, most: int) -> DataFrame:
    """The pairs whose whole signatures differ by ``most`` bits at most and whose shingle sets have Jaccard ``least`` or more."""
    def near(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(a ^ b).sum(axis=1) <= most))

    def sets(batches):
        for batch, values in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(v, words).tobytes() for v in values], pa.binary())], ["node", "hashes"])

    close = pairs.select("src", "dst").join(_of(signs, "src", "sign", "a"), "src").join(_of(signs, "dst", "sign", "b"), "dst").select("src", "dst", "a", "b")
    close = stage(close.mapInArrow(near, "src long, dst long"))
    used = small_side(stage(close.select(F.col("src").alias("node")).union(close.select("dst")).distinct()))
    table = stage(plain.join(used, "node", "left_semi").dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node long, hashes binary"))
    return judged(close, table, least)


def _labels(edges: DataFrame) -> DataFrame:
    return components(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges)


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over pairs whose shingle sets have Jaccard ``least`` or more.

    Every link is judged on the sets (64-bit hashes of shingles), so texts below ``least`` are never linked themselves. A pair just at ``least``
    is met with probability ``recall``, likelier ones more often. Texts that meet are first compared along a forest, a pair or a few for
    each text; where a pair of it turns out unlike, the members of the groups on both sides are compared through their rarest
    shingles, so no pair is left out for its crowd and a crowd that only shares a template is not compared pair by pair.
    Equal texts (64-bit hash) are one node. Texts without words are like each other only. Repeated rows stay; a null doc_id is in a
    component but never names one, unless it is alone (null then). An empty table gives an empty one. A very long text costs memory in
    proportion to its distinct shingles; columns other than doc_id and text, whatever their names, are not read."""
    plain = texts(docs).select("doc_id", F.xxhash64("text").alias("node"), "text")
    n = plain.count()
    bits, blocks, q = plan(n, least, recall)
    wide = -(-(CHECK + bits * blocks) // 64)

    def sign(batches):
        for batch, values in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([signature(shingles(v, words), wide).tobytes() for v in values], pa.binary())],
                                             ["doc_id", "node", "sign"])

    marked = stage(plain.mapInArrow(sign, "doc_id long, node long, sign binary"))
    signs = stage(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("sign").alias("sign")))
    pairs = stage(candidates(signs.select("node", "sign"), n, bits, blocks, _most(CHECK, q)))
    edges = alike(pairs.where(F.col("kind") < CHAIN), signs, plain, words, least, _most(64 * wide, q))
    label = _labels(edges)
    def named(side):
        return label.select(F.col("node").alias(side), F.col("component").alias(f"grp_{side}"))

    ends = pairs.join(named("src"), "src", "left").join(named("dst"), "dst", "left").select(
        F.coalesce("grp_src", "src").alias("a"), F.coalesce("grp_dst", "dst").alias("b")).where("a <> b")
    apart = stage(ends.select(F.col("a").alias("grp")).union(ends.select("b")).distinct())
    if not apart.isEmpty():
        every = signs.select("node").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("grp"))
        more = links_across(stage(every.join(apart, "grp", "left_semi").select("node", "grp")), plain, words, least)
        label = _labels(edges.union(more))
    joined = signs.select("node", "first").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked.select("doc_id", "node").join(joined.join(lowest, "component").select("node", "component_id"), "node").select("doc_id", "component_id")
