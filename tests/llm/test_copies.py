"""Exact copies, near copies, repeated strings and shards against brute force."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpus_cases import make, near_classes, prose, simhash, windows_removed
from obsloom.llm import bwt_dedup, extendible, sharding, simhash_ball


def by_text(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return groups


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 3000])
def test_exact_copies(docs, none, rows, bucket_bytes):
    want = []
    for t, ids in by_text(rows).items():
        keep = max((d for d in ids if d is not None), default=None)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert sorted(map(tuple, extendible.dedup(docs, bucket_bytes=bucket_bytes).collect()), key=str) == sorted(want, key=str)
    assert extendible.dedup(none).collect() == []


def test_directory_splits_only_what_is_full(docs):
    reps, _ = extendible.local_copies(extendible.texts(docs))
    leaves = extendible.directory(reps, 3000)
    assert len(leaves) > 4 and len({d for _, d in leaves}) > 1 and sorted(leaves, key=lambda x: x[0] << 62 - x[1]) == leaves


def test_fingerprints(rows):
    assert [simhash_ball.fingerprint(t or "") for _, t in rows] == [simhash(t) for _, t in rows]


def test_near_groups(docs, none, rows):
    want = [(d, f"{f:016x}", c) for d, f, c in near_classes([(d, simhash(t)) for d, t in rows])]
    got = [tuple(r) for r in simhash_ball.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash_ball.near_groups(none).collect() == []


@pytest.mark.parametrize("cell", [1 << 21, 1 << 12])
def test_links_lose_no_pair(spark, cell):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for k in (1, 3, 4, 5):
            g = f
            for b in rnd.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(40) for b in range(a)}  # one crowd around a point
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash_ball.links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), cell_variants=cell).collect()
    place, parent = {f: i for i, f in enumerate(signed)}, list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        a, b = sorted((find(place[r.src]), find(place[r.dst])))
        parent[b] = a
    low = {c: d for d, _, c in near_classes(list(enumerate(fps)))}
    assert len(got) * 8 < len(fps) ** 2 / 2  # spanning forests of cells, not the pairs of the crowd
    assert [find(i) for i in range(len(fps))] == [c for _, _, c in near_classes(list(enumerate(fps)))] and low


def test_repeated_strings(spark, none, rows):
    single = list({d: (d, t) for d, t in rows if d is not None}.values())
    want = windows_removed(single)
    for size in (4 << 20, 2500):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in bwt_dedup.remove_repeats(make(spark, single), block_bytes=size).collect()}
        assert got == want
    assert sum(w[1] for w in want.values()) > 5000
    assert bwt_dedup.remove_repeats(none).collect() == []


def test_repeated_strings_with_null_and_shared_ids(spark):
    t = prose(random.Random(2), 60)
    got = bwt_dedup.remove_repeats(make(spark, [(None, t), (4, t), (4, t), (5, None)], 1)).collect()
    assert sorted((r.doc_id is not None, r.n_removed) for r in got) == [(False, 0), (True, 0), (True, len(t.encode())), (True, len(t.encode()))]


def test_merged_transform_equals_sorting():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    parts = [strings[:20], strings[20:]]
    bwts = []
    for part in parts:
        sizes = np.array([len(s) + 1 for s in part])
        codes = np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8) + np.uint8(1)
        bwts.append(bwt_dedup.transform(codes, np.cumsum(sizes) - sizes, 6)[1])
    shard, block = bwt_dedup.merge(bwts, 6)
    want = Counter()
    for k, part in enumerate(parts):
        for s in part:
            for i in range(len(s) - 5):
                want[s[i:i + 6], k] += 1
    found = Counter(zip(block.tolist(), shard.tolist()))
    assert Counter(want.values()) <= Counter(found.values())
    block_, string, offset = bwt_dedup.repeats(strings, 6)
    groups = defaultdict(set)
    for b, s, o in zip(block_.tolist(), string.tolist(), offset.tolist()):
        groups[b].add(strings[s][o:o + 6])
    assert all(len(g) == 1 for g in groups.values())
    every = Counter(s[i:i + 6] for s in strings for i in range(len(s) - 5))
    assert len(groups) == sum(c > 1 for c in every.values()) and len(block_) == sum(c for c in every.values() if c > 1)


def test_shards(docs, none, rows, spark):
    got = sharding.shards(docs, n_shards=7).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7 and {r.law for r in got} == {"rows"}
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    assert sharding.shards(none).collect() == []
    few = sharding.shards(make(spark, rows[:3])).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_shards_keep_copies_together_and_spread_a_hot_one(spark):
    rnd = random.Random(1)
    texts = ["hot"] * 400 + [f"g{i}" for i in range(60) for _ in range(4)] + [prose(rnd, 9) for _ in range(560)]
    got = sharding.shards(make(spark, list(enumerate(texts))), n_shards=12).collect()
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
    assert len(homes["hot"]) <= 8 and sum(len(homes[f"g{i}"]) > 1 for i in range(60)) <= 2


def test_only_rows_that_may_repeat_go_on():
    """The narrowed merge gives the blocks of the whole one, for windows that strings hold and another string shares."""
    rng = np.random.default_rng(4)
    strings = [bytes(rng.choice([97, 98], rng.integers(0, 60)).astype(np.uint8)) for _ in range(40)] + [b"a" * 30, b"a" * 25, b""]
    bwts, whole = [], []
    for part in (strings[:20], strings[20:]):
        sizes = np.array([len(s) + 1 for s in part])
        codes = np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8) + np.uint8(1)
        starts = np.cumsum(sizes) - sizes
        order, bwt = bwt_dedup.transform(codes, starts, 9)
        bwts.append(bwt)
        name = np.searchsorted(starts, order, side="right") - 1
        whole.append(sizes[name] - 1 - (order - starts[name]) >= 9)
    shard, block = bwt_dedup.merge(bwts, 9)
    row = np.empty(len(shard), int)
    row[shard == 0], row[shard == 1] = np.arange(len(bwts[0])), len(bwts[0]) + np.arange(len(bwts[1]))
    want: dict = {}
    for r, b in zip(row, block):
        if np.concatenate(whole)[r]:
            want.setdefault(b, set()).add(int(r))
    got: dict = {}
    for r, b in zip(*bwt_dedup.merge_shared(bwts, 9)):
        got.setdefault(b, set()).add(int(r))
    assert list(got.values()) == [rows for rows in want.values() if len(rows) > 1] and 0 < sum(map(len, got.values())) < len(shard)
