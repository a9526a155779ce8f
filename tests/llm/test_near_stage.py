"""The pipeline's near stage against the Jaccard of every pair of texts."""
import random

import numpy as np

import corpus_pipeline
from corpus_cases import make
from obsloom.llm import near_copies


def grams(text, k=5):
    words = text.lower().split()
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rnd, words, n):
    out = words[:]
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.randrange(10 ** 9)}"
    return out


def kept_by_pairs(rows):
    parent, sets = list(range(len(rows))), [grams(t) for _, t in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}  # rows ascend by doc_id


def test_near_stage_keeps_what_all_pairs_keep(spark):
    rnd = random.Random(5)
    texts = []
    for size in (12, 30, 80, 200, 500):
        for _ in range(16):
            base = [f"w{rnd.randrange(10 ** 9)}" for _ in range(size)]
            texts.append(base)
            for share in (0.008, 0.016, 0.024, 0.04):  # around Jaccard 0.8 for shingles of five words
                texts.append(edited(rnd, base, max(1, round(share * size))))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, " "), (9001, "\n\t"), (9002, "one two"), (9003, "ONE  two")]
    want = kept_by_pairs(rows)
    got = {r.doc_id for r in corpus_pipeline.near(spark, make(spark, rows), "").collect()}
    assert got == want and len(want) < len(rows) - 100


def test_a_crowd_of_copies_is_judged_pair_by_pair(spark):
    rnd = random.Random(8)
    chain = [[f"w{rnd.randrange(10 ** 9)}" for _ in range(300)]]
    for _ in range(24):  # each is near the one before it, the ends are not near each other
        chain.append(edited(rnd, chain[-1], 4))
    crowd = [edited(rnd, chain[0], 2) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(chain + crowd)]
    got = {r.doc_id for r in corpus_pipeline.near(spark, make(spark, rows), "").collect()}
    assert got == kept_by_pairs(rows) == {0}


def test_signature_distance_follows_the_plan():
    rnd = random.Random(2)
    bits, blocks, q = near_copies.plan(200_000, 0.8, 0.9995)
    wide = -(-(near_copies.CHECK + bits * blocks) // 64)
    far = []
    for _ in range(200):
        n = rnd.choice((45, 90, 450))
        common, a, b = (np.array([rnd.getrandbits(64) for _ in range(k)], np.uint64) for k in (n * 8 // 9, n // 9, n // 9))
        x, y = (near_copies.signature(np.concatenate([common, own]), wide) for own in (a, b))
        far.append(np.bitwise_count(x ^ y).sum() / (64 * wide))
    assert abs(np.mean(far) - q) < 0.02 and near_copies.plan(10 ** 9, 0.8, 0.9995)[0] > bits


def test_a_crowd_of_one_template_is_not_compared_pair_by_pair(spark):
    """160 of 200 words are shared: nothing links but the planted copies, and candidates grow with the crowd, not with its square."""
    rnd = random.Random(3)
    template = [f"t{i}" for i in range(160)]
    made = []
    for size in (300, 900):
        texts = [template[:80] + [f"u{rnd.randrange(10 ** 9)}" for _ in range(40)] + template[80:] for _ in range(size)]
        texts += [edited(rnd, texts[7], 3), edited(rnd, texts[7], 3), edited(rnd, texts[8], 2)]
        docs = make(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
        groups = {}
        for r in near_copies.near_groups(docs).collect():
            groups.setdefault(r.component_id, set()).add(r.doc_id)
        assert {k: v for k, v in groups.items() if len(v) > 1} == {7: {7, size, size + 1}, 8: {8, size + 2}}
        plain = near_copies.texts(docs).select("doc_id", near_copies.F.xxhash64("text").alias("node"), "text")
        alone = plain.select("node", near_copies.F.col("node").alias("grp")).distinct()
        made.append(near_copies.regrouped(alone, plain, 5, 0.8).count())
    assert made[0] >= 4 and made[1] < 4 * made[0] + 20


def test_rarest_shingles_meet_every_near_pair(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(40):
        base = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(6, 90))]
        texts += [base, edited(rnd, base, 1), edited(rnd, base, max(1, len(base) // 30)), base[:-max(1, len(base) // 10)]]
    plain = near_copies.texts(make(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).select("doc_id", near_copies.F.xxhash64("text").alias("node"), "text").cache()
    node = {r.doc_id: r.node for r in plain.collect()}
    alone = plain.select("node", near_copies.F.col("node").alias("grp")).distinct()
    got = {(r.src, r.dst) for r in near_copies.regrouped(alone, plain, 5, 0.8).collect()}
    sets = [grams(" ".join(t)) for t in texts]
    want = {tuple(sorted((node[i], node[j]))) for i in range(len(texts)) for j in range(i) if node[i] != node[j] and jaccard(sets[i], sets[j]) >= 0.8}
    assert len(want) > 40 and want <= got


def test_odd_rows(spark, docs, none, rows):
    got = near_copies.near_groups(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert near_copies.near_groups(none).collect() == []
    of = {r.doc_id: r.component_id for r in got}
    empty = {d for d, t in rows if d is not None and not (t or "").split()}
    assert {of[d] for d in empty} == {min(empty)}


def test_forest_connects_what_its_edges_connect():
    rng = np.random.default_rng(4)
    for n, m in ((2, 1), (10, 12), (60, 40), (200, 3000)):
        pair = np.unique(np.sort(rng.integers(0, n, (m, 2)), axis=1), axis=0)
        a, b = pair[pair[:, 0] < pair[:, 1]].T
        kept = near_copies._forest(a, b, n)

        def classes(edges):
            parent = list(range(n))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i in edges:
                x, y = sorted((find(a[i]), find(b[i])))
                parent[y] = x
            return [find(i) for i in range(n)]

        assert classes(kept) == classes(range(len(a))) and len(kept) == n - len(set(classes(kept)))


def test_rounds_of_some_pairs_link_what_all_pairs_link(spark, monkeypatch):
    """A crowd whose members lie on both sides of the bound, each a group of its own at first."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10 ** 9)}" for _ in range(200)]
    texts = [edited(rnd, base, rnd.choice((1, 2, 3, 6, 9))) for _ in range(120)] + [[f"v{rnd.randrange(10 ** 9)}" for _ in range(50)] for _ in range(20)]
    plain = near_copies.texts(make(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).select("doc_id", near_copies.F.xxhash64("text").alias("node"), "text").cache()
    node = {r.doc_id: r.node for r in plain.collect()}
    alone = plain.select("node", near_copies.F.col("node").alias("grp")).distinct()
    asked = []
    whole = near_copies.meetings
    monkeypatch.setattr(near_copies, "meetings", lambda rows, least, every: asked.append(every) or whole(rows, least, every))
    links = near_copies.links_across(alone, plain, 5, 0.8)
    got = {r.node: r.component for r in near_copies._labels(links).collect()}
    sets = [grams(" ".join(t)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    classes = lambda of: {frozenset(d for d in range(len(texts)) if of(d) == c) for c in {of(d) for d in range(len(texts))}}
    assert classes(lambda d: got.get(node[d], node[d])) == classes(find)
    assert False in asked and len({find(d) for d in range(120)}) > 1


def test_crowds_around_the_bound_judge_few_and_lose_none(spark, monkeypatch):
    """Copies whose Jaccard is about 0.73, some over 0.8: of the pairs that meet few are judged, among them all that connect."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10 ** 9)}" for _ in range(150)]
    texts = [edited(rnd, base, 2 + i % 3 if i % 10 else 1) for i in range(150)] + [[f"v{rnd.randrange(10 ** 9)}" for _ in range(60)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    plain = near_copies.texts(make(spark, rows)).select("doc_id", near_copies.F.xxhash64("text").alias("node"), "text").cache()
    alone = plain.select("node", near_copies.F.col("node").alias("grp")).distinct()
    whole, counts = near_copies.judged, []
    monkeypatch.setattr(near_copies, "judged", lambda pairs, *a: counts.append(pairs.count()) or whole(pairs, *a))
    label = near_copies._labels(near_copies.links_across(alone, plain, 5, 0.8))
    lowest = {}
    own = {r.node: r.component for r in label.collect()}
    for r in plain.orderBy("doc_id").collect():
        lowest.setdefault(own.get(r.node, r.node), r.doc_id)
    assert set(lowest.values()) == kept_by_pairs(rows) and len(lowest) < len(rows)
    assert sum(counts) < 150 * 149 // 2 // 4


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for n, own in ((0, 0), (1, 1), (30, 3), (200, 40), (5000, 900)):
        common, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, own, own // 2))
        x, y = (near_copies.parity(np.concatenate([common, v])) for v in (a, b))
        assert len(x) * 8 == near_copies.PARITY and np.bitwise_count(x ^ y).sum() <= own + own // 2


def test_shingles_stay_whole_however_batches_cut_them(monkeypatch):
    monkeypatch.setattr(near_copies, "AT_ONCE", 7)
    shingle = np.repeat(np.arange(12), [1, 2, 9, 1, 1, 30, 2, 2, 1, 5, 1, 3])
    batches = [near_copies.pa.RecordBatch.from_arrays([near_copies.pa.array(shingle[a:a + 4]), near_copies.pa.array([bytes(8)] * len(shingle[a:a + 4]))], ["shingle", "bits"])
               for a in range(0, len(shingle), 4)]
    got = list(near_copies._whole(iter(batches)))
    assert np.concatenate([g[0] for g in got]).tolist() == shingle.tolist() and len(got) > 2
    assert all(a[0][-1] != b[0][0] for a, b in zip(got, got[1:])) and all(g[1].shape == (len(g[0]), 1) for g in got)
