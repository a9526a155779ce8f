"""Secrets, quality votes, order-sensitive fingerprints, mixing and the pipeline."""
import hashlib
import math
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpus_cases import make, prose
from obsloom.llm import mixing, neighbour_vote, order_minhash, secrets

SF = "/root/testdata/sf0.001"


def base_spans(t):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_secrets(docs, none, rows):
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base) for r in secrets.scan_documents(docs).collect()}
    want = set()
    for d, t in rows:
        s = base_spans(t or "")
        want.add((d, *(sum(x[0] == k for x in s) for k in ("assign", "access", "hex")), secrets.spell(s)))
    assert got == want and any(w[1] for w in want)
    assert secrets.scan_documents(none).collect() == []


def test_entropy_windows_equal_direct_counts():
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice("ab0123456789cdefXYZ"[:rnd.randint(2, 19)]) for _ in range(rnd.randint(0, 80)))
        hot = np.zeros(len(text), bool)
        for i in range(len(text) - 23):
            w = text[i:i + 24]
            if -sum(w.count(c) / 24 * math.log2(w.count(c) / 24) for c in set(w)) >= 3.0 - 1e-9:
                hot[i:i + 24] = True
        mine = np.zeros(len(text), bool)
        for a, b in secrets.hot_windows(text, 24, 3.0):
            mine[a:b] = True
        assert (hot == mine).all()


def test_entropy_and_allow_list():
    key = hashlib.sha256(b"k").hexdigest()
    assert ("entropy", 2, 66) in secrets.scan("x " + key)
    assert [s for s in secrets.scan("sha256-" + "abcdefghijklmnopqrstuvwxyz0123456789" + " 123e4567-e89b-12d3-a456-426614174000") if s[0] == "entropy"] == []


def test_votes(spark, none):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = neighbour_vote.score(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert got.count() == docs.count() and len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    flipped = neighbour_vote.score(docs, labels.withColumn("quality", (1 - labels.quality) * 0 + labels.toxic * 0)).collect()
    assert {r.score for r in flipped} == {0.0}  # one kind of label only: its share
    assert neighbour_vote.score(none, labels).collect() == []


def test_votes_on_odd_rows(docs, rows, spark):
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, t) in enumerate(rows) if d is not None] + [(None, 1, 0), (0, None, 1)], "doc_id long, quality int, toxic int")
    got = neighbour_vote.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in neighbour_vote.score(docs, labels.limit(0)).collect()} == {0.5}


def test_votes_are_exact_neighbours():
    rnd = np.random.default_rng(2)
    x, bank = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rnd.normal(size=(30, 5)), rnd.normal(size=(40, 5))))
    label, mass = rnd.integers(0, 2, 40), rnd.random(40)
    got = neighbour_vote.vote(x, bank, label, mass, 7, 3.0, 0.4)
    for i in range(30):
        near = sorted(range(40), key=lambda j: -(x[i] @ bank[j]))[:7]
        w = [max(x[i] @ bank[j], 0) ** 3 * mass[j] for j in near]
        assert got[i] == pytest.approx(sum(a * label[j] for a, j in zip(w, near)) / sum(w))


def test_edited_texts(docs, none, rows):
    got = order_minhash.edited_fingerprints(docs, range_bytes=3000).collect()
    assert len(got) == len(rows)
    unique = {d: t or "" for d, t in rows if d is not None and sum(x[0] == d for x in rows) == 1}
    order = sorted(d for d, _ in rows if d is not None)
    mine = {r.doc_id: r for r in got}
    for d, t in unique.items():
        after = next((x for x in order if x > d), None)
        if after is None or after not in unique:
            continue
        half, nxt = len(t) // 2, unique[after]
        assert (mine[d].n_chars, mine[d].edited_sha256) == (len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest())
    prints = {}
    for r in got:
        t = unique.get(r.doc_id)
        if t is not None:
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert order_minhash.edited_fingerprints(none).collect() == []


def test_single_document_follows_itself(spark):
    r = order_minhash.edited_fingerprints(make(spark, [(5, "one two three four five six")])).collect()[0]
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"one two three one two three"[:14] + b"one two three").hexdigest()


def brute_sketch(spark, text):
    return order_minhash.fingerprints(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).collect()[0].sketch


def test_order_matters(spark):
    rnd = random.Random(6)
    words = [prose(rnd, 1) + str(i) for i in range(900)]
    blocks = [words[i:i + 30] for i in range(0, 900, 30)]
    shuffled = blocks[:]
    rnd.shuffle(shuffled)
    edited = words[:300] + ["new"] + words[301:]
    same, moved, edit = (set(brute_sketch(spark, " ".join(w))) for w in (words, sum(shuffled, []), edited))
    assert len(same & edit) > len(same & moved) and len(same & edit) >= 55 and len(same) == 64
    again = set(brute_sketch(spark, " ".join(words + words[:450])))
    assert len(same & again) < 64  # repeated k-mers count by occurrence


def test_mixing(spark, none):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    want = {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}
    got = mixing.mix(docs, targets={"lang": want}, share=0.3).toPandas()
    assert len(got) == 1000 and ((got.probability > 0) & (got.probability <= 1)).all()
    raked = (got.weight * got.n_tokens).groupby(got.lang).sum()
    assert np.allclose(raked / raked.sum(), 0.25, atol=1e-6)
    source = (got.weight * got.n_tokens).groupby(got.source).sum()
    goal = got.groupby("source").n_tokens.sum() ** 0.7
    assert np.allclose(source / source.sum(), goal / goal.sum(), atol=1e-6)
    assert (got.probability * got.n_tokens).sum() / got.n_tokens.sum() == pytest.approx(0.3, abs=1e-6)
    assert abs((got.sampled * got.n_tokens).sum() / got.n_tokens.sum() - 0.3) < 0.06
    assert mixing.mix(none).collect() == [] and mixing.sample(none).collect() == []


def test_mixing_odd_rows(docs, rows):
    got = mixing.mix(docs, share=0.5).collect()
    assert len(got) == len(rows) and all(r.source is not None and r.n_tokens >= 1 for r in got)
    kept = mixing.sample(docs, share=0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in got)


def test_too_many_cells_is_an_error(docs):
    with pytest.raises(ValueError):
        mixing.mix(docs, most_cells=2)


def test_rake_reaches_marginals():
    rnd = np.random.default_rng(0)
    cells = rnd.random(24) + 0.1
    axes = [np.arange(24) // 6, np.arange(24) % 6]
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.full(6, 1 / 6)]
    w = mixing.rake(cells, axes, goals)
    for axis, goal in zip(axes, goals):
        assert np.allclose(np.bincount(axis, w) / w.sum(), goal, atol=1e-8)


def test_pipeline(spark):
    documents = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and all(documents[r.doc_id] == r for r in docs.collect())
        if name == "exact dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({r.text for r in before.collect()})
    last = {r.doc_id: r for r in docs.collect()}
    assert len(last) > 100 and all(r.decoded_sha256 == hashlib.sha256(documents[d].text.encode()).hexdigest() for d, r in last.items())


def test_registry():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
