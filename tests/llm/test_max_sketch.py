"""Ranked search against scores of every pair."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpus_cases import make
from obsloom.llm import max_sketch


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, items, k=50):
    """(item, rank, doc_id, score); a missing doc_id first among equal scores."""
    tf = [(d, Counter(words(t))) for d, t in rows]
    n_docs, length = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in tf:
            m = 100 - 50 + 50 * c.total() * n_docs // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def items_of(rows, seed=4):
    rnd = random.Random(seed)
    texts = [t for _, t in rows if t and t.strip()]
    items = [(i, " ".join(rnd.sample(rnd.choice(texts).split(), 1) + rnd.choice(texts).split()[:12])) for i in range(25)]
    return items + [(25, None), (26, ""), (27, "never seen anywhere"), (None, texts[0]), (3, texts[4]), (3, texts[4]), (28, "É é ti TI Ti")]


def answer(spark, docs, items, k=50):
    table = spark.createDataFrame([(i, t, 9, 9) for i, t in items], "item_id long, text string, rank int, score long").repartition(2)
    return sorted(map(tuple, max_sketch.search(docs, table, k).collect()), key=str)


@pytest.mark.parametrize("k", [50, 3])
def test_equals_scores_of_all_pairs(spark, docs, rows, k, monkeypatch):
    items = items_of(rows)
    assert answer(spark, docs, items, k) == brute(rows, items, k)
    monkeypatch.setattr(max_sketch, "QUERIES", 4)
    monkeypatch.setattr(max_sketch, "BLOCK", 7)
    assert answer(spark, docs, items, k) == brute(rows, items, k)


def test_empty_tables(spark, docs, none, rows):
    assert answer(spark, none, items_of(rows)) == []
    assert answer(spark, docs, []) == []
    assert answer(spark, make(spark, [(1, ""), (2, None), (3, " .,")]), [(1, "a")]) == []


def test_bounds_hold_and_prune():
    rnd = random.Random(2)
    vocabulary = ["w%d" % i for i in range(4000)]
    weights = [1 / (i + 1) for i in range(4000)]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 400))) for _ in range(1500)]
    found = [max_sketch.counts(t) for t in texts]
    n, length = len(texts), sum(c.total() for c in found)
    df = Counter(t for c in found for t in c)
    queries = [[(t.encode(), max_sketch.weight(n, df[t.encode()])) for t in set(rnd.choices(vocabulary, k=12)) if df[t.encode()]] for _ in range(20)]
    task = max_sketch.Searcher(queries, n, length, 10)
    for i in range(0, n, 100):
        task.add(list(range(i, i + 100)), texts[i:i + 100])
    m = np.array([50 + 50 * c.total() * n // length for c in found])
    bounds = max_sketch.sketch(found, m, task.hashes)[:, task.places] @ task.lookup * np.float32(max_sketch.SLACK)
    for q, terms in enumerate(queries):
        exact = [sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * int(m[d]))) for t, w in terms if t in c) for d, c in enumerate(found)]
        assert (bounds[:, q] >= np.array(exact)).all()
        best = sorted(((-s, d) for d, s in enumerate(exact) if s))[:10]
        assert sorted(((-s, -d) for s, _, d in task.best[q])) == best
    assert task.rescored < 0.2 * n * len(queries)


def test_long_text_is_counted_in_pieces(monkeypatch):
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["alpha", "Beta", "é", "x1", "--"]) for _ in range(400_000)) + "z" * 3000
    whole = Counter(w.encode() for w in words(text))
    assert max_sketch.counts(text) == whole
    monkeypatch.setattr(max_sketch, "CHUNK", 50)
    assert max_sketch.counts(text[:20_000] + " " + "q" * 500 + " a") == Counter(w.encode() for w in words(text[:20_000] + " " + "q" * 500 + " a"))
