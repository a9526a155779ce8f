"""Ranked lexical search: hashed maxima of each document's term weights bound its scores, and only documents whose bound can still
reach the best ones are scored exactly.

The saturation of a term in a document, ``1e9 tf / (1000 tf + 20 m)``, does not depend on the query. A document folds those of all its
terms into ``COORDINATES`` maxima, by a hash of the term. A query looks its terms up there, times their corpus weights: never less
than the score. Blocks of documents answer all queries in one matrix product."""
from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .layout import slices, texts

COORDINATES = 4096
BLOCK = 512  # documents bounded at once
QUERIES = 1024  # items searched in one pass over the documents
CHUNK = 1 << 20  # bytes of a text that are cut into terms at once
SLACK = 1 + 1e-4  # single precision sums of up to 1000 weights stay below this
KNOWN = 300_000  # terms whose hash a worker keeps

# Terms are runs of ASCII letters and digits and everything beyond ASCII; in UTF-8 a byte at a time says the same. Only A-Z are lowered.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """Terms of a text in order, in lists of bounded size."""
    raw = text.encode().translate(_LETTERS)
    start = 0
    while len(raw) - start > CHUNK:
        end = raw.rfind(b" ", start + 1, start + CHUNK)
        end = raw.find(b" ", start + CHUNK) if end < 0 else end
        if end < 0:
            break
        yield raw[start:end].split()
        start = end
    yield raw[start:].split()


def counts(text: str) -> Counter:
    found: Counter = Counter()
    for part in terms(text):
        found.update(part)
    return found


class Hashes(dict):
    """Coordinate of a term; forgets all when it holds too many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        place = self[term] = zlib.crc32(term) % COORDINATES
        return place


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def sketch(found: list[Counter], m: np.ndarray, hashes: Hashes) -> np.ndarray:
    """One row of maxima for each document, rounded upwards to single precision."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    total = int(sizes.sum())
    place = np.fromiter((hashes[t] for c in found for t in c), np.int64, total)
    tf = np.fromiter((n for c in found for n in c.values()), np.int64, total)
    row = np.repeat(np.arange(len(found)), sizes)
    out = np.zeros(len(found) * COORDINATES, np.float32)
    np.maximum.at(out, row * COORDINATES + place, saturation(tf, m[row]).astype(np.float32))
    return out.reshape(len(found), COORDINATES)


class Searcher:
    """Bounds and exact scores of a task's documents for one block of queries; ``best`` holds each query's ``k`` best so far."""

    def __init__(self, queries: list[list[tuple[bytes, int]]], n_docs: int, length: int, k: int):
        self.queries, self.n_docs, self.length, self.k, self.hashes = queries, n_docs, length, k, Hashes()
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]
        places = sorted({self.hashes[t] for q in queries for t, _ in q})
        at = {p: i for i, p in enumerate(places)}
        self.places = np.array(places, np.int64)
        self.lookup = np.zeros((len(places), len(queries)), np.float32)
        for i, q in enumerate(queries):
            for t, w in q:
                self.lookup[at[self.hashes[t]], i] += w
        self.rescored = 0

    def add(self, ids: list, values: list[str]) -> None:
        """``ids`` in any order; a missing doc_id ranks before all others of its score."""
        found = [counts(v) for v in values]
        n = np.fromiter((c.total() for c in found), np.int64, len(found))
        m = 50 + 50 * n * self.n_docs // self.length
        bounds = sketch(found, m, self.hashes)[:, self.places] @ self.lookup * np.float32(SLACK)
        for q, weights in enumerate(self.queries):
            best, column = self.best[q], bounds[:, q]
            least = best[0][0] if len(best) == self.k else 1
            order = np.flatnonzero(column >= least)
            for d in order[np.argsort(-column[order], kind="stable")].tolist():
                if len(best) == self.k and column[d] < best[0][0]:
                    break  # no later bound is higher
                tf, mass, score = found[d], 20 * int(m[d]), 0
                self.rescored += 1
                for term, weight in weights:
                    if term in tf:
                        score += weight * (1_000_000_000 * tf[term] // (1000 * tf[term] + mass))
                if score:
                    entry = (score, ids[d] is None, 0 if ids[d] is None else -ids[d])
                    if len(best) < self.k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)


def _query_terms(items: DataFrame) -> DataFrame:
    """(item, text) rows as (item, terms); rows of one item are one query."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), F.lit(1))
    return items.groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias("terms"))


def statistics(docs: DataFrame, wanted: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms with repeats, and for each wanted term the documents that hold it."""
    asked = frozenset(wanted)

    def work(batches):
        seen, n_docs, length = Counter(), 0, 0
        for _, values in slices(batches):
            for value in values:
                here, n = set(), 0
                for part in terms(value):
                    n += len(part)
                    here.update(asked.intersection(part))
                seen.update(here)
                n_docs, length = n_docs + (n > 0), length + n
        if n_docs:
            names = [None, *seen]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n_docs, *seen.values()], pa.int64()), pa.array([length] + [0] * len(seen), pa.int64())],
                                             ["term", "n", "length"])

    part = texts(docs).mapInArrow(work, "term binary, n long, length long")
    rows = part.groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()  # a row for each wanted term at most
    df = {None if r.term is None else bytes(r.term): (r.n, r.length) for r in rows}
    n_docs, length = df.pop(None, (0, 0))
    return n_docs, length, {t: n for t, (n, _) in df.items()}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0, equal scores by ascending doc_id.

    Items are taken ``QUERIES`` at a time, with one pass over all documents for the corpus statistics of their terms and one for the
    search; whole texts are read, and only a task's ``k`` best of an item are shuffled. Rows that share an item id are one query with
    the terms of all; a null item id is an item too. A null or empty text has no terms. Repeated documents each rank on their own; a
    null doc_id comes first among equal scores. A very long text is counted in pieces. Columns other than the id and the text, whatever
    their names, are not read. Empty tables on either side give an empty one."""
    spark = docs.sparkSession
    queries = _query_terms(items.select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    blocks = -(-items.count() // QUERIES)
    out = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).where(F.size("terms") > 0).collect()
        if not mine:
            continue
        asked = [(r.item, [t.encode() for t in r.terms]) for r in mine]
        part = _search(docs, asked, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search(docs: DataFrame, asked: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    n_docs, length, df = statistics(docs, sorted({t for _, q in asked for t in q}))
    queries = [[(t, weight(n_docs, df[t])) for t in q if t in df] for _, q in asked]

    def work(batches):
        task = Searcher(queries, n_docs, length, k)
        for batch, values in slices(batches):
            ids = batch.column(0).to_pylist()
            for i in range(0, len(ids), BLOCK):
                task.add(ids[i:i + BLOCK], values[i:i + BLOCK])
        for i in range(0, len(asked), 64):
            rows = [(asked[q][0], score, None if missing else -doc) for q in range(i, min(i + 64, len(asked))) for score, missing, doc in task.best[q]]
            if rows:
                item, score, doc = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    found = texts(docs).mapInArrow(work, "item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    group = F.floor(F.spark_partition_id() / 64)  # tasks are merged 64 at a time first, so that no task gets those of all
    near = found.withColumn("group", group).withColumn("place", F.row_number().over(Window.partitionBy("item_id", "group").orderBy(*order))).where(F.col("place") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
