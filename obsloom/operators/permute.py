"""Labels re-dealt inside strata without a shuffle for each repeat.

Rows get a place 0..n-1 inside their stratum once, by one bucketed ranking. The labels of a stratum, in sorted order, fill the same
places, so a stratum needs only its label counts. A repeat is a keyed bijection of the places: a Feistel network over a rectangle just
above n, walked on until the place is below n. Every row finds the label of every repeat by itself; only counts or sums are shuffled."""
from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from . import order

ROUNDS = 12  # fewer leave the orders of five or six rows visibly uneven
KEY_STEP, KEY_DIGITS = 2, 7  # a round's key: hex digits of one md5
MASK = (1 << 31) - 1
# odd multipliers of the round function
SPREAD, KEYED, FINISH = 739982445, 1000003, 695872825
BLOCK = 1 << 19  # places packed in a row
TASKS = 32  # at least, if there are as many repeats: small tables are shared out by ranges of the repeats
STRETCH = 16384  # places walked at a time, as much as a core keeps near
CELLS = 4_000_000  # counters a task holds before it passes them on
PLACED = ("_name", "_real", "_place", "_size", "_labels", "_upto")


def round_keys(seed: int, rep: int, stratum: str) -> list[int]:
    h = hashlib.md5(f"{seed}|{rep}|{stratum}".encode()).hexdigest()
    return [int(h[i * KEY_STEP:i * KEY_STEP + KEY_DIGITS], 16) * KEYED for i in range(ROUNDS)]


def _scatter(v: np.ndarray, key: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A number from 0 to ``below`` - 1 for each value and key."""
    t = (v * SPREAD + key) & MASK
    u = ((t ^ (t >> 15)) * FINISH) & MASK
    return ((u ^ (u >> 16)) * below) >> 31


def permuted_place(place: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each place goes: a bijection of 0..n-1 for each n and keys. ``keys`` has ROUNDS rows, n and keys a column for each place."""
    a = np.ceil(np.sqrt(n)).astype(np.int64)
    b = -(-n // a)
    x, todo = place.astype(np.int64, copy=True), None
    while todo is None or len(todo):
        left, right = np.divmod(x if todo is None else x[todo], b)
        for r in range(0, ROUNDS, 2):
            left = left + _scatter(right, keys[r], a)
            left -= a * (left >= a)
            right = right + _scatter(left, keys[r + 1], b)
            right -= b * (right >= b)
        left *= b
        left += right
        if todo is None:
            x = left
            todo = np.flatnonzero(x >= n)
        else:
            x[todo] = left
            out = left >= n
            todo, n, a, b, keys = todo[out], n[out], a[out], b[out], keys[:, out]
            continue
        n, a, b, keys = n[todo], a[todo], b[todo], keys[:, todo]
    return x


def with_places(df: DataFrame, id_col: str, label: str, stratum: str) -> DataFrame:
    """Adds what a deal needs: _place and _size inside the stratum, _name of the stratum, its _labels in order and where each ends.

    ``id_col`` is unique in a stratum and orders it. A null stratum is one of its own; a null label is dealt like any other."""
    named = df.withColumns({"_name": F.coalesce(F.col(stratum).cast("string"), F.lit("")), "_real": F.col(label).cast("string")})
    counts = named.groupBy("_name", F.col("_real").alias("_label")).agg(F.count("*").alias("_count"))
    runs = counts.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("_label", "_count"))).alias("_runs"))
    upto = F.transform("_runs", lambda _, i: F.aggregate(F.slice("_runs", 1, i + 1), F.lit(0).cast("long"), lambda t, r: t + r["_count"]))
    runs = runs.select("_name", F.col("_runs._label").alias("_labels"), upto.alias("_upto"))
    placed = order.cumulative_counts(named.withColumn("_one", F.lit(1).cast("long")), ["_name"], id_col, "_one")
    placed = placed.withColumn("_place", F.col("cum") - 1).withColumnRenamed("n", "_size").drop("cum", "_one")
    return placed.join(runs, "_name")


class Deal:
    """The deals of one batch of placed rows. Labels are coded by their place in ``levels``; -1 stands for the real labels."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        col = {n: batch.column(n) for n in PLACED}
        names = col["_name"].dictionary_encode()
        self.names, self.stratum = names.dictionary.to_pylist(), names.indices.to_numpy()
        self.place, self.size, self.seed = col["_place"].to_numpy(), col["_size"].to_numpy(), seed
        first = np.unique(self.stratum, return_index=True)[1]
        runs = [(col["_labels"][int(i)].as_py(), col["_upto"][int(i)].as_py()) for i in first]
        self.levels = sorted({x for labels, _ in runs for x in labels}, key=lambda x: (x is not None, x))
        code = {x: i for i, x in enumerate(self.levels)}
        # the runs of all strata, one after the other, so that one search finds the label of any place
        sizes = np.array([upto[-1] for _, upto in runs], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.ends = np.concatenate([s + np.array(upto) for s, (_, upto) in zip(self.start, runs)])
        self.codes = np.array([code[x] for labels, _ in runs for x in labels])
        real = col["_real"].dictionary_encode(null_encoding="encode")
        self.real = np.array([code[x] for x in real.dictionary.to_pylist()])[real.indices.to_numpy()]

    def labels(self, rep: int) -> np.ndarray:
        if rep < 0:
            return self.real
        keys = np.array([round_keys(self.seed, rep, s) for s in self.names], np.int64).T[:, self.stratum]
        at = self.start[self.stratum] + permuted_place(self.place, self.size, keys)
        return self.codes[np.searchsorted(self.ends, at, side="right")]


def permuted_labels(placed: DataFrame, id_col: str, reps, seed: int) -> DataFrame:
    """(rep, id, permuted): every row with its label in every repeat; -1 is the real one."""
    reps = list(reps)

    def run(batches):
        for batch in batches:
            if len(batch):
                deal, ids = Deal(batch, seed), batch.column("_id")
                levels = pa.array(deal.levels, pa.string())
                for rep in reps:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), rep)), ids, levels.take(pa.array(deal.labels(rep)))], ["rep", "id", "permuted"])

    part = placed.select(F.col(id_col).alias("_id"), *PLACED)
    return part.mapInArrow(run, f"rep long, id {dict(placed.dtypes)[id_col]}, permuted string")


def _tally(placed: DataFrame, extra: dict, reps, seed: int, width: int, add, schema: str) -> DataFrame:
    """Sums by (repeat, a, b) of each task: ``add(batch, deal)`` gives the values of ``a`` and a function from a repeat to the values of
    ``b``, a table of codes and sums of ``width`` numbers for each pair. Rows stay where they are."""
    reps = np.array(list(reps), np.int64)

    def run(batches):
        held: dict = {}  # (a, b) -> sums by repeat

        def flush():
            for (a, b), sums in held.items():
                some = np.flatnonzero(sums[:, 0])
                values = pa.FixedSizeListArray.from_arrays(pa.array(sums[some].ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array([a] * len(some), pa.string()), pa.array([b] * len(some), pa.string()), values],
                                                 ["rep", "a", "b", "sums"])
            held.clear()

        for batch in batches:
            if not len(batch):
                continue
            names, levels, sums_of = add(batch, Deal(batch, seed))
            for i, rep in enumerate(reps.tolist()):
                sums = sums_of(rep)
                for c in np.flatnonzero(sums[:, 0]).tolist():
                    pair = (names[c // len(levels)], levels[c % len(levels)])
                    if pair not in held:
                        if len(held) * len(reps) * width > CELLS:
                            yield from flush()
                        held[pair] = np.zeros((len(reps), width))
                    held[pair][i] += sums[c]
        yield from flush()

    part = placed.select(*PLACED, *[c.alias(n) for n, c in extra.items()]).mapInArrow(run, "rep long, a string, b string, sums array<double>")
    total = part.groupBy("rep", "a", "b").agg(*[F.sum(F.col("sums")[i]).alias(f"_{i}") for i in range(width)])
    return total.select("rep", F.col("a").alias(schema.split()[0]), F.col("b").alias(schema.split()[1]), F.col("_0").cast("long").alias("n"),
                        *([F.array(*[f"_{i}" for i in range(1, width)]).alias("s")] if width > 1 else []))


def _encoded(column: pa.Array) -> tuple[np.ndarray, list]:
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _tables(n: int, keys: list[int]) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
    """Width of the rectangle of ``n`` places, what each round adds for every value of the other half, and what the halves give in the
    end. A half has only about sqrt(n) values, so a round is a look-up; tables repeat as often as halves have passed their end."""
    high = int(np.ceil(np.sqrt(np.array([n], np.int64)))[0])
    wide = -(-n // high)
    v = np.arange(max(high, wide), dtype=np.int64)
    add = []
    for r, k in enumerate(keys):
        mine, other = (high, wide) if r % 2 == 0 else (wide, high)
        add.append(np.tile(_scatter(v[:other], np.int64(k), np.int64(mine)), (r + 1) // 2 + 1))
    return wide, add, np.tile(v[:high] * wide, ROUNDS // 2 + 1), np.tile(v[:wide], ROUNDS // 2 + 1)


def _walk(x: np.ndarray, wide: int, add: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """One step of the walk of ``x``. No clipping happens: the mode spares the check of bounds."""
    left, right = np.divmod(x, wide)
    step = np.empty_like(left)
    for r in range(0, ROUNDS, 2):
        left += np.take(add[r], right, out=step, mode="clip")
        right += np.take(add[r + 1], left, out=step, mode="clip")
    x = np.take(rows, left, out=step, mode="clip")
    x += np.take(columns, right, out=left, mode="clip")
    return x


def _label_counts(place: np.ndarray, n: int, keys: list[int], ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Codes x labels: how often the places from ``starts[c]`` to ``starts[c + 1]`` get each label, whose runs end at ``ends``."""
    tables = _tables(n, keys)
    out = np.zeros((len(starts) - 1, len(ends)), np.int64)
    for c, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
        upto, todo = np.zeros(len(ends), np.int64), [place[at:min(at + STRETCH, hi)] for at in range(lo, hi, STRETCH)]
        while todo:
            outside = []
            for x in todo:
                x = _walk(x, *tables)
                upto += np.array([np.count_nonzero(x < e) for e in ends], np.int64)
                outside.append(x[x >= n])
            # those in no run yet walk on
            rest = np.concatenate(outside)
            todo = [rest[at:at + STRETCH] for at in range(0, len(rest), STRETCH)]
        out[c] = np.diff(upto, prepend=0)
    return out


def null_cells(placed: DataFrame, by: str, reps, seed: int) -> DataFrame:
    """(rep, a, b, n_ab): counts of ``by`` against the label of every repeat.

    The places of a stratum are packed into blocks, sorted by ``by``; a task walks the places of its blocks for a range of the repeats."""
    real = [int(r) for r in reps if r < 0]
    reps = [int(r) for r in reps if r >= 0]

    def pack(pdf):
        code, names = pd.factorize(pdf["_by"], use_na_sentinel=False)
        o = np.argsort(code, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))])
        first = pdf.iloc[0]
        return pd.DataFrame([(first["_name"], int(first["_size"]), list(first["_labels"]), list(first["_upto"]), [None if x is None or x != x else x for x in names], starts.tolist(),
                              pdf["_place"].to_numpy()[o].astype(np.int64).tobytes())], columns=["_name", "_size", "_labels", "_upto", "_names", "_starts", "_places"])

    blocked = placed.select(*[c for c in PLACED if c != "_real"], F.col(by).cast("string").alias("_by"), F.floor(F.col("_place") / BLOCK).alias("_block"))
    blocks = stage(blocked.groupBy("_name", "_block").applyInPandas(
        pack, "_name string, _size long, _labels array<string>, _upto array<long>, _names array<string>, _starts array<long>, _places binary"))
    n = blocks.count()
    ranges = max(1, min(len(reps), -(-TASKS // max(n, 1))))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                place, ends, starts = np.frombuffer(row["_places"], np.int64), np.array(row["_upto"], np.int64), np.array(row["_starts"], np.int64)
                mine = reps[row["_range"]::ranges]
                if not mine:
                    continue
                got = np.stack([_label_counts(place, row["_size"], round_keys(seed, r, row["_name"]), ends, starts) for r in mine])
                i, a, b = np.nonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(mine, np.int64)[i]), pa.array([row["_names"][x] for x in a], pa.string()),
                                                  pa.array([row["_labels"][x] for x in b], pa.string()), pa.array(got[i, a, b])], ["rep", "a", "b", "n_ab"])

    spread = blocks.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).repartition(max(1, n * ranges))
    cells = spread.mapInArrow(run, "rep long, a string, b string, n_ab long")
    if real:
        own = placed.groupBy(F.col(by).cast("string").alias("a"), F.col("_real").alias("b")).agg(F.count("*").alias("n_ab"))
        cells = cells.unionByName(own.withColumn("rep", F.explode(F.array(*[F.lit(r).cast("long") for r in real]))))
    return cells.groupBy("rep", "a", "b").agg(F.sum("n_ab").alias("n_ab"))


def null_sums(placed: DataFrame, by: str, vec: str, dims: int, reps, seed: int) -> DataFrame:
    """(rep, by, label, n, s): rows and sums of the vector by ``by`` and the label of every repeat."""
    def add(batch, deal):
        row, names = _encoded(batch.column("_by"))
        x = np.column_stack([np.ones(len(batch)), np.stack(batch.column("_vec").to_numpy(zero_copy_only=False))])
        wide = len(deal.levels)

        def sums(rep):
            code = row * wide + deal.labels(rep)
            order_of = np.argsort(code, kind="stable")
            found, first = np.unique(code[order_of], return_index=True)
            out = np.zeros((len(names) * wide, dims + 1))
            out[found] = np.add.reduceat(x[order_of], first)
            return out

        return names, deal.levels, sums

    return _tally(placed, {"_by": F.col(by).cast("string"), "_vec": F.col(vec)}, reps, seed, dims + 1, add, "by label")


def null_confusion(placed: DataFrame, by: str, vec: str, models: dict, reps, seed: int) -> DataFrame:
    """(rep, truth, pred, n): rows by the label of every repeat and the class its model gives. ``models``: (repeat, value of ``by``) ->
    model with ``log_scores`` and ``classes``; they go to every task, so their number times their size must be small."""
    def add(batch, deal):
        row, names = _encoded(batch.column("_by"))
        x = np.stack(batch.column("_vec").to_numpy(zero_copy_only=False))
        classes = sorted({c for m in models.values() for c in m.classes})
        code = {c: i for i, c in enumerate(classes)}
        wide = len(classes)

        def counts(rep):
            pred = np.zeros(len(x), np.int64)
            for i, name in enumerate(names):
                m, mine = models[rep, name], row == i
                pred[mine] = np.array([code[c] for c in m.classes])[m.log_scores(x[mine]).argmax(1)]
            return np.bincount(deal.labels(rep) * wide + pred, minlength=len(deal.levels) * wide)[:, None]

        return deal.levels, classes, counts

    return _tally(placed, {"_by": F.col(by).cast("string"), "_vec": F.col(vec)}, reps, seed, 1, add, "truth pred")
