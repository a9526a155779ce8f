"""Source mixing: token weights raked to marginals by iterative proportional fitting, then calibrated sampling."""
from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Topics are rules over the text, first match wins; a caller may pass other rules or a topic column.
TOPICS: tuple[tuple[str, str], ...] = (
    ("notice", r"(?i)\b(licensed under|copyright|all rights reserved)\b"),
    ("table", r"\|[^|\n]*\|[^|\n]*\|"),
    ("code", r"[{};]\s*\n|(?i)\b(def|return|import|select)\b\s"),
    ("dialogue", r"[?!][^?!]{0,80}[?!][^?!]{0,80}[?!]"),
)


def topic_of(text: Column, rules=TOPICS, other: str = "prose") -> Column:
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Size of a text in tokens: its words, at least one so that an empty text can be sampled too.

    Spaces are counted; a split would make an object of every word."""
    inner = F.trim(text)
    return F.greatest(F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "), F.lit(""))) + 1, F.lit(1)).cast("long")


def rake(cells: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Cell weights whose marginal over each axis is in proportion to its target. ``axes`` hold each cell's level; total stays that of ``cells``.

    Targets of levels without tokens are dropped and the rest rescaled."""
    total = cells.sum()
    goals = []
    for level, target in zip(axes, targets):
        have = np.bincount(level, cells, len(target)) > 0
        goal = np.where(have, target, 0.0)
        goals.append(total * goal / goal.sum() if goal.sum() else np.bincount(level, cells, len(target)))
    weight = cells.astype(float).copy()
    for _ in range(rounds):
        worst = 0.0
        for level, goal in zip(axes, goals):
            now = np.bincount(level, weight, len(goal))
            ratio = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            weight *= ratio[level]
            worst = max(worst, np.abs(now - goal).max() / max(total, 1e-300))
        if worst < tol:
            break
    return weight


def inclusion(cells: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """Probability per cell in proportion to weight / tokens, at most one, so that the expected tokens are ``share`` of all."""
    ratio = np.divide(weight, cells, out=np.zeros_like(weight), where=cells > 0)
    want, low, high = share * cells.sum(), 0.0, 1.0
    while (np.minimum(1, high * ratio) * cells).sum() < want * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * cells).sum() < want else (low, mid)
    return np.minimum(1, high * ratio)


def tempered(power: float):
    """Target shares in proportion to observed tokens to ``power``: below one small levels gain."""
    return lambda tokens: tokens ** power / (tokens ** power).sum()


def _marked(docs: DataFrame, seed: int, topics) -> DataFrame:
    """``docs`` with one more column ``_mix`` (source, lang, topic, n_tokens, u); names in ``docs`` cannot clash with its fields."""
    text = F.coalesce(F.col("text"), F.lit(""))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", text), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return docs.withColumn("_mix", F.struct(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
                                            topic_of(text, topics).alias("topic"), tokens_of(text).alias("n_tokens"), u.alias("u")))


def calibrate(marked: DataFrame, targets: Mapping | None, share: float, most_cells: int) -> DataFrame:
    """Weight and probability of each (source, lang, topic) cell, raked on the table of cell totals."""
    axes = ["source", "lang", "topic"]
    table = marked.select("_mix.*").groupBy(*axes).agg(F.sum("n_tokens").alias("n")).limit(most_cells + 1).collect()
    if len(table) > most_cells:
        raise ValueError(f"more than {most_cells} cells of source, language and topic")
    cells = np.array([r["n"] for r in table], float)
    levels, goals = [], []
    for axis in axes:
        names = sorted({r[axis] for r in table})
        place = {x: i for i, x in enumerate(names)}
        levels.append(np.array([place[r[axis]] for r in table], int))
        want = (targets or {}).get(axis, tempered(0.7))
        seen = np.bincount(levels[-1], cells, len(names))
        goals.append(want(seen) if callable(want) else np.array([float(want.get(x, 0.0)) for x in names]))
    weight = rake(cells, levels, goals) if table else cells
    chance = inclusion(cells, weight, share) if table else cells
    found = [(r["source"], r["lang"], r["topic"], float(w / c), float(p)) for r, c, w, p in zip(table, cells, weight, chance)]
    return marked.sparkSession.createDataFrame(found, "_s string, _l string, _t string, _weight double, _probability double")


def _joined(docs: DataFrame, targets, share: float, seed: int, topics, most_cells: int) -> DataFrame:
    marked = _marked(docs, seed, topics)
    small = F.broadcast(calibrate(marked, targets, share, most_cells))
    return marked.join(small, (F.col("_mix.source") == F.col("_s")) & (F.col("_mix.lang") == F.col("_l")) & (F.col("_mix.topic") == F.col("_t")), "left")


def mix(docs: DataFrame, targets: Mapping | None = None, share: float = 0.8, seed: int = 17, topics=TOPICS, most_cells: int = 200_000) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) for each row of ``docs`` (doc_id, text, source, lang).

    ``targets`` maps "source", "lang" and "topic" to {level: share} or to a function of the observed tokens; absent axes are tempered by 0.7.
    Levels without a target get none of the weight. Tokens are summed per cell in one aggregate over all rows; raking works on that table
    (checked to have ``most_cells`` rows at most, an error beyond). ``weight`` is raked tokens per token. A row is sampled when a hash of (seed,
    doc_id, text) falls below its probability, so repeats of the query agree and repeated rows share their fate. Null source or lang is a
    level of its own (""); a null text is empty and counts one token; a null doc_id is hashed like a value; an empty table gives an empty one."""
    return _joined(docs, targets, share, seed, topics, most_cells).select(
        F.col("doc_id").cast("long").alias("doc_id"), "_mix.source", "_mix.lang", "_mix.topic", "_mix.n_tokens", F.col("_weight").alias("weight"),
        F.col("_probability").alias("probability"), (F.col("_mix.u") < F.col("_probability")).alias("sampled"))


def sample(docs: DataFrame, targets: Mapping | None = None, share: float = 0.8, seed: int = 17, topics=TOPICS, most_cells: int = 200_000) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    joined = _joined(docs, targets, share, seed, topics, most_cells)
    return joined.where(F.col("_mix.u") < F.col("_probability")).select(*[F.col(f"`{c}`") for c in docs.columns])
