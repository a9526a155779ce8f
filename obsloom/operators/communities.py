"""Communities of a weighted graph: local moves without conflicts, refinement, contraction, until nothing moves.

A graph of up to LOCAL link rows is settled in one task. In a larger one communities are dealt to blocks, fresh in every round: the gain of
a move depends on the two communities only, so blocks that hold all members of theirs move their nodes one by one, side by side.
"""
from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from .graph import components

EPS = 1e-10  # gains below this share of a node's degree are rounding
LOCAL = 1 << 22  # link rows (both ways) that a task holds


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w) both ways, repeated pairs added up; loops, NULL ends and weights that are not positive left out."""
    e = edges.where((F.col("src") != F.col("dst")) & (F.col("w") > 0)).select("src", "dst", F.col("w").cast("double").alias("w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def proposals(sym: DataFrame, lab: DataFrame, degree: DataFrame, two_m: float, gamma: float, turn: int, alone_only: bool) -> DataFrame:
    """Nodes that gain by a move to a community they have a link to, with the best target of all and the best under the colouring.

    A gain is half the rise of quality, in units of weight. Communities are coloured by a hash of (community, turn): under
    the colouring nodes leave only black communities for white ones. ``alone_only``: only nodes alone in theirs move."""
    volume = lab.join(degree, "id").groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
    own = lab.join(degree, "id").join(volume, "c")
    near = (sym.where(F.col("src") != F.col("dst")).join(lab.select(F.col("id").alias("dst"), F.col("c").alias("to")), "dst")
            .groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w")))
    if alone_only:
        own = own.where("members = 1")
    gain = F.col("w") - gamma * F.col("k") * F.col("tot_to") / two_m
    away, white = F.col("to") != F.col("c"), lambda x: F.pmod(F.xxhash64(x, F.lit(turn)), F.lit(2)) == 1
    target = F.struct(gain.alias("g"), (-F.col("to")).alias("n"))
    cand = near.join(own, "id").join(volume.select(F.col("c").alias("to"), F.col("tot").alias("tot_to")), "to")
    best = cand.groupBy("id").agg(F.first("c").alias("c"), F.first("k").alias("k"), F.first("tot").alias("tot"),
                                  F.coalesce(F.max(F.when(~away, F.col("w"))), F.lit(0.0)).alias("inside"),
                                  F.max(F.when(away, target)).alias("any"), F.max(F.when(away & white("to") & ~white("c"), target)).alias("coloured"))
    stay = F.col("inside") - gamma * F.col("k") * (F.col("tot") - F.col("k")) / two_m
    out = best.select("id", "c", "k", (-F.col("any.n")).alias("to"), (F.col("any.g") - stay).alias("g"),
                      (-F.col("coloured.n")).alias("to2"), (F.col("coloured.g") - stay).alias("g2"))
    return out.where(F.col("g") > EPS * F.col("k"))


def _coloured(prop: DataFrame, two_m: float, gamma: float) -> DataFrame:
    """Proposals under the colouring that gain even if all others of the same ends move too.

    Others that leave the same community or enter the same one only add links; they cost at most
    gamma k K / 2 two_m each way, with K the degrees of all that propose it. So every subset raises quality."""
    p = prop.where(F.col("g2") > EPS * F.col("k"))
    into, out = p.groupBy("to2").agg(F.sum("k").alias("k_in")), p.groupBy("c").agg(F.sum("k").alias("k_out"))
    worst = gamma * F.col("k") * (F.col("k_in") + F.col("k_out") - 2 * F.col("k")) / (2 * two_m)
    return p.join(into, "to2").join(out, "c").where(F.col("g2") - worst > EPS * F.col("k")).select("id", F.col("to2").alias("to"))


def _matched(prop: DataFrame) -> DataFrame:
    """Proposals that are the best at both of their communities: no two share one. The best of all is among them."""
    rank = F.struct("g", "id")
    ends = prop.select(rank.alias("r"), F.explode(F.array("c", "to")).alias("end"))
    top = ends.groupBy("end").agg(F.max("r").alias("r")).groupBy(F.col("r.id").alias("id")).agg(F.count("*").alias("ends"))
    return prop.join(top.where("ends = 2").select("id"), "id").select("id", "to")


class _Limit:
    def __init__(self, rounds: int):
        self.left, self.turn = rounds, 0

    def next(self) -> int:
        self.left, self.turn = self.left - 1, self.turn + 1
        if self.left < 0:
            raise ValueError("communities did not settle")
        return self.turn


def _blocks(sym: DataFrame, lab: DataFrame, degree: DataFrame, prop: DataFrame, two_m: float, gamma: float, turn: int, alone_only: bool) -> DataFrame:
    """(id, to) of nodes that move one after the other inside blocks of the communities that ``prop`` names."""
    named = stage(prop.select(F.explode(F.array("c", "to")).alias("c")).distinct())
    volume = lab.join(degree, "id").groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
    ends = stage(lab.join(named, "c").join(degree, "id").join(volume, "c"))
    far = ends.select(F.col("id").alias("dst"), F.col("c").alias("to"))
    rows = stage(sym.where("src != dst").join(ends.withColumnRenamed("id", "src"), "src").join(far, "dst"))
    parts = F.lit(-(-rows.count() // LOCAL) or 1)
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), parts)

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, src = np.unique(pdf["src"].to_numpy(), return_inverse=True)
        names, c = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        one = np.unique(src, return_index=True)[1]
        graph = _Graph(src, np.searchsorted(ids, pdf["dst"].to_numpy()), pdf["w"].to_numpy(), pdf["k"].to_numpy()[one])
        at = np.unique(c, return_index=True)[1]
        new = _sweep(graph, c[one], pdf["tot"].to_numpy()[at], pdf["members"].to_numpy()[at], two_m, gamma, alone_only)
        moved = new != c[one]
        return pd.DataFrame({"id": ids[moved], "to": names[new[moved]]})

    inside = rows.where(block("c") == block("to")).withColumn("block", block("c"))
    return inside.select("block", "src", "dst", "w", "k", "c", "tot", "members").groupBy("block").applyInPandas(move, "id long, to long")


class _Graph:
    """Links by their first end, and the degrees, of nodes 0, 1, ... that a task holds."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray):
        o = np.argsort(src, kind="stable")
        self.src, self.dst, self.w, self.k = src[o], dst[o], w[o], k
        self.first = np.searchsorted(self.src, np.arange(len(k) + 1))


def _sweep(graph: _Graph, lab: np.ndarray, tot: np.ndarray, members: np.ndarray, two_m: float, gamma: float, alone_only: bool) -> np.ndarray:
    """Labels 0, 1, ... after moves of one node at a time, each to the community of most gain (the first of those), until no neighbour of
    a moved node gains."""
    lab, tot, members, k, first = lab.copy(), tot.tolist(), members.tolist(), graph.k.tolist(), graph.first.tolist()
    todo, waits = deque(range(len(k))), np.ones(len(k), bool)
    while todo:
        i = todo.popleft()
        waits[i] = False
        c, ki = int(lab[i]), k[i]
        if alone_only and members[c] > 1:
            continue
        part = slice(first[i], first[i + 1])
        near, into = graph.dst[part], {}
        for to, w in zip(lab[near].tolist(), graph.w[part].tolist()):
            into[to] = into.get(to, 0.0) + w
        if not into:
            continue
        stay = into.pop(c, 0.0) - gamma * ki * (tot[c] - ki) / two_m
        if not into:
            continue
        gain, to = max((w - gamma * ki * tot[to] / two_m, -to) for to, w in into.items())
        if gain - stay > EPS * ki:
            to = -to
            lab[i] = to
            tot[c], tot[to], members[c], members[to] = tot[c] - ki, tot[to] + ki, members[c] - 1, members[to] + 1
            again = near[(lab[near] != to) & ~waits[near]]
            waits[again] = True
            todo.extend(again.tolist())
    return lab


def _sums(lab: np.ndarray, k: np.ndarray) -> np.ndarray:
    return np.bincount(lab, k, minlength=len(k))


def _settle_here(graph: _Graph, lab: np.ndarray, two_m: float, gamma: float, limit: _Limit, alone_only: bool = False) -> tuple[np.ndarray, bool]:
    """``_settle`` in a task."""
    moved = False
    while True:
        limit.next()
        new = _sweep(graph, lab, _sums(lab, graph.k), np.bincount(lab, minlength=len(lab)), two_m, gamma, alone_only)
        if (new == lab).all():
            return lab, moved
        lab, moved = new, True


def _parts(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node that each node has a path to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, src, low[dst])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _communities_here(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, gamma: float, limit: _Limit) -> np.ndarray:
    """``communities`` of a graph that a task holds: links both ways without loops between nodes 0, 1, ..."""
    whole = _Graph(src, dst, w, np.bincount(src, w, minlength=n))
    two_m, lab0, again = float(whole.k.sum()), np.arange(n), True
    while True:
        lab, moved = _settle_here(whole, lab0, two_m, gamma, limit)
        if not moved and not again:
            return lab0
        graph, member = whole, np.arange(n)
        while True:
            own = (lab[graph.src] == lab[graph.dst]) & (graph.src != graph.dst)
            inner = _Graph(graph.src[own], graph.dst[own], graph.w[own], graph.k)
            fine, merged = _settle_here(inner, np.arange(len(graph.k)), two_m, gamma, limit, True)
            if not merged:
                break
            heads, up = np.unique(fine, return_inverse=True)
            pair, at = np.unique(up[graph.src] * len(heads) + up[graph.dst], return_inverse=True)
            # a label is a place of its level, so labels are numbered anew
            lab = np.unique(lab[heads], return_inverse=True)[1]
            graph = _Graph(pair // len(heads), pair % len(heads), np.bincount(at, graph.w), np.bincount(up, graph.k))
            member = up[member]
            inner = graph.src != graph.dst
            lab, _ = _settle_here(_Graph(graph.src[inner], graph.dst[inner], graph.w[inner], graph.k), lab, two_m, gamma, limit)
        flat = lab[member]
        own = flat[whole.src] == flat[whole.dst]
        lab0 = _parts(whole.src[own], whole.dst[own], n)
        own = lab0[whole.src] == lab0[whole.dst]
        g = gamma * whole.k * (_sums(lab0, whole.k)[lab0] - whole.k) / two_m - np.bincount(whole.src[own], whole.w[own], minlength=n)
        gains = np.flatnonzero(g > EPS * whole.k)
        leave = gains[np.lexsort((gains, g[gains], lab0[gains]))]
        leave = leave[np.append(lab0[leave][1:] != lab0[leave][:-1], True)] if len(leave) else leave
        again = len(leave) > 0
        if again:
            parted = lab0.copy()
            parted[leave] = n
            low = np.full(n, n)
            rest = parted < n
            np.minimum.at(low, lab0[rest], np.flatnonzero(rest))
            lab0 = np.where(rest, low[lab0], np.arange(n))


def _in_a_task(sym: DataFrame, gamma: float, rounds: int) -> DataFrame:
    def run(batches):
        held = list(batches)
        if not held:
            return
        whole = pd.concat(held)
        ids, ends = np.unique(whole[["src", "dst"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        try:
            lab = pd.Series(ids[_communities_here(ends[:, 0], ends[:, 1], whole["w"].to_numpy(), len(ids), gamma, _Limit(rounds))], dtype="Int64")
        except ValueError:
            lab = pd.Series([None] * len(ids), dtype="Int64")
        yield pd.DataFrame({"id": ids, "community": lab})

    out = stage(sym.select("src", "dst", "w").coalesce(1).mapInPandas(run, "id long, community long"))
    if not out.where("community IS NULL").isEmpty():
        raise ValueError("communities did not settle")
    return out


def _settle(sym, lab, degree, two_m, gamma, limit, alone_only=False) -> tuple[DataFrame, bool]:
    """Rounds of moves until no node gains; (labels, whether any moved). Quality rises in every round."""
    moved = False
    while True:
        turn = limit.next()
        prop = stage(proposals(sym, lab, degree, two_m, gamma, turn, alone_only))
        if prop.isEmpty():
            return lab, moved
        go = stage(_blocks(sym, lab, degree, prop, two_m, gamma, turn, alone_only))
        if go.isEmpty():  # no gain inside a block
            go = stage(_coloured(prop, two_m, gamma))
        if go.isEmpty():
            go = _matched(prop)
        lab = stage(lab.join(go, "id", "left").select("id", F.coalesce("to", "c").alias("c")))
        moved = True


def _inside(sym: DataFrame, lab: DataFrame) -> DataFrame:
    a, b = lab.select(F.col("id").alias("src"), F.col("c").alias("cs")), lab.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
    return sym.join(a, "src").join(b, "dst").where("cs = cd AND src != dst").select("src", "dst", "w")


def _loners(sym: DataFrame, lab: DataFrame, degree: DataFrame, two_m: float, gamma: float) -> DataFrame:
    """The node of each community that gains most by leaving for one of its own."""
    volume = lab.join(degree, "id").groupBy("c").agg(F.sum("k").alias("tot"))
    held = _inside(sym, lab).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("w"))
    own = lab.join(degree, "id").join(volume, "c").join(held, "id", "left")
    gain = gamma * F.col("k") * (F.col("tot") - F.col("k")) / two_m - F.coalesce("w", F.lit(0.0))
    return own.withColumn("g", gain).where(F.col("g") > EPS * F.col("k")).groupBy("c").agg(F.max_by("id", F.struct("g", "id")).alias("id")).select("id", F.lit(True).alias("leaves"))


def communities(edges: DataFrame, gamma: float = 1.0, rounds: int = 2000) -> DataFrame:
    """(id, community) for the nodes of ``edges`` (BIGINT src, dst, w; a pair once): modularity by local moves.

    A pass moves nodes until none gains, refines each community from single nodes (only nodes still alone move, along links
    inside the community), contracts the refined groups, and goes on with them from the communities found, until nothing
    contracts. Then the nodes are taken up again: communities without a path inside are split, a node that gains alone leaves.
    It ends when nodes taken up again do not move: no node gains by a move, and every community is connected. Every round raises
    quality, so the loop ends; ``rounds`` is a safety limit that raises ValueError. Ties go to the smallest community, labels
    are the smallest id. Loops, NULL ends and weights that are not positive are left out; no edges give no rows."""
    sym0 = stage(symmetric(edges))
    if sym0.count() <= LOCAL:
        return _in_a_task(sym0, gamma, rounds)
    degree0 = stage(sym0.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    two_m = degree0.agg(F.sum("k")).first()[0]
    lab0 = degree0.select("id", F.col("id").alias("c"))
    if two_m is None:
        return lab0.select("id", F.col("c").alias("community"))
    limit, again = _Limit(rounds), True
    while True:
        lab, moved = _settle(sym0, lab0, degree0, two_m, gamma, limit)
        if not moved and not again:
            return lab0.select("id", F.col("c").alias("community"))
        sym, degree, member = sym0, degree0, degree0.select("id", F.col("id").alias("at"))
        while True:
            single = degree.select("id", F.col("id").alias("c"))
            fine, merged = _settle(stage(_inside(sym, lab)), single, degree, two_m, gamma, limit, alone_only=True)
            if not merged:
                break
            up = fine.withColumnRenamed("c", "g")
            lab = stage(lab.join(up, "id").groupBy(F.col("g").alias("id")).agg(F.first("c").alias("c")))
            degree = stage(degree.join(up, "id").groupBy(F.col("g").alias("id")).agg(F.sum("k").alias("k")))
            ends = up.select(F.col("id").alias("src"), F.col("g").alias("gs")), up.select(F.col("id").alias("dst"), F.col("g").alias("gd"))
            sym = stage(sym.join(ends[0], "src").join(ends[1], "dst").groupBy(F.col("gs").alias("src"), F.col("gd").alias("dst")).agg(F.sum("w").alias("w")))
            member = stage(member.join(up.withColumnRenamed("id", "at"), "at").select("id", F.col("g").alias("at")))
            lab, _ = _settle(sym, lab, degree, two_m, gamma, limit)
        flat = stage(member.join(lab.withColumnRenamed("id", "at"), "at").select("id", "c"))
        lab0 = components(flat.select("id"), _inside(sym0, flat).select("src", "dst"), "id").withColumnRenamed("component", "c")
        leave = stage(_loners(sym0, lab0, degree0, two_m, gamma))
        again = not leave.isEmpty()
        if again:
            parted = stage(lab0.join(leave, "id", "left"))
            rest = parted.where("leaves IS NULL").groupBy("c").agg(F.min("id").alias("low"))
            lab0 = stage(parted.join(rest, "c", "left").select("id", F.when(F.col("leaves"), F.col("id")).otherwise(F.col("low")).alias("c")))
