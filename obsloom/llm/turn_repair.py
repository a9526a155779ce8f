"""Repair of conversations by weighted interval parsing.

Target: role initials ``(s?(ua)+)?``. The repair grammar is in Chomsky normal form: a nonterminal X(p, q) stands for the rows of a span,
edited so that their roles lead from state p to state q of that language, and X(p, q) -> X(p, r) X(r, q). Terminals are a row's edits:
Keep, Rerole, Delete. A cell holds the least (cost, audit) of each nonterminal, closed under insertions on both sides of every row.
Spans are combined bottom-up by length: rows, pairs, fours and so on to spans of at most 256 rows, then the spans of a conversation.
As a nonterminal fixes the states at both ends, every way to halve a span leads to the same cell, so one halving is enough.

Two audits of a span with equal cost never begin one another (they would differ by insertions only, which cost), so the ASCII-least
audit of a whole is made of ASCII-least audits of its parts."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage

SPAN_BITS = 8
START, SYSTEM, USER, DONE = range(4)  # nothing yet, after s, after u, after ua
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": DONE}, DONE: {"u": USER}}
REACH = {START: (START, SYSTEM, USER, DONE), SYSTEM: (SYSTEM, USER, DONE), USER: (USER, DONE), DONE: (USER, DONE)}
NONTERMINALS = [(p, q) for p in REACH for q in REACH[p]]
AT = {pq: i for i, pq in enumerate(NONTERMINALS)}
PRODUCTIONS = [(AT[p, r], AT[r, q], AT[p, q]) for p, r in NONTERMINALS for q in REACH[r]]
NEXT = {p: next(r for r in to if r in "ua") for p, to in STEPS.items()}  # the one role that Rerole and Insert can give in a state
FORCED = 2  # kind of a row that must go; 1 is a truncated one, 0 any other

Cell = list  # (cost, audit) or None by nonterminal


def combine(left: Cell, right: Cell) -> Cell:
    out: Cell = [None] * len(NONTERMINALS)
    for i, j, k in PRODUCTIONS:
        a, b, best = left[i], right[j], out[k]
        if a is None or b is None:
            continue
        cost = a[0] + b[0]
        if best is None or cost < best[0]:
            out[k] = (cost, a[1] + b[1])
        elif cost == best[0]:
            out[k] = (cost, min(best[1], a[1] + b[1]))
    return out


def _cell(entries: dict) -> Cell:
    return [entries.get(pq) for pq in NONTERMINALS]


def _closure() -> Cell:
    """Insertions alone: from at most one on, until no cell gets better."""
    one = _cell({(p, p): (0, "") for p in STEPS} | {(p, STEPS[p][role]): (2, "I") for p, role in NEXT.items()})
    now = one
    while (more := combine(now, one)) != now:
        now = more
    return now


INSERTED = _closure()


def terminal(initial: str, kind: int, copies: int = 1) -> Cell:
    """Cell of a row, or of ``copies`` rows that must go."""
    if kind == FORCED:
        own = {(p, p): (3 * copies, "D" * copies) for p in STEPS}
    else:
        own = {(p, p): (3, "D") for p in STEPS}
        for p, to in STEPS.items():
            own[p, to[NEXT[p]]] = (2 + kind, "R")
            if initial in to:
                own[p, to[initial]] = (kind, "K")
    return combine(combine(INSERTED, _cell(own)), INSERTED)


def parse(cells: list[Cell]) -> Cell:
    """Cell of a span from those of its rows, by doubling lengths."""
    while len(cells) > 1:
        pairs = [combine(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(cells) - len(cells) % 2:]
    return cells[0]


def best_path(spans: list[Cell]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost and audit of a conversation, and for each span the state before it and its part of the audit."""
    reach, steps = {START: (0, "", START)}, []
    for cell in spans:
        following: dict = {}
        for p, (cost, audit, _) in reach.items():
            for q in REACH[p]:
                if cell[AT[p, q]] is not None:
                    add, letters = cell[AT[p, q]]
                    way = (cost + add, audit + letters, p)
                    if q not in following or way < following[q]:
                        following[q] = way
        steps.append(following)
        reach = following
    cost, audit, end = min((reach[q][0], reach[q][1], q) for q in (START, DONE) if q in reach)
    parts = []
    for cell, following in zip(reversed(spans), reversed(steps)):
        before = following[end][2]
        parts.append((before, cell[AT[before, end]][1]))
        end = before
    return cost, audit, parts[::-1]


def edits(state: int, audit: str, initials: list[str], copies: list[int]) -> list[list[str]]:
    """A span's audit dealt to its rows, each edit with the initial of the row it leaves (a blank for Delete). An insertion belongs to
    the row after it, the last ones to the last row."""
    out, at = [], 0
    for k, (initial, left) in enumerate(zip(initials, copies)):
        own: list[str] = []
        while left or k == len(copies) - 1 and at < len(audit):
            letter, role = audit[at], " "
            at += 1
            left -= letter != "I"
            if letter != "D":
                role = initial if letter == "K" else NEXT[state]
                state = STEPS[state][role]
            own.append(letter + role)
        out.append(own)
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one row in twenty each dropped, emptied, robbed of its full stops, repeated, given to the user,
    by the CRC-32 of ``conv_id:turn``. Nulls stand as one space, in the hashed key too (conv_id and turn stay null themselves)."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.col("case")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"),
                                shown("text").alias("text"), F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20)).alias("case"))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where(case != 0).select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies))
    return rows.select("conv_id", "turn", "role", "text")


def _faults(turns: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with ``copies``; ``pos`` numbers all rows by conversation, turn (nulls first), role and text.

    ``first`` tells whether the role and text are new to the conversation: then one copy stands for itself, the others are duplicates."""
    nothing = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), nothing).alias("role"), F.coalesce(F.col("text").cast("string"), nothing).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("said", F.sha2(F.concat_ws("\u0000", "role", "text"), 256))
    seen = rows.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))).alias("start"), F.count("*").alias("turns"))
    again = seen.where("turns > 1").select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), F.col("start.turn").alias("_turn"), F.lit(True).alias("_again"))
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = rows.select("conv_id", "turn", "role", "text", "copies", (F.col("_again").isNull() | F.col("turn").eqNullSafe(F.col("_turn"))).alias("first"),
                       (last == "").alias("blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("cut"), F.substring("text", 1, 64).alias("head"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "head").drop("head")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return stage(ordered.withColumn("pos", F.monotonically_increasing_id()))


_FOUND = ["blank", "duplicate", "truncated", "illegal", "turns"]
_SPAN = ("conv_id long, block long, cells array<struct<cost:long,audit:string>>, initials string, copies array<long>, at long, low long, high long, " + ", ".join(f"{n} long" for n in _FOUND))


def _spans(rows: DataFrame) -> DataFrame:
    """Cells and counts of each span: the rows of a conversation whose numbers share all but the last eight bits."""
    light = rows.select("conv_id", F.shiftright("pos", SPAN_BITS).alias("block"), F.struct(
        "pos", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "first", "blank", "cut").alias("row"))
    grouped = light.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def work(batches):
        known: dict = {}

        def cell(*key):
            if key not in known:
                known[key] = terminal(*key)
            return known[key]

        for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
            out = []
            for conv, block, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cells, initials, copies, turns, counts = [], [], [], [], dict.fromkeys(_FOUND, 0)
                for r in own:
                    kept = 0 if r["blank"] or not r["first"] else 1
                    initial = r["initial"] or " "
                    initial = initial if initial in "sua" else " "
                    if kept:
                        cells.append(cell(initial, int(r["cut"])))
                        counts["truncated"] += r["cut"]
                    gone = r["copies"] - kept
                    counts["blank" if r["blank"] else "duplicate"] += gone
                    if gone:
                        forced = terminal(initial, FORCED, gone) if gone > 4 else cell(initial, FORCED, gone)
                        cells.append(forced)
                    counts["illegal"] += (r["copies"] - 1) + bool(initials and initials[-1] + initial not in ("su", "ua", "au"))
                    if r["turn"] is not None:
                        counts["turns"] += not turns or turns[-1] != r["turn"]
                        turns.append(r["turn"])
                    initials.append(initial)
                    copies.append(r["copies"])
                out.append({"conv_id": conv, "block": block, "cells": [c and {"cost": c[0], "audit": c[1]} for c in parse(cells)], "initials": "".join(initials),
                            "copies": copies, "at": own[0]["pos"], "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
                            **counts})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = _arrow(_SPAN, grouped)
    return grouped.mapInArrow(work, _SPAN)


def _arrow(ddl: str, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


_REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, marks array<struct<pos:long,edits:array<string>>>"


def _conversations(spans: DataFrame) -> DataFrame:
    """One row a conversation from its spans, in order. What meets here is as long as the audit it returns, never a text."""
    fields = [f.name for f in spans.schema if f.name != "conv_id"]
    grouped = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: (
        F.when(a["block"] < b["block"], -1).when(a["block"] > b["block"], 1).otherwise(0))).alias("spans"))

    def work(batches):
        for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
            out = []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cost, audit, parts = best_path([[c and (c["cost"], c["audit"]) for c in s["cells"]] for s in own])
                total = {n: sum(s[n] for s in own) for n in _FOUND}
                lows, highs = [s["low"] for s in own if s["low"] is not None], [s["high"] for s in own if s["high"] is not None]
                for a, b in zip(own, own[1:]):
                    total["illegal"] += a["initials"][-1] + b["initials"][0] not in ("su", "ua", "au")
                total["turns"] -= sum(a == b for a, b in zip(highs, lows[1:]))
                marks = []
                for (state, letters), s in zip(parts, own):
                    dealt = edits(state, letters, list(s["initials"]), s["copies"])
                    marks += [{"pos": s["at"] + i, "edits": e} for i, e in enumerate(dealt)]
                out.append({"conv_id": conv, "gaps": highs[-1] - lows[0] + 1 - total["turns"] if lows else 0, **{n: total[n] for n in _FOUND[:4]},
                            "cost": cost, "audit": audit, "marks": marks})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = _arrow(_REPAIR, grouped)
    return grouped.mapInArrow(work, _REPAIR)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rows) of the cheapest repair of every conversation in (conv_id, turn, role, text).

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row a conversation. rows: conv_id, at, step, edit, role,
    text, what each conversation consists of afterwards, in the order of (at, step); ``edit`` is K, R or I. Null roles and texts count as
    one space (such a row is blank if its text is), a null conv_id is a conversation, null turns come first, equal turns are ordered by
    role and text; repeated rows are duplicates. Empty tables give empty ones; extra columns, whatever their names, are left out. Rows
    are spread by number, so that a conversation of any length has its texts in many tasks, very long texts are never gathered; only the
    letters of its audit meet."""
    rows = _faults(turns)
    done = stage(_conversations(_spans(rows)))
    marks = done.select(F.explode("marks").alias("m")).select(F.col("m.pos").alias("_pos"), "m.edits")
    dealt = rows.join(marks, F.col("pos") == F.col("_pos")).select("conv_id", "pos", "role", "text", F.posexplode("edits").alias("step", "mark"))
    edit, left = F.substring("mark", 1, 1), F.substring("mark", 2, 1)
    role = F.when(edit == "K", F.col("role")).when(left == "u", "user").otherwise("assistant")
    after = dealt.where(edit != "D").select("conv_id", F.col("pos").alias("at"), "step", edit.alias("edit"), role.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))
    return done.drop("marks"), after


def digest(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) over ``role:text`` of each conversation's rows, joined by newlines in the order of (at, step).

    A digest is taken in order, so one task reads a conversation's texts, one after the other from the sorted shuffle."""
    def work(batches):
        now, state, first = None, None, True

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        yield flush()
                    now, state, first = conv, hashlib.sha256(), True
                state.update(("" if first else "\n").encode() + line.encode())
                first = False
        if state is not None:
            yield flush()

    ordered = rows.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "at", "step").repartition("conv_id")
    return ordered.sortWithinPartitions(F.asc_nulls_first("conv_id"), "at", "step").select("conv_id", "line").mapInArrow(work, "conv_id long, sha256 string")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Reports and digest for every conv_id of ``conversations`` after ``damage``; one that has lost all its rows has zeros, an empty
    audit and the digest of the empty string. Odd input as in ``repair``."""
    reports, rows = repair(damage(conversations))
    sha = digest(rows).select(F.col("conv_id").alias("_sha_conv"), F.col("sha256"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    reports = reports.withColumnRenamed("conv_id", "_report_conv")
    joined = every.join(reports, F.col("conv_id").eqNullSafe(F.col("_report_conv")), "left").join(sha, F.col("conv_id").eqNullSafe(F.col("_sha_conv")), "left")
    counts = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
