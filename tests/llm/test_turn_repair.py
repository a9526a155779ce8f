"""Conversation repair against exhaustive search and a plain walk over whole conversations."""
import hashlib
import random
import re
import zlib

import pytest

from obsloom.llm import turn_repair as T

FORM = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """Least (cost, audit, roles) over every sequence of edits; rows are (initial, kind)."""
    best = None

    def go(i, out, audit, cost, inserted):
        nonlocal best
        if cost > (best[0] if best else 3 * len(rows)):
            return
        if i == len(rows) and FORM.fullmatch(out):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserted < 5:
            for r in "ua":
                go(i, out + r, audit + "I", cost + 2, inserted + 1)
        if i < len(rows):
            initial, kind = rows[i]
            if kind != T.FORCED:
                go(i + 1, out + initial, audit + "K", cost + kind, inserted)
                for r in "ua":
                    go(i + 1, out + r, audit + "R", cost + 2 + kind, inserted)
            go(i + 1, out, audit + "D", cost + 3, inserted)

    go(0, "", "", 0, 0)
    return best


def test_cells_equal_exhaustive_search_at_every_cut():
    rnd = random.Random(1)
    for _ in range(250):
        rows = [(rnd.choice("suuaa "), rnd.choice([0, 0, 0, 1, 2])) for _ in range(rnd.randint(1, 5))]
        want = exhaustive(rows)
        cells = [T.terminal(*r) for r in rows]
        for cut in range(len(rows)):
            cost, audit, parts = T.best_path([T.parse(c) for c in (cells[:cut], cells[cut:]) if c])
            assert (cost, audit) == want[:2] and "".join(w for _, w in parts) == audit
        marks = T.edits(0, audit, [r for r, _ in rows], [1] * len(rows)) if cut == 0 else None
        assert marks is None or "".join(m[1] for own in marks for m in own).replace(" ", "") == want[2]


def test_every_halving_leads_to_the_same_cell():
    rnd = random.Random(2)
    cells = [T.terminal(rnd.choice("sua "), rnd.choice([0, 1, 2])) for _ in range(23)]
    whole = T.parse(cells)
    for cut in range(1, 23):
        assert T.combine(T.parse(cells[:cut]), T.parse(cells[cut:])) == whole


def expected(rows):
    """conv_id -> report and digest of damaged and repaired conversations, one row after the other."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in own:
            inner = text.strip(" \t\n\v\f\r")
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((role, text))
            kinds.append({None: 0, "truncated": 1}.get(fault, T.FORCED))
            if fault:
                count[fault] += 1
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        # every audit of least cost by the prefix done and the roles so far; roles are kept as the last one and whether s led
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        now = {"": (0, "")}

        def insert(now):
            grown = dict(now)
            for _ in range(3):
                for p, (c, w) in list(grown.items()):
                    for r in step[p]:
                        if r in "ua":
                            grown[r] = min(grown.get(r, (1 << 60, "")), (c + 2, w + "I"))
            return grown

        for initial, kind in zip(initials, kinds):
            after = {}
            for p, (c, w) in insert(now).items():
                ways = [(p, c + 3, w + "D")]
                if kind != T.FORCED:
                    ways += [(r, c + kind + (0 if r == initial else 2), w + ("K" if r == initial else "R")) for r in step[p] if r == initial or r in "ua"]
                    ways += [(r, c + kind + 2, w + "R") for r in step[p] if r in "ua"]
                for q, c2, w2 in ways:
                    after[q] = min(after.get(q, (1 << 60, "")), (c2, w2))
            now = after
        now = insert(now)
        cost, audit = min(now[q] for q in ("", "a") if q in now)
        lines, i, last = [], 0, ""
        for letter in audit:
            _, role, text = own[i] if letter != "I" else (None, "", "")
            i += letter != "I"
            if letter != "D":
                initial = role[:1] if letter == "K" else "a" if last == "u" else "u"
                last = initial
                lines.append((role if letter == "K" else {"u": "user", "a": "assistant"}[initial]) + ":" + text)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations():
    rnd = random.Random(7)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "ufo"]
    texts = ["Hello there.", "What? ", "cut off", "", None, " \t\n", "Yes!", "é?", "no stop ü", "x ", "long " * 30_000 + "."]
    rows = [(conv, turn, rnd.choice(roles), rnd.choice(texts[:10]) if rnd.random() < 0.5 else f"own {turn}.") for conv in range(60) for turn in range(rnd.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["a.", f"{t}.", "cut"])) for t in range(900)]  # several spans
    rows += [(101, t // 3, "user", "same.") for t in range(700)] + [(102, 5, "assistant", "one turn.")] * 400
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (103, None, "user", "a."), (103, None, None, None), (104, 1, "assistant", texts[10])]
    rows += [(200 + c, c, "user", "dropped?") for c in range(40)]  # some lose their only row
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_operator(spark, partitions):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos long, said string").repartition(partitions)
    got = {r[0]: tuple(r[1:]) for r in T.damage_and_repair(table).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert [(c, got[c], want[c]) for c in want if got[c] != want[c]] == []
    assert any(v[6] == "" and v[5] == 0 for v in want.values())


def test_rows_and_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.damage_and_repair(none).collect() == []
    reports, rows = T.repair(spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "no"), (1, 3, "user", "")], none.schema))
    assert [tuple(r) for r in reports.select("cost", "audit").collect()] == [exhaustive([("a", 0), ("a", 0), ("u", 1), ("u", 2)])[:2]]
    left = rows.orderBy("at", "step").collect()
    assert FORM.fullmatch("".join(r.role[0] for r in left)) and "".join(r.edit for r in left) == reports.first().audit.replace("D", "")
