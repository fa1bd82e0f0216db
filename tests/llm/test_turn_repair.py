"""Repaired conversations against a table of all prefixes, and against every edit sequence."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from graphloom.llm import queries, turn_repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def ordered(rows):
    said = lambda r: hashlib.sha256(r[3].encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), said(r)))


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, edits, lines) of the cheapest edits, the least in ASCII order, from the last row back."""
    follows = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    takes = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    best = [{0: (0, "", ()), 3: (0, "", ())}]
    for i in range(len(rows), -1, -1):
        row = rows[i] if i < len(rows) else None
        here = dict(best[0]) if row is None else {}

        def offer(s, x):
            if s not in here or (x[0], x[1]) < (here[s][0], here[s][1]):
                here[s] = x
                return True

        if row is not None:
            bad = kinds[i] in ("blank", "duplicate")
            extra = 5 if kinds[i] == "truncated" else 0
            for s in range(4):
                if s in best[0]:
                    c, e, t = best[0][s]
                    offer(s, (c + 2, "D" + e, t))
                if not bad:
                    role, text = row[2], row[3]
                    k = follows.get((role[:1], s))
                    if k in best[0]:
                        c, e, t = best[0][k]
                        offer(s, (c + extra, "K" + e, (f"{role}:{text}", *t)))
                    name, k = takes[s]
                    if k in best[0]:
                        c, e, t = best[0][k]
                        offer(s, (c + 1 + extra, "R" + e, (f"{name}:{text}", *t)))
        while any([offer(s, (here[k][0] + 5, "I" + here[k][1], (f"{name}:", *here[k][2]))) for s, (name, k) in takes.items() if k in here]):
            pass
        best.insert(0, here)
    return best[0][0]


def exhaustive(rows, kinds, most):
    """The same by trying every sequence of edits of a cost up to ``most``."""
    found = []

    def go(i, cost, edits, roles, lines):
        if cost > most:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, edits, lines))
        for name in ("user", "assistant"):
            go(i, cost + 5, edits + "I", roles + name[0], (*lines, f"{name}:"))
        if i < len(rows):
            role, text = rows[i][2:]
            go(i + 1, cost + 2, edits + "D", roles, lines)
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 if kinds[i] == "truncated" else 0
                go(i + 1, cost + extra, edits + "K", roles + role[:1], (*lines, f"{role}:{text}"))
                for name in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, edits + "R", roles + name[0], (*lines, f"{name}:{text}"))

    go(0, 0, "", "", ())
    return min(found)


def brute(rows):
    convs = collections.defaultdict(list)
    for r in damaged(rows):
        convs[r[0]].append(r)
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = ordered(convs[conv])
        kinds = faults(own)
        cost, audit, lines = cheapest(own, kinds)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = zip([r[2][:1] for r in own], [r[2][:1] for r in own][1:])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(rnd, n, longest):
    """Conversations with nulls, ties, repeats, unknown roles, blank and cut texts."""
    rows = []
    for conv in [*range(n), None]:
        for t in range(rnd.randint(1, longest)):
            turn = rnd.choice([t, t, t, t * 2, 3, None])
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rnd.choice(["Yes.", "Ok!", "What is it?", f"no end {t}", " \t", "", None, f"a.\x0b {rnd.random()}?", "é", "Long. " * 50])
            rows.append((conv, turn, role, text))
    return rows


def test_search_is_the_first_cheapest_path():
    rnd = random.Random(1)
    for _ in range(60):
        rows = [(0, t, rnd.choice(["user", "user", "assistant", "system", "x"]), rnd.choice(["Yes.", f"No {t}", "", f"{t}!"])) for t in range(rnd.randint(0, 4))]
        kinds = faults(rows)
        cost, audit, lines = cheapest(rows, kinds)
        assert (cost, audit, lines) == exhaustive(rows, kinds, cost)
        search = [(r[2][:1], int(k in ("blank", "duplicate")), k == "truncated") for r, k in zip(rows, kinds)]
        assert turn_repair.Repair(search, turn_repair.END).best(0) == (cost, audit)


def test_long_search_stays_small():
    """A failed state is not searched again with what it lacked before."""
    rnd = random.Random(2)
    rows = [(rnd.choice("suax"), 0, rnd.random() < 0.2) for _ in range(turn_repair.SEGMENT)]
    repair, calls = turn_repair.Repair(rows, turn_repair.END), []
    within = repair.within
    repair.within = lambda *a: calls.append(a) or within(*a)
    assert repair.best(0)[0] > 10
    assert len(calls) < 60 * len(rows)


@pytest.mark.parametrize("size", [3, 64])
def test_conversations(spark, monkeypatch, size):
    """Also with segments of three rows, so that all conversations are cut within and between partitions."""
    monkeypatch.setattr(turn_repair, "SEGMENT", size)
    rnd = random.Random(size)
    rows = conversations(rnd, 60, 9) + [(1000, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", f"{t}?", f"{t}!"])) for t in range(700)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, n int, part string").repartition(7)
    got = turn_repair.repair(df)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_empty_and_many_copies(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(df).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(dropped, 1, "user", "Gone.")] + [(5, 1, "user", "Again.")] * 500 + [(5, 2, "assistant", "Once.")]
    got = turn_repair.repair(spark.createDataFrame(rows, df.schema))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
    none = next(r for r in got.collect() if r.conv_id == dropped)
    assert tuple(none)[1:7] == (0,) * 6 and none.audit == "" and none.repaired_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_turn_repair(spark, SF).select(COLUMNS).collect())) == sorted(brute(rows))
