import hashlib
import itertools
import random
import re
import zlib

import pytest

from relscope.llm import conversation_repair as repair
from relscope.llm import queries

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\f\r"
GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit) by relaxing every edit at every place, rows left to right, until nothing changes."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                p = repair.NEXT[q]
                best[p] = min(best.get(p, (10**9, "")), (c + 5, a + "I"))
        return best

    inserted(best)
    for role, fault in rows:
        new = {}

        def take(q, c, a):
            new[q] = min(new.get(q, (10**9, "")), (c, a))

        for q, (c, a) in best.items():
            take(q, c + 2, a + "D")
            if fault != repair.GONE:
                more = 5 * (fault == repair.CUT)
                if (q, role) in repair.MOVES:
                    take(repair.MOVES[q, role], c + more, a + "K")
                take(repair.NEXT[q], c + 1 + more, a + "R")
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def every_audit(rows, most):
    """(cost, audit) by trying all audits of up to `most` letters: no states, only the pattern wanted."""
    found = []
    for size in range(len(rows), most + 1):
        for audit in itertools.product("DIKR", repeat=size):
            if sum(x != "I" for x in audit) != len(rows):
                continue
            at, cost, choices = 0, 0, [""]
            for x in audit:
                if x == "I":
                    cost, choices = cost + 5, [c + r for c in choices for r in "ua"]
                    continue
                role, fault = rows[at]
                at += 1
                if x == "D":
                    cost += 2
                    continue
                if fault == repair.GONE:
                    choices = []
                cost += 5 * (fault == repair.CUT) + (x == "R")
                choices = [c + role for c in choices] if x == "K" else [c + r for c in choices for r in "ua"]
            if any(GOOD.fullmatch(c) for c in choices):
                found.append((cost, "".join(audit)))
    return min(found)


def test_search_against_all_audits():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suaut"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 4))]
        # deleting all costs 2 a row, so no answer has more than two inserts
        assert repair.search(rows, 0, repair.GOALS) == every_audit(rows, len(rows) + 2) == cheapest(rows)


@pytest.mark.parametrize("segment", [256, 7, 1])
def test_segments_make_no_difference(monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(150):
        rows = [(rng.choice("suauauat"), rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 60))]
        edits = repair.Edits()
        for row in rows:
            edits.add(*row)
        assert edits.best() == cheapest(rows)


def expected(rows):
    """The report of one conversation's rows (turn, role, text) in their order."""
    turns = [t for t, _, _ in rows if t is not None]
    counts, seen, faults = [0, 0, 0], set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        faults.append(repair.FINE if fault is None else repair.CUT if fault == 2 else repair.GONE)
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(list(zip(initials, faults)))
    out, left, at = [], iter(rows), ""
    for x in audit:
        needed = "user" if not at or at[-1] in "sa" else "assistant"
        if x == "I":
            out.append((needed, ""))
            at += needed[0]
            continue
        _, role, text = next(left)
        if x != "D":
            out.append((needed if x == "R" else role, text))
            at += out[-1][0][0]
    assert GOOD.fullmatch(at)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(conv, turn, role, text):
    role, text = (" " if v is None else v for v in (role, text))
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def key(row):
    turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def compare(got, given):
    want = {}
    for conv, turn, role, text in given:
        want.setdefault(conv, []).extend(damage(conv, turn, role, text))
    found = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert len(found) == len(want)
    for conv, rows in want.items():
        assert found[conv] == expected(sorted(rows, key=key)), conv
    return want


def test_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert queries.op11_conversation_repair(spark, SF).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    compare(queries.op11_conversation_repair(spark, SF), given)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None, t, rng.choice(["user", "assistant", None]), rng.choice(["a.", "b", None, "", "\t"])) for t in [None, None, 3, 9, 9]]
    rows += [(1, t, "user", "x.") for t in range(6)] + [(2, None, "system", "s!"), (2, None, "system", "s!"), (3, 5, "tool", "t?"), (4, 0, "", ".")]
    # every row dropped: conversations whose only turn falls to 0
    rows += [(c, 0, "user", "gone.") for c in range(100, 140)]
    rows += [(50, t, ["user", "assistant"][t % 2], f"turn {t}." + "y" * (100000 if t == 7 else 0)) for t in range(700)]
    rows += [(60, 1, "user", "Ünï. "), (60, 2, "assistant", "é? \n"), (60, 3, "user", " ")]
    path = str(tmp_path / "conversations.parquet")
    made = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int")
    made.write.parquet(path)
    want = compare(queries.op11_conversation_repair(spark, str(tmp_path)), rows)
    assert any(not v for v in want.values())
    empty = made.limit(0)
    assert repair.repair_report(empty).count() == repair.repaired(empty, repair.repair_report(empty)).count() == 0


def test_repaired_rows(spark):
    rows = [("a", 0, "assistant", "hi."), ("a", 1, "user", "ho."), ("a", 2, "assistant", "cut"), ("b", 0, "user", " "), ("c", 0, "user", "q?"), ("c", 1, "assistant", "r.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    report = repair.repair_report(df)
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {"a": (4, "RRD"), "b": (2, "D"), "c": (0, "KK")}
    out = sorted(tuple(r) for r in repair.repaired(df, report).collect())
    assert [r for r in out if r[0] == "c"] == [("c", 0, "user", "q?"), ("c", 1, "assistant", "r.")]
    assert not [r for r in out if r[0] == "b"]
