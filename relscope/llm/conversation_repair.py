"""Conversation structure repair: the cheapest edits that bring the roles of a conversation into order, found by
bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows used up, what may follow); the roles wanted are `(s?(ua)+)?`, by their initials. Keep, Rerole
and Delete use a row, Insert does not. A forward and a reverse heap take nodes by cost, and at one cost by how far they are,
as only Keep is free and always goes on: so when a node is taken its least audit is final, too. The search goes on until no
crossing of the same cost can be left; the least of all concatenated audits of cheapest crossings is the answer. No audit of
equal cost is another's beginning, as what is left over could only be inserts, which cost. So the least audit of a whole is
made of the least audits of its parts, and a long conversation is searched in segments of bounded size, from each state to
each, that are joined one after another.

Rows are dealt by conversation and sorted by Spark, and pass through a task as a stream. The first pass is over narrow rows
(role initial, faults, digest) and gives counts and audit; the second carries the audit beside the rows and applies it, so
no conversation's texts are ever held.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean

SPACE = " \t\n\x0b\f\r"
#: Costs of the edits; OPEN is added for a truncated row that stays.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
OPEN = 5
#: States: nothing yet, behind s, behind u, behind a. A keep moves by the row's initial, other edits to what is needed.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDED, NEXT = "uuau", (2, 2, 3, 2)
BEFORE = {q: [p for p in range(4) if NEXT[p] == q] for q in range(4)}
KEPT = {(q, r): [p for p in range(4) if MOVES.get((p, r)) == q] for q in range(4) for r in "sua"}
GOALS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FINE, GONE, CUT = 0, 1, 2  # a row's fault: none, must be deleted, truncated
#: Rows searched at once.
SEGMENT = 256


def search(rows: list[tuple[str, int]], start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows (initial, fault) that lead from a state to one of the goals, of equal
    ones the least audit; None if there are none."""
    n = len(rows)

    def ahead(i, q):
        yield i, NEXT[q], COST["I"], "I"
        if i < n:
            role, fault = rows[i]
            yield i + 1, q, COST["D"], "D"
            if fault != GONE:
                more = OPEN * (fault == CUT)
                if (q, role) in MOVES:
                    yield i + 1, MOVES[q, role], more, "K"
                if role != NEEDED[q]:
                    yield i + 1, NEXT[q], COST["R"] + more, "R"

    def behind(i, q):
        for p in BEFORE[q]:
            yield i, p, COST["I"], "I"
        if i:
            role, fault = rows[i - 1]
            yield i - 1, q, COST["D"], "D"
            if fault != GONE:
                more = OPEN * (fault == CUT)
                for p in KEPT.get((q, role), ()):
                    yield i - 1, p, more, "K"
                for p in BEFORE[q]:
                    if role != NEEDED[p]:
                        yield i - 1, p, COST["R"] + more, "R"

    labels = ({(0, start): (0, "")}, {(n, q): (0, "") for q in goals})
    heaps = ([(0, 0, start)], [(0, 0, q) for q in goals])
    done: tuple[set, set] = (set(), set())
    best = min((0 for node in labels[0] if node in labels[1]), default=None)
    while all(heaps) and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0] < heaps[0][0])
        own, other, heap = labels[side], labels[1 - side], heaps[side]
        cost, far, q = heapq.heappop(heap)
        node = (n - far if side else far, q)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = own[node][1]
        for i, p, more, letter in (behind if side else ahead)(*node):
            new = (cost + more, letter + audit if side else audit + letter)
            old = own.get((i, p))
            if old is None or new < old:
                own[i, p] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(heap, (new[0], n - i if side else i, p))
                if (i, p) in other:
                    total = new[0] + other[i, p][0]
                    best = total if best is None else min(best, total)
    if best is None:
        return None
    crossings = ((a[0] + b[0], a[1] + b[1]) for node, a in labels[0].items() if (b := labels[1].get(node)))
    return min(c for c in crossings if c[0] == best)


class Edits:
    """The cheapest edits of a conversation whose rows come one by one."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.paths = {0: (0, "")}

    def add(self, role: str, fault: int) -> None:
        if len(self.rows) == SEGMENT:
            self.paths = {q: path for q in range(4) if (path := self._ways((q,)))}
            self.rows = []
        self.rows.append((role, fault))

    def _ways(self, goals):
        found = ((q, search(self.rows, q, goals)) for q in self.paths)
        return min(((self.paths[q][0] + way[0], self.paths[q][1] + way[1]) for q, way in found if way), default=None)

    def best(self) -> tuple[int, str]:
        return self._ways(GOALS)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows by conversation in their order: turn, nulls first, and within a turn role and digest."""
    digest = F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", digest)


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *[F.asc_nulls_first(c) for c in order])


def _streams(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(conv_id, whether it is another one than before, values) of each row."""
    before = object()
    for batch in batches:
        for conv, *values in zip(*(batch.column(c).to_pylist() for c in ["conv_id", *columns])):
            yield conv, conv != before, values
            before = conv


def _batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 1000) -> Iterator[pa.RecordBatch]:
    held, width = [], 0
    for row in rows:
        held.append(row)
        width += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or width > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held, width = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


def _mapped(rows: DataFrame, make, columns: dict[str, str]) -> DataFrame:
    """The rows (conv_id, *columns) that make(batches) gives for each task's batches; conv_id keeps its type."""
    types = {"long": pa.int64(), "string": pa.string()}

    def run(batches):
        if (first := next(batches, None)) is not None:
            schema = pa.schema([first.schema.field("conv_id"), *[(c, types[t]) for c, t in columns.items()]])
            yield from _batches(schema, make(chain([first], batches)))

    bound_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), ", ".join([f"conv_id {kind}", *[f"{c} {t}" for c, t in columns.items()]]))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation of rows (conv_id, turn,
    role, text).

    Rows stand by turn, nulls first, then by role and a digest of role and text. A row's first fault counts: blank (only
    white space), duplicate (role and text of an earlier row), truncated (the last character that is no white space is none
    of .!?). gaps are the turns missing between the smallest and the largest; illegal are neighbours whose initials are not
    su, ua or au. audit has the initials of the cheapest edits in order, of equal ones the least. Null roles and texts are
    one blank; null conversation ids are one conversation; an empty table gives an empty result. Other columns are left
    out. A conversation is one stream through one task, as its audit is one value in its order: the task holds 16 bytes for
    each of its distinct rows and a letter for each edit, never its texts.
    """
    keyed = _keyed(rows)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = keyed.select(
        "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), "digest", (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open")
    )

    def reports(batches):
        edits = conv = None

        def closed():
            cost, audit = edits.best()
            return (conv, (high - low + 1 - turns) if turns else 0, *faults, illegal, cost, audit)

        for new_conv, new, (turn, initial, digest, blank, open_) in _streams(batches, ["turn", "initial", "digest", "blank", "open"]):
            if new:
                if edits:
                    yield closed()
                conv, edits, seen, faults, illegal, last, low, high, turns = new_conv, Edits(), set(), [0, 0, 0], 0, None, None, None, 0
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            illegal += last is not None and last + initial not in ("su", "ua", "au")
            last = initial
            fault = 0 if blank else 1 if digest in seen else 2 if open_ else None
            seen.add(digest)
            if fault is not None:
                faults[fault] += 1
            edits.add(initial, FINE if fault is None else CUT if fault == 2 else GONE)
        if edits:
            yield closed()

    return _mapped(_dealt(narrow, "turn", "role", "digest"), reports, {**dict.fromkeys(COUNTS, "long"), "audit": "string"})


def _applied(batches) -> Iterator[tuple]:
    """(conv_id, place, role, text) of repaired rows: an audit comes before the rows of its conversation."""
    conv, letters, at, state, place = None, "", 0, 0, 0

    def inserts():
        nonlocal at, state, place
        while at < len(letters) and letters[at] == "I":
            yield conv, place, ROLES[NEEDED[state]], ""
            at, state, place = at + 1, NEXT[state], place + 1

    for new_conv, new, (kind, role, text) in _streams(batches, ["kind", "role", "text"]):
        if new:
            yield from inserts()
            conv, letters, at, state, place = new_conv, text, 0, 0, 0
        if not kind:
            continue
        yield from inserts()
        edit, at = letters[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            role, state = ROLES[NEEDED[state]], NEXT[state]
        else:
            state = MOVES[state, role[0]]
        yield conv, place, role, text
        place += 1
    yield from inserts()


def _with_audits(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of each conversation in order, the audit (kind 0, as text) before them."""
    none = F.lit(None)
    audits = report.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"), none.cast("binary").alias("digest"), F.lit(0).alias("kind"))
    return _dealt(audits.unionByName(_keyed(rows).withColumn("kind", F.lit(1))), "kind", "turn", "role", "digest")


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows that the audits of a report on them leave, numbered from 0 in each conversation.

    A conversation of which nothing is left has no rows. Inserted rows have empty texts.
    """
    return _mapped(_with_audits(rows, report), _applied, {"place": "long", "role": "string", "text": "string"})


def repaired_digests(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the rows of repaired(), as role:text joined by line feeds, for conversations of which
    anything is left. The rows are hashed as they pass."""

    def digests(batches):
        conv = hashed = None
        for own, place, role, text in _applied(batches):
            if not place:
                if hashed:
                    yield conv, hashed.hexdigest()
                conv, hashed = own, hashlib.sha256()
            hashed.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if hashed:
            yield conv, hashed.hexdigest()

    return _mapped(_with_audits(rows, report), digests, {"repaired_sha256": "string"})


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults planted by the crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties
    its text, 2 takes out its .!?, 3 repeats it, 4 makes it the user's. Nulls in roles, texts and that name are one blank."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return out.withColumn("kind", F.explode(F.array_repeat("kind", F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind")
