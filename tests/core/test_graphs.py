"""Graph operators against plain Python, and their rounds on long paths."""

import random

import pytest

from relscope.operators import edges, graphs


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "t") for a, b in pairs], "src long, dst long, type string")


def brute_levels(pairs):
    nodes, pairs = {x for e in pairs for x in e}, {e for e in pairs if e[0] != e[1]}
    waiting = {n: sum(b == n for _, b in pairs) for n in nodes}
    level, out, now = 0, {}, [n for n in nodes if not waiting[n]]
    while now:
        out |= dict.fromkeys(now, level)
        then = []
        for a, b in pairs:
            if a in now:
                waiting[b] -= 1
                then += [b] if not waiting[b] else []
        now, level = then, level + 1
    return {n: out.get(n, level) for n in nodes}


def brute_cycles(pairs):
    next_ = {}
    for a, b in pairs:
        if a != b:
            next_.setdefault(a, set()).add(b)
    found = set()
    for n in next_:
        seen, todo = set(), list(next_[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += next_.get(x, ())
        found |= {n} & seen
    return found


def graph(rng, n, acyclic):
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, int(1.6 * n)))]
    pairs = [(min(e), max(e)) for e in pairs] if acyclic else pairs
    pairs += [(100 + i, 101 + i) for i in range(rng.randint(2, 9))]
    return pairs + [(rng.randrange(n), 100), (102, rng.randrange(n))]


@pytest.mark.parametrize("seed", range(4))
def test_levels_and_cycles_of_random_graphs(spark, seed):
    pairs = graph(random.Random(seed), [5, 12, 30, 30][seed], seed % 2 == 0)
    assert {r.node: r.level for r in edges.levels(frame(spark, pairs)).collect()} == brute_levels(pairs)
    assert sorted(r.node for r in edges.cycle_nodes(frame(spark, pairs)).collect()) == sorted(brute_cycles(pairs))


def test_odd_graphs(spark):
    assert edges.levels(frame(spark, [])).count() == edges.cycle_nodes(frame(spark, [])).count() == 0
    assert [tuple(r) for r in edges.levels(frame(spark, [(1, 1)])).collect()] == [(1, 0)]
    assert edges.cycle_nodes(frame(spark, [(1, 1), (1, 2)])).count() == 0
    both = [(1, 2), (2, 1)]
    assert {r.node: r.level for r in edges.levels(frame(spark, both)).collect()} == {1: 0, 2: 0}
    assert sorted(r.node for r in edges.cycle_nodes(frame(spark, both)).collect()) == [1, 2]
    assert edges.component(frame(spark, both), "7").count() == 0 and edges.component(frame(spark, [(3, 3)]), "3").count() == 1


def counted(monkeypatch):
    """Rounds as the checkpoints made."""
    made = []
    for module, name in ((graphs, "cut"), (graphs, "cut_round"), (edges, "cut")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, real=real: (made.append(1), real(df))[1])
    return made


def test_long_path_with_a_random_graph(spark, monkeypatch):
    made = counted(monkeypatch)
    rng = random.Random(7)
    names = list(range(1000, 11_000))
    rng.shuffle(names)
    pairs = list(zip(names, names[1:])) + [(names[0], 1), (5, names[-1])] + [(i, j) for i in range(1, 9) for j in range(i + 1, 9) if rng.random() < 0.4]
    got = {r.node: r.level for r in edges.levels(frame(spark, pairs)).collect()}
    assert all(got[n] == i for i, n in enumerate(names))
    small = [e for e in pairs if max(e) < 1000] + [(0, 1)]  # the path's first node leads to node 1
    assert {n: got[n] for n in got if n < 1000} == {n: v for n, v in brute_levels(small).items() if n}
    print("checkpoints of levels", len(made))
    assert len(made) <= 80


def test_ring(spark, monkeypatch):
    made = counted(monkeypatch)
    names = list(range(10_000))
    random.Random(8).shuffle(names)
    pairs = list(zip(names, names[1:] + names[:1])) + [(20_000, 3), (4, 20_001), (20_001, 20_002)]
    assert sorted(r.node for r in edges.cycle_nodes(frame(spark, pairs)).collect()) == list(range(10_000))
    print("checkpoints of cycles", len(made))
    assert len(made) <= 60


def test_component_of_a_path(spark, monkeypatch):
    made = counted(monkeypatch)
    names = list(range(10_000))
    random.Random(9).shuffle(names)
    pairs = [e if i % 2 else e[::-1] for i, e in enumerate(zip(names, names[1:]))] + [(20_000, 20_001)]
    assert edges.component(frame(spark, pairs), "17").count() == 9_999
    print("checkpoints of components", len(made))
    assert len(made) <= 20


def brute_gaps(rows, total):
    out = []
    for owner in {o for o, _, _ in rows}:
        top = 0
        for start, size in sorted((s, n) for o, s, n in rows if o == owner):
            out += [(owner, top, start - top)] if start > top else []
            top = max(top, start + size)
        out += [(owner, top, total - top)] if total > top else []
    return sorted(out)


def test_gaps_of_an_owner_in_many_ranges(spark):
    rng = random.Random(3)
    rows = [(7, rng.randrange(50_000), rng.randrange(9)) for _ in range(1500)] + [(rng.randrange(300) + 8, rng.randrange(100), rng.randrange(20)) for _ in range(2500)]
    rows += [(1, 5, 5)] * 1500 + [(7, 0, 30_000)]
    df = spark.createDataFrame(rows, "owner long, start long, size long").repartition(5)
    total = df.select("owner").distinct().selectExpr("owner", "60000L as total")
    assert sorted(tuple(r) for r in edges.interval_gaps(df, total, 16).collect()) == brute_gaps(rows, 60_000)
    held = [n for _, n in edges.sliced(df, 16).groupBy("slice").count().collect()]
    assert len(held) > 10 and max(held) <= 2 * sum(held) / len(held)
