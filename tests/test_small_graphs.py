"""Places of stages in graphs small enough for bits and in larger ones."""

import random

from siltstone.operators import flow


def expected(nodes, merges, edges):
    after = {n: {d for u, d in edges if u == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(after[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        reach[n] = seen
    entries = {n for n in nodes if not any(d == n for _, d in edges)}
    cyclic = any(n in reach[n] for n in nodes)

    def depth(n):
        return max((1 + depth(u) for u, d in edges if d == n), default=0)

    for n in nodes:
        yield n, n in entries, not after[n], n in reach[n], n in entries or any(n in reach[e] for e in entries), bool(reach[n] & merges), None if cyclic else depth(n)


def test_small_and_large_graphs_have_the_places_of_a_search(spark, monkeypatch):
    rng = random.Random(8)
    stages, deps, want = [], [], {}
    for g, n in enumerate([1, 2, 3, 5, 7, 7, 7, 12, 64, 64, 66]):
        nodes = [f"s{k:02}" for k in range(n)]
        merges = set(rng.sample(nodes, n // 3))
        edges = {(nodes[a], nodes[b]) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(int(1.1 * n) if n > 1 else 0))}
        if g % 3 == 2 and n < 66:
            edges.add((nodes[-1], nodes[rng.randrange(n)]))
        if n == 64 and g % 2:
            edges |= {(nodes[k], nodes[k + 1]) for k in range(63)}
        stages += [(g, x, x in merges) for x in nodes]
        deps += [(g, d, u) for u, d in edges] + [(g, nodes[0], "absent"), (g, "absent", nodes[0])]
        want |= {(g, x): tuple(rest) for x, *rest in expected(nodes, merges, edges)}
    stages.append((None, "s00", True))
    stages.append((0, None, True))
    s = spark.createDataFrame(stages, "graph int, node string, is_merge boolean").coalesce(2)
    d = spark.createDataFrame(deps + [(0, "s00", None), (None, "s00", "s00")], "graph int, node string, needs string").coalesce(2)
    joined = []
    large = flow._of_large
    monkeypatch.setattr(flow, "_of_large", lambda a, b: joined.append(sorted(r[0] for r in a.select("graph").distinct().collect())) or large(a, b))
    rows = flow._placed(s, d).collect()
    got = {(r.graph, r.node): (r.entry, r.terminal, r.in_cycle, r.reached, r.merged, r.depth) for r in rows}
    assert len(rows) == len(stages) and joined == [[10]]
    assert got.pop((None, "s00")) == got.pop((0, None)) == (True, True, False, True, False, 0)
    assert {k: v[:5] if want[k][5] is None else v for k, v in got.items()} == {k: v[:5] if v[5] is None else v for k, v in want.items()}
