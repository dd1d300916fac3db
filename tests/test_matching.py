import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinreel import constants as K
from twinreel.functions import pixels
from twinreel.functions.hashing import median_hash
from twinreel.operators import corroborate, graph, hamming
from twinreel.operators import coverage as cov
from twinreel.plans import api

SCHEDULE = {**dict.fromkeys(range(13), 1), **dict.fromkeys(range(13, 16), 2), **dict.fromkeys(range(16, 19), 3), 19: 4, 20: 4, 21: 5, 22: 6, 23: 7, 24: 8, 25: 10, 26: 12, 27: 15, 28: 18, 29: 23, 30: 29, 31: 38, 32: 51}


def test_schedule_and_masks():
    assert {d: K.witnesses_needed(d) for d in range(33)} == SCHEDULE
    assert all(K.witnesses_needed(d) is None for d in range(33, 65))
    assert [len(K.masks(16, r)) for r in range(5)] == [1, 17, 137, 697, 2517]
    assert K.tolerances(4) == (4, 10)
    assert K.tolerances(32) == (32, 38)
    with pytest.raises(ValueError, match="distance"):
        K.tolerances(33)


@given(st.integers(0, 40), st.integers(3, 8), st.integers(0, 2**64 - 1), st.data())
@settings(max_examples=200, deadline=None)
def test_block_plan_is_exhaustive(distance, blocks, x, data):
    """Any pair within the distance has a block within its radius."""
    flips = data.draw(st.lists(st.integers(0, 63), max_size=distance, unique=True))
    y = x
    for b in flips:
        y ^= 1 << b
    plan = K.block_plan(distance, blocks)
    assert sum(bits for _, bits, _ in plan) == 64
    assert any(((x >> s ^ y >> s) & ((1 << b) - 1)).bit_count() <= r for s, b, r in plan if r >= 0)


def _samples(spark, rows):
    return spark.createDataFrame(rows, "media_id long, idx int, hash long, t_start long, t_end long")


def test_index_equals_direct(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) - 2**63 for _ in range(12)]
    rows = []
    for m in range(12):
        for i in range(6):
            h = rng.choice(base)
            for b in rng.sample(range(64), rng.randrange(0, 9)):
                h ^= (1 << b) if b < 63 else -(1 << 63)
            rows.append((m, i, h, i * 1000, i * 1000 + 1000))
    s = _samples(spark, rows).cache()
    for d in (0, 3, 10, 16):
        a = {tuple(r) for r in hamming.frame_matches(s, d, "direct").collect()}
        b = [tuple(r) for r in hamming.frame_matches(s, d, "index").collect()]
        assert len(b) == len(set(b))
        assert set(b) == a
        want = {(x[0], y[0], x[1], y[1]) for x in rows for y in rows if x[0] < y[0] and ((x[2] ^ y[2]) & (2**64 - 1)).bit_count() <= d}
        assert {r[:4] for r in a} == want


def test_even_tolerance(spark):
    s = spark.createDataFrame([(3,), (5,)], "hash long")
    assert hamming.even_tolerance(s, 7) == 6
    assert hamming.even_tolerance(s.unionByName(spark.createDataFrame([(1,)], "hash long")), 7) == 7


def _brute(rows, distance):
    strict, loose = K.tolerances(distance)
    rows = [r for r in rows if r[5] <= loose]
    out = set()
    for a, b, i, j, off, d in rows:
        need = K.witnesses_needed(d)
        near = [(r[2], r[3]) for r in rows if r[:2] == (a, b) and abs(r[4] - off) <= 500 and r[2] != i and r[3] != j]
        best = corroborate.largest_matching(near, 10**9)
        if d <= strict or need is not None and best >= need:
            out.add((a, b, i, j))
    return out


def test_corroboration_against_brute_force(spark):
    rng = random.Random(5)
    rows = sorted({(1, 2 + rng.randrange(2), rng.randrange(9), rng.randrange(9)) for _ in range(90)})
    rows = [(*r, rng.choice([0, 300, 500, 501, 900, 5000]), rng.randrange(6, 19)) for r in rows]
    df = spark.createDataFrame(rows, "a long, b long, i int, j int, offset long, dist int")
    for d in (4, 8, 12):
        assert {tuple(r) for r in corroborate.corroborated(df, d).collect()} == _brute(rows, d)


def test_matching_is_a_matching():
    # three edges at one vertex are one witness, not three
    assert corroborate.largest_matching([(0, 1), (0, 2), (0, 3)], 9) == 1
    assert corroborate.largest_matching([(0, 1), (1, 1), (1, 2), (2, 2), (2, 3)], 9) == 3
    assert corroborate.largest_matching([], 9) == 0


@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=14))
@settings(max_examples=150, deadline=None)
def test_matching_against_search(edges):
    def best(rest, used_i, used_j):
        if not rest:
            return 0
        (i, j), more = rest[0], rest[1:]
        skip = best(more, used_i, used_j)
        return skip if i in used_i or j in used_j else max(skip, 1 + best(more, used_i | {i}, used_j | {j}))

    assert corroborate.largest_matching(sorted(edges), 99) == best(sorted(edges), frozenset(), frozenset())


def test_coverage_gates_and_links(spark):
    s = _samples(spark, [(1, 0, 7, 0, 400), (1, 1, 7, 400, 1000), (2, 0, 7, 0, 100)])
    media = spark.createDataFrame([(1, 1000, 1.0), (2, 0, 0.0)], "media_id long, total_ms long, duration double")
    marks = spark.createDataFrame([(1, 2, 0, 0), (1, 2, 0, 0), (1, 2, 1, 0)], "a long, b long, i int, j int")
    r = cov.coverage(marks, s, media).first()
    assert (r["ms_a"], r["coverage_a"], r["coverage_b"]) == (1000, 1.0, 0.0)
    assert tuple(r["span_a"]) == (0, 1000)
    pairs = cov.coverage(marks, s, media)
    assert cov.percent_gate(pairs, 100.0).count() == 1
    assert cov.percent_gate(pairs.withColumn("coverage_a", F.lit(0.0).cast("float")), 0.0).count() == 0
    assert cov.seconds_gate(pairs, media, 1.0).count() == 1
    assert cov.seconds_gate(pairs, media, 1.1).count() == 0
    assert {tuple(x) for x in cov.links(pairs).select("subject", "other").collect()} == {(1, 2), (2, 1)}
    for bad in ({"percent": 101}, {"min_duration": float("nan")}, {"distance": 40}):
        with pytest.raises(ValueError, match="must"):
            cov.check_knobs(**({"distance": 4, "percent": 20, "min_duration": 0} | bad))


def _cliques(pairs):
    nodes = sorted({x for p in pairs for x in p})
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in nodes}
    sets = []
    for mask in range(1, 1 << len(nodes)):
        c = {nodes[i] for i in range(len(nodes)) if mask >> i & 1}
        if len(c) > 1 and all(b in near[a] for a in c for b in c if a < b):
            sets.append(c)
    return sorted(sorted(c) for c in sets if not any(c < d for d in sets))


@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)).filter(lambda p: p[0] < p[1]), min_size=1, max_size=16))
@settings(max_examples=80, deadline=None)
def test_cliques_against_all_subsets(pairs):
    assert graph.maximal_cliques(sorted(pairs))[0] == _cliques(sorted(pairs))


def test_clique_ceilings():
    moon = [(a, b) for a in range(12) for b in range(a + 1, 12) if a // 3 != b // 3]
    assert len(graph.maximal_cliques(moon)[0]) == 81
    assert graph.maximal_cliques(moon, budget=50) == ([], "budget")
    assert graph.maximal_cliques(moon, most=20) == ([], "groups")
    assert len(graph.maximal_cliques(moon, most=81)[0]) == 81


def test_components_and_group_order(spark):
    chain = [(1, 2), (2, 3), (10, 11), (11, 12), (10, 12), *((i, i + 1) for i in range(20, 60))]
    m = spark.createDataFrame(chain, "a long, b long")
    got = dict(graph.components(m).collect())
    assert {got[x] for x in (1, 2, 3)} == {1}
    assert {got[x] for x in range(20, 61)} == {20}
    media = spark.createDataFrame([(i, f"/p{i:03d}") for i in range(70)], "media_id long, path string")
    rows = graph.ordered_groups(graph.groups(m), media).orderBy("group_no", "pos").collect()
    first = [r["media_id"] for r in rows if r["group_no"] == 1]
    assert first == [10, 11, 12]
    # a chain of three is two groups, not one: its ends were never compared
    assert [[r["media_id"] for r in rows if r["group_no"] == n] for n in (2, 3)] == [[1, 2], [2, 3]]
    gone = graph.groups(m, most=0).where("problem IS NOT NULL").count()
    assert gone >= 1


def test_common_parent(spark):
    df = spark.createDataFrame([(1, "/a/b/c.mp4"), (1, "/a/b/d/e.mp4"), (2, "/x"), (2, "/y/z"), (3, "rel")], "k int, path string")
    assert dict(graph.common_parent(df, "k").collect()) == {1: "/a/b", 2: "/", 3: None}


def test_hash_of_coefficients(spark):
    rng = np.random.default_rng(1)
    block = rng.normal(0, 50, (20, 64)).astype(np.float32)
    block[:, 0] = 0
    df = spark.createDataFrame(pd.DataFrame({"i": range(20), "c": [x.tolist() for x in block]}), "i int, c array<float>")
    got = [r[1] for r in df.select("i", median_hash(F.col("c"))).orderBy("i").collect()]
    assert got == pixels.hashes(block).tolist()
    assert {int(x & (2**64 - 1)).bit_count() for x in got} == {32}


def test_route_is_chosen_by_cost():
    for tolerance in (0, 4, 10, 18):
        dearer = [hamming.index_is_cheaper(rows, tolerance) for rows in (100, 10_000, 1_000_000, 1_000_000_000)]
        assert dearer == sorted(dearer)
        assert not dearer[0]
        assert dearer[-1]
    assert K.best_blocks(10, 80_000) == 6


def test_stars_leave_no_more_rows_than_nodes_and_connect_the_same(spark, monkeypatch):
    monkeypatch.setattr(graph, "TAKEN", 50)
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(b, b + 60), 2))) for b in (-500, 0, 900) for _ in range(400)} | {(-3000, 4000), (4000, 5000)})
    m = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    rows = graph.stars(m).collect()
    assert len(rows) <= 3 * 183 < len(pairs)
    assert sum(r["n"] for r in rows) == len(pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, {a}).add(b), near.setdefault(b, {b}).add(a)
    want = {}
    for v in sorted(near):
        todo = [] if v in want else [v]
        while todo:
            u = todo.pop()
            if u not in want:
                want[u] = v
                todo += near[u]
    assert dict(graph.components(m).collect()) == want


def test_component_beyond_the_budget_is_not_gathered(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)] + [(100, 101)]
    m = spark.createDataFrame(pairs, "a long, b long")
    # a first step of 380
    assert graph.maximal_cliques(pairs[:-1], 379) == ([], "budget")
    for budget in (100, 379):
        rows = graph.groups(m, budget=budget)
        assert sorted((r["component"], r["members"], r["problem"]) for r in rows.collect()) == [(0, None, "20 media: gave up over its budget"), (100, [100, 101], None)]
    assert graph.groups(m).where("members IS NOT NULL").count() == 2


def test_matches_outside_groups_are_dropped_where_they_are_read(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)] + [(100, 101), (100, 102), (101, 103)]
    m = spark.createDataFrame(pairs, "a long, b long")
    media = spark.createDataFrame([(i, f"/p/{i}") for i in (*range(20), 100, 101, 102, 103)], "media_id long, path string")
    groups = graph.ordered_groups(graph.groups(m, budget=100), media)
    kept = api.grouped_matches(m, groups)
    assert sorted(map(tuple, kept.collect())) == pairs[-3:]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
