import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.operators import graph, ordering, routing, sampling, spatial, topology


def network(spark, ways, nodes=None, barriers=()):
    """ways: (way_id, refs, tags); nodes default to a grid of whole micro-degrees."""
    osm = spark.createDataFrame([(w, r, t) for w, r, t in ways], "way_id bigint, refs array<bigint>, tags map<string,string>")
    ids = sorted({n for _, r, _ in ways for n in r})
    nodes = nodes or {n: (n * 1000, n * n * 100) for n in ids}
    points = spark.createDataFrame([(n, a, o, "gate" if n in barriers else None) for n, (a, o) in nodes.items()], "id bigint, lat_udeg int, lon_udeg int, barrier string")
    return (*topology.explode_ways(osm), points)


def edges_of(spark, *args, **kw):
    return {(r.src, r.dst): (r.road_level, r.distance) for r in topology.build_edges(*network(spark, *args, **kw)).collect()}


R = {"highway": "primary"}


def test_loop_and_cross(spark):
    assert set(edges_of(spark, [(1, [1, 2, 3, 1], R)])) == {(1, 1)}
    assert set(edges_of(spark, [(1, [1, 2, 3], R), (2, [4, 2, 5], R)])) == {(1, 2), (2, 1), (2, 3), (3, 2), (4, 2), (2, 4), (2, 5), (5, 2)}


def test_barrier_at_a_junction_blocks_both_sides(spark):
    ways = [(1, [1, 2, 3, 4], R), (2, [5, 3, 6], R)]
    assert set(edges_of(spark, ways, barriers=(3,))) == set()
    assert set(edges_of(spark, ways, barriers=(2,))) == {(3, 4), (4, 3), (5, 3), (3, 5), (3, 6), (6, 3)}


def test_directions_and_no_roads(spark):
    assert set(edges_of(spark, [(1, [1, 2], R | {"oneway": "yes"}), (2, [2, 3], R | {"oneway": "-1"}), (3, [3, 4], {"highway": "footway"})])) == {(1, 2), (3, 2)}


def test_parallel_edges_keep_largest_level_and_least_distance(spark):
    arcs = spark.createDataFrame([(1, 2, 1, 300), (1, 2, 5, 100)], "src bigint, dst bigint, road_level int, distance bigint")
    assert [tuple(r) for r in topology.dedup_edges(arcs).collect()] == [(1, 2, 5, 100)]


def test_distance_is_rounded_once(spark):
    nodes = {1: (0, 0), 2: (0, 5), 3: (0, 10)}  # two steps of 0.556 m
    got = edges_of(spark, [(1, [1, 2, 3], R)], nodes)
    assert got[(1, 3)][1] == 1


def test_incomplete_ways_are_left_out_and_reported(spark):
    ways, refs, nodes = network(spark, [(1, [1, 2], R), (2, [2, 3], R)], {1: (0, 0), 2: (0, 10)})
    assert {(r.src, r.dst) for r in topology.build_edges(ways, refs, nodes).collect()} == {(1, 2), (2, 1)}
    assert [tuple(r) for r in topology.incomplete_ways(refs, topology.roads(ways), nodes).collect()] == [(2, 1)]


def frame(spark, pairs, level=1):
    return spark.createDataFrame([(a, b, level, 10) for a, b in pairs], "src bigint, dst bigint, road_level int, distance bigint")


def strong(pairs):
    """Mutual reachability, by brute force."""
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}, reach


@pytest.mark.parametrize("limit", [0, 1000])
def test_components_both_ways(spark, limit):
    rng = random.Random(limit + 1)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(32)]
    labels, reach = strong(pairs)
    df = frame(spark, pairs)
    assert dict(map(tuple, graph.strong_components(df, limit).collect())) == labels
    both, _ = strong(pairs + [(b, a) for a, b in pairs])
    assert dict(map(tuple, graph.weak_components(df, limit).collect())) == both
    mixed = frame(spark, pairs, 4).unionByName(frame(spark, pairs[:2], 2))
    seeds = {n for p in pairs[:2] for n in p}
    assert {r.node_id for r in graph.reachable_nodes(mixed, 2, limit).collect()} == set.union(*[reach[s] for s in seeds])


def test_dead_ends_and_islands(spark):
    df = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)])
    assert {(r.src, r.dst) for r in graph.dead_end_edges(df).collect()} == {(4, 3), (5, 4)}
    islands = frame(spark, [(1, 2), (2, 1), (2, 3), (3, 2), (10, 11), (11, 10), (20, 21), (21, 20)])
    nodes = spark.createDataFrame([(n, 0, n * 1000) for n in (1, 2, 3, 10, 11, 20, 21)], "id bigint, lat_udeg int, lon_udeg int")
    links = {(r.src, r.dst): r.road_level for r in graph.component_links(islands, nodes).collect()}
    assert links == {(10, 3): 5, (3, 10): 5, (20, 3): 5, (3, 20): 5}
    fixed = graph.repair(islands, nodes)
    assert {r.component_id for r in graph.strong_components(fixed).collect()} == {1}


def dijkstra(pairs, start):
    best, todo = {start: 0}, [start]
    while todo:
        v = todo.pop()
        for a, b, w in pairs:
            if a == v and best[v] + w < best.get(b, 1 << 60):
                best[b] = best[v] + w
                todo.append(b)
    return best


@pytest.mark.parametrize("small", [0, 1000])
def test_shortest_paths_both_ways(spark, small):
    rng = random.Random(7)
    pairs = {(rng.randrange(20), rng.randrange(20)): rng.randrange(1, 50) for _ in range(60)}
    rows = [(a, b, w) for (a, b), w in pairs.items()]
    df = spark.createDataFrame([(a, b, 1, w) for a, b, w in rows], "src bigint, dst bigint, road_level int, distance bigint")
    asked = [(k, rng.randrange(22), rng.randrange(22)) for k in range(25)]
    got = routing.shortest_paths(df, spark.createDataFrame(asked, "query_id bigint, start bigint, goal bigint"), small).collect()
    assert len(got) == 25
    for r in got:
        want = 0 if r.start == r.goal else dijkstra(rows, r.start).get(r.goal)
        assert r.distance == want
        if want is None:
            assert r.path is None
        else:
            assert r.path[0] == r.start and r.path[-1] == r.goal and sum(pairs[p] for p in zip(r.path, r.path[1:])) == want


@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("least", [0, 1])
def test_few_and_many_goals_and_walked_legs(spark, small, least):
    """Small weights, so that many paths tie: one goal is searched from both ends, many from the start; both give the same path."""
    rng = random.Random(least)
    pairs = {(a, b): rng.randrange(least, 4) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(130))}
    df = spark.createDataFrame([(a, b, 1, w) for (a, b), w in pairs.items()], "src bigint, dst bigint, road_level int, distance bigint")
    starts, ends = spark.range(0, 12).toDF("start"), spark.range(0, 42).toDF("goal")
    best = {s: dijkstra([(a, b, w) for (a, b), w in pairs.items()], s) for s in range(12)}
    got = routing.many_to_many(df, starts, ends, small_edges=small, reached=True, walked=True).collect()
    assert Counter(map(tuple, got)) == Counter((s, g, d, d) for s in best for g, d in best[s].items())
    if least and small:
        csr = tuple(routing._broadcast_graph(df).value)[1:]
        back = routing._turned(csr)
        lists = [a.tolist() for a in csr]
        for s, g in ((s, g) for s in range(12) for g in range(csr[0].size - 1) if s != g):
            found, before = routing._search(lists, s, {g})
            distance, path = routing._settle(csr, s, g, back)
            assert distance == found.get(g)
            if g in found:
                want = [g]
                while want[-1] != s:
                    want.append(before[want[-1]])
                assert path == want[::-1]


def two_rings(spark):
    """Even and odd nodes, two parts; origins 0 to 5, one that is nowhere, and the distances."""
    pairs = [(k, (k + 2) % 80, 1 + k % 7) for k in range(80)]
    df = spark.createDataFrame([(a, b, 1, w) for a, b, w in pairs], "src bigint, dst bigint, road_level int, distance bigint")
    return df, spark.createDataFrame([(k,) for k in (*range(6), 99)], "start bigint"), {s: dijkstra(pairs, s) for s in range(6)}


def changes(rows):
    """How often the goal of a task's rows changes, for each of the two parts of its starts."""
    out = {}
    for r in rows:
        own = out.setdefault((r.task, r.start % 2), [None, 0])
        own[1] += own[0] != r.goal
        own[0] = r.goal
    return [n for _, n in out.values()]


def test_ways_come_goal_by_goal(spark):
    df, starts, best = two_rings(spark)
    got = routing.many_to_many(df, starts, spark.range(0, 82).toDF("goal"), reached=True).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.start, r.goal, r.distance) for r in got) == sorted((s, g, d) for s in best for g, d in best[s].items())
    assert max(changes(got)) <= 40  # goals of a part, whatever the number of its starts


def test_pairs_without_a_way_come_goal_by_goal(spark):
    df, starts, best = two_rings(spark)
    got = routing.many_to_many(df, starts, spark.range(0, 82).toDF("goal"), unreachable=0).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.start, r.goal, r.distance) for r in got) == sorted((s, g, best.get(s, {}).get(g, 0)) for s in (*range(6), 99) for g in range(82))
    assert max(changes([r for r in got if r.start < 6])) <= 82  # 99 is in no part and comes by itself


def test_walked_legs_come_goal_by_goal(spark):
    df, starts, best = two_rings(spark)
    got = routing.many_to_many(df, starts, spark.range(0, 82).toDF("goal"), reached=True, walked=True).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.start, r.goal, r.distance, r.walked) for r in got) == sorted((s, g, d, d) for s in best for g, d in best[s].items())
    assert max(changes(got)) <= 40


def test_distances_beyond_32_bits():
    source, head, weight = np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([1 << 29, 1 << 29, 1 << 29])
    assert routing._spread(4, source, weight, head, np.array([0]))[:, 0].tolist() == [0, 1 << 29, 1 << 30, 3 << 29]


def test_nearest_by_brute_force(spark):
    rng = random.Random(3)
    lines = [(k, k, k + 1, *[rng.uniform(0, 1000) for _ in range(4)]) for k in range(60)] + [(60, 3, 3, 5.0, 5.0, 5.0, 5.0)]
    points = [(k, rng.uniform(-5000, 6000), rng.uniform(-300, 1300)) for k in range(40)]

    def d2(p, ln):
        _, _, _, x1, y1, x2, y2 = ln
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = 0 if n == 0 else max(0, min(1, ((p[1] - x1) * (x2 - x1) + (p[2] - y1) * (y2 - y1)) / n))
        return (p[1] - x1 - t * (x2 - x1)) ** 2 + (p[2] - y1 - t * (y2 - y1)) ** 2

    got = spatial.nearest_lines(
        spark.createDataFrame(points, "point_id bigint, px double, py double"),
        spark.createDataFrame(lines, "target_id bigint, src bigint, dst bigint, x1 double, y1 double, x2 double, y2 double"),
    ).collect()
    assert {r.point_id for r in got} == set(range(40))
    for r in got:
        assert abs(r.d2 - min(d2(points[r.point_id], ln) for ln in lines)) < 1e-6


def test_nearest_lines_by_bounds_and_columns(spark):
    """Many lines over few points and far ones, lines of no length and equal lines: the least distance, then the least id, in chunks and in one."""
    rng = np.random.default_rng(9)
    ends = rng.uniform(0, 1000, (3000, 4)).round(1)
    ends[::7, 2:] = ends[::7, :2]
    ends[1::5, 2] = ends[1::5, 0]
    ends[1500:1600] = ends[:100]
    lines = [(k, k, k + 1, *map(float, e)) for k, e in enumerate(ends)]
    points = np.concatenate([rng.uniform(-100, 1100, (300, 2)), rng.uniform(-90000, 90000, (20, 2))])
    d2 = np.stack([spatial._distance2(points[:, 0], points[:, 1], *e) for e in ends])
    want = {k: (int(d2[:, k].argmin()), d2[:, k].min()) for k in range(len(points))}
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "point_id bigint, px double, py double")
    ln = spark.createDataFrame(lines, "target_id bigint, src bigint, dst bigint, x1 double, y1 double, x2 double, y2 double")
    for most, first in ((1000, 10), (150, 5000)):
        assert {r.point_id: (r.target_id, r.d2) for r in spatial.nearest_lines(p, ln, most, first).collect()} == want
    assert spatial.nearest_lines(p, ln.limit(0)).count() == spatial.nearest_lines(p.limit(0), ln).count() == 0


def test_boxes_by_cells_and_by_broadcast(spark):
    rng = random.Random(5)
    lines = spark.createDataFrame([(k, *[rng.uniform(0, 100) for _ in range(4)]) for k in range(50)], "edge_id bigint, x1 double, y1 double, x2 double, y2 double")
    boxes = spark.createDataFrame([(k, *[rng.uniform(0, 100) for _ in range(4)]) for k in range(12)], "box_id bigint, bx1 double, by1 double, bx2 double, by2 double")
    pairs = lambda n: sorted((r.box_id, r.edge_id) for r in spatial.edges_in_boxes(lines, boxes, n, 7.0).collect())
    assert pairs(100) == pairs(0) and pairs(0)


def test_totals_of_boxes_are_counted_without_pairs(spark):
    """Whole numbers, so that borders touch; one box twice, one that nothing meets."""
    rng = random.Random(6)
    place = lambda n: [float(rng.randrange(n)) for _ in range(4)]
    lines = spark.createDataFrame([(k, k, *place(40)) for k in range(200)], "edge_id bigint, distance bigint, x1 double, y1 double, x2 double, y2 double")
    boxes = spark.createDataFrame([(k % 30, *place(50)) for k in range(31)] + [(99, 60.0, 60.0, 61.0, 61.0)], "box_id bigint, bx1 double, by1 double, bx2 double, by2 double")
    pairs = spatial.edges_in_boxes(lines, boxes).groupBy("box_id").agg(F.count("*"), F.sum("distance"))
    want = sorted(map(tuple, pairs.collect()))
    assert want and all(99 != box for box, *_ in want)
    for most in (100, 7):
        totals = spatial.box_totals(lines, boxes, most)
        assert sorted(map(tuple, totals.collect())) == want
    assert "Join" not in totals._jdf.queryExecution().executedPlan().toString()
    assert spatial.box_totals(lines.limit(0), boxes).count() == 0 and spatial.box_totals(lines, boxes.limit(0)).count() == 0


#: Samples of at most five of the numbers below n that results have to match (fixed values).
GOLDEN = {6: [2, 3, 5], 8: [2, 3, 5, 6], 9: [2, 3, 5, 6, 8], 12: [5, 6, 9], 22: [5, 6, 9, 12], 29: [5, 6, 9, 12, 22], 35: [6, 9, 12, 29], 37: [6, 9, 12, 29, 35], 105: [9]}


def test_sampling_goldens(spark):
    for n, want in GOLDEN.items():
        assert sorted(r.id for r in sampling.sample(spark.range(n), "id", 5, sip=True).collect()) == want
    for m in (6, 100):
        assert sampling.sample(spark.range(6), "id", m, sip=True).count() == 6
    assert sampling.sample(spark.range(6), "id", 0).count() == 0
    shuffled = spark.range(37).orderBy(F.rand(3))
    assert sorted(r.id for r in sampling.sample(shuffled, "id", 5, sip=True).collect()) == [6, 9, 12, 29, 35]


def test_sampling_with_priority(spark):
    def by(n, expr, m):
        rows = sampling.sample_with_priority(spark.range(n).withColumn("p", F.expr(expr)), "id", "p", m, sip=True).collect()
        out = {}
        for r in rows:
            out.setdefault(r.p, []).append(r.id)
        return {k: sorted(v) for k, v in out.items()}

    plain = lambda a, b, m: sorted(r.id for r in sampling.sample(spark.range(a, b), "id", m, sip=True).collect())
    assert by(38, "0", 5) == {0: plain(0, 38, 5)}
    assert by(38, "cast(id div 19 as int)", 5) == {1: plain(19, 38, 5)}
    assert by(38, "cast(id div 10 as int)", 5) == {3: plain(30, 38, 5)}
    assert by(38, "cast(id div 10 as int)", 15) == {3: plain(30, 38, 15), 2: plain(20, 30, 7)}


def test_dense_index_and_deltas(spark):
    df = spark.range(500).selectExpr("id * 7 % 501 as k", "(id * 31) % 1000 - 500 as v")
    placed = {r.k: r.place for r in ordering.dense_index(df, ["k"], "place").collect()}
    assert [placed[k] for k in sorted(placed)] == list(range(500))
    encoded = ordering.delta_encode(df, "k", "v")
    values = [r.v for r in df.orderBy("k").collect()]
    assert [r.delta for r in encoded.orderBy("k").collect()] == [b - a for a, b in zip([0, *values], values)]
    assert [r.back for r in ordering.delta_decode(encoded, "k", "delta", "back").orderBy("k").collect()] == values
    assert ordering.dense_index(df.limit(0), ["k"], "place").count() == 0


def test_route_goes_round_and_reports(spark):
    ids = {1: (0, 0), 2: (0, 1000), 3: (1000, 1000)}
    nodes = spark.createDataFrame([(n, a, o) for n, (a, o) in ids.items()], "id bigint, lat_udeg int, lon_udeg int")
    edges = spark.createDataFrame([(0, 1, 2, 1, 111), (1, 2, 3, 1, 111), (2, 3, 1, 1, 157)], "edge_id bigint, src bigint, dst bigint, road_level int, distance bigint")
    lines = spatial.with_lines(edges, nodes)
    asked = spark.createDataFrame([(1, "0.0002,0;0.0008,0"), (2, "0,0"), (3, "x,1;2,2")], "request_id bigint, coordinates string")
    got = {r.request_id: r for r in routing.route(asked, lines, nodes).collect()}
    assert got[1].distance == 88 + 111 + 157 + 88 and '"routes"' in got[1].response
    assert got[2].error.startswith("Expected at least 2") and got[3].error.startswith("Could not parse pair x,1")
    cut_off = spatial.with_lines(edges.where("edge_id <> 2"), nodes)
    assert {r.request_id: r.error for r in routing.route(asked, cut_off, nodes).collect()}[1] == "no route"


def test_pairs_are_searched_bridge_by_bridge(monkeypatch):
    """Three parts that hang together by one edge each, one that is apart, a dead end and a bridge of one direction."""
    rng = random.Random(3)
    pairs = {(40 * k + rng.randrange(30), 40 * k + rng.randrange(30)): rng.randrange(1, 4) for k in range(4) for _ in range(90)}
    pairs |= {(3, 45): 2, (45, 3): 3, (50, 85): 1, (85, 50): 2, (7, 31): 1, (31, 7): 1, (8, 32): 1}
    ids = np.unique(list(pairs))
    rows = sorted((int(np.searchsorted(ids, a)), int(np.searchsorted(ids, b)), w) for (a, b), w in pairs.items())
    src, dst, weight = (np.array(c) for c in zip(*rows))
    csr = (np.searchsorted(src, np.arange(len(ids) + 1)), dst, weight)
    back, forest, lists = routing._turned(csr), routing._forest(csr), [a.tolist() for a in csr]

    def labels(skip=None):
        both = [{a, b} for a, b, _ in rows if {a, b} != skip]
        return routing.weak_labels(len(ids), *np.array([(min(e), max(e)) for e in both]).T)

    apart = {frozenset(e) for e in {(a, b) for a, b, _ in rows if a != b} if len(set(labels(set(e)).tolist())) > len(set(labels().tolist()))}
    _, parent, _, bridge = forest
    assert {frozenset((int(v), int(parent[v]))) for v in np.flatnonzero(bridge)} == apart
    looked, settle = [], routing._settle
    monkeypatch.setattr(routing, "_settle", lambda csr, a, b, back: looked.append((a, b)) or settle(csr, a, b, back))
    known = {}
    for s in range(0, len(ids), 3):
        found, before = routing._search(lists, s, set(range(len(ids))))
        for g in range(len(ids)):
            distance, path = routing._bridge_by_bridge(csr, back, forest, s, g, known)
            assert distance == found.get(g)
            if path:
                assert path[0] == s and all(before[b] == a for a, b in zip(path, path[1:])) and path[-1] == g
    side = (ids // 40).tolist()
    assert looked and all(side[a] == side[b] for a, b in looked)



def test_a_few_pairs_over_a_large_graph_are_searched_block_by_block(spark, monkeypatch):
    """Parts that hang together by bridges, some of one direction, one part apart: the same paths as from the whole graph, without rounds of joins."""
    rng = random.Random(8)
    pairs = {(40 * k + rng.randrange(30), 40 * k + rng.randrange(30)): rng.randrange(1, 4) for k in range(4) for _ in range(90)}
    pairs |= {(3, 45): 2, (45, 3): 3, (50, 85): 1, (7, 31): 1, (31, 7): 1, (8, 32): 1}
    df = spark.createDataFrame([(a, b, 1, w) for (a, b), w in pairs.items()], "src bigint, dst bigint, road_level int, distance bigint")
    asked = [(k, rng.randrange(155), rng.randrange(155)) for k in range(80)] + [(80, 5, 5), (81, 999, 999), (81, 999, 5), (82, 31, 88), (82, 31, 88)]
    asked = spark.createDataFrame(asked, "query_id bigint, start bigint, goal bigint")
    want = Counter((*r[:4], tuple(r.path or ())) for r in routing.shortest_paths(df, asked).collect())
    assert len({r[3] for r in want}) > 9 and sum(want.values()) == 85
    relaxed, rounds_of = routing._relaxed, []
    monkeypatch.setattr(routing, "_relaxed", lambda *a: rounds_of.append(a) or relaxed(*a))
    for most, rounds in ((1000, 0), (70, 1)):
        got = routing.shortest_paths(df, asked, small_edges=0, block_edges=most).collect()
        assert Counter((*r[:3], r.distance) for r in got) == Counter(r[:4] for r in want.elements())
        assert rounds or Counter((*r[:4], tuple(r.path or ())) for r in got) == want
        assert len(rounds_of) == rounds

@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_strong_components_from_whole_arrays(rounds):
    rng = random.Random(rounds)
    for _ in range(20):
        pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(35)]
        nodes, (a, b) = np.unique(pairs), (np.searchsorted(np.unique(pairs), x) for x in zip(*pairs))
        forth, back = graph._Ends(a, b, len(nodes), 3), graph._Ends(b, a, len(nodes), 3)
        got = graph.strong_labels(len(nodes), forth, back, np.ones(len(nodes), bool), rounds)
        assert dict(zip(nodes.tolist(), nodes[got].tolist())) == strong(pairs)[0]


def test_repaired_labels_all_at_once(spark):
    """One labelling gives the rows that reachability, dead ends and links give one by one."""
    rng = random.Random(5)
    pairs = {(30 * k + rng.randrange(20), 30 * k + rng.randrange(20)) for k in range(4) for _ in range(28)}
    rows = [(a, b, rng.choice([2, 4, 5]), rng.randrange(9)) for a, b in sorted(pairs)]
    df = spark.createDataFrame(rows, "src bigint, dst bigint, road_level int, distance bigint")
    nodes = spark.createDataFrame([(n, 0, n * 977 % 5003) for n in range(120)], "id bigint, lat_udeg int, lon_udeg int")
    at_once, one_by_one = graph.repaired(df, nodes), graph.repaired(df, nodes, one_task_edges=0)
    assert Counter(map(tuple, at_once.collect())) == Counter(map(tuple, one_by_one.collect()))
    assert len({r.component_id for r in graph.strong_components(at_once).collect()}) == 1
