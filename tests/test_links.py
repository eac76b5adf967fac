from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import chains, communities, cycles, edges, ego, evidence, graph, pairs

EDGE = "source string, target string, relation_type string, weight double"


def _evidence(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "ord long, entity_id string, url_or_reference string, raw_content_hash string",
    )


def _edge_set(df):
    return {(r["source"], r["target"], r["relation_type"]): r["weight"] for r in df.collect()}


def test_shared_url_and_twice_shared_hash(spark):
    ev = _evidence(spark, [("A", "u", None), ("B", "u", None), ("C", "u", None), (None, "u", None),
                           ("A", None, "h1"), ("B", None, "h1"), ("A", None, "h2"), ("B", None, "h2"), ("A", "u", "h1")])
    got = _edge_set(edges.physical_edges(ev))
    assert got == {
        ("A", "B", "shared_reference"): 1.0,
        ("A", "C", "shared_reference"): 1.0,
        ("B", "C", "shared_reference"): 1.0,
        ("A", "B", "shared_content"): 3.0,
    }


def test_first_seen_orientation(spark):
    ev = _evidence(spark, [("B", "u", None), ("A", "u", None)])
    assert list(_edge_set(edges.physical_edges(ev, "first_seen"))) == [("B", "A", "shared_reference")]


def _random_evidence(spark, seed, hot):
    """Many entities share the key ``hot``; the rest share random keys."""
    rng = random.Random(seed)
    rows = [(f"E{i:03d}", "hot", None) for i in range(hot)]
    rows += [(f"E{rng.randrange(120):03d}", f"k{rng.randrange(60)}", f"h{rng.randrange(200)}") for _ in range(500)]
    return _evidence(spark, rows)


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_hot_key_pairs_match_brute_force(spark, block_rows):
    ev = _random_evidence(spark, 3, 90)
    got = _edge_set(edges.physical_edges(ev, block_rows=block_rows))
    rows = ev.collect()
    want: dict = {}
    for kind, col, w in (("shared_reference", "url_or_reference", 1.0), ("shared_content", "raw_content_hash", 1.5)):
        groups: dict = {}
        for r in rows:
            if r[col] is not None:
                groups.setdefault(r[col], set()).add(r["entity_id"])
        for members in groups.values():
            for a, b in itertools.combinations(sorted(members), 2):
                want[(a, b, kind)] = want.get((a, b, kind), 0.0) + w
    assert got == want


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_strong_edges_equal_filtered_edges(spark, block_rows):
    ev = _random_evidence(spark, 5, 100)
    assert _edge_set(edges.strong_edges(ev, block_rows)) == _edge_set(edges.drop_noise(edges.physical_edges(ev)))


@pytest.mark.parametrize("minimum", [2, 3])
def test_pairs_sharing_at_least_is_exact(spark, minimum):
    rng = random.Random(minimum)
    members = {(f"k{rng.randrange(12)}", i) for i in range(40) for _ in range(6)} | {("hot", i) for i in range(30)}
    df = spark.createDataFrame(sorted(members), "key string, m long")
    got = {(r["a"], r["b"]): r["shared"] for r in pairs.pairs_sharing_at_least(df, "key", "m", minimum, 8).collect()}
    keys: dict = {}
    for k, m in members:
        keys.setdefault(m, set()).add(k)
    want = {(a, b): len(keys[a] & keys[b]) for a, b in itertools.combinations(sorted(keys), 2)
            if len(keys[a] & keys[b]) >= minimum}
    assert got == want


def test_collapse_and_merge(spark):
    two = spark.createDataFrame(
        [("A", "B", "shared_content", 3.0), ("A", "B", "shared_reference", 1.0)], EDGE)
    assert _edge_set(edges.collapse(two)) == {("A", "B", "shared_reference"): 1.0}
    sem = spark.createDataFrame([("A", "B", "semantic_similarity", 0.8)], EDGE)
    more = sem.withColumn("weight", F.lit(0.9))
    assert _edge_set(edges.merge_semantic(sem, more)) == {("A", "B", "semantic_similarity"): 0.9}


def test_explanations_of_semantic_and_plain_edges(spark):
    ev = _evidence(spark, [("A", "https://x.org/exports/SDN.XML", "abcdefgh"), ("B", "https://x.org/exports/SDN.XML", "abcdefgh"),
                           ("C", None, "zz"), ("D", "http://h.net/p/q", None), ("E", "http://h.net/p/q", None)])
    es = spark.createDataFrame(
        [("A", "B", "shared_reference", 1.0), ("A", "C", "semantic_similarity", 0.753), ("C", "D", "other", 1.0), ("D", "E", "x", 1.0)], EDGE)
    got = {(r["source"], r["target"]): (r["explanation"], r["short_label"]) for r in edges.explain_edges(es, ev).collect()}
    assert got[("A", "B")] == ("Ref. Compartida\n(OFAC SDN List)", "Ref: OFAC SDN List")
    assert got[("A", "C")] == ("Vínculo Semántico\n(Simil: 75.3%)", "75.3%")
    assert got[("C", "D")] == ("Enlace Físico (other)", "Físico")
    assert got[("D", "E")][1] == "Ref: h.net"


def test_snippet_stands_in_until_a_reason_appears(spark):
    ev = spark.createDataFrame(
        [(0, "A", "L1", None, "first", None), (1, "A", "L2", "mx", "second", "{'review_reason': 'R', 'status': None, 'supposition': 'S'}"),
         (2, "B", None, None, None, "{'programs_json': \"['P', 'Q']\", 'regime_name': 'G'}"), (3, "B", "L1", "", "late", None)],
        "ord long, entity_id string, source_id string, country string, snippet string, extracted_fields string")
    got = {r["entity_id"]: r for r in evidence.evidence_details(ev).collect()}
    assert got["A"]["reasons"] == ["first", "R"] and got["A"]["lists"] == ["L1", "L2"]
    assert (got["A"]["status"], got["A"]["country"]) == ("S", "mx")
    assert got["B"]["reasons"] == ["Regime: G", "Prog: P", "Prog: Q"]


def test_ego_prefers_semantic_links(spark):
    es = spark.createDataFrame(
        [("A", "B", "shared_reference", 9.0), ("A", "C", "semantic_similarity", 0.7), ("D", "A", "shared_content", 1.5)], EDGE)
    rows = ego.ego_network(es, top=2).where("entity_id = 'A'").orderBy("position").collect()
    assert [r["neighbour_id"] for r in rows] == ["C", "B"]


def _nodes(spark, ids, outliers=()):
    return spark.createDataFrame([(i, f"n{i}", int(i in outliers)) for i in ids], "entity_id string, entity_name string, is_outlier int")


def test_two_hop_chain(spark):
    es = spark.createDataFrame(
        [("A", "B", "shared_content", 1.5), ("B", "OFAC_SDN-1", "shared_reference", 2.0)], EDGE)
    got = chains.suspicious_chains(_nodes(spark, ["A", "B", "OFAC_SDN-1"]), es).collect()
    assert len(got) == 1
    assert got[0]["path_nodes_ids"] == "OFAC_SDN-1 -> B -> A" and got[0]["avg_edge_weight"] == 1.75
    weak = es.withColumn("weight", F.when(F.col("target") == "OFAC_SDN-1", 1.0).otherwise(F.col("weight")))
    assert chains.suspicious_chains(_nodes(spark, ["A", "B"]), edges.drop_noise(weak)).count() == 0


def test_chain_depth(spark):
    path = ["UK_SANCTIONS-1", "P", "Q", "R", "S"]
    es = spark.createDataFrame([(a, b, "shared_content", 1.5) for a, b in zip(path, path[1:])], EDGE)
    plain = chains.suspicious_chains(_nodes(spark, path), es).collect()
    assert {r["target_entity_id"] for r in plain} == {"Q"}
    flagged = chains.suspicious_chains(_nodes(spark, path, outliers=("R", "S")), es, hub_edges=1).collect()
    assert {r["target_entity_id"]: r["path_hops"] for r in flagged} == {"Q": 2, "R": 3}


def _undirected(spark, pairs_, weight=1.5):
    return spark.createDataFrame([(a, b, "shared_content", weight) for a, b in pairs_], EDGE)


def _forest(pairs_):
    """Root, depth and parent by plain breadth-first search."""
    near = {}
    for a, b in pairs_:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    tree = {}
    for root in sorted(near):
        if root in tree:
            continue
        tree[root], level = (root, 0, None), [root]
        while level:
            nxt = sorted({b for a in level for b in near[a]} - tree.keys())
            for b in nxt:
                tree[b] = (root, tree[level[0]][1] + 1, min(near[b] & set(level)))
            level = nxt
    return tree


def _basis(pairs_):
    tree, out = _forest(pairs_), set()

    def up(x):
        way = [x]
        while tree[way[-1]][2] is not None:
            way.append(tree[way[-1]][2])
        return way

    for a, b in {(min(p), max(p)) for p in pairs_}:
        if tree[a][2] == b or tree[b][2] == a:
            continue
        ups, vps = up(a), up(b)
        meet = next(x for x in ups if x in vps)
        loop = ups[: ups.index(meet) + 1] + vps[: vps.index(meet)][::-1]
        if len(loop) <= 5:
            at = loop.index(min(loop))
            loop = loop[at:] + loop[:at]
            out.add(tuple(loop if loop[1] <= loop[-1] else loop[:1] + loop[:0:-1]))
    return out


def test_cycle_basis_matches_breadth_first_search(spark):
    import random

    rng = random.Random(5)
    for nodes, n in ((12, 18), (30, 45), (9, 36)):
        names = [f"n{i:02d}" for i in range(nodes)]
        pairs_ = {tuple(sorted(rng.sample(names, 2))) for _ in range(n)}
        given = _undirected(spark, sorted(pairs_))
        forest = cycles.spanning_forest(graph.Adjacency(edges.both_ways(edges.collapse(given)), 3))
        assert {r["node"]: (r["root"], r["depth"], r["parent"]) for r in forest.collect()} == _forest(pairs_)
        assert _cycles(cycles.fundamental_cycles(given, hub_edges=3)) == _basis(pairs_)


def test_cycle_basis_of_small_graphs(spark):
    ring = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("A", "E")]
    assert _cycles(cycles.fundamental_cycles(_undirected(spark, ring))) == {("A", "B", "C", "D", "E")}
    six = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "F"), ("A", "F")]
    assert _cycles(cycles.fundamental_cycles(_undirected(spark, six))) == set()
    clique = [(a, b) for i, a in enumerate("ABCDEF") for b in "ABCDEF"[i + 1 :]]
    assert len(_cycles(cycles.fundamental_cycles(_undirected(spark, clique)))) == 15 - 5


def _cycles(df):
    return {tuple(r["cycle"]) for r in df.collect()}


def test_triangle_and_square_with_diagonal(spark):
    assert _cycles(cycles.short_cycles(_undirected(spark, [("A", "B"), ("B", "C"), ("A", "C")]))) == {("A", "B", "C")}
    square = _undirected(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("A", "D"), ("A", "C")])
    assert _cycles(cycles.short_cycles(square)) == {("A", "B", "C"), ("A", "C", "D"), ("A", "B", "C", "D")}


def test_cycles_match_brute_force_with_hubs_and_blocks(spark):
    rng = random.Random(11)
    pairs_ = {tuple(sorted(rng.sample("ABCDEFGHIJ", 2))) for _ in range(22)} | {("A", x) for x in "BCDEFGHIJ"}
    adj: dict = {}
    for a, b in pairs_:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    want = set()
    for n in (3, 4, 5):
        for c in itertools.permutations(sorted(adj), n):
            if c[0] == min(c) and c[1] < c[-1] and all(c[(i + 1) % n] in adj[c[i]] for i in range(n)):
                want.add(c)
    got = cycles.short_cycles(_undirected(spark, sorted(pairs_)), hub_edges=4, block_rows=2)
    assert _cycles(got) == want


def _cliques():
    left, right = "ABCD", "WXYZ"
    return [*itertools.combinations(left, 2), *itertools.combinations(right, 2), ("D", "W")]


def test_communities_of_two_cliques(spark):
    es = _undirected(spark, _cliques(), 1.0)
    cat = _nodes(spark, list("ABCDWXYZ") + ["LONE"])
    comm = communities.louvain(cat, es)
    groups: dict = {}
    for r in comm.collect():
        groups.setdefault(r["community_id"], set()).add(r["entity_id"])
    assert sorted(map(sorted, groups.values())) == [list("ABCD"), ["LONE"], list("WXYZ")]
    singles = cat.select("entity_id", F.monotonically_increasing_id().alias("community_id"))
    assert communities.modularity(es, comm) > communities.modularity(es, singles)


def _pagerank_numpy(pairs_, nodes, rounds=None):
    import numpy as np

    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs_:
        m[at[a], at[b]] = m[at[b], at[a]] = 1.0
    out = m.sum(1)
    p = np.where(out[:, None] > 0, m / np.where(out > 0, out, 1)[:, None], 1.0 / len(nodes))
    r = np.full(len(nodes), 1.0 / len(nodes))
    for _ in range(rounds or 100):
        new = 0.85 * r @ p + 0.15 / len(nodes)
        done = abs(new - r).sum() < len(nodes) * 1e-6
        r = new
        if rounds is None and done:
            break
    return dict(zip(nodes, r))


def test_pagerank_stops_where_it_should(spark):
    nodes = list("ABCDWXYZ") + ["LONE"]
    es = _undirected(spark, _cliques(), 1.0)
    adjacency = graph.collapsed_graph(es, hub_edges=3)
    got = {r["entity_id"]: r["pagerank"] for r in graph.pagerank(_nodes(spark, nodes), es, adjacency=adjacency).collect()}
    want = _pagerank_numpy(_cliques(), nodes)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-9)
    assert got == pytest.approx(want, abs=1e-12)


def test_smoothing_of_two_equal_nodes(spark):
    nodes = spark.createDataFrame([("A", 1, 1, 0.5, 1), ("B", 1, 1, 0.5, 1), ("C", 4, 2, 0.9, 7)],
                                  "entity_id string, sources_evaluated int, sources_with_hallazgo int, max_identity_score double, evidence_items int")
    out = {r["entity_id"]: r for r in graph.smooth_features(nodes, _undirected(spark, [("A", "B"), ("A", "X")], 1.0)).collect()}
    assert out["A"][1:] == out["B"][1:] and len(set(out["A"][1:])) == 1
    # Equal neighbours with weight 1 average back to their own scaled sum.
    assert out["A"]["gnn_feature_0"] == pytest.approx(0.5 * 4 * (-0.7071067811865475), abs=1e-6)


@pytest.fixture(params=[0.0, float("inf")], ids=["cells", "joined"])
def counting(request, monkeypatch):
    """Pairs counted in tiny cells and strips, or joined."""
    for name, value in (("PAIRS_PER_ROW", request.param), ("CELL_ROWS", 17), ("GRID", 40), ("MET", 30)):
        monkeypatch.setattr(f"riskweave.operators.shared.{name}", value)


def test_counts_of_pairs_are_the_same_in_cells(spark, counting):
    ev = _random_evidence(spark, 7, 60).unionByName(_evidence(spark, [("é", "hot", "h1"), ("Z", "hot", None), (None, "hot", "h1"), ("é", "hot", "h2")]))
    rows, want = ev.collect(), {}
    for kind, col, w in (("shared_reference", "url_or_reference", 1.0), ("shared_content", "raw_content_hash", 1.5)):
        groups: dict = {}
        for r in rows:
            if r[col] is not None and r["entity_id"] is not None:
                groups.setdefault(r[col], set()).add(r["entity_id"])
        for members in groups.values():
            for a, b in itertools.combinations(sorted(members, key=str.encode), 2):
                want[(a, b, kind)] = want.get((a, b, kind), 0.0) + w
    made = edges.physical_edges(ev)
    assert made.schema.simpleString() == f"struct<{EDGE.replace(' ', ':').replace(',:', ',')}>"
    assert made.count() == len(want) and _edge_set(made) == want
    assert _edge_set(edges.strong_edges(ev)) == {e: w for e, w in want.items() if e[2] == "shared_content" or w >= 2}
    last = {e[:2]: (e[2], want[e]) for e in sorted(want)}
    assert _edge_set(edges.collapse(made)) == {(*e, r): w for e, (r, w) in last.items()}
    assert _edge_set(edges.collapse(made.where("weight > 1"))) == {
        (*e, r): w for e, (r, w) in {e[:2]: (e[2], want[e]) for e in sorted(want) if want[e] > 1}.items()
    }
    catalog = spark.createDataFrame([("é",), ("alone",)], "entity_id string")
    degrees = {r["entity_id"]: r["degree"] for r in edges.node_degree(catalog, made).collect()}
    assert degrees == {"alone": 0} | {x: sum(x in e for e in last) for x in {x for e in last for x in e}}
    kinds = [r for *_, r in want]
    assert {r["relation_type"]: r["edges"] for r in edges.relation_counts(made).collect()} == {r: kinds.count(r) for r in set(kinds)}
    told = [r[1] for r in edges.topology_stats(catalog, made).collect()]
    assert told == [2, kinds.count("shared_reference"), kinds.count("shared_content"), 0, len(kinds), 0]


def test_pairs_of_hot_keys_cross_no_shuffle(spark):
    """Collapsed edges of keys with many members: what is sent are the members' keys, not the pairs."""
    ev = _evidence(spark, [(f"E{i:03d}", f"k{i % 3}", "h") for i in range(300)])
    plan = edges.collapse(edges.physical_edges(ev))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == 1


def test_least_keys_and_strongest_links_are_the_same_in_cells(spark, counting):
    ev = _random_evidence(spark, 8, 50)
    made = edges.physical_edges(ev)
    assert (edges.counted_in(made) is None) == (edges.counted_in(edges.strong_edges(ev)) is None)
    table, keys = _edge_set(made), {}
    for r in ev.collect():
        keys.setdefault(("shared_reference", r["entity_id"]), set()).add(r["url_or_reference"])
        keys.setdefault(("shared_content", r["entity_id"]), set()).add(r["raw_content_hash"])
    for kind in ("shared_reference", "shared_content"):
        common = {(a, b): (keys[kind, a] & keys[kind, b]) - {None} for a, b, _ in table}
        got = [((r["source"], r["target"]), r["key"]) for r in edges.shared_keys_of(made, ev, kind).collect()]
        assert sorted(got) == sorted((e, min(k)) for e, k in common.items() if k)
    other = ev.where("url_or_reference <> 'hot'")  # edges of one table, keys of another
    got = {(r["source"], r["target"]): r["key"] for r in edges.shared_keys_of(made, other, "shared_reference").collect()}
    assert "hot" not in got.values()
    told = {tuple(r) for r in edges.explain_edges(made, ev).collect()}
    assert told == {tuple(r) for r in edges.explain_edges(made.where("weight > 0"), ev).collect()} and len(told) == len(table)
    top = {tuple(r) for r in ego.ego_network(made, top=4).collect()}
    assert top == {tuple(r) for r in ego.ego_network(made.where("weight > 0"), top=4).collect()}
    for kind in ("semantic_similarity", "shared_reference"):
        links = spark.createDataFrame([("E001", "E002", kind, 0.8), ("E001", "E002", kind, 9.5), ("E001", "ZZ", kind, 0.7)], EDGE)
        merged = edges.merge_semantic(made, links)
        assert merged.count() == len(want := table | {("E001", "E002", kind): 9.5, ("E001", "ZZ", kind): 0.7})
        assert _edge_set(merged) == want
