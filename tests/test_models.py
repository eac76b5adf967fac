from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import functions as F

from riskweave.functions import stats
from riskweave.operators import agglomerative, clustering, components, density, detectors, metric, metrics, mixture, similarity, supervised, tfidf
from riskweave.operators.scaling import Scaler


def _points(spark, x, labels=None):
    rows = [(f"p{i:03d}", [float(v) for v in r], *([int(labels[i])] if labels is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id string, vec array<double>" + (", label int" if labels is not None else ""))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    return np.vstack([rng.normal(c, 0.3, (40, 3)) for c in (0.0, 4.0, 9.0)] + [rng.uniform(-30, 40, (6, 3))])


def test_quantile_by_histogram_is_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.exponential(2, 400), np.zeros(300), [1e9, -5.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert stats.exact_quantile(df, "v", q) == pytest.approx(np.percentile(values, 100 * q), rel=1e-12, abs=1e-12)
    small = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1), (4.0, 1), (10.0, 1)], "v double, w int")
    assert stats.exact_quantile(small, "v", 0.95, "w") == pytest.approx(8.8)


def test_running_sums_over_partitions(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in random.Random(1).sample(range(200), 150)], "k double, v long")
    got = {r["k"]: r["cum_v"] for r in stats.running_sums(df, "k", ["v"], parts=5).collect()}
    total, want = 0, {}
    for k, v in sorted(((r["k"], r["v"]) for r in df.collect()), reverse=True):
        total += v
        want[k] = float(total)
    assert got == want


@pytest.mark.parametrize("block_rows", [9, 1024])
def test_nearest_matches_brute_force(spark, blobs, block_rows):
    x = np.vstack([blobs, blobs[:5], blobs[:5]])
    places = metric.distinct_points(_points(spark, x), "id").cache()
    assert places.count() == len(blobs)
    got: dict = {}
    for r in metric.nearest(places.select("id", "vec"), places, 7, block_rows).collect():
        got.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbour_id"], r["copies"]))
    local = {r["id"]: (np.array(r["vec"]), r["copies"]) for r in places.collect()}
    for i, (v, _) in local.items():
        order = sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 9), j, c) for j, (w, c) in local.items())
        want, total = [], 0
        for item in order:
            if total >= 7:
                break
            want.append(item)
            total += item[2]
        assert sorted(got[i]) == want


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_cosine_pairs_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r["a"], r["b"]) for r in metric.cosine_pairs(_points(spark, x), 0.7, block_rows=block_rows).collect()}
    sim = x @ x.T
    want = {(f"p{i:03d}", f"p{j:03d}") for i in range(120) for j in range(i + 1, 120) if sim[i, j] >= 0.7}
    assert got == want and len(want) > 100


def _tfidf(texts):
    def grams(text):
        for word in text.lower().split():
            w = f" {word} "
            for n in (1, 2, 3):
                for i in range(max(len(w) - n + 1, 1)):
                    yield w[i : i + n]

    counts = [{} for _ in texts]
    for c, t in zip(counts, texts):
        for g in grams(t):
            c[g] = c.get(g, 0) + 1
    df: dict = {}
    for c in counts:
        for g in c:
            df[g] = df.get(g, 0) + 1
    out = []
    for c in counts:
        w = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2}
        length = math.sqrt(sum(v * v for v in w.values()))
        out.append({g: v / length for g, v in w.items()})
    return out


def test_tfidf_vectors_and_sparse_links(spark):
    rng = random.Random(2)
    words = ["fraude", "lista", "a", "Banco", "sanción", "pago", "zz"]
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(30)] + ["lista  lista\tpago"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vectors, vocabulary = similarity.tfidf_vectors(df, "id", "text")
    names = {r["term_id"]: r["term"] for r in vocabulary.collect()}
    want = _tfidf(texts)
    for r in vectors.collect():
        got = {names[i]: v for i, v in zip(r["idx"], r["vec"])}
        assert got == pytest.approx(want[r["id"]])
    links = {(r["source"], r["target"]): r["weight"] for r in similarity.semantic_links(vectors, threshold=0.9, block_rows=8).collect()}
    dots = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            s = sum(v * want[j].get(g, 0.0) for g, v in want[i].items())
            if s >= 0.9:
                dots[(i, j)] = s
    assert links == pytest.approx(dots) and dots
    again, _ = similarity.tfidf_vectors(df.limit(3), "id", "text", vocabulary)
    assert again.count() == 3


def test_cohesion_and_silhouette_fixture(spark, blobs):
    df = _points(spark, [(1.0, 1.0), (1.1, 0.9), (5.0, 5.0), (5.2, 4.8)], [0, 0, 1, 1])
    assert metrics.cohesion(df) == pytest.approx(0.10607, abs=1e-5)
    labels = np.array([0] * 40 + [1] * 40 + [2] * 40 + [-1] * 6)
    got = metrics.silhouette(_points(spark, blobs, labels), block_rows=11)
    x, y = blobs[:120], labels[:120]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(120):
        a = d[i, y == y[i]].sum() / (sum(y == y[i]) - 1)
        b = min(d[i, y == c].mean() for c in range(3) if c != y[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s))
    assert metrics.silhouette(_points(spark, blobs, np.zeros(126, int))) is None


@pytest.mark.parametrize("width", [2, 20])
def test_distance_sums_by_the_number_of_a_point(spark, monkeypatch, width):
    """Sums over points that come twice and under two labels; blocks return no vectors."""
    monkeypatch.setattr(metrics, "STRIP_ROWS", 4)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (70, width)).astype(float)
    x[60:] = x[:10]
    y = rng.integers(0, 3, 70)
    df = _points(spark, x, y)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(tuple(x[i]), y[i], c): (d[i, y == c].sum(), sum((x == x[i]).all(1) & (y == y[i]))) for i in range(70) for c in range(3)}
    found = metrics.label_distances(df, block_rows=13)
    rows = found.collect()
    assert len(rows) == len(want)
    for r in rows:
        total, copies = want[tuple(r["vec"]), r["label"], r["other"]]
        assert r["total"] == pytest.approx(total, abs=1e-6) and r["copies"] == copies
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [line for line in plan if "FlatMapGroupsInPandas" in line]
    assert made and not any("vec" in line.rsplit("[", 1)[1] for line in made)


def test_curve_areas_against_definition(spark):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 80)
    score = np.round(rng.normal(size=80) + truth, 1)
    df = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score)], "truth int, score double")
    area = metrics.curve_areas(df).first()
    pos, neg = score[truth == 1], score[truth == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    points = [(0.0, 1.0)]
    for t in sorted(set(score), reverse=True):
        hit = score >= t
        points.append((truth[hit].sum() / truth.sum(), truth[hit].mean()))
    pr = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area["roc_auc"] == pytest.approx(auc) and area["pr_auc"] == pytest.approx(pr)
    assert tuple(metrics.curve_areas(df.withColumn("truth", F.lit(0))).first()) == (0.0, 0.0)


def test_local_outlier_factor_against_numpy(spark, blobs):
    k, x = 5, blobs
    model = detectors.LocalOutlierFactor.fit(_points(spark, x), k=k)
    got = {r["id"]: r["score"] for r in model.scores(_points(spark, x)).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d + np.where(np.eye(len(x)) > 0, np.inf, 0), axis=1)[:, :k]
    kd = d[np.arange(len(x)), near[:, -1]]
    lrd = 1 / (np.maximum(kd[near], np.take_along_axis(d, near, 1)).mean(1) + 1e-10)
    self_near = np.argsort(d, axis=1, kind="stable")[:, :k]
    lrd_new = 1 / (np.maximum(kd[self_near], np.take_along_axis(d, self_near, 1)).mean(1) + 1e-10)
    want = lrd[self_near].mean(1) / lrd_new
    assert [got[f"p{i:03d}"] for i in range(len(x))] == pytest.approx(want)


@pytest.mark.parametrize("name", list(detectors.DETECTORS))
def test_detectors_find_planted_outliers_and_reload(spark, blobs, name, tmp_path):
    x = np.vstack([blobs[:40], blobs[120:123]])
    points = _points(spark, x).cache()
    model = detectors.DETECTORS[name].fit(points)
    out = {r["id"]: r for r in model.transform(points).collect()}
    worst = sorted(out, key=lambda i: -out[i]["score"])[:3]
    if name != "OneClassSVM":
        assert set(worst) == {"p040", "p041", "p042"}
    assert abs(sum(r["flag"] for r in out.values()) - 0.05 * len(x)) <= 2
    model.save(spark, str(tmp_path / "m"))
    again = detectors.DETECTORS[name].load(spark, str(tmp_path / "m"))
    assert {r["id"]: r["flag"] for r in again.transform(points).collect()} == {i: r["flag"] for i, r in out.items()}


def test_one_class_scores_follow_the_exact_kernel(spark, blobs):
    x = blobs[:80]
    x = (x - x.mean(0)) / x.std(0)
    got = {r["id"]: r["score"] for r in detectors.OneClassSVM.fit(_points(spark, x), features=1024).scores(_points(spark, x)).collect()}
    gamma = 1 / (x.shape[1] * x.var())
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    alpha, cap = np.full(len(x), 1 / len(x)), 1 / (0.05 * len(x))
    for t in range(3000):
        target = np.zeros(len(x))
        left = 1.0
        for i in np.argsort(kernel @ alpha):
            target[i] = min(cap, left)
            left -= target[i]
        alpha += 2 / (t + 3) * (target - alpha)
    exact = -(kernel @ alpha)
    ours = np.array([got[f"p{i:03d}"] for i in range(len(x))])
    ranks = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(ranks(exact), ranks(ours))[0, 1] > 0.8


def test_one_class_machine_is_solved_to_its_gap(spark, blobs):
    x = np.vstack([blobs[:60], blobs[:3], blobs[:3]])
    x = (x - x.mean(0)) / x.std(0)
    nu = 0.1
    model = detectors.OneClassSVM.fit(_points(spark, x), nu=nu, features=64)
    z = detectors._fourier(x, model.directions, model.shifts)
    # the same problem by many plain steps over rows: weights of rows capped at 1 / (nu n)
    alpha, cap = np.full(len(x), 1 / len(x)), 1 / (nu * len(x))
    for t in range(20_000):
        target, left = np.zeros(len(x)), 1.0
        for i in np.argsort(z @ (z.T @ alpha), kind="stable"):
            target[i] = min(cap, left)
            left -= target[i]
            if left <= 0:
                break
        alpha += 2 / (t + 3) * (target - alpha)
    best = z.T @ alpha
    assert model.gap <= detectors.GAP
    assert model.weights @ model.weights <= (best @ best) * (1 + 2 * detectors.GAP)
    assert np.linalg.norm(model.weights - best) <= 0.1 * np.linalg.norm(best)
    flags = [r["flag"] for r in model.transform(_points(spark, x)).collect()]
    assert abs(sum(flags) - nu * len(x)) <= 3 and 0 < model.kernel_error < 0.2


def test_minimum_determinant_equals_all_subsets(spark):
    from itertools import combinations

    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (10, 2)) @ np.array([[1.0, 0.4], [0.0, 0.6]]), rng.normal(6, 0.5, (4, 2))])
    data = metric.distinct_points(_points(spark, x), "id").repartition(3).cache()
    centre, cov, cut = detectors.minimum_determinant(data, 2)
    size = math.ceil(0.5 * (len(x) + 3))
    best = min(combinations(range(len(x)), size), key=lambda c: np.linalg.det(np.cov(x[list(c)].T, bias=True)))
    assert np.allclose(centre, x[list(best)].mean(0)) and np.allclose(cov, np.cov(x[list(best)].T, bias=True))
    gap = x - centre
    inside = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) <= cut * (1 + 1e-9)
    assert set(np.flatnonzero(inside)) == set(best)


def test_support_cut_is_exact_with_copies(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(np.round(rng.normal(0, 1, (40, 2)), 1), rng.integers(1, 6, 40), axis=0)
    data = metric.distinct_points(_points(spark, x), "id").cache()
    models = [(np.zeros(2), np.eye(2)), (np.ones(2), np.diag([0.5, 2.0]))]
    for support in (1, 30, len(x)):
        cuts = detectors._support_cuts(data, models, support)
        for (c, p), cut in zip(models, cuts):
            scores = np.sort(detectors._mahalanobis(x, c, p))
            assert cut == scores[support - 1]


def test_chi_square_quantiles():
    assert detectors.chi2_quantile(0.5, 3) == pytest.approx(2.365974, abs=1e-5)
    assert detectors.chi2_quantile(0.975, 3) == pytest.approx(9.348404, abs=1e-5)


def test_scaler_uses_population_deviation(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5), ("b", 3, 5)], "entity_id string, x int, y int")
    scaler = Scaler.fit(df, ("x", "y"))
    scaler.save(spark, str(tmp_path / "s"))
    got = {r["id"]: r["vec"] for r in Scaler.load(spark, str(tmp_path / "s")).transform(df).collect()}
    assert got == {"a": [-1.0, 0.0], "b": [1.0, 0.0]}


def _same_partition(found, groups):
    return {frozenset(i for i in found if found[i] == c and c != -1) for c in set(found.values())} - {frozenset()} == {
        frozenset(g) for g in groups}


def test_clusterings_separate_blobs(spark, blobs):
    ids = [f"p{i:03d}" for i in range(120)]
    groups = [ids[:40], ids[40:80], ids[80:120]]
    points = clustering.ml_points(_points(spark, blobs[:120])).cache()
    for run in (
        lambda: clustering.kmeans_labels(points, 3, restarts=3),
        lambda: clustering.minibatch_kmeans(points, 3),
        lambda: clustering.bisecting(points, 3),
        lambda: clustering.cf_clusters(points, 3),
        lambda: clustering.gaussian_mixture(points, 3),
    ):
        found = {r["id"]: r["label"] for r in run().collect()}
        assert _same_partition(found, groups)


def test_clusters_that_are_named_by_text_get_numbers(spark):
    named = spark.createDataFrame([("p1", "p1"), ("p2", "p1"), ("p3", "p3"), ("p4", "-1")], "id string, label string")
    assert {r["id"]: r["label"] for r in clustering.relabel(named).collect()} == {"p1": 0, "p2": 0, "p3": 1, "p4": -1}


def test_mixture_equals_numpy_and_never_loses_likelihood(spark, blobs):
    model = mixture.fit_mixture(_points(spark, blobs), 3, restarts=1, tolerance=1e-9)
    steps = np.diff(model.history)
    assert (steps > -1e-9).all() and len(steps) > 1
    weights, means, covs = model.weights.copy(), model.means.copy(), model.covariances.copy()
    d = blobs.shape[1]
    logs = np.stack(
        [np.log(w) - 0.5 * (np.log(np.linalg.det(2 * np.pi * c)) + np.einsum("ij,jk,ik->i", blobs - m, np.linalg.inv(c), blobs - m)) for w, m, c in zip(weights, means, covs)], 1
    )
    likelihood = np.log(np.exp(logs).sum(1))
    assert model.history[-1] == pytest.approx(likelihood.mean())
    told = {r["id"]: r for r in model.responsibilities(_points(spark, blobs)).collect()}
    want = np.exp(logs - likelihood[:, None])
    assert np.allclose([told[f"p{i:03d}"]["parts"] for i in range(len(blobs))], want)
    assert all(sum(r["parts"]) == pytest.approx(1.0) for r in told.values())
    mean, cov = model.total_covariance()
    assert np.allclose(mean, blobs.mean(0)) and np.allclose(cov, np.cov(blobs.T, bias=True))
    assert d == len(mean)


def test_mixture_of_flat_and_few_points(spark):
    flat = np.column_stack([np.arange(8.0), np.zeros(8)])  # a covariance without full rank
    model = mixture.fit_mixture(_points(spark, flat), 2, restarts=1)
    assert np.isfinite(model.history).all() and model.weights.sum() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        mixture.fit_mixture(_points(spark, np.zeros((0, 2))), 2)


def _ward(x, k):
    """Ward by always merging the cheapest pair; equal rows are one from the start."""
    places, inverse, copies = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    groups = [[i] for i in range(len(places))]
    costs = []

    def cost(a, b):
        na, nb = copies[a].sum(), copies[b].sum()
        ca, cb = (np.average(places[g], axis=0, weights=copies[g]) for g in (a, b))
        return na * nb / (na + nb) * ((ca - cb) ** 2).sum()

    cut = None
    while len(groups) > 1:
        if len(groups) == k:
            cut = [list(g) for g in groups]
        c, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        costs.append(c)
        groups[j] += groups[i]
        del groups[i]
    label = {m: n for n, g in enumerate(cut) for m in g}
    return [label[i] for i in np.ravel(inverse)], sorted(costs)


@pytest.mark.parametrize("block_rows", [13, 1024])
def test_ward_equals_cheapest_pair_first(spark, blobs, block_rows):
    x = np.vstack([blobs[::3], blobs[:4], blobs[:4]])
    want, costs = _ward(x, 4)
    points = _points(spark, x)
    got = {r["id"]: r["label"] for r in agglomerative.ward_labels(points, 4, block_rows).collect()}
    mine = [got[f"p{i:03d}"] for i in range(len(x))]
    assert len(set(zip(mine, want))) == len(set(mine)) == 4
    found = sorted(r["cost"] for r in agglomerative.ward_merges(points, block_rows).collect())
    assert np.allclose(found, costs)


def test_features_keep_their_radius_whatever_the_partitions(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.02, (30, 40)) for c in (0.0, 1.0)] + [rng.normal(0, 3, (5, 40))])
    seen = []
    for parts in (1, 7):
        features, member = agglomerative.cluster_features(_points(spark, x).repartition(parts), 0.5, block_rows=9)
        of = {r["id"]: r["feature"] for r in member.collect()}
        rows = {r["id"]: r for r in features.collect()}
        assert set(of.values()) == set(rows) and len(rows) == 2 + 5  # cubes of this width would keep all 65 rows apart
        for f, r in rows.items():
            mine = x[[i for i in range(len(x)) if of[f"p{i:03d}"] == f]]
            assert len(mine) == r["size"] and np.allclose(mine.mean(0), r["vec"])
            assert ((mine - mine.mean(0)) ** 2).sum() == pytest.approx(r["squares"]) and r["squares"] / r["size"] <= 0.25
        seen.append(of)
    assert seen[0] == seen[1]


def _density(x, smallest, samples):
    """Density clusters by Kruskal over all pairs, equal weights together, and recursion over the tree."""
    places, copies = np.unique(x, axis=0, return_counts=True)
    d = np.sqrt(((places[:, None] - places[None]) ** 2).sum(2))
    core = [sorted(np.repeat(row, copies))[samples - 1] for row in d]
    edges = sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(len(places)) for j in range(i))
    group = {i: [i] for i in range(len(places))}
    home = list(range(len(places)))
    size = lambda members: int(sum(copies[m] for m in members))
    node = {i: {"members": [i], "run": {"end": 1e9, "out": [(1e9, size([i]))], "kids": [], "points": [i]} if copies[i] >= smallest else None} for i in group}
    at = 0
    while at < len(edges):
        w, links = edges[at][0], []
        while at < len(edges) and edges[at][0] == w:
            links.append(edges[at][1:])
            at += 1
        near = {}
        for i, j in links:
            if home[i] != home[j]:
                near.setdefault(home[i], set()).add(home[j])
                near.setdefault(home[j], set()).add(home[i])
        seen = set()
        for start in list(near):
            if start in seen:
                continue
            parts, todo = [], [start]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    parts.append(a)
                    todo += near[a]
            members = [m for a in parts for m in node[a]["members"]]
            runs = [node[a]["run"] for a in parts if node[a]["run"]]
            small = [m for a in parts if not node[a]["run"] for m in node[a]["members"]]
            lam, run = 1 / w, None
            if size(members) >= smallest:
                if len(runs) == 1:
                    run = runs[0]
                    run["out"].append((lam, size(small)))
                    run["points"] += small
                else:
                    for r in runs:
                        r["birth"] = lam
                    run = {"out": [(lam, size(members))], "kids": runs, "points": small}
            new = min(members)
            for a in parts:
                del node[a]
            node[new] = {"members": members, "run": run}
            for m in members:
                home[m] = new
    labels, root = {}, next(iter(node.values()))["run"]

    def value(run):
        run["below"] = sum(value(k) for k in run["kids"])
        run["stable"] = sum((lam - run.get("birth", 0.0)) * n for lam, n in run["out"])
        return max(run["stable"], run["below"])

    def mark(run, name):
        name = id(run) if name is None and run is not root and run["stable"] >= run["below"] else name
        for m in run["points"]:
            labels[m] = name
        for k in run["kids"]:
            mark(k, name)

    if root:
        value(root)
        mark(root, None)
    index = {tuple(p): i for i, p in enumerate(places)}
    return [labels.get(index[tuple(r)]) for r in x]


@pytest.mark.parametrize(("seed", "smallest", "samples", "parts"), [(1, 5, 3, 8), (2, 4, 4, 2), (3, 8, 2, 3)])
def test_density_clusters_equal_kruskal(spark, seed, smallest, samples, parts):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, s, (25, 2)) for c, s in ((0, 0.4), (2.2, 0.5), (7, 1.0), (7.5, 0.2))] + [rng.uniform(-5, 12, (15, 2))])
    if seed != 1:
        x = np.round(x, 1)  # many equal weights
    x = np.vstack([x, np.repeat(x[:2], 6, axis=0)])  # places of many copies
    assert len(np.unique(x, axis=0)) > 60
    found = {r["id"]: r["label"] for r in density.density_clusters(_points(spark, x), smallest, samples, block_rows=20, parts=parts).collect()}
    want = _density(x, smallest, samples)
    mine = [found[f"p{i:03d}"] for i in range(len(x))]
    assert [m == -1 for m in mine] == [w is None for w in want]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want)) > 2


def test_density_clusters_mark_noise(spark, blobs):
    found = {r["id"]: r["label"] for r in density.density_clusters(_points(spark, blobs), 10, 5, block_rows=30).collect()}
    for start in (0, 40, 80):
        inside = [found[f"p{i:03d}"] for i in range(start, start + 40)]
        top = max(set(inside), key=inside.count)
        assert top != -1 and inside.count(top) >= 34
    assert sum(found[f"p{i:03d}"] == -1 for i in range(120, 126)) >= 5


def test_projection_matches_svd(spark, blobs, monkeypatch):
    points = clustering.ml_points(_points(spark, blobs)).cache()
    centred = blobs - blobs.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    for width in (2048, 1):
        monkeypatch.setattr(clustering, "EXACT_PCA_WIDTH", width)
        got = {r["id"]: r["coords"] for r in clustering.Projection.fit(points, 2).transform(points).collect()}
        ours = np.array([got[f"p{i:03d}"] for i in range(len(blobs))])
        assert np.allclose(np.abs(ours), np.abs(centred @ vt[:2].T), atol=1e-5)


def test_supervised_models_learn_and_reload(spark, tmp_path):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 3)) + y[:, None] * 2
    df = _points(spark, x, y).cache()
    split = supervised.stratified_split(df, "label", "id").groupBy("label").agg(
        F.count_if("is_train").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["t"] == math.floor(0.7 * r["n"]) for r in split)
    gaps = df.withColumn("label", F.when(F.col("id") > "p150", F.col("label")))
    assert supervised.stratified_split(gaps, "label", "id").where("label IS NULL AND is_train").count() == 0
    names = ["baseline_5_svm", "baseline_6_knn"]
    table, models = supervised.compare_models(df, names)
    rows = {r["Modelo"]: r for r in table.collect()}
    assert set(rows) == set(names) and all(r["ROC-AUC"] > 0.9 for r in rows.values())
    for name, model in models.items():
        model.save(spark, str(tmp_path / name))
        again = supervised.Classifier.load(spark, str(tmp_path / name))
        a = model.score(df.select("id", "vec")).select("id", "guess")
        assert a.exceptAll(again.score(df.select("id", "vec")).select("id", "guess")).count() == 0
    one, none = supervised.compare_models(df.withColumn("label", F.lit(0)))
    assert one.count() == 0 and not none


def test_models_learn_after_graph_rounds_in_one_session(spark):
    """A fitted model's margin feeds a second fit, as in the kernel classifier, after components were found."""
    links = spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "node long, next long")
    assert {r["node"]: r["end"] for r in components.follow(links).collect()} == {3: 1, 2: 1, 9: 8}
    x = np.concatenate([np.linspace(-3, 0.2, 20), np.linspace(-0.2, 3, 20)])[:, None]
    data = supervised._features(_points(spark, x, np.repeat([0, 1], 20)))
    svc = LinearSVC(regParam=0.1).fit(data)
    platt = LogisticRegression(maxIter=5).fit(supervised._margin(svc, data))
    assert platt.coefficients[0] > 0


def test_encoder_runs_in_tasks_and_is_normalised(spark):
    texts = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "y")], "entity_id string, entity_profile_text string")
    factory = lambda: lambda items: np.array([[len(t), 1.0] for t in items])
    got = {r["id"]: r["vec"] for r in similarity.encode_texts(texts, factory).collect()}
    assert got["a"] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)])
    assert got["b"] == pytest.approx([0.0, 1.0])


def test_term_counts_keep_short_words(spark):
    df = spark.createDataFrame([(1, "a A")], "id long, text string")
    got = {r["term"]: r["tf"] for r in tfidf.term_counts(df, "id", "text").collect()}
    assert got == {" ": 4, "a": 2, " a": 2, "a ": 2, " a ": 2}
