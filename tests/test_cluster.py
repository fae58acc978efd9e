import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracecast.operators import cluster as C
from tracecast.operators import density, neighbours, ngrams, svd, traces
from tracecast.operators.router import fit_linear, route, train_router
from tracecast.plans.clustered import best_candidate, candidate_scores, clustered_lines, fit_clustered
from tracecast.operators import split
from tracecast.settings import Settings


def test_connected_components_against_union_find(spark):
    rng = random.Random(2)
    edges = {(f"n{rng.randrange(120):03}", f"h{rng.randrange(110)}") for _ in range(170)}
    edges |= {(f"n{i:03}", f"chain{j}") for i in range(200, 260) for j in (i, i + 1)}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    smallest: dict = {}
    for n in {a for a, _ in edges}:
        smallest[root(n)] = min(n, smallest.get(root(n), n))
    found = C.connected_components(spark.createDataFrame(list(edges), "node string, hub string"))
    assert {r.node: r.component for r in found.collect()} == {n: smallest[root(n)] for n in {a for a, _ in edges}}


def grams(acts):
    return frozenset(acts) | {" ".join(p) for p in zip(acts, acts[1:])}


def brute_clusters(weights: dict, sets: dict, size: int):
    """Labels, and exemplars, of the points: every pair compared, merged at each distance in turn, chosen from the root down."""
    points = sorted(sets)
    apart = {(a, b): len(sets[a] ^ sets[b]) for a in points for b in points if a != b}

    def core(p):
        ranks = [0] * (weights[p] - 1) + sorted(d for (a, q), d in apart.items() if a == p for _ in range(weights[q]))
        return ranks[size - 1] if len(ranks) >= size else None

    cores = {p: core(p) for p in points}
    live = [p for p in points if cores[p] is not None]
    reach = {(a, b): max(apart[a, b], cores[a], cores[b]) for a in live for b in live if a < b}
    dense = lambda level: level**-0.5 if level else density.DENSEST
    part = {p: frozenset([p]) for p in live}
    tree: list = []  # clusters: members at the end, mass, children, members at birth
    holds: dict = {}
    for p in live:
        if weights[p] >= size:
            holds[part[p]] = len(tree)
            tree.append({"mass": weights[p] * dense(cores[p]), "children": [], "points": {p}, "birth": {p}, "since": cores[p]})
    total = lambda group: sum(weights[p] for p in group)
    for level in sorted(set(reach.values())):
        before = set(part.values())
        for (a, b), d in reach.items():
            if d == level and part[a] != part[b]:
                both = part[a] | part[b]
                for p in both:
                    part[p] = both
        for group in set(part.values()) - before:
            inside = {g: holds[g] for g in before if g <= group and g in holds and tree[holds[g]]["since"] < level}
            inner = list(inside.values())
            if len(inner) == 1:
                (old,) = inside
                cluster = tree[inner[0]]
                cluster["mass"] += (total(group) - total(old)) * dense(level)
                cluster["points"] |= group
                holds[group] = inner[0]
            elif inner:
                for g, c in inside.items():
                    tree[c]["mass"] -= total(g) * dense(level)
                holds[group] = len(tree)
                tree.append({"mass": total(group) * dense(level), "children": inner, "points": set(group), "birth": set(), "since": level})
            elif total(group) >= size:
                holds[group] = len(tree)
                tree.append({"mass": total(group) * dense(level), "children": [], "points": set(group), "birth": set(group), "since": level})
    roots = [holds[g] for g in set(part.values()) if g in holds]
    best = {}
    for i, c in enumerate(tree):
        below = sum(best[k] for k in c["children"])
        c["head"] = c["mass"] >= below and (i not in roots or len(roots) > 1)
        best[i] = max(c["mass"], below)
    label, exemplar = dict.fromkeys(points), set()

    def down(i, chosen):
        chosen = chosen if chosen is not None else (i if tree[i]["head"] else None)
        exemplar.update(tree[i]["birth"])
        if chosen is not None:
            for p in tree[i]["points"]:
                label[p] = min(tree[chosen]["points"])
        for k in tree[i]["children"]:
            down(k, chosen)

    for r in roots:
        down(r, None)
    return label, exemplar


def random_points(spark, trace_frame, seed: int, n: int, letters: str):
    rng = random.Random(seed)
    texts = ["-".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    points = C.points_of(C.feature_points(trace_frame(";".join(texts))))
    rows = points.collect()
    return points, {r.point: r.weight for r in rows}, {r.point: frozenset(r["items"]) for r in rows}


@pytest.mark.parametrize("seed, n, letters, most_nodes", [(1, 300, "abc", 1000), (2, 300, "abcdefgh", 1000), (2, 200, "abcde", 5), (3, 250, "abcd", 30), (4, 40, "ab", 1)])
def test_clusters_equal_the_condensed_single_linkage_of_all_pairs(spark, trace_frame, seed, n, letters, most_nodes):
    points, weights, sets = random_points(spark, trace_frame, seed, n, letters)
    sizes = [2, 3, 5, 9]
    found = C.labels_of(points, sizes, most_nodes=most_nodes).collect()
    for size in sizes:
        label, exemplar = brute_clusters(weights, sets, size)
        own = {r.point: r.label for r in found if r.candidate == size}
        groups = lambda of: {frozenset(p for p in of if of[p] == k) for k in set(of.values()) - {None}}
        assert groups(own) == groups(label), (size, len(groups(own)), len(groups(label)))
        assert {r.point for r in found if r.candidate == size and r.exemplar and r.label is not None} == {p for p in exemplar if label[p] is not None}


def test_blocks_of_several_orders_find_the_near_points(spark, trace_frame):
    points, weights, sets = random_points(spark, trace_frame, 7, 600, "abcdef")
    small = neighbours.BlockSettings(points=120, orders=6)
    cored = {r.point: r.cores for r in neighbours.core_distances(points, [1, 3], small).collect()}
    exact = {r.point: r.cores for r in neighbours.core_distances(points, [1, 3]).collect()}
    right = sum(cored[p][0] == exact[p][0] for p in sets)
    assert len(sets) > 3 * 120 and right >= 0.8 * len(sets) and all(cored[p][0] >= exact[p][0] for p in sets)
    found = C.labels_of(points, [2, 4], small).collect()
    assert len(found) == 2 * len(sets)


@pytest.mark.parametrize("size, nodes", [(60, 200_000), (60, 100), (150, 200_000)])
def test_results_do_not_depend_on_the_size_of_blocks(spark, trace_frame, monkeypatch, size, nodes):
    points, weights, sets = random_points(spark, trace_frame, 7, 300, "abcdef")
    points, small, sizes = points.persist(), neighbours.BlockSettings(points=size), [2, 4]
    monkeypatch.setattr(neighbours, "thinned", lambda edges, parts, settings, run=neighbours.thinned: run(edges, parts, settings, nodes))
    assert len(sets) > 1.3 * size
    core = lambda *blocks: {r.point: r.cores for r in neighbours.core_distances(points, [1, 3], *blocks).collect()}
    assert core(small) == core()
    labels = lambda *blocks: sorted((r.candidate, r.point, r.label or -1, r.exemplar) for r in C.labels_of(points, sizes, *blocks).collect())
    assert labels(small) == labels()


def test_any_two_points_meet_in_a_block(spark):
    points = spark.range(40).select(F.col("id").alias("point"), F.array("id").alias("items"))

    def pairs(block):
        held = block.column("point").to_pylist()
        assert len(held) <= 3 * 10
        yield pa.RecordBatch.from_arrays([pa.array([a for a in held for _ in held]), pa.array(held * len(held))], ["a", "b"])

    met = {(r.a, r.b) for r in neighbours.in_blocks(points, pairs, "a long, b long", neighbours.BlockSettings(points=10)).collect()}
    assert met == {(a, b) for a in range(40) for b in range(40)}


def test_thinned_edges_span_at_the_least_cost(spark):
    rng = random.Random(8)
    edges = [(2, a, b, rng.randint(1, 9)) for a in range(60) for b in range(a) if rng.random() < 0.3]
    found = neighbours.thinned(spark.createDataFrame(edges, neighbours.FOREST), 20, neighbours.BlockSettings(points=6)).collect()
    w = np.full((60, 60), 99, np.int32)
    for _, a, b, level in edges:
        w[a, b] = w[b, a] = level
    assert len(found) == 59 and sum(r.level for r in found) == neighbours.least_tree(lambda i: w[i], 60)[2].sum()
    assert {(r.candidate, r.a, r.b, r.level) for r in found} <= set(edges)


def test_least_trees_span_at_the_least_cost():
    rng = random.Random(3)
    for n in (2, 3, 30):
        w = np.array([[rng.randint(1, 20) for _ in range(n)] for _ in range(n)], np.int32)
        w = np.minimum(w, w.T)
        a, b, level = neighbours.least_tree(lambda i: w[i], n)
        edges = sorted((int(w[i, j]), i, j) for i in range(n) for j in range(i))
        up = list(range(n))
        cost = 0
        for c, i, j in edges:
            while up[i] != i:
                i = up[i]
            while up[j] != j:
                j = up[j]
            if i != j:
                up[i] = j
                cost += c
        assert cost == level.sum() and len(a) == n - 1


def test_clusters_of_small_log(spark, small):
    train = traces.trainable(split.train_test_split(small).where("is_train")).drop("is_train")
    clustering = C.cluster_traces(train)
    found = clustering.memberships
    chosen = C.representatives(found).join(clustering.variants.select("variant_id", "acts"), "variant_id")
    groups = {}
    for r in chosen.where("is_build").collect():
        groups.setdefault(r.candidate, {}).setdefault(r.cluster_id, set()).add("-".join(r.acts))
    as_sets = {c: {frozenset(g) for g in by.values()} for c, by in groups.items()}
    loops, short = "3-4-5-3-4;3-4-5-3-4-5-3-4".split(";"), "3-4"
    assert frozenset(loops) in as_sets[2] and frozenset([short]) in as_sets[2]
    assert frozenset([*loops, short]) in as_sets[6] and frozenset(["0-1-2", "1-0-2", "1-2-0"]) in as_sets[6]
    sums = found.groupBy("candidate", "variant_id").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    assert max(as_sets) < 10  # one cluster left: the candidate is dropped
    assert all(r.k > 1 for r in chosen.groupBy("candidate").agg(F.countDistinct("cluster_id").alias("k")).collect())
    covered = C.coverage(chosen).collect()
    assert all(0 < r.build_cases <= 6 and r.training_cases <= 20 for r in covered)


def test_soft_membership_against_its_definition(spark, trace_frame):
    points, weights, sets = random_points(spark, trace_frame, 6, 150, "abcd")
    sizes = [2, 5, 9]
    labels = C.labels_of(points, sizes)
    marks: dict = {}
    for r in labels.collect():
        if r.exemplar and r.label is not None:
            marks.setdefault(r.candidate, {}).setdefault(r.label, []).append(r.point)
    expected = {}
    for size, clusters in marks.items():
        for p in sets:
            near = sorted((min(len(sets[p] ^ sets[q]) for q in own), c) for c, own in clusters.items())[: C.NEAREST_CLUSTERS]
            shares = {c: float(d == 0) if near[0][0] == 0 else 1 / d for d, c in near}
            expected |= {(size, p, c): x / sum(shares.values()) for c, x in shares.items() if x}
    found = {(r.candidate, r.point, r.cluster): r.prob for r in C.soft_membership(points, labels, sizes).collect()}
    assert marks and found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_a_point_belongs_to_all_clusters(spark, monkeypatch):
    sets = {i: set(range(i % 7 + 1)) | {100 + i} for i in range(30)}
    points = spark.createDataFrame([(i, 1, sorted(s)) for i, s in sets.items()], "point long, weight long, items array<long>")
    labels = [(c, i, i - i % k if i < 20 * k else None, i < 20 * k) for c, k in ((2, 1), (5, 2)) for i in range(30)]
    labels = spark.createDataFrame(labels, "candidate int, point long, label long, exemplar boolean")
    want = {}
    for size, k in ((2, 1), (5, 2)):
        for p in sets:
            near = {}
            for q in range(min(30, 20 * k)):
                near[q - q % k] = min(near.get(q - q % k, 99), len(sets[p] ^ sets[q]))
            shares = {c: float(d == 0) if not min(near.values()) else 1 / d for c, d in near.items()}
            want |= {(size, p, c): x / sum(shares.values()) for c, x in shares.items() if x}
    assert sum(size == 2 and p == 29 for size, p, _ in want) == 20
    for numbers, rows in ((1 << 23, 10_000), (100, 3)):
        monkeypatch.setattr(neighbours, "_NUMBERS", numbers)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        found = {(r.candidate, r.point, r.cluster): r.prob for r in C.soft_membership(points, labels, [2, 5]).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in found)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cluster_without_strong_member_takes_its_best(spark):
    rows = spark.createDataFrame(
        [(2, "c", 5, 1, 0.1), (2, "c", 7, 1, 0.15), (2, "d", 5, 1, 0.9)],
        "candidate int, cluster_id string, variant_id bigint, n_traces bigint, prob double",
    )
    found = {(r.cluster_id, r.variant_id): (r.is_build, r.is_training) for r in C.representatives(rows).collect()}
    assert found == {("c", 7): (True, True), ("d", 5): (True, True)}


def labelled_traces(spark, seed: int, n: int):
    rng = random.Random(seed)
    train = [([rng.choice("abcd" if c == "x" else "cdef" if c == "y" else "adfg") for _ in range(rng.randint(2, 8))], c) for c in "xyxyz" for _ in range(n)]
    rows = [(2, c, i, a, 1) for i, (a, c) in enumerate(train)]
    labelled = spark.createDataFrame(rows, "candidate int, cluster_id string, variant_id bigint, acts array<string>, n_traces bigint")
    return train, labelled


def log_odds_route(train, prefix, length):
    """Smoothed log-odds of the n-grams that a cut holds: what the classifiers are to be as good as."""
    vocab = set().union(*(grams(a) for a, _ in train))
    have = grams(prefix) & vocab
    best = None
    for cluster in sorted({c for _, c in train}):
        rows = [grams(a[:length]) for a, c in train if c == cluster]
        score = math.log(len(rows) / len(train))
        for g in vocab:
            p = (sum(g in r for r in rows) + 1) / (len(rows) + 2)
            score += math.log(p) if g in have else math.log(1 - p)
        if best is None or score > best[0] + 1e-9:
            best = (score, cluster)
    return best[1]


def test_classifiers_are_as_good_as_log_odds_on_other_traces(spark):
    train, labelled = labelled_traces(spark, 9, 30)
    others, _ = labelled_traces(spark, 10, 20)
    longest = max(len(a) for a, _ in train)
    sequences = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(others)], "variant_id bigint, acts array<string>")
    found = {(r.variant_id, r.length): r.cluster_id for r in route(sequences, train_router(labelled, longest)).collect()}
    asked = [(i, k) for i, (a, _) in enumerate(others) for k in range(2, len(a))]
    assert found.keys() == set(asked)
    right = sum(found[i, k] == others[i][1] for i, k in asked)
    odds = sum(log_odds_route(train, others[i][0][:k], min(k, longest)) == others[i][1] for i, k in asked)
    assert right >= 0.97 * odds and right > 0.6 * len(asked)


def test_classifiers_equal_the_plain_version(spark):
    train, labelled = labelled_traces(spark, 4, 8)
    longest = max(len(a) for a, _ in train)
    router = train_router(labelled, longest)
    axes = {tuple(r.gram): np.array(r.axis) for r in router.basis.collect()}
    names = {" ".join(g): g for g in axes}
    vector = lambda acts: sum((axes[names[g]] for g in grams(acts) if g in names), np.zeros(len(next(iter(axes.values())))))
    draw = {r.variant_id: r.draw for r in labelled.select("variant_id", F.xxhash64("variant_id", F.lit(Settings().seed)).alias("draw")).collect()}
    order = sorted(range(len(train)), key=lambda i: (draw[i], i))
    models = {r.length: r for r in router.models.collect()}
    assert models.keys() == set(range(2, longest + 1))
    for length, model in models.items():
        x = np.stack([vector(train[i][0][:length]) for i in order])
        label = np.array([model.clusters.index(train[i][1]) for i in order])
        assert np.allclose(fit_linear(x, label, 3, Settings().seed), np.array(model.weights), atol=1e-6)
    tests = [["a", "q", "q"], ["q", "q", "q", "q"], train[0][0] + ["a"] * longest]
    sequences = spark.createDataFrame(list(enumerate(tests)), "variant_id bigint, acts array<string>")
    for r in route(sequences, router).collect():
        model = models[min(r.length, longest)]
        weights = np.array(model.weights)
        scores = np.round(weights[:, :-1] @ vector(tests[r.variant_id][: r.length]) + weights[:, -1], 6)
        assert scores[model.clusters.index(r.cluster_id)] == scores.max()


def test_a_classifier_sees_no_more_rows_than_asked(spark):
    _, labelled = labelled_traces(spark, 4, 20)
    few = train_router(labelled, 5, Settings(router_rows=10))
    assert {r.length for r in few.models.collect()} == {2, 3, 4, 5}
    assert route(labelled.select("variant_id", "acts"), few).count() > 0


def test_classifiers_and_routes_know_the_variants_of_largest_hash(spark):
    """The cluster of the last ten of 2,020 variants, by the order they are drawn in."""
    drawn = spark.range(2020).withColumn("draw", F.xxhash64("id", F.lit(Settings().seed))).orderBy("draw", "id").collect()
    late = {r.id for r in drawn[-10:]}
    rows = [(2, 7 if i in late else i % 2, i, ["z", "y", "z"] if i in late else ["a", "ab"[i % 2], "b"]) for i in range(2020)]
    labelled = spark.createDataFrame(rows, "candidate int, cluster_id long, variant_id long, acts array<string>")
    router = train_router(labelled, 3)
    assert {(r.length, tuple(r.clusters)) for r in router.models.collect()} == {(2, (0, 1, 7)), (3, (0, 1, 7))}
    asked = spark.createDataFrame([(1, ["z", "y", "z"]), (2, ["a", "b", "b"])], "variant_id long, acts array<string>")
    assert {r.variant_id: r.cluster_id for r in route(asked, router).collect()} == {1: 7, 2: 1}


def matrix(texts):
    names = sorted(set().union(*(grams(t.split("-")) for t in texts)))
    return np.array([[g in grams(t.split("-")) for g in names] for t in texts], dtype=float)


@pytest.mark.parametrize("components", [3, 200])
def test_svd_matches_numpy(spark, trace_frame, components):
    rng = random.Random(5)
    texts = ["-".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    features = ngrams.first_lengths(trace_frame(";".join(texts)))
    basis = svd.svd_basis(features, settings=Settings(svd_components=components))
    axes = np.array([r.axis for r in basis.collect()])
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-8)
    found = {r.case_id: r.projection for r in svd.svd_features(features, basis).collect()}
    projected = np.array([found[i] for i in range(len(texts))])
    whole = matrix(texts)
    s = np.linalg.svd(whole, compute_uv=False)
    lengths = np.linalg.norm(projected, axis=0)
    assert np.allclose(lengths[:3], s[:3], rtol=1e-2) and projected.shape[1] == min(components, whole.shape[1])
    if components == 200:
        assert np.allclose(projected @ projected.T, whole @ whole.T, atol=1e-6)


def test_prefix_projections_are_projections_of_the_prefixes(spark, trace_frame):
    texts = ["a-b-c-a", "a-c", "b-c-a-b-b", "c", "a-b", "b-b-c"]
    rows = trace_frame(";".join(texts))
    basis = svd.svd_basis(ngrams.first_lengths(rows))
    axes = {" ".join(r.gram): np.array(r.axis) for r in basis.collect()}
    more = trace_frame(";".join([*texts, "q-q-a-b"]))
    found = {(r.case_id, r.length): np.array(r.projection) for r in svd.prefix_projections(more, basis).collect()}
    every = [*texts, "q-q-a-b"]
    assert found.keys() == {(i, k) for i, t in enumerate(every) for k in range(2, len(t.split("-")) + 1)}
    for (i, k), x in found.items():
        assert np.allclose(x, sum((axes[g] for g in grams(every[i].split("-")[:k]) if g in axes), 0), atol=1e-9)


def test_clustered_run_of_small_log(spark, small):
    both = split.train_test_split(small)
    train, validation = split.cut_validation(traces.trainable(both.where("is_train")).drop("is_train"))
    fitted = fit_clustered(train)
    scores = candidate_scores(validation, fitted)
    assert {r.candidate for r in scores.collect()} == {r.candidate for r in fitted.chosen.select("candidate").distinct().collect()}
    best = best_candidate(scores).first()
    assert best.score == max(r.score for r in scores.collect())
    lines = clustered_lines(both.where("not is_train"), validation, fitted).collect()
    assert sorted(r.case_id for r in lines) == [45, 48, 52, 62, 63]
    assert all(0 <= r.damerau_similarity <= 1 for r in lines)


def test_no_candidate_falls_back_to_one_model(spark, trace_frame):
    rows = trace_frame("a-b-c;a-b-c;a-b-c;a-b-c;a-b-c")
    fitted = fit_clustered(rows)
    assert fitted.router is None
    lines = clustered_lines(trace_frame("a-b-c"), rows.limit(0), fitted).collect()
    assert [r.suffix_guessed for r in lines] == [["c"]]


def test_candidate_range():
    assert Settings().candidates() == list(range(2, 11))
    assert Settings(end_inclusive=True).candidates()[-1] == 11
