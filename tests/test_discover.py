import json
import random

from pyspark.sql import functions as F

from tracecast.operators.discover import discover
from tracecast.operators.replay import replay, visible_path
from tracecast.operators.tree import transitions, tree_nodes
from tracecast.sources.trees import models_from, read_models, tree_from_text, tree_to_text, write_models
from tracecast.storage import materialize

# Logs and the trees that discovery must give for them.
GOLDEN = {
    "3-4": "Seq(3, 4)",
    "0-1-2": "Seq(0, 1, 2)",
    "1-0-2": "Seq(1, 0, 2)",
    "0-1-2;1-0-2": "Seq(And(1, 0), 2)",
    "0-1-2;1-0-2;1-2-0": "And(Seq(1, 2), 0)",
    "0-1-2;1-2-0": "And(2, 0, 1)",
    "3-4-5-3-4": "XorLoop(Seq(3, 4), 5, tau)",
    "3-4-5-3-4;3-4-5-3-4-5-3-4": "XorLoop(Seq(3, 4), 5, tau)",
    "3-4;3-4-5-3-4;3-4-5-3-4-5-3-4": "XorLoop(Seq(3, 4), 5, tau)",
    "0-1-2;1-0-2;1-2-0;3-4;3-4-5-3-4;3-4-5-3-4-5-3-4": "Xor(And(Seq(1, 2), 0), XorLoop(Seq(3, 4), 5, tau))",
}
FURTHER = {
    "a": "a",
    "a-b-c;a-c": "Seq(a, Xor(tau, b), c)",
    "a-a-a": "XorLoop(a, tau, tau)",
    "a-b;c": "Xor(Seq(a, b), c)",
    "a-b-a-b;b-a;b-b-a": "And(XorLoop(a, tau, tau), XorLoop(b, tau, tau))",
    "a-b;a-b-a-b": "XorLoop(Seq(a, b), tau, tau)",  # no cut, then a split where an end meets a start
    # No cut; "e" is the first activity without which there is one.
    "s-x-y-e-s-x-e;s-x-z-e": "And(XorLoop(e, tau, tau), Seq(XorLoop(Seq(s, x), y, tau), Xor(tau, z)))",
    "a-r-a;a-q-a;a": "XorLoop(a, Xor(q, r), tau)",
}


def unordered(tree):
    """Children of And and Xor as sets."""
    if not isinstance(tree, list):
        return tree
    kids = [unordered(k) for k in tree[1:]]
    return (tree[0], tuple(sorted(kids, key=repr)) if tree[0] in ("And", "Xor") else tuple(kids))


def test_golden_trees(spark):
    expected = GOLDEN | FURTHER
    rows = [(log, t.split("-"), 1) for log in expected for t in log.split(";")]
    found = discover(spark.createDataFrame(rows, "model_id string, acts array<string>, n_traces bigint")).collect()
    assert len(found) == len(expected)
    for row in found:
        assert unordered(json.loads(row.tree)) == unordered(tree_from_text(expected[row.model_id])), row


def test_counts_and_partitions_do_not_matter(spark):
    rows = [("m", t.split("-"), n) for t, n in (("0-1-2", 4), ("1-0-2", 6), ("3-4", 5), ("3-4-5-3-4", 2))]
    log = spark.createDataFrame(rows, "model_id string, acts array<string>, n_traces bigint")
    assert discover(log).first().tree == discover(log.repartition(5)).first().tree


def test_a_large_alphabet_is_no_error(spark):
    acts = [f"a{i:04d}" for i in range(2_500)]
    log = spark.createDataFrame([("m", acts, 1)], "model_id string, acts array<string>, n_traces bigint")
    assert json.loads(discover(log).first().tree) == ["Seq", *acts]


def test_text_form_and_store(spark, tmp_path):
    text = "Xor(And(Seq(1, 2), 0), XorLoop(Seq(3, 4), 5, tau))"
    tree = tree_from_text(text)
    assert tree_to_text(tree) == text and tree_to_text(tree_from_text("7")) == "7"
    write_models(models_from(spark, {"2_0": tree, "2_1": "a, (b)"}), str(tmp_path / "models"))
    back = {r.model_id: json.loads(r.tree) for r in read_models(spark, str(tmp_path / "models")).collect()}
    assert back == {"2_0": tree, "2_1": "a, (b)"}


def test_trees_of_random_logs_replay_their_logs(spark):
    """With no noise filter every tree must be able to play its whole log, and show it unchanged."""
    rng, rows = random.Random(21), []
    for m in range(80):
        acts = "abcdef"[: rng.randint(2, 6)]
        for v in {tuple(rng.choice(acts) for _ in range(rng.randint(0 if m % 3 == 0 else 1, 6))) for _ in range(rng.randint(1, 6))}:
            rows.append((f"m{m}", len(rows), list(v), 1))
    log = materialize(spark.createDataFrame(rows, "model_id string, variant_id bigint, acts array<string>, n_traces bigint"), "random")
    models = materialize(discover(log), "models")
    replayed = materialize(replay(log, models), "replayed")
    assert replayed.agg(F.sum("n_skipped")).first()[0] == 0
    shown: dict = {}
    for r in visible_path(replayed, transitions(tree_nodes(models))).orderBy("pos").collect():
        shown.setdefault(r.variant_id, []).append(r.activity)
    assert {v: shown.get(v, []) for _, v, _, _ in rows} == {v: a for _, v, a, _ in rows}
