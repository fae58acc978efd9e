"""Every query and every stage on rows as they may come: nulls, repeated rows and ids, long texts, no rows, clashing names."""

import random

import pytest

import corpus_pipeline
from tracecast.llm import licences, mixing, ngram_join, pii
from tracecast.llm.queries import queries

#: Names that the operators give to columns of their own.
INNER = (
    "row base entities same candidates terms disclosing told owned term n n_term class_doc_id class_id class_row stays rows node label size bucket block sign bands "
    "mix_source mix_tokens mix_epoch mix_at mix_block mix_draw mix_weight mix_repeats mix_epochs mix_blocks mix_last draw epoch goal blocks place core words line path folder "
    "above score kept n_words base_failed text_a text_b packed copied runs spans train held_out lang_pred predicted piece start length sequence_id offset tokens given_path"
).split()


def documents(spark, kind: str):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 60))) + "\nwrite to a@b.org, all rights reserved", rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(80)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (None, rows[0][1], "en", "a"), (None, None, None, None), (None, "MIT no", None, None), (203, rows[1][1], "de", None), rows[2], rows[2]]
    rows += [(300, " ".join(words) * 400, "en", "a"), (301, "x" * 300_000, "en", "b"), (302, "\n" * 50_000, "de", "b")]
    rows = [] if kind == "empty" else rows
    names = ", ".join(f"`{n}` {'int' if i % 2 else 'string'}" for i, n in enumerate(INNER))
    clash = tuple(i if i % 2 else "x" for i in range(len(INNER)))
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *clash) for i, t, lang, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    docs = documents(spark, request.param)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    few = [] if request.param == "empty" else [(i, i % 2, i % 3 == 0, "x") for i in range(80)] + [(None, 1, True, "x"), (5, None, None, "x"), (5, 1, False, "x")]
    spark.createDataFrame([(a, b, None if c is None else int(c), d) for a, b, c, d in few], "doc_id long, quality int, toxic int, score string").write.parquet(f"{path}/labels.parquet")
    vectors = [] if request.param == "empty" else [(i, [0.1 * i, 1.0, 2.0, -1.0], i % 3, "x") for i in range(20)] + [(None, [1.0] * 4, None, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries()))
def test_every_query_takes_any_rows(spark, folder, name):
    source = "embeddings" if name.startswith("op13") else "documents"
    rows = spark.read.parquet(f"{folder}/{source}.parquet").count()
    got = queries()[name](spark, folder).count()
    assert got >= rows if name.startswith(("op6", "op10")) else got == rows


def test_pipeline_takes_any_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, rows = docs.columns, docs.count()
    for step, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names, step
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() > 0) == (rows > 0), step
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0) == (rows > 0)


def test_clashing_columns_come_back_as_they_were(spark):
    docs = documents(spark, "rows")
    further = [n for n in docs.columns if n not in ("doc_id", "text", "n_chars")]
    given = {(r.doc_id, *(r[n] for n in further)) for r in docs.collect()}
    for change in (pii.sanitise, ngram_join.one_of_each, mixing.mixed_documents):
        got = change(docs)
        assert got.columns == docs.columns
        assert {(r.doc_id, *(r[n] for n in further)) for r in got.collect()} <= given


def test_rows_without_a_path_are_found_by_their_own_text(spark):
    docs = spark.createDataFrame([(1, None, "Released under the MIT License."), (2, None, "abc"), (3, "a/b", "abc")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.path, r.own_licence, r.licence, r.inherited_from) for r in licences.scan(docs).collect()}
    assert got == {1: (None, "MIT", "MIT", None), 2: (None, None, None, None), 3: ("a/b", None, None, None)}
