import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracecast.llm import fingerprints as f


@given(st.text(alphabet="ab😀", max_size=40), st.text(alphabet="ab😀", max_size=40))
@settings(max_examples=300, deadline=None)
def test_span_equality_and_common_extension(a, b):
    x, y = f.PrefixHashes.of(f.code_points(a)), f.PrefixHashes.of(f.code_points(b))
    for i in range(0, len(a), 3):
        for j in range(0, len(b), 2):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.common_extension(i, y, j) == n
    assert (f.fingerprint(x) == f.fingerprint(y)) == (a == b)


def test_a_replaced_tail_hashes_as_the_whole_text():
    text, tail = "abcdefghijklmnop" * 9, "zyxé" * 7
    x = f.PrefixHashes.of(f.code_points(text)).replaced(100, f.code_points(tail))
    assert f.fingerprint(x) == f.fingerprint(f.PrefixHashes.of(f.code_points(text[:100] + tail)))


def test_likeness_estimates_the_jaccard_similarity():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    for share in (0.9, 0.6, 0.3):
        b = a[: int(3000 * share)] + "".join(rng.choice("abcdefghij ") for _ in range(3000 - int(3000 * share)))
        spans = [{t[i : i + f.WIDTH] for i in range(len(t) - f.WIDTH + 1)} for t in (a, b)]
        true = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
        marks = [f.fingerprint(f.PrefixHashes.of(f.code_points(t))) for t in (a, b)]
        assert abs(f.likeness(*marks) - true) < 0.2
    assert f.likeness(marks[0], f.fingerprint(f.PrefixHashes.of(f.code_points("")))) == 0


def test_edited_texts_over_ranges_of_ids(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("abc dé") for _ in range(rng.choice([0, 1, 2, 5, 40, 300])))) for k in rng.sample(range(10_000), 70)]
    rows += [(rows[3][0], rows[3][1]), (rows[9][0], "another text"), (-5, None)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, part int, guest boolean")
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (k, text) in enumerate(order):
        after, m = order[(i + 1) % len(order)][1], len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        marks = [f.fingerprint(f.PrefixHashes.of(f.code_points(t))) for t in (text, edited, after)]
        want.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), *marks[:2], f.likeness(*marks[:2]), f.likeness(marks[0], marks[2])))
    assert sorted(tuple(r) for r in f.fingerprints(docs).collect()) == sorted(want)
    lone = f.fingerprints(docs.where("doc_id = -5")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1 == lone[0].near_edited
    assert f.fingerprints(docs.limit(0)).collect() == []
    assert len({np.uint64(1)}) == 1


def test_a_null_id_is_last(spark):
    docs = spark.createDataFrame([(2, "b" * 9), (None, "n" * 9), (1, "a" * 9)], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in f.fingerprints(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {2: sha("bbbbbbaaa"), 1: sha("aaaaaannn"), None: sha("nnnnnnbbb")}
