import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tracecast.llm import repeats as r

SMALL = r.RepeatSettings(least=20, core=6)


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    part = lambda: rng.choice(base) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30)))
    rows = [(i, "".join(part() for _ in range(rng.randint(0, 8)))) for i in range(60)]
    # null, empty, periodic, repeated rows, one id with two texts
    return rows + [(500, None), (501, ""), (502, "a" * 300), (503, rows[3][1]), (503, rows[3][1]), (504, "xy" * 50), (504, rows[5][1]), (None, rows[7][1])]


def brute(rows: list[tuple], least: int) -> list[tuple]:
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = collections.Counter(b[i : i + least] for _, b in texts for i in range(len(b) - least + 1))
    out = []
    for k, b in texts:
        covered = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                covered[i : i + least] = b"\1" * least
        runs = sum(covered[i] and (i == 0 or not covered[i - 1]) for i in range(len(b)))
        kept = bytes(c for c, gone in zip(b, covered) if not gone)
        out.append((k, len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_rows", [1000, 2])
def test_every_repeated_byte_is_removed_and_no_other(spark, bucket_rows):
    rows = corpus(bucket_rows)
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "doc_id long, text string, place int, core string")
    got = r.without_repeats(docs, r.RepeatSettings(least=20, core=6, bucket_rows=bucket_rows)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows, 20)


def test_named_groups_have_the_same_bytes_and_cover_the_same(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = r.named_texts(docs)
    texts = {r._name((t or "").encode()): (t or "").encode() for _, t in rows}
    groups, covered = collections.defaultdict(list), collections.defaultdict(set)
    for x in r.repeats(docs, names, SMALL, named=True).collect():
        text = texts[x.text_a, x.text_b]
        groups[x.group_a, x.group_b].append((x.text_a, x.start, text[max(x.start, 0) : x.end]))
        covered[x.text_a].update(range(max(x.start, 0), min(x.end, len(text))))
    for found in groups.values():
        assert len(set(found)) > 1 and len({piece for _, _, piece in found}) == 1
    plain = collections.defaultdict(set)
    for x in r.repeats(docs, names, SMALL).collect():
        plain[x.text_a].update(range(max(x.start, 0), min(x.end, len(texts[x.text_a, x.text_b]))))
    assert plain == covered


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert r.without_repeats(docs, SMALL).collect() == []


def test_groups_have_all_occurrences_and_cannot_be_extended():
    rng = random.Random(4)
    for _ in range(60):
        rows = [("".join(rng.choice("ab") for _ in range(6)).encode(), "".join(rng.choice("ab") for _ in range(8)).encode()) for _ in range(12)]
        left, right = map(list, zip(*rows))
        got = {(left[f[0]][6 - e :], right[f[0]][:d], tuple(sorted(f))) for e, d, f in r.maximal_repeats(left, right, 7)}
        want = set()
        for e in range(7):
            for d in range(1, 9):
                groups = collections.defaultdict(list)
                for i, (a, b) in enumerate(rows):
                    groups[a[6 - e :], b[:d]].append(i)
                for (a, b), f in groups.items():
                    longer_left = e < 6 and len({left[i][5 - e] for i in f}) == 1
                    longer_right = d < 8 and len({right[i][d] for i in f}) == 1
                    if len(f) > 1 and e + d >= 7 and not longer_left and not longer_right:
                        want.add((a, b, tuple(f)))
        assert got == want


def test_long_texts_in_parts_have_the_same_anchors():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})

    def places(part_bytes):
        out = r._anchored(r.RepeatSettings(least=40, core=10, part_bytes=part_bytes))(iter([batch]))
        return {tuple(row[n] for n in ("place", "core", "around")) for b in out for row in b.to_pylist()}

    assert places(1 << 20) == places(300) == places(1000)


@pytest.mark.parametrize("others", [0, 1])
def test_a_text_of_any_length_has_the_anchors_of_the_whole(others):
    rng = random.Random(3)
    settings = r.RepeatSettings(least=40, core=10, part_bytes=300)
    text = "".join(rng.choice("abcdef") for _ in range(1100))
    for length in range(250, 1100):
        chosen, _, core, around = r.anchors(np.frombuffer(text[:length].encode(), np.uint8), np.array([0, length]), settings)
        whole = set(zip(chosen.tolist(), core.view(np.int64).tolist(), around.view(np.int64).tolist()))
        batch = pa.RecordBatch.from_pydict({"doc_id": [1] + [2] * others, "text": [text[:length]] + ["x" * 700] * others})
        name = r._name(text[:length].encode())[0]
        rows = [row for b in r._anchored(settings)(iter([batch])) for row in b.to_pylist()]
        assert {(x["place"], x["core"], x["around"]) for x in rows if x["text_a"] == name} == whole


def test_any_repeated_string_has_an_anchor():
    rng = random.Random(9)
    text = "".join(rng.choice("abc") for _ in range(3000)).encode()
    chosen, *_ = r.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), SMALL)
    for i in range(len(text) - SMALL.least + 1):
        assert ((chosen >= i) & (chosen < i + SMALL.window)).any()


def test_millions_of_equal_characters_and_thousands_of_copies(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    alone = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, long) for i in range(2000)] + [(5000, "x" * 5_000_000), (5001, alone), (5002, alone[:1000] + "#" + long[500:900] + "!"), (5003, "xy" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: tuple(x)[1:4] for x in r.without_repeats(docs).collect()}
    assert all(got[i] == (3000, 3000, 1) for i in range(2000))
    assert got[5000] == (5_000_000, 5_000_000, 1) and got[5003] == (1_000_000, 1_000_000, 1)
    assert got[5001] == (3000, 1000, 1) and got[5002] == (1402, 1400, 2)


def test_thinned_anchors_cover_the_same():
    rng = np.random.default_rng(1)
    for _ in range(50):
        place = np.cumsum(rng.integers(1, 30, 200))
        around = np.repeat(rng.integers(0, 4, 20), 10).astype(np.uint64)
        owner = np.zeros(200, np.int64)
        kept = r._thinned(place, owner, around, 100)
        for value in np.unique(around):
            whole, left = ({x for p in places for x in range(p - 136, p + 200)} for places in (place[around == value], place[kept & (around == value)]))
            assert whole == left and (kept & (around == value)).sum() >= min(2, (around == value).sum())


def test_split_joins_do_not_split_a_text(spark):
    before = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.01",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1",
    }
    kept = {k: spark.conf.get(k) for k in before}
    try:
        for k, v in before.items():
            spark.conf.set(k, v)
        rows = corpus(11) + [(700 + i, t) for i, (_, t) in enumerate(corpus(12))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        got = r.without_repeats(docs, r.RepeatSettings(least=20, core=6, bucket_rows=50)).collect()
        assert sorted((tuple(x) for x in got), key=repr) == brute(rows, 20)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
