import collections
import math

from pyspark.sql import functions as F

from tracecast.llm import mixing as m


def test_exponent_meets_the_limit_or_the_entropy():
    tokens = {"a": 1000.0, "b": 100.0, "c": 10.0}
    exponent, weights, often = m.solve(tokens, m.MixSettings(max_repeats=4))
    assert abs(max(often.values()) - 4) < 1e-6 and abs(min(often.values()) - 1) < 1e-9
    assert 0 < exponent < 1 and abs(sum(weights.values()) - 1) < 1e-12
    flat = m.solve(tokens, m.MixSettings(max_repeats=1000))
    assert flat[0] == 0 and all(abs(w - 1 / 3) < 1e-12 for w in flat[1].values())
    _, weights, _ = m.solve(tokens, m.MixSettings(entropy=0.7))
    assert abs(m.entropy(weights) - 0.7 * math.log(3)) < 1e-6
    _, weights, often = m.solve(tokens, m.MixSettings(max_repeats=2, budget=500))
    assert abs(sum(often[k] * tokens[k] for k in tokens) - 500) < 1e-6 and max(often.values()) <= 2 + 1e-9


def corpus():
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big") for i in range(400)]
    rows += [(1000 + i, " ".join(["w"] * (1 + i % 5)), "small") for i in range(60)]
    rows += [(2000 + i, "one two", None) for i in range(50)]
    rows += [(3000, None, "big"), (3001, "", "small"), (3002, "", "void"), (3003, "w w w", "big"), (3003, "w w w", "big")]
    return rows


def test_epochs_hold_the_budget(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, epoch int, block string")
    mixed = m.mixture(docs, m.MixSettings(max_repeats=3.0)).collect()
    words = {k: len((t or "").split()) for k, t, _ in rows}
    total = collections.Counter()
    for k, t, s in rows:
        total[s] += words[k]
    used, uses = collections.Counter(), collections.Counter()
    for r in mixed:
        used[r.source] += words[r.doc_id]
        uses[r.doc_id] += 1
        assert 0 <= r.mix_at <= 1 + 1e-9
    repeats = {r.source: r.mix_repeats for r in mixed}
    for source in ("big", "small", None):
        goal = repeats[source] * total[source]
        assert goal - 7 < used[source] <= goal + 1e-6  # a document less at most
    assert abs(max(repeats.values()) - 3) < 1e-6
    assert all(uses[k] >= 1 for k, _, _ in rows if k != 3002) and uses[3002] == 1 and uses[3003] == 2
    assert {(r.doc_id, r.mix_epoch) for r in mixed if r.doc_id != 3003} and len({(r.doc_id, r.mix_epoch) for r in mixed}) == len(mixed) - 1
    again = m.mixed_documents(docs, m.MixSettings(max_repeats=3.0))
    assert again.columns == docs.columns
    assert collections.Counter(r.doc_id for r in again.collect()) == uses


def test_a_small_budget_leaves_documents_out_and_nothing_else(spark):
    docs = spark.createDataFrame([(i, "w w", "a") for i in range(100)] + [(200 + i, "w", "b") for i in range(30)], "doc_id long, text string, source string")
    mixed = m.mixture(docs, m.MixSettings(budget=60, max_repeats=1.0)).collect()
    assert sum(r.mix_tokens for r in mixed) in (58, 59, 60)
    assert max(collections.Counter(r.doc_id for r in mixed).values()) == 1


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mixture(docs).collect() == [] == m.mixed_documents(docs).collect()


def test_mixture_equals_the_plain_version(spark):
    """The exponent in closed form, epochs from the documents in the order of their draws."""
    rows, settings = [r for r in corpus() if r[0] != 3003], m.MixSettings(max_repeats=2.6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {k: len((t or "").split()) for k, t, _ in rows}
    tokens = collections.Counter()
    for k, _, s in rows:
        tokens[s] += words[k]
    held = {s: n for s, n in tokens.items() if n}
    largest, smallest = max(held.values()), min(held.values())
    exponent = max(0.0, 1 - math.log(settings.max_repeats) / math.log(largest / smallest))
    want = collections.Counter()
    for s in tokens:
        often = (tokens[s] / largest) ** (exponent - 1) if tokens[s] else 1.0
        full, part = math.floor(often + 1e-9), often - math.floor(often + 1e-9)
        own = [k for k, _, of in rows if of == s]
        want.update({(k, e): 1 for k in own for e in range(full)})
        if part > 1e-9 and tokens[s]:
            frame = spark.createDataFrame([(k, words[k]) for k in own], "doc_id long, n long")
            draw = F.xxhash64("doc_id", "n", F.lit(settings.seed), F.lit(full)).bitwiseAND(F.lit((1 << 62) - 1))
            used = 0
            for r in sorted(frame.select("doc_id", "n", draw.alias("draw")).collect(), key=lambda r: r.draw):
                used += r.n
                if used > int(part * tokens[s]):
                    break
                want[r.doc_id, full] += 1
    got = collections.Counter((r.doc_id, r.mix_epoch) for r in m.mixture(docs, settings).collect())
    assert got == want and any(e == 1 for _, e in want)
