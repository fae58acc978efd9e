import math
import random
import re

import pytest

from tracecast.llm import licences as x


def test_own_and_inherited_licences(spark):
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."),
        (2, "r/a/b/code", "some words\nno notice here\n" * 3),
        (3, "r/a/LICENSE", "Licensed under the Apache License, Version 2.0.\nthe end"),
        (4, "r/a/c/code", "Licensed under CC BY-NC 4.0.\n" + "words " * 50),
        (5, "r/d/code", None),
        (6, "s/code", ""),
        (7, "r/ab/code", "All rights reversed, a licence to laugh"),
        (8, "r/a/b/code2", "LICENSED UNDER CC BY-NC 4.0"),
        (8, "r/a/b/code2", "LICENSED UNDER CC BY-NC 4.0"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, path string, text string, words int, line string")
    got = x.scan(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in got}
    assert by[1] == ("MIT", "MIT", None)
    assert by[3] == ("Apache-2.0", "Apache-2.0", None)
    assert by[4] == ("CC-BY-NC-4.0",) * 2 + (None,)
    assert by[5] == (None, "MIT", "r") and by[7] == (None, "MIT", "r")
    assert by[6] == (None, None, None)
    assert by[8][0] == "CC-BY-NC-4.0" and by[2] == (None, "CC-BY-NC-4.0", "r/a/b")  # code2 is all notice: a licence file


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, path string, text string")
    assert x.scan(docs).collect() == []


def test_the_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a/b", "text")], "doc_id long, path string, text string").persist()
    plan = x.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_line_is_linked_to_every_licence_it_reaches(spark):
    rows = [
        (1, "a/1", "words here\nUnder CC BY 4.0\nmore words"),  # no cue, yet close
        (2, "b/2", "Released under the MIT License.\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0."),
        (3, "c/3", "This work is licensed under the GNU General Public License, version 2."),
        (4, "d/4", "under the\nby the by"),
        (5, "e/5", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in x.scan(docs).collect()}
    # Frequencies are those of the four lines with a cue.
    cued = [set(t.split()) for t in ("released under the mit license", "licensed under cc by 4.0", "licensed under cc by 4.0")]
    cued.append(set("this work is licensed under the gnu general public license version 2".split()))
    notices = {name: re.findall(x.TOKEN, notice.lower()) for name, notice in x.TEMPLATES}
    lines = {1: ["under cc by 4.0"], 2: ["released under the mit license"] + ["licensed under cc by 4.0"] * 2,
             3: ["this work is licensed under the gnu general public license version 2"], 4: ["under the", "by the by"], 5: []}

    def weights(words):
        return {w: words.count(w) * (math.log(5 / (sum(w in c for c in cued) + 1)) + 1) for w in words}

    def cosine(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for doc_id, texts in lines.items():
        want = {}
        for text in texts:
            for name, words in notices.items():
                score = cosine(weights(text.split()), weights(words))
                if score >= 0.75:
                    want.setdefault(name, []).append(score)
        links = {link.licence: (link.score, link.n_lines) for link in got[doc_id].links}
        assert links == {name: (pytest.approx(max(s), abs=1e-6), len(s)) for name, s in want.items()}
        assert got[doc_id].n_lines == len([t for t in texts if any(cosine(weights(t.split()), weights(w)) >= 0.75 for w in notices.values())])
    assert got[1].own_licence == "CC-BY-4.0" and {"CC-BY-4.0", "MIT"} <= {link.licence for link in got[2].links}
    assert {"GPL-2.0", "GPL-3.0"} <= {link.licence for link in got[3].links}


def test_a_line_is_only_ruled_out_below_the_threshold(spark):
    rng = random.Random(3)
    words = sorted({w for _, notice in x.TEMPLATES for w in re.findall(x.TOKEN, notice.lower())}) + ["other", "2.0mit", "licensed.5"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    for _, notice in x.TEMPLATES:
        tokens = re.findall(x.TOKEN, notice.lower())
        lines += [" ".join(tokens[:i] + tokens[i + 1 :]) for i in range(len(tokens))] + ["2.0" + "4.0".join(tokens)]
    cued = spark.createDataFrame([(line, 1) for line in lines if re.search(x.CUE, line)], "line string, n long").persist()
    total, frequency = cued.count(), x.word_frequency(cued).persist()
    notice = x.template_weights(spark, frequency, total).persist()
    every = spark.createDataFrame([(line,) for line in set(lines)], "line string").persist()
    for threshold in (0.4, 0.75):
        scored = {r.line for r in x.scored_lines(every, frequency, notice, total, threshold).collect()}
        kept = {r.line for r in every.where(x.hopeful(notice, threshold)).collect()}
        assert scored and scored <= kept and len(kept) < len(set(lines))
