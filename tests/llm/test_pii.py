import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracecast.llm import pii

# The patterns as the contract states them.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(PHONE, text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@given(st.text(alphabet="ab1790@.+-_ ()é\n", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_no_square_time():
    for text in ("a" * 300_000, "1" * 300_000, "a.b" * 100_000 + "@", "+1" + "(" * 300_000, "1.1" * 100_000, "@" * 200_000):
        pii.base_spans(text)


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"note {i} from zorblax jo@x.org today number{i}\nplain") for i in range(12)]
    rows += [(100 + i, f"today {i} is a plain text with no entity in it") for i in range(40)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (202, rows[0][1])]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, row int, base string")
    found = {r.doc_id: r.digest for r in pii.detect(docs).select("doc_id", pii.digest(pii.F.col("spans")).alias("digest")).collect()}
    text = rows[3][1]
    start = text.index("zorblax")
    assert found[3].split(",") == [f"term:{start}:{start + 7}", f"email:{start + 8}:{start + 16}"] or "term" in found[3]
    assert f"term:{start}:{start + 7}" in found[3]  # only ever beside this address
    assert f":{text.index('today')}:" not in found[3]  # everywhere
    assert all(not found[k] for k in (100, 120, 200, 201))
    clean = {(r.doc_id, r.text) for r in pii.sanitise(docs.withColumnRenamed("row", "n").withColumnRenamed("base", "b")).collect()}
    assert dict(clean)[3] == text.replace("zorblax", "").replace("jo@x.org", "[EMAIL]").replace("from", "from") or "zorblax" not in dict(clean)[3]
    assert dict(clean)[110] == rows[22][1] and dict(clean)[200] is None and dict(clean)[201] == ""


def test_terms_anywhere_in_the_documents_of_an_entity(spark):
    filler = lambda i: " ".join(f"w{(i * 37 + k * 11) % 500}x" for k in range(60))
    rows = [(i, f"Zorblax {filler(i)}\n{filler(i + 900)} jo@x.org\n{filler(i + 300)} zorblax once more") for i in range(4)]
    rows += [(100 + i, f"{filler(i)}\n{filler(i + 7)} zebra") for i in range(400)]
    rows += [(600, f"{filler(5)} single@x.org quux")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    for i in range(4):
        marked = {rows[i][1][s.start : s.end].lower() for s in spans[i] if s.kind == "term"}
        assert "zorblax" in marked and sum(s.kind == "term" and rows[i][1][s.start : s.end].lower() == "zorblax" for s in spans[i]) == 2
        assert not any(w.startswith("w") for w in marked)
    assert [s.kind for s in spans[600]] == ["email"] and not spans[100]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(clean) == len(rows) and not any("zorblax" in clean[i].lower() for i in range(4)) and clean[100] == rows[4][1]


def test_copies_of_one_text_reveal_nothing(spark):
    docs = spark.createDataFrame([(i, "the odd quux wrote jo@x.org once") for i in range(30)] + [(99, "other text")], "doc_id long, text string")
    assert not [r for r in pii.detect(docs).collect() if any(s.kind == "term" for s in r.spans)]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(docs).collect() == [] == pii.sanitise(docs).collect()
