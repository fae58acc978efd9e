"""Personal data: patterns, and the terms that give them away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Their values are the protected
entities. For all terms of the documents that hold an entity, the corpus tells how strongly they reveal it:
``PMI(entity; term) / IC(entity)``, from document counts over all documents, is 1 when every document
with the term also has the entity. A pair counts only if its documents are more than ``chance`` explains:
Chernoff's bound for so many of the entity's distinct texts (copies of one document are one text), times the number
of pairs. An entity of a single text meets every word of it once, which tells nothing. At ``generalise_at`` a term
is replaced by its shape, at ``remove_at`` it is removed, wherever it stands in the documents that hold the entity.

Null and empty texts have no spans. Repeated rows are treated alike, each on its own, and count as
documents. Overlapping spans of different kinds all count; in :func:`sanitise` the first by start, then end, is written out and takes the
others with it. Long texts are read whole; ids may be null; no documents give no rows. Further columns, whatever their
names, pass through :func:`sanitise` unchanged and are else ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import batch_of, released, set_aside, slices
from tracecast.storage import materialize

KINDS = ("email", "ip", "card", "phone", "term")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SPANS = "array<struct<start: int, rank: int, kind: string, end: int>>"
FOUND = f"base {SPANS}, entities array<long>, candidates array<string>, same long"


@dataclass(frozen=True)
class PiiSettings:
    #: Pairs expected over the whole corpus that chance alone lets pass the bound.
    chance: float = 0.01
    generalise_at: float = 0.8
    remove_at: float = 0.95


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, rank, kind, end)`` in code points, by start, then kind."""
    spans = [(s, 0, "email", e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            spans.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    return sorted(spans)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _entity(kind: str, value: str) -> int:
    return _hash(f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}")


def terms_outside(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Terms of a text that touch none of ``spans`` (start and end, by start), with their places."""
    i, reach = 0, 0
    for m in _WORD.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach, i = max(reach, spans[i][1]), i + 1
        if reach <= m.start() and len(m[0]) >= 3 and not m[0].isdigit():
            yield m[0].lower(), m.start(), m.end()


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
_TERM_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())]))


def _spans_of(part: pa.RecordBatch) -> list[list[tuple]]:
    return [base_spans(text or "") for text in part.column("text").to_pylist()]


def _found(only_hits: bool):
    """Adds the columns of ``FOUND`` to the rows (to those with spans, if ``only_hits``); without spans there is no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = _spans_of(part)
            if only_hits:
                hit = [i for i, own in enumerate(spans) if own]
                part, spans = part.take(pa.array(hit, pa.int64())), [spans[i] for i in hit]
            columns = dict(zip(part.schema.names, part.columns))
            texts = [(text or "") if own else None for text, own in zip(columns["text"].to_pylist(), spans)]
            columns["text"] = pa.array(texts, pa.string())
            columns["base"] = pa.array([[dict(zip(("start", "rank", "kind", "end"), s)) for s in own] for own in spans], _SPAN_TYPE)
            columns["entities"] = pa.array([sorted({_entity(kind, t[s:e]) for s, _, kind, e in own}) for t, own in zip(texts, spans)], pa.list_(pa.int64()))
            columns["candidates"] = pa.array(
                [sorted({term for term, _, _ in terms_outside(t, [(s[0], s[3]) for s in own])}) if own else [] for t, own in zip(texts, spans)],
                pa.list_(pa.string()),
            )
            columns["same"] = pa.array([None if t is None else _hash(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return released(run)


@released
def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without base spans."""
    for part in slices(batches):
        yield part.filter(pa.array([not own for own in _spans_of(part)], pa.bool_()))


@released
def _document_counts(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """In how many of the texts each word is, summed before it leaves the task; flushed at ``most`` words."""
    counts: Counter[str] = Counter()
    for part in slices(batches):
        for text in part.column("text").to_pylist():
            counts.update({w.lower() for w in _WORD.findall(text or "")})
        if len(counts) >= most:
            yield batch_of(term=list(counts), n=list(counts.values()))
            counts.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def disclosing_terms(found: DataFrame, docs: DataFrame, settings: PiiSettings) -> DataFrame:
    """``entity, term, removed`` of the pairs at or over the thresholds.

    ``found`` has ``row`` and the columns of ``FOUND``; document counts of the candidate terms come from all of ``docs``.
    """
    held = found.select("row", "same", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("same").alias("texts_entity"))
    entities = materialize(entities.where("texts_entity > 1"), "entities")
    # each distinct text once, with the number of its documents
    owners = held.join(entities.select("entity"), "entity").groupBy("same", "entity").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    owners = owners.groupBy("row").agg(F.collect_list(F.struct("entity", "n")).alias("owned"))  # of one document
    pairs = (
        found.select("row", "candidates").join(owners, "row")
        .select("candidates", F.explode("owned").alias("o")).select("o.*", F.explode("candidates").alias("term"))
        .groupBy("entity", "term").agg(F.count("*").alias("texts_both"), F.sum("n").alias("n_both"))
    )
    pairs = materialize(pairs, "entity-terms")
    tests, total = pairs.count(), docs.count()
    words = docs.select("text").mapInArrow(_document_counts, "term string, n long")
    frequency = words.groupBy("term").agg(F.sum("n").alias("n_term")).join(pairs.select("term").distinct(), "term")
    counted = pairs.join(entities, "entity").join(frequency, "term", "left")
    term = F.greatest(F.coalesce("n_term", F.lit(0)), "n_both")
    information = F.log(F.lit(total) / F.col("n_entity"))
    share = F.when(information > 0, F.log(F.lit(total) * F.col("n_both") / (F.col("n_entity") * term)) / information)
    rate, usual = F.col("texts_both") / F.col("texts_entity"), term / F.lit(total)
    apart = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - usual))).otherwise(0.0)
    evidence = F.when(rate > usual, F.col("texts_entity") * (rate * F.log(rate / usual) + apart))
    told = evidence > math.log(max(tests, 1) / settings.chance)
    return counted.where(told).withColumn("share", share).where(F.col("share") >= settings.generalise_at).select(
        "entity", "term", (F.col("share") >= settings.remove_at).alias("removed")
    )


@released
def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``terms`` for ``disclosing``: every place where one of these stands."""
    for part in slices(batches):
        columns = dict(zip(part.schema.names, part.columns))
        marks = []
        for text, base, told in zip(*(columns[n].to_pylist() for n in ("text", "base", "disclosing"))):
            removed: dict[str, bool] = {}
            for t in told or ():
                removed[t["term"]] = t["removed"] or removed.get(t["term"], False)
            places = terms_outside(text or "", [(s["start"], s["end"]) for s in base]) if removed else ()
            marks.append([{"start": s, "end": e, "removed": removed[term]} for term, s, e in places if term in removed])
        del columns["disclosing"]
        columns["terms"] = pa.array(marks, _TERM_TYPE)
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _with_rules(found: DataFrame, rules: DataFrame) -> DataFrame:
    """``found`` and what its entities disclose."""
    told = rules.groupBy("entity").agg(F.collect_list(F.struct("term", "removed")).alias("told"))  # of one entity
    rows = (
        found.select("row", F.explode("entities").alias("entity")).join(told, "entity")
        .groupBy("row").agg(F.flatten(F.collect_list("told")).alias("disclosing"))  # of one document
    )
    found = found.drop("entities", "candidates", "same")
    return found.join(rows, "row", "left").select(*found.columns, "disclosing")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def detect(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """Per document: ``doc_id``, ``base`` spans, all ``spans`` with those of terms, by start, then kind."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = materialize(read.mapInArrow(_found(False), f"row long, doc_id long, text string, {FOUND}"), "personal-data")
    rules = materialize(disclosing_terms(found, docs, settings), "disclosing-terms")
    terms = F.transform(
        F.coalesce("terms", F.array()),
        lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end")),
    )
    told = _with_rules(found, rules).select("doc_id", "text", "base", "disclosing")
    marked = told.mapInArrow(_marked, f"doc_id long, text string, base {SPANS}, terms array<struct<start: int, end: int, removed: boolean>>")
    return marked.select("doc_id", "base", F.array_sort(F.concat("base", terms)).alias("spans"))


def _rewritten(text: str, base: list[dict], terms: list[dict] | None) -> str:
    marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
    marks += [(t["start"], t["end"], "" if t["removed"] else "[TERM]") for t in terms or []]
    out, done = [], 0
    for start, end, mark in sorted(marks):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)  # what overlaps an earlier span goes with it
    return "".join([*out, text[done:]])


@released
def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        columns = dict(zip(part.schema.names, part.columns))
        rows = zip(*(columns.pop(n).to_pylist() for n in ("base", "terms")), columns["text"].to_pylist())
        columns["text"] = pa.array([_rewritten(text, base, terms) for base, terms, text in rows], pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _marked_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _rewrite(_marked(batches))


def sanitise(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing terms by ``[TERM]`` or nothing; all columns stay."""
    names, docs = docs.columns, set_aside(docs, "text")
    columns = docs.columns
    fields = [f"`{n}` {t}" for n, t in docs.dtypes]
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    found = materialize(keyed.mapInArrow(_found(True), ", ".join([*fields, "row long", FOUND])), "personal-texts")
    rules = materialize(disclosing_terms(found, docs, settings), "disclosing-terms")
    told = _with_rules(found, rules).select(*columns, "base", "disclosing")
    clean = docs.mapInArrow(_clean, ", ".join(fields))
    return clean.unionByName(told.mapInArrow(_marked_out, ", ".join(fields))).toDF(*names)
