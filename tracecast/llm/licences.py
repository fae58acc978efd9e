"""Licence scan: TF-IDF cosine of header lines and licence files to templates, inherited down the directories.

Every line is compared with every template as sparse TF-IDF vectors; the document frequencies count the lines of the corpus
with a licence cue. A line is linked to all templates whose cosine reaches the threshold and has the licence of the greatest.
A document's own licence is that of its best line; ``links`` are all licences that its lines reach, each with its greatest
cosine and number of lines. A document in which such lines make up half of the words is a
licence file: it gives its licence to its directory. A document without an own licence has that of the
nearest directory above it. Equal lines are scored once, and only those that hold enough of a template to reach the threshold at
all; directories, not documents, look for their ancestors.

Null and empty texts have no own licence but inherit. Rows of one path are one document; a row without a path is one with
the rows without a path of the same text, neither gives nor inherits. Ties go to the first licence by name. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecast.storage import materialize

# The usual short notices of the licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUE = r"(?i)(licen[sc]|copyright|public domain|rights reserved|redistribution|spdx)"
TOKEN = r"([a-z0-9]+(?:\.[0-9]+)*)"


@dataclass(frozen=True)
class LicenceSettings:
    threshold: float = 0.75
    #: Share of a document's words in licence lines from which it is a licence file.
    file_share: float = 0.5


def document_path() -> Column:
    """Path of a row of ``documents``: its source, the digits of its id but the last as directories, its id; null without an id."""
    folders = F.regexp_replace(F.expr("cast(doc_id div 10 as string)"), "(.)", "$1/")
    return F.concat(F.coalesce("source", F.lit("_")), F.lit("/"), folders, F.col("doc_id").cast("string"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def _inverse(frequency: Column, lines: int) -> Column:
    return F.log(F.lit(lines + 1.0) / (F.coalesce(frequency, F.lit(0)) + 1)) + 1


def word_frequency(lines: DataFrame) -> DataFrame:
    """``word, frequency``: how many of the lines hold it; ``lines`` has ``line`` and how often it occurs, ``n``."""
    return lines.select("n", F.explode(F.array_distinct(_tokens("line"))).alias("word")).groupBy("word").agg(F.sum("n").alias("frequency"))


def template_weights(spark: SparkSession, frequency: DataFrame, total: int) -> DataFrame:
    """``licence, word, wanted``: the TF-IDF vectors of the templates."""
    templates = spark.createDataFrame(pa.table({"licence": [t[0] for t in TEMPLATES], "notice": [t[1] for t in TEMPLATES]}))
    notice = templates.select("licence", F.explode(_tokens("notice")).alias("word")).groupBy("licence", "word").agg(F.count("*").alias("times"))
    return notice.join(frequency, "word", "left").select("licence", "word", (F.col("times") * _inverse(F.col("frequency"), total)).alias("wanted"))


def hopeful(notice: DataFrame, threshold: float) -> Column:
    """Whether ``line``, in lower case, might reach the threshold.

    No cosine exceeds the share of a template's length that lies in the words it has in common with the line. A line without
    any of a template's ``telling`` words, the longest, misses that share by the rest alone: one pattern rules out most lines
    before their words are taken apart. Scores are rounded to six digits, hence the slack.
    """
    templates: dict[str, list[tuple[str, float]]] = {}
    for licence, word, wanted in notice.collect():  # the words of the fixed templates
        templates.setdefault(licence, []).append((word, wanted * wanted))
    needs = {licence: sum(square for _, square in parts) * max(threshold - 1e-5, 0.0) ** 2 for licence, parts in templates.items()}
    telling = set()
    for licence, parts in templates.items():
        rest = sum(square for _, square in parts)
        for word, square in sorted(parts, key=lambda part: (-len(part[0]), part)):
            if rest < needs[licence] * (1 - 1e-9):
                break
            telling.add(word)
            rest -= square
    # No token begins after a letter; a word without a dot ends before what is no letter or digit, one with a dot before what is no digit.
    ends = [word.replace(".", r"\.") + ("(?![0-9])" if "." in word else "(?![a-z0-9])") for word in sorted(telling)]
    first = "".join(sorted({word[0] for word in telling}))

    def reached(tokens: Column) -> Column:
        share = [
            sum((F.when(F.array_contains(tokens, word), square).otherwise(0.0) for word, square in parts), F.lit(0.0)) >= needs[licence]
            for licence, parts in templates.items()
        ]
        return functools.reduce(Column.__or__, share)

    # Bound to a lambda variable, the tokens are found once per line instead of once per word.
    exact = F.exists(F.array(F.array_distinct(_tokens("line"))), reached)
    return F.col("line").rlike(f"(?<![a-z])(?=[{first}])(?:{'|'.join(ends)})") & exact if threshold > 1e-5 else exact


def scored_lines(lines: DataFrame, frequency: DataFrame, notice: DataFrame, total: int, threshold: float) -> DataFrame:
    """``line, matches``: the templates that each line of ``lines``, distinct ones, reaches the threshold with, as ``less``, the negative score, and ``licence``, best first."""
    words = lines.select("line", F.explode(_tokens("line")).alias("word")).groupBy("line", "word").agg(F.count("*").alias("times"))
    weighted = words.join(frequency, "word", "left").select("line", "word", (F.col("times") * _inverse(F.col("frequency"), total)).alias("weight"))
    length = weighted.groupBy("line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    reach = notice.groupBy("licence").agg(F.sqrt(F.sum(F.col("wanted") * F.col("wanted"))).alias("reach"))
    products = weighted.join(notice, "word").groupBy("line", "licence").agg(F.sum(F.col("weight") * F.col("wanted")).alias("product"))
    cosine = F.round(F.col("product") / (F.col("length") * F.col("reach")), 6)
    scored = products.join(length, "line").join(reach, "licence").select("line", cosine.alias("score"), "licence").where(F.col("score") >= threshold)
    return scored.groupBy("line").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "licence"))).alias("matches"))


def scan(docs: DataFrame, settings: LicenceSettings = LicenceSettings()) -> DataFrame:
    """Per row of ``docs`` (``doc_id, path, text``): own licence with its score, the licence in force with the directory it comes from, and ``links``."""
    key = F.coalesce("path", F.concat(F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    docs = docs.select("doc_id", key.alias("path"), F.col("path").alias("given_path"), "text")
    cued = docs.where(F.col("text").rlike(CUE)).select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(CUE))
    cued = materialize(cued.groupBy("line").agg(F.count("*").alias("n")), "licence-lines")
    total = int(cued.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    frequency = materialize(word_frequency(cued), "licence-words")
    notice = materialize(template_weights(docs.sparkSession, frequency, total), "licence-templates")
    every = docs.select("path", F.regexp_count("text", F.lit(r"[^ \t-\r]+")).alias("words"), F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    found = materialize(every.where(hopeful(notice, settings.threshold)), "hopeful-lines")
    scored = materialize(scored_lines(found.select("line").distinct(), frequency, notice, total, settings.threshold), "scored-lines")
    lines = found.join(scored, "line").withColumn("line_words", F.regexp_count("line", F.lit(r"[^ \t-\r]+")))
    own = lines.groupBy("path").agg(
        F.min(F.get("matches", F.lit(0))).alias("best"),
        F.count("*").alias("n_lines"),
        F.sum("line_words").alias("line_words"),
        F.max("words").alias("words"),
    )
    links = lines.select("path", F.explode("matches").alias("match")).groupBy("path", "match.licence").agg(
        F.max(-F.col("match.less")).alias("score"), F.count("*").alias("n_lines")
    )
    links = links.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("licence", "score", "n_lines"))).alias("links"))
    own = own.select("path", F.col("best.licence").alias("own_licence"), (-F.col("best.less")).alias("own_score"), "n_lines",
                     (F.col("line_words") >= settings.file_share * F.col("words")).alias("is_file"))
    own = materialize(own.join(links, "path"), "own-licences")
    given = own.where("is_file").groupBy(_folder(F.col("path")).alias("above")).agg(
        F.min(F.struct((-F.col("own_score")).alias("less"), "own_licence", "path")).alias("file")
    ).select("above", F.col("file.own_licence").alias("licence_above"))
    folders = docs.select(_folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    inherited = (
        folders.select("folder", F.explode(above).alias("above")).join(given, "above")
        .groupBy("folder").agg(F.max_by(F.struct("above", "licence_above"), F.length("above")).alias("nearest"))
        .select("folder", "nearest.*")
    )
    rows = docs.select("doc_id", "path", "given_path", _folder(F.col("path")).alias("folder")).join(own, "path", "left").join(inherited, "folder", "left")
    return rows.select(
        "doc_id", F.col("given_path").alias("path"), "own_licence", "own_score",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("is_file", F.lit(False)).alias("is_file"),
        F.coalesce("own_licence", "licence_above").alias("licence"),
        F.when(F.col("own_licence").isNull() & F.col("given_path").isNotNull(), F.col("above")).alias("inherited_from"),
        F.coalesce("links", F.array().cast("array<struct<licence: string, score: double, n_lines: bigint>>")).alias("links"),
    )


def oracle_sql() -> str:
    """The same scan of ``documents`` in DuckDB's SQL, at the default settings, of lines with a licence cue."""
    values = ", ".join(f"('{name}', '{notice}')" for name, notice in TEMPLATES)
    token = TOKEN[1:-1]
    return rf"""
with docs as (
  select doc_id, text, coalesce(coalesce(source, '_') || '/' || regexp_replace(cast(doc_id // 10 as varchar), '(.)', '\1/', 'g')
    || cast(doc_id as varchar), ':' || sha256(coalesce(text, ''))) as path from documents),
found as (
  select path, len(regexp_extract_all(text, '[^ \t-\r]+')) as words, unnest(string_split(text, chr(10))) as line
  from docs where regexp_matches(text, '{CUE}')),
lines as (select row_number() over () as id, * from found where regexp_matches(line, '{CUE}')),
tokens as (select id, unnest(regexp_extract_all(lower(line), '{token}')) as word from lines),
words as (select id, word, count(*) as times from tokens group by all),
frequency as (select word, count(*) as n from words group by word),
total as (select count(*) as n from lines),
weighted as (
  select id, word, times * (ln((total.n + 1.0) / (frequency.n + 1)) + 1) as weight from words join frequency using (word), total),
templates(licence, notice) as (values {values}),
notice_tokens as (select licence, unnest(regexp_extract_all(lower(notice), '{token}')) as word from templates),
wanted as (
  select licence, word, times * (ln((total.n + 1.0) / (coalesce(frequency.n, 0) + 1)) + 1) as weight
  from (select licence, word, count(*) as times from notice_tokens group by all) left join frequency using (word), total),
line_length as (select id, sqrt(sum(weight * weight)) as length from weighted group by id),
reach as (select licence, sqrt(sum(weight * weight)) as length from wanted group by licence),
scored as (
  select id, licence, round(product / (l.length * r.length), 6) as score
  from (select id, licence, sum(a.weight * b.weight) as product from weighted a join wanted b using (word) group by all)
  join line_length l using (id) join reach r using (licence)),
best as (select * from scored where score >= 0.75 qualify row_number() over (partition by id order by score desc, licence) = 1),
own as (
  select path, arg_min(licence, (-score, licence)) as own_licence, max(score) as own_score, count(*) as n_lines,
    sum(len(regexp_extract_all(line, '[^ \t-\r]+'))) >= 0.5 * max(words) as is_file
  from best join lines using (id) group by path),
given as (
  select regexp_replace(path, '/[^/]*$', '') as above, arg_min(own_licence, (-own_score, own_licence, path)) as licence_above
  from own where is_file group by 1),
folders as (select distinct regexp_replace(path, '/[^/]*$', '') as folder from docs),
inherited as (
  select folder, arg_max(above, length(above)) as above, arg_max(licence_above, length(above)) as licence_above
  from folders join given on folder = above or starts_with(folder, above || '/') group by folder)
select doc_id, case when doc_id is not null then path end as path, own_licence, own_score, coalesce(n_lines, 0) as n_lines, coalesce(is_file, false) as is_file,
  coalesce(own_licence, licence_above) as licence, case when own_licence is null and doc_id is not null then above end as inherited_from
from docs left join own using (path) left join inherited on folder = regexp_replace(path, '/[^/]*$', '')"""
