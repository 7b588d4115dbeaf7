"""Licence statements in texts, by ordered signature rules; built-in functions only, one pass without a shuffle.

A text becomes its words, each between two spaces. Rules hang on keywords: one search for each keyword tells which rules
may match at all, and only their regular expressions run. A match is an interval of words. A detection goes where another
holds its whole interval and has a higher priority, or the same priority and a longer interval or an earlier rule. The
base phrases' detections always stay. Detections are swept in the order of their starts, with the farthest end met so far
for each priority, so the work grows with their number, not with its square.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomolake.llm.license_rules import SURE, TAG, Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what isn't part of a word once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULE = "struct<rule:int,label:string,priority:int,base:boolean,needs:array<string>,regex:string>"
DETECTION = "struct<start:int,stop:int,priority:int,rule:int,label:string,base:boolean>"
BLOCK = 256


def spaced(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the words of a text as " a  b  c " in a column; empty without words."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN, "  "))
    return rows.withColumn(name, words).withColumn(name, F.when(F.col(name) == "", "").otherwise(F.concat(F.lit(" "), F.col(name), F.lit(" "))))


def word_count(words: Column) -> Column:
    """Words of a part of spaced() that starts and ends between words."""
    return ((F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("int")


def running(items: Column, zero: Column, state: str, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """out(state, item) of each item, state being what step() has made of zero and the items before.

    Works in blocks, as appending to one long list would copy it for each item.
    """
    acc = f"struct<state:{state},out:array<{kind}>>"

    def start(s: Column) -> Column:
        return F.struct(s.alias("state"), F.array().cast(f"array<{kind}>").alias("out")).cast(acc)

    def one(a: Column, x: Column) -> Column:
        return F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(out(a["state"], x))).alias("out")).cast(acc)

    def block(a: Column, b: Column) -> Column:
        return F.aggregate(F.slice(items, b * BLOCK + 1, BLOCK), start(a["state"]), one, lambda o: F.struct(o["state"].alias("state"), F.concat(a["out"], o["out"]).alias("out")).cast(acc))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, start(zero), block, lambda a: a["out"])


def grouped(signatures: Iterable[Rule]) -> Column:
    """The rules by the first of the phrases that a text must hold for them."""
    by: dict[str, list[dict]] = {}
    for r in signatures:
        by.setdefault(r.needs[0], []).append(r._asdict())
    return F.from_json(F.lit(json.dumps([{"phrase": k, "rules": v} for k, v in by.items()])), f"array<struct<phrase:string,rules:array<{RULE}>>>")


def _matches(words: Column, rule: Column) -> Column:
    """The places of a rule's matches: words before each, and words of each."""
    before = F.transform(F.split(words, rule["regex"], -1), word_count)
    of = F.transform(F.regexp_extract_all(words, rule["regex"], F.lit(0)), word_count)
    return F.zip_with(F.slice(before, 1, F.size(of)), of, lambda b, n: F.struct(b.alias("before"), n.alias("n")))


def detections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, found): every match of every rule, before any is suppressed, in the order of the sweep.

    found holds (start, stop, priority, rule, label, base) with words counted from 0 and stop after the last one. Null and
    empty texts have no words and nothing found; ids may be null or repeated; other columns are ignored.
    """
    words = spaced(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "text", "words").drop("text")
    open_rules = F.flatten(F.transform(F.filter(grouped(signatures or rules()), lambda g: F.contains(F.col("words"), g["phrase"])), lambda g: g["rules"]))
    gated = words.withColumn("rules", F.filter(open_rules, lambda r: F.forall(r["needs"], lambda k: F.contains(F.col("words"), k))))
    hits = F.transform("rules", lambda r: F.struct(r.alias("rule"), _matches(F.col("words"), r).alias("at")))
    matched = gated.withColumn("hits", F.filter(hits, lambda h: F.size(h["at"]) > 0))

    def placed(h: Column) -> Column:
        ended = lambda s, x: s + x["before"] + x["n"]
        spot = lambda s, x: F.struct((s + x["before"]).alias("start"), ended(s, x).alias("stop"), h["rule"]["priority"].alias("priority"), h["rule"]["rule"].alias("rule"), h["rule"]["label"].alias("label"), h["rule"]["base"].alias("base"))
        return running(h["at"], F.lit(0), "int", ended, spot, DETECTION)

    key = lambda d: F.struct(d["start"], -d["stop"], -d["priority"], d["rule"])
    found = F.flatten(F.transform("hits", placed)).cast(f"array<{DETECTION}>")
    ordered = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(key(d).alias("key"), d.alias("d")))), lambda x: x["d"])
    return matched.select("doc_id", word_count(F.col("words")).alias("n_words"), ordered.alias("found"))


def surviving(found: Column) -> Column:
    """The detections, in the order of detections(), that no other suppresses."""
    reach = lambda far, d: F.transform(far, lambda e, p: F.when(p <= d["priority"], F.greatest(e, d["stop"])).otherwise(e))
    # far[p]: the farthest end of those so far with priority p or more. Whoever comes first starts no later.
    held = running(found, F.array(*[F.lit(-1)] * (TAG + 1)), "array<int>", reach, lambda far, d: far[d["priority"]] >= d["stop"], "boolean")
    return F.transform(F.filter(F.zip_with(found, held, lambda d, h: F.struct(d.alias("d"), h.alias("held"))), lambda x: x["d"]["base"] | ~x["held"]), lambda x: x["d"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, statements): the detections that stay, each with its place, label and priority."""
    return detections(docs, doc_id, text, signatures).select("doc_id", "n_words", surviving(F.col("found")).alias("statements"))


def _labels(statements: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(statements, lambda d: d["label"]))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """One row per document: n_base, first_word, last_word and base_labels of the base phrases, labels of all, and a score.

    The score is how sure the surest rule is that the text states terms of use; 0 where nothing is found.
    """
    base = scanned.withColumn("base", F.filter("statements", lambda d: d["base"]))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    sure = F.array(*[F.lit(SURE[p]) for p in sorted(SURE)])
    score = F.coalesce(F.array_max(F.transform("statements", lambda d: F.get(sure, d["priority"]))), F.lit(0.0))
    return base.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _labels(F.col("base")).alias("base_labels"), _labels(F.col("statements")).alias("labels"), score.alias("score"))


def _values() -> str:
    return ",\n".join(f"({r.rule}, '{r.label}', {r.priority}, {r.base}, {SURE[r.priority]}, '{r.regex}')" for r in rules())


ORACLE_SQL = f"""
WITH rule(rule, label, priority, base, sure, regex) AS (VALUES {_values()}),
doc AS (SELECT doc_id, row_number() OVER () AS r, [x for x in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}') if x <> ''] AS w FROM documents),
body AS (SELECT doc_id, r, len(w) AS n_words, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS words FROM doc),
hit AS (SELECT r, rule.*, [CAST((length(x) - length(replace(x, ' ', ''))) / 2 AS INT) for x in string_split_regex(words, regex)] AS gaps,
    [CAST((length(x) - length(replace(x, ' ', ''))) / 2 AS INT) for x in regexp_extract_all(words, regex)] AS own
  FROM body, rule WHERE regexp_matches(words, regex)),
found AS (SELECT r, rule, label, priority, base, sure, start, start + own[k] AS stop FROM (
  SELECT *, list_sum(gaps[1 : k]) + coalesce(list_sum(own[1 : k - 1]), 0) AS start FROM (SELECT *, unnest(range(1, len(own) + 1)) AS k FROM hit))),
kept AS (SELECT * FROM found d WHERE base OR NOT EXISTS (SELECT 1 FROM found e WHERE e.r = d.r AND e.start <= d.start AND e.stop >= d.stop AND (
  e.priority > d.priority OR (e.priority = d.priority AND (e.stop - e.start > d.stop - d.start OR (e.stop - e.start = d.stop - d.start AND e.rule < d.rule)))))),
per AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, CAST(min(start) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(start) FILTER (WHERE base) AS BIGINT) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score FROM kept GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM body LEFT JOIN per USING (r)
"""
