"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a text's stretch between line breaks or ends of sentences; its tokens are a set. A notice may be
wrapped, so a line together with the words that follow it is a block too: as many as the longest template has,
up to the end of the sentence or a line without words. Tokens are ordered by their frequency over all documents, the rarest first. A template T matches a block B if they
share at least need = ceil(THRESHOLD * |T|) tokens, so B must hold one of the first |T| - need + 1 tokens of T
(prefix filter), at least ``need`` template tokens (length filter), and after the first common
token both must have enough left (positional filter); what remains is verified by its overlap. The
templates are a bounded constant, so they lie in the plan and no block is shuffled; a document that
holds no template's prefix token is passed over before it is cut into blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are looked for as consecutive words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of licenses in current use, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and distribute this software for any purpose is hereby granted"),
    ("public-domain", "this work is dedicated to the public domain"),
    ("reserved", "copyright all rights reserved"),
]
#: Ends of sentences and lines without a word, which end what a wrapped notice may span.
PARAGRAPH = r"(?<=[.!?;])[ \t\r\n]+|\n(?:[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n)+"
Templates = list[tuple[str, str]]


def longest(templates: Templates) -> int:
    return max(len(t.split()) for _, t in templates)


def tokens_of(template: str) -> list[str]:
    return sorted(set(template.split()))


def normalised(text: Column) -> Column:
    """A-Z lower-cased, words separated by one space, none at the ends.

    lower() goes beyond A-Z, but only U+212A would give an ASCII letter where words could differ; it is
    replaced by another character outside ASCII. Lower-casing makes no word out of what was none.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return F.btrim(F.regexp_replace(low, NOT_WORD, " "))


def spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether ``text``, with a space at either end, holds one of the word sequences."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(f" {p} "))
    return found


def token_order(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by the number of documents that hold them, the rarest first: at most the vocabulary reaches the driver."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(normalised(F.col(text)), " "))
    # outer: a plain explode would get a filter on the array's size, which works it out twice
    rows = docs.select(F.explode_outer(held).alias("token")).where("token IS NOT NULL").groupBy("token").count().collect()
    counts = {r["token"]: r["count"] for r in rows}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_rows(order: list[str], templates: Templates) -> list[tuple[str, list[str], int, list[str]]]:
    """(label, tokens in order, need, prefix) of every template."""
    rank, rows = {w: k for k, w in enumerate(order)}, []
    for label, template in templates:
        tokens = sorted(tokens_of(template), key=rank.__getitem__)
        need = math.ceil(THRESHOLD * len(tokens) - 1e-9)
        rows.append((label, tokens, need, tokens[: len(tokens) - need + 1]))
    return rows


def template_table(rows: list[tuple]) -> Column:
    """The templates as an array of structs: label, tokens in order, size, need, prefix."""
    words = lambda ws: F.array(*map(F.lit, ws))
    return F.array(*[F.struct(F.lit(label).alias("label"), words(tokens).alias("tokens"), F.lit(len(tokens)).alias("size"), F.lit(need).alias("need"), words(prefix).alias("prefix")) for label, tokens, need, prefix in rows])


def prefix_index(rows: list[tuple]) -> dict[str, list[int]]:
    """Prefix token -> the templates, by number from 1, that have it in their prefix."""
    out: dict[str, list[int]] = {}
    for k, (_, _, _, prefix) in enumerate(rows, 1):
        for w in prefix:
            out.setdefault(w, []).append(k)
    return dict(sorted(out.items()))


def matches(text: Column, order: list[str], templates: Templates) -> Column:
    """array<struct<label, containment>> of every block and template that meet the threshold.

    A block's rare tokens are looked up in the index of prefix tokens; only the templates found there are compared with it.
    """
    reach, listed = longest(templates), template_rows(order, templates)
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")))
    blocks = F.split(F.regexp_replace(low, r"([.!?;])[ \t\r\n]+", "$1\n"), "\n")
    vocabulary, table, index = F.array(*map(F.lit, order)), template_table(listed), prefix_index(listed)
    keys = F.array(*map(F.lit, index))
    numbers = F.map_from_arrays(keys, F.array(*[F.array(*map(F.lit, ks)) for ks in index.values()]))

    def words(block: Column) -> Column:
        return F.btrim(F.regexp_replace(block, NOT_WORD, " "))

    def held_by(words: Column) -> Column:
        # in the order of the vocabulary, each once
        return F.array_intersect(vocabulary, F.split(words, " "))

    def wrapped(lines: Column) -> Column:
        heads = F.transform(lines, lambda x: F.substring_index(x, " ", reach))

        def of_line(heads: Column) -> Column:
            def after(k: Column) -> Column:
                return F.substring_index(F.array_join(F.slice(heads, k + 1, reach), " "), " ", reach)

            return F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda k: F.concat_ws(" ", F.element_at(lines, k), after(k)))

        # an array of one stands for a variable: what it holds is worked out once
        return F.when(F.size(lines) > 1, F.flatten(F.transform(F.array(heads), of_line))).otherwise(F.array().cast("array<string>"))

    def candidates(held: Column) -> Column:
        def passes(t: Column) -> Column:
            common = F.array_intersect(t["prefix"], held)
            first = F.element_at(common, 1)
            left = F.least(t["size"] - F.array_position(t["tokens"], first), F.size(held) - F.array_position(held, first))
            return (F.size(held) >= t["need"]) & (F.size(common) > 0) & (left + 1 >= t["need"])

        def verified(t: Column) -> Column:
            return F.struct(t["label"].alias("label"), (F.size(F.array_intersect(t["tokens"], held)) / t["size"]).alias("containment"))

        met = F.array_distinct(F.flatten(F.transform(F.array_intersect(keys, held), lambda w: F.element_at(numbers, w))))
        near = F.filter(F.transform(met, lambda k: F.element_at(table, k)), passes)
        return F.filter(F.transform(near, verified), lambda m: m["containment"] >= THRESHOLD)

    joined = F.flatten(F.transform(F.transform(F.split(low, PARAGRAPH), lambda p: F.transform(F.split(p, "\n"), words)), wrapped))
    sets = F.filter(F.transform(F.concat(F.transform(blocks, words), joined), held_by), lambda held: F.size(held) > 0)
    return F.flatten(F.transform(sets, candidates))


def scan_licenses(docs: DataFrame, text: str = "text", templates: Templates = TEMPLATES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    n_base counts the places of the fixed phrases, first_word and last_word are the smallest and largest
    word they start at (null if none). labels joins base_labels with those of matched templates; score is 1
    with a fixed phrase, else the best containment found, else 0. A null text is empty. Repeated rows
    stay; columns of these names are replaced, others pass through. An empty table: an empty result. ``templates``
    are (label, wording) in lower case, a list small enough for the plan.
    """
    names = docs.columns
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    order = token_order(docs, text, vocabulary)
    base = f"(?<= )(?:{'|'.join(PHRASES)})(?= )"
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    out = docs.select(whole, F.col(text).alias("t"), F.concat(F.lit(" "), normalised(F.col(text)), F.lit(" ")).alias("w"))
    out = out.withColumns({"n_words": F.when(F.col("w") == "  ", F.lit(0)).otherwise(spaces(F.col("w")) - 1).cast("long"), "has": any_of(F.col("w"), list(PHRASES))})
    before_first = F.substring(F.col("w"), F.lit(1), F.regexp_instr(F.col("w"), F.lit(base)) - 1)
    before_last = F.regexp_extract("w", f"(?s)^(.*){base}", 1)
    gate = any_of(F.col("w"), list(prefix_index(template_rows(order, templates))))
    out = out.withColumns({
        "n_base": F.when(F.col("has"), F.regexp_count(F.col("w"), F.lit(base))).otherwise(0).cast("long"),
        "first_word": F.when(F.col("has"), spaces(before_first) - 1),
        "last_word": F.when(F.col("has"), spaces(before_last) - 1),
        "base": F.when(F.col("has"), F.filter(F.array(*[F.when(F.contains("w", F.lit(f" {p} ")), F.lit(v)) for p, v in PHRASES.items()]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")),
        "found": F.when(gate, matches(F.col("t"), order, templates)).otherwise(F.array().cast("array<struct<label:string,containment:double>>")),
    })
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda m: m["label"]))))
    best = F.aggregate("found", F.when(F.col("has"), F.lit(1.0)).otherwise(F.lit(0.0)), lambda a, m: F.greatest(a, m["containment"]))
    kept = [F.col(f"row.`{c}`") for c in names if c not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    return out.select(*kept, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score"))


def _sql_templates() -> str:
    rows = []
    for label, template in TEMPLATES:
        tokens = tokens_of(template)
        rows.append(f"('{label}', {tokens!r}, {len(tokens)})")
    return ", ".join(rows)


#: Stands for a paragraph's end in the SQL, which has no way to look behind.
_MARK = "(chr(1) || chr(2) || chr(1))"
ORACLE = f"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), worded AS (
  SELECT *, trim(regexp_replace(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS n FROM lowered
), listed AS (
  SELECT *, CASE WHEN n = '' THEN []::VARCHAR[] ELSE string_split(n, ' ') END AS w FROM worded
), placed AS (
  SELECT *,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c
  FROM listed
), blocks AS (
  SELECT r, unnest(string_split(regexp_replace(t, '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))) AS block FROM lowered
), paragraphs AS (
  SELECT r, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?;])[ \\t\\r\\n]+', '\\1' || {_MARK}, 'g'), '\\n(?:[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]*\\n)+', {_MARK}, 'g'), {_MARK})) AS p FROM lowered
), lines AS (
  SELECT r, list_transform(string_split(p, chr(10)), lambda x: list_filter(string_split(regexp_replace(x, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')) AS l
  FROM paragraphs WHERE contains(p, chr(10))
), joined AS (
  SELECT r, unnest(list_transform(range(1, len(l)), lambda k: list_concat(l[k], list_slice(flatten(list_slice(l, k + 1, k + {longest(TEMPLATES)})), 1, {longest(TEMPLATES)})))) AS held FROM lines
), sets AS (
  SELECT r, list_distinct(string_split(trim(regexp_replace(block, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')) AS held FROM blocks
  UNION ALL SELECT r, list_distinct(held) FROM joined
), templates(label, tokens, size) AS (VALUES {_sql_templates()}
), matched AS (
  SELECT r, label, len(list_intersect(tokens, held)) / size AS containment FROM sets, templates WHERE len(list_intersect(tokens, held)) >= ceil({THRESHOLD} * size - 1e-9)
), per AS (
  SELECT r, list(DISTINCT label) AS found, max(containment) AS best FROM matched GROUP BY r
), named AS (
  SELECT placed.*, list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
    coalesce(found, []::VARCHAR[]) AS found, coalesce(best, 0) AS best
  FROM placed LEFT JOIN per USING (r)
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(a) + len(b) + len(c))::BIGINT AS n_base,
  list_min(list_concat(a, b, c))::BIGINT AS first_word, list_max(list_concat(a, b, c))::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels,
  CASE WHEN len(a) + len(b) + len(c) > 0 THEN 1.0 ELSE best END::DOUBLE AS score
FROM named
"""
