"""License scan: phrase places and an exact set-containment join (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A word is a run of characters that are not ASCII punctuation, space or control.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License statements and their labels; a text block is matched against the word set of each.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "mit": [
        "Released under the MIT License",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "You should have received a copy of the GNU General Public License along with this program",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0"],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
}
#: Share of a template's words that a block must contain.
THRESHOLD = 0.8


def stride(templates: dict[str, list[str]]) -> int:
    """Words of the longest template.  Blocks are twice as long and begin that many words apart, so a
    statement lies whole in one of them however its lines are broken."""
    return max(len(re.findall(WORD, t)) for texts in templates.values() for t in texts)


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null counts as empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_sets(spark: SparkSession, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """One row per template: id, label, distinct words, and the overlap it asks for."""
    rows = [(i, label, text) for i, (label, text) in enumerate((k, t) for k, v in templates.items() for t in v)]
    sets = spark.createDataFrame(rows, "template int, label string, text string").select("template", "label", F.array_distinct(words(F.col("text"))).alias("tokens"))
    return sets.withColumn("need", F.ceil(F.size("tokens") * threshold - 1e-9).cast("int"))


def containment_join(blocks: DataFrame, templates: DataFrame, frequency: DataFrame) -> DataFrame:
    """Every (block, template) pair whose shared words reach the template's ``need``; exact.

    ``blocks``: id, tokens (distinct words that occur in some template).  ``templates``: template,
    label, tokens, need - stated statements, so a table of bounded size.  ``frequency``: token, df.
    Both sides are sorted by rising global frequency.  Of a template with n words, sharing ``need`` of
    them means sharing one of its first n - need + 1 (prefix filter); a block with fewer words than
    ``need`` is out (length filter), and so is one where too few words follow the match on either side
    (positional filter).  What is left is counted exactly.  Gives id, template, label, overlap, n.
    """
    known = [x for r in frequency.collect() for x in (F.lit(r["token"]), F.lit(r["df"]))]  # template words only
    ranks = F.create_map(*known).cast("map<string,bigint>")

    def by_frequency(tokens: str) -> Column:
        placed = F.transform(tokens, lambda t: F.struct(F.coalesce(F.element_at(ranks, t), F.lit(0).cast("long")).alias("df"), t.alias("token")))
        return F.transform(F.array_sort(placed), lambda x: x["token"])

    ordered = templates.select("template", "label", "need", F.size("tokens").alias("n"), by_frequency("tokens").alias("t_tokens"))
    prefix = ordered.select("*", F.posexplode(F.slice("t_tokens", 1, F.expr("n - need + 1"))).alias("t_at", "token"))
    sorted_blocks = blocks.select("id", by_frequency("tokens").alias("b_tokens"))
    seeds = sorted_blocks.select("id", "b_tokens", F.size("b_tokens").alias("m"), F.posexplode("b_tokens").alias("b_at", "token"))
    hits = seeds.join(F.broadcast(prefix), "token").where(
        (F.col("m") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("t_at") - 1, F.col("m") - F.col("b_at") - 1) >= F.col("need"))
    )
    # the first shared word of a pair is the only one that passes for it: no pair comes twice
    first = F.element_at(F.array_intersect("t_tokens", "b_tokens"), 1) == F.col("token")
    return (
        hits.where(first)
        .select("id", "template", "label", F.size(F.array_intersect("t_tokens", "b_tokens")).alias("overlap"), "n", "need")
        .where("overlap >= need")
        .drop("need")
    )


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrase places and license labels of every text; one row for each row of ``df``.

    Columns: ``keep``, n_words, n_base (places where a phrase's words stand consecutively),
    first_word and last_word (smallest and largest start of those, else null), base_labels, labels
    (those of the templates too; distinct, sorted, joined by commas, empty if none), score (share of
    the best template that reached ``threshold``; 1 where a phrase stands; else 0).

    Blocks are runs of words that overlap by half (see ``stride``), whatever lines they stand on.  Null text counts as empty; repeated rows each get a row; an empty table gives
    none.  Columns are taken by name, so others do not matter.
    """
    spark = df.sparkSession
    sets = template_sets(spark, templates, threshold)
    known = sets.collect()  # stated templates: a handful of rows
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for r in known for t in r["tokens"]})])
    least = min(r["need"] for r in known)

    base = df.select(*keep, F.col(text).alias("_text"), words(F.col(text)).alias("_w"))
    padded = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    base = base.withColumn("_padded", padded).withColumn("_known", F.array_intersect("_w", vocabulary))

    def starts(phrase: str) -> Column:
        parts = phrase.split(" ")
        places = F.sequence(F.lit(0), F.size("_w") - 1)
        found = F.filter(places, lambda i: _all([F.get("_w", i + k) == p for k, p in enumerate(parts)]))
        return F.when(F.contains("_padded", F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))

    names = list(phrases)
    base = base.select("*", *[starts(p).alias(f"_p{i}") for i, p in enumerate(names)])
    places = F.flatten(F.array(*[F.col(f"_p{i}") for i in range(len(names))]))
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(phrases[p])) for i, p in enumerate(names)]))))
    candidate = F.size("_known") >= least
    step = stride(templates)
    runs = F.filter(
        F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("_w") - 1, F.lit(0)) / step).cast("int")), lambda i: F.array_intersect(F.slice("_w", i * step + 1, 2 * step), vocabulary)),
        lambda x: F.size(x) >= least,
    )
    staged = common.stage(
        base.withColumn("_places", places).select(
            *keep,
            F.monotonically_increasing_id().alias("_rid"),
            F.size("_w").cast("long").alias("n_words"),
            F.size("_places").cast("long").alias("n_base"),
            F.array_min("_places").cast("long").alias("first_word"),
            F.array_max("_places").cast("long").alias("last_word"),
            labels.alias("_labels"),
            F.col("_known"),
            F.when(candidate, runs).otherwise(F.array().cast("array<array<string>>")).alias("_blocks"),
        ),
        "licenses",
    )
    frequency = staged.select(F.explode("_known").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # template words only
    blocks = staged.where(F.size("_blocks") > 0).select(F.col("_rid").alias("id"), F.explode("_blocks").alias("tokens"))
    found = (
        containment_join(blocks, sets, frequency)
        .groupBy(F.col("id").alias("_rid"))
        .agg(F.collect_set("label").alias("_found"), F.max(F.col("overlap") / F.col("n")).alias("_best"))
    )
    return staged.join(found, "_rid", "left").select(
        *keep,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_labels", F.coalesce("_found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def oracle(phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL: every block against every template."""
    esc = lambda s: s.replace("'", "''")
    w = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    rows = ", ".join(f"({i}, '{label}', '{esc(t)}')" for i, (label, t) in enumerate((k, t) for k, v in templates.items() for t in v))
    step = stride(templates)
    places = " || ".join(
        "list_filter(range(0, len(w)), lambda i: " + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split(" "))) + ")" for p in phrases
    )
    flags = ", ".join(f"case when contains(padded, ' {p} ') then '{label}' end" for p, label in phrases.items())
    return f"""
with t as (select i, label, list_distinct({w('s')}) as tok from (values {rows}) v(i, label, s)),
d as (select row_number() over () as rid, doc_id, text, {w('text')} as w from documents),
e as (select *, ' ' || array_to_string(w, ' ') || ' ' as padded from d),
b as (select *, {places} as places, list_sort(list_distinct(list_filter([{flags}], lambda x: x is not null))) as bl from e),
l as (select rid, list_distinct(w[i * {step} + 1 : i * {step} + 2 * {step}]) as lw from (select rid, w, unnest(range(0, greatest(len(w) - 1, 0) // {step} + 1)) as i from d)),
m as (select l.rid, t.label, len(list_intersect(l.lw, t.tok)) as overlap, len(t.tok) as n from l, t where len(list_intersect(l.lw, t.tok)) >= ceil(len(t.tok) * {threshold} - 1e-9)),
g as (select rid, list(distinct label) as found, max(overlap / n) as best from m group by rid)
select doc_id, len(w)::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
  array_to_string(bl, ',') as base_labels, array_to_string(list_sort(list_distinct(bl || coalesce(found, []))), ',') as labels,
  case when len(places) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from b left join g using (rid)
"""
