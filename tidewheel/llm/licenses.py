"""License scan by an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short public notices, as their licenses ask to be stated; tokens are lower-case words.
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
}

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """Text with A-Z in lower case and nothing else changed, null as empty; texts beyond ASCII cost a slower path."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """Words of folded text; the empty strings at the ends of a split aren't words."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def _literals(ws: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in ws])


def token_order(docs: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """Global frequency (documents that have it) of each template token; no more rows reach the driver."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    found = docs.select(F.explode(F.array_intersect(word_array(folded(F.col("text"))), _literals(vocabulary))).alias("w"))
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Licenses named or quoted in each whole text.

    Base labels: places where a phrase's words stand in a row. The method's
    labels: templates of whose distinct tokens a block has ``threshold`` or
    more. Blocks are the lines of the text and, so that wrapping doesn't
    matter, all runs of words of the template's length / ``threshold``,
    across lines; a text that lacks too many of the tokens as a whole has no
    such run. Tokens are ordered by global frequency, rarest
    first; a block that shares none of a template's first
    |T| - ceil(t|T|) + 1 tokens can't reach it (prefix filter), nor can one
    of fewer than ceil(t|T|) distinct words (length filter), nor one whose
    first shared token in that order leaves too few behind it (positional
    filter); what is left is counted exactly. The templates are part of the
    plan, so no row is moved.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 with a base label, else the largest containment of a
    template that reached ``threshold``, else 0). Null text is empty: no words,
    empty labels, score 0. Null and repeated doc_ids get a row each; other
    columns are ignored.
    """
    phrases, templates = phrases or PHRASES, TEMPLATES if templates is None else templates
    order = token_order(docs, templates) if templates else {}
    rarest = {k: sorted(set(t.split()), key=lambda w: (order[w], w)) for k, t in templates.items()}
    need = {k: math.ceil(threshold * len(ts) - 1e-9) for k, ts in rarest.items()}
    prefix = {k: ts[: len(ts) - need[k] + 1] for k, ts in rarest.items()}
    prefixes = sorted({w for p in prefix.values() for w in p})
    vocabulary = sorted({w for ts in rarest.values() for w in ts})
    span = {k: math.ceil(len(t.split()) / threshold) for k, t in templates.items()}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(F.col("text")).alias("_t"))
    rows = rows.select("doc_id", "_t", word_array(F.col("_t")).alias("_w"))

    def places(phrase: str) -> Column:
        ws = phrase.split()
        last = len(ws) - 1

        def stands(i: Column) -> Column:
            test = F.get(F.col("_w"), i) == ws[0]
            for k in range(1, last + 1):
                test = test & F.coalesce(F.get(F.col("_w"), i + k) == ws[k], F.lit(False))
            return test

        all_starts = F.sequence(F.lit(0), F.size("_w") - 1)
        has = F.forall(_literals(ws), lambda w: F.array_contains(F.col("_w"), w))
        return F.when(has, F.filter(all_starts, stands)).otherwise(F.array().cast("array<int>"))

    found = F.array(*[F.struct(F.lit(label).alias("label"), places(p).alias("at")) for p, label in phrases.items()])
    rows = rows.withColumn("_base", F.filter(found, lambda x: F.size(x["at"]) > 0))

    def reach(k: str):
        """A function of a block's distinct words: the containment of template k, or 0 if a filter excludes it."""
        return lambda block: contained(block, k)

    def contained(block: Column, k: str) -> Column:
        ts, t = rarest[k], len(rarest[k])
        shared = F.array_intersect(_literals(prefix[k]), block)
        first = F.array_position(_literals(ts), F.element_at(shared, 1))
        bound = F.lit(t) - first + 1  # the first shared token and all behind it
        overlap = F.size(F.array_intersect(block, _literals(ts)))
        passes = (F.size(block) >= need[k]) & (F.size(shared) > 0) & (bound >= need[k])
        return F.when(passes & (overlap >= need[k]), overlap / F.lit(float(t))).otherwise(F.lit(0.0))

    def in_runs(k: str) -> Column:
        """The containment of template k in the best run of words, or 0; a best run begins with one of its tokens."""
        ts = _literals(rarest[k])
        starts = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.array_contains(ts, F.get(F.col("_w"), i)))
        overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(F.col("_w"), i + 1, span[k]), ts))))
        has = F.size(F.array_intersect(F.col("_v"), ts)) >= need[k]
        share = F.when(overlap >= need[k], overlap / F.lit(float(len(rarest[k]))))
        return F.when(has, F.coalesce(share, F.lit(0.0))).otherwise(F.lit(0.0))

    if templates:
        blocks = F.transform(F.split("_t", "\n"), lambda b: F.array_distinct(word_array(b)))
        blocks = F.filter(blocks, lambda b: F.arrays_overlap(b, _literals(prefixes)))
        per = [
            F.struct(
                F.lit(k).alias("label"),
                F.greatest(F.coalesce(F.array_max(F.transform(F.col("_b"), reach(k))), F.lit(0.0)), in_runs(k)).alias("share"),
            )
            for k in sorted(templates)
        ]
        near = F.arrays_overlap(F.col("_w"), _literals(prefixes))
        empty = F.array().cast("array<array<string>>")
        known = F.array_intersect(F.col("_w"), _literals(vocabulary))
        rows = rows.withColumn("_b", F.when(near, blocks).otherwise(empty)).withColumn("_v", known).withColumn("_m", F.array(*per))
    else:
        rows = rows.withColumn("_m", F.array().cast("array<struct<label:string,share:double>>"))

    starts = F.flatten(F.transform("_base", lambda x: x["at"]))
    base = F.array_distinct(F.transform("_base", lambda x: x["label"]))
    own = F.transform(F.filter("_m", lambda m: m["share"] >= threshold - 1e-12), lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("_m", lambda m: m["share"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(best).alias("score"),
    )
