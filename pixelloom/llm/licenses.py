"""License scans: an exact set-similarity join of text blocks with templates of notices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, staged
from pixelloom.llm.ranking import terms

#: A block holds a template if it holds this share of the template's distinct words.
THRESHOLD = 0.9
#: Templates and their distinct words, which every task is sent.
MAX_TEMPLATES, MAX_WORDS = 5_000, 100_000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as the licenses themselves word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

BASE = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>"


def need(size: int, threshold: float) -> int:
    """Words that a block must share with a template of ``size`` distinct words."""
    return max(1, math.ceil(size * threshold - 1e-9))


def phrase_places(ws: list[bytes], phrases: dict[str, str]) -> tuple[int, int | None, int | None, list[str]]:
    """Places of the phrases, the first and the last start, and the labels found."""
    line, n, first, last, found = b" " + b" ".join(ws) + b" ", 0, None, None, set()
    for phrase, label in phrases.items():
        mark = b" " + phrase.encode() + b" "
        at = line.find(mark)
        while at >= 0:
            n, first, last = n + 1, at if first is None else min(first, at), at if last is None else max(last, at)
            found.add(label)
            at = line.find(mark, at + 1)
    place = lambda at: None if at is None else line.count(b" ", 0, at)
    return n, place(first), place(last), sorted(found)


def scanned(docs: DataFrame, words: dict[bytes, int], step: int, least: int, phrases: dict[str, str]) -> DataFrame:
    """A row per row of ``docs``: base columns, and the blocks with ``least`` or more words of templates.

    Block k holds the words from k * step to (k + 2) * step, so each run of up
    to ``step`` words lies whole in a block. Words that no template has cannot
    add to what a block shares with one, so blocks are sets of the others.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                ws = terms(text.as_py())
                known = [(k, w) for k, w in enumerate(map(words.get, ws)) if w is not None]
                blocks: list[set[int]] = [set() for _ in range(max(1, -(-len(ws) // step) - 1))]
                for k, w in known:
                    k //= step
                    if k < len(blocks):
                        blocks[k].add(w)
                    if k:
                        blocks[k - 1].add(w)
                for col, x in zip(rows, (len(ws), *phrase_places(ws, phrases), [sorted(b) for b in blocks if len(b) >= least])):
                    col.append(x)
            kinds = (*[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, f"doc_id long, {BASE}, blocks array<array<int>>")
    return staged(out.withColumn("rid", F.monotonically_increasing_id()), "blocks")


def holding(blocks: DataFrame, templates: list[list[int]], threshold: float) -> DataFrame:
    """The pairs of ``blocks`` (rid, block: distinct word numbers) and templates (sets of numbers) above the threshold.

    Rows rid, template, share: once for each block and template that it holds.
    Words are ordered by the number of blocks that have them, rarest first. Of
    a block and a template that share ``need`` words the first common word is
    in the prefix of both: only the prefixes are joined, by word. The length
    of the block and what stands after the two positions bound what can be
    shared; the pairs left are counted in full.
    """
    spark = blocks.sparkSession
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("block").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # words of templates only
    order = sorted({w for t in templates for w in t}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for k, t in enumerate(templates):
        own, must = sorted(rank[w] for w in t), need(len(t), threshold)
        rows += [(r, k, i, len(own), must, own) for i, r in enumerate(own[: len(own) - must + 1])]
    prefixes = spark.createDataFrame(rows, "word int, template int, i int, t_size int, must int, t_words array<int>")
    least = min((r[4] for r in rows), default=1)
    ranks = F.split(F.lit(",".join(str(rank.get(w, 0)) for w in range(max(rank, default=0) + 1))), ",").cast("array<int>")
    ordered = blocks.select("rid", F.array_sort(F.transform("block", lambda w: F.get(ranks, w))).alias("b"))
    heads = ordered.withColumn("b_size", F.size("b")).where(F.col("b_size") >= least)
    heads = heads.select("rid", "b", "b_size", F.posexplode(F.slice("b", F.lit(1), F.col("b_size") - least + 1)).alias("j", "word"))
    pairs = heads.join(F.broadcast(prefixes), "word")  # at most MAX_WORDS words of MAX_TEMPLATES
    pairs = pairs.where((F.col("b_size") >= F.col("must")) & (F.least(F.col("t_size") - F.col("i"), F.col("b_size") - F.col("j")) >= F.col("must")))
    both = pairs.withColumn("both", F.array_intersect("t_words", "b"))
    both = both.where((F.size("both") >= F.col("must")) & (F.array_min("both") == F.col("word")))
    return both.select("rid", "template", (F.size("both") / F.col("t_size")).alias("share"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """The licenses named or quoted in each row of ``docs``.

    Base labels come from phrases; a template's label comes from a block of the
    text that holds at least ``threshold`` of its distinct words. ``score`` is
    the largest share of a template found that way, 0 if none was.
    Cases: a null text is empty and has no words; every row gets a row, with
    repeated and null ids as they are; labels of several templates are one;
    templates without a word are passed over; texts of any length are read
    whole, in overlapping blocks; an empty table gives an empty result; other
    columns are not read. Over MAX_TEMPLATES templates or MAX_WORDS words of
    theirs raise: each task is sent them.
    """
    bags = [(label, list(dict.fromkeys(terms(text))), len(terms(text))) for label, text in templates if terms(text)]
    words = {w: k for k, w in enumerate(dict.fromkeys(w for _, bag, _ in bags for w in bag))}
    if len(bags) > MAX_TEMPLATES or len(words) > MAX_WORDS:
        raise ValueError(f"at most {MAX_TEMPLATES} templates with {MAX_WORDS} words")
    sets = [[words[w] for w in bag] for _, bag, _ in bags]
    step = max((n for *_, n in bags), default=1)
    rows = scanned(docs, words, step, min((need(len(s), threshold) for s in sets), default=1), phrases)
    found = holding(rows.select("rid", F.explode("blocks").alias("block")), sets, threshold)
    names = F.array(*(F.lit(label) for label, *_ in bags)) if bags else F.array().cast("array<string>")
    found = found.groupBy(F.col("rid").alias("of")).agg(F.collect_set(F.get(names, F.col("template"))).alias("own"), F.max("share").alias("score"))
    out = rows.drop("blocks").join(found, F.col("rid") == F.col("of"), "left")
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("own", F.array().cast("array<string>")))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
