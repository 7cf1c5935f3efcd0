"""License scan by an exact set-similarity join (operator 13).

Texts and license templates become lower-cased words.  A template stands in a
block of text when the block holds at least ``threshold`` of the template's
distinct words.  Blocks are windows: for templates of up to 2^k words, windows of
2^(k+1) words that start every 2^k words, so a notice lies whole in one of them
however its lines are broken, and a window never spans much more than a notice.

The join, for every block and template, without a candidate missed:

* *Global order*: the words of all templates are counted over all blocks of all
  texts; a set lists its words from the rarest on.  Words of no template can't
  add to an overlap and are left out.
* *Prefix filter*: with ``need = ceil(threshold * |template|)``, a template and a
  block that share ``need`` words share one among the first ``|template| - need
  + 1`` of the template and the first ``|block| - need + 1`` of the block.  Only
  those words are joined on, which are the rare ones.
* *Length filter*: the block has at least ``need`` words.
* *Positional filter*: from the places of the shared word on, both lists are
  long enough for ``need`` shared words.
* The pairs that are left are compared by their whole sets.

Of the templates found in one block, one whose words all belong to another of
them is dropped (``cc by 4.0`` beside ``cc by-nc 4.0``).  Fixed phrases are
counted as well: places where a phrase's words stand in a row.

Scale: texts stay where they were read; only blocks with a rare template word
leave as rows.  Templates are a parameter of the job (a list in its program),
bounded by ``TEMPLATE_WORDS``; their side of the join is planned by Spark.  What
is found is grouped by document, one row a label at most.

Null and empty texts have no words, no labels and score 0.  A null key keeps its
row.  Repeated rows each get their own.  A very long text is scanned window by
window.  Empty tables give empty results.  Templates without words are refused.
Of ties there are none: a label is found or not.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm.common import SLICE_ROWS, by_batch_of, documents, in_arrow, pick, written
from vigilo.llm.decontaminate import words

#: Phrases that count as places, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Wording of public licenses, as documents state them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

THRESHOLD = 0.9
#: Words of all templates together: some ten MB in a task at most.
TEMPLATE_WORDS = 100_000


def prepared(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[dict]:
    """Templates as (template number, label, distinct words, words needed, size
    class k: at most 2^k words)."""
    out = []
    for i, (label, text) in enumerate(templates):
        w = words(text)
        if not w:
            raise ValueError(f"template {label!r} has no words")
        distinct = sorted({x.decode() for x in w})
        out.append({"template": i, "label": label, "words": distinct, "k": max(1, math.ceil(math.log2(len(w)))),
                    "need": max(1, math.ceil(threshold * len(distinct) - 1e-9))})
    if sum(len(t["words"]) for t in out) > TEMPLATE_WORDS:
        raise ValueError(f"more than {TEMPLATE_WORDS} template words: scan for parts of the list, one after the other")
    return out


def blocks(places: list[tuple[int, bytes]], k: int) -> Iterator[tuple[int, set[bytes]]]:
    """(block number, distinct words) of the windows with a word in ``places``
    (ascending place, word): block b spans the words from b * 2^k to (b + 2) * 2^k."""
    before: set[bytes] = set()
    last, now = -1, set()
    for at, w in places:
        b = at >> k
        if b != last:
            if last > 0:
                yield last - 1, before | now
            if last >= 0 and b > last + 1:
                yield last, now
            before, now, last = (now if b == last + 1 else set()), set(), b
        now.add(w)
    if last > 0:
        yield last - 1, before | now
    if last >= 0:
        yield last, now


def word_order(docs: DataFrame, made: list[dict], text: str = "text") -> list[str]:
    """All template words, from the one in the fewest blocks of ``docs`` on (ties
    in text order).  Every block of every text is counted."""
    known = frozenset(w.encode() for t in made for w in t["words"])
    classes = sorted({t["k"] for t in made})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE_ROWS):
                for t in batch.column(0).slice(s, SLICE_ROWS).to_pylist():
                    at = [(i, w) for i, w in enumerate(words(t)) if w in known]
                    for k in classes if at else ():
                        for _, of in blocks(at, k):
                            held.update(of)
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in held], "n": pa.array(held.values(), pa.int64())})

    counts = in_arrow(docs.select(F.col(f"`{text}`").cast("string").alias("text")), run, "word string, n long")
    n = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # template words only
    return sorted((w for w in {w for t in made for w in t["words"]}), key=lambda w: (n.get(w, 0), w))


def index(spark: SparkSession, made: list[dict], order: list[str]) -> DataFrame:
    """Prefix words of the templates: (k, word, template, place, size, need, set)."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t in made:
        ids = sorted(rank[w] for w in t["words"])
        rows += [(t["k"], ids[p], t["template"], p, len(ids), t["need"], ids) for p in range(len(ids) - t["need"] + 1)]
    return spark.createDataFrame(rows, "k int, word int, template int, t_place int, t_size int, need int, t_set array<int>")


def candidates(rows: DataFrame, made: list[dict], order: list[str]) -> DataFrame:
    """(key, mark, k, block, word, place, size, set): the prefix words of every
    block that are prefix words of a template of its class too."""
    rank = {w.encode(): i for i, w in enumerate(order)}
    wanted: dict[int, set[int]] = {}
    least: dict[int, int] = {}
    for t in made:
        ids = sorted(rank[w.encode()] for w in t["words"])
        wanted.setdefault(t["k"], set()).update(ids[:len(ids) - t["need"] + 1])
        least[t["k"]] = min(t["need"], least.get(t["k"], t["need"]))

    def run(keys: list, marks: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("key", "mark", "k", "block", "word", "place", "size", "set")}
        for key, mark, t in zip(keys, marks, texts, strict=True):
            at = [(i, rank[w]) for i, w in enumerate(words(t)) if w in rank]
            for k in wanted if at else ():
                for b, of in blocks(at, k):
                    if len(of) < least[k] or wanted[k].isdisjoint(of):
                        continue
                    ids = sorted(of)
                    for p, w in enumerate(ids[:len(ids) - least[k] + 1]):
                        if w in wanted[k]:
                            for c, v in zip(out, (key, mark, k, b, w, p, len(ids), ids), strict=True):
                                out[c].append(v)
        return out

    kind = rows.schema["key"].dataType.simpleString().replace("bigint", "long")
    return by_batch_of(rows, run, f"key {kind}, mark long, k int, block long, word int, place int, size int, set array<int>")


def found(rows: DataFrame, made: list[dict], order: list[str]) -> DataFrame:
    """(key, mark, k, block, template, share), written: all pairs of a block and
    a template that meet the threshold."""
    held = F.size(F.array_intersect("set", "t_set"))
    pairs = (candidates(rows, made, order).join(index(rows.sparkSession, made, order), ["k", "word"])
             .filter((F.col("size") >= F.col("need")) & (F.col("place") <= F.col("size") - F.col("need")))
             .filter(F.least(F.col("size") - F.col("place"), F.col("t_size") - F.col("t_place")) >= F.col("need"))
             .withColumn("held", held).filter("held >= need"))
    return written(pairs.select("key", "mark", "k", "block", "template", (F.col("held") / F.col("t_size")).alias("share"))
                   .distinct(), "license-pairs")


def labelled(pairs: DataFrame, made: list[dict]) -> DataFrame:
    """(key, mark, found, share): labels of each document's blocks and the
    greatest share.  A template inside another one of the same words is dropped."""
    spark = pairs.sparkSession
    sets = [frozenset(t["words"]) for t in made]
    inside = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a < b]
    # Blocks of different classes overlap: a place is compared at the words' scale.
    first = F.col("block") * F.pow(F.lit(2), "k").cast("long")
    spans = pairs.withColumns({"a": first, "b": first + F.pow(F.lit(2), F.col("k") + 1).cast("long")})
    wide = (spans.select(F.col("key").alias("o_key"), F.col("mark").alias("o_mark"), F.col("template").alias("outer"),
                         F.col("a").alias("o_a"), F.col("b").alias("o_b"))
            .join(spark.createDataFrame(inside, "inner int, outer int"), "outer"))
    own = spans.join(wide, F.col("key").eqNullSafe(F.col("o_key")) & (F.col("mark") == F.col("o_mark"))
                     & (F.col("template") == F.col("inner")) & (F.col("a") < F.col("o_b")) & (F.col("o_a") < F.col("b")), "left_anti")
    names = spark.createDataFrame([(t["template"], t["label"]) for t in made], "template int, label string")
    return own.join(names, "template").groupBy("key", "mark").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("share"))


def phrase_places(w: list[bytes], phrases: list[tuple[bytes, str]]) -> tuple[list[int], list[str]]:
    """(start words of all places of all phrases, labels found)."""
    line = b" ".join([b"", *w, b""])
    starts, labels = [], []
    for phrase, label in phrases:
        at, seen, place = line.find(phrase), 0, -1
        if at >= 0:
            labels.append(label)
        while at >= 0:
            place += line.count(b" ", seen, at + 1)
            seen = at + 1
            starts.append(place)
            at = line.find(phrase, at + 1)
    return starts, labels


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None,
         phrases: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score)
    for every row, the labels as sorted arrays.  score is 1 where a phrase
    stands, else the greatest share of a template that any block holds above
    the threshold, else 0."""
    made = prepared(TEMPLATES if templates is None else templates, threshold)
    fixed = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in (PHRASES if phrases is None else phrases)]
    rows = pick(df, key, text, any_key=True).select("key", F.xxhash64("text").alias("mark"), "text")
    kind = rows.schema["key"].dataType.simpleString().replace("bigint", "long")

    def run(keys: list, marks: list, texts: list) -> dict[str, list]:
        split = [words(t) for t in texts]
        hits = [phrase_places(w, fixed) for w in split]
        return {"key": keys, "mark": marks, "n_words": [len(w) for w in split], "n_base": [len(s) for s, _ in hits],
                "first_word": [min(s, default=None) for s, _ in hits], "last_word": [max(s, default=None) for s, _ in hits],
                "base_labels": [sorted(set(of)) for _, of in hits]}

    base = by_batch_of(rows, run, f"key {kind}, mark long, n_words long, n_base long, first_word long, last_word long, "
                                  "base_labels array<string>")
    more = labelled(found(rows, made, word_order(df, made, text)), made)
    more = more.select(F.col("key").alias("f_key"), F.col("mark").alias("f_mark"), "found", "share")
    none = F.array().cast("array<string>")
    return base.join(more, F.col("key").eqNullSafe(F.col("f_key")) & (F.col("mark") == F.col("f_mark")), "left").select(
        "key", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def op13(spark, sf_dir: str) -> DataFrame:
    """``op13_licenses``: phrases and templates in every document."""
    out = scan(documents(spark, sf_dir)).withColumnRenamed("key", "doc_id")
    return out.withColumns({c: F.concat_ws(",", c) for c in ("base_labels", "labels")})
