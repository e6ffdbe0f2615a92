"""License scans by diagonal voting.

Method
    Every rolling word k-gram of every text is hashed and joined to the positions of the templates' k-grams. Hits vote by
    diagonal (place in the text less place in the template): a diagonal has the different places of the template that
    are hit on it, so a fragment that is repeated votes once. Neighbouring diagonals, which inserted or left-out words
    make, are merged into one strand, and a strand is cut into spans where it leaves out many words of the text. A span is verified word by word: the words of the template that its hits cover (a
    hit has the template's very words, not only their hash) are at least ``COVERAGE`` of all, and those that decide between
    variants, as version or kind, are there without a gap. Of overlapping spans of one family of licences the one with
    the most words stands. A phrase is a template of one k-gram, so each of its hits is a place.
    Before the join, k-grams whose hash is not in a bitmap of the templates' hashes are left out (a runtime filter:
    it drops no hit). The templates' table is broadcast if it has at most ``BROADCAST_GRAMS`` rows. What is found is
    written before it is shuffled, so rows keep the numbers that they are told apart by when an executor is lost.

Cases
    Null or empty text, or text without words: n_words 0, no labels, first_word and last_word null, score 0. Rows
    are told apart by their place in the input, so repeated rows, ties and null doc_ids give a result each. Empty
    table: no rows. Other columns are ignored. Very long texts are hashed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm._store import bounded_batches, stored
from faultline.llm._text import ALNUM_WORDS, gram_hash, words_of

GRAM = 3
#: Least share of a template's k-grams, and how far diagonals and places of one span may be apart, in words.
COVERAGE, DRIFT, GAP = 0.7, 4, 12
BROADCAST_GRAMS = 200_000
_BITS = 1 << 20


class Template(NamedTuple):
    """``deciding`` words of the text must be found without a gap; of overlapping spans of a ``family`` one stands."""

    label: str
    text: str
    base: bool = False
    family: str = ""
    deciding: str = ""


# Base phrases, then notices and texts of public licences, with label, family and deciding words.
BASE_PHRASES = [Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True)]
TEMPLATES = [
    *BASE_PHRASES,
    Template("apache-2.0", "licensed under the apache license version 2 0", family="apache", deciding="apache license version 2 0"),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        family="apache",
        deciding="apache license version 2 0",
    ),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", family="apache", deciding="apache org licenses license 2 0"),
    Template("mit", "released under the mit license", family="mit", deciding="the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        family="mit",
    ),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", family="mit"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", family="isc"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", family="isc"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", family="bsd"),
    Template(
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution this software is provided by the copyright holders and contributors as is",
        family="bsd",
        deciding="provided with the distribution this software is provided",
    ),
    Template(
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        family="bsd",
        deciding="may be used to endorse or promote products",
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", family="gpl", deciding="general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", family="gpl", deciding="general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", family="gpl", deciding="gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", family="gpl", deciding="gnu affero general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", family="gpl", deciding="gnu general public license as published"),
    Template("cc-by-4.0", "licensed under cc by 4 0", family="cc", deciding="cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", family="cc", deciding="cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", family="cc", deciding="cc by nc 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", family="cc", deciding="commons attribution 4 0"),
    Template("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", family="cc", deciding="attribution sharealike 4 0"),
    Template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", family="cc", deciding="attribution noncommercial 4 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", family="cc"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", family="mpl", deciding="mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", family="unlicense"),
]
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def gram_rows(templates: list[Template]) -> list[tuple]:
    """(hash, k, gram, template, label, base, family, tpos, words, deciding) of each k-gram; a phrase of up to GRAM words is one k-gram.

    deciding: whether the k-gram lies in the template's deciding words.
    """
    rows = []
    for t, x in enumerate(templates):
        words, deciding = _words(x.text), _words(x.deciding)
        if not words:
            continue
        k = len(words) if x.base or len(words) <= GRAM else GRAM
        n = len(words) - k + 1
        at = next((i for i in range(len(words)) if deciding and words[i : i + len(deciding)] == deciding), None)
        if deciding and at is None:
            raise ValueError(f"{x.deciding!r} is not in the template of {x.label}")
        within = range(at, at + len(deciding) - k + 1) if deciding else range(0)
        rows += [(int(np.uint64(gram_hash(words[i : i + k])).astype(np.int64)), k, " ".join(words[i : i + k]), t, x.label, x.base, x.family, i, len(words), i in within) for i in range(n)]
    return rows


ROWS = "row long, doc_id long, n_words long, hash long, k int, gram string, pos int"


def _grams(sizes: list[int], bitmap: np.ndarray):
    mask = np.uint64(_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for low, high, w in words_of(batch.column(1), ALNUM_WORDS):
                n = high - low
                out = [([*range(n)], [None] * n, [None] * n, [None] * n, [None] * n)]
                for k in sizes:
                    hashes = w.grams(k)
                    at = np.flatnonzero(bitmap[(hashes & mask).astype(np.int64)] & w.gram_mask(k))
                    rows = np.searchsorted(w.bounds, at, "right") - 1
                    out.append((rows.tolist(), hashes[at].view(np.int64).tolist(), [k] * len(at), [w.text(i, i + k) for i in at.tolist()], (at - w.bounds[rows]).tolist()))
                rows, hashes, ks, grams, places = ([x for part in c for x in part] for c in zip(*out))
                index = pa.array(rows, pa.int64())
                counts = pa.array(np.diff(w.bounds), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(rows, np.int64) + (base + seen)), batch.column(0).slice(low, n).take(index), counts.take(index), pa.array(hashes, pa.int64()), pa.array(ks, pa.int32()), pa.array(grams, pa.string()), pa.array(places, pa.int32())],
                    ["row", "doc_id", "n_words", "hash", "k", "gram", "pos"],
                )
                seen += n

    return run


def spans(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Spans (row, doc_id, n_words, label, base, first, last, score) of each row of ``docs``; each row has one with a null label besides."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    grams = gram_rows(templates)
    bitmap = np.zeros(_BITS, bool)
    bitmap[[g[0] & (_BITS - 1) for g in grams]] = True
    table = spark.createDataFrame(grams, "hash long, k int, gram string, template int, label string, base boolean, family string, tpos int, words int, deciding boolean")
    n_deciding = table.filter("deciding").groupBy("template").agg(F.count(F.lit(1)).alias("n_deciding"))
    table = table.join(F.broadcast(n_deciding), "template", "left").na.fill(0, ["n_deciding"])
    if len(grams) <= BROADCAST_GRAMS:
        table = F.broadcast(table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_grams(sorted({g[1] for g in grams}), bitmap), ROWS)
    rows = stored(rows, "license-grams")
    hits = rows.filter("pos is not null").join(table, ["hash", "k", "gram"])
    own = ["row", "doc_id", "n_words", "template", "label", "base", "family", "words", "n_deciding", "k"]
    places = F.collect_set("tpos"), F.collect_set(F.when(F.col("deciding"), F.col("tpos")))
    diagonals = hits.groupBy(*own, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(places[0].alias("places"), places[1].alias("decided"), F.min("pos").alias("low"), F.max(F.col("pos") + F.col("k") - 1).alias("high"))
    # A phrase's diagonals are places of their own; a longer template's drift apart where words are put in or left out.
    # Near diagonals first, whatever others (of passages that the template repeats) lie between them in the text; then places.
    across = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(across) > DRIFT)
    diagonals = diagonals.withColumn("strand", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(across))
    along = Window.partitionBy("row", "template", "strand").orderBy("low", "diagonal")
    far = F.col("low") - F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1)) > GAP
    both = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    merged = diagonals.withColumn("span", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(along)).groupBy(*own, "strand", "span").agg(both("places").alias("places"), both("decided").alias("decided"), F.min("low").alias("first"), F.max("high").alias("last"))
    # Word by word: those that the hits cover, and whether all that decide are among them.
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    verified = merged.withColumn("covered", covered).withColumn("score", F.col("covered") / F.col("words")).filter((F.col("score") >= COVERAGE) & (F.size("decided") == F.col("n_deciding")))
    # Overlapping spans of a family: the one with the most words stands. Phrases all do.
    group = Window.partitionBy("row", "family").orderBy("first", "last", "template")
    apart = F.col("first") > F.max("last").over(group.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(group)
    best = F.row_number().over(Window.partitionBy("row", "family", "island").orderBy(F.desc("covered"), F.desc("score"), "first", "template"))
    standing = verified.filter("not base").withColumn("island", island).withColumn("best", best).filter("best = 1").unionByName(verified.filter("base"), allowMissingColumns=True)
    columns = ["row", "doc_id", "n_words", "label", "base", "first", "last", "score"]
    nothing = [F.lit(None).cast(standing.schema[c].dataType).alias(c) for c in columns[3:]]
    return standing.select(*columns).unionByName(rows.filter("pos is null").select("row", "doc_id", "n_words", *nothing))


def license_scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, one row a row of ``docs``."""

    def labels(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    base = F.coalesce(F.col("base"), F.lit(False))
    return (
        spans(docs, templates)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(F.col("label").isNotNull()).alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).cast("double").alias("score"),
        )
        .drop("row")
    )
