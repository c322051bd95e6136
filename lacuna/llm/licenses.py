"""License scans by Dice coefficient over word bigrams.

Texts and templates are normalised alike (lower case, runs of other characters than letters and digits are
one space).  What is compared are the units of a text: each line and each paragraph (lines between
blank ones).  The Dice coefficient of two sets of bigrams of sizes a and b is at most 2 min(a, b) / (a + b), so a unit
meets only templates whose size lies in the interval that leaves the coefficient possible; that is an
equality join on the number of bigrams with a table of fixed size (templates times admissible sizes),
which is broadcast.  Besides the units, every window of words of the whole text is compared, so a notice is found
within a longer line or across lines; ``best_windows`` says why few windows have to be looked at.  ``n_matches``
counts the units that match as a whole; license, dice and unit are those of the best window.

Defined cases: null and empty texts have no units and get null; a unit of one word has its word as only
bigram; of equally similar templates the first name wins; each row is judged alone; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapped, parts, table

THRESHOLD = 0.8

#: Short notices and opening grants of common licences (fixed values: they must read as the licences do).
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "public-domain": "This work has been dedicated to the public domain.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software."
    ),
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, as the columns below make them."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))) or words[:1]


def admissible(size: int, threshold: float) -> range:
    """Sizes of a unit for which a template of ``size`` bigrams can reach the threshold."""
    low, high = size * threshold / (2 - threshold), size * (2 - threshold) / threshold
    return range(max(1, int(low) - 1), int(high) + 2)


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def best_windows(words: list[str], known: dict[str, list[str]], vocabulary: dict[tuple[str, ...], list[str]], threshold: float) -> tuple[float, str, str] | None:
    """(-dice, license, text) of the best window of any length, or nothing below the threshold.

    ``vocabulary`` has the licenses of each bigram (a tuple of words; one word for templates of one word).  A window can reach
    the threshold only if the text has enough of the template's distinct bigrams.  A best window starts and ends with bigrams of
    the template, holds its first bigram once (else a later start is as good) and has at most so many distinct ones
    as ``admissible`` allows: that ends the walk from each start.  Where windows of a template overlap, the better one
    counts; one within a match of a larger template is a part of that notice and does not count.
    """
    grams: list = list(zip(words, words[1:], strict=False))
    own: dict[str, list[int]] = {}
    for i in [i for i, g in enumerate(grams) if g in vocabulary]:
        for name in vocabulary[grams[i]]:
            own.setdefault(name, []).append(i)
    single = {g[0] for g in vocabulary if len(g) == 1}
    for i in [i for i, w in enumerate(words) if w in single] if single else []:
        for name in vocabulary[(words[i],)]:
            own.setdefault(name, []).append(i)
    best = None
    taken: list[list[tuple[int, int]]] = []  # matches of each larger template: first and last word
    for name in sorted(own, key=lambda k: (-len(known[k]), k)):
        at, size = own[name], len(known[name])
        one = " " not in known[name][0]
        template = {grams[i] for i in at} if not one else set()
        have = 1 if one else len(template)
        if 2 * have / (have + size) < threshold:
            continue
        most = size * (2 - threshold) / threshold + 1e-9
        spans = [(-1.0, i, i) for i in at] if one else []
        for start in at if not one else ():
            seen: set = set()
            hits, top = 0, None
            for k in range(start, len(grams)):
                g = grams[k]
                if k > start and g == grams[start]:
                    break
                if g in seen:
                    continue
                seen.add(g)
                if len(seen) > most:
                    break
                if g in template:
                    hits += 1
                    dice = 2 * hits / (len(seen) + size)
                    if dice >= threshold and (top is None or -dice < top[0]):
                        top = (-dice, start, k + 1)
            if top:
                spans.append(top)
        accepted: list[tuple[int, int]] = []  # in order, without overlap
        for low, first, last in sorted(spans):
            place = bisect.bisect(accepted, (first, last))
            if place and accepted[place - 1][1] >= first or place < len(accepted) and accepted[place][0] <= last:
                continue
            accepted.insert(place, (first, last))
            if best and (low, name) > best[:2]:
                continue
            before = ((x, bisect.bisect(x, (first, math.inf))) for x in taken)
            if any(place and x[place - 1][1] >= last for x, place in before):
                continue
            found = (low, name, " ".join(words[first : last + 1]))
            best = min(best or found, found)
        taken.append(accepted)
    return best


def _with_windows(base: DataFrame, known: dict[str, list[str]], threshold: float) -> DataFrame:
    """``base`` with a struct ``window`` (low, license, unit): the best window of its text."""
    vocabulary: dict[tuple[str, ...], list[str]] = {}
    for name in sorted(known):
        for g in known[name]:
            vocabulary.setdefault(tuple(g.split(" ")), []).append(name)
    at = base.columns.index("text")
    other = re.compile("[^a-z0-9]+")

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, at)):
            found = [best_windows(other.sub(" ", t.lower()).split(), known, vocabulary, threshold) for t in batch.column(at).to_pylist()]
            rows = [None if x is None else dict(zip(("low", "license", "unit"), x, strict=True)) for x in found]
            kind = pa.struct([("low", pa.float64()), ("license", pa.string()), ("unit", pa.string())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "window"])

    return mapped(base, run, base.select("*", F.lit(None).cast("struct<low:double,license:string,unit:string>").alias("window")).schema)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units compared, n_matches, license (best), dice and unit (the best window's text), one row for each row."""
    templates = TEMPLATES if templates is None else templates
    known = {k: bigrams(v) for k, v in templates.items()}
    sizes = [(n, k, known[k]) for k in known if known[k] for n in admissible(len(known[k]), threshold)]
    small = docs.sparkSession.createDataFrame(sizes, "size int, license string, template array<string>")
    row = F.monotonically_increasing_id()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", row.alias("row"), "text"
    )
    base = _with_windows(base, known, threshold)
    paragraphs = F.split("text", r"\n[ \t\r]*\n")
    units = F.array_distinct(F.concat(F.split("text", "\n"), paragraphs))
    plain = F.transform(units, lambda u: F.trim(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " ")))
    found = F.array_distinct(F.filter(plain, lambda u: u != ""))
    each = base.select("doc_id", "row", "window", found.alias("units")).select("doc_id", "row", "window", F.size("units").cast("long").alias("n_units"), F.explode_outer("units").alias("unit"))
    grams = _bigrams(F.split("unit", " "))
    # a repeated notice is long with few distinct bigrams: only the number of distinct ones proves anything
    cut = each.select("doc_id", "row", "window", "n_units", "unit", F.when(F.col("unit").isNotNull(), grams).alias("grams")).withColumn("size", F.size("grams"))
    met = cut.join(F.broadcast(small), "size", "left")
    dice = 2 * F.size(F.array_intersect("grams", "template")) / (F.size("grams") + F.size("template"))
    rated = met.select("doc_id", "row", "window", "n_units", "unit", "license", F.when(F.col("license").isNotNull(), dice).alias("dice"))
    hit = F.col("dice") >= threshold
    # only texts that match are sent on; the rest of a row is its number of units
    # a unit is a window too; the best is the highest coefficient, then the first name, then the first text
    rated = rated.select("doc_id", "row", "n_units", F.when(hit, F.col("unit")).alias("unit"), "window")
    out = rated.groupBy("doc_id", "row", "n_units").agg(F.count_distinct("unit").alias("n_matches"), F.min("window").alias("best"))
    return out.select("doc_id", "n_units", "n_matches", F.col("best.license").alias("license"), F.round(-F.col("best.low"), 6).alias("dice"), F.col("best.unit").alias("unit"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = {k: bigrams(v) for k, v in TEMPLATES.items()}
    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, v))}])" for k, v in known.items())
    grams = (
        "CASE WHEN len(words) > 1 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) ELSE words END"
    )
    return f"""
WITH templates(license, template) AS (VALUES {rows}),
units AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) AS unit
  FROM (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'))) AS u FROM documents)
),
cut AS (SELECT doc_id, unit, {grams} AS grams FROM (SELECT doc_id, unit, string_split(unit, ' ') AS words FROM units WHERE unit <> '')),
rated AS (
  SELECT c.doc_id, c.unit, t.license, 2 * len(list_intersect(c.grams, t.template)) / (len(c.grams) + len(t.template)) AS dice
  FROM cut c LEFT JOIN templates t ON 2.0 * least(len(c.grams), len(t.template)) / (len(c.grams) + len(t.template)) >= {THRESHOLD}
),
ranked AS (
  SELECT doc_id, unit, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, unit) AS k FROM rated WHERE dice >= {THRESHOLD}
),
counts AS (
  SELECT doc_id, count(DISTINCT unit) AS n_units, count(DISTINCT CASE WHEN dice >= {THRESHOLD} THEN unit END) AS n_matches FROM rated GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_matches, 0) AS n_matches, license, round(dice, 6) AS dice, unit
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (doc_id)
"""


ORACLE_SQL = _oracle()
