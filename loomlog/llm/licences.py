"""License scans in DataFrame operations only: Dice coefficient over word bigrams with license templates.

Units of a text (sentences, lines, and the whole of it) are normalised to lower-case ASCII words and
compared with templates as sets of word bigrams. Dice >= t asks for sizes between t / (2 - t) and
(2 - t) / t of the template's, so a unit is compared only with the templates within these bounds, and its
bigrams are not even made if its words are too few for all of them.

A unit that is like a template has at least t / (2 - t) of its bigrams, so of any other share of them that
is larger than what is left it has one. Such a share is chosen around the template's long, repeated words: a
text or unit without any of these words is passed by, without loss.

Notices also span lines and stand within longer ones. So these wide units are compared too, line breaks and
comment marks read as blanks: sentences over several lines (a blank line ends one), and windows of the text's
words that begin with a bigram of a template (or end the text) and have as many bigrams as the template or,
ending with one of its bigrams, up to (2 - t) / t times as many. Shorter windows are no units: a part of a
wording would be like it, whatever stands in the place of the rest. A window is only made where enough of a
template's bigrams are close together. Wide units count for licenses that no plain unit shows, one match a
license, as a notice on one line is in many wide units. The SQL of oracle() has the plain units only: it gives
the same rows where no notice is wrapped or within a line, as in the given tables.

Everything happens within a row: no shuffle, nothing that grows with the corpus leaves a task.

Defined results: a null text, and one without a unit that is like a template, has no licenses, best 0 and
is allowed; repeated rows each get a row; null doc_ids are kept; an empty table gives no rows; other
columns are ignored; texts of any length are scanned whole; of two templates of one license the nearer
counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (license, may be trained on, wording) of usual notices and permission texts.
TEMPLATES = (
    ("apache-2.0", True, "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", True, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", True, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", True, "Released under the BSD License."),
    ("cc-by-4.0", True, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", True, "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", False, "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", False, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", False, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", False, "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", False, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", True, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", True, "Released under the MIT License."),
    ("mit", True, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mpl-2.0", True, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", False, "All rights reserved."),
    ("unlicense", True, "This is free and unencumbered software released into the public domain."),
)


def bigrams(wording: str) -> list[str]:
    own = re.sub(r"[^a-z0-9]+", " ", wording.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(own, own[1:], strict=False)})


def bounds(size: int, least: float = LEAST) -> tuple[float, float]:
    """Sizes of a set that can have a Dice coefficient of `least` with one of `size` (and a little more, for rounding)."""
    return size * least / (2 - least) - 1e-9, size * (2 - least) / least + 1e-9


def anchors(own: list[str], least: float = LEAST) -> list[str]:
    """Words that cover so many of a template's bigrams that each unit like it holds one of the words."""
    missing = len(own) - math.ceil(len(own) * least / (2 - least) - 1e-9) + 1
    left, out = [set(x.split()) for x in own], []
    while missing > 0:
        count = Counter(w for x in left for w in x)
        best = max(count, key=lambda w: (len(w) >= 6, count[w], len(w), w))
        out.append(best)
        missing -= count[best]
        left = [x for x in left if best not in x]
    return out


def units(text: Column) -> Column:
    """Sentences, lines and the whole of a text."""
    whole = F.translate(text, UPPER, LOWER)
    return F.array_distinct(F.concat(F.split(F.regexp_replace(whole, r"([.!?])[ \t\r\n]+", "$1\n"), "\n"), F.split(whole, "\n"), F.array(whole)))


HITS = "array<array<struct<name:string,good:boolean,dice:double>>>"


def wrapped(text: Column) -> Column:
    """Sentences of a text that hold a line break."""
    whole = F.translate(text, UPPER, LOWER)
    return F.filter(F.array_distinct(F.split(whole, r"(?<=[.!?])[ \t\r\n]+|\n[^a-z0-9\n]*(?=\n)")), lambda u: F.trim(u).contains("\n"))


def _words(unit: Column) -> Column:
    return F.filter(F.split(unit, "[^a-z0-9]+"), lambda x: x != "")


def _grams(w: Column) -> Column:
    """The distinct bigrams of two words at least."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def _sets(units: Column, fewest: float, anchored: Callable[[Column], Column]) -> Column:
    """The bigram sets of all units that have an anchor and at least `fewest` bigrams."""
    long = F.filter(F.transform(F.filter(units, anchored), _words), lambda w: F.size(w) - 1 >= fewest)
    return F.transform(long, _grams)


def _windows(text: Column, known: list[tuple[str, bool, list[str], int]], least: float) -> Column:
    """The hits of all windows, as array<struct<name, good, dice>>; `known` has the number of a template's bigrams, repeats counted, last."""
    every = sorted({x for *_, own, _ in known for x in own})
    begins = sorted({x.split()[0] for x in every})
    need = [max(1, math.ceil(len(own) * least / (2 - least) - 1e-9)) for *_, own, _ in known]
    shapes = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit(good).alias("good"), F.array(*map(F.lit, own)).alias("own"), F.lit(n).alias("n"), F.lit(max(n, math.floor(n * (2 - least) / least + 1e-9))).alias("most"), F.lit(k).alias("need"))
            for (name, good, own, n), k in zip(known, need, strict=True)
        )
    )

    def of_template(w: Column, met: Column, t: Column) -> Column:
        """Windows of the words `w`, of whose bigrams `met` (at, gram) are the template's."""
        last = F.size(w) - 1 - t["n"]

        def close(x: Column, i: Column) -> Column:
            there = (x["at"] <= last) & (F.get(met, i + t["need"] - 1)["at"] < x["at"] + t["most"])
            return F.struct(x["at"].alias("begin"), F.when(there, F.slice(met, i + 1, t["most"])).alias("near"))

        ending = F.struct(last.alias("begin"), F.when(last >= 0, F.filter(met, lambda x: x["at"] >= last)).alias("near"))
        begun = F.filter(F.concat(F.transform(met, close), F.array(ending)), lambda x: x["near"].isNotNull() & (F.size(x["near"]) >= t["need"]))

        def dices(x: Column) -> Column:
            ends = F.filter(F.transform(x["near"], lambda y: y["at"]), lambda e: (e >= x["begin"] + t["n"]) & (e < x["begin"] + t["most"]))

            def dice(e: Column) -> Column:
                alike = F.size(F.array_distinct(F.transform(F.filter(x["near"], lambda y: y["at"] <= e), lambda y: y["gram"])))
                return F.when(alike >= t["need"], 2.0 * alike / (F.size(_grams(F.slice(w, x["begin"] + 1, e - x["begin"] + 2))) + F.size(t["own"]))).otherwise(0.0)

            return F.transform(F.concat(F.array(x["begin"] + t["n"] - 1), ends), dice)

        best = F.coalesce(F.array_max(F.flatten(F.transform(begun, dices))), F.lit(0.0))
        return F.struct(t["name"].alias("name"), t["good"].alias("good"), F.when(F.size(met) >= t["need"], best).otherwise(0.0).alias("dice"))

    def of_words(w: Column) -> Column:
        grams = F.transform(w, lambda x, i: F.struct(i.alias("at"), F.when(x.isin(begins), F.concat_ws(" ", x, F.get(w, i + 1))).alias("gram")))
        met = F.filter(grams, lambda x: x["gram"].isin(every))
        found = F.transform(F.array(met), lambda g: F.when(F.size(g) >= min(need, default=1), F.transform(shapes, lambda t: F.element_at(F.transform(F.array(F.filter(g, lambda x: F.array_contains(t["own"], x["gram"]))), lambda m: of_template(w, m, t)), 1))))
        return F.filter(F.element_at(found, 1), lambda x: x["dice"] >= least)

    return F.element_at(F.transform(F.array(_words(F.translate(text, UPPER, LOWER))), of_words), 1)


def scan(docs: DataFrame, templates: tuple[tuple[str, bool, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, licenses (names, comma-joined), n_matches (units like a template, and licenses that only wide units show), best (highest coefficient) and allowed of every row."""
    known = [(name, good, own) for name, good, wording in templates if (own := bigrams(wording))]

    def likeness(b: Column) -> Column:
        """The templates within bounds that reach `least`, as array<struct<name, good, dice>>."""
        each = []
        for name, good, own in known:
            low, high = bounds(len(own), least)
            dice = F.when(F.size(b).between(low, high), 2.0 * F.size(F.array_intersect(b, F.array(*map(F.lit, own)))) / (F.size(b) + len(own))).otherwise(0.0)
            each.append(F.struct(F.lit(name).alias("name"), F.lit(good).alias("good"), dice.alias("dice")))
        return F.filter(F.array(*each), lambda x: x["dice"] >= least)

    fewest = min((bounds(len(own), least)[0] for *_, own in known), default=1)
    needed = sorted({w for *_, own in known for w in anchors(own, least)})

    def anchored(text: Column) -> Column:
        out = F.lit(False)
        for w in needed:
            out = out | text.contains(w)
        return out

    def near(units: Column) -> Column:
        return F.filter(F.transform(_sets(units, fewest, anchored), likeness), lambda x: F.size(x) > 0)

    counted = [(name, good, own, len(re.sub(r"[^a-z0-9]+", " ", wording.lower()).split()) - 1) for name, good, wording in templates if (own := bigrams(wording))]
    spans = F.flatten(near(wrapped(F.col("text"))))
    wide = F.concat(spans, F.coalesce(_windows(F.col("text"), counted, least), F.array().cast(HITS[6:-1]))) if counted else spans
    low = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lower("text").alias("low"))
    met = low.select("doc_id", F.when(anchored(F.col("low")), F.struct(near(units(F.col("text"))).alias("hits"), wide.alias("wide"))).alias("x"))
    plain = met.select("doc_id", F.coalesce("x.hits", F.array().cast(HITS)).alias("hits"), F.coalesce("x.wide", F.array().cast(HITS[6:-1])).alias("wide")).withColumn("plain", F.flatten("hits"))
    more = plain.withColumn("more", F.filter("wide", lambda x: ~F.exists("plain", lambda y: y["name"] == x["name"])))
    found = more.withColumn("all", F.concat("plain", "more"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["name"]))), ",").alias("licenses"),
        (F.size("hits") + F.size(F.array_distinct(F.transform("more", lambda x: x["name"])))).cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("all", lambda x: x["dice"])), F.lit(0.0)).alias("best"),
        F.forall("all", lambda x: x["good"]).alias("allowed"),
    )


def oracle(templates: tuple[tuple[str, bool, str], ...] = TEMPLATES, least: float = LEAST) -> str:
    """The result of scan() in DuckDB SQL, which compares every unit with every template."""
    rows = ", ".join(f"('{name}', {good}, {bigrams(wording)!r})" for name, good, wording in templates)
    return rf"""
WITH t(name, good, grams) AS (VALUES {rows}),
  w AS (SELECT doc_id, row_number() OVER () AS n, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS whole FROM documents),
  u AS (SELECT n, unnest(list_distinct(string_split(regexp_replace(whole, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)) || string_split(whole, chr(10)) || [whole])) AS unit FROM w),
  s AS (SELECT n, unit, list_filter(string_split_regex(unit, '[^a-z0-9]+'), lambda x: x <> '') AS words FROM u),
  b AS (SELECT n, unit, list_distinct(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS own FROM s WHERE len(words) > 1),
  d AS (SELECT n, unit, name, good, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM b, t),
  h AS (SELECT n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT unit) AS n_matches, max(dice) AS best, bool_and(good) AS allowed FROM d WHERE dice >= {least} GROUP BY n)
SELECT w.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(best, 0)::DOUBLE AS best, coalesce(allowed, true) AS allowed FROM w LEFT JOIN h ON h.n = w.n
"""
