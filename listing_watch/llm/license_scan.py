"""Licence scan (native: DataFrame functions only).

A document's units are its lines and its paragraphs (runs of lines without an empty line
between). A unit is normalised (A-Z lowered, everything but a-z and 0-9 a single space) and
compared to licence templates by the Dice coefficient over distinct word bigrams,
2 |A and B| / (|A| + |B|). Two size rules prune templates and lose nothing:

* Dice of t or more needs |A| t / (2 - t) <= |B| <= |A| (2 - t) / t;
* it needs more than |B| t / (2 - t) - 1 bigrams of the template, so any set of words that
  touches all but fewer of them must occur in the unit. Texts without a word of the union of
  these sets (`anchor_words`) are never split into units.

Defined results: a null, empty or wordless text has no licence (null, score null, no matches).
Among equal scores the name that sorts first wins. Rows are judged alone, so repeated rows give
repeated results; an empty table gives an empty result. Columns made here start with `ls_`.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Percent, so that bounds compare whole numbers.
THRESHOLD = 80

#: Notices and permission texts of public licences.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "Licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Licensed under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-release": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> list[str]:
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in text.translate(str.maketrans(UPPER, UPPER.lower())))
    return out.split()


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for k, w in ((k, _words(v)) for k, v in templates.items())}


def anchor_words(templates: dict[str, str], threshold: int = THRESHOLD) -> list[str]:
    """Words of which every unit within the threshold of any template has at least one.

    Per template the longest words are taken until the bigrams they leave untouched are fewer
    than the overlap that the threshold demands."""
    out: set[str] = set()
    for bigrams in template_bigrams(templates).values():
        need = len(bigrams) * threshold / (200 - threshold)
        left = [b.split() for b in bigrams]
        by = Counter(w for b in left for w in set(b))
        for w in sorted(by, key=lambda w: (w not in out, -len(w), -by[w], w)):
            if len(left) < need:
                break
            if any(w in b for b in left):
                out.add(w)
                left = [b for b in left if w not in b]
    return sorted(out)


def _bigrams(unit: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(unit, UPPER, UPPER.lower()), "[^a-z0-9]+", " "))
    pair = F.split(plain, " ")
    # each word but the last, with the next: both sides come from one split
    return F.array_distinct(F.zip_with(F.slice(pair, 1, F.greatest(F.size(pair) - 1, F.lit(0))), F.slice(pair, 2, F.greatest(F.size(pair) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """docs with `ls_license` (the best template, null if none), `ls_dice` and `ls_matches` (the
    units within the threshold of some template)."""
    templates = TEMPLATES if templates is None else templates
    t = F.coalesce(F.col(text_col), F.lit(""))
    anchors = "(?i)(" + "|".join(anchor_words(templates, threshold)) + ")"
    lines = F.split(t, "\n")
    blocks = F.filter(F.split(t, "\n[ \\t\\r]*\n"), lambda x: F.contains(x, F.lit("\n")))
    units = F.when(t.rlike(anchors), F.filter(F.concat(lines, blocks), lambda x: x.rlike(anchors)))
    d = packed(docs, None, ["ls_license", "ls_dice", "ls_matches"], bigrams=F.transform(units, _bigrams))

    def best(b: Column) -> Column:
        n = F.size(b)
        each = []
        for name, own in sorted(template_bigrams(templates).items()):
            k = len(own)
            both = F.size(F.array_intersect(F.array(*map(F.lit, own)), b))
            in_bounds = (n * (200 - threshold) >= k * threshold) & (n * threshold <= k * (200 - threshold))
            near = in_bounds & (200 * both >= threshold * (n + k))
            each.append(F.when(near, F.struct((-2 * both / (n + k)).alias("minus"), F.lit(name).alias("name"))))
        return F.array_min(F.array(*each))

    d = d.withColumn("found", F.filter(F.transform("bigrams", best), lambda x: x.isNotNull()))
    top = F.array_min("found")
    return unpacked(d, top["name"].alias("ls_license"), (-top["minus"]).alias("ls_dice"), F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("ls_matches"))


def oracle(templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> str:
    """DuckDB SQL over `documents` for doc_id, license, dice, n_matches."""
    templates = TEMPLATES if templates is None else templates
    q = lambda s: "'" + s.replace("'", "''") + "'"
    own = ", ".join(f"({q(k)}, [{', '.join(map(q, v))}])" for k, v in sorted(template_bigrams(templates).items()))
    return f"""
WITH templates(name, own) AS (VALUES {own}),
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
               list_filter(string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), lambda x: contains(x, chr(10))) AS blocks FROM documents),
units AS (SELECT doc_id, unnest(list_concat(lines, blocks)) AS unit FROM cut),
words AS (SELECT doc_id, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{UPPER.lower()}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units
          WHERE regexp_matches(unit, '(?i)({"|".join(anchor_words(templates, threshold))})')),
grams AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words),
scored AS (SELECT doc_id, name, b, len(own) + len(b) AS n, len(list_intersect(own, b)) AS k, 2 * k / n AS dice FROM grams, templates
           WHERE len(b) * {200 - threshold} >= len(own) * {threshold} AND len(b) * {threshold} <= len(own) * {200 - threshold} AND 200 * k >= {threshold} * n),
best AS (SELECT doc_id, b, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM scored GROUP BY doc_id, b),
tally AS (SELECT doc_id, b, count(*) AS k FROM grams GROUP BY doc_id, b),
found AS (SELECT doc_id, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, sum(k)::BIGINT AS n_matches FROM best JOIN tally USING (doc_id, b) GROUP BY doc_id)
SELECT d.doc_id, license, dice, coalesce(n_matches, 0) AS n_matches FROM documents d LEFT JOIN found USING (doc_id)
"""
