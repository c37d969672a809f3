"""Licence scan of a tree of files (DataFrame functions only).

A file's text is cut into lines and sentences and, with adjacent lines joined,
into paragraphs; each of these is
compared with notice templates by the cosine of sparse TF-IDF vectors.  The
inverse frequencies are counted over all files.  A segment that reaches
the threshold must share a term that is outside the lightest terms of a
template whose joint weight stays below the threshold (prefix filter for
cosines), so only texts with such an anchor term are cut at all.  Terms
outside the templates are counted where a segment would reach the threshold if
they had the least weight; they only lengthen its vector, so no other segment
can reach it.  An SPDX tag names its licence outright.

A file whose matching segments hold at least half of its words, or that is
named like a licence file, speaks for its directory.  Files without a notice
of their own inherit from the nearest ancestor directory that has one: the
distinct directories are joined with their ancestors' licences by path, and the
files with their directory.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Notices by SPDX identifier, one sentence each.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights to this work are waived under CC0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_FREE = "it under the terms of the GNU {} as published by the Free Software Foundation"
#: Paragraphs of common headers and licence files by which they are told apart, and their short notices.
PARAGRAPHS = [
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", f"This program is free software: you can redistribute it and/or modify {_FREE.format('General Public License')}, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", f"This program is free software; you can redistribute it and/or modify {_FREE.format('General Public License')}; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", f"This library is free software: you can redistribute it and/or modify {_FREE.format('Lesser General Public License')}, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", f"This library is free software; you can redistribute it and/or modify {_FREE.format('Lesser General Public License')}; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", f"This program is free software: you can redistribute it and/or modify {_FREE.format('Affero General Public License')}, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
#: Lines without a letter or digit (blank, or a comment's marks alone) part paragraphs.
PARAGRAPH = r"(?:^|\n)[^A-Za-z0-9\n]*(?=\n|$)"
SPDX_MARK = "SPDX-License-Identifier:"
SPDX = SPDX_MARK + r"[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)"
SEGMENT = r"\n+|(?<=[.!?;])[ \t\r]+"
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([-._][^/]*)?$"
#: Directories up to this many are broadcast to the files (about 100 bytes each).
_BROADCAST_DIRS = 50_000
#: Terms, or rows with a notice, up to this many are broadcast (about 50 bytes each).
_BROADCAST_ROWS = 200_000


def terms(text: Column) -> Column:
    """Lower-case terms; only ASCII letters are folded and taken."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))


def _anchors(weights: dict[int, dict[str, float]], threshold: float) -> set[str]:
    """Terms outside each template's lightest ones that stay below the threshold together."""
    found: set[str] = set()
    for own in weights.values():
        whole, light = sum(w * w for w in own.values()), 0.0
        for term, w in sorted(own.items(), key=lambda x: (x[1], x[0])):
            light += w * w
            if math.sqrt(light / whole) >= threshold - 1e-9:
                found.add(term)
    return found


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", key_cols: tuple[str, ...] = (), templates=(*TEMPLATES, *PARAGRAPHS), threshold: float = 0.75) -> DataFrame:
    """``key_cols, path, own_license, score, is_license_file, license, how, from_dir``, a row per input row.

    ``own_license`` is the best template's (ties: the earlier template) and
    ``score`` its cosine, both null without a match.  ``how`` is ``own``,
    ``inherited`` or ``none``; ``from_dir`` names the directory inherited from
    (the empty string is the root).  Of several licence files in a directory
    the one with the smallest path speaks.  Null texts count as empty, null
    paths as files in the root; texts of any length are scanned whole; repeated
    rows are rows each; an empty table gives an empty result, and other columns
    of any name play no part.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "license-scan")
    counted = [re.findall(TERM, text.lower()) for _, text in templates]
    vocabulary = sorted({t for c in counted for t in c})
    text, path = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{path_col}`"), F.lit(""))
    known_terms = F.array(*[F.lit(t) for t in vocabulary])
    frequency = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms(text), known_terms))).alias("term")).groupBy("term").count()
    seen = {r["term"]: r["count"] for r in frequency.collect()}  # a row per template term
    total = seen.get("", 0)
    idf = lambda n: round(math.log((total + 1) / (n + 1)) + 1, 6)
    weight = {t: idf(seen.get(t, 0)) for t in vocabulary}
    vectors = {i: {t: c.count(t) * weight[t] for t in set(c)} for i, c in enumerate(counted)}
    norms = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vectors.items()}
    anchors = _anchors(vectors, threshold)

    # per term: its weight, and its part in the dot product with each template
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.array(F.lit(weight[t]), *[F.lit(v.get(t, 0.0) * weight[t]) for v in vectors.values()]).alias("w")) for t in vocabulary])
    table = F.map_from_entries(pairs)
    anchor_list = F.array(*[F.lit(a) for a in sorted(anchors)])

    def tally(own: Column) -> Column:
        return F.transform(F.array_distinct(own), lambda t: F.struct(t.alias("term"), F.size(F.filter(own, lambda x: x == t)).alias("times")))

    def measured(own: Column) -> Column:
        """A unit's dot products with the templates, the square of its norm over their terms, and its terms."""
        ours = F.transform(tally(F.filter(own, lambda x: x.isin(vocabulary))), lambda o: F.struct(o.times.alias("times"), F.element_at(table, o.term).alias("w")))
        known = F.aggregate(ours, F.lit(0.0), lambda s, o: s + F.pow(o.times * F.element_at(o.w, 1), F.lit(2.0)))
        dots = F.aggregate(ours, F.array(*[F.lit(0.0)] * len(vectors)), lambda s, o: F.zip_with(s, F.slice(o.w, 2, len(vectors)), lambda d, w: d + o.times * w))
        count = F.aggregate(ours, F.lit(0), lambda s, o: s + o.times)
        return F.struct(dots.alias("dots"), known.alias("known"), (F.size(own) - count).cast("double").alias("others"), own.alias("own"))

    def reaches(x: Column, rest: Column) -> Column:
        """Whether a unit reaches the threshold if its other terms add so much to the square of its norm."""
        return F.array_max(F.zip_with(x.dots, norm_list, lambda d, n: d / n)) >= F.sqrt(x.known + rest) * (threshold - 1e-6)

    def counted(x: Column) -> Column:
        rest = tally(F.filter(x.own, lambda t: ~t.isin(vocabulary)))
        return F.struct(x.dots.alias("dots"), x.known.alias("known"), rest.alias("rest"), F.size(x.own).alias("terms"))

    norm_list = F.array(*[F.lit(n) for n in norms.values()])
    # only texts that hold an anchor are cut; their segments stay in the row, so nothing is shuffled
    anchored = F.arrays_overlap(terms(F.col("_text")), anchor_list)

    def units(pattern: str, joined: bool) -> Column:
        # another term weighs at least 1, so it adds at least its times, and when counted the square of its times;
        # only units that reach the threshold that way are counted, so a long paragraph is gone through once
        own = F.filter(F.transform(F.split("_text", pattern), terms), lambda own: F.arrays_overlap(own, anchor_list))
        found = F.transform(F.filter(F.transform(own, measured), lambda x: reaches(x, x.others)), counted)
        found = F.filter(found, lambda x: reaches(x, F.aggregate(x.rest, F.lit(0.0), lambda s, r: s + F.pow(r.times.cast("double"), F.lit(2.0)))))
        return F.transform(found, lambda x: F.struct(x.dots.alias("dots"), x.known.alias("known"), x.rest.alias("rest"), x.terms.alias("terms"), F.lit(joined).alias("joined")))

    none = F.array().cast("array<struct<dots:array<double>, known:double, rest:array<struct<term:string, times:int>>, terms:int, joined:boolean>>")
    near = F.when(anchored, F.concat(units(SEGMENT, False), units(PARAGRAPH, True))).otherwise(none)
    key_names = [f"_key{i}" for i in range(len(key_cols))]
    keys = [F.col(f"`{k}`").alias(name) for k, name in zip(key_cols, key_names, strict=True)]
    rows = files.select(*keys, path.alias("_path"), text.alias("_text")).withColumn("_near", near).withColumn("_tag", F.when(F.contains("_text", F.lit(SPDX_MARK)), F.nullif(F.regexp_extract("_text", SPDX, 1), F.lit(""))))
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), *key_names, "_path", "_near", "_tag", F.when(F.col("_tag").isNotNull(), F.size(terms(F.regexp_extract("_text", SPDX, 0)))).otherwise(0).alias("_tagged"), F.when((F.size("_near") > 0) | F.col("_tag").isNotNull(), F.size(terms(F.col("_text")))).alias("_terms"))
    rows = scratch.save(rows, "rows")
    near = rows.select("_row", F.posexplode("_near").alias("_place", "n")).select("_row", "_place", "n.*")
    rest = near.select("_row", "_place", F.explode("rest").alias("r")).select("_row", "_place", "r.*")
    counted_terms = _frequencies(files.select(terms(text).alias("own")), rest.select("term").distinct(), scratch)
    idf_of = F.round(F.log(F.lit(float(total + 1)) / (F.col("files") + 1)) + 1, 6)
    more = rest.join(counted_terms, "term").groupBy("_row", "_place").agg(F.sum(F.pow(F.col("times") * idf_of, F.lit(2.0))).alias("_more"))
    norm = F.sqrt(F.col("known") + F.coalesce("_more", F.lit(0.0)))
    cosines = F.transform(F.arrays_zip("dots", norm_list.alias("norms")), lambda x, i: F.struct(F.round(x.dots / norm / x.norms, 6).alias("score"), (-i).alias("rank")))
    found = near.join(more, ["_row", "_place"], "left").select("_row", "terms", "joined", F.array_max(cosines).alias("best")).filter(F.col("best.score") >= threshold)
    found = scratch.save(found.groupBy(F.col("_row").alias("_of")).agg(F.max("best").alias("hit"), F.greatest(*[F.coalesce(F.sum(F.when(F.col("joined") == j, F.col("terms"))), F.lit(0)) for j in (False, True)]).alias("_matched")), "found")
    few = found.count() <= _BROADCAST_ROWS
    names = F.array(*[F.lit(name) for name, _ in templates])
    hit, tag = F.col("hit"), F.col("_tag")
    matched = F.greatest(F.coalesce("_matched", F.lit(0)), "_tagged")
    own = rows.join(F.broadcast(found) if few else found, F.col("_row") == F.col("_of"), "left").select(
        *key_names, "_path", F.coalesce(tag, F.when(hit.isNotNull(), F.element_at(names, 1 - hit.rank))).alias("own_license"), F.when(tag.isNotNull(), F.lit(1.0)).otherwise(hit.score).alias("score"),
        F.when(tag.isNotNull() | hit.isNotNull(), (matched * 2 >= F.col("_terms")) | F.col("_path").rlike(LICENCE_NAME)).otherwise(F.lit(False)).alias("is_license_file"), F.regexp_replace("_path", "/?[^/]*$", "").alias("_dir"),
    )
    return _inherited(scratch.save(own, "own"), key_cols)


def _frequencies(files: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``term, files``: the number of files that hold each wanted term."""
    wanted = scratch.save(wanted, "wanted")
    each = files.select(F.explode(F.array_distinct("own")).alias("term"))
    count = wanted.count()
    if count <= _BROADCAST_ROWS:
        each = each.join(F.broadcast(wanted), "term", "left_semi")
    counts = each.groupBy("term").agg(F.count("*").alias("files"))
    return scratch.save(counts if count <= _BROADCAST_ROWS else counts.join(wanted, "term", "left_semi"), "frequencies")


def _inherited(own: DataFrame, key_cols: tuple[str, ...]) -> DataFrame:
    """Adds what files without a notice get from the nearest directory above them."""
    speaks = own.filter("is_license_file").groupBy(F.col("_dir").alias("from_dir")).agg(F.min(F.struct("_path", "own_license")).alias("m")).select("from_dir", F.col("m.own_license").alias("_given"))
    wanting = own.filter("own_license IS NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    near = wanting.select("_dir", F.explode(F.array_distinct(above)).alias("from_dir")).join(speaks, "from_dir")
    near = near.groupBy("_dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "_given")).alias("n"))
    near = near.select(F.col("_dir").alias("_for"), F.col("n.from_dir").alias("from_dir"), F.col("n._given").alias("_given"))
    few = near.count() <= _BROADCAST_DIRS
    out = own.join(F.broadcast(near) if few else near, own["own_license"].isNull() & (F.col("_dir") == F.col("_for")), "left")
    how = F.when(F.col("own_license").isNotNull(), "own").when(F.col("_given").isNotNull(), "inherited").otherwise("none")
    return out.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(key_cols)], F.col("_path").alias("path"), "own_license", "score", "is_license_file", F.coalesce("own_license", "_given").alias("license"), how.alias("how"), "from_dir")
