"""Licence scan: a paragraph classifier over sparse word n-grams, with an unknown class and template comparison.

A paragraph ends at a blank line or at a line that ends a sentence; lines that a notice was wrapped over are joined, without
the comment signs before them. Logistic regression (Spark ML, in the JVM) over hashed word 1- and 2-grams is trained here on
notices and licence sections of each family and on ordinary paragraphs of a bounded sample of documents. A binary model tells
notices from ordinary text; a multinomial one names the family of a notice, and what stays below its limit is `unknown`.
(One multinomial model for all paragraphs merges its sparse rows for every line, which took half of the time.) Both
limits are calibrated on what the models never saw: held-back ordinary paragraphs and forms of notices, and notices of
families that aren't trained, which are to stay unknown. A predicted family is confirmed where the paragraph's shingles of
five words meet a template of that family at CONTAINMENT or more, of either. Notices whose lines end sentences, among other
lines without a blank one between, are also found in blocks of non-blank lines, by templates alone.

Paragraphs are counted where they stand, without a shuffle; documents' results are collected by document only.

Defined results: null and empty texts have no paragraphs and no families; paragraphs without words are not classified; a
null doc_id stays null; repeated rows are scanned alike, each with a row of its own; columns other than doc_id and text are
never read. A paragraph of two families with equal probability gets the first of them.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import numbered, scanned, unit_hash

DIM = 1 << 14
CONTAINMENT = 0.8
SHINGLE = 5
#: Bounds of the sample of ordinary paragraphs: how many, characters of a document (longer ones aren't used).
ORDINARY_PARAGRAPHS, LONGEST = 4000, 6000
#: Share of ordinary paragraphs that may pass for notices, and of notices of untrained families that may get a name.
PASS, NAMED = 0.001, 0.1
# Notices and licence sections of each family, as published.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
        "Licensed under CC BY-SA 4.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "SPDX-License-Identifier: ISC",
    ),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 Example Corporation. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. No part of this document may be reproduced without prior written permission."),
}
# Notices of families that aren't trained; they calibrate the limit below which a notice is unknown.
UNTRAINED = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.",
    "Licensed under the European Union Public Licence, version 1.2 or later.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This is free and unencumbered software released into the public domain.",
    "Do what the fuck you want to public license, version 2.",
    "Licensed under the Open Data Commons Open Database License.",
    "The contents of this file are subject to the Common Development and Distribution License.",
    "This font software is licensed under the SIL Open Font License, version 1.1.",
    "Published under the Artistic License 2.0.",
)
#: Every template needs one of these words to be held at CONTAINMENT.
NEEDED = r"(?i)(?=[lsmcrp])(?:licen[sc]e|software|modification|conditions|rights|copying|prohibited|spdx|redistribut|copyright|mpl|reproduced)"
#: Paragraphs with one of these words aren't taken for ordinary ones in training.
LIKE_A_NOTICE = r"(?i)licen[sc]|rights|copyright|permission|redistribut|warrant|prohibited|confidential|mpl|as.is"
FAMILIES = ("none", *TEMPLATES)
LEADS = ("", "This document is ", "Note: ", "The text is ", "Copyright 2021. ")
TAILS = ("", " See LICENSE for details.", " Some terms apply.")


#: ASCII signs other than the full stop, one by one. Java looks single characters up in a table, but asks the ranges of a class
#: one after the other, which took most of the scan's time.
SIGNS = "[" + "".join(f"\\x{c:02x}" for c in range(0x7F) if not chr(c).isalnum() and chr(c) != ".") + "]"


def words_of(text: Column) -> Column:
    """Words between ASCII signs other than the full stop; the first and last may be empty."""
    return F.split(F.lower(text), SIGNS + "+")


def grams(words: Column) -> Column:
    """Word 1- and 2-grams."""
    two = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, two)


def shingles(words: Column, k: int = SHINGLE) -> Column:
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(many)


def template_words(template: str) -> list[str]:
    """words_of a template, without the empty ones."""
    return [w for w in re.split(SIGNS + "+", template.lower()) if w]


def template_shingles(*templates: str) -> Column:
    """The distinct shingles of templates, as a constant; Spark would work out lambdas over constants again for every row."""
    ws = [template_words(t) for t in templates]
    own = dict.fromkeys(" ".join(w[i : i + SHINGLE]) for w in ws for i in range(max(len(w) - SHINGLE + 1, 1)))
    return F.split(F.lit("\n".join(own)), "\n")


#: The end of a line within a sentence, up to the text of the next line: what stands between wrapped lines (white space one by one).
WRAP = r"([^ \t\n\x0b\f\r.!?:;])[ \t]*\r?\n[ \t]*(?:(?://+|#+|\*+|--+|;+|%+)[ \t]*)?(?=[^ \t\n\x0b\f\r])"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc columns id and rid, with a row for each paragraph: line."""
    joined = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), WRAP, "$1 ")
    return docs.select("rid", "doc_id", F.explode(F.split(joined, "\n")).alias("line"))


class Scanner:
    """The fitted pieces: a notice model, a family model, both over DIM features, and their calibrated limits."""

    def __init__(self, notices, families, notice_limit: float, family_limit: float):
        self.notices, self.families, self.notice_limit, self.family_limit = notices, families, notice_limit, family_limit


def _featured(lines: DataFrame) -> DataFrame:
    tf = HashingTF(numFeatures=DIM, inputCol="grams", outputCol="features", binary=True)
    return tf.transform(lines.withColumn("words", words_of(F.col("line"))).withColumn("grams", grams(F.col("words"))))


def _forms() -> list[tuple[str, float, bool]]:
    """(text, family, whether it is held back): each notice with leads and tails; a quarter of the forms is for calibration."""
    out = []
    for f, ts in TEMPLATES.items():
        for k, t in enumerate(ts):
            for i, lead in enumerate(LEADS):
                for j, tail in enumerate(TAILS):
                    out.append((lead + t + tail, float(FAMILIES.index(f)), (k + 2 * i + j) % 4 == 3))
    return out


def train(docs: DataFrame) -> Scanner:
    """Fit on notices and a bounded sample of paragraphs of documents that don't look like notices; the sample is chosen by hash."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    short = docs.where(F.length(text) <= LONGEST)
    share = min(1.0, ORDINARY_PARAGRAPHS / max(1, short.count()))
    some = paragraphs(short.where(unit_hash(F.col("doc_id"), "licences") < share).select(F.lit(0).alias("rid"), "doc_id", "text"))
    draw = F.xxhash64("line")
    fit_for = some.where(~F.col("line").rlike(LIKE_A_NOTICE) & (F.length("line") > 0)).select("line").distinct()
    plain = [(r[0], 0.0, k % 4 == 3) for k, r in enumerate(fit_for.orderBy(draw, "line").limit(ORDINARY_PARAGRAPHS).collect())]
    rows = [*_forms(), *plain, ("", 0.0, False), *[(t, -1.0, True) for t in UNTRAINED]]
    data = _featured(spark.createDataFrame(rows, "line string, label double, held boolean").repartition(1)).select("line", "label", "held", "features").cache()
    two = data.where("label >= 0").withColumn("label", (F.col("label") > 0).cast("double"))
    notices = LogisticRegression(maxIter=25, regParam=1e-4, probabilityCol="p_notice", rawPredictionCol="raw_notice", predictionCol="is_notice").fit(two.where("not held"))
    many = data.where("label > 0").withColumn("label", F.col("label") - 1)
    families = LogisticRegression(maxIter=25, regParam=1e-4, family="multinomial", probabilityCol="p_family", rawPredictionCol="raw_family", predictionCol="n_family").fit(many.where("not held"))
    p = notices.transform(two.where("held")).select("label", _second("p_notice").alias("p"))
    most = p.where("label = 0").agg(F.percentile("p", 1 - PASS)).first()[0] or 0.0
    least = p.where("label = 1").agg(F.percentile("p", 0.02)).first()[0]
    best = lambda rows: families.transform(rows).select(F.array_max(vector_to_array("p_family")).alias("q"))
    strange = best(data.where("label < 0")).agg(F.percentile("q", 1 - NAMED)).first()[0]
    known = best(many.where("held")).agg(F.percentile("q", 0.05)).first()[0]
    data.unpersist()
    # Between what ordinary text reaches and what notices reach; ordinary text decides where they overlap.
    return Scanner(notices, families, max(0.5, most, (most + least) / 2), max(0.5, min(strange, known)))


def _second(vector: str) -> Column:
    return F.get(vector_to_array(vector), F.lit(1))


def confirmed(words: Column, family: Column) -> Column:
    """Whether a template of the family holds, or is held by, the paragraph's shingles at CONTAINMENT or more."""
    own = shingles(words)
    out = F.lit(False)
    for f, ts in TEMPLATES.items():
        hit = F.lit(False)
        for t in ts:
            theirs = template_shingles(t)
            shared = F.size(F.array_intersect(own, theirs))
            hit = hit | (shared >= CONTAINMENT * F.size(theirs)) | (shared >= CONTAINMENT * F.size(own)) | F.contains(F.array_join(words, " "), F.lit(" ".join(template_words(t.rstrip(".")))))
        out = F.when(family == f, hit).otherwise(out)
    return out


def classified(lines: DataFrame, scanner: Scanner) -> DataFrame:
    """rid, doc_id, line, family, p, confirmed for the paragraphs (rid, doc_id, line) that are no ordinary text: both models, and templates to confirm."""
    # The row number keeps Catalyst from moving the filter below the features, where it would compute them several times.
    scored = scanner.notices.transform(_featured(lines)).select("rid", "doc_id", "line", "words", "features", _second("p_notice").alias("notice"), F.monotonically_increasing_id().alias("row"))
    found = scored.where((F.col("notice") > scanner.notice_limit) & (F.col("row") >= 0)).drop("notice", "row")
    seen = scanner.families.transform(found).select("rid", "doc_id", "line", "words", vector_to_array("p_family").alias("ps"))
    best = F.array_max("ps")
    names = F.array(*[F.lit(f) for f in TEMPLATES])
    family = F.when(best >= scanner.family_limit, F.element_at(names, F.array_position("ps", best).cast("int"))).otherwise("unknown")
    named = seen.select("rid", "doc_id", "line", "words", family.alias("family"), best.alias("p"))
    words = F.filter("words", lambda w: w != "")
    return named.select("rid", "doc_id", "line", "family", "p", confirmed(words, F.col("family")).alias("confirmed"))


def scan_paragraphs(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """rid, doc_id, line, family, p, confirmed for paragraphs that are no ordinary text."""
    return classified(paragraphs(numbered(docs.select("doc_id", "text"))).where("line <> ''"), scanner)


def block_paragraphs(docs: DataFrame) -> DataFrame:
    """rid, doc_id, line: what blocks of two and more non-blank lines hold from the first to the last shingle of a family's templates.

    A wrapped notice stands over lines, among others that may be ordinary text; templates that a block holds at CONTAINMENT
    or more tell where to cut it out. What it is, the models decide.
    """
    rows = numbered(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")))
    rows = rows.select("rid", "doc_id", F.explode(F.split("body", r"\n\s*\n")).alias("block"))
    some = rows.where(F.contains(F.trim("block"), F.lit("\n")) & F.col("block").rlike(NEEDED))
    own = some.select("rid", "doc_id", F.filter(words_of(F.col("block")), lambda w: w != "").alias("words")).select("rid", "doc_id", "words", shingles(F.col("words")).alias("own"))
    # A block has few shingles of templates, or none; only those are compared with each template. (A filter on them would be
    # moved below the shingles, which would then split the block again for each of its words.)
    own = own.select("rid", "doc_id", "words", F.array_intersect("own", template_shingles(*[t for ts in TEMPLATES.values() for t in ts])).alias("own"))
    held = []
    for f, ts in TEMPLATES.items():
        hit = F.lit(False)
        for t in ts:
            theirs = template_shingles(t)
            # A line of few words is found as a line.
            hit = hit | ((F.size(theirs) > 1) & (F.size(F.array_intersect("own", theirs)) >= CONTAINMENT * F.size(theirs)))
        held.append(F.when(hit, F.lit(f)))
    by = own.select("rid", "doc_id", "words", F.explode(F.array_compact(F.array(*held))).alias("family"))
    theirs = F.lit(None).cast("array<string>")
    for f, ts in TEMPLATES.items():
        theirs = F.when(F.col("family") == f, template_shingles(*ts)).otherwise(theirs)
    n = F.size("words")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.array_contains("theirs", F.array_join(F.slice("words", i, SHINGLE), " ")))
    cut = by.withColumn("theirs", theirs).withColumn("starts", starts)
    first, last = F.element_at("starts", 1), F.element_at("starts", -1)
    return cut.select("rid", "doc_id", F.array_join(F.slice("words", first, last - first + SHINGLE), " ").alias("line"))


def scan_blocks(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """rid, family of the notices in blocks that the models name and a template confirms."""
    return classified(block_paragraphs(docs), scanner).where("confirmed").select("rid", "family")


def scan_licences(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, n_notices, n_confirmed, n_unknown, families (confirmed ones, sorted): one row for each row of docs.

    A family that the models find in a block of lines only counts as one notice, confirmed.
    """
    docs = scanned(docs)
    found = scan_paragraphs(docs, scanner)
    by = found.groupBy("rid").agg(
        F.count("*").alias("n_notices"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
        F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("by_line"),
    )
    wrapped = scan_blocks(docs, scanner).groupBy("rid").agg(F.collect_set("family").alias("by_block")).withColumnRenamed("rid", "b_rid")
    own = numbered(docs.select("doc_id"), "own_rid")
    none = F.array().cast("array<string>")
    line, block = F.coalesce("by_line", none), F.coalesce("by_block", none)
    more = {"n_notices": F.size(F.array_except(block, line)), "n_confirmed": F.size(F.array_except(block, line)), "n_unknown": F.lit(0)}
    return own.join(by, F.col("own_rid") == F.col("rid"), "left").join(wrapped, F.col("own_rid") == F.col("b_rid"), "left").select(
        "doc_id", *[(F.coalesce(c, F.lit(0)) + m).cast("long").alias(c) for c, m in more.items()], F.array_join(F.array_sort(F.array_union(line, block)), ",").alias("families")
    )
