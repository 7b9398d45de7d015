"""Licence scans in DataFrame operations alone: Dice coefficient over word bigrams against licence templates.

A licence may stand anywhere in a text: passages of normalised words, whatever lines they run over, are compared with
templates. Size bounds say how many of a template's bigrams a passage must hold and how long it may be; most texts lack
the bigrams without which no passage can hold so many, and go at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.llm.common import let

#: Dice coefficient from which a passage is a licence's.
DICE = 0.8

# Licence notices and short licence texts, as their publishers word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def words(text: Column) -> Column:
    """Normalised words: lower case, cut at everything but letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(found: Column) -> Column:
    """Hashes of neighbouring words, in order."""
    pairs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))
    many = let(F.transform(found, lambda w: F.xxhash64(w)), pairs)
    return F.when(F.size(found) >= 2, many).otherwise(F.array().cast("array<bigint>"))


def bounds(templates=TEMPLATES, least: float = DICE) -> list[tuple[int, str, str, int, int, int, list[str]]]:
    """(template, licence, wording, distinct bigrams, how many of them a passage must hold, bigrams it may span, bigrams
    of which it must hold one) of each template."""
    out = []
    for i, (name, wording) in enumerate(templates):
        w = [x for x in re.split(r"[^\w]+|_", wording.lower()) if x]
        each = [" ".join(p) for p in zip(w, w[1:])]
        grams = list(dict.fromkeys(each))
        need = -int(-round(least * len(grams) / (2 - least), 6) // 1)
        # a passage that holds `need` of the bigrams holds one of any others than need - 1; long words are rare ones
        rare = sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - need + 1]
        out.append((i, name, wording, len(grams), need, int(round(len(each) * (2 - least) / least, 6)), rare))
    return out


def scan(docs: DataFrame, templates=TEMPLATES, *, least: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice, begin, n_words: one row per document and licence found in it, with its best passage (word
    places; ties to the earlier, then the shorter one).

    A passage begins with a bigram of the template that none precedes, ends with one, and spans at most as many bigrams
    as the template has, over its size bound. Its size counts the template's bigrams in it once, others wherever they
    stand. Null and empty texts and texts of one word hold no licence; null ids are kept; rows that repeat an id count
    together; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    fixed = bounds(templates, least)
    listed = spark.createDataFrame([x[:6] for x in fixed], "template int, license string, wording string, n_template int, need int, reach int")
    grams = bigrams(words(F.col("wording")))
    listed = listed.select("template", "license", "n_template", "need", "reach", F.explode(F.array_distinct(grams)).alias("gram"))
    rare = F.array(*[F.xxhash64(*[F.xxhash64(F.lit(w)) for w in g.split(" ")]) for g in sorted({g for x in fixed for g in x[6]})])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("mark"), bigrams(words(text)).alias("grams"))
    own = own.where(F.arrays_overlap("grams", rare))
    # the templates are a fixed list
    hits = own.select("doc_id", "key", "mark", F.posexplode("grams").alias("at", "gram")).join(F.broadcast(listed), "gram")
    by = ["key", "mark", "doc_id", "template", "license", "n_template", "need", "reach"]
    # a document's hits are fewer than its words
    hits = hits.distinct().groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "gram"))).alias("hits"))
    starts = F.filter(
        F.transform("hits", lambda x, i: F.struct(x["at"].alias("begin"), i.alias("i"))),
        lambda x: ((x["i"] == 0) | (F.get("hits", x["i"] - 1)["at"] < x["begin"] - 1)) & (F.get("hits", x["i"] + F.col("need") - 1)["at"] < x["begin"] + F.col("reach")),
    )
    near = hits.where(F.size("hits") >= F.col("need")).select("*", F.explode(starts).alias("s"))
    inside = F.filter(F.slice("hits", F.col("s.i") + 1, F.col("reach")), lambda x: x["at"] < F.col("s.begin") + F.col("reach"))
    passage = near.select(*by, F.col("s.begin").alias("begin"), F.explode(inside).alias("x")).select(*by, "begin", F.col("x.at").alias("at"), F.col("x.gram").alias("gram"))
    at_start = Window.partitionBy("key", "mark", "template", "begin")
    once = (F.row_number().over(at_start.partitionBy("key", "mark", "template", "begin", "gram").orderBy("at")) == 1).cast("int")
    run = at_start.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = passage.withColumn("once", once).withColumns({"n": F.sum("once").over(run), "k": F.count(F.lit(1)).over(run)})
    size = F.col("at") - F.col("begin") + 1 - F.col("k") + F.col("n")
    dice = counted.withColumn("dice", F.round(2.0 * F.col("n") / (size + F.col("n_template")), 6)).where(F.col("dice") >= least)
    best = dice.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.max(F.struct("dice", (-F.col("begin")).alias("b"), (-F.col("at")).alias("e"))).alias("best"))
    return best.select("doc_id", "license", "dice", (-F.col("best.b")).cast("long").alias("begin"), (F.col("best.b") - F.col("best.e") + 2).cast("long").alias("n_words"))
