"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Built-in DataFrame functions only; every step up to the last small aggregate is
narrow. A notice of m five-word shingles is looked for in windows of
m + s - 1 shingles that begin every s = max(2, m / 4) shingles, so wherever it
stands, one window holds all of it. The window's Jaccard similarity with a whole
notice is at least m / (m + s - 1), 0.5 in the worst case of m = 1, and BANDS
bands of one MinHash each miss it with probability 0.5**BANDS, under 2e-5.
A window and a notice can only share a band if the notice's own minimal shingle
is in the window, so windows without any such shingle (nearly all) are left out
before their signatures are made: no band match is lost by that. Each pair that
a band retrieves is verified: at least SIMILARITY of the notice's shingles must
be in the window.

Null and empty texts hold nothing; a null doc_id is kept as a group of its own;
repeated rows count once each in `windows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.runtime import plain

SHINGLE, BANDS, SIMILARITY, TEMPLATES_MAX = 5, 16, 0.8, 1000
_SIGNS = ",;:()[]{}\"'!?*#"
_STOPS = r"[.]+([ \t-\r]|\z)"  # full stops at the end of a word
#: Notices and grants as their licences word them.
NOTICES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
    "notice appear in all copies.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
    "version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def _held(df: DataFrame, name: str, made: Column) -> DataFrame:
    """df with a column that is made once a row: through a generator, as the optimizer would write it out anew within each lambda that uses it."""
    return df.select("*", F.explode(F.array(made)).alias(name))


def _words(text: Column) -> Column:
    clean = F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), _SIGNS, " " * len(_SIGNS)), F.lit(" \t\n\v\f\r"))
    return F.split(F.btrim(F.regexp_replace(clean, _STOPS, "$1"), F.lit(" \t\n\v\f\r")), r"[ \t-\r]+")


def _shingles(words: Column) -> Column:
    n = F.size(words) - SHINGLE
    made = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(n >= 0, made).otherwise(F.array().cast("array<bigint>"))


def _least(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))


def _signature(shingles: Column) -> Column:
    """The band number and the smallest hash of the shingles, for each band."""
    return F.array(*[F.struct(F.lit(k).alias("band"), _least(shingles, k).alias("least")) for k in range(BANDS)])


def _windows(m: int) -> Column:
    """The windows for notices of m shingles that hold one of `hits`."""
    step = max(2, m // 4)
    length = m + step - 1

    def starts(p: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.ceil((p - (length - 1)) / step).cast("int")), F.floor(p / step).cast("int"))

    every = F.array_distinct(F.flatten(F.transform("hits", starts)))
    return F.transform(every, lambda q: F.struct(F.lit(m).alias("m"), (q * step).alias("start"), F.lit(length).alias("length")))


def _templates(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in notices.items()])
    t = _held(spark.range(1).select(F.inline(rows)), "words", _words(F.col("text")))
    return _held(t, "shingles", F.array_distinct(_shingles(F.col("words")))).select("license", "shingles").where(F.size("shingles") > 0)


def find_notices(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, license, containment, first_word, windows): the best window's share, the first's place, how many match."""
    if not 0 < len(notices) <= TEMPLATES_MAX:
        raise ValueError(f"1 to {TEMPLATES_MAX} notices")
    spark = docs.sparkSession
    templates = _templates(spark, notices)
    if lacking := sorted(set(notices) - {r["license"] for r in templates.select("license").collect()}):
        raise ValueError(f"notices of fewer than {SHINGLE} words can't be told from chance: {lacking}")
    known = templates.withColumn("signature", _signature(F.col("shingles"))).collect()  # TEMPLATES_MAX rows at most
    least = {(b["band"], b["least"]) for r in known for b in r["signature"]}
    hashes = templates.select(F.explode("shingles").alias("x")).distinct().select("x", _signature(F.array("x")).alias("s")).collect()
    minimal = sorted({r["x"] for r in hashes for b in r["s"] if (b["band"], b["least"]) in least})

    own = _held(plain(docs, "doc_id", "text"), "words", _words(F.col("text"))).select("doc_id", "words")
    own = _held(own, "shingles", _shingles(F.col("words"))).select("doc_id", "shingles").where(F.size("shingles") > 0)
    at = F.sequence(F.lit(0), F.size("shingles") - 1)
    own = _held(own, "hits", F.filter(at, lambda i: F.get("shingles", i).isin(minimal))).where(F.size("hits") > 0)
    windows = [_windows(m) for m in sorted({len(r["shingles"]) for r in known})]
    cut = own.select("doc_id", "shingles", F.explode(F.concat(*windows)).alias("w"))
    cut = _held(cut, "window", F.slice("shingles", F.col("w.start") + 1, F.col("w.length"))).select("doc_id", "w.m", "w.start", "window")
    banded = cut.select("doc_id", "m", "start", "window", F.explode(_signature(F.col("window"))).alias("b"))
    bands = templates.select("license", "shingles", F.size("shingles").alias("m"), F.explode(_signature(F.col("shingles"))).alias("t"))
    bands = bands.select("license", "shingles", "m", F.col("t.band").alias("band"), F.col("t.least").alias("least"))
    met = banded.select("doc_id", "m", "start", "window", F.col("b.band").alias("band"), F.col("b.least").alias("least")).join(F.broadcast(bands), ["m", "band", "least"])  # TEMPLATES_MAX * BANDS rows at most
    share = F.size(F.array_intersect("shingles", "window")) / F.col("m")
    met = met.select("doc_id", "license", "start", "band", share.alias("share")).where(F.col("share") >= SIMILARITY)
    once = met.groupBy("doc_id", "license", "start").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count("*").alias("windows"))
