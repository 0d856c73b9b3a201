"""Licence scan by a positional index of rare licence words, in DataFrame functions alone."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.session import saved

#: What is no part of a word, A-Z having been lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, mandatory key phrases, notice), from the public texts of the licences.
TEMPLATES = [
    ("apache-2.0", ["apache license version 2 0"], "licensed under the apache license version 2 0"),
    ("apache-2.0", ["apache license version 2 0", "in compliance with the license"],
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
     "the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
     "license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", ["mit license"], "released under the mit license"),
    ("mit", ["permission is hereby granted free of charge", "the software is provided as is"],
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
     "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
     "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any "
     "kind express or implied"),
    ("gpl-2.0", ["gnu general public license version 2"], "under the gnu general public license version 2"),
    ("gpl-3.0", ["gnu general public license version 3"], "under the gnu general public license version 3"),
    ("gpl-2.0", ["free software foundation either version 2 of the license"],
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", ["free software foundation either version 3 of the license"],
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation either version 3 of the license or at your option any later version"),
    ("bsd-2-clause", ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"],
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary "
     "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", ["neither the name of", "endorse or promote products derived from this software"],
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission"),
    ("isc", ["permission to use copy modify and or distribute this software"],
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
     "notice and this permission notice appear in all copies"),
    ("mpl-2.0", ["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl-2.1", ["gnu lesser general public license", "either version 2 1 of the license"],
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
     "software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3.0", ["gnu affero general public license"],
     "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
     "software foundation either version 3 of the license or at your option any later version"),
    ("bsl-1.0", ["any person or organization obtaining a copy"],
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
     "license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("zlib", ["held liable for any damages", "alter it and redistribute it freely"],
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of "
     "this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it "
     "freely subject to the following restrictions"),
    ("epl-2.0", ["eclipse public license"], "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0-1.0", ["related and neighboring rights"],
     "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc-by-4.0", ["cc by 4 0"], "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", ["cc by sa 4 0"], "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", ["cc by nc 4 0"], "licensed under cc by nc 4 0"),
    ("unlicense", ["released into the public domain"], "this is free and unencumbered software released into the public domain"),
]
#: Identifiers of the public licence list, as words, with their labels; the tag before them makes the phrase.
SPDX = {
    "apache 2 0": "apache-2.0", "mit": "mit", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3.0", "agpl 3 0": "agpl-3.0", "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause", "isc": "isc", "mpl 2 0": "mpl-2.0", "epl 2 0": "epl-2.0", "bsl 1 0": "bsl-1.0", "zlib": "zlib", "cc0 1 0": "cc0-1.0", "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0", "cc by nc 4 0": "cc-by-nc-4.0", "unlicense": "unlicense",
}
TEMPLATES += [(label, [f"spdx license identifier {words}"], f"spdx license identifier {words}") for words, label in SPDX.items()]

#: Words too common in prose to be looked up.
COMMON = "a all an and any are as at be been by can for form from in is it its no not of on or other that the their this to under use was with you your".split()


def _rows(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table, made by a literal."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _phrases() -> list[str]:
    return list(dict.fromkeys([*BASE, *(p for _, keys, _ in TEMPLATES for p in keys)]))


def _keys() -> list[dict]:
    """Where each template has its mandatory phrases."""
    out = []
    for t, (_, keys, text) in enumerate(TEMPLATES):
        for k in keys:
            at = len(re.match(rf"(?:.*? )?(?={k}\b)", text).group().split())
            out.append({"template": t, "phrase": _phrases().index(k), "at": at, "keys": len(keys)})
    return out


def _index(words: DataFrame) -> dict[str, str]:
    """The rarest word of each phrase, by documents that hold it (ties: first by name), of those that are not common.

    words has a column _words. A document without a phrase's rarest word does not hold the phrase, whatever the others do,
    so that looking up rare words alone loses none."""
    known = sorted({w for p in _phrases() for w in p.split()} - set(COMMON))
    held = words.select(F.explode(F.array_distinct(F.filter("_words", lambda w: w.isin(known)))).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    docs = {r["word"]: r["docs"] for r in held.collect()}  # some hundred words at most
    return {p: min(set(p.split()) - set(COMMON), key=lambda w: (docs.get(w, 0), w)) for p in _phrases()}


def _places(words: Column, index: dict[str, str]) -> Column:
    """phrase (its number) and at (its first word) of every place where a phrase stands: each place of a rare word is
    looked up for the phrases that it stands for, and these are compared."""
    by_word: dict[str, list[Column]] = {}
    for n, p in enumerate(_phrases()):
        own = p.split()
        for off in (i for i, w in enumerate(own) if w == index[p]):
            by_word.setdefault(index[p], []).append(F.struct(F.lit(n).alias("phrase"), F.lit(off).alias("off"), F.lit(own).alias("own")))
    postings = F.create_map(*[x for w, own in by_word.items() for x in (F.lit(w), F.array(*own))])
    rare = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(by_word)), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    stands = lambda r: lambda p: (r["at"] >= p["off"]) & (F.slice(words, F.greatest(r["at"] - p["off"], F.lit(0)) + 1, F.size(p["own"])) == p["own"])
    found = lambda r: F.transform(F.filter(F.element_at(postings, r["word"]), stands(r)), lambda p: F.struct(p["phrase"].alias("phrase"), (r["at"] - p["off"]).alias("at")))
    return F.array_distinct(F.flatten(F.transform(rare, found)))


def scan(docs: DataFrame, slack: int = 16) -> DataFrame:
    """Licence labels of all whole texts.

    docs needs doc_id and text; other columns are ignored, whatever their names. Each mandatory phrase is indexed, with its
    positions in the templates, by its word of highest inverse document frequency over all documents. A document's words
    are looked up there, and the phrases compared where they were hit. A phrase's place says where a template would begin;
    a template is found when all its mandatory phrases say so within one of the windows of 2 * slack words that begin at
    multiples of slack. So a template whose phrases stand at their distances within slack words is found whatever other
    documents hold, and one with a single phrase wherever it stands. Returns a row for each input row: doc_id, n_words,
    n_base, first_word, last_word, base_labels, labels (both sorted arrays), score (half for a base phrase, half times the
    largest share of a found template's words that stand about where it does).

    Null and empty texts have no words, no labels and score 0; a null doc_id stays null; repeated rows are labelled
    alike; equal rarity goes by the word itself. No rows, no result rows.
    """
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), lambda w: w != "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("_words"))
    own = own.withColumn("places", _places(F.col("_words"), _index(own))).select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), "places", F.when(F.size("places") > 0, F.col("_words")).alias("words"), F.monotonically_increasing_id().alias("row"))
    own = saved(own, "licence-words", compression="zstd")
    n_base = len(BASE)
    base = F.filter("places", lambda p: p["phrase"] < n_base)
    base_labels = F.lit(list(BASE.values()))

    keys = _rows(own, _keys(), "template:int,phrase:int,at:int,keys:int")
    found = own.where(F.size("places") > 0).select("row", F.inline("places")).withColumnRenamed("at", "pos")
    begins = found.join(F.broadcast(keys), "phrase").withColumn("begin", F.col("pos") - F.col("at"))
    bins = begins.withColumn("bin", F.explode(F.array(F.floor(F.col("begin") / slack), F.floor(F.col("begin") / slack) + 1)))
    met = bins.groupBy("row", "template", "bin", "keys").agg(F.count_distinct("phrase").alias("met"), F.min("begin").alias("begin")).where("met = keys")
    names = _rows(own, [{"template": t, "label": label, "own": sorted(set(text.split()) - set(COMMON)), "long": len(text.split())} for t, (label, _, text) in enumerate(TEMPLATES)],
                  "template:int,label:string,own:array<string>,long:int")
    around = F.slice("words", F.greatest(F.col("begin") - slack, F.lit(0)).cast("int") + 1, F.col("long") + 3 * slack)
    share = F.size(F.array_intersect(around, "own")) / F.size("own")
    labelled = met.join(F.broadcast(names), "template").join(own.where(F.size("places") > 0).select("row", "words"), "row").groupBy("row").agg(F.collect_set("label").alias("found"), F.max(share).alias("share"))
    base_found = F.array_sort(F.array_distinct(F.transform(base, lambda p: F.get(base_labels, p["phrase"]))))
    ats = F.transform(base, lambda p: p["at"])
    return own.join(labelled, "row", "left").select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(ats).cast("long").alias("first_word"), F.array_max(ats).cast("long").alias("last_word"),
        base_found.alias("base_labels"), F.array_sort(F.array_union(base_found, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        (F.when(F.size(base) > 0, 0.5).otherwise(0.0) + F.coalesce("share", F.lit(0.0)) * 0.5).alias("score"))
