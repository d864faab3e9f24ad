"""Licence detection with a positional index of rare words (operator 9, native).

The templates are short phrases that must stand whole, and licence texts with a key phrase. For a template's words of
highest inverse document frequency over all templates, an index has postings (template, position). A document's words are
looked up in it; a hit at word i with posting (t, p) proposes template t at word i - p. The postings of a
proposed place are intersected by relative position: at least ``need`` of the template's rare words must stand where they do in the
template. Then the key phrase is verified word by word at its relative place. The index is a constant of the plan: its
size is that of the template list.

Everything is SQL functions over one row: no shuffle, no join, no Python.

Base phrases are looked for literally. The method adds labels from further phrases and texts of well-known licences.

Defined results: a null text counts as empty; no words means no places, empty labels and a score of 0; very long texts are
read whole. A place's score is the share of the template's words that stand at their relative place, times the template's
weight (1 for base phrases, 1 - 1 / words for others); a document's is that of its best place. A text whose place would
begin before the document is not found by that place. Repeated rows each get their row, null doc_ids too; other columns pass, but for
``n_words`` and ``places``, which give way. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, lower_ascii, unused

#: Word separators: every ASCII character but digits and a-z; text is lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
METHOD = (
    ("permission is hereby granted free of charge to any person", "mit"),
    ("the software is provided as is without warranty of any kind", "mit"),
    ("licensed under the apache license", "apache-2"),
    ("www apache org licenses license 2 0", "apache-2"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("eclipse public license", "epl"),
)
# Licence texts (or the notices that stand in files), with the phrase that must be there and the label.
TEXTS = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "to deal in the software without restriction", "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "you may not use this file except in compliance with the license", "apache-2",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "are permitted provided that the following conditions are met", "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS.",
        "for any purpose with or without fee is hereby granted", "isc",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "under the terms of the gnu general public license", "gpl",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
        "subject to the terms of the mozilla public license", "mpl",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "in no event will the authors be held liable for any damages", "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered software released into the public domain", "unlicense",
    ),
)
#: Rare words of a phrase and of a text that go into the index.
RARE, RARE_OF_TEXT = 2, 8


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]


def templates(base=BASE, method=METHOD, texts=TEXTS) -> list[dict]:
    """Templates with their words, key phrase (place and length), indexed (rare) positions, how many must be there, and weight."""
    out = [{"words": _words(p), "label": label, "base": i < len(base), "key": (0, len(_words(p))), "rare_words": RARE} for i, (p, label) in enumerate((*base, *method))]
    for text, key, label in texts:
        words, key = _words(text), _words(key)
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append({"words": words, "label": label, "base": False, "key": (at, len(key)), "rare_words": RARE_OF_TEXT})
    df = Counter(w for t in out for w in set(t["words"]))
    for t in out:
        idf = {w: math.log(1 + len(out) / df[w]) for w in t["words"]}
        n = len(t["words"])
        # Highest inverse document frequency first; of equals the longer, thus rarer, word.
        t["rare"] = sorted(sorted(range(n), key=lambda i: (-idf[t["words"][i]], -len(t["words"][i]), i))[: t["rare_words"]])
        t["need"] = len(t["rare"]) if t["rare_words"] == RARE else -(-len(t["rare"]) // 2)
        t["weight"] = 1.0 if t["base"] else round(1 - 1 / n, 4)
    return out


def scan(docs: DataFrame, text: str = "text", base=BASE, method=METHOD, texts=TEXTS) -> DataFrame:
    """``docs`` with n_words and ``places``: array of (start, template number, score), each verified, sorted."""
    known = templates(base, method, texts)
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(known):
        for p in t["rare"]:
            postings.setdefault(t["words"][p], []).append((number, p))
    index = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    table = F.array(*[
        F.struct(
            F.array(*map(F.lit, t["words"])).alias("words"), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t["words"][p]).alias("w")) for p in t["rare"]]).alias("rare"),
            F.lit(t["need"]).alias("need"), F.lit(t["key"][0]).alias("key_at"), F.array(*map(F.lit, t["words"][t["key"][0] : sum(t["key"])])).alias("key"), F.lit(t["weight"]).alias("weight"),
        )
        for t in known
    ])
    none = F.array().cast("array<struct<start:int,t:int,score:double>>")
    column = unused("__scan", docs.columns)

    def places(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(list(postings)))

        def propose(h: Column) -> Column:  # template and start in one number
            return F.transform(F.element_at(index, h["w"]), lambda x: x["t"].cast("long") * (1 << 32) + (h["i"] - x["p"]).cast("long") + (1 << 31))

        proposed = F.array_distinct(F.flatten(F.transform(hits, propose)))

        def judged(c: Column) -> Column:
            t, start = F.floor(c / (1 << 32)).cast("int"), (F.pmod(c, F.lit(1 << 32)) - (1 << 31)).cast("int")

            def of(x: Column) -> Column:  # x: start, number and template
                here = lambda at: F.get(words, x["start"] + at)
                meet = F.size(F.filter(x["template"]["rare"], lambda r: here(r["p"]).eqNullSafe(r["w"]))) >= x["template"]["need"]
                whole = F.slice(words, x["start"] + x["template"]["key_at"] + 1, F.size(x["template"]["key"])) == x["template"]["key"]
                same = F.size(F.filter(F.transform(x["template"]["words"], lambda w, j: here(j).eqNullSafe(w)), lambda y: y))
                score = F.round(same / F.size(x["template"]["words"]) * x["template"]["weight"], 6)
                return F.when((x["start"] >= 0) & meet, F.when(whole, F.struct(x["start"].alias("start"), x["t"].alias("t"), score.alias("score"))))

            return let(F.struct(start.alias("start"), t.alias("t"), F.element_at(table, t + 1).alias("template")), of)

        return F.array_sort(F.filter(F.transform(proposed, judged), lambda x: x.isNotNull()))

    def of(raw: Column) -> Column:
        n = F.size(raw) - (F.element_at(raw, 1) == "").cast("int") - ((F.size(raw) > 1) & (F.element_at(raw, -1) == "")).cast("int")
        some = F.exists(raw, lambda w: w.isin(list(postings)))
        return F.struct(n.cast("long").alias("n_words"), F.when(some, let(F.filter(raw, lambda w: w != ""), places)).otherwise(none).alias("places"))

    found = let(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), SEPARATORS, -1), of)
    return docs.withColumn(column, found).withColumns({"n_words": F.col(f"{column}.n_words"), "places": F.col(f"{column}.places")}).drop(column)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = templates()
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    labels = F.array(*[F.lit(t["label"]) for t in known])
    base = F.filter("places", lambda x: x["t"] < len(BASE))
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: F.element_at(labels, x["t"] + 1)))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"].cast("long"))).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"].cast("long"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    words = lambda ws: "[" + ", ".join(map(repr, ws)) + "]"
    rows = ",\n    ".join(
        f"({i}, '{t['label']}', {words(t['words'])}, {t['need']}, {t['key'][0]}, {words(t['words'][t['key'][0] : sum(t['key'])])}, {t['weight']})" for i, t in enumerate(templates())
    )
    rare = ", ".join(f"({i}, {p}, '{t['words'][p]}')" for i, t in enumerate(templates()) for p in t["rare"])
    return f"""
WITH templates(t, label, words, need, key_at, key, weight) AS (
  VALUES
    {rows}
), rare(t, p, word) AS (VALUES {rare}),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
), seen AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), places AS (
  SELECT doc_id, t, i - p AS start, count(*) AS m FROM seen JOIN rare USING (word) WHERE i >= p GROUP BY ALL
), hits AS (
  SELECT doc_id, t, label, start, round(list_sum(list_transform(range(1, len(words) + 1), lambda j: CASE WHEN w[start + j] = words[j] THEN 1 ELSE 0 END)) / len(words) * weight, 6) AS score
  FROM places JOIN templates USING (t) JOIN d USING (doc_id) WHERE m >= need AND w[start + key_at + 1 : start + key_at + len(key)] = key
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(h.t) FILTER (h.t < {len(BASE)}) AS n_base,
  CAST(min(h.start) FILTER (h.t < {len(BASE)}) AS BIGINT) AS first_word, CAST(max(h.start) FILTER (h.t < {len(BASE)}) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label) FILTER (h.t < {len(BASE)}), '') AS base_labels,
  coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '') AS labels,
  coalesce(CAST(max(h.score) AS DOUBLE), 0) AS score
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id, d.w
"""


OP9_SQL = _sql()
