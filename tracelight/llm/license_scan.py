"""Licence scans by a positional index of licence words. Native: DataFrame functions only.

Templates are notices of well-known licences. The index lists, for each of their words that is not a stop word,
where it stands in which template. The words' document frequencies over all files give their IDF. The word of highest IDF in
a template's mandatory key phrase opens the template's alignments (template, file position - template position): as the key
phrase must stand whole, no true alignment is without it. In files with an opened alignment, the postings of all licence words
are intersected by relative position, and an alignment counts only if all words of the key phrase stand in their places.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, let, lower_ascii, text_or_empty

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label of the base.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, notice, mandatory key phrase within it). The wording of the licences' own notices.
TEMPLATES = (
    ("mit", "Released under the MIT License", "MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""", "Permission is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "purpose with or without fee"),
    ("apache", "Licensed under the Apache License, Version 2.0", "Apache License"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied""", "Apache License"),
    ("gpl", "Licensed under the GNU General Public License version 3", "GNU General Public License"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License", "General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version""", "GNU General Public License"),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General Public License"),
    ("agpl", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided", "Redistribution and use in source"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer""", "Redistribution and use in source"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived"),
    ("cc-by", "licensed under CC BY 4.0", "CC BY 4 0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4 0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "CC BY SA"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License", "Attribution ShareAlike"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "CC BY NC"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License", "Attribution NonCommercial"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", "CC0 1 0 Universal"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License"),
    ("boost", "Distributed under the Boost Software License, Version 1.0", "Boost Software License"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Common words that the index leaves out unless a key phrase needs them.
STOP_WORDS = frozenset("a and any are for from in is it of or the this to under use with that be by as on an you may not at".split())
#: The share of a template's indexed words that an alignment must match.
LEAST_SHARE = 0.5


def split(text: str) -> list[str]:
    """The words of a notice, by the rule for files."""
    return [w for w in re.split(SEPARATOR, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def postings() -> list[tuple[str, int, int, bool]]:
    """(word, template, place, in key phrase) of the index."""
    out = []
    for t, (_, notice, key) in enumerate(TEMPLATES):
        words, wanted = split(notice), split(key)
        at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        out += [(w, t, i, at <= i < at + len(wanted)) for i, w in enumerate(words) if at <= i < at + len(wanted) or w not in STOP_WORDS]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """For each row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, alignments.

    ``alignments`` lists (template, start, matched) of what was found. ``score`` is the largest matched share of a
    found template, 0.5 for a base phrase alone, else 0. A null text is an empty one: no words, no labels (''),
    null first and last word. Null ids and repeated rows stay; other columns are not read; an empty table gives
    an empty result. The first pass writes only the hits on index words; all later steps are linear in
    those of files with an opened alignment, so a text full of licence words makes no pairs.
    """
    spark, index = docs.sparkSession, postings()
    vocabulary = sorted({w for w, *_ in index} | {w for p, _ in PHRASES for w in p.split()})
    words = F.filter(F.split(lower_ascii(text_or_empty(text_col)), SEPARATOR), lambda w: w != "")
    found = let(
        words,
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.array_compact(F.transform(ws, lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.cast("long").alias("pos"))))).alias("hits"),
        ),
    )
    rows = docs.select(F.col(id_col).alias("__id"), found.alias("f")).select(F.monotonically_increasing_id().alias("row"), "__id", "f.n_words", "f.hits")
    rows = Store(spark).put(rows)

    # one count for each word of the index
    files = {r.word: r.files for r in rows.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").agg(F.count("*").alias("files")).collect()}
    opener = {t: min((files.get(w, 0), w, i) for w, of, i, key in index if of == t and key) for t in range(len(TEMPLATES))}
    table = spark.createDataFrame([(w, t, i, key, opener[t][1:] == (w, i)) for w, t, i, key in index], "word string, template int, place int, is_key boolean, opens boolean")
    hits = rows.where(F.exists("hits", lambda h: h["word"].isin(sorted({w for _, w, _ in opener.values()})))).select("row", F.explode("hits").alias("h")).select("row", "h.word", "h.pos")
    sizes = {t: sum(x[1] == t for x in index) for t in range(len(TEMPLATES))}
    keys = {t: sum(x[1] == t and x[3] for x in index) for t in range(len(TEMPLATES))}
    each = lambda of: F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("template"))
    aligned = (
        hits.join(F.broadcast(table), "word")
        .groupBy("row", "template", (F.col("pos") - F.col("place")).alias("start"))
        .agg(F.count("*").alias("matched"), F.count_if("is_key").alias("key"), F.count_if("opens").alias("opened"))
        .where((F.col("opened") > 0) & (F.col("key") == each(keys)) & (F.col("matched") >= least_share * each(sizes)))
        .select("row", "template", "start", "matched", (F.col("matched") / each(sizes)).alias("share"))
    )
    label = each({t: x[0] for t, x in enumerate(TEMPLATES)})
    of_row = aligned.groupBy("row").agg(
        F.collect_set(label).alias("found"), F.max("share").alias("share"), F.array_sort(F.collect_list(F.struct("template", "start", "matched"))).alias("alignments")
    )

    def starts(phrase: str):
        parts = phrase.split()
        test = lambda h, i: F.forall(F.array(*(F.coalesce((F.get("hits", i + k)["word"] == w) & (F.get("hits", i + k)["pos"] == h["pos"] + k), F.lit(False)) for k, w in enumerate(parts))), lambda x: x)
        return F.transform(F.filter("hits", lambda h, i: (h["word"] == parts[0]) & test(h, i)), lambda h: h["pos"])

    base = rows.select("row", "__id", "n_words", *(starts(p).alias(f"s{k}") for k, (p, _) in enumerate(PHRASES)))
    places = F.concat(*(F.col(f"s{k}") for k in range(len(PHRASES))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"s{k}") > 0, F.lit(x)) for k, (_, x) in enumerate(PHRASES))))
    base = base.select("row", "__id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_sort(base_labels).alias("base_set"))
    return base.join(of_row, "row", "left").select(
        F.col("__id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.coalesce("share", F.when(F.col("n_base") > 0, F.lit(0.5)), F.lit(0.0)), 6).alias("score"),
        "alignments",
    )


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def sql() -> str:
    index = ", ".join(f"('{w}', {t}, {p}, {k})" for w, t, p, k in postings())
    labels = ", ".join(f"({t}, '{x[0]}', {sum(y[1] == t for y in postings())}, {sum(y[1] == t and y[3] for y in postings())})" for t, x in enumerate(TEMPLATES))
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{x}')" for p, x in PHRASES)
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
),
idx(word, template, place, is_key) AS (VALUES {index}),
tpl(template, label, n_words_t, n_key) AS (VALUES {labels}),
phr(phrase, label) AS (VALUES {phrases}),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
starts AS (
  SELECT w.doc_id, p.label, s.pos FROM w JOIN pos s ON s.doc_id = w.doc_id JOIN phr p ON s.word = p.phrase[1]
  WHERE list_slice(w.ws, s.pos + 1, s.pos + len(p.phrase)) = p.phrase
),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM starts GROUP BY doc_id),
hits AS (SELECT * FROM pos WHERE word IN (SELECT word FROM idx) OR word IN (SELECT unnest(phrase) FROM phr)),
aligned AS (
  SELECT h.doc_id, i.template, h.pos - i.place AS start, count(*) AS matched, count(*) FILTER (is_key) AS key FROM hits h JOIN idx i ON h.word = i.word GROUP BY ALL
),
good AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(matched / n_words_t) AS share
  FROM aligned JOIN tpl ON aligned.template = tpl.template WHERE key = n_key AND matched >= {LEAST_SHARE} * n_words_t GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found, [])))), ',') AS labels,
       round(coalesce(share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN good ON w.doc_id = good.doc_id
"""
