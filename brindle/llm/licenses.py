"""License scans by diagonal voting, with DataFrame functions only.

All rolling k-word hashes of a document are joined to the places of the same hashes in templates. Hits of one document
and template vote for the diagonal (place in the document less place in the template); neighbouring diagonals merge,
and a merged span counts if its hits, verified word by word, cover enough of the template's words.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, written

K = 3
#: Diagonals this near belong together: so many words may be put in or left out between hits.
NEAR = 3
#: The least share of a template's words that hits must cover.
COVER = 0.9

#: Phrases of the base rule and their labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# Fixed texts: usual wordings of license notices, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    # whole texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, a-z and all beyond ASCII."""
    return F.regexp_extract_all(F.translate(text, LETTERS, LETTERS.lower()), F.lit(WORD), F.lit(0))


def _phrase_places(words: Column, phrase: list[str]) -> Column:
    first, *rest = phrase

    def here(x: Column, i: Column) -> Column:
        test = x == first
        for n, w in enumerate(rest, 1):
            test = test & F.coalesce(F.get(words, i + n) == w, F.lit(False))
        return F.when(test, i).otherwise(-1)

    may = F.array_contains(words, first)
    for w in rest:
        may = may & F.array_contains(words, w)
    return F.when(may, F.filter(F.transform(words, here), lambda i: i >= 0)).otherwise(F.array().cast("array<int>"))


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def template_rows(templates: list[tuple[str, str]]) -> list[tuple[int, str, int, int, str]]:
    """template, label, length, place, gram (text of K words): as many rows as the texts have words."""
    return [(t, label, len(w), p, " ".join(w[p : p + K])) for t, (label, text) in enumerate(templates) for w in [text.split()] for p in range(len(w) - K + 1)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: (label, text of lower-case words, K at least); a fixed list, sent to all. score: the largest share of a
    template's words that a span covers, 1 with a base label, else 0. Null and empty texts have no words; a null
    doc_id and repeated rows stay; an empty table gives none.
    """
    spark = docs.sparkSession
    w = F.col("w")
    texts = id_and_text(docs, id_col, text_col).select("doc_id", "text", words_of(F.col("text")).alias("w"))
    rows = template_rows(templates)
    known = sorted({x for *_, gram in rows for x in gram.split()})
    # a gram of other words than the templates' joins nothing: of the rolling grams only the rest is hashed
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0))), lambda i: F.coalesce(reduce(and_, [F.get("w", i + n).isin(known) for n in range(K)]), F.lit(False)))
    gram = F.transform(at, lambda i: F.struct(i.alias("at"), _hash([F.get("w", i + n) for n in range(K)]).alias("h"), F.concat_ws(" ", F.slice("w", i + 1, K)).alias("gram")))
    gram = F.filter(gram, lambda g: g["gram"].isin(sorted({g for *_, g in rows})))
    places = {label: _phrase_places(w, phrase.split()) for label, phrase in PHRASES.items()}
    read = texts.select("doc_id", "text", F.size("w").cast("long").alias("n_words"), gram.alias("grams"), *[p.alias(f"at_{i}") for i, p in enumerate(places.values())])
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(places))])
    labels = F.filter(F.array(*[F.when(F.size(f"at_{i}") > 0, label) for i, label in enumerate(places)]), lambda x: x.isNotNull())
    # written once, without the texts; equal texts have one key and are searched once
    read = read.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base"), "grams", F.when(F.size("grams") > 0, F.md5("text")).alias("key"),
    )
    read = written(read, "licenses")

    table = spark.createDataFrame(rows, "template int, label string, length int, place int, gram string")
    parts = F.split("gram", " ")
    table = table.withColumn("h", _hash([parts[i] for i in range(K)]))
    grams = read.where("key IS NOT NULL").select("key", F.explode("grams").alias("g")).select("key", "g.at", "g.h", "g.gram").distinct()
    # the words themselves must agree, not only their hashes
    hits = grams.join(F.broadcast(table), ["h", "gram"])
    diagonal = hits.groupBy("key", "template", "label", "length", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    # a span takes in the diagonals up to NEAR from its first one, no chains of them
    near = W.partitionBy("key", "template").orderBy("diagonal").rangeBetween(0, NEAR)
    spans = diagonal.withColumn("places", F.flatten(F.collect_list("places").over(near)))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    spans = spans.withColumn("cover", covered / F.col("length"))
    found = spans.groupBy("key").agg(F.collect_set(F.when(F.col("cover") >= COVER, F.col("label"))).alias("more"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    # rows without grams have no key, and would all meet in one task of the join
    kept = read.drop("grams")
    joined = kept.where("key IS NOT NULL").join(found, "key", "left").unionByName(kept.where("key IS NULL"), allowMissingColumns=True)
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
