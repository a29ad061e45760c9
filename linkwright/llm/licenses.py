"""Operator 3, licence scans: a positional rare-token index, with DataFrame functions alone.

Licence templates are indexed by word: a posting says in which template and at which position the
word stands. A scan over the texts keeps, for each file, the places of indexed words and of the
key phrases. Inverse document frequencies of the indexed words come from all files. Each file then
looks up its rarest licence words, and every posting votes for (template, file position minus
template position); votes of one relative position are summed. A template's label is given
where enough of its weight agrees at one relative position and one of its mandatory key phrases
stands exactly where that position puts it.

The text is read once. What is shuffled are the votes of files that hold indexed words: numbers,
summed before the shuffle. The frequencies sent to the driver are one for each indexed word of
the fixed templates.

Defined cases: a null or empty text has no words, no places, no labels and score 0; repeated
files are scanned alike; columns other than the key and the text are not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Phrases whose places are the base scan, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of public licences, as words; the label, and the phrases of which one must stand in its place.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "released under the mit license", ("released under the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("as is basis without warranties or conditions of any kind",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("see the gnu general public license for more details",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("shall be included in all copies or substantial portions of the software",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy of the software and accompanying documentation",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain by waiving",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Words too common to be indexed.
COMMON_WORDS = frozenset("a all an and any are as at be by can each for from has if in into is it its may not of on one or that the this to under was which will with you your 0 2 3 4 v".split())
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class TemplateIndex:
    """Words of the templates, their postings, and the key phrases with their positions."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _, _ in templates]
        words = [text.split() for _, text, _ in templates]
        self.vocab = sorted({w for t in words for w in t} - COMMON_WORDS)
        self.postings = [[(t, p) for t, ws in enumerate(words) for p, w in enumerate(ws) if w == word] for word in self.vocab]
        self.indexed = [[self.vocab.index(w) for w in ws if w not in COMMON_WORDS] for ws in words]
        self.phrases = [tuple(x.split()) for x in BASE_PHRASES]
        self.phrase_postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, _, keys) in enumerate(templates):
            for key in keys:
                k = tuple(key.split())
                if k not in self.phrases:
                    self.phrases.append(k)
                for p in range(len(words[t])):
                    if tuple(words[t][p : p + len(k)]) == k:
                        self.phrase_postings.setdefault(self.phrases.index(k), []).append((t, p))


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def scan_words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")


def scan(docs: DataFrame, index: TemplateIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, n_words, hits (indexed word and place), places (phrase and place); one pass over the texts."""
    words = docs.select(F.col(key).alias("key"), scan_words(text).alias("words"))
    present = F.array_intersect("words", strings(index.vocab))
    # A text without an indexed word can only hold phrases that have none either.
    heads = strings(sorted({p[0] for p in index.phrases if not set(p) & set(index.vocab)}))
    table = words.select("key", "words", F.size("words").cast("long").alias("n_words"), present.alias("present"), F.arrays_overlap("words", heads).alias("may"))
    word_no = F.transform("present", lambda w: F.array_position(strings(index.vocab), w).cast("int") - 1)
    hits = F.when(
        F.size("present") > 0,
        F.transform(
            F.filter(F.transform("words", lambda w, i: F.struct(F.array_position("present", w).cast("int").alias("k"), i.alias("i"))), lambda x: x["k"] > 0),
            lambda x: F.struct(F.element_at("numbers", x["k"]).alias("w"), x["i"].alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<w:int,i:int>>"))

    def found(n: int, phrase: tuple[str, ...]) -> Column:
        def here(i: Column) -> Column:
            test = F.get("words", i) == phrase[0]
            for d, w in enumerate(phrase[1:], 1):
                test = test & (F.get("words", i + d) == w)
            return test

        all_in = F.array_contains("words", phrase[0]) & F.array_contains("words", phrase[-1])
        where = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        return F.when(all_in, F.transform(where, lambda i: F.struct(F.lit(n).alias("p"), i.alias("i")))).otherwise(F.array().cast("array<struct<p:int,i:int>>"))

    places = F.when((F.size("present") > 0) | F.col("may"), F.concat(*(found(n, p) for n, p in enumerate(index.phrases)))).otherwise(F.array().cast("array<struct<p:int,i:int>>"))
    table = table.withColumn("numbers", word_no)
    return table.select(F.monotonically_increasing_id().alias("row"), "key", "n_words", hits.alias("hits"), places.alias("places"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", rarest: int = 16, agree: float = 0.5, least: int = 3, templates=TEMPLATES) -> DataFrame:
    """key, n_words, places (of base phrases), base_labels, labels, score; labels as sorted arrays.

    ``rarest`` licence words of a file are looked up; a template needs ``least`` of them, or all it
    has, and ``agree`` of its weight at one relative position. score is the best such share, key
    phrase or not.
    """
    index = TemplateIndex(templates)
    slim = checkpointed(scan(docs, index, key, text))
    n = slim.count()
    df = {r.w: r["count"] for r in slim.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count().collect()}
    # Whole thousandths, so that sums do not depend on their order.
    idf = [round(1000 * math.log((n + 1) / (df.get(w, 0) + 1))) + 1 for w in range(len(index.vocab))]
    weight = [sum(idf[w] for w in ws) for ws in index.indexed]
    number = F.array(*(F.lit(v) for v in idf))
    posting = F.array(*(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in posts)) for posts in index.postings))
    top = F.slice(F.sort_array(F.transform(F.array_distinct("hits.w"), lambda w: F.struct(F.get(number, w).alias("idf"), w.alias("w"))), asc=False), 1, rarest)
    holders = slim.where("size(hits) > 0")
    looked = holders.select("row", "hits", top["w"].alias("top")).select("row", F.explode(F.filter("hits", lambda h: F.array_contains("top", h["w"]))).alias("h"))
    votes = looked.select("row", F.col("h.i").alias("i"), F.get(number, F.col("h.w")).alias("idf"), F.explode(F.get(posting, F.col("h.w"))).alias("post"))
    votes = votes.select("row", F.col("post.t").alias("t"), (F.col("i") - F.col("post.p")).alias("off"), "idf", F.lit(1).alias("n"), F.lit(0).alias("key_phrase"))
    keyed = [(p, t, at) for p, posts in index.phrase_postings.items() for t, at in posts]
    key_posts = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(at).alias("at")) for p, t, at in keyed)), lambda x: x["p"] == F.col("place.p"))
    phrase_votes = holders.select("row", F.explode("places").alias("place")).select("row", F.col("place.i").alias("i"), F.explode(key_posts).alias("post"))
    phrase_votes = phrase_votes.select("row", F.col("post.t").alias("t"), (F.col("i") - F.col("post.at")).alias("off"), F.lit(0).alias("idf"), F.lit(0).alias("n"), F.lit(1).alias("key_phrase"))
    agreed = votes.union(phrase_votes).groupBy("row", "t", "off").agg(F.sum("idf").alias("idf"), F.sum("n").alias("n"), F.max("key_phrase").alias("key_phrase"))
    share = F.col("idf") / F.get(F.array(*(F.lit(w) for w in weight)), F.col("t"))
    enough = F.get(F.array(*(F.lit(min(least, len(ws))) for ws in index.indexed)), F.col("t"))
    agreed = agreed.withColumn("share", share).withColumn("sure", (F.col("share") >= agree) & (F.col("n") >= enough) & (F.col("key_phrase") == 1))
    label = F.get(strings(index.labels), F.col("t"))
    verdict = agreed.groupBy("row").agg(F.max("share").alias("best"), F.collect_set(F.when(F.col("sure"), label)).alias("by_template"))
    base_of = strings(BASE_PHRASES.values())
    out = slim.join(verdict, "row", "left").withColumn("places", F.filter("places", lambda x: x["p"] < len(BASE_PHRASES)))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: F.get(base_of, x["p"]))))
    out = out.withColumn("base_labels", base)
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("by_template", F.array().cast("array<string>"))))
    return out.select(F.col("key").alias(key), "n_words", F.col("places.i").alias("places"), "base_labels", labels.alias("labels"), F.round(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0)), 6).alias("score"))
