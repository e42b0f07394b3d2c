"""License scan: a positional index of rare words, JVM-side.

Templates are texts of licence notices with mandatory key phrases. The index holds, of every phrase, its two
words of the highest inverse document frequency in the corpus, with all their places in the template. Of a file the
licence words with the highest IDF are looked up (and the rarest word of every base phrase, so that no base
place is missed). A posting of a word at place a of the file and place p of a template gives the offset a - p; it
stands where another indexed word of the template lies at its relative place too. There the
template's mandatory phrases are verified word by word. A template matches where all of its phrases stand.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.containment import words

#: indexed words of a phrase
RAREST = 2


@dataclass(frozen=True)
class Template:
    """phrases are mandatory and stand in text; without a text the first phrase is all of it. Words are parted by spaces."""

    label: str
    phrases: tuple[str, ...]
    text: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return (self.text or self.phrases[0]).split()

    def place(self, phrase: str) -> int:
        w, p = self.words, phrase.split()
        return next(k for k in range(len(w)) if w[k : k + len(p)] == p)


#: fixed values: base phrases and their labels
BASE = (
    Template("cc-by", ("cc by",), base=True),
    Template("gpl", ("general public license",), base=True),
    Template("reserved", ("all rights reserved",), base=True),
)
#: fixed values: notices of well-known licences, lower-cased and without punctuation, and their key phrases
TEMPLATES = BASE + (
    Template("agpl", ("affero general public license",)),
    Template("apache-2.0", ("apache license version 2 0",)),
    Template(
        "apache-2.0", ("licensed under the apache license", "you may not use this file except in compliance with the license"),
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    Template(
        "bsd", ("redistribution and use in source and binary forms", "this list of conditions"),
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    Template("cc-by-nc", ("cc by nc",)),
    Template("cc-by-sa", ("cc by sa",)),
    Template("cc-by", ("licensed under a creative commons attribution",), "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("gpl-2.0", ("gnu general public license version 2",)),
    Template("gpl-3.0", ("gnu general public license version 3",)),
    Template(
        "gpl-3.0", ("terms of the gnu general public license", "either version 3 of the license"),
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    Template("lgpl", ("lesser general public license",)),
    Template(
        "mit", ("permission is hereby granted free of charge", "the software is provided as is"),
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind",
    ),
    Template("mit", ("mit license",)),
    Template("mpl-2.0", ("mozilla public license version 2 0",)),
    Template("mpl-2.0", ("subject to the terms of the mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("public-domain", ("public domain",)),
    Template("unlicense", ("free and unencumbered software released into the public domain",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
#: as many words as can be indexed
LOOKED_UP = RAREST * sum(len(t.phrases) for t in TEMPLATES)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, looked_up: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, places (array of phrase, at), n_base, first_word, last_word, base_labels, labels, score.

    Words are counted from 0; phrase is the number of a phrase in the templates' order. score is the largest share of a
    template's words that stand at their relative places, 1 for a whole template and 0 without a posting that stands. One
    row per row of docs, also of rows that repeat a doc_id or have a null one; null and empty texts have 0
    words and no labels (an empty string). Other columns are ignored. All indexed words that a file has are looked up; looked_up
    sets fewer, those of the highest IDF, at the risk of missing labels beyond base.
    """
    looked_up = looked_up or RAREST * sum(len(t.phrases) for t in templates)
    phrases = [(t, k, p) for t in range(len(templates)) for k, p in enumerate(templates[t].phrases)]
    vocabulary = sorted({w for _, _, p in phrases for w in p.split()})
    counted = docs.select(F.explode(F.array_intersect(words(F.col("text")), F.lit(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # one row for each word of the phrases at most
    frequency = {r["word"]: r["n"] for r in counted.limit(len(vocabulary)).collect()}

    def rarest(phrase: str) -> list[str]:
        return sorted({w for w in phrase.split() if w in frequency}, key=lambda w: (frequency[w], w))

    indexed = [sorted({w for p in t.phrases for w in rarest(p)[:RAREST]}) for t in templates]
    anchors = sorted({w for t in templates if t.base for p in t.phrases for w in rarest(p)[:1]})
    by_idf = sorted({w for ws in indexed for w in ws}, key=lambda w: (frequency[w], w))
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    none = F.expr("cast(array() AS array<struct<phrase:int,at:bigint>>)")
    if not by_idf:
        rows = w.withColumns({"places": none, "share": F.lit(0.0)})
    else:
        rows = _placed(w, templates, phrases, indexed, anchors, by_idf, looked_up).withColumn("places", F.coalesce("places", none))
    present = F.array_distinct(F.transform("places", lambda p: p["phrase"]))
    number = {(t, k): n for n, (t, k, _) in enumerate(phrases)}
    of = lambda t: [number[t, k] for k in range(len(templates[t].phrases))]

    def joined(chosen: list[int]) -> Column:
        found = F.array(*[F.when(F.size(F.array_intersect(F.lit(of(t)), F.col("present"))) == len(of(t)), F.lit(templates[t].label)) for t in chosen])
        return F.when(F.size("present") == 0, "").otherwise(F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ","))

    base = [t for t in range(len(templates)) if templates[t].base]
    numbers = [n for t in base for n in of(t)]
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), "places", "share", present.alias("present"), F.transform(F.filter("places", lambda p: p["phrase"].isin(numbers)), lambda p: p["at"]).alias("base_at"))
    return rows.select(
        "doc_id", "n_words", "places", F.size("base_at").cast("long").alias("n_base"), F.array_min("base_at").alias("first_word"), F.array_max("base_at").alias("last_word"),
        joined(base).alias("base_labels"), joined(list(range(len(templates)))).alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"),
    )


def _placed(w: DataFrame, templates: tuple[Template, ...], phrases: list, indexed: list, anchors: list[str], by_idf: list[str], looked_up: int) -> DataFrame:
    """doc_id, w, places and share of each file; all expressions of one row, so nothing is shuffled."""
    texts = [t.words for t in templates]
    posted: dict[str, list[Column]] = {}
    for t, chosen in enumerate(indexed):
        for word in chosen:
            others = F.array(*[F.struct(F.lit(other).alias("word"), F.lit(p).alias("place")) for other in chosen if other != word for p, x in enumerate(texts[t]) if x == other])
            others = others if len(chosen) > 1 else F.expr("cast(array() AS array<struct<word:string,place:int>>)")
            posted.setdefault(word, []).extend(F.struct(F.lit(t).alias("t"), F.lit(p).alias("place"), F.lit(templates[t].base).alias("base"), others.alias("others")) for p, x in enumerate(texts[t]) if x == word)
    index = F.create_map(*[x for word in by_idf for x in (F.lit(word), F.array(*posted[word]))])
    number = {(t, k): n for n, (t, k, _) in enumerate(phrases)}
    phrase = lambda t, k, p: F.struct(F.lit(number[t, k]).alias("phrase"), F.lit(templates[t].place(p)).alias("place"), F.lit(p.split()).alias("words"))
    known = F.array(*[F.struct(F.lit(texts[t]).alias("words"), F.array(*[phrase(t, k, p) for k, p in enumerate(templates[t].phrases)]).alias("phrases")) for t in range(len(templates))])

    word_at = lambda at: F.get("w", at.cast("int"))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.cast("long").alias("at"), x.alias("word"))), lambda h: h["word"].isin(by_idf))
    rows = w.withColumn("hits", hits)
    # the file's words of the highest inverse document frequency
    top = F.slice(F.array_intersect(F.lit(by_idf), F.transform("hits", lambda h: h["word"])), 1, looked_up)
    rows = rows.withColumn("top", F.when(F.size("hits") > 0, F.array_union(top, F.lit(anchors).cast("array<string>"))))
    chosen = F.filter("hits", lambda h: F.array_contains("top", h["word"]))
    # postings by relative position: another indexed word of the template must lie at its place
    stands = lambda at: lambda p: p["base"] | F.exists(p["others"], lambda o: F.coalesce(word_at(at - p["place"] + o["place"]) == o["word"], F.lit(False)))
    offsets = F.flatten(F.transform(chosen, lambda h: F.transform(F.filter(F.element_at(index, h["word"]), stands(h["at"])), lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["place"]).alias("offset")))))
    rows = rows.withColumn("offsets", F.when(F.col("top").isNotNull(), F.array_distinct(offsets)))

    def verified(o: Column) -> Column:
        begin = lambda p: o["offset"] + p["place"]
        equal = lambda p: F.when(begin(p) >= 0, F.slice("w", (F.greatest(begin(p), F.lit(0)) + 1).cast("int"), F.size(p["words"])) == p["words"]).otherwise(False)
        return F.transform(F.filter(F.element_at(known, o["t"] + 1)["phrases"], equal), lambda p: F.struct(p["phrase"].alias("phrase"), begin(p).alias("at")))

    def share(o: Column) -> Column:
        text = F.element_at(known, o["t"] + 1)["words"]
        same = F.filter(text, lambda x, i: F.coalesce(word_at(o["offset"] + i) == x, F.lit(False)))
        return F.size(same) / F.size(text)

    places = F.array_distinct(F.flatten(F.transform("offsets", verified)))
    return rows.select("doc_id", "w", places.alias("places"), F.array_max(F.transform("offsets", share)).alias("share"))
