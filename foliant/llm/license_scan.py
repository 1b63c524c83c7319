"""License scans by diagonal voting.

All windows of K words of every text are hashed and joined to the places of the same windows in license templates. A hit
at word w of the text and word p of a template lies on diagonal w - p; hits are counted by document, template and
diagonal, neighbouring diagonals merged (an inserted or lost word moves what follows to the next one). A merged span is
then verified: of its hits the longest chain that goes forward in both the text and the template is its alignment, and it
counts when the chain has enough of the template's windows, those of the words that tell templates apart among them. Of
spans that overlap, the one with the most windows counts alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, let, text_of, words_of

K = 3
#: Diagonals as near as this are one alignment.
NEAR = 2
#: Share of a template's windows, and fewest windows, that an alignment must hit.
SHARE, LEAST = 0.6, 2
#: Words that tell templates apart, besides the first number of a version; and neighbours that nothing may come between.
TELLING = ("sa", "nc", "nd", "lesser", "affero")
TELLING_PAIRS = (("gnu", "general"), ("lesser", "general"), ("affero", "general"))
#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices in common use, as words; label and text.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-3.0", "this work is licensed under the gnu lesser general public license version 3"),
    ("lgpl-3.0", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    *[(f"cc-by{'-' * bool(kind)}{kind.replace(' ', '-')}-4.0", " ".join(f"licensed under cc by {kind} 4 0".split())) for kind in ("", "sa", "nc",
        "nd", "nc sa", "nc nd")],
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
]


def template_windows(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(h, t0, t1, t2, template, place, n_windows, label, telling): every window of every template; no more rows than the templates have words."""
    rows = [(i, label, text.split(), telling(text.split())) for i, (label, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, label string, words array<string>, telling array<struct<a:int,b:int>>")
    w = t.select("template", "label", "telling", (F.size("words") - K + 1).alias("n_windows"), F.posexplode(windows(F.col("words"))).alias("place", "w"))
    return w.select("w.h", *[F.col(f"w.w{j}").alias(f"t{j}") for j in range(K)], "template", "place", "n_windows", "label", "telling")


def telling(words: list[str]) -> list[tuple[int, int]]:
    """First and last places of what tells a template from its like."""
    alone = [(i, i) for i, w in enumerate(words) if w in TELLING or (w.isdigit() and not (i and words[i - 1].isdigit()))]
    return alone + [(i, i + 1) for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in TELLING_PAIRS]


def chain(hits: Column, n_windows: Column) -> Column:
    """The longest run of hits (word, place) that goes forward in both. One step a hit, over the template's places."""
    none = F.array().cast("array<struct<word:int,place:int>>")
    longest = lambda ends: F.coalesce(F.array_max(F.transform(ends, lambda c: F.struct(F.size(c).alias("n"), c.alias("c"))))["c"], none)

    def step(ends, hit):
        grown = F.concat(longest(F.slice(ends, F.lit(1), hit["place"])), F.array(hit))
        return F.transform(ends, lambda c, i: F.when((i == hit["place"]) & (F.size(grown) > F.size(c)), grown).otherwise(c))

    # of hits at one word the later place comes first, so that none follows another
    by_word = F.transform(F.sort_array(F.transform(hits, lambda x: F.struct(x["word"].alias("word"), (-x["place"]).alias("back")))),
        lambda x: F.struct(x["word"].alias("word"), (-x["back"]).alias("place")))
    return F.aggregate(by_word, F.array_repeat(none, n_windows), step, longest)


def windows(words: Column) -> Column:
    """Array of (h, w0, w1, w2): hash and words of every window, in order."""

    def window(words, i):
        w = [F.get(words, i + j) for j in range(K)]
        return F.struct(F.xxhash64(*w).alias("h"), *[x.alias(f"w{j}") for j, x in enumerate(w)])

    all_of = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: window(w, i))
    return let(words, lambda w: F.when(F.size(w) >= K, all_of(w)))


def base_places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand in a row. ``words``: a lambda variable."""
    want = phrase.split()
    here, has = (lambda i: _all(F.get(words, i + j) == w for j, w in enumerate(want))), _all(F.array_contains(words, w) for w in want)
    # most texts lack one of the words, and their places needn't be looked at
    return F.when(has, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(here(i), F.lit(False)))).otherwise(F.array().cast("array<int>"))


def _all(parts) -> Column:
    return reduce(lambda a, b: a & b, parts)


def vote(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, label, score, first, last): one row for each verified alignment of a template in a text.

    The templates are broadcast: their size is that of the list. Only hits are shuffled. A hit is compared word by word,
    so that no two different windows count as equal.
    """
    keyed = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("text_hash"),
        F.posexplode(windows(words_of(ascii_lower(text_of(docs)), SEPARATORS))).alias("word", "w"))
    flat = keyed.select("doc_id", "text_hash", "word", F.col("w.h").alias("wh"), *[F.col(f"w.w{j}") for j in range(K)])
    t = F.broadcast(template_windows(docs.sparkSession, templates))
    same = (flat["wh"] == t["h"]) & _all(flat[f"w{j}"] == t[f"t{j}"] for j in range(K))
    hits = flat.join(t, same).select("doc_id", "text_hash", "template", "label", "n_windows", "telling", "place", "word",
        (F.col("word") - F.col("place")).alias("diagonal"))
    of = ["doc_id", "text_hash", "template", "label", "n_windows", "telling"]
    # equal rows give equal hits, which count once
    votes = hits.groupBy(*of, "diagonal").agg(F.collect_set(F.struct("word", "place")).alias("hits"))
    order = Window.partitionBy(*of).orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(1))
    merged = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    spans = merged.groupBy(*of, "run").agg(F.count(F.lit(1)).alias("diagonals"), F.flatten(F.collect_list("hits")).alias("hits"))
    # too few hits need no chain, and those of one diagonal are one
    spans = spans.where(F.size("hits") >= F.least(F.lit(LEAST), F.col("n_windows")))
    spans = spans.withColumn("hits", F.when(F.col("diagonals") == 1, F.sort_array("hits")).otherwise(chain(F.col("hits"), F.col("n_windows"))))
    spans = spans.select("*", F.size("hits").alias("n"), F.get("hits", F.lit(0))["word"].alias("first"), (F.element_at("hits", -1)["word"] + K - 1).alias("last"))
    told = F.forall("telling", lambda t: F.exists("hits", lambda x: (t["a"] >= x["place"]) & (t["b"] <= x["place"] + K - 1)))
    share = F.least(F.col("n") / F.col("n_windows"), F.lit(1.0))
    enough = (F.col("n") >= F.least(F.lit(LEAST), F.col("n_windows"))) & (share >= SHARE) & told
    return best_of_overlaps(spans.where(enough).select("doc_id", "text_hash", "label", "n", F.round(share, 6).alias("score"), "first", "last"))


def best_of_overlaps(spans: DataFrame) -> DataFrame:
    """Without the spans that overlap one of another label with more windows, or as many and a greater share of its template's.

    Spans of a text are cut into islands that overlap nothing else; only those of an island, at one place no more than
    there are templates, are compared.
    """
    of = ["doc_id", "text_hash"]
    so_far = Window.partitionBy(*of).orderBy("first", "last", "label").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("first") > F.max("last").over(so_far)).cast("int"), F.lit(1))
    order = Window.partitionBy(*of).orderBy("first", "last", "label").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    row = F.struct("label", "n", "score", "first", "last")
    held = islands.groupBy(*of, "island").agg(F.collect_set(row).alias("spans"))
    beats = lambda y, x: (y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["score"] > x["score"]))
    over = lambda y, x: (y["label"] != x["label"]) & (y["first"] <= x["last"]) & (x["first"] <= y["last"])
    kept = F.filter("spans", lambda x: ~F.exists("spans", lambda y: over(y, x) & beats(y, x)))
    return held.select(*of, F.explode(kept).alias("s")).select(*of, "s.label", "s.score", "s.first", "s.last")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    Null text counts as empty. Votes meet the documents by id and hash of the text, so that repeated or null ids don't
    mix texts; equal rows stay as many rows; an empty table gives none; other columns aren't read. Score is 1 with a base
    phrase, else the largest share of a template's windows that an alignment has, else 0. spans has label, first and last
    word of each verified alignment.
    """

    def facts(w):
        return F.struct(F.size(w).cast("bigint").alias("n_words"), *[base_places(w, p).alias(f"p{i}") for i, p in enumerate(phrases)])

    words = words_of(ascii_lower(text_of(docs)), SEPARATORS)
    base = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("text_hash"), let(words, facts).alias("f")).select("doc_id", "text_hash", "f.*")
    places = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    base = base.select("doc_id", "text_hash", "n_words", places.alias("places"), F.array_sort(F.array_distinct(labels)).alias("base"))
    spans = vote(docs, templates).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("voted"), F.max("score").alias("share"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label"))).alias("spans"))
    same = base["doc_id"].eqNullSafe(spans["doc_id"]) & (base["text_hash"] == spans["text_hash"])
    out = base.join(spans, same, "left").select(base["doc_id"], "n_words", "places", "base", "voted", "share", "spans")
    every = F.array_sort(F.array_union("base", F.coalesce("voted", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "spans",
    )
