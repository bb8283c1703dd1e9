"""Licence scans by a positional rare-token index.

Templates of licence notices are indexed by the words of theirs that fewest documents have. A file's
index words are all looked up; each occurrence votes, for every template that has the
word, for the place where the template would begin. A template is found where votes of several
words agree on a place and its mandatory phrases stand there, too. Texts are read once: what is kept
of them is their template words with their places. Everything is DataFrame functions; the index is
made from the templates alone and is of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import durable, row_key

#: What stands between words, which are runs of all other characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, notice, mandatory phrases of the notice; standard wordings, in lower case without marks.
TEMPLATES = [
    ("mit", "released under the mit license", ["under the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("cc-by", "this work is licensed under a creative commons attribution", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]
#: Index words of a template, and how many of them have to agree on a place.
RARE, AGREE = 4, 2


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text in lower case (A-Z); splitting is several times as fast as matching them."""
    return F.array_remove(F.split(_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def template_words(docs: DataFrame) -> DataFrame:
    """(doc_id, key_id, key_text, n_words, kept: array of (w, i), the words that a template or a base
    phrase has and their numbers, in order), one row for every row of docs."""
    vocabulary = sorted({w for text in (*BASE, *(notice for _, notice, _ in TEMPLATES)) for w in text.split()})
    words = words_of(F.col("text"))
    kept = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.size(words).cast("long").alias("n_words"), kept.alias("kept"))


def places(kept: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively: their first word's numbers. Words of a phrase that
    are neighbours in the text are neighbours in kept."""
    starts = F.array_compact(F.transform(kept, lambda x, j: F.when(x["w"] == phrase[0], j)))

    def stands(j: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(phrase[1:], 1):
            x = F.get(kept, j + k)
            found = found & F.coalesce((x["w"] == word) & (x["i"] == F.get(kept, j)["i"] + k), F.lit(False))
        return found

    return F.transform(F.filter(starts, stands), lambda j: F.get(kept, j)["i"])


def rare_words(rows: DataFrame) -> tuple[dict[str, float], list[list[tuple[str, int]]]]:
    """IDF of every template word over the rows of template_words, and each template's RARE rarest
    words with their places in it. What is collected is a count for each template word."""
    has = rows.select(F.explode(F.array_append(F.array_distinct("kept.w"), "")).alias("word"))
    counts = {r["word"]: r["count"] for r in has.groupBy("word").count().collect()}
    vocabulary = {w for _, notice, _ in TEMPLATES for w in notice.split()}
    idf = {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    index = []
    for _, notice, _ in TEMPLATES:
        own = notice.split()
        chosen = sorted(set(own), key=lambda w: (-idf[w], w))[:RARE]
        index.append([(w, k) for k, w in enumerate(own) if w in chosen])
    return idf, index


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for every row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, notices (templates found: label, first word, share of index words).

    Base: every place of a base phrase. labels adds the labels of notices that the index found; both
    are distinct, sorted, joined by commas, empty if none. score: the best notice's share of index
    words that agree, one half at least where a base phrase stands; 0 without a label. Null text
    counts as empty. Rows with the same id and text get the same answer.
    """
    row = durable(template_words(docs))
    idf, index = rare_words(row)
    tokens = sorted({w for own in index for w, _ in own}, key=lambda w: (-idf[w], w))  # rarest first

    # votes: (template, place where it would begin, the word or phrase that says so)
    kind = "array<struct<t:int,at:int,w:string,p:string>>"
    postings = {w: [(t, k) for t, own in enumerate(index) for x, k in own if x == w] for w in tokens}
    entries = [x for w in tokens for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in postings[w]]))]
    table = F.create_map(*entries)
    hits = F.filter("kept", lambda x: x["w"].isin(tokens))
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["k"]).alias("at"), h["w"].alias("w"), F.lit(None).cast("string").alias("p")))))
    phrases = []
    for phrase in sorted({p for _, _, own in TEMPLATES for p in own}):
        inside = [(t, f" {notice} ".split(f" {phrase} ")[0].count(" ")) for t, (_, notice, own) in enumerate(TEMPLATES) if phrase in own]
        found = places(F.col("kept"), phrase.split())
        phrases += [_phrase_votes(found, t, k, phrase) for t, k in inside]
    some = F.size(F.array_intersect(F.array(*[F.lit(w) for w in tokens]), F.array_distinct("kept.w"))) >= AGREE
    evidence = F.concat(votes.cast(kind), *[p.cast(kind) for p in phrases])

    base = {label: places(F.col("kept"), phrase.split()) for phrase, label in BASE.items()}
    stats = row.select("doc_id", "key_id", "key_text", "n_words", *[c.alias(f"base_{label}") for label, c in base.items()])

    said = row.where(some).select("key_id", "key_text", F.explode(F.array_distinct(evidence)).alias("e")).select("key_id", "key_text", "e.*").distinct()
    agreed = said.groupBy("key_id", "key_text", "t", "at").agg(F.count("w").alias("words"), F.count("p").alias("phrases"))
    facts = F.create_map(*[x for t, (label, _, own) in enumerate(TEMPLATES) for x in (F.lit(t), F.struct(F.lit(label).alias("label"), F.lit(len(own)).alias("phrases"), F.lit(len({w for w, _ in index[t]})).alias("words")))])
    fact = F.element_at(facts, F.col("t"))
    sure = agreed.where((F.col("words") >= F.least(F.lit(AGREE), fact["words"])) & (F.col("phrases") >= fact["phrases"]))
    notice = F.struct(fact["label"].alias("label"), F.col("at").alias("first_word"), (F.col("words") / fact["words"]).alias("share"))
    notices = sure.groupBy("key_id", "key_text").agg(F.array_sort(F.collect_set(notice)).alias("notices"))  # a document's own notices

    rows = stats.join(notices, ["key_id", "key_text"], "left")
    all_places = F.concat(*[F.col(f"base_{label}") for label in base])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base_{label}") > 0, label) for label in sorted(base)]))
    own_notices = F.coalesce("notices", F.array().cast("array<struct<label:string,first_word:int,share:double>>"))
    labels = F.array_sort(F.array_union(base_labels, F.transform(own_notices, lambda n: n["label"])))
    best = F.coalesce(F.array_max(F.transform(own_notices, lambda n: n["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.size(all_places) > 0, 0.5).otherwise(0.0)).alias("score"), own_notices.alias("notices"),
    )


def _phrase_votes(found: Column, template: int, offset: int, phrase: str) -> Column:
    return F.transform(found, lambda i: F.struct(F.lit(template).alias("t"), (i - offset).alias("at"), F.lit(None).cast("string").alias("w"), F.lit(phrase).alias("p")))
