"""License scans by a positional index of rare tokens, in DataFrame functions only (operator 6).

The templates are sentences of licenses: those below, or a list of (label, words, key phrase) that the caller gives.
Over all texts the document frequency of every word of theirs is counted; each sentence then keeps its ``INDEXED`` words
of highest inverse document frequency. The index leads from a word to its postings, (template, position, idf): a
constant array of slots, a word's slot given by its CRC, so a lookup takes the same time however many templates there are.

A file is scanned once for indexed words, and the postings of those that it has are looked up and put in order of
templates; a template of which fewer than ``ENOUGH`` words are there is never looked at. Of the others the file's ``RARE`` words of
highest IDF are taken. Where a license stands, ``ENOUGH`` of these agree on the place where it begins, so one of the
first ``RARE - ENOUGH + 1`` does: their places, less their positions, are the starts that are tried. There the postings are
intersected by relative position, and the words of the mandatory key phrase verified. Plain phrases give labels too,
wherever their words stand one after another.

Everything but the count of template words happens within a row: nothing shuffles, no row is too
common, and a null or empty text has no words. Words: A-Z in lower case, runs of letters, digits and
non-ASCII characters. The score is 1 for a phrase, else the IDF-weighted share of the file's rare words that agree
in the best match, else 0. Without templates only phrases give labels.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import read

# Phrases with the labels they give.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Label, words of a sentence of a license's well-known text, key phrase inside it.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "use copy modify merge publish distribute sublicense"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see", "received a copy of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library if not see", "received a copy of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "copy of the mpl was not distributed with this file"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "anyone is free to copy modify publish use compile sell or distribute"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
]

#: Words of a template in the index, how many of those that a file has are looked up, and how many of these must agree.
INDEXED = 10
RARE = 5
ENOUGH = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
def words_of(text: str) -> Column:
    """Words of a text column."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BREAK), "")


def idf_of(df: DataFrame, text: str, wanted: list[str]) -> dict[str, float]:
    """Inverse document frequency of the wanted words over all texts of df; one row a word comes back."""
    own = F.array_distinct(F.filter(words_of(text), lambda w: w.isin(wanted)))
    counted = df.select(F.explode(F.array_append(own, F.lit(""))).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in counted}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) + 1.0 for w in wanted}


def index_of(idf: dict[str, float], templates: list[tuple[str, str, str]] = TEMPLATES) -> list[list[tuple[str, int, float]]]:
    """For each template its words in the index: (word, position, idf), the rarest first."""
    out = []
    for _, words, _ in templates:
        at: dict[str, int] = {}
        for i, w in enumerate(words.split()):
            at.setdefault(w, i)
        out.append([(w, at[w], idf[w]) for w in sorted(at, key=lambda w: (-idf[w], w))[:INDEXED]])
    return out


_POSTINGS = "array<array<struct<w:string,t:int,r:int,p:int,x:double>>>"
_TEMPLATES = "array<struct<label:string,key:array<string>,at:int>>"


def constant(rows: list, kind: str) -> Column:
    """A constant of nested arrays and structs, read from JSON once a plan."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def slots_of(index: list[list[tuple[str, int, float]]]) -> tuple[Column, int]:
    """The postings (word, template, rank in it, position, idf) of each slot, and the number of slots."""
    n = 1 << max(4, (4 * len({w for own in index for w, _, _ in own})).bit_length())
    slots: list[list[dict]] = [[] for _ in range(n)]
    for t, own in enumerate(index):
        for r, (w, p, x) in enumerate(own):
            slots[zlib.crc32(w.encode()) % n].append({"w": w, "t": t, "r": r, "p": p, "x": x})
    return constant(slots, _POSTINGS), n


def templates_of(templates: list[tuple[str, str, str]]) -> Column:
    """The templates as one constant: structs of label, key phrase and its place."""
    rows = []
    for label, words, key in templates:
        whole, key = words.split(), key.split()
        at = next((i for i in range(len(whole)) if whole[i : i + len(key)] == key), None)
        if at is None or not key:
            raise ValueError(f"no key phrase inside a template of {label}")
        rows.append({"label": label, "key": key, "at": at})
    return constant(rows, _TEMPLATES)


def scan(df: DataFrame, text: str = "text", index: list | None = None, drop_text: bool = False, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """df with n_words, places (start and label of each phrase), templates (start, label, score), labels and score.

    Columns of these names are replaced. index: of ``index_of`` with the same templates; made from df's own texts if None.
    """
    if index is None:
        index = index_of(idf_of(df, text, sorted({w for _, words, _ in templates for w in words.split()})), templates)
    indexed = sorted({w for own in index for w, _, _ in own})
    anchors = [max(p.split(), key=lambda w: (len(w), w)) if label != "cc-by-nc" else "nc" for p, label in PHRASES]
    looked = sorted({*indexed, *anchors})
    word = lambda i: F.get("_words", i)
    both = lambda xs: reduce(lambda a, b: a & b, xs)
    slots, n_slots = slots_of(index)
    known = templates_of(templates)

    base = df.drop("_words", "_hits", "_own", "_posts", "_rare", "_near", "n_words", "places", "templates", "labels", "score")
    out = base.withColumn("_words", words_of(text))
    out = out.withColumn("_hits", F.array_remove(F.transform("_words", lambda w, i: F.when(w.isin(looked), i).otherwise(-1)), -1))
    out = out.withColumn("_own", F.array_distinct(F.transform("_hits", word)))

    def places(phrase: str, label: str, anchor: str) -> Column:
        own = phrase.split()
        k = own.index(anchor)
        found = F.filter("_hits", lambda i: both([word(i + (j - k)).eqNullSafe(w) for j, w in sorted(enumerate(own), key=lambda x: x[0] != k)]))
        return F.transform(found, lambda i: F.struct((i - k).alias("start"), F.lit(label).alias("label")))

    def postings(w) -> Column:
        """What the index has for a word."""
        return F.filter(F.get(slots, F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(n_slots)).cast("int")), lambda x: x["w"] == w)

    def first_of(i) -> Column:
        """Whether a template's postings begin here, and there are enough."""
        post = lambda j: F.get("_posts", j)
        return (post(i)["t"] == post(i + (ENOUGH - 1))["t"]) & ((i == 0) | (F.get("_posts", F.greatest(i - 1, F.lit(0)))["t"] != post(i)["t"]))

    def candidate(i) -> Column:
        """A template and the rarest of its words that the file has."""
        t = F.get("_posts", i)["t"]
        own = F.filter(F.slice("_posts", i + 1, RARE), lambda x: x["t"] == t)
        return F.struct(F.get(known, t).alias("known"), own.alias("rare"), F.slice(own, F.lit(1), F.size(own) - (ENOUGH - 1)).alias("first"))

    def matches(c) -> Column:
        """Places where the file's rare words agree on a template's start and its key phrase stands."""
        t = c["known"]
        starts = F.array_distinct(F.flatten(F.transform(c["first"], lambda x: F.transform(F.filter("_near", lambda i: word(i) == x["w"]), lambda i: i - x["p"]))))
        at = lambda start: start + t["at"]
        stands = lambda start: (at(start) >= 0) & (F.slice("_words", F.greatest(at(start), F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["x"])
        agree = lambda start: F.filter(c["rare"], lambda x: word(start + x["p"]) == x["w"])
        verified = F.filter(starts, lambda start: stands(start) & (F.size(agree(start)) >= ENOUGH))
        return F.transform(verified, lambda start: F.struct(start.alias("start"), t["label"].alias("label"), (weight(agree(start)) / weight(c["rare"])).alias("score")))

    found = F.flatten(F.transform("_own", postings))
    out = out.withColumn("_posts", F.array_sort(F.transform(found, lambda x: F.struct(x["t"].alias("t"), x["r"].alias("r"), x["p"].alias("p"), x["x"].alias("x"), x["w"].alias("w")))))
    places_of_posts = F.filter(F.transform("_posts", lambda x, i: i), first_of)
    out = out.withColumn("_rare", F.transform(places_of_posts, candidate))
    near = F.array_distinct(F.flatten(F.transform("_rare", lambda c: c["first"]["w"])))
    out = out.withColumn("_near", F.when(F.size("_rare") == 0, F.array().cast("array<int>")).otherwise(F.filter("_hits", lambda i: F.array_contains(near, word(i)))))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "places": F.array_sort(F.concat(*[places(p, label, a) for (p, label), a in zip(PHRASES, anchors)])),
        "templates": F.array_sort(F.array_distinct(F.flatten(F.transform("_rare", matches)))),
    })
    out = out.withColumns({
        "labels": F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("templates.label")))),
        "score": F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max("templates.score"), F.lit(0.0)))),
    })
    return out.drop("_words", "_hits", "_own", "_posts", "_rare", "_near", *[text] * drop_text)


def op6_license_scan(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, drop_text=True)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
