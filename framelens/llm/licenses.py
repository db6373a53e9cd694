"""License scans by an exact set-similarity join of text blocks with license templates.

A template is the set of words of a license notice; it is found in a block of words that
contains at least ``THRESHOLD`` of them. Templates of at most c words (c a power of two) meet
blocks of 2c words, one beginning at every c-th word, so any c consecutive words lie within
one block.

1. ``_count`` takes the words of every whole text, finds the plain phrases, and counts for each
   template word the documents that hold it. The counts of all documents (as many as there
   are template words) give the global order: rare words first.
2. ``_blocks``: of a template's words in that order one of the first size - need + 1 must be in
   a block that has need of them (prefix filter), so only blocks around these rare words are
   written out, as their template words in the global order, if there are enough (length filter).
3. The join matches prefixes of blocks and templates word by word, drops pairs whose places
   leave too few words (positional filter), and verifies the rest exactly; a pair is taken at
   its first common word only. The templates are a fixed list, so they are broadcast.

Containment is one-sided: a notice of the lesser license also holds the words of the general
one, and has both labels.

Defined results: null text is empty and has no words, no places and score 0; rows equal in id
and text share their labels; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm import runs as R
from framelens.llm.common import stored

THRESHOLD = 0.9
LEAST_CLASS = 8
#: Phrases that always count, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses, with their labels. One label may have several.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("creative-commons", "Licensed under CC BY 4.0"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("creative-commons", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
)
#: A-Z to lower case, ASCII characters outside of words to spaces; bytes of longer code points are letters.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand together."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        sought = f" {phrase} ".encode()
        at = line.find(sought)
        while at >= 0:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(sought, at + 1)
    return sorted(found)


class Template:
    """The words of a notice, how many must be found, and its class."""

    def __init__(self, label: str, text: str, threshold: float) -> None:
        own = words_of(text)
        self.label, self.words = label, frozenset(own)
        self.need = math.ceil(threshold * len(self.words) - 1e-9)
        self.size = max(LEAST_CLASS, 1 << (len(own) - 1).bit_length())


def _count(vocabulary: frozenset[bytes], phrases: tuple):
    """A row for each document, and for each batch the numbers of its documents that hold each template word."""
    last = {p.rpartition(" ")[2].encode() for p, _ in phrases}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            holders: Counter[bytes] = Counter()
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                own = vocabulary.intersection(words)
                holders.update(own)
                found = places(words, phrases) if own & last else []
                at = [i for i, _ in found]
                rows.append((len(words), len(found), at[0] if at else None, at[-1] if at else None, ",".join(sorted({label for _, label in found}))))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels"]).astype({"first_word": "Int64", "last_word": "Int64"})
            yield out.assign(doc_id=batch["doc_id"].to_numpy(), _tid=batch["_tid"].to_numpy(), word=None)
            yield pd.DataFrame({"n_words": list(holders.values()), "word": [w.decode() for w in holders]}).assign(doc_id=0, _tid=0, n_base=0, first_word=pd.NA, last_word=pd.NA, base_labels=None)

    return count


def _prefix(template: Template, rank: dict[bytes, int]) -> list[bytes]:
    return sorted(template.words, key=rank.__getitem__)[: len(template.words) - template.need + 1]


def _blocks(templates: list[Template], rank: dict[bytes, int]):
    """The blocks that a template could be in: their template words as places in the global order, ascending."""
    classes = []
    for size in sorted({t.size for t in templates}):
        own = [t for t in templates if t.size == size]
        classes.append((size, frozenset(w for t in own for w in _prefix(t, rank)), frozenset(w for t in own for w in t.words), min(t.need for t in own)))
    rare = frozenset(w for _, prefix, _, _ in classes for w in prefix)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, tid, text in zip(batch["doc_id"], batch["_tid"], batch["text"], strict=True):
                words = words_of(text)
                at = [i for i, w in enumerate(words) if w in rare]
                for size, prefix, known, least in classes:
                    around = {k for i in at if words[i] in prefix for k in (i // size - 1, i // size) if k >= 0}
                    for k in sorted(around):
                        held = known.intersection(words[k * size : (k + 2) * size])
                        if len(held) >= least:
                            rows.append((doc_id, tid, size, k, sorted(map(rank.__getitem__, held))))
            yield pd.DataFrame(rows, columns=["doc_id", "_tid", "size", "block", "words"])

    return blocks


def matches(own: DataFrame, templates: list[Template], order: list[bytes]) -> DataFrame:
    """doc_id, _tid, size, block, label, share: every pair of a block and a template that it contains."""
    rank = {w: i for i, w in enumerate(order)}
    blocks = stored(own.mapInPandas(_blocks(templates, rank), "doc_id long, _tid long, size int, block int, words array<int>").dropDuplicates(["doc_id", "_tid", "size", "block"]))
    rows = []
    for t in templates:
        ranked = sorted(rank[w] for w in t.words)
        rows += [(t.size, w, i, ranked, t.need, t.label) for i, w in enumerate(ranked[: len(ranked) - t.need + 1])]
    index = own.sparkSession.createDataFrame(rows, "size int, word int, at int, template array<int>, need int, label string")
    least = F.least(*[F.when(F.col("size") == s, F.lit(min(t.need for t in templates if t.size == s))).otherwise(F.lit(1 << 30)) for s in sorted({t.size for t in templates})], F.lit(1 << 30))
    # The prefix of a block for the template of its class that needs the fewest words.
    prefix = blocks.select("*", F.posexplode(F.slice("words", F.lit(1), F.greatest(F.size("words") - least + 1, F.lit(0)))).alias("place", "word"))
    pairs = prefix.join(F.broadcast(index), ["size", "word"])
    left = F.least(F.size("template") - F.col("at"), F.size("words") - F.col("place"))
    common = F.array_intersect("words", "template")
    exact = (F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("word"))
    return pairs.where((F.size("words") >= F.col("need")) & (left >= F.col("need"))).where(exact).select("doc_id", "_tid", "size", "block", "label", (F.size(common) / F.size("template")).alias("share"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    score: the largest share of a template's words that a block contains where it is found; 1 where a phrase is.
    """
    known = [Template(label, text, threshold) for label, text in templates]
    vocabulary = frozenset(w for t in known for w in t.words) | {p.rpartition(" ")[2].encode() for p, _ in phrases}
    own = R.identified(docs)
    schema = "doc_id long, _tid long, n_words long, n_base long, first_word long, last_word long, base_labels string, word string"
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    count = _count(vocabulary, phrases)
    counted = stored(own.mapInPandas(lambda batches: (x[columns] for x in count(batches)), schema))
    holders = {r["word"].encode(): r["n"] for r in counted.where("word is not null").groupBy("word").agg(F.sum("n_words").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (holders.get(w, 0), w))
    found = matches(own, known, order).groupBy("doc_id", "_tid").agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share"))
    rows = counted.where("word is null").join(found, ["doc_id", "_tid"], "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels: Column = F.array_join(F.sort_array(F.array_union(base, F.coalesce("_labels", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0)))
    return rows.select(R.given(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> str:
    """The same rows from every block, without filters."""
    known = [Template(label, text, threshold) for label, text in templates]
    rows = ", ".join(f"({i}, {t.size}, {t.need}, {len(t.words)}, '{t.label}', '{w.decode()}')" for i, t in enumerate(known) for w in sorted(t.words))
    lead = lambda k: "w" if not k else f"lead(w, {k}) over (partition by rid order by pos)"
    cases = " ".join(f"when {' and '.join(f"{lead(k)} = '{w}'" for k, w in enumerate(p.split(' ')))} then '{label}'" for p, label in phrases)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with docs as (
    select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
words as (select rid, unnest(range(0, len(ws))) as pos, unnest(ws) as w from docs),
base as (select rid, pos, case {cases} end as label from words),
counted as (
    select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels
    from base where label is not null group by rid),
templates(tid, size, need, n, label, w) as (values {rows}),
held as (
    select rid, tid, size, need, n, label, w, pos // size as block from words join templates using (w)
    union all
    select rid, tid, size, need, n, label, w, pos // size - 1 from words join templates using (w) where pos >= size),
found as (select rid, tid, label, count(distinct w) / any_value(n) as share from held group by rid, tid, label, block, need having count(distinct w) >= need),
more as (select rid, list(distinct label) as labels, max(share) as share from found group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
    array_to_string(list_sort(coalesce(counted.labels, [])), ',') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(counted.labels, []), coalesce(more.labels, [])))), ',') as labels,
    case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from docs left join counted using (rid) left join more using (rid)
"""
