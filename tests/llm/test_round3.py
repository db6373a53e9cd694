"""License scans, cross-tokenizer alignment and hard negatives against brute force and SQL."""

import math
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm import alignment, licenses, negatives, registry
from tests.oracle import connect, differences

from .fixtures import SCHEMA, corpus, frame, prose

SF = "/root/testdata/sf0.01"
A_PATH, B_PATH = (public_tokenizers.path(x) for x in (alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY))


@pytest.mark.parametrize("name", ["op11_license_scan", "op13_hard_negatives"])
def test_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) == ""


def awkward(extra=()):
    rows = corpus()
    rows += [rows[2], (None, *rows[8][1:]), (None, *rows[8][1:])]
    return rows + [(1000 + i, t, "en", "a", len(t), None, 1, 2, 3, "s", "f", "l") for i, t in enumerate(extra)]


NOTICES = [
    "x " * 70 + "Permission is hereby granted,\n * free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software\n * without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software " + "y " * 50,
    "MIT License mit-license MIT\nLICENSE, the apache LICENSE; General  Public License",
    "Released under the Apache something else license",
    "This work is licensed under the GNU Lesser General Public License, version 2",
    "mit lizense, Mit Lıcense, general public licenses",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "License " * 2000 + "MIT",
]


def test_licenses_against_brute_force(spark):
    rows = awkward(NOTICES)
    got = licenses.scan_licenses(frame(spark, rows).coalesce(2)).collect()
    known = [licenses.Template(label, text, licenses.THRESHOLD) for label, text in licenses.TEMPLATES]
    want = []
    for r in rows:
        words = [w.decode() for w in licenses.words_of(r[1] or "")]
        base = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        labels, score = {label for _, label in base}, float(bool(base))
        for t in known:
            need = {w.decode() for w in t.words}
            for k in range(0, max(1, len(words)), t.size):
                share = len(need.intersection(words[k : k + 2 * t.size])) / len(need)
                if share * len(need) >= t.need:
                    labels.add(t.label)
                    score = max(score, share)
        at = [i for i, _ in base]
        want.append((r[0], len(words), len(base), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got), key=key) == sorted(want, key=key)
    found = {r["doc_id"]: r for r in got}
    assert found[1000]["labels"] == "mit" and found[1000]["base_labels"] == "" and found[1000]["score"] >= 0.9
    assert found[1001]["n_base"] == 5 and found[1002]["labels"] == "" and "lgpl" in found[1005]["labels"].split(",")
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_license_words_are_those_of_the_contract():
    import re

    for text in (*(r[1] or "" for r in corpus()), "Ünï-CÖDÉ ÀB_c9\x00d\x7fe f g", *NOTICES):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert [w.decode() for w in licenses.words_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def alignment_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_side.encode_special_tokens = True
    letters = alignment.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a_side.get_vocab().items() if i != 50256}
    cut, holders = [], Counter()
    for r in rows:
        text = r[1]
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        own = [[a_bytes[i] for i in a], [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]]
        if any(b"".join(x) != f" {text}".encode() for x in own):
            a, b, own = [], [], [[], []]
        ends = [np.cumsum([len(x) for x in side]).astype(int).tolist() for side in own]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(x, y) for x, s, e in zip(a, starts[0], ends[0], strict=False) for y, u, v in zip(b, starts[1], ends[1], strict=False) if s < v and u < e] if len(a) < 400 else None
        if links is None:
            links, i, j = [], 0, 0
            while i < len(a):
                links.append((a[i], b[j]))
                e, f = ends[0][i], ends[1][j]
                i, j = i + (e <= f), j + (f <= e)
        groups = []
        begin = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, e in zip(side, own_ends, strict=True) if begin < e <= end) for side, own_ends in ((a, ends[0]), (b, ends[1]))) if len(a) < 3000 else None)
            begin = end
        cut.append((r[0], len(a), len(b), len(groups), links, groups))
        holders.update(set(links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return [(i, n_a, n_b, n_g, len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), ("" if not n_a else sha256(";".join(g).encode()).hexdigest()) if None not in g else None) for i, n_a, n_b, n_g, links, g in cut]


ODD = ["▁ a▁b", "two  spaces and\ttabs \n new", " leading", "trailing ", "<|endoftext|> <s>x</s> <unk> <0x0A>", "𝔸 ﬁ　中文 \x00 é́", "\n \nx", "a" * 5000]


@pytest.mark.parametrize(("chunk", "fan_in", "remembered"), [(1 << 22, 128, 400_000), (2000, 2, 400_000), (3000, 3, 50)])
def test_alignment_against_brute_force(spark, monkeypatch, chunk, fan_in, remembered):
    """Small chunks, merges of few runs at a time and a table that is often forgotten give the same rows."""
    rows = awkward(ODD)
    scan, merge_runs = alignment._scan, alignment.merge_runs
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    monkeypatch.setattr(alignment, "CHUNK", chunk)

    def small(byte_path, piece_path):
        def run(batches):
            alignment.CHUNK, alignment.WORDS = chunk, remembered
            yield from scan(byte_path, piece_path)(batches)

        return run

    levels = []
    monkeypatch.setattr(alignment, "_scan", small)
    monkeypatch.setattr(alignment, "merge_runs", lambda runs, groups, *more: levels.append(groups) or merge_runs(runs, groups, *more))
    got = alignment.align(frame(spark, rows).coalesce(2), A_PATH, B_PATH).collect()
    assert levels[0] == 1 if chunk > 10_000 else levels[0] > fan_in
    want = alignment_by_hand(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:7])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] in (None, g[7]) for g, w in zip(got, want, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("ab é▁\n\t1'.中ſ \x85\x1c") + ["the", "'s", "  "]), min_size=1, max_size=12).map("".join), min_size=1, max_size=5))
def test_segments_cut_like_whole_texts(texts):
    """Tokens of the segments, one after the other, are those of the whole text."""
    t = alignment.tokenizers(A_PATH, B_PATH)
    for text in texts:
        parts = t.segments(text)
        assert " ".join(parts) == text
        assert [i for s in parts for i in t.a.encode_ordinary(f" {s}")] == t.a.encode_ordinary(f" {text}")
        assert [i for s in parts for i in t.b.encode(s)] == t.b.encode(text)


def test_alignment_of_nothing(spark):
    assert alignment.align(frame(spark, []), A_PATH, B_PATH).count() == 0
    rows = [(r[0], None, *r[2:]) for r in corpus()[:3]]
    assert {tuple(r)[1:] for r in alignment.align(frame(spark, rows), A_PATH, B_PATH).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_merge_is_by_a_id():
    rng = np.random.default_rng(3)
    runs, want = [], Counter()
    for _ in range(7):
        pairs = np.unique(rng.integers(0, 1 << 8, rng.integers(0, 60)))
        counts = rng.integers(1, 5, len(pairs))
        runs.append((pairs, counts))
        for p, c in zip(pairs.tolist(), counts.tolist(), strict=True):
            want[p] += c
    parts = list(alignment.merged(runs, 4))
    assert all(len(set(p >> 4)) == 1 for p, _ in parts)
    assert [x for p, _ in parts for x in p] == sorted(want)
    assert {int(p): int(c) for ps, cs in parts for p, c in zip(ps, cs, strict=True)} == want


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(1, 8), st.integers(0, 1 << 20))
def test_strassen_is_exact(m, k, n, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << 62), 1 << 62, (m, k)), rng.integers(-(1 << 62), 1 << 62, (k, n))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("score", T.StringType()), T.StructField("row", T.StringType()), T.StructField("anchor", T.LongType())])


def vector_rows(seed, count):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0.2, 1, 6).round(1).tolist(), "s", "r", 1) for i in range(count)]
    rows[3] = (3, None, rows[3][2], "s", "r", 1)
    rows[4] = (4, 1, None, "s", "r", 1)
    rows[5] = (5, 1, [1.0, None], "s", "r", 1)
    rows[6] = (6, 1, [float("nan"), 1.0], "s", "r", 1)
    rows[7] = (7, 1, [float("-inf")], "s", "r", 1)
    rows[8] = (None, 1, [1.0] * 6, "s", "r", 1)
    rows[9] = (9, 2, [], "s", "r", 1)
    rows[11] = (11, 2, [1.0, 2.0], "s", "r", 1)
    rows[12] = (12, *rows[13][1:])
    return rows


def negatives_by_hand(rows, every):
    known = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, q in known:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=False)), j, k) for j, k, r in known if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, t) for t, n, k in scored if k != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, rank, n, -s, -t) for rank, (n, t) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "slice_rows", "tile"), [(4096, 16_384, 512), (5, 30, 7)])
def test_negatives_against_brute_force(spark, monkeypatch, anchors, slice_rows, tile):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "ROWS", slice_rows)
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = vector_rows(5, 150)
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("id") % 4 == 0).collect()
    want = negatives_by_hand(rows, 4)
    assert want and sorted(map(tuple, got)) == want


def test_negatives_of_repeats_and_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("id") % 4 == 0).count() == 0
    same = [(i, i % 2, [1.0, 1.0], "s", "r", 1) for i in range(40)] + [(100, 1, [0.9, 0.9], "s", "r", 1)]
    got = negatives.hard_negatives(spark.createDataFrame(same, VECTORS), F.col("id") == 0).collect()
    assert {r["positive_id"] for r in got} == {2, 4, 6, 8, 10} and {r["negative_id"] for r in got} == {100}
    twice = negatives.hard_negatives(spark.createDataFrame(same + same[:3], VECTORS), F.col("id") == 0).collect()
    assert {(r["positive_id"], r["negative_id"]) for r in twice} == {(2, 100), (4, 100), (6, 100), (8, 100)}
    with pytest.raises(TypeError):
        negatives.hard_negatives(spark.createDataFrame([("a", 1, [1.0])], "id string, label int, vector array<double>"), F.lit(True))


def test_clashing_columns_are_left_alone(spark):
    assert set(SCHEMA.names) & {"n", "score", "size", "start", "label"}
    rng = __import__("random").Random(2)
    rows = [(1, prose(rng, 30) + " released under the mit license", "en", "a", 3, "0", 1, 2, 3, "s", "f", "l")]
    assert licenses.scan_licenses(frame(spark, rows)).first()["labels"] == "mit"


def test_hot_keys_are_routed_otherwise_and_give_the_same(spark, monkeypatch):
    """Keys that count as hot are broadcast, others shuffled: the rows are the same."""
    from framelens.llm import common, suffixes, superkmers

    docs = frame(spark, awkward() * 3)
    plain = [sorted(map(str, f(docs).collect())) for f in (superkmers.remove_seen_windows, suffixes.remove_repeats)]
    monkeypatch.setattr(common, "LEAST_HOT", 1)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    assert [sorted(map(str, f(docs).collect())) for f in (superkmers.remove_seen_windows, suffixes.remove_repeats)] == plain
