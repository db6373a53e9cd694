"""Substring dedup (bytes and words) and the near-duplicate join against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelens.llm import components, forest, runs, suffixes, superkmers

from .fixtures import SCHEMA, corpus, frame, shingle_set, words


def brute_bytes(rows):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[p : p + 200] for _, t in texts for p in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows):
    least = {}
    for r in rows:
        w = words(r[1])
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            own = -(1 << 63) if r[0] is None else r[0]
            least[key] = min(least.get(key, own), own)
    out = []
    for r in rows:
        w, gone = words(r[1]), set()
        own = -(1 << 63) if r[0] is None else r[0]
        for p in range(len(w) - 49):
            if least[tuple(w[p : p + 50])] < own:
                gone.update(range(p, p + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_links(rows):
    sets = [shingle_set(r[1]) for r in rows]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    return [(r[0], min(classes[find(i)]), links[i]) for i, r in enumerate(rows)]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(params=[False, True], ids=["unique", "repeated"])
def rows(request):
    found = corpus()
    return found + [found[2], found[12], (7, "other text " * 30, *found[7][2:])] if request.param else found


@pytest.mark.parametrize("most", [50_000, 3])
def test_bytes(spark, rows, most, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", most)
    assert collected(suffixes.remove_repeats(frame(spark, rows).repartition(3))) == sorted(brute_bytes(rows), key=str)


@pytest.mark.parametrize("most", [50_000, 3])
def test_words(spark, rows, most, monkeypatch):
    monkeypatch.setattr(superkmers, "MOST", most)
    assert collected(superkmers.remove_seen_windows(frame(spark, rows).repartition(3))) == sorted(brute_words(rows), key=str)


def test_null_id(spark):
    rows = corpus()
    rows[12] = (None, *rows[12][1:])
    assert collected(superkmers.remove_seen_windows(frame(spark, rows))) == sorted(brute_words(rows), key=str)
    assert len(suffixes.remove_repeats(frame(spark, rows)).collect()) == len(rows)
    assert len(forest.near_duplicates(frame(spark, rows)).collect()) == len(rows)


@pytest.mark.parametrize("block", [128, 2])
def test_links(spark, rows, block, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", block)
    assert collected(forest.near_duplicates(frame(spark, rows))) == sorted(brute_links(rows), key=str)


def test_deduplicate(spark, rows):
    df = frame(spark, rows)
    kept = forest.deduplicate(df)
    assert kept.columns == df.columns
    want = Counter()
    for i, c, _ in brute_links(rows):
        want[c] += 1
    left = [r["doc_id"] for r in kept.collect()]
    empty = sum(not words(r[1]) for r in rows)
    full = {c for (i, c, _), r in zip(brute_links(rows), rows, strict=True) if words(r[1])}
    assert {r["doc_id"] for r in kept.collect() if words(r["text"])} == full
    assert len(left) == empty + len(forest_classes(rows))


def forest_classes(rows):
    """Classes of documents with words, apart by their texts where ids repeat."""
    sets = {}
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, r in enumerate(rows):
        if words(r[1]):
            sets[k], parent[k] = shingle_set(r[1]), k
    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {find(k) for k in sets}


@pytest.mark.parametrize("operator", [suffixes.remove_repeats, superkmers.remove_seen_windows, forest.near_duplicates, forest.deduplicate])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_depth_reaches_the_target():
    depth = forest.prefix_depth()
    assert 1 - (1 - 0.8**depth) ** forest.TREES >= forest.TARGET > 1 - (1 - 0.8 ** (depth + 1)) ** forest.TREES


def test_recall_on_a_table(spark):
    """All links of the small table, against brute force on the whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want, got = brute_links(rows), {r["doc_id"]: (r["class_id"], r["n_links"]) for r in forest.near_duplicates(docs).collect()}
    total, found = sum(n for _, _, n in want), sum(got[i][1] for i, _, _ in want)
    assert total > 50 and found >= 0.99 * total
    assert sum(got[i][0] == c for i, c, _ in want) >= 0.99 * len(want)


def test_recall_estimate_shortens_prefixes(spark, monkeypatch):
    """With one tree few pairs meet at first; the estimate asks for shorter prefixes."""
    assert forest.unseen([(1, 10), (2, 4)]) == 10 * 9 / (2 * 5) and forest.unseen([(3, 10)]) == 0
    depths = []
    plain = forest._candidates
    monkeypatch.setattr(forest, "unseen", lambda met: 5.0 if len(depths) < 3 else 0.0)
    monkeypatch.setattr(forest, "_candidates", lambda reps, depth, *more: depths.append(depth) or plain(reps, depth, *more))
    rows = corpus()
    assert collected(forest.near_duplicates(frame(spark, rows))) == sorted(brute_links(rows), key=str)
    assert depths == [6, 5, 4]


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(n, find(n)) for n in parent}


def test_multikey_matches_sorting():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    group = rng.integers(0, 5, 500)
    same, classes = runs.multikey(group, lambda at, c: items[at, c], 4)
    counts = Counter((g, *row) for g, row in zip(group.tolist(), items.tolist(), strict=True))
    want = {i for i in range(500) if counts[(int(group[i]), *items[i].tolist())] > 1}
    assert set(same.tolist()) == want
    keys = {}
    for i, c in zip(same.tolist(), classes.tolist(), strict=True):
        assert keys.setdefault(c, (int(group[i]), *items[i].tolist())) == (int(group[i]), *items[i].tolist())
