"""Packing, fingerprints, mixing, scans, rules and classifiers on an awkward corpus."""

import base64
import hashlib
import json
import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framelens.llm import fingerprints, mixing, outliers, packing, quality, registry, secrets, toxicity
from tests.oracle import connect, differences

from .fixtures import SCHEMA, corpus, frame, prose, words

PATH = public_tokenizers.path(packing.VOCABULARY)
SMOOTHING = 0.03


def doubled(rows):
    return rows + [rows[2], (None, *rows[8][1:])]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = doubled(corpus())
    tokenizer = Tokenizer.from_file(PATH)
    pieces = packing.pack_documents(frame(spark, rows).coalesce(2), PATH).collect()
    want = Counter()
    for r in rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want[(r[0], len(ids))] += len(ids)
    got = Counter()
    for p in pieces:
        got[(p["doc_id"], p["doc_tokens"])] += p["length"]
    assert got == want
    by_id = {r[0]: np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows}
    for p in pieces:
        assert p["ids_crc32"] == crc32(by_id[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert sum(sum(n for _, n in parts) < packing.LENGTH for parts in sequences.values()) <= 2


def test_packing_balances_cost():
    lengths = np.random.default_rng(0).integers(1, 1500, 400)
    pieces = packing.pack(lengths)
    filled = Counter()
    for _, _, n, k, _ in pieces:
        filled[k] += n
    assert sum(v for v in filled.values()) == lengths.sum() and len(filled) == -(-int(lengths.sum()) // 2048)
    assert len(pieces) < 1.5 * len(lengths)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "ΑΣ ΣΑΣ. İ", "it's ok'll \x01 x\x01y", "word...?! a.b,c   　z", "½ Ⅷ 日本語。テスト", "a\x1cb c\x1d d\x1e\x1f e", ""])
def test_tokens_equal_the_library(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(next(iter(packing.Tokens(PATH)([text]))), "<u4").tolist() == want


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RUN", 7)
    rows = doubled(corpus())
    got = fingerprints.fingerprints_with_edits(frame(spark, rows).repartition(3)).collect()
    digests = {r["t"]: r["h"] for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digests[r[1] or ""], r[1] or ""))
    want = []
    for k, r in enumerate(order):
        own, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        want.append((r[0], len(own), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got), key=str) == sorted(want, key=str)
    prints = {}
    for g in got:
        if g["doc_id"] is not None:
            prints[g["doc_id"]] = g["fingerprint"]
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    assert prints[2] == prints[3] and prints[31] == prints[32] == "" and prints[34] != ""


def test_similar_fingerprints(spark):
    rows = corpus()
    made = fingerprints.fingerprints(frame(spark, rows).select("doc_id", "text"))
    found = {(r["left"], r["right"]) for r in fingerprints.similar_fingerprints(made).collect()}
    first = {}
    for r in sorted(made.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(r["fingerprint"], r["doc_id"])
    sets = {i: fingerprints.decoded(f) for f, i in first.items() if f}
    assert found == {(a, b) for a in sets for b in sets if a < b and fingerprints.pruned_jaccard(sets[a], sets[b]) >= 0.8}


def test_mixing_oracle(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        assert differences(registry.op4_mix_sources(spark, d), connect(d), mixing.ORACLE) == ""


def test_mixing(spark):
    rows = doubled(corpus())
    df = frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert Counter(g["doc_id"] for g in got) == Counter(r[0] for r in rows)
    total = sum(len(words(r[1])) for r in rows)
    targets = {(g["source_size"], g["target"]) for g in got}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 and all(t <= 2 * s for s, t in targets)
    assert all(g["taken"] <= 2 * g["size"] for g in got)
    largest = max(g["size"] for g in got)
    for s, t in targets:
        assert abs(sum(g["taken"] for g in got if g["source_size"] == s) - t) <= largest / 2 + 1
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(g["copies"] for g in got)


def test_mixing_unequal_probabilities(spark):
    rows = [(i, "w " * 10, "en", "a", 20, float(1 + i % 2)) for i in range(2000)] + [(5000 + i, "w " * 10, "en", "b", 20, 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, weight double")
    got = mixing.mix_sources(df, (1, 1), 0.6, 2.0, "weight").toPandas()
    own = got[got.doc_id < 5000]
    odd, even = own[own.doc_id % 2 == 1].copies.mean(), own[own.doc_id % 2 == 0].copies.mean()
    assert abs(own.taken.sum() - own.target.iloc[0]) <= 10 and 1.6 < odd / even < 2.4


def base_rules(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rules(spark):
    rows = doubled(corpus())
    rows.append((900, "a b c d e f g h i\n#x <y>\n#x <y>\na b c d e f g h i j " + prose(random.Random(3), 60), "en", "a", 1, None, 1, 2, 3, "s", "f", "l"))
    got = outliers.robust_outliers(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str((g["doc_id"], *(g[n] for n in names))) for g in got)) == sorted(str((r[0], *base_rules(r[1]))) for r in rows)
    assert not any(g["kept"] and g["base_failed"] for g in got)


def test_outliers_are_rejected(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(50, 400)), "en", "a", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(f"{x}***" for x in prose(rng, 100).split()), "en", "a", 1) for i in range(20)]
    got = outliers.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    assert got[got.doc_id < 1000].kept.mean() > 0.99 and not got[got.doc_id >= 1000].kept.any()


def der(*parts):
    body = b"".join(bytes([2, len(p)]) + p for p in parts)
    return bytes([0x30, 0x82]) + len(body).to_bytes(2, "big") + body


def test_secrets(spark):
    key = der(b"\x00", b"\x11" * 40, b"\x03", b"\x22" * 40)
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    token = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.{'c2lnbmF0dXJlc2ln'}"
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----"
    ssh = base64.b64encode(b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + b"k" * 32).decode()
    text = f"α Password: 'hunter22' token = token = abcdefgh AKIA{'Z' * 16} {'ab12' * 7} {token} {base64.b64encode(key).decode()} {ssh}\n{pem} secret:abc {key.hex()}"
    kinds = Counter(s[0] for s in secrets.base_spans(text) + secrets.confirmed(text))
    assert kinds["token"] == 1 and kinds["der"] == 2 and kinds["ssh"] == 1 and kinds["pem"] == 1 and kinds["access"] == 1
    for kind, a, b in secrets.base_spans(text):
        if kind == "assign":
            assert text[a:b].lower().startswith(("password", "token"))
    broken = base64.b64encode(key[:-1]).decode()
    assert not secrets.confirmed(f"{broken} {'A' * 64} a.b.c {part({'typ': 1})}.{part({})}.abcdefgh")
    rows = doubled(corpus())
    rows.append((901, text, "en", "a", 1, None, 1, 2, 3, "s", "f", "l"))
    df = frame(spark, rows)
    got = secrets.find_secrets(df).collect()
    assert len(got) == len(rows)
    own = next(g for g in got if g["doc_id"] == 901)
    assert own["spans"] == secrets.listed(secrets.base_spans(text) + secrets.confirmed(text)) and own["n_confirmed"] == 5
    assert own["base_sha256"] == hashlib.sha256(secrets.listed(secrets.base_spans(text)).encode()).hexdigest()
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert after[31] is None and "hunter22" not in after[901] and token not in after[901] and after[35] == rows[35][1]


def labelled(spark, kind):
    rng = random.Random(9)
    bad = {"toxic": lambda t: t + " " + " ".join(rng.choices(["idiotic", "morons", "scumbag"], k=3)), "quality": lambda t: " ".join(f"{w}$$$" for w in t.split())}[kind]
    rows, labels = [], []
    for i in range(600):
        hit = i % 4 == 0
        t = prose(rng, rng.randint(20, 80))
        rows.append((i, bad(t) if hit else t, "en", "a", None if i == 7 else len(t), "x", 1, 2, 3, "s", "f", "l"))
        labels.append((i, None if i == 9 else int(hit) if kind == "toxic" else 1 - int(hit)))
    return frame(spark, rows + [(None, None, None, None, None, None, 1, 2, 3, "s", "f", "l")]), spark.createDataFrame(labels, f"doc_id long, {kind} int")


@pytest.mark.parametrize(("kind", "operator", "folds", "held"), [("toxic", toxicity.toxic_scores, 3, 1), ("quality", quality.quality_scores, 5, 0)])
def test_classifiers(spark, kind, operator, folds, held):
    docs, labels = labelled(spark, kind)
    got = operator(docs, labels).toPandas()
    assert len(got) == 601 and got.score.between(0, 1).all()
    known = {r["doc_id"]: r[kind] for r in labels.collect()}
    out = got[got.held_out & got.doc_id.notna()]
    assert all(crc32(str(int(i)).encode()) % folds == held for i in out.doc_id)
    right = [int(known[int(i)]) == p for i, p in zip(out.doc_id, out.predicted, strict=True) if known[int(i)] == known[int(i)] and known[int(i)] is not None]
    assert np.mean(right) > 0.95
    again = operator(docs.repartition(5), labels).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score, atol=1e-6)


@pytest.mark.parametrize("operator", [toxicity.toxic_scores, quality.quality_scores])
def test_classifiers_without_labels(spark, operator):
    docs = frame(spark, corpus())
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert operator(docs, labels).where(F.col("score").isNull()).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    size = quality.WORD_BUCKETS + quality.STATISTICS
    m = quality.Machine(0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, quality.FACTORS)))
    ids, stats = np.array([3, 10, 500]), rng.random(quality.STATISTICS)
    at = np.concatenate([ids, np.arange(quality.WORD_BUCKETS, size)])
    x = np.concatenate([np.full(3, 1 / np.sqrt(3)), stats])
    z = m.w0 + m.w[at] @ x + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.score(ids, stats) - 1 / (1 + np.exp(-z))) < 1e-9


@pytest.mark.parametrize("operator", [lambda d: packing.pack_documents(d, PATH), fingerprints.fingerprints_with_edits, mixing.mix_sources, mixing.mixed_documents, outliers.robust_outliers, secrets.find_secrets, secrets.redact])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ratios_and_features():
    texts, labels = ["abcd ef", "abcd abcd xyzzy", "", "xyzzy éé"], [1, 0, 1, 0]
    features = toxicity.Features()

    def plain(text):
        """The n-grams of a text, spelt out."""
        return {p[i : i + n] for w in text.lower().split() for p in [f" {w} "] for n in toxicity.SIZES for i in range(len(p) - n + 1)}

    for t in texts:
        assert len(features(t)) == len(plain(t))
    for a in texts:
        for b in texts:
            assert len(np.intersect1d(features(a), features(b))) == len(plain(a) & plain(b))
    counts = np.zeros((2, 1 << toxicity.BITS), int)
    for t, k in zip(texts, labels, strict=True):
        counts[k][features(t)] += 1
    ratios = toxicity.log_count_ratios(counts[0], counts[1], 2, 2, SMOOTHING)
    assert np.allclose(ratios[features("éé")], np.log(0.0 + 0.03) - np.log(0.5 + 0.03))
    own = features("abcd")
    assert np.allclose(ratios[own], 0.0)
    assert np.allclose(ratios[np.setdiff1d(features("xyzzy"), own)], np.log(0.03) - np.log(1.03))


def test_logistic_separates():
    rng = np.random.default_rng(5)
    labels = np.repeat([0.0, 1.0], 150)
    found = [np.flatnonzero(rng.random(40) < 0.2 + 0.5 * (k * np.arange(40) / 40)).astype(np.int32) for k in labels]
    ratios = np.linspace(-1, 1, 40)
    w, b = toxicity.logistic(found, labels, ratios)
    model = toxicity.Model(np.arange(40, dtype=np.int32), ratios, w, b)
    score = model.scorer()
    plain = [1 / (1 + np.exp(-(b + sum(w[f] * ratios[f]) / np.sqrt(sum(ratios[f] ** 2))))) for f in found]
    assert np.allclose([score(f) for f in found], plain, atol=1e-5)
    assert np.mean((np.array(plain) > 0.5) == labels) > 0.9


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 20, f"word{i} other text", 10) for i in range(4000)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i % 20, i % 2) for i in range(300)], "_id long, label int")
    assert len(quality.sample_of(docs, labels, 5)) <= 10


def brute_mcd(x):
    """The operator's estimate for a single group, by plain loops: two starts, concentration, reweighting."""
    d = x.shape[1]
    steps = np.array(outliers.STEP)

    def floored(cov):
        cov = cov.copy()
        cov[np.diag_indices(d)] = np.maximum(np.diag(cov), steps**2)
        return cov

    def distances(m, cov):
        z = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
        return (z * z).sum(0)

    near = lambda v: np.round(v / 50) * 50
    low, mid, high = (np.sort(x, 0)[max(0, int(np.ceil(q * len(x))) - 1)] for q in (0.25, 0.5, 0.75))
    starts = [(near(mid), np.diag(np.maximum(near(high - low) / 1.349, steps) ** 2)), (x.mean(0), floored(np.cov(x.T, bias=True)))]
    results = []
    for m, cov in starts:
        for _ in range(outliers.STEPS):
            bins = np.floor(outliers.BINS_PER_E * np.log(distances(m, cov) + 1e-9))
            order = np.sort(np.unique(bins))
            counts = np.array([(bins == b).sum() for b in order])
            kept = order[np.concatenate([[0], np.cumsum(counts)[:-1]]) < outliers.SUBSET * len(x)]
            own = x[np.isin(bins, kept)]
            m, cov = own.mean(0), floored(np.cov(own.T, bias=True) * outliers.CONSISTENT_75)
        results.append((np.linalg.slogdet(cov)[1], m, cov))
    _, m, cov = min(results, key=lambda r: round(r[0], 6))
    own = x[distances(m, cov) <= outliers.CHI2_975]
    return distances(own.mean(0), floored(np.cov(own.T, bias=True) * outliers.CONSISTENT_975))


def test_outliers_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(30, 300)) + (" ***" * rng.randint(0, 4)) + ("\nHead\nHead" if i % 7 == 0 else ""), "en", "a") for i in range(200)]
    rows += [(1000 + i, " ".join(f"{x}***" for x in prose(rng, 100).split()), "en", "a") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = outliers.text_statistics(docs)
    x = stats.select("doc_id", *outliers._transformed()).toPandas().sort_values("doc_id")[outliers.STATS].to_numpy(float)
    got = outliers.robust_outliers(docs).toPandas().sort_values("doc_id")
    want = brute_mcd(x)
    assert np.allclose(got.distance, want, rtol=1e-4, atol=1e-4)
    assert (got.kept == (~got.base_failed & (want <= outliers.CHI2_999))).all()


def test_every_group_has_its_own_estimate(spark):
    """Two sources of one language whose ordinary texts differ: neither is an outlier of the other."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(50, 200)), "en", "plain") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{x.upper()}" for x in prose(rng, rng.randint(50, 200)).split()), "en", "loud") for i in range(300)]
    got = outliers.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert got.groupby(got.doc_id < 1000).kept.mean().min() > 0.95


def test_weighted_mix_reaches_its_target(spark):
    rows = [(i, "w " * 10, "a", 100.0 if i < 20 else 1.0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mixing.mix_sources(docs, (1,), 1.5, 2.0, "weight").toPandas()
    assert abs(got.taken.sum() - got.target.iloc[0]) <= 10 and (got.copies <= 2).all() and (got[got.doc_id < 20].copies == 2).all()


def test_secrets_anywhere_in_a_run():
    key = der(b"\x00", b"\x11" * 40, b"\x03", b"\x22" * 40)
    text = base64.b64encode(key).decode()
    for before in ("path/", "x-", "A" * 7):
        assert ("der", len(before), len(before) + len(text.rstrip("="))) in secrets.confirmed(before + text + "zz")
    assert secrets.confirmed("f" + key.hex() + "00") == [("der", 1, 1 + 2 * len(key))]
    deep = der(b"\x01" * 30)
    for _ in range(40):
        deep = bytes([0x30, 0x82]) + len(deep).to_bytes(2, "big") + deep
    assert [k for k, _, _ in secrets.confirmed(base64.b64encode(deep).decode())] == ["der"]


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "password=hunter22 x", "keep", "keep", "keep", 5)], "doc_id long, text string, _found string, _masked string, _made string, n_chars long")
    for made in (secrets.find_secrets(docs), secrets.redact(docs), fingerprints.fingerprints(docs)):
        row = made.first()
        assert row["_found"] == row["_masked"] == row["_made"] == "keep"


def test_structure_takes_no_longer_for_one_long_word():
    import time

    encode = quality.Encoder()
    began = time.perf_counter()
    for text in ("x" * 1_000_000, "ab" * 500_000, "漢" * 1_000_000, "a " * 300_000):
        encode(text, None)
    assert time.perf_counter() - began < 5
    a, b = (quality.structure(t, t.split(), len(set(t.split())), 1.0) for t in ("to to to be be or", "to be or to be to"))
    assert sum(x != y for x, y in zip(a, b, strict=True)) == 2 and a[-4] == 2 * 13 / 37


def test_smoothing_is_chosen_by_the_other_half():
    """Features that one text holds say nothing: the more there are, the more smoothing is chosen; halves without a label choose nothing."""
    rng = np.random.default_rng(1)
    n, common = 200, 40
    labels = np.arange(n) % 2 * 1.0
    half = np.arange(n) // 2 % 2
    found = [np.unique(np.concatenate([np.flatnonzero(rng.random(common) < (0.6 if y else 0.4)), common + 20 * i + np.arange(20)])).astype(np.int32) for i, y in enumerate(labels)]
    counts = np.zeros((4, common + 20 * n), np.int32)
    for f, y, h in zip(found, labels, half, strict=True):
        counts[2 * h + int(y)][f] += 1
    totals = np.array([np.sum((half == h) & (labels == k)) for h in (0, 1) for k in (0, 1)])
    assert toxicity.chosen_smoothing(counts, totals, found, labels, half) >= 0.03
    assert toxicity.chosen_smoothing(counts * 0, totals * [1, 0, 1, 1], found, labels, half) == toxicity.SMOOTHINGS[2]


def test_held_out_labels_are_never_learnt_from(spark):
    """Other labels in the held-out rows give the same scores."""
    rows = frame(spark, corpus())
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    for score_of, column, held in ((toxicity.toxic_scores, "toxic", fold % 3 == 1), (quality.quality_scores, "quality", fold % 5 == 0)):
        turned = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        a, b = (sorted((r["doc_id"], r["score"]) for r in score_of(rows, x).collect() if r["doc_id"] is not None) for x in (labels, turned))
        assert a == b
