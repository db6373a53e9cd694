"""Alignment of two tokenizers over a corpus by external spill counting.

Every text is cut by tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback).
Byte offsets where both end a token cut the tokens into groups; an A token and a B token are
linked where their bytes overlap. The count of a pair of ids is the number of documents that
hold it linked.

1. ``_scan`` cuts texts in chunks of about ``CHUNK`` characters. A chunk gives one row a
   document and, for every radix of the A id, a zstd run of records (pair, document, links),
   sorted with the A id leading. Both tokenizers start anew at every single space before a
   word, so a word's tokens, groups and links are worked out once and remembered in a bounded
   table; texts where that does not hold are cut whole.
2. ``_merge``: at most about ``FAN_IN`` runs of a radix are merged by a heap of their heads, A id
   by A id, which counts documents; merged runs are merged again until a radix has one. Since
   a merge has all pairs of an A id together, the last one also has their maximum. A task
   reads ``FAN_IN`` runs of bounded size, however often a pair occurs.
3. ``_contribute`` streams the runs of each group against the counts of their radix and sends
   back, for every document of a run, its best links and its sum of counts; ``_total`` adds
   them up.

Counts are bounded by the two vocabularies, never by documents; they are sent once to each
group of ``FAN_IN`` runs.

Defined results: null and empty texts, and texts whose tokens do not spell them (U+2581 in the
text, say), have zeros and ''; repeated rows are documents of their own; ids may be null or
repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import stored

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a run's texts, about, and most documents of it.
CHUNK, MOST_DOCS = 1 << 22, 1 << 20
#: Radixes of A ids (a power of two), and runs that are merged at once.
BUCKETS, FAN_IN = 64, 128
#: Words and characters of them that a task remembers.
WORDS, LETTERS = 600_000, 1 << 25
#: Where a tokenizer need not start anew at a space: before other white space, at the end, or at the piece mark.
_WHOLE = re.compile(r"▁| \s| $")
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Ids of both tokenizers for segments, each with a space before it, and the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(byte_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Words can be cut one by one only if no piece holds a space behind anything else.
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_bits, self.b_bits = (max(1, (len(x) - 1).bit_length()) for x in (self.a_bytes, self.b_bytes))

    def segments(self, text: str) -> list[str]:
        return text.split(" ") if self.by_word and not _WHOLE.search(text) and not text[:1].isspace() else [text]


@lru_cache(maxsize=1)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


def _plain(segment: str) -> bool:
    return bool(segment) and " " not in segment and not segment[0].isspace() and "▁" not in segment


class Words:
    """What segments give, worked out many at a time: numbers of tokens and groups, links, groups as text."""

    def __init__(self, t: Tokenizers) -> None:
        self.t = t
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (t.a_bytes, t.b_bytes)]
        # Decimal ids with what follows them: the next id, or what ends a side or a group.
        self.texts = [[f"{i}{end}".encode() for i in range(len(side)) for end in (",", last)] for side, last in ((t.a_bytes, "|"), (t.b_bytes, ";"))]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.letters = 0
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; -1 tokens where the bytes differ
        self.start = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.uint64)

    def add(self, segments: list[str]) -> None:
        """Works out the segments that are not known yet."""
        if len(self.index) > WORDS or self.letters > LETTERS:
            self.clear()
        new = list(set(segments).difference(self.index))
        if not new:
            return
        self.letters += sum(map(len, new))
        t = self.t
        raw = [b" " + s.encode() for s in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        # Words without white space go through the tokenizers together; where the bytes show that one was altered, one by one.
        ids = [np.array(t.a.encode_ordinary(" " + " ".join(new)), np.int64), np.fromiter(chain.from_iterable(t.b.encode(new, num_threads=1)), np.int64)] if t.by_word and all(map(_plain, new)) else None
        fine = np.ones(len(new), bool)
        if ids is None or any(b"".join(map(spelling.__getitem__, side.tolist())) != b"".join(raw) for side, spelling in zip(ids, (t.a_bytes, t.b_bytes), strict=True)):
            lists = [(t.a.encode_ordinary(f" {s}"), t.b.encode(s, num_threads=1)) for s in new]
            fine = np.array([all(b"".join(map(spelling.__getitem__, side)) == r for side, spelling in zip(both, (t.a_bytes, t.b_bytes), strict=True)) for both, r in zip(lists, raw, strict=True)])
            ids = [np.fromiter(chain.from_iterable(both[k] for both, f in zip(lists, fine, strict=True) if f), np.int64) for k in (0, 1)]
        numbers = np.full((len(new), 4), -1, np.int64)
        numbers[fine], links, strings = self._worked_out(*ids, np.cumsum(lengths[fine]))
        if not fine.all():
            found = iter(strings)
            strings = [next(found) if f else b"" for f in fine]
        self.index |= dict(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += strings
        n = np.maximum(numbers[:, 3], 0)
        self.start = np.concatenate([self.start, len(self.links) + np.cumsum(n) - n])
        self.links = np.concatenate([self.links, links])
        self.numbers = np.concatenate([self.numbers, numbers])

    def _worked_out(self, a: np.ndarray, b: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers, links and groups of words that end at these bytes, from their tokens end to end."""
        size = int(words[-1]) + 1 if len(words) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at_a[end_a] = at_b[end_b] = True
        ends = np.flatnonzero(at_a | at_b)
        both = np.flatnonzero(at_a & at_b)
        last_a, last_b = at_b[end_a], at_a[end_b]
        # Every stretch between two ends lies in one token of either side.
        behind_a, behind_b = np.cumsum(at_a), np.cumsum(at_b)
        links = self.places(a[behind_a[ends] - at_a[ends]]) << self.t.b_bits | b[behind_b[ends] - at_b[ends]]
        per = lambda at: np.diff(at[words], prepend=0)
        numbers = np.stack([per(behind_a), per(behind_b), per(np.cumsum(at_a & at_b)), per(np.cumsum(at_a | at_b))], 1)
        # Tokens group by group, those of A first.
        to_a, to_b = behind_a[both], behind_b[both]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        token = np.empty(len(a) + len(b), object)
        token[np.arange(len(a)) + np.concatenate([[0], to_b])[group_a]] = list(map(self.texts[0].__getitem__, (2 * a + last_a).tolist()))
        token[np.arange(len(b)) + to_a[group_b]] = list(map(self.texts[1].__getitem__, (2 * b + last_b).tolist()))
        tokens = token.tolist()
        stops = np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
        return numbers, links.astype(np.uint64), [b"".join(tokens[i:j]) for i, j in zip([0, *stops], stops, strict=False)]

    def places(self, a: np.ndarray) -> np.ndarray:
        """A ids with their radix, the low digits, moved to the front."""
        low = BUCKETS.bit_length() - 1
        return (a & (BUCKETS - 1)) << (self.t.a_bits - low) | a >> low


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers in the least widths that hold them, compressed."""
    narrow = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) for x in arrays]
    head = np.array([v for x in narrow for v in (len(x), x.itemsize)], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(x.tobytes() for x in narrow))


def unpack(data: bytes, count: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw, np.int64, 2 * count)
    out, at = [], 16 * count
    for n, width in head.reshape(count, 2).tolist():
        out.append(np.frombuffer(raw, f"u{width}", n, at).astype(np.int64))
        at += n * width
    return out


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=0)


class _Runs:
    def __init__(self, words: Words) -> None:
        self.words = words

    def rows(self, run: int, ids: list, texts: list[str | None]) -> Iterator[pd.DataFrame]:
        """The documents of a chunk, then its runs of records."""
        cut = [self.words.t.segments(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self.words.add(flat)
        w = self.words
        listed = list(map(w.index.__getitem__, flat))
        codes = np.array(listed, np.int64)
        sizes = np.array([len(c) for c in cut], np.int64)
        doc = np.repeat(np.arange(len(cut)), sizes)
        bad = np.bincount(doc, w.numbers[codes, 0] < 0, len(cut)) > 0
        kept = ~bad[doc]
        codes, doc = codes[kept], doc[kept]
        totals = np.stack([np.bincount(doc, w.numbers[codes, i], len(cut)).astype(np.int64) for i in range(4)], 1)
        hashes, end = [], 0
        for size, skip in zip(sizes.tolist(), bad.tolist(), strict=True):
            begin, end = end, end + size
            # Each segment's groups end in a semicolon; the last one's is dropped.
            hashes.append("" if skip or not size else sha256(b"".join(map(w.groups.__getitem__, listed[begin:end]))[:-1]).hexdigest())
        n = len(cut)
        yield pd.DataFrame({"run": run, "pos": np.arange(n), "doc_id": pd.array(ids, "Int64"), "n_a": totals[:, 0], "n_b": totals[:, 1], "n_groups": totals[:, 2], "n_links": totals[:, 3], "groups_sha256": hashes, "bucket": -1, "pairs": None, "docs": None})
        many = w.numbers[codes, 3]
        first = np.cumsum(many) - many
        links = w.links[np.repeat(w.start[codes] - first, many) + np.arange(int(many.sum()))]
        shift = np.uint64(MOST_DOCS.bit_length() - 1)
        key = np.sort(links << shift | np.repeat(doc, many).astype(np.uint64))
        if not len(key):
            return
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(new, len(key)))
        pair, own = (key[new] >> shift).astype(np.int64), (key[new] & np.uint64(MOST_DOCS - 1)).astype(np.int64)
        radix = pair >> (w.t.a_bits + w.t.b_bits - (BUCKETS.bit_length() - 1))
        edges = np.searchsorted(radix, np.arange(BUCKETS + 1))
        rows = []
        for bucket in range(BUCKETS):
            part = slice(edges[bucket], edges[bucket + 1])
            if part.start < part.stop:
                distinct, counts = np.unique(pair[part], return_counts=True)
                rows.append((bucket, pack(_steps(distinct), counts), pack(own[part], times[part] - 1)))
        yield pd.DataFrame(rows, columns=["bucket", "pairs", "docs"]).assign(run=run, pos=-1, doc_id=None, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256=None)


_SCANNED = "run long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, pairs binary, docs binary"


def _scan(byte_path: str, piece_path: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = _Runs(Words(tokenizers(byte_path, piece_path)))
        columns = [c.strip().split(" ")[0] for c in _SCANNED.split(",")]
        run = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(text)
                size += len(text or "")
                if size >= CHUNK or len(texts) == MOST_DOCS:
                    yield from (x[columns] for x in maker.rows(run, ids, texts))
                    run, ids, texts, size = run + 1, [], [], 0
        if texts:
            yield from (x[columns] for x in maker.rows(run, ids, texts))

    return scan


def merged(runs: list[tuple[np.ndarray, np.ndarray]], b_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) of each A id in ascending order, from runs of sorted distinct pairs with counts.

    A heap holds the next A id of every run; the runs that stand at the least one are merged.
    """
    edges, heads = [], []
    for k, (pairs, _) in enumerate(runs):
        a = pairs >> b_bits
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        edges.append([*starts.tolist(), len(a)])
        if len(a):
            heads.append((int(a[0]), k, 0))
    heapq.heapify(heads)
    while heads:
        least = heads[0][0]
        parts = []
        while heads and heads[0][0] == least:
            _, k, i = heads[0]
            pairs, counts = runs[k]
            begin, end = edges[k][i], edges[k][i + 1]
            parts.append((pairs[begin:end], counts[begin:end]))
            if end < len(pairs):
                heapq.heapreplace(heads, (int(pairs[end]) >> b_bits, k, i + 1))
            else:
                heapq.heappop(heads)
        if len(parts) == 1:
            yield parts[0]
        else:
            pairs, of = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            yield pairs, np.bincount(of, np.concatenate([c for _, c in parts])).astype(np.int64)


def _pieces(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator]]:
    """(values of keys, rows) of each group of rows that come sorted by keys."""
    rows = (r for batch in batches for r in batch.itertuples(index=False))
    yield from groupby(rows, lambda r: tuple(getattr(r, k) for k in keys))


def _merge(b_bits: int, last: bool) -> Callable:
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (bucket, group), rows in _pieces(batches, ["bucket", "grp"]):
            runs = [unpack(r.pairs, 2) for r in rows]
            done = list(merged([(np.cumsum(steps), counts) for steps, counts in runs], b_bits))
            pairs, counts = (np.concatenate(x) for x in zip(*done, strict=True))
            best = [np.concatenate([c == c.max() for _, c in done])] if last else []
            yield pd.DataFrame({"bucket": [bucket], "grp": [group], "pairs": [pack(_steps(pairs), counts, *best)]})

    return merge


def _contribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, rows in _pieces(batches, ["bucket", "grp"]):
        steps, counts, best = unpack(next(rows).pairs, 3)
        pairs = np.cumsum(steps)
        for r in rows:
            own, each = unpack(r.pairs, 2)
            docs, more = unpack(r.docs, 2)
            at = np.repeat(np.searchsorted(pairs, np.cumsum(own)), each)
            n = int(docs.max()) + 1
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], docs, (more + 1) * best[at])
            np.add.at(sums[1], docs, (more + 1) * counts[at])
            yield pd.DataFrame({"run": [r.run], "pairs": [pack(*sums)]})


def _total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by run, contributions (pos -1) before documents: the documents with their sums."""
    current, sums = None, np.zeros((2, 0), np.int64)
    for batch in batches:
        for run, rows in batch.groupby("run", sort=False):
            if run != current:
                current, sums = run, np.zeros((2, 0), np.int64)
            for data in rows.loc[rows["pos"] < 0, "pairs"]:
                own = np.stack(unpack(data, 2))
                if own.shape[1] > sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, own.shape[1] - sums.shape[1])))
                sums[:, : own.shape[1]] += own
            docs = rows[rows["pos"] >= 0]
            pos = docs["pos"].to_numpy().astype(np.int64)
            inside = pos < sums.shape[1]
            best, count = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            best[inside], count[inside] = sums[0, pos[inside]], sums[1, pos[inside]]
            yield docs[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].assign(n_best=best, count_sum=count, groups_sha256=docs["groups_sha256"])


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b_bits = tokenizers(byte_path, piece_path).b_bits
    scanned = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_scan(byte_path, piece_path), _SCANNED))
    rows = scanned.where("pos >= 0").select("run", "pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.lit(None).cast("binary").alias("pairs"))
    spilt = scanned.where("pos < 0")
    groups = max(1, math.ceil(scanned.where("pos = 0").count() / FAN_IN))
    grouped = F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int")
    counts = merge_runs(spilt.select("bucket", grouped.alias("grp"), "pairs"), groups, b_bits, parts)
    every = counts.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(-1).cast("long").alias("run"), "pairs", F.lit(None).cast("binary").alias("docs"))
    streams = every.unionByName(spilt.select("bucket", grouped.alias("grp"), "run", "pairs", "docs"))
    sent = streams.repartition(parts, "bucket", "grp").sortWithinPartitions("bucket", "grp", "run").mapInPandas(_contribute, "run long, pairs binary")
    back = sent.select("run", F.lit(-1).alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"))], "pairs")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return back.unionByName(rows).repartition(parts, "run").sortWithinPartitions("run", "pos").mapInPandas(_total, schema)


def merge_runs(runs: DataFrame, groups: int, b_bits: int, parts: int) -> DataFrame:
    """bucket, pairs (with documents and whether they are the most of their A id) from runs in groups: bucket, grp, pairs."""
    while True:
        dealt = runs.repartition(parts, "bucket", "grp").sortWithinPartitions("bucket", "grp")
        runs = dealt.mapInPandas(_merge(b_bits, groups == 1), "bucket int, grp int, pairs binary")
        if groups == 1:
            return stored(runs)
        groups = math.ceil(groups / FAN_IN)
        runs = runs.withColumn("grp", F.pmod("grp", F.lit(groups)).cast("int"))
