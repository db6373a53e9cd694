"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs about ``LINEAR`` n + ``QUADRATIC`` n^2 (attention within a piece).
Documents are tokenised and packed shard by shard. A shard is a run of consecutive documents
of one input partition with at most ``SHARD_TOKENS`` tokens (one document at least), so
nothing is shuffled and memory is bounded by a shard, whatever the size of the table.

Within a shard, documents longer than a sequence give whole sequences first. For what is
left the least number of sequences that holds it is opened. Pieces go, in descending length,
to the sequence of lowest cost that has room for all of them; one that fits nowhere whole is
cut, filling the cheapest sequences. So all sequences of a shard but one are full.

Token ids come from a public vocabulary through the tokenizers library. White space never
lies within a token, so texts are tokenised by the parts between white space, and each part
is remembered: a part that was seen before costs one look-up.

Defined results: null text is an empty text, which still has the closing id; repeated rows
are packed one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

LENGTH = 2048
CLOSING = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SHARD_TOKENS = 4_000_000
VOCABULARY = "word_bpe_49k.json"
#: Parts of texts whose ids a worker remembers.
REMEMBERED = 1_000_000
_MARK = "\x01"
#: ASCII punctuation, but for the apostrophe, right behind a letter: always the end of a word.
_WORD_END = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-zß-öø-ÿ].)", re.DOTALL)


#: White space of the vocabulary: unlike str.split, it does not part texts at U+001C to U+001F.
_SPACE = re.compile("[^\\S\x1c-\x1f]+")
_NO_SPACE = re.compile("[\x1c-\x1f]")


def parts_of(text: str) -> list[str]:
    """The parts of a text between the white space of the vocabulary."""
    return [p for p in _SPACE.split(text) if p] if _NO_SPACE.search(text) else text.split()


class Tokens:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, the closing id included."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.mark = self._ids(_MARK)
        self.closing = np.array([CLOSING], "<u4").tobytes()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, parts: set[str]) -> None:
        if len(self.known) + len(parts) > REMEMBERED:
            self.known = {"": b""}
        # The library's cost per call is high: many parts go in one text, kept apart by a mark.
        plain = [p for p in parts if _MARK not in p and p.isprintable()] if len(self.mark) == 1 else []
        for part in parts.difference(plain):
            self.known[part] = np.array(self._ids(part), "<u4").tobytes()
        for start in range(0, len(plain), 2000):
            some = plain[start : start + 2000]
            ids = np.array(self._ids(f" {_MARK} ".join(some)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            begins = np.append(0, ends[:-1] + 1)
            for part, a, b in zip(some, begins.tolist(), ends.tolist(), strict=True):
                self.known[part] = ids[a:b].tobytes()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            parts = parts_of(spaced(text or ""))
            try:
                yield b"".join(map(self.known.__getitem__, parts)) + self.closing
            except KeyError:
                self.learn({p for p in parts if p not in self.known})
                yield b"".join([self.known[p] if p in self.known else np.array(self._ids(p), "<u4").tobytes() for p in parts]) + self.closing


def spaced(text: str) -> str:
    """A text with the same ids, in lower case and with a space between words and what follows them.

    So fewer different parts need be remembered. Texts that could hold the name of a special
    token, or letters whose lower case depends on their place, are left as they are.
    """
    if "<|" in text or "\u03a3" in text or "\u0130" in text:
        return text
    return _WORD_END.sub(r" \g<0>", text.lower())


def pack(lengths: np.ndarray, size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard; every token in exactly one."""
    pieces, sequences = [], 0
    rest, begin = lengths % size, (lengths // size) * size
    for doc in np.flatnonzero(lengths >= size):
        for start in range(0, int(begin[doc]), size):
            pieces.append((int(doc), start, size, sequences, 0))
            sequences += 1
    left = int(rest.sum())
    open_ = -(-left // size)
    if not open_:
        return pieces
    room = np.full(open_, size)
    # The last one need not be full: what it could hold beyond the tokens that there are is taken off.
    room[-1] -= open_ * size - left
    filled, cost = np.zeros(open_, np.int64), np.zeros(open_)
    order = np.argsort(-rest, kind="stable")
    for doc in order[: np.count_nonzero(rest)]:
        start, n = int(begin[doc]), int(rest[doc])
        while n:
            fits = np.where(room >= n, cost, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:
                k = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(n, int(room[k]))
            pieces.append((int(doc), start, part, sequences + k, int(filled[k])))
            room[k] -= part
            filled[k] += part
            cost[k] += LINEAR * part + QUADRATIC * part * part
            start, n = start + part, n - part
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _tokens(tokenizer_path)
        base, shard = TaskContext.get().partitionId() << 40, 0
        ids, texts, total = [], [], 0
        for batch in batches:
            for doc_id, own in zip(batch["doc_id"], tokens(batch["text"].tolist()), strict=True):
                if texts and total + len(own) // 4 > SHARD_TOKENS:
                    yield _rows(ids, texts, base + (shard << 20), size)
                    ids, texts, total, shard = [], [], 0, shard + 1
                ids.append(doc_id)
                texts.append(own)
                total += len(own) // 4
        if texts:
            yield _rows(ids, texts, base + (shard << 20), size)

    # As text, an id of any type and size passes pandas unchanged, null included.
    kind = docs.schema["doc_id"].dataType
    as_text = docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text")
    out = as_text.mapInPandas(packed, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", out["doc_id"].cast(kind))


def _rows(ids: list, texts: list[bytes], first: int, size: int) -> pd.DataFrame:
    lengths = np.array([len(t) // 4 for t in texts])
    rows = [
        (ids[d], start, n, crc32(memoryview(texts[d])[4 * start : 4 * (start + n)]), int(lengths[d]), first + k, offset)
        for d, start, n, k, offset in pack(lengths, size)
    ]
    return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


_loaded: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    """One per worker process, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]
