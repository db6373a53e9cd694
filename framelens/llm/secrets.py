"""Secret scans with structural confirmation.

Three plain patterns (assignments, access keys, long hexadecimal runs) are always reported.
Beyond them a candidate is reported only when its structure holds:

* ``token``: three base64url parts whose first decodes to a JSON object with "alg", and
  whose second decodes to a JSON object (signed-token header);
* ``der``: base64 or hexadecimal text that decodes to a DER sequence whose length fields,
  nested ones included, fill the bytes exactly, and that holds an integer or a key object;
* ``ssh``: base64 that decodes to the length-prefixed fields of an SSH public or private key;
* ``pem``: an armoured block whose body decodes to either of the last two.

An encoded key may begin anywhere in a run of base64 or hexadecimal text (behind a path or a
label, say): every place where the first bytes of a structure could stand is tried, and the
structure's own length says where it ends. Nesting may have any depth.

Spans are code points, end exclusive. Every whole text is scanned. Per-row work only: no
shuffle.

Defined results: null text is empty and has no spans; rows are scanned one by one, repeats
included; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import free

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "token", "der", "ssh", "pem")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Whatever could be encoded in base64 or hexadecimal: at least 24 characters without a break.
_LONG = re.compile(r"[A-Za-z0-9+/_=.-]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_ANY_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")

INTEGER, BIT_STRING, OCTET_STRING, OBJECT, SEQUENCE, SET = 0x02, 0x03, 0x04, 0x06, 0x30, 0x31
#: Tags of DER elements that hold no others.
PLAIN_TAGS = frozenset((0x01, INTEGER, BIT_STRING, OCTET_STRING, 0x05, OBJECT, 0x0C, 0x13, 0x16, 0x17, 0x18))
#: Within a longer run a sequence must be this long and begin like a key, since chance finds shorter ones.
LEAST_INNER = 24
INNER_FIRST = (b"\x02", b"\x30", b"\x06")
#: How base64 of a DER sequence, of length-prefixed fields and of "openssh-key-v1" begins.
_SSH_HEAD = re.compile(rb"openssh-key-v1\x00|\x00\x00\x00.(?:ssh|ecdsa|sk)-", re.DOTALL)
_BASE64_STARTS = re.compile("M[A-I]|AAAA[A-E]|b3BlbnNzaC1rZXkt")


def decoded(text: str) -> bytes | None:
    """Bytes of plain or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the content starts) of the DER length field at a position."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    count = first & 0x7F
    if not 1 <= count <= 4 or at + 1 + count > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + count], "big"), at + 1 + count


def der_tags(data: bytes) -> set[int] | None:
    """Tags within data if its elements, nested ones included, fill it exactly, else None."""
    tags: set[int] = set()
    waiting = [(0, len(data))]
    while waiting:
        at, end = waiting.pop()
        while at < end:
            tag, found = data[at], der_length(data, at + 1)
            if found is None or found[1] + found[0] > end:
                return None
            size, start = found
            tags.add(tag)
            if tag in (SEQUENCE, SET) or 0xA0 <= tag <= 0xA7:
                waiting.append((start, start + size))
            elif tag not in PLAIN_TAGS and not 0x80 <= tag <= 0x87:
                return None
            at = start + size
    return tags


def is_der_key(data: bytes) -> bool:
    if len(data) < 16 or data[0] != SEQUENCE:
        return False
    tags = der_tags(data)
    return tags is not None and (INTEGER in tags or OBJECT in tags)


def der_size(head: bytes) -> int | None:
    """Bytes of the sequence that begins with head, by its length field; None if head begins none."""
    found = der_length(head, 1) if head[:1] == bytes([SEQUENCE]) else None
    return None if found is None else found[0] + found[1]


def inner_spans(text: str) -> list[tuple[str, int, int]]:
    """Structures that begin anywhere in a run of base64 characters."""
    found, after = [], 0
    for m in _BASE64_STARTS.finditer(text):
        at = m.start()
        if at < after:
            continue
        if m.group()[0] == "M":
            size = der_size(decoded(text[at : at + 8]) or b"")
            if size is None or size < LEAST_INNER or at + -(-size * 4 // 3) > len(text):
                continue
            end = at + -(-size * 4 // 3)
            raw = decoded(text[at:end])
            if raw and raw[0] == SEQUENCE and len(raw) >= size and raw[der_head(raw) :][:1] in INNER_FIRST and is_der_key(raw[:size]):
                found.append(("der", at, end))
                after = end
        else:
            if not _SSH_HEAD.match(decoded(text[at : at + 64 if at + 64 <= len(text) else at + (len(text) - at) // 4 * 4]) or b""):
                continue
            raw = decoded(text[at : at + (len(text) - at) // 4 * 4] if (len(text) - at) % 4 == 1 else text[at:])
            if raw and is_ssh_key(raw):
                found.append(("ssh", at, len(text)))
                after = len(text)
    return found


def der_head(raw: bytes) -> int:
    """Bytes of the tag and the length field."""
    return der_length(raw, 1)[1]


def inner_hex(text: str) -> list[tuple[int, int]]:
    """Sequences that begin anywhere in a run of hexadecimal digits."""
    found, at = [], text.find("30")
    while at >= 0:
        size = der_size(bytes.fromhex(text[at : at + (12 if at + 12 <= len(text) else (len(text) - at) // 2 * 2)]))
        end = at + 2 * (size or 0)
        if size and size >= LEAST_INNER and end <= len(text):
            raw = bytes.fromhex(text[at:end])
            if raw[der_head(raw) :][:1] in INNER_FIRST and is_der_key(raw):
                found.append((at, end))
                at = text.find("30", end)
                continue
        at = text.find("30", at + 1)
    return found


def is_ssh_key(data: bytes) -> bool:
    """openssh-key-v1 blocks, or length-prefixed fields that begin with a key type and fill the bytes."""
    if data.startswith(b"openssh-key-v1\0"):
        data, fields = data[15:], 3  # cipher, key derivation and its options
    else:
        fields = None
    at, count = 0, 0
    while at < len(data) and (fields is None or count < fields):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        if fields is None and count == 0 and not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{2,40}", data[4 : 4 + size]):
            return False
        at, count = at + 4 + size, count + 1
    return count >= (fields or 2)


def is_signed_token(header: str, payload: str) -> bool:
    for part, needs in ((header, "alg"), (payload, None)):
        raw = decoded(part)
        if raw is None or not raw.startswith(b"{"):
            return False
        try:
            value = json.loads(raw)
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (needs and needs not in value):
            return False
    return True


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans whose structure is confirmed by decoding."""
    found = []
    for run in _LONG.finditer(text):
        part, offset = run.group(), run.start()
        for m in _TOKEN.finditer(part):
            if is_signed_token(m.group(1), m.group(2)):
                found.append(("token", offset + m.start(), offset + m.end()))
        for m in _BASE64.finditer(part):
            raw = decoded(m.group())
            kind = ("der" if is_der_key(raw) else "ssh" if is_ssh_key(raw) else None) if raw else None
            if kind:
                found.append((kind, offset + m.start(), offset + m.end()))
            else:
                found += [(k, offset + m.start() + a, offset + m.start() + b) for k, a, b in inner_spans(m.group().rstrip("="))]
        for m in _ANY_HEX.finditer(part):
            if len(m.group()) % 2 == 0 and is_der_key(bytes.fromhex(m.group())):
                found.append(("der", offset + m.start(), offset + m.end()))
            else:
                found += [("der", offset + m.start() + a, offset + m.start() + b) for a, b in inner_hex(m.group())]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            raw = decoded("".join(m.group(2).split()))
            if raw and (is_der_key(raw) or is_ssh_key(raw)):
                found.append(("pem", m.start(), m.end()))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain patterns: leftmost matches that do not overlap, per kind; short ones go."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Runs are maximal, so asking for 24 characters at once gives the same spans.
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


FOUND = "n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def _scanned(text: str | None) -> tuple:
    text = text or ""
    base, more = base_spans(text), confirmed(text)
    counts = [sum(s[0] == kind for s in base) for kind in KINDS[:3]]
    return (*counts, len(more), sha256(listed(base).encode()).hexdigest(), listed(base + more))


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_confirmed, base_sha256 and spans (columns of those names are replaced)."""
    names = [part.split()[0] for part in FOUND.split(", ")]

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_scanned(t) for t in texts], columns=names)

    own = free("_found", docs.columns)
    out = docs.withColumn(own, scan(text_col))
    return out.select(*[c for c in docs.columns if c not in names], *[F.col(f"{own}.{n}").alias(n) for n in names])


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """docs with every found span of text replaced by mask (overlapping spans as one); n_chars follows changed texts."""

    @F.pandas_udf("string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else masked(t, mask) for t in texts], dtype=object)

    name = free("_masked", docs.columns)
    out = docs.withColumn(name, scan("text"))
    changed = F.coalesce(F.col(name) != F.col("text"), F.lit(False))
    own = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, F.length(name)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[own[c].alias(c) if c in own else c for c in docs.columns])


def masked(text: str, mask: str) -> str:
    spans = sorted((start, end) for _, start, end in base_spans(text) + confirmed(text))
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
