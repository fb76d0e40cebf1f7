"""Secret scans with structural confirmation.

Patterns find the base spans. Long runs of base64 or hex are then decoded, and a further span is reported only where the bytes
parse: a DER private key whose nested lengths add up, an OpenSSH key whose length-prefixed fields fill it, or a signed token
whose header is JSON that names an algorithm. A run that doesn't parse adds nothing.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from splitmark.llm.common import map_rows

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LONG = re.compile(r"(?<!\S)\S{32,}")
RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
RUN16 = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s]+?)-----END (?:[A-Z]+ )*PRIVATE KEY-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at``, or None where its length doesn't fit before ``end``."""
    if at + 2 > end:
        return None
    tag, length, start = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        length, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (tag, start, start + length) if start + length <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill [at, end) exactly."""
    found = []
    while at < end:
        if (e := _element(data, at, end)) is None:
            return None
        found.append(e)
        at = e[2]
    return found


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, PKCS#8 or SEC1 private key: one SEQUENCE over all bytes, a version, then the fields of that form."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    if len(parts) >= 9 and version in (0, 1) and all(t == 0x02 for t in tags[:9]):
        return parts[1][2] - parts[1][1] >= 32
    if len(parts) >= 3 and version in (0, 1) and tags[1] == 0x30 and tags[2] == 0x04:
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and parts[2][2] - parts[2][1] >= 16
    return len(parts) >= 2 and version == 1 and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])


def is_openssh_key(data: bytes) -> bool:
    """The format's magic, then cipher, kdf, options, key count, public keys and the private part, each with its length."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if not field() or not field() or field() is None or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys)) and bool(field()) and at == len(data)


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_json(part: str, key: str = "") -> bool:
    try:
        value = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (not key or isinstance(value.get(key), str))


def _key_kind(data: bytes | None) -> str:
    return "" if not data else "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else ""


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, in code points, end exclusive, by start and then kind. Null counts as empty."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if LONG.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        more = set()
        for m in RUN64.finditer(text):
            if kind := _key_kind(_decoded(m[0])):
                more.add((m.start(), m.end(), kind))
        for m in RUN16.finditer(text):
            if kind := _key_kind(bytes.fromhex(m[0])):
                more.add((m.start(), m.end(), kind))
        for m in TOKEN.finditer(text):
            if _is_json(m[1], "alg") and _is_json(m[2]):
                more.add((m.start(), m.end(), "jwt"))
        found += more
    if "-----BEGIN " in text:
        found += {(m.start(), m.end(), kind) for m in BLOCK.finditer(text) if (kind := _key_kind(_decoded("".join(m[1].split()))))}
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span, overlapping ones merged, replaced by a mark with the first one's kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, spans array<struct<start, end, kind>>).

    Null or empty text: no spans. Repeated rows: one result each. An empty table gives an empty result. Only the two named
    columns are read, so others may have any name. Spans may overlap across kinds, never within a base kind. Texts are scanned
    whole.
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, [dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans_of(text)]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], f"{id_col} {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>", step)


def remove_secrets(df: DataFrame) -> DataFrame:
    """``documents`` with the spans masked and ``n_chars`` counted anew; every document stays, and all columns keep their places."""
    rest = [c for c in df.columns if c not in ("text", "n_chars")]

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *others, text, n in rows:
            if spans := spans_of(text):
                text = masked(text, spans)
                n = len(text)
            yield *others, text, n

    order = [*rest, "text", "n_chars"]
    return map_rows(df, order, df.select(order).schema, step).select(df.columns)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def op10_secret_scan(df: DataFrame) -> DataFrame:
    """The contract's columns from the spans that :func:`spans_of` finds in each whole text."""

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            spans = spans_of(text)
            base = [s for s in spans if s[2] in KINDS[:3]]
            counts = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            yield doc_id, *counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)

    return map_rows(df, ["doc_id", "text"], "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", step)
