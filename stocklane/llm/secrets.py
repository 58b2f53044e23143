"""Secret scans: base patterns, and candidates confirmed by decoding and parsing their structure.

Base kinds (always reported): ``assign``, ``access``, ``hex``. Confirmed kinds are reported only after the
candidate decodes and its inner lengths agree: ``pem`` (armoured key whose body is DER, an SSH key or, by its
header, whole blocks of a sealed key), ``der`` (bare base64 or hex that is a DER key or certificate), ``ssh``
(base64 of length-prefixed SSH key fields whose inner lengths add up), ``jwt`` (signed-token header and payload are JSON objects).

Defined results: null and empty texts have no spans; spans are code points, end exclusive, and may overlap
across kinds; very long texts and runs are read in one pass; an empty table gives no rows; repeated rows are judged one by
one; other columns play no part.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import batches

KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Group 2 keeps its own letters: the class lists both cases, so ignoring case changes nothing there.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY|CERTIFICATE)-----((?:[A-Za-z0-9+/=\s:,.]++|-(?!----))*+)-----END \1-----")
#: A token starts where a run of its letters starts, so a long run is read once.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
BLOB = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
LONG_HEX = re.compile(r"[0-9a-f]{64,}|[0-9A-F]{64,}")

SEQUENCE, INTEGER, BITS, OCTETS, OID = 0x30, 0x02, 0x03, 0x04, 0x06
SSH_NAMES = (b"ssh-", b"ecdsa-", b"sk-")
SSH_MAGIC = b"openssh-key-v1\0"


def header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at``, if its length stays inside."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements of a DER body, if they fill it exactly."""
    found = []
    while at < end:
        one = header(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the bytes, whose own elements fill it and look like a key or certificate."""
    top = header(data, 0, len(data))
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    inner = elements(data, top[1], top[2])
    if not inner or len(inner) < 2:
        return False
    tags = [tag for tag, _, _ in inner]
    if tags[0] == INTEGER and len(inner) >= 3:  # private keys: version first, then numbers, octets or an algorithm
        return set(tags[1:]) <= {INTEGER, OCTETS, SEQUENCE, 0xA0, 0xA1}
    if tags[0] == SEQUENCE:  # public or sealed keys and certificates: nested elements must add up as well
        parts = elements(data, inner[0][1], inner[0][2])
        return bool(parts) and tags[-1] in (BITS, OCTETS) and parts[0][0] in (OID, INTEGER, 0xA0)
    return False


def fields(data: bytes, at: int = 0, count: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at``, all to the end or ``count`` of them, and where they end; None if one runs over."""
    found = []
    while at < len(data) if count is None else len(found) < count:
        if at + 4 > len(data):
            return None
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            return None
        found.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return found, at


def is_public_ssh_key(data: bytes) -> bool:
    """Fields that fill the bytes, a key type first."""
    found = fields(data)
    return found is not None and len(found[0]) > 1 and found[0][0].startswith(SSH_NAMES)


def is_ssh_key(data: bytes) -> bool:
    """A public key, or a private key file: cipher, key derivation and its options, the number of keys, as many public keys and
    one private part that ends the bytes; an open private part starts with its check number twice."""
    if not data.startswith(SSH_MAGIC):
        return is_public_ssh_key(data)
    head = fields(data, len(SSH_MAGIC), 3)
    if head is None or head[1] + 4 > len(data):
        return False
    (cipher, _, _), at = head
    (count,) = struct.unpack_from(">I", data, at)
    body = fields(data, at + 4)
    if body is None or not 1 <= count == len(body[0]) - 1 or not all(map(is_public_ssh_key, body[0][:-1])):
        return False
    private = body[0][-1]
    return len(private) >= 8 and len(private) % 8 == 0 and (cipher != b"none" or private[:4] == private[4:8])


def unbase64(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(text: str) -> dict | None:
    data = unbase64(text, url=True)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


#: Header of a sealed key: its cipher and start vector.
SEALED = re.compile(r"^DEK-Info: [A-Z0-9-]+,([0-9A-F]{16}|[0-9A-F]{32})\s*$", re.M)


def pem_holds(label: str, body: str) -> bool:
    """The body is DER or an SSH key; sealed by header, it is whole blocks as long as the start vector."""
    lines = [x for x in body.strip().splitlines() if ":" not in x]
    data = unbase64("".join(lines))
    if not data:
        return False
    if sealed := SEALED.search(body):
        return len(data) % (len(sealed[1]) // 2) == 0
    return is_der_key(data) or is_ssh_key(data)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start, then kind as listed in ``KINDS``."""
    found: list[tuple[str, int, int]] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text) if pem_holds(m[1], m[2])]
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            head, body, _ = m[0].split(".")
            if "alg" in (json_object(head) or {}) and json_object(body) is not None:
                found.append(("jwt", *m.span()))
    for m in BLOB.finditer(text):
        data = unbase64(m[0])
        if data and is_der_key(data):
            found.append(("der", *m.span()))
        elif data and is_ssh_key(data):
            found.append(("ssh", *m.span()))
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col`` and ``spans``, an array of (kind, start_at, end_at)."""
    fields = documents.select(id_col).withColumn("spans", F.lit(None).cast("array<struct<kind:string,start_at:bigint,end_at:bigint>>")).schema

    def step(batch):
        found = [[{"kind": k, "start_at": a, "end_at": b} for k, a, b in spans(t or "")] for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "spans": found}

    return batches(documents.select(id_col, text_col), step, fields)


def redact(documents: DataFrame, *, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The documents with every span (merged where they overlap) replaced by ``mark``."""

    def step(batch):
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        return columns | {text_col: [None if t is None else blank(t, mark) for t in columns[text_col].to_pylist()]}

    return batches(documents, step, documents.schema)


def blank(text: str, mark: str) -> str:
    out, at = [], 0
    for _, a, b in spans(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of each document."""
    joined = lambda kinds: F.concat_ws(",", F.transform(F.filter("spans", lambda s: s.kind.isin(*kinds)), lambda s: F.concat_ws(":", s.kind, s.start_at, s.end_at)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return scan(documents, id_col=id_col, text_col=text_col).select(
        id_col, *map(count, BASE_KINDS), F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"), joined(KINDS).alias("spans"), *map(count, KINDS[3:])
    )
