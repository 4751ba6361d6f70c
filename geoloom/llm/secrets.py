"""Secret scans with structural confirmation.

Three base kinds are patterns. Candidates in base64 (either alphabet) or hex are
then decoded and reported only if what they hold parses:

* jwt: header.payload.signature where the header decodes to a JSON object that names an
  algorithm and the payload to a JSON object;
* der: DER whose outermost SEQUENCE fills the bytes exactly, whose nested lengths all fit, and
  which starts as a private key (a small version integer, then a key's parts);
* openssh: the key container's magic followed by length-prefixed strings that fit;
* blob: the wire form of a public or private key, length-prefixed with a known algorithm name.

Key armour may wrap base64 over lines; of a run of base64 lines every stretch of whole lines that holds a key is reported. A null or empty text has no spans; equal rows get
equal spans; a text is scanned whole whatever its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A match of HEX of 24 characters or more is one of these and the other way round.
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
#: Parts are tried from their first letter on and given up whole, so that a long text without dots takes one pass.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*")
#: Lines of one run, the first one long, the others of any length as a key's last line may hold one letter; a line that starts with dashes is armour.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:\r?\n(?!--)[A-Za-z0-9+/_-]+)*={0,2}")
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "blob")
#: Names that open a key's wire form.
ALGORITHMS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")


def unbase64(s: str) -> bytes | None:
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(s: str) -> bool:
    header, payload, _ = s.split(".")
    try:
        h, p = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each element of data[at:end]; None if their lengths don't fill it."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 128:
            more = n & 127
            if not 1 <= more <= 4 or at + more > end:
                return None
            n, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def private_key_der(data: bytes) -> bool:
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(data, *top[0][1:])
    if not parts or len(parts) < 3 or parts[0][0] != 2 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    if all(tag == 2 for tag, _, _ in parts):
        return len(parts) >= 6  # integers only: the two primes and their company
    if parts[1][0] == 0x30:  # an algorithm, then the key as a string
        inner = der_items(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 6 and parts[2][0] == 4
    return parts[1][0] == 4 and all(tag in (0xA0, 0xA1) for tag, _, _ in parts[2:])


def strings(data: bytes, at: int, n: int) -> list[bytes] | None:
    """n length-prefixed strings from at on; None if one doesn't fit."""
    out = []
    for _ in range(n):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if size > len(data) - at:
            return None
        out.append(data[at : at + size])
        at += size
    return out


def structure(data: bytes | None) -> str | None:
    """What kind of key the bytes hold, or None."""
    if not data or len(data) < 24:
        return None
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if strings(data, 15, 3) else None
    if data[0] == 0x30:
        return "der" if private_key_der(data) else None
    if data[:3] == b"\0\0\0":
        got = strings(data, 0, 2)
        return "blob" if got and got[0].startswith(ALGORITHMS) and got[1] else None
    return None


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start and then kind as listed in KINDS; code points, end exclusive."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX_LONG.finditer(text)]
    if "." in text:
        out += [("jwt", m.start(), m.end()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    for m in BASE64.finditer(text):
        out += run_keys(text, m.start(), m.end())
    for m in HEX_ANY.finditer(text):
        if kind := structure(bytes.fromhex(m[0])):
            out.append((kind, m.start(), m.end()))
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def lines(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """The whole lines of text[s:e]."""
    out, at = [], s
    for part in text[s:e].split("\n"):
        out.append((at, at + len(part.rstrip("\r"))))
        at += len(part) + 1
    return out


def opening(s: str) -> tuple[str, int] | None:
    """The kind of key whose base64 may open with s, and the bytes it takes (0 if its first bytes don't tell)."""
    head = unbase64(s[: len(s) // 4 * 4]) or b""
    if head.startswith(b"openssh-key-v1\0"):
        return "openssh", 0
    if head[:3] == b"\0\0\0" and head[4:].startswith(ALGORITHMS):
        return "blob", 0
    if len(head) > 6 and head[0] == 0x30:
        more = head[1] & 127 if head[1] & 128 else 0
        return "der", 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
    return None


def string_ends(kind: str, data: bytes) -> list[int]:
    """Where a container, or a key's wire form, that opens data may end."""
    if kind == "openssh":
        head = strings(data, 15, 3)
        at = 15 + sum(4 + len(x) for x in head or ())
        n = int.from_bytes(data[at : at + 4], "big")  # public keys; the private part is one string more
        rest = strings(data, at + 4, n + 1) if head is not None else None
        return [] if rest is None else [at + 4 + sum(4 + len(x) for x in rest)]
    out, at = [], 0
    while got := strings(data, at, 1):
        at += 4 + len(got[0])
        out.append(at)
    return out[1:]


def run_keys(text: str, s: int, e: int) -> list[tuple[str, int, int]]:
    """Every key in text[s:e], a run of base64 lines: the stretches of whole lines that parse, one behind the other."""
    spans = lines(text, s, e)
    if len(spans) == 1:
        kind = structure(unbase64(text[s:e]))
        return [(kind, s, e)] if kind else []
    parts = [text[a:b].rstrip("=") for a, b in spans]
    flat = "".join(parts)
    first = [0, *accumulate(len(x) for x in parts)]
    line = {f: k for k, f in enumerate(first)}
    opens = [opening(flat[f : f + 24]) for f in first[:-1]]

    def behind(k: int, size: int) -> int | None:
        """The line behind a key of that many bytes from line k on; None if it doesn't end with a line."""
        to = line.get(first[k] - -size * 4 // 3)
        return to if to and structure(unbase64(flat[first[k] : first[to]])) == opens[k][0] else None

    def starts(k: int, kind: str) -> bool:
        """Whether a key starts in line k that one of the given kind can't hold."""
        if not opens[k] or kind == "openssh" and opens[k][0] == "blob":
            return False
        return opens[k][0] != "der" or behind(k, opens[k][1]) is not None

    out, k = [], 0
    while k < len(spans):
        to = None
        if opens[k] and opens[k][0] == "der":
            to = behind(k, opens[k][1])
        elif opens[k]:
            kind = opens[k][0]
            limit = next((j for j in range(k + 1, len(spans)) if starts(j, kind)), len(spans))
            n = first[limit] - first[k]
            data = unbase64(flat[first[k] : first[limit] - (n % 4 == 1)])
            to = next((j for size in reversed(string_ends(kind, data)) if (j := behind(k, size))), None)
            if to is None:  # without an end that a line shares, as far as it may reach
                while (first[limit] - first[k]) % 4 == 1 and limit > k + 1:
                    limit -= 1
                to = limit if structure(unbase64(flat[first[k] : first[limit]])) == kind else None
        if to is None:
            k += 1
        else:
            out.append((opens[k][0], spans[k][0], spans[to - 1][1]))
            k = to
    return out


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """text with every covered stretch replaced by mask."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans: an array of (kind, start, end), in one pass without a shuffle."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in rows.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return arrow_map(src, run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def clean(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with the secrets in text replaced by mask; every row and every other column stays as it is."""
    names = docs.columns
    at = names.index(text)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = [t if t is None else redact(t, found, mask) if (found := scan(t)) else t for t in rows.column(at).to_pylist()]
        cols = list(rows.columns)
        cols[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(cols, names=rows.schema.names)

    return arrow_map(docs, run, docs.schema)
