"""Secrets in texts: patterns, and candidates that only count once their structure is confirmed.

Encoded candidates (base64, base64url, hex; also wrapped over lines) are decoded first, at every alignment of the run.
A key must then parse somewhere in what is decoded: DER nests lengths that must end exactly where the outer one ends, an
OpenSSH blob is a chain of length-prefixed fields behind a magic word, a signed token has a JSON header that names an
algorithm and a JSON payload, an encrypted one a header with algorithm and cipher and five parts. Keys between BEGIN and
END lines may have header lines; where these say that the key is encrypted they must name the cipher, and what is decoded
must be whole blocks. Public keys and certificates parse as well, but are no secrets.

Texts are scanned in runs that are looked at once: time grows in proportion to a text, however long its runs are.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans with the same start are listed; the first three are patterns alone.
KINDS = ("assign", "access", "hex", "pem", "token", "key64", "keyhex")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_PEM_HEADERS = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+[^\n]+\n)*)+")
_SEALED_BY = re.compile(r"DEK-Info:\s*([A-Z0-9-]+)\s*,\s*((?:[0-9A-Fa-f]{2})+)")
#: A run that dots part; a signed or encrypted token lies within one.
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{32,}")
#: Runs of either alphabet, over line breaks between parts of 16 characters and more.
_KEY64 = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/_-]+)?={0,2}")
_KEYHEX = re.compile(r"[0-9a-fA-F]{32,}(?:[ \t]*(?:\r?\n|\\n)[ \t]*[0-9a-fA-F]{16,})*(?:[ \t]*(?:\r?\n|\\n)[ \t]*[0-9a-fA-F]+)?")
_DIGITS = re.compile(r"[A-Za-z0-9+/_-]")
_WORDS = ("passw", "secret", "token", "api_key", "apikey")

_OPENSSH = b"openssh-key-v1\0"
_BEGINS = re.compile(rb"\x30[\x16-\x7f\x81-\x84]|" + re.escape(_OPENSSH), re.S)
#: Identifiers of password-based encryption (PKCS #5 and PKCS #12) begin so.
_SEALED = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
#: Bytes that a key has at least.
_LEAST = 24


def _decoded64(text: str) -> bytes | None:
    text = re.sub(r"\s|\\n", "", text).replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, where the content begins, where it ends) of the DER element at a place; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 0 < width <= 4 or at + width > end:
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
    return (tag, at, at + n) if at + n <= end else None


def _der_items(data: memoryview) -> list[tuple[int, memoryview]] | None:
    """(tag, content) of the elements that fill data exactly; None if a length does not fit."""
    out, at = [], 0
    while at < len(data):
        found = _element(data, at, len(data))
        if not found:
            return None
        tag, begin, at = found
        out.append((tag, data[begin:at]))
    return out


def _ssh_end(data: bytes, at: int) -> int | None:
    """Where the OpenSSH private key that begins at a place ends: names, options, public keys and the private block."""
    at, fields = at + len(_OPENSSH), 0
    while fields < 3:  # cipher, key derivation, its options
        if at + 4 > len(data):
            return None
        at, fields = at + 4 + int.from_bytes(data[at : at + 4], "big"), fields + 1
    if at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(min(keys, 16) + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if 0 < keys <= 16 and at <= len(data) else None


def is_key(data: bytes | memoryview | None) -> bool:
    """Whether decoded bytes are, as a whole, a private key structure: nested DER, or OpenSSH's fields."""
    if not data or len(data) < _LEAST:
        return False
    data = memoryview(data)
    if data[: len(_OPENSSH)] == _OPENSSH:
        return _ssh_end(data, 0) == len(data)
    if data[0] != 0x30:
        return False
    outer = _der_items(data)
    if not outer or len(outer) != 1:
        return False
    inner = _der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags == [0x30, 0x04]:  # encrypted: an algorithm, named by an identifier, and the sealed key
        named = _der_items(inner[0][1])
        return bool(named) and named[0][0] == 0x06 and bytes(named[0][1][:16]).startswith(_SEALED)
    if tags[0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 1:
        return False  # the others begin with a version
    if not (len(inner) >= 6 and set(tags) == {0x02} or 0x04 in tags[1:3]):
        return False
    return all(_der_items(x) is not None for t, x in inner if t in (0x30, 0xA0, 0xA1))


def _keys_in(data: bytes) -> list[tuple[int, int]]:
    """[begin, end) of the keys within decoded bytes."""
    out, at, whole = [], 0, memoryview(data)
    while m := _BEGINS.search(data, at):
        begin = m.start()
        if m[0] == _OPENSSH:
            end = _ssh_end(data, begin)
        else:
            found = _element(data, begin, len(data))
            end = found and found[2]
        if end and is_key(whole[begin:end]):
            out.append((begin, end))
            at = end
        else:
            at = begin + 1
    return out


def _encoded(run: re.Match, hexed: bool) -> list[tuple[int, int]]:
    """[start, end) in the text of the keys that a run encodes, whatever stands before and behind them in it."""
    places = [run.start() + m.start() for m in _DIGITS.finditer(run[0].replace("\\n", "\n\n"))]
    text = re.sub(r"[^A-Za-z0-9+/_-]", "", run[0].replace("\\n", "")).replace("-", "+").replace("_", "/")
    per, bits = (2, 4) if hexed else (4, 6)
    out: list[tuple[int, int]] = []
    for phase in range(per):
        part = text[phase:]
        if hexed:
            data = bytes.fromhex(part[: len(part) // 2 * 2])
        else:
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
        for a, b in _keys_in(data):
            if hexed or not (8 * a) % 6:  # another phase has the key that begins within a digit
                first, last = phase + 8 * a // bits, phase + -(-8 * b // bits)
                start, end = places[first], run.end() if last == len(text) else places[last - 1] + 1
                if all(end <= x or y <= start for x, y in out):
                    out.append((start, end))
    return out


def is_token(text: str) -> bool:
    """Whether text as a whole is a signed token (three parts) or an encrypted one (five)."""
    return [(0, len(text))] == tokens(text)


def _object(part: str) -> dict | None:
    try:
        found = json.loads(_decoded64(part) or b"-")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _header(part: str) -> tuple[int, dict] | None:
    """Where in a part the first JSON object with an algorithm begins that ends with the part, and the object.

    Each of the four alignments is decoded once; an object begins where a group of four characters does.
    """
    if "e" not in part:  # the first six bits of a brace
        return None
    begins = []
    for phase in range(4):
        data = _decoded64(part[phase:]) or b""
        if b'"alg"' in data:
            at = data.find(b"{")
            while at >= 0:
                if at % 3 == 0:
                    begins.append((phase + at // 3 * 4, at, data))
                at = data.find(b"{", at + 1)
    for start, at, data in sorted(begins, key=lambda x: x[0]):
        try:
            found = json.loads(data[at:])
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict) and isinstance(found.get("alg"), str):
            return start, found
    return None


def tokens(run: str) -> list[tuple[int, int]]:
    """[start, end) of the tokens in a run of letters, digits, hyphens, low lines and dots."""
    parts, places, out = run.split("."), [0], []
    for p in parts:
        places.append(places[-1] + len(p) + 1)
    i = 0
    while i + 2 < len(parts):
        found, n = _header(parts[i]) if parts[i + 1] or i + 4 < len(parts) else None, 0
        if found:
            if i + 4 < len(parts) and isinstance(found[1].get("enc"), str) and all(parts[i + 2 : i + 5]) and all(_decoded64(p) is not None for p in parts[i + 1 : i + 5]):
                n = 5
            elif _object(parts[i + 1]) is not None:
                n = 3
        if n:
            out.append((places[i] + found[0], places[i + n] - 1))
        i += n or 1
    return out


def _armoured(text: str) -> list[tuple[int, int]]:
    """[start, end) of private keys between BEGIN and END lines."""
    out = []
    for m in _PEM.finditer(text):
        end = text.find("-----", m.end())
        closing = f"-----END {m[1]}-----"
        if end < 0 or not text.startswith(closing, end):
            continue
        body = text[m.end() : end].replace("\\r", "").replace("\\n", "\n").replace("\r", "")
        headers = _PEM_HEADERS.match(body)
        data = _decoded64(body[headers.end() :] if headers else body)
        if headers and "ENCRYPTED" in headers[0]:
            by = _SEALED_BY.search(headers[0])
            block = len(by[2]) // 2 if by else 0
            ok = block in (8, 16) and data is not None and len(data) >= _LEAST and len(data) % block == 0
        else:
            ok = is_key(data)
        if ok:
            out.append((m.start(), end + len(closing)))
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all secrets in a text, in code points, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if max(map(len, text.split()), default=0) >= 32:
        out += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]
        out += [(m.start() + a, 4, m.start() + b) for m in _DOTTED.finditer(text) if m[0].count(".") > 1 for a, b in tokens(m[0])] if "." in text else []
        out += [(a, 5, b) for m in _KEY64.finditer(text) for a, b in _encoded(m, False)]
        out += [(a, 6, b) for m in _KEYHEX.finditer(text) for a, b in _encoded(m, True)]
    if "PRIVATE KEY-----" in text:
        out += [(a, 3, b) for a, b in _armoured(text)]
    return sorted(out)


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _redacted(text: str, spans) -> str:
    out, last = [], 0
    for a, _, b in spans:
        if b > last:
            out += [text[last:a], "[secret]"] if a >= last else []
            last = max(last, b)
    return "".join(out) + text[last:]


def _scanned(with_text: bool):
    def scanned(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = find(text)
                n = [sum(k == i for _, k, _ in spans) for i in range(3)]
                base = _listed(x for x in spans if x[1] < 3)
                rows.append((*n, sum(k > 2 for _, k, _ in spans), hashlib.sha256(base.encode()).hexdigest(), _listed(spans), _redacted(text, spans) if with_text and spans else None))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            extra = [pa.array(c, t) for c, t in zip(cols, kinds)][: 7 if with_text else 6]
            names = ["n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans", "redacted"][: len(extra)]
            kept = [batch.column(i) for i in range(batch.num_columns) if with_text or batch.schema.names[i] != "text"]
            own = [x for x in batch.schema.names if with_text or x != "text"]
            yield pa.RecordBatch.from_arrays([*kept, *extra], [*own, *names])

    return scanned


_FOUND = "n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of each text: a row (key, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans) for each row.

    spans lists kind:start:end (code points, end exclusive) by start, then by the order of `KINDS`, comma-joined;
    base_sha256 is the digest of that list for the first three kinds alone; n_confirmed counts the other kinds. Of
    encoded keys that overlap in a run, that of the first alignment is listed.
    A null or empty text holds none (spans ''); repeated rows, null keys and very long texts are like any others;
    other columns are ignored; an empty table gives an empty result. One pass, no shuffle.
    """
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("did"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["did"]
    return rows.mapInArrow(_scanned(False), f"did {kind}, {_FOUND}").withColumnRenamed("did", key)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, same columns, with each secret in `text` replaced by [secret]; rows without one, and nulls, are unchanged."""
    common.bounded_batches(docs.sparkSession)
    rows = common.apart(docs, text)
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_scanned(True), f"row {kind}, text string, {_FOUND}, redacted string")
    return common.together(out, docs.columns, text, F.coalesce("redacted", "text"))
