"""Secret scan: pattern hits plus blobs that are confirmed by decoding them.

A plain pattern finds assignments, access keys and long hex runs. On top of that, base64 and hex candidates
are decoded, and only those that parse are reported: DER keys (every nested length must fit), OpenSSH key
containers (length-prefixed fields), PEM private keys (armoured body parses; line ends may be escaped), and signed
tokens (header and payload are JSON objects, the header names an algorithm). The body of a PEM key that its own
headers call encrypted shows no structure; it must decode to whole cipher blocks. Keys are also found as lines of
base64 without an armour, at the end of a longer run (after a path), as a PEM encoded once more, and as hex bytes
with colons.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from . import common

#: In the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "token", "der", "openssh", "pem")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f][0-9a-f]{23,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_-]{23,}")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
#: Line ends in an armour, as they are or escaped once or more, as in JSON strings.
_EOL = r"(?:\s|\\+[nrt])"
_PEM = re.compile(
    rf"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:{_EOL}*+[A-Z][A-Za-z-]*+:[^\\\r\n]*+{_EOL})*+)"
    rf"((?:[A-Za-z0-9+/=]|{_EOL})*+)-----END \1PRIVATE KEY-----"
)
#: Base64 in lines of one length, without an armour; hex bytes with colons between them.
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/])(?:(?:[A-Za-z0-9+/]{{64}}{_EOL}++)++[A-Za-z0-9+/]{{1,64}}|(?:[A-Za-z0-9+/]{{76}}{_EOL}++)++[A-Za-z0-9+/]{{1,76}})(?![A-Za-z0-9+/])={{0,2}}")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::\s*+[0-9A-Fa-f]{2}){23,}+")
_MIN_LINE = 64
_DEK = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),\s*[0-9A-Fa-f]{16,}")

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
MIN_ASSIGN, MIN_ACCESS, MIN_RUN = 6, 20, 24


#: Object identifiers 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at``, or None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80:
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All elements of a SEQUENCE body; None unless they fill it exactly."""
    out = []
    while at < end:
        got = _element(data, at, end)
        if got is None:
            return None
        out.append(got)
        at = got[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A DER private key: PKCS#1 (nine integers), DSA (six), PKCS#8 (version, algorithm, octets; if encrypted, algorithm with
    parameters and octets) or SEC1 (1, octets)."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = _elements(data, top[1], top[2])
    if inner and [x[0] for x in inner] == [0x30, 0x04]:
        return _is_encrypted_key(data, *inner)
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    tags = [x[0] for x in inner]
    if len(inner) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True
    if len(inner) == 6 and all(t == 0x02 for t in tags):
        sizes = [x[2] - x[1] for x in inner]  # version 0, p, q, g, y, x
        return data[inner[0][1]] == 0 and sizes[1] >= 64 and 20 <= sizes[2] <= 33 and 1 <= sizes[5] <= 33
    if len(inner) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        algorithm = _elements(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1] == 0x04 and data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] >= 16


def _is_encrypted_key(data: bytes, algorithm: tuple[int, int, int], octets: tuple[int, int, int]) -> bool:
    """EncryptedPrivateKeyInfo: a password-based algorithm (PKCS#5 or PKCS#12) with its parameters, and octets.

    A DigestInfo has the same outline, so the algorithm has to be of these families.
    """
    parts = _elements(data, algorithm[1], algorithm[2])
    if not parts or len(parts) != 2 or parts[0][0] != 0x06 or parts[1][0] != 0x30 or octets[2] - octets[1] < 16:
        return False
    return data[parts[0][1] : parts[0][2]].startswith(_PASSWORD_BASED)


def is_openssh_key(data: bytes) -> bool:
    """The openssh-key-v1 container: cipher, kdf, options, key count, then that many public parts and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= n <= 16 and all(field() for _ in range(n + 1))


def _decoded(run: str) -> list[bytes]:
    out = []
    if len(run) % 2 == 0 and _HEX.fullmatch(run.lower()):
        out.append(bytes.fromhex(run))
    plain = run.replace("-", "+").replace("_", "/").rstrip("=")
    if len(plain) % 4 != 1:
        try:
            out.append(base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True))
        except (binascii.Error, ValueError):
            pass
    return out


def _confirmed(data: bytes) -> str | None:
    if b"PRIVATE KEY-----" in data and any(_is_pem(m) for m in _PEM.finditer(data.decode("latin-1"))):
        return "pem"
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def _is_pem(m: re.Match) -> bool:
    blobs = _decoded(re.sub(_EOL, "", m[3]))
    return any(is_der_key(d) or is_openssh_key(d) for d in blobs) or any(_is_cipher_text(m[2], d) for d in blobs)


def _key_at_end(run: str) -> tuple[str, int] | None:
    """(kind, start) of a DER key that ends where the run does. Only starts whose length header fits are decoded."""
    for m in re.finditer("M[A-Z]", run):
        head = run[m.start() : m.start() + 8]
        if m.start() and len(head) == 8:
            first = _decoded(head)[-1]
            n = first[1] & 0x7F if first[1] & 0x80 else 0
            size = int.from_bytes(first[2 : 2 + n], "big") if n else first[1]
            if n <= 4 and -(-(2 + n + size) * 4 // 3) == len(run) - m.start() and any(is_der_key(d) for d in _decoded(run[m.start() :])):
                return "der", m.start()
    return None


def _is_cipher_text(headers: str, data: bytes) -> bool:
    """Whole blocks of the cipher that the headers of a traditional encrypted key name."""
    dek = _DEK.search(headers)
    if not dek or "ENCRYPTED" not in headers:
        return False
    return len(data) >= 32 and len(data) % (8 if "DES" in dek[1] else 16) == 0


def _json_part(part: str) -> dict | None:
    try:
        got = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. Work is linear in the text; long texts are scanned whole."""
    raw = text.encode("utf-8", "surrogatepass")
    spans: list[tuple[str, int, int]] = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"PRIVATE KEY-----" in raw:
        spans += [("pem", m.start(), m.end()) for m in _PEM.finditer(text) if _is_pem(m)]
    armoured = [s[1:] for s in spans if s[0] == "pem"]
    if raw.count(b":") >= MIN_RUN - 1:
        for m in _COLONS.finditer(text):
            if kind := _confirmed(bytes.fromhex(re.sub(r"[:\s]", "", m[0]))):
                spans.append((kind, m.start(), m.end()))
    if b"eyJ" in raw:
        for m in _TOKEN.finditer(text):
            head, body, _ = m[0].split(".", 2)
            if (h := _json_part(head)) and isinstance(h.get("alg"), str) and _json_part(body) is not None:
                spans.append(("token", m.start(), m.end()))
    if len(raw) >= MIN_RUN:
        inside = _RUN_BYTES[np.frombuffer(raw, np.uint8)]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate(([0], edges, [len(raw)]))
        longest = int(np.diff(edges)[0 if inside[0] else 1 :: 2].max(initial=0))
        if longest >= MIN_RUN:
            spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
            for m in _RUN.finditer(text):
                end = m.end() + len(text[m.end() : m.end() + 2]) - len(text[m.end() : m.end() + 2].lstrip("="))
                if kind := next((k for d in _decoded(m[0]) if (k := _confirmed(d))), None):
                    spans.append((kind, m.start(), end))
                elif at := _key_at_end(m[0]):
                    spans.append((at[0], m.start() + at[1], end))
        if longest >= _MIN_LINE:
            for m in _WRAPPED.finditer(text):
                inside_pem = any(a <= m.start() and m.end() <= b for a, b in armoured)
                if not inside_pem and (kind := next((k for d in _decoded(re.sub(_EOL, "", m[0])) if (k := _confirmed(d))), None)):
                    spans.append((kind, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def span_list(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text, one row per input row: id, ``spans`` (kind, start, end, SHA-256 of the secret).

    Null and empty texts have no spans; null ids and repeated rows are kept as they are; other columns of the
    input are not read. Spans of different kinds may overlap. Very long texts are read whole, and an empty table gives
    no rows. One pass, no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,sha256:string>>"

    def work(rows: dict[str, list]) -> dict[str, list]:
        ids, texts = rows["id"], rows["text"]
        out = []
        for t in texts:
            out.append(
                [
                    {"kind": k, "start": a, "end": b, "sha256": hashlib.sha256(t[a:b].encode("utf-8", "replace")).hexdigest()}
                    for k, a, b in find_spans(t or "")
                ]
            )
        return {id_col: ids, "spans": out}

    return common.map_arrow(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), work, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each maximal stretch covered by spans replaced by one marker naming its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"[redacted {kind}]"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced by markers and ``length_col`` (if there) set to the new length.

    Rows without secrets are unchanged, null texts stay null, all columns and their order are kept.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    lengths = length_col if length_col in docs.columns else None

    def work(rows: dict[str, list]) -> dict[str, list]:
        for i, t in enumerate(rows[text_col]):
            if t and (spans := find_spans(t)):
                rows[text_col][i] = t = redact(t, spans)
                if lengths:
                    rows[lengths][i] = len(t)
        return rows

    return common.map_arrow(docs, work, schema)


def digest_columns(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, and all spans as text."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": rows["doc_id"]} | {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for spans in rows["spans"]:
            every = [(s["kind"], s["start"], s["end"]) for s in spans]
            base = [s for s in every if s[0] in BASE]
            for k in BASE:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(span_list(base).encode()).hexdigest())
            out["spans"].append(span_list(every))
        return out

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return common.map_arrow(scan_secrets(docs), work, schema)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return digest_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
