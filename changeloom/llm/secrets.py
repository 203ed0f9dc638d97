"""Secret scan with structural confirmation.

Base kinds are patterns: assign (a name such as password or token, then = or :, then a value), access (AKIA
and capitals) and hex (runs of lower-case hexadecimal). Confirmed kinds decode a candidate and parse it
before it is reported:

- pem: a PEM block whose body is the encoding of a private key;
- der: base64 or hexadecimal that decodes to a private key in DER, all nested lengths closing exactly;
- ssh: base64 that decodes to an OpenSSH private key, its length-prefixed fields closing exactly;
- jwt: a signed token whose header and payload are JSON objects and whose signature fits the algorithm.

Keys and tokens may follow other letters of their alphabet (a path, a prefix such as `tok_`, `0x`): a key's own
header says where it ends, so only starts whose end is the end of a line or of the run are decoded. Base64 may be
wrapped in lines without a PEM header. Escaped line ends and slashes, as in JSON, are read as what they
stand for, and spans are those of the text as it is.

Public keys and certificates parse as well, but are not secrets and are not reported.

Spans are code points, the end exclusive, as kind:start:end. Edge cases. Null text: as empty. Repeated rows:
a result each. No rows: no rows. Extra columns are ignored. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.common import by_chunk

KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: A PEM block is a BEGIN, characters of its body only, and the next END of the same label.
PEM_BEGIN, PEM_END = (re.compile(rf"(?=-----{word} ([A-Z0-9 ]{{3,40}})-----{after})") for word, after in (("BEGIN", r"\s"), ("END", "")))
NOT_PEM_BODY = re.compile(r"[^A-Za-z0-9+/=\s:,.-]+")
#: Three base64url parts. A header is an object: these are the letters of a brace and a quote or blank behind it.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+(?=\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
HEADER = re.compile(r"(?=e(?:y[A-DI-L]|w[k-r0-3]))")
#: Lines of one run of base64 each, the first long; the last may be padded.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{2,})*={0,2}")
WRAP = re.compile(r"[ \t]*\r?\n[ \t]*")
#: How keys start in base64: a DER sequence with a length of one to five bytes, an OpenSSH key, a PEM block encoded once more.
KEY_START = re.compile(r"(?=M(?:[A-H]|I[E-T])|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)")
HEX_RUN, HEX_START = re.compile(r"[0-9a-f]{40,}|[0-9A-F]{40,}"), re.compile(r"(?=30)")
#: Escaped line ends and slashes, escaped once or more often, as in JSON.
ESCAPE = re.compile(r"\\+([nr/])")

#: Bytes to x where they can be part of a run, to find long runs with one search.
HEX_MAP = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))
RUN_MAP = bytes(0x78 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 0x20 for c in range(256))

#: What base64 of `{"`, `{ ` and `{` before a line end or tab starts with.
HEADERS = tuple(f"e{a}{b}".encode() for a, bs in (("y", "ABCDIJKL"), ("w", "klmnopqr0123")) for b in bs)

#: Signature bytes by JWT algorithm; RSA signatures are as long as the key (fixed values of the standard).
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EDDSA": 64}


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[start:end] exactly; None if they don't."""
    items = []
    while start < end:
        if end - start < 2 or data[start] & 0x1F == 0x1F:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or n > 1 and size < 1 << 8 * (n - 1):  # not the shortest form
                return None
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        start = at + size
    return items


def is_private_der(data: bytes, depth: int = 0) -> bool:
    """Whether data is a private key: PKCS#1, PKCS#8 (encrypted or not), SEC 1 or DSA."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30 or depth > 2:
        return False
    inner = der_items(data, *top[0][1:])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    number = lambda item: int.from_bytes(data[item[1] : item[2]], "big") if item[2] > item[1] else -1
    if set(tags) == {0x02} and len(tags) in (6, 9, 10):
        return number(inner[0]) in (0, 1) and all(b > a for _, a, b in inner)
    if tags[:3] == [0x02, 0x30, 0x04] and number(inner[0]) in (0, 1):
        algorithm = der_items(data, *inner[1][1:])
        key = data[inner[2][1] : inner[2][2]]
        nested = der_items(key, 0, len(key))
        return bool(algorithm) and algorithm[0][0] == 0x06 and bool(nested) and (nested[0][0] == 0x04 and len(nested) == 1 or is_private_der(key, depth + 1))
    if tags[:2] == [0x02, 0x04] and number(inner[0]) == 1:
        return 16 <= inner[1][2] - inner[1][1] <= 66 and all(t in (0xA0, 0xA1) and der_items(data, a, b) for t, a, b in inner[2:])
    if tags == [0x30, 0x04]:
        algorithm = der_items(data, *inner[0][1:])
        return bool(algorithm) and [t for t, _, _ in algorithm] == [0x06, 0x30] and bool(der_items(data, *algorithm[1][1:])) and inner[1][2] - inner[1][1] >= 16
    return False


def ssh_end(data: bytes) -> int | None:
    """Where an OpenSSH private key at the start of data ends: cipher, KDF, options, the public keys, then the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), []

    def take() -> bool:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else -1
        if size < 0 or at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
        return True

    if not (take() and take() and take()) or at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return at if 1 <= keys <= 16 and all(take() for _ in range(keys + 1)) and len(fields[-1]) % 8 == 0 else None


def is_private_ssh(data: bytes) -> bool:
    return ssh_end(data) == len(data)


def der_size(head: bytes) -> int | None:
    """The length of the DER sequence that starts with head, by its first bytes; None if none starts there."""
    if len(head) < 7 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or head[2 + n] not in (0x02, 0x30):  # a number or a sequence comes first
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run, standard or URL-safe, padded or not."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None, depth: int = 0) -> str | None:
    if not data:
        return None
    if data[0] == 0x30 and is_private_der(data):
        return "der"
    if is_private_ssh(data):
        return "ssh"
    if depth == 0 and data.startswith(b"-----BEGIN ") and (block := next(pem_blocks(data.decode("latin-1")), None)) and pem_is_private(*block[2:]):
        return "der"
    return None


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of the PEM blocks, leftmost first and apart from each other.

    The places of all ENDs and of what no body can hold are found once, so that many BEGINs without an END
    cost a search each and not a scan.
    """
    begins = [(m.start(), m[1]) for m in PEM_BEGIN.finditer(text)]
    if not begins:
        return
    ends, foreign, at = defaultdict(list), [m.start() for m in NOT_PEM_BODY.finditer(text)], 0
    for m in PEM_END.finditer(text):
        ends[m[1]].append(m.start())
    for start, label in begins:
        body, places = start + len(f"-----BEGIN {label}-----") + 1, ends[label]
        if start < at or (i := bisect_left(places, body)) == len(places):
            continue
        # A run of foreign characters starts after the BEGIN, which holds none.
        if (j := bisect_left(foreign, body)) < len(foreign) and foreign[j] < places[i]:
            continue
        at = places[i] + len(f"-----END {label}-----")
        yield start, at, label, text[body : places[i]]


def pem_is_private(label: str, body: str) -> bool:
    if "PRIVATE KEY" not in label:
        return False
    encoded = "".join(line for line in body.split("\n") if ":" not in line)  # without the headers of old encrypted keys
    data = decoded("".join(encoded.split()))
    return data is not None and (key_kind(data, 1) is not None or "DEK-Info:" in body and len(data) >= 64 and len(data) % 8 == 0)


def is_signed_token(token: str) -> bool:
    head, body, sign = (decoded(x) if x else b"" for x in token.split("."))
    if head is None or body is None or sign is None:
        return False
    try:
        header, claims = json.loads(head), json.loads(body)
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    alg = header["alg"].upper()
    return len(sign) == SIGNATURE[alg] if alg in SIGNATURE else alg[:2] in ("RS", "PS") and len(sign) >= 128 and len(sign) % 8 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, kind as an index of KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[KINDS[kind]]]
    return sorted(found)


def unescaped(text: str) -> tuple[str, Callable[[int], int]]:
    """The text with escaped line ends and slashes as themselves, and what maps its offsets back."""
    found = list(ESCAPE.finditer(text))
    if not found:
        return text, lambda at: at
    plain = ESCAPE.sub(lambda m: {"n": "\n", "r": "\r", "/": "/"}[m[1]], text)
    lost = [0, *accumulate(m.end() - m.start() - 1 for m in found)]
    # In the plain text the k-th escape is one character at its start less what earlier ones have lost.
    places = [m.start() - x for m, x in zip(found, lost)]
    return plain, lambda at: at + lost[bisect_left(places, at)]


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the signed tokens; what stands before the header in its part is left out."""
    at = 0
    for m in TOKEN.finditer(text):
        for h in HEADER.finditer(text, max(at, m.start()), m.end()):
            # The first bytes tell what is no JSON, so few headers are decoded whole.
            if (head := decoded(text[h.start() : h.start() + 12])) and head.isascii() and re.fullmatch(rb"[\s\x20-\x7e]+", head) and m.end() - h.start() >= 10:
                token = f"{text[h.start() : m.end()]}.{m[1]}.{m[2]}"
                if is_signed_token(token):
                    at = h.start() + len(token)
                    yield h.start(), at
                    break


def keys(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in base64 and hexadecimal, wherever in their run they start; they end where a line or the run ends."""
    for m in WRAPPED.finditer(text):
        body = m[0].rstrip("=")
        wraps = [(w.start(), w.end()) for w in WRAP.finditer(body)]
        joined_body = WRAP.sub("", body) if wraps else body
        # Ends of lines in the joined text, and the offset of each line's first character.
        skipped = [0, *accumulate(b - a for a, b in wraps)]
        ends = [*(a - x for (a, _), x in zip(wraps, skipped)), len(joined_body)]
        place = lambda at, inner: m.start() + at + skipped[bisect_left(ends, at + (not inner))]  # noqa: B023, E731
        after = 0
        for k in KEY_START.finditer(joined_body):
            start = k.start()
            if start < after:
                continue
            if joined_body[start] == "M":
                size = der_size(decoded(joined_body[start : start + 12]) or b"")
                until = None if size is None else start + -(-4 * size // 3)
                if until is None or until > len(joined_body) or ends[bisect_left(ends, until)] != until:
                    continue
            elif joined_body[start] == "b":
                whole = decoded(joined_body[start : start + (len(joined_body) - start) // 4 * 4]) or b""
                whole += decoded(joined_body[start + len(whole) // 3 * 4 :]) or b""
                size = ssh_end(whole)
                until = None if size is None else start + -(-4 * size // 3)
                if until is None or ends[bisect_left(ends, until)] != until:
                    continue
            else:
                until = len(joined_body)
            kind = key_kind(decoded(joined_body[start:until]))
            if kind:
                end = place(until, True)
                end += len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
                yield place(start, False), end, kind
                after = until
    for m in HEX_RUN.finditer(text):
        for k in HEX_START.finditer(text, m.start(), m.end()):
            size = der_size(bytes.fromhex(text[k.start() : min(m.end(), k.start() + 14)])) if m.end() - k.start() >= 14 else None
            if size is not None and k.start() + 2 * size == m.end() and key_kind(bytes.fromhex(text[k.start() : m.end()])):
                yield k.start(), m.end(), "der"
                break


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the confirmed kinds: what lies in a PEM block, of whatever label, or in a token is no key beside it."""
    text, back = unescaped(text)
    blocks = list(pem_blocks(text))
    found = [(start, KINDS.index("pem"), end) for start, end, label, body in blocks if pem_is_private(label, body)]
    found += [(start, KINDS.index("jwt"), end) for start, end in tokens(text)]
    taken = sorted({(a, b) for a, b, _, _ in blocks} | {(a, b) for a, _, b in found})
    reach = list(accumulate((b for _, b in taken), max))
    for start, end, kind in sorted(keys(text)):
        before = bisect_left(taken, (end,))
        if not (before and reach[before - 1] > start):
            found.append((start, KINDS.index(kind), end))
    return sorted((back(start), kind, back(end)) for start, kind, end in found)


def spans_of(raw: bytes) -> tuple[list, list]:
    """Base and confirmed spans of a UTF-8 text. Cheap searches tell most texts free of candidates."""
    lower = raw.lower()
    names, access, hexes = any(n in lower for n in NAMES), b"AKIA" in raw, b"x" * 32 in raw.translate(HEX_MAP)
    candidates = b"-----BEGIN " in raw or b"x" * 40 in raw.translate(RUN_MAP) or any(n in raw for n in HEADERS)
    if not (names or access or hexes or candidates):
        return [], []
    text = raw.decode("utf-8", "replace")
    base = base_spans(text) if names or access or hexes else []
    return base, confirmed_spans(text) if candidates else []


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def _make():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw in batch.column("text").cast(pa.binary()).to_pylist():
            base, more = spans_of(raw or b"")
            n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.record_batch([batch.column("doc_id"), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return each


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row each with the counts, the digest of the base spans and all spans."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(by_chunk(_make), SCHEMA)
