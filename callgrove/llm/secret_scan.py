"""Secret scans: patterns, and candidates that are confirmed by their inner structure.

Assignments, access keys and long hex strings are taken by pattern.  Longer base64 and hex strings are
decoded, and reported only if what they hold has the structure of a key: nested lengths of a DER key
that add up, length-prefixed fields of an SSH key, a signed token whose header names an algorithm, a PEM
block around such a key.  Line ends inside a PEM block or a base64 key may be written as in JSON or source
text (backslash n, quotes around each line); PEM header lines are skipped, and a body they name as
encrypted is confirmed by its whole blocks.

Defined results: null and empty texts hold no secrets; texts of any length are read in full; spans that
start together are ordered by kind; repeated rows are judged one by one; an empty table gives an empty
table.  Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.llm.texts import change_rows, map_rows, slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")
# The patterns of the three base kinds (hex strings are found as runs of bytes).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_ENCODED = 6, 20, 24, 40
MOST_PARTS = 64

_PEM = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
_LINE_END = re.compile(r"\\+[rn]|\\+(?=/)")
_QUOTE = re.compile(r"""\\*["'`]|[+.,;&](?=\s*\\*["'`])|\\(?=\s)""")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*((?:[0-9A-Fa-f]{2})+)")
_KEY_START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[rn]))M[A-Za-z0-9+/]{15,}")
_PIECE = re.compile(r"[A-Za-z0-9+/]+")
_BETWEEN = re.compile(r"""(?:\\+[rn]|\\*["'`]|[+.,;&](?=\s*\\*["'`])|\\(?=\s)|\s)+""")
_PADDING = re.compile("={0,2}")
_ENCODED = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9_-]{40,}={0,2}")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_HEX_BYTES = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_CODE_BYTES = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_=.-") for b in range(256)])


class Span(NamedTuple):
    start: int
    end: int
    kind: str

    def text(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    inside = np.concatenate(([False], mask, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _value(data: bytes | _Bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at ``at``, if its length fits."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size > 0x80:
        more = size & 0x7F
        if more > 4 or at + more > len(data):
            return None
        size, at = int.from_bytes(data[at:at + more], "big"), at + more
    elif size == 0x80:
        return None
    return (tag, at, at + size) if at + size <= len(data) else None


def is_der_key(data: bytes | _Bytes) -> bool:
    """A sequence that fills ``data``, starts with a small integer or a sequence, and whose parts' lengths add up at every level.

    Keys have about ten parts; what has more than ``MOST_PARTS`` is none, so the work on a candidate is bounded.
    """
    whole = _value(data, 0)
    if not whole or whole[0] != 0x30 or whole[2] != len(data):
        return False
    tags, inner, open_, n = [], [], [(whole[1], whole[2], 0)], 0
    while open_:
        at, end, depth = open_.pop()
        while at < end:
            part, n = _value(data, at), n + 1
            if not part or part[2] > end or n > MOST_PARTS:
                return False
            if depth == 0:
                tags.append((part[0], part[2] - part[1]))
            elif depth == 1 and len(tags) == 2:
                inner.append(part[0])
            if part[0] & 0x20:
                open_.append((part[1], part[2], depth + 1))
            at = part[2]
    if len(tags) < 2:
        return False
    numbered = tags[0][0] == 0x02 and tags[0][1] == 1  # version, then the key or its algorithm
    public = tags[0][0] == 0x30 and tags[1][0] == 0x03  # algorithm, then a bit string
    encrypted = [t for t, _ in tags] == [0x30, 0x04] and inner == [0x06, 0x30]  # algorithm with parameters (a digest has none), then the key
    return numbered or public or encrypted


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or length-prefixed fields that fill ``data`` and start with the name of a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def _decoded(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_pem_key(body: str) -> bool:
    """What stands between the marks of a private key holds one, or whole blocks of the cipher that its header names."""
    lines = [x.strip() for x in _QUOTE.sub("", _LINE_END.sub(lambda m: "" if m[0][-1] == "\\" else "\n", body)).splitlines()]
    data = _decoded("".join(x for line in lines if not _HEADER.match(line) for x in line.split()))
    if not data:
        return False
    cipher = next((m for line in lines if (m := _CIPHER.match(line))), None)
    return len(data) % (len(cipher[1]) // 2) == 0 if cipher else is_der_key(data) or is_ssh_key(data)


class _Bytes:
    """What unpadded base64 text holds, decoded where it is asked for."""

    def __init__(self, text: str, start: int, size: int):
        self.text, self.start, self.size = text, start, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self[at:at + 1][0]
        low, high = at.start or 0, min(self.size, self.size if at.stop is None else at.stop)
        first = low // 3
        body = self.text[self.start + 4 * first:self.start + min(4 * -(-high // 3), -(-self.size * 4 // 3))]
        return (_decoded(body) or b"")[low - 3 * first:high - 3 * first]


def _stated(head: bytes | None) -> int | None:
    """Number of bytes of a DER sequence that begins with ``head`` and holds a number or a sequence first."""
    if not head or head[0] != 0x30 or head[1] == 0x80:
        return None
    more = head[1] & 0x7F if head[1] > 0x80 else 0
    if more > 4 or head[2 + more] not in (0x02, 0x30):
        return None
    return 2 + more + int.from_bytes(head[2:2 + more], "big") if more else 2 + head[1]


def _wrapped(text: str) -> list[tuple[int, int]]:
    """Base64 keys that go on over lines; the first bytes tell how long they are.

    The lines of a run are measured once, however many of them begin like a key, and a key is decoded only as far as its nested
    lengths are right.
    """
    out, done, stop = [], 0, 0
    for m in _KEY_START.finditer(text):
        size = _stated(_decoded(m[0][:16])) if m.start() >= done else None
        if size is None:
            continue
        if m.start() >= stop or m.start() not in number:
            starts, parts, at = [], [], m.start()
            while piece := _PIECE.match(text, at):
                starts.append(at)
                parts.append(piece[0])
                at = stop = piece.end()
                if len(piece[0]) < 16 or not (gap := _BETWEEN.match(text, at)):
                    break
                at = gap.end()
            number, upto, joined = {a: i for i, a in enumerate(starts)}, [0, *accumulate(map(len, parts))], "".join(parts)
        i = number[m.start()]
        end = upto[i] + -(-size * 4 // 3)
        j = bisect_left(upto, end)
        if j < len(upto) and upto[j] == end and is_der_key(_Bytes(joined, upto[i], size)):
            last = starts[j - 1] + len(parts[j - 1])
            done = last + len(_PADDING.match(text, last)[0])
            out.append((m.start(), done))
    return out


def is_signed_token(text: str) -> bool:
    """Header and body of a signed token are JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(_decoded(part) or b"") for part in text.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def _confirmed(text: str) -> list[tuple[int, int, str]]:
    """Structured secrets inside one run of code characters."""
    out = [(m.start(), m.end(), "jwt") for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    tokens = Stretches((a, b) for a, b, _ in out)
    for m in _ENCODED.finditer(text):
        if tokens.touch(m.start(), m.end()):
            continue
        if re.fullmatch(r"([0-9a-f]{2}|[0-9A-F]{2})+", m[0]):
            data = bytes.fromhex(m[0])
        else:
            data = _decoded(m[0])
        if data and is_der_key(data):
            out.append((m.start(), m.end(), "der"))
        elif data and is_ssh_key(data):
            out.append((m.start(), m.end(), "ssh"))
    return out


class Stretches:
    """Stretches of a text, those that overlap as one, for questions in logarithmic time."""

    def __init__(self, parts):
        self.starts, self.ends = [], []
        for a, b in sorted(parts):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touch(self, a: int, b: int) -> bool:
        """Whether one overlaps a to b."""
        i = bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] < b

    def hold(self, a: int, b: int) -> bool:
        """Whether a to b lies in one."""
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and b <= self.ends[i]


class _Places:
    """The code point at a byte; only a count for each stretch of bytes is held."""

    def __init__(self, data: np.ndarray, width: int = 1 << 14):
        self.data, self.width = data, width
        counts = [np.count_nonzero((data[a:a + width] & 0xC0) != 0x80) for a in range(0, len(data), width)]
        self.before = [0, *accumulate(counts)]

    def __call__(self, i: int) -> int:
        k = i // self.width
        return int(self.before[k] + np.count_nonzero((self.data[k * self.width:i] & 0xC0) != 0x80))


def find_secrets(text: str) -> list[Span]:
    """All spans of a text in code points, end exclusive, in order of start and kind."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    place = int if len(data) == len(text) else _Places(data)
    spans = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [Span(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    del lower
    if "AKIA" in text:
        spans += [Span(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    pems = []
    if "-----BEGIN " in text:
        marks = list(_PEM.finditer(text))
        for m, e in zip(marks, marks[1:], strict=False):
            if (m[1], e[1]) == ("BEGIN", "END") and m[2] == e[2] and is_pem_key(text[m.end():e.start()]):
                pems.append((m.start(), e.end()))
    spans += [Span(a, b, "pem") for a, b in pems]
    inside = Stretches(pems)
    for low, high in slices(data, _CODE_BYTES):
        part = data[low:high]
        spans += [Span(place(low + a), place(low + b), "hex") for a, b in _runs(_HEX_BYTES[part], LEAST_HEX)]
        for a, b in _runs(_CODE_BYTES[part], LEAST_ENCODED):
            a, b = place(low + a), place(low + b)
            spans += [Span(a + x, a + y, kind) for x, y, kind in _confirmed(text[a:b]) if not inside.hold(a + x, a + y)]
    taken = Stretches([*pems, *((s.start, s.end) for s in spans if s.kind in ("der", "jwt", "ssh"))])
    spans += [Span(a, b, "der") for a, b in _wrapped(text) if not taken.touch(a, b)]
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds spans, an array of kind, start and end per text, one row per row of ``df``."""
    def start():
        return lambda v: (",".join(s.text() for s in find_secrets(v.as_py() or "")),)

    found = map_rows(df, list(keep), text, {"spans": "string"}, start)
    parts = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    return found.withColumn("spans", F.transform(parts, lambda p: F.struct(
        p[0].alias("kind"), p[1].cast("bigint").alias("start"), p[2].cast("bigint").alias("end"))))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for s in find_secrets(text):
        if s.start >= at:
            out += [text[at:s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets in ``text`` replaced by a mark; null stays null, other texts stay as they are."""
    return change_rows(df, text, lambda: lambda v: redact(v.as_py()) if v.is_valid else None)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
