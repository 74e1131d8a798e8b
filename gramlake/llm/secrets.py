"""Secret scan with multipart credential linking.

Strong findings (assignments, access keys, long hex) stand alone. Weak parts do
not: an account identifier, an unlabelled high-entropy string or an endpoint is
reported only when a complementary part lies in the same scope. Parts are
intervals; a scope is the paragraph around the part, and at most SCOPE code
points to either side. The interval join runs inside one text: parts sorted by
position, the neighbours in reach found by bisection, so it costs
O(parts log parts) and never lists pairs.

Kinds, in the order in which equal starts are listed: assign, access, hex
(strong), then secret, ident, endpoint (weak, only where linked). A weak secret
needs an identifier, an access key or an endpoint in reach; an identifier or an
endpoint needs a secret (weak or strong) in reach.

Defined cases: a null text counts as empty; a text without findings has counts 0,
an empty spans string, and the hash of the empty string; offsets are code
points, end exclusive; very long texts are scanned whole; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "secret", "ident", "endpoint")
#: Code points on either side in which a complementary part links.
SCOPE = 240

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENT = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.IGNORECASE | re.ASCII)
_HOST = re.compile(r"""\b(?:host(?:name)?|server|endpoint|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.IGNORECASE | re.ASCII)
_URL_REST = re.compile(r"""://[^\s"'<>]{4,}""")
_SCHEME = re.compile(r"\b[a-z][a-z0-9+.-]+\Z", re.IGNORECASE | re.ASCII)
_SCHEME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WEAK_MARKS = ("://", "host", "server", "endpoint", "url", "user", "login", "account", "client", "access", "key", "tenant")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Strong findings by kind, leftmost and non-overlapping within a kind."""
    low = text.lower()
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if any(x in low for x in _MARKS) else [],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else [],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in (s.count(x) for x in set(s)))


def _opaque(s: str) -> bool:
    """Looks like key material: two letter cases and digits, near-random letters."""
    return any(x.isdigit() for x in s) and any(x.islower() for x in s) and any(x.isupper() for x in s) and _entropy(s) >= 3.5


def _paragraphs(text: str) -> list[int]:
    return [m.end() for m in re.finditer(r"\n[ \t]*\n", text)]


class _Parts:
    """Disjoint intervals sorted by start, with a test for one in reach of another."""

    def __init__(self, spans, breaks):
        self.spans, self.breaks = sorted(spans), breaks
        self.starts = [a for a, _ in self.spans]

    def near(self, a: int, b: int) -> bool:
        """Is there a part, not overlapping [a, b), in its scope?"""
        i = bisect_left(self.starts, a)
        home = bisect_left(self.breaks, a + 1)
        for k in range(i - 1, -1, -1):
            s, e = self.spans[k]
            if e <= a:
                if a - e <= SCOPE and bisect_left(self.breaks, s + 1) == home:
                    return True
                break
        for k in range(i, len(self.spans)):
            s, _ = self.spans[k]
            if s >= b:
                return s - b <= SCOPE and bisect_left(self.breaks, s + 1) == home
        return False


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if not out or a >= out[-1][1]:
            out.append((a, b))
        elif b > out[-1][1]:
            out[-1] = (out[-1][0], b)
    return out


def endpoint_spans(text: str) -> list[tuple[int, int]]:
    """Addresses with a scheme, and values named as a host; leftmost, non-overlapping.

    The scheme is read backwards from "://", so long dotted runs cost no more than their length.
    """
    found, done = [m.span() for m in _HOST.finditer(text)], 0
    for m in _URL_REST.finditer(text):
        j = m.start()
        while j > done and text[j - 1] in _SCHEME_CHARS:
            j -= 1
        scheme = _SCHEME.search(text, j, m.start())
        if scheme:
            found.append((scheme.start(), m.end()))
        done = m.end()
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def linked_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Weak parts that a complementary part in scope confirms."""
    none = {"secret": [], "ident": [], "endpoint": []}
    low = text.lower()
    if not any(x in low for x in _WEAK_MARKS) and not base["access"]:
        return none
    endpoint = endpoint_spans(text)
    ident = [m.span() for m in _IDENT.finditer(text)]
    if not (endpoint or ident or base["access"]):
        return none
    strong = _disjoint(base["assign"] + base["access"] + base["hex"] + endpoint + ident)
    known = _Parts(strong, [])

    def free(a: int, b: int) -> bool:
        i = bisect_left(known.starts, b) - 1
        return i < 0 or known.spans[i][1] <= a

    weak = [m.span() for m in _OPAQUE.finditer(text) if free(*m.span()) and _opaque(m.group())]
    breaks = _paragraphs(text)
    givers = _Parts(_disjoint(endpoint + ident + base["access"]), breaks)
    takers = _Parts(_disjoint(weak + base["assign"] + base["hex"]), breaks)
    return {
        "secret": [s for s in weak if givers.near(*s)],
        "ident": [s for s in ident if takers.near(*s)],
        "endpoint": [s for s in endpoint if takers.near(*s)],
    }


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    rows = sorted((a, KINDS.index(k), b) for k, found in spans.items() for a, b in found)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def scan_text(text: str) -> tuple[dict, dict]:
    base = base_spans(text)
    return base, {**base, **linked_spans(text, base)}


_OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: counts of strong findings, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, every = scan_text(t or "")
                rows.append((len(base["assign"]), len(base["access"]), len(base["hex"]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_column, *(x.split()[0] for x in _OUT.split(", "))])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, {_OUT}")


def redact_text(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every found span replaced; overlapping spans are replaced once."""
    _, every = scan_text(text)
    at, out = 0, []
    for a, b in _disjoint([s for found in every.values() for s in found]):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """docs with secrets masked; rows without any stay as they are, nulls stay null.

    n_chars, if the table has it, follows a changed text.
    """
    at = docs.columns.index(text)
    size_at = docs.columns.index(n_chars) if n_chars and n_chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None else redact_text(t, mark) for t in old]
            cols = list(batch.columns)
            if new != old:
                cols[at] = pa.array(new, batch.schema.field(at).type)
                if size_at is not None:
                    sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(size_at).to_pylist(), old, new)]
                    cols[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
