"""Secret scan: key patterns, and Shannon entropy in sliding windows over candidate strings."""
from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .layout import slices, texts

# Patterns of the contract; letters of the words in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

# Character classes for entropy: candidate pattern, window length, bits a character in a window must carry.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]{32,}"), 32, 3.0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0))
# Spans that are no secrets: UUIDs, runs of the alphabet or of digits, whole checksums named as such, example words and the key of AWS's manuals.
ALLOW = (re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"), re.compile(r"abcdefghijklm|ABCDEFGHIJKLM|0123456789"),
         re.compile(r"(?<![A-Za-z0-9])(md5[-_=]([0-9a-f]{32}|[A-Za-z0-9+/]{22}={0,2})|sha1[-_=]([0-9a-f]{40}|[A-Za-z0-9+/]{27}=?)|sha256[-_=]([0-9a-f]{64}|[A-Za-z0-9+/]{43}=?)"
                    r"|sha384[-_=]([0-9a-f]{96}|[A-Za-z0-9+/]{64})|sha512[-_=]([0-9a-f]{128}|[A-Za-z0-9+/]{86}={0,2}))(?![A-Za-z0-9+/=])"),
         re.compile(r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|EXAMPLE"))
PATH = re.compile(r"[a-z0-9_-]*(/[a-z0-9_-]+){3,}/?")  # a candidate that is one is judged segment by segment


def hot_windows(value: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Union of the windows whose Shannon entropy is ``bits`` or more; one count leaves and one enters at each step."""
    if len(value) < window:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]  # entropy = log2(window) - sum(c log2 c) / window
    most = window * (math.log2(window) - bits) + 1e-9
    counts: dict[str, int] = {}
    load = 0.0
    out: list[list[int]] = []
    for i, c in enumerate(value):
        n = counts.get(c, 0)
        counts[c] = n + 1
        load += weigh[n + 1] - weigh[n]
        if i >= window:
            gone = value[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            load += weigh[n - 1] - weigh[n]
        if i >= window - 1 and load <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    return [(a, b) for a, b in out]


def suspect(value: str, window: int, bits: float, allow=ALLOW) -> list[tuple[int, int]]:
    """Hot windows of a candidate that lie outside every allowed span, and inside one segment if the candidate is a path."""
    if not hot_windows(value, window, bits):
        return []
    parts, at = [], 0
    for a, b in sorted(m.span() for p in allow for m in p.finditer(value)):
        parts.append((at, a))
        at = max(at, b)
    parts.append((at, len(value)))
    if PATH.fullmatch(value):
        parts = [(a + m.start(), a + m.end()) for a, b in parts for m in re.finditer("[^/]+", value[a:b])]
    return [(a + x, a + y) for a, b in parts for x, y in hot_windows(value[a:b], window, bits)]


def scan(text: str, classes=CLASSES, allow=ALLOW) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, each leftmost and non-overlapping, then of the entropy kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans = []
    for _, pattern, window, bits in classes:
        for m in pattern.finditer(text):
            spans += [(m.start() + a, m.start() + b) for a, b in suspect(m[0], window, bits, allow)]
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return found + [("entropy", a, b) for a, b in merged]


def spell(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_documents(docs: DataFrame, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): base spans and all spans of each whole text, in code points.

    A null or empty text has none; every row of ``docs`` gives one row, repeated rows and null doc_ids too."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def work(batches):
        for batch, values in slices(batches):
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), values):
                found = scan(value, classes, allow)
                base = [s for s in found if s[0] != "entropy"]
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append({"doc_id": key, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base": spell(base), "spans": spell(found)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return texts(docs).mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
