"""Secrets: fixed patterns, and the entropy of sliding windows over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows
from .spans import Span, digest, joined

# The base patterns of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]

_assign = re.compile(ASSIGN, re.I | re.A)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so a run of under 32 can be left out at once
_words = ("password", "passwd", "secret", "token", "api")
_candidate = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class EntropyRules:
    """``least``: bits a character that a window of ``window`` characters needs, by the class of its candidate."""

    window: int = 20
    least: dict = field(default_factory=lambda: {"hex": 3.0, "alnum": 3.6, "base64": 3.8})
    #: Candidates that match one of these whole are no secrets: UUIDs, placeholder values, paths and words joined by dashes.
    allow: tuple = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"(?i:.*(example|sample|dummy|placeholder|changeme|xxxx).*)",
        r"[A-Za-z/_+=-]*",
        r"[0-9_+/=-]*",
    )


def class_of(candidate: str) -> str | None:
    """The narrowest class that holds the candidate; null if its characters are of one sort alone, as words are."""
    if not any(c.isdigit() for c in candidate) or not any(c.isalpha() for c in candidate):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate):
        return "hex"
    return "alnum" if candidate.isalnum() else "base64"


def highest_entropy(text: str, window: int) -> float:
    """The largest Shannon entropy (bits a character) of any window, from counts that change by two a step."""
    w = min(window, len(text))
    if not w:
        return 0.0
    clog = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]  # a character comes before one goes
    counts: dict = {}
    total = 0.0  # sum of c * log2(c)
    best = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += clog[n + 1] - clog[n]
        if i >= w:
            d = text[i - w]
            n = counts[d]
            counts[d] = n - 1
            total += clog[n - 1] - clog[n]
        if i >= w - 1:
            best = max(best, math.log2(w) - total / w)
    return best


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in _words):
        spans += [("assign", *m.span()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span()) for m in _hex.finditer(text)]
    return spans


def scan(text: str, rules: EntropyRules = EntropyRules(), allow: list | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that only their entropy gives away: candidates, or what base spans leave of them if that's one itself."""
    allow = [re.compile(a) for a in rules.allow] if allow is None else allow
    base = base_spans(text)
    covered = merged((a, b) for _, a, b in base)
    found, first = [], 0
    for m in _candidate.finditer(text):
        while first < len(covered) and covered[first][1] <= m.start():  # candidates come in order, so nothing is passed twice
            first += 1
        for part in outside(*m.span(), covered, first):
            x = text[slice(*part)]
            kind = class_of(x) if _candidate.fullmatch(x) else None
            if kind and not any(a.fullmatch(x) for a in allow) and highest_entropy(x, rules.window) >= rules.least[kind]:
                found.append(("entropy", *part))
    return base, found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What spans cover, as stretches that don't touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def outside(start: int, end: int, spans: list[tuple[int, int]], first: int = 0) -> list[tuple[int, int]]:
    """The stretches of ``start`` .. ``end`` that none of the spans, in order of their starts and from the ``first`` on, covers."""
    parts = []
    for a, b in (spans[k] for k in range(first, len(spans))):
        if a >= end:
            break
        if a > start:
            parts.append((start, a))
        start = max(start, b)
    return parts + [(start, end)] * (start < end)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover, overlapping ones together, replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, rules: EntropyRules = EntropyRules(), id_col: str = "doc_id", text: str = "text", redacted: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: counts a kind, digest of the base spans, all spans, and with ``redacted`` the text without them.

    Null and empty texts have no spans; the redacted form of null is null.
    Null and repeated ids and repeated rows each get a row; an empty table gives
    none; other columns are left out, but those that ``keep`` names and that
    aren't the result's. Candidates of any length are scanned whole, in time that grows with their length.
    """

    own = {id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"}
    passed = [c for c in keep or [] if c not in own]

    def make():
        allow = [re.compile(a) for a in rules.allow]

        def each(cols):
            out: dict = {"id": cols["_id"], "rest": cols["_rest"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "redacted": []}
            for x in cols["_text"]:
                base, more = scan(x, rules, allow) if x else ([], [])
                for k in BASE:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(digest(joined(base, KINDS)))
                out["spans"].append(joined(base + more, KINDS))
                out["redacted"].append(redact(x, base + more) if redacted and x else x if redacted else None)
            return out

        return each

    rest = F.struct(*[F.col(c) for c in passed]) if passed else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), rest.alias("_rest"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    got = map_rows(rows, f"id {kinds['_id']}, rest {kinds['_rest']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string", make)
    return got.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", *["redacted"] * redacted, *[F.col(f"rest.{c}").alias(c) for c in passed])
