"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds anchors: at-signs, schemes, plus
signs before a digit, dots before a digit, digits and words that announce an
account. At each anchor a local parser reads outward from it, so the text
between anchors is never parsed. The parsers give just the leftmost
non-overlapping matches of the contract's patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows
from .spans import Span, digest, joined

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "account"]
# Character sets and lengths of the contract's patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words that announce an account number; compared in lower case.
CUES = ("iban", "account", "acct")
_iban = re.compile(r"(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")  # starts may overlap
#: Characters of a country's account numbers, blanks not counted.
LENGTHS = {
    k: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in countries.split()
}
_scheme_left = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_userinfo = re.compile(r"[^\s/@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, "d")
            a.add_word("." + d, ".")
            a.add_word("+" + d, "+")
        a.add_word("@", "@")
        a.add_word("://", ":")
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, "c")
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def accounts(text: str, start: int) -> list[Span]:
    """All account numbers from ``start`` on: of their country's length or, where that's unknown, of the most whole groups that check."""
    got: list[Span] = []
    for m in _iban.finditer(text, start):
        if got and m.start() < got[-1][2]:
            continue
        run = m.group(1)
        places = [i for i, c in enumerate(run) if c != " "]
        if own := LENGTHS.get(run[:2]):
            ends = [p + 1 for p in places[own - 1 : own]]
        else:
            ends = [p + 1 for p in reversed(places[14:]) if run[p + 1 : p + 2] in ("", " ")]
        if end := next((e for e in ends if iban_ok(run[:e])), None):
            got.append(("account", m.start(), m.start() + end))
    return got


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans of the further kinds: addresses with a user in them, and checked account numbers."""
    base: list[Span] = []
    more: list[Span] = []
    email_end = ip_end = card_end = phone_end = 0
    dots: set[int] = set()
    starts: list[int] = []
    last_digit = -2
    cue = None
    for at, kind in _automaton().iter(text):
        if kind == "d":
            if at != last_digit + 1:
                starts.append(at)
            last_digit = at
        elif kind == ".":
            dots.add(at - 1)
        elif kind == "@":
            a = at
            while a > email_end and text[a - 1] in LOCAL:
                a -= 1
            if a < at and (m := _domain.match(text, at + 1)):
                base.append(("email", a, m.end()))
                email_end = m.end()
        elif kind == "+":
            if at - 1 >= phone_end and (m := _phone.match(text, at - 1)):
                phone_end = m.end()
                if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                    base.append(("phone", *m.span()))
        elif kind == ":":
            a = at - 2
            while a > 0 and text[a - 1] in _scheme_left:
                a -= 1
            if a < at - 2 and (m := _userinfo.match(text, at + 1)):
                more.append(("url", a, m.end()))
        elif cue is None:
            cue = at + 1
    if cue is not None:
        more += accounts(text, cue)
    for a in starts:
        if a >= card_end and (m := _card.match(text, a)):
            card_end = m.end()
            digits = [c for c in m.group() if c in DIGITS]
            if 12 <= len(digits) <= 19 and luhn("".join(digits)):
                base.append(("card", *m.span()))
        if dots and a >= ip_end and (m := _ip.match(text, a)):
            ip_end = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                base.append(("ip", *m.span()))
    return base, more


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts a kind, digest of the base spans, all spans.

    Null and empty texts have no spans. Repeated rows each get a row; other
    columns are left out. Texts of any length are read whole.
    """

    def make():
        def each(cols):
            out: dict = {"id": cols[id_col], "n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": []}
            for x in cols[text]:
                base, more = find(x) if x else ([], [])
                for k in BASE:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(digest(joined(base, KINDS)))
                out["spans"].append(joined(base + more, KINDS))
            return out

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    got = map_rows(docs.select(id_col, text), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)
    return got.select(F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
