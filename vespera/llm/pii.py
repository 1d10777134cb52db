"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Kinds email, ip, card and phone are the base: every confirmed base span is reported. Further kinds (iban, ssn,
local_phone, birth_date) are reported when their score, prior plus context, reaches the threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from vespera.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "birth_date")
#: Characters on each side of a span in which context words count.
NEAR = 60
THRESHOLD = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_DATE = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])")
_DIGITS = re.compile(r"[0-9]")

#: Kind: pattern, prior score, words that raise it, words that lower it.
CONTEXT = {
    "iban": (_IBAN, 0.6, ("iban", "account", "bank", "konto", "compte", "cuenta"), ("serial", "part no", "isbn")),
    "ssn": (_SSN, 0.3, ("ssn", "social security", "tax id"), ("order", "invoice", "isbn")),
    "local_phone": (_LOCAL_PHONE, 0.2, ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"), ("version", "order", "invoice")),
    "birth_date": (_DATE, 0.1, ("born", "birth", "dob", "geboren", "né le", "nacido", "nacimiento"), ("version", "released", "updated")),
}


#: Kind: the words of CONTEXT as whole words.
_SAID = {kind: tuple(re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)") for words in rule[2:]) for kind, rule in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the account number leaves 1 modulo 97, letters read as 10 to 35."""
    x = iban.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    # Found from each @ outwards: the same matches as the pattern's, but linear on long runs without an @.
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _ip_ok(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base kinds, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _around(text: str, start: int, end: int) -> str:
    """The whole words within NEAR characters before and after a span, lower-cased."""
    a, b = max(0, start - NEAR), min(len(text), end + NEAR)
    while 0 < a < start and text[a - 1].isalnum() and text[a].isalnum():
        a += 1
    while end < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b -= 1
    return f"{text[a:start]} \x00 {text[end:b]}".lower()


def context_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, index of kind, end, score) of the further kinds that overlap no base span."""
    out = []
    if not _DIGITS.search(text):
        return out
    for kind, (pattern, prior, *_) in CONTEXT.items():
        up, down = _SAID[kind]
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "iban" and not mod97(m[0]) or any(a < e and s < b for a, _, b in taken):
                continue
            near = _around(text, s, e)
            score = prior + 0.4 * bool(up.search(near)) - 0.3 * bool(down.search(near))
            if score >= THRESHOLD:
                out.append((s, KINDS.index(kind), e, score))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    base = base_spans(text or "")
    return base, context_spans(text or "", base)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind,start,end,score>> sorted by start, offsets in code points.

    A null text counts as empty and has no spans; repeated rows are each reported; other columns are ignored. Texts
    are scanned whole, in time linear in their length. Overlapping base spans of different kinds all stay.
    """

    def make():
        def f(ids, texts):
            out = []
            for t in texts:
                base, more = scan(t)
                found = sorted([(*x, 1.0) for x in base] + more)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": v} for s, k, e, v in found])
            return ids, out

        return f

    got = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(got, make, f"doc_id {got.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,score:double>>")
