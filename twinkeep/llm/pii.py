"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Patterns propose spans of each kind; a validator (Luhn for cards, mod-97 for bank
accounts, ranges for addresses, entropy for secrets) confirms or drops them, and words close
by raise or lower the score. Proposals of the base kinds that their validator accepts are
always kept; weaker kinds (``iban``, ``ssn``, ``secret``) are kept from ``MIN_SCORE`` on.

The patterns are written so that their time is linear in the text: an email is
found from its ``@``, number runs are taken whole and never tried again. An account
is one of the beginnings of a run of groups, of which there are at most nine: the one
of its country's length if the checksum confirms it, else the longest confirmed one.
A secret is what is assigned to a name that tells so, if it has letters and digits and its
characters vary as those of random text do, or a key of a form that its issuer fixes.

Null and empty texts have no spans. Rows are independent, so repeated rows and
repeated or null ids each give their own result; an empty table gives no rows, and a
column of the input that bears the name of a new one is replaced. Offsets count code points.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

#: Context words, the score without context, and their effect.
CONTEXT = {
    "email": ("mail", "email", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "auth", "credential", "bearer"),
}
AGAINST = ("version", "isbn", "serial", "order", "build", "invoice")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.6}
CONTEXT_GAIN, CONTEXT_LOSS, CONTEXT_REACH, MIN_SCORE = 0.2, 0.2, 40, 0.5

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}+){3,8}+")
_GROUP_END = re.compile(r"(?<=[A-Z0-9])(?!\w)")
#: Characters of an account by country.
IBAN_LENGTH = {
    code[:2]: int(code[2:])
    for code in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 "
        "EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
        "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 "
        "PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 "
        "UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Names that secrets are assigned to, and forms of issued keys.
_ASSIGNED = re.compile(
    r"""(?i:token|secret|passwo?r?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)"""
    r"""[A-Za-z0-9_-]{0,32}+["']?(?:[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}|[ \t]{1,4})["']?([A-Za-z0-9+/=_.~-]{16,}+)"""
)
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
    r"|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]++(?:-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
)
#: Bits per character from which an assigned value counts as random; hexadecimal digits reach 4.
LEAST_ENTROPY = 3.0
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    for hit in _DOMAIN.finditer(text):
        at = hit.start()
        # The run of local characters that ends at the @, read backwards.
        low = at
        while low > free and text[low - 1] in _LOCAL:
            low -= 1
        if low < at:
            found.append((low, hit.end()))
            free = hit.end()
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    return [
        m.span()
        for m in _IP.finditer(text)
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))
    ]


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for hit in _CARD.finditer(text):
        digits = hit[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(hit.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [
        m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15
    ]


def _ibans(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    while hit := _IBAN.search(text, at):
        start, at = hit.start(), hit.start() + 4
        able = []
        # One character more than the run, for the look ahead.
        for place in _GROUP_END.finditer(text, at, min(len(text), hit.end() + 1)):
            end = place.start()
            account = text[start:end].replace(" ", "")
            if end <= hit.end() and 15 <= len(account) <= 34 and mod97(account):
                able.append((len(account) == IBAN_LENGTH.get(account[:2]), end))
        if able:
            at = max(able)[1]
            found.append((start, at))
    return found


def _ssns(text: str) -> list[tuple[int, int]]:
    return [
        m.span()
        for m in _SSN.finditer(text)
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00"
    ]


def entropy(value: str) -> float:
    """Bits per character, by the characters' shares."""
    return sum(n / len(value) * log2(len(value) / n) for n in Counter(value).values())


def _secrets(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in _ISSUED.finditer(text)]
    for hit in _ASSIGNED.finditer(text):
        value = hit[1].rstrip(".=")
        mixed = any(map(str.isdigit, value)) and any(map(str.isalpha, value))
        if len(value) >= 16 and mixed and entropy(value) >= LEAST_ENTROPY:
            found.append((hit.start(1), hit.start(1) + len(value)))
    apart = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not apart or start >= apart[-1][1]:
            apart.append((start, end))
    return apart


def spans(text: str | None) -> list[Span]:
    """All spans of a text by kind as listed in ``KINDS``, then by start."""
    if not text:
        return []
    proposed: dict[str, list[tuple[int, int]]] = {}
    if "@" in text:
        proposed["email"] = _emails(text)
    if _DIGIT.search(text):
        proposed["ip"] = _ips(text)
        proposed["card"] = _cards(text)
        proposed["phone"] = _phones(text) if "+" in text else []
        proposed["iban"] = _ibans(text)
        proposed["ssn"] = _ssns(text)
        proposed["secret"] = _secrets(text)
    out = []
    for kind in KINDS:
        for start, end in proposed.get(kind, ()):
            score = _score(text, kind, start, end)
            if kind in BASE_KINDS or score >= MIN_SCORE:
                out.append(Span(kind, start, end, score))
    return out


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_REACH) : start] + " " + text[end : end + CONTEXT_REACH]
    words = set(_WORD.findall(near.lower()))
    score = PRIOR[kind]
    score += CONTEXT_GAIN * (not words.isdisjoint(CONTEXT[kind]))
    score -= CONTEXT_LOSS * (not words.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, score)), 3)


def masked(text: str | None, found: list[Span]) -> str | None:
    """The text with each span, overlapping ones joined, replaced by ``[KIND]``."""
    if not found:
        return text
    parts, done = [], 0
    for span in sorted(found, key=lambda s: (s.start, -s.end)):
        if span.start >= done:
            parts += [text[done : span.start], f"[{span.kind.upper()}]"]
        done = max(done, span.end)
    return "".join([*parts, text[done:]])


def find_pii(docs: DataFrame, text: str = "text", mask: bool = False) -> DataFrame:
    """``docs`` with ``pii`` (the spans, with score) and, if asked, ``masked``.

    ``masked`` equals the text where nothing was found and is null for a null text.
    """
    fields = "pii array<struct<kind string, start long, end long, score double>>"
    kind = rows._arrow(rows.T._parse_datatype_string(fields).fields[0].dataType)

    def make():
        def work(texts: pa.Array):
            values = texts.to_pylist()
            found = [spans(v) for v in values]
            column = pa.array([[s._asdict() for s in f] for f in found], type=kind)
            if not mask:
                return [column]
            return [column, pa.array([masked(v, f) for v, f in zip(values, found)], pa.string())]

        return work

    return rows.append(docs, [text], make, fields + (", masked string" if mask else ""))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and span lists of ``find_pii``, one row per input row."""

    def written(kinds: tuple[str, ...]):
        parts = F.filter("pii", lambda s: s["kind"].isin(*kinds))
        return F.array_join(
            F.transform(
                parts,
                lambda s: F.concat_ws(
                    ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
                ),
            ),
            ",",
        )

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(written(BASE_KINDS), 256).alias("base_sha256"),
        written(KINDS).alias("spans"),
    )
