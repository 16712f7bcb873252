"""Personal data by anchor expansion (operator 9).

One Aho-Corasick automaton finds anchors in the whole text: at-signs, URL schemes, colons, digits,
identifier cues and street words, in any case.  At each anchor a deterministic local parser expands to
the left and right, fixes the boundaries and validates: mail addresses (labels, top-level domain, letters
of any alphabet), URLs that carry a user, a bare host number or a personal parameter, IPv4 and IPv6
addresses, payment cards (13 to 19 digits, Luhn), IBANs (mod 97), phone numbers (digits and grouping),
numbers after identifier cues (ssn, passport, account ...) and postal addresses (a street with a house
number, with unit, town and postcode where they follow; English, German, French and Spanish forms).

The time is linear in the text: a parser looks at a bounded stretch around its anchor, or at a run of
characters that no second anchor makes it read again.

Defined cases: null and empty texts have no findings; null ids are reported as null; repeated rows are
reported each; texts of any length are scanned whole; findings don't overlap: the one whose anchor comes
first wins, but for numbers inside an address or URL that begins before them, which are part of it; a
local part or scheme is reported whole however long it is; an empty table gives an empty result; other
columns are kept by redacted() and ignored by findings().  Values are reported as a digest with their
place; redacted() puts the kind in angle brackets in their place and adjusts n_chars if there is one.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common as C

CUES = ("iban", "ssn", "social security", "passport", "account no", "account number", "acct", "tax id", "driver", "patient id", "customer id", "member id", "konto", "cuenta", "compte")
#: Street word -> where its house number stands: before the name (and the word after it), after the word's own name, or after the words that follow it.
STREETS = {
    **dict.fromkeys(("street", "avenue", "road", "boulevard", "lane", "drive", "court", "terrace", " st.", " ave.", " rd.", " blvd"), "en"),
    **dict.fromkeys(("straße", "strasse", "str.", "allee"), "de"),
    **dict.fromkeys(("rue ", "avenue ", "boulevard ", "chemin ", "impasse "), "fr"),
    **dict.fromkeys(("calle ", "avenida ", "paseo ", "plaza "), "es"),
}
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff\u0400-\u052f"
_LABEL = _LETTER + "\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af"
_WIDE = re.compile(rf"[{_LETTER}]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_EDGE = "!#$%&'*/=?^`{|}~.-"
_DOMAIN = re.compile(rf"(?:[{_LABEL}0-9](?:[{_LABEL}0-9-]{{0,61}}[{_LABEL}0-9])?\.)+(?:[Xx][Nn]--[A-Za-z0-9-]{{1,58}}[A-Za-z0-9]|[{_LETTER}]{{2,24}})(?![{_LETTER}0-9])")
_URL_END = re.compile(r"[^\s<>\"'`|\\^{}]*")
_HOST_END = re.compile(r"[^\s<>\"'`|\\^{}/?#]*")
_PERSONAL = re.compile(r"[?&](?:email|user|token|phone|ssn)=[^&\s]")
_IPV4 = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", re.A)
_IPV6 = re.compile(r"[0-9A-Fa-f:.]*")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?![\d])", re.A)
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)", re.A)
_SSN = re.compile(r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d)", re.A)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)
_ACCOUNT = re.compile(r"[^A-Za-z0-9\n]{0,3}(?:(?:no|nr|number|id|is)\b)?[\s:#=.]{0,4}(?P<v>[A-Z0-9][A-Z0-9-]{5,34})", re.I | re.A)
_HOUSE = r"\d{1,5}[A-Za-z]?(?:[-/]\d{1,4}[A-Za-z]?)?"
_CAPITAL = rf"(?:[^\W\d_a-z][\w.'’-]{{0,30}}|\d{{1,3}}(?:st|nd|rd|th))"
_EN_BEFORE = re.compile(rf"(?<![\w.,-])(?P<s>{_HOUSE}[ ](?:{_CAPITAL}[ ]){{0,3}}{_CAPITAL}[ ]?)\Z")
_EN_AFTER = re.compile(rf"(?:,?[ ](?:Apt|Apartment|Suite|Ste|Unit|Floor|Fl)\.?[ ]#?\w{{1,6}}\b|,?[ ]#\w{{1,6}}\b)?(?:,[ ](?:{_CAPITAL}[ ]){{0,2}}{_CAPITAL},?[ ][A-Z]{{2}}(?:[ ]\d{{5}}(?:-\d{{4}})?\b)?)?")
_POSTCODE = rf"(?:,?[ \n](?:[A-Z]{{1,2}}-)?\d{{4,5}}[ ]{_CAPITAL}(?:[ -]{_CAPITAL}){{0,2}})?"
_DE_BEFORE = re.compile(r"(?<![^\W_])(?P<s>(?!(?:Die|Der|Das|Dieser?|Eine[rn]?|In|Zur|Auf)[ -])[^\W\d_a-zß][^\W\d_]{0,30}(?:-[^\W\d_a-zß][^\W\d_]{0,30}){0,2}[ -]?)\Z")
_NUMBER_AFTER = re.compile(rf"[ ](?P<n>{_HOUSE})(?!\w|[.,]\d)" + _POSTCODE)
_FR_BEFORE = re.compile(rf"(?<![\w.,-])(?P<s>{_HOUSE}(?:[ ](?:bis|ter))?,?[ ])\Z")
_NAME = r"(?:(?:de|du|des|la|le|les|l|d|del|los|las|el)\b['’ ]?[ ]?){0,3}" + rf"{_CAPITAL}(?:[ -](?:(?:de|du|des|la|del|los|las)[ ]){{0,2}}{_CAPITAL}){{0,3}}"
_FR_AFTER = re.compile(_NAME + _POSTCODE)
_ES_AFTER = re.compile(_NAME + rf",?[ ](?:n[.º°]{{1,2}}[ ]?|núm\.?[ ])?(?P<n>{_HOUSE})(?!\w|[.,]\d)" + _POSTCODE)
_IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
#: Characters that a street parser looks at on either side.
_REACH = 160
_DOUBLED = {str(d): d * 2 - 9 * (d > 4) for d in range(10)}
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_auto: list = []


def _automaton():
    if not _auto:
        import ahocorasick

        a = ahocorasick.Automaton()
        forms: dict[str, list[tuple[str, int]]] = {"@": [("at", 1)], "://": [("scheme", 3)], ":": [("colon", 1)]}
        for d in "0123456789":
            forms[d] = [("digit", 1)]
        for cue in CUES:
            forms.setdefault(cue, []).append(("cue", len(cue)))
        for word, form in STREETS.items():
            forms.setdefault(word, []).append((form, len(word)))
        for word, kinds in forms.items():
            a.add_word(word, kinds)
        a.make_automaton()
        _auto.append(a)
    return _auto[0]


def _lower(t: str) -> str:
    """In lower case, character by character."""
    low = t.lower()
    return low if len(low) == len(t) else t.translate(_ASCII_LOWER)


def email(t: str, at: int) -> tuple[int, int] | None:
    """Boundaries of the mail address around the at-sign."""
    m = _DOMAIN.match(t, at + 1)
    if not m:
        return None
    s = at
    while s and (t[s - 1] in _LOCAL or (t[s - 1] > "\x7f" and _WIDE.match(t[s - 1]))):
        s -= 1
    local = t[s:at]
    cut = max(local.rfind(".."), -1)
    if cut >= 0:
        s += cut + 2
        local = t[s:at]
    s += len(local) - len(local.lstrip(_EDGE))
    if s >= at or t[at - 1] == "." or not any(c.isalnum() for c in t[s:at]):
        return None
    return s, m.end()


class _Urls:
    """URLs of one text; remembers how far the run of URL characters has been read."""

    def __init__(self, t: str):
        self.t, self.end, self.personal = t, -1, -1

    def parse(self, at: int) -> tuple[int, int] | None:
        """Boundaries of a URL that names a user or a bare address; others aren't personal."""
        t, s = self.t, at
        while s and t[s - 1].isascii() and t[s - 1].isalnum():
            s -= 1
        if s == at or not t[s].isalpha():
            return None
        begin = at + 3
        if begin > self.end:
            self.end = _URL_END.match(t, begin).end()
            self.personal = max((m.start() for m in _PERSONAL.finditer(t, begin, self.end)), default=-1)
        h = _HOST_END.match(t, begin).end()
        if "@" in t[begin:h] or _IPV4.match(t, begin, h) or (t[begin : begin + 1] == "[" and _ipv6(t[begin + 1 : h].partition("]")[0])) or self.personal >= begin:
            e = self.end
            while e > begin and t[e - 1] in ".,;:!?)]*#$%&":
                e -= 1
            return (s, e) if e > begin else None
        return None


def _ipv6(v: str) -> bool:
    """An address of the global, local or private ranges."""
    try:
        first = int(v.partition(":")[0] or "0", 16)
        ipaddress.IPv6Address(v)
    except ValueError:
        return False
    return 0x2000 <= first <= 0x3FFF or 0xFC00 <= first <= 0xFDFF or 0xFE80 <= first <= 0xFEBF


def ipv6(t: str, at: int) -> tuple[int, int] | None:
    """Boundaries of the IPv6 address whose first colon this is."""
    s = at
    while s and at - s < 5 and t[s - 1] in "0123456789abcdefABCDEF":
        s -= 1
    if not 3 <= at - s <= 4 or (s and (t[s - 1].isalnum() or t[s - 1] in "_:.-")):
        return None
    e = _IPV6.match(t, at, at + 48).end()
    while e > at and t[e - 1] in ".:" and t[e - 2 : e] != "::":
        e -= 1
    if e < len(t) and (t[e].isalnum() or t[e] == "_"):
        return None
    return (s, e) if _ipv6(t[s:e]) else None


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(_DOUBLED.__getitem__, digits[-2::-2]))) % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _ends(t: str, m: re.Match) -> list[int]:
    """Where a matched number may end: at its own end or before one of its separators, the longest first."""
    return [m.end()] + [e for e in range(m.end() - 1, m.start(), -1) if t[e] in " -"]


def _iban_end(t: str, m: re.Match) -> int | None:
    """The end of the IBAN that the match begins with; groups after it (a currency, a number) don't belong to it."""
    want = _IBAN_LENGTHS.get(m.group()[:2])
    size = {e: len(t[m.start() : e].replace(" ", "")) for e in _ends(t, m)}
    for e in sorted(size, key=lambda e: (size[e] != want, -e)):
        if (size[e] == want or want is None or e == m.end()) and iban(t[m.start() : e]):
            return e
    return None


def _card_end(t: str, m: re.Match) -> int | None:
    """The end of the card number that the match begins with, without a date or check number after it."""
    for e in _ends(t, m):
        d = t[m.start() : e].replace(" ", "").replace("-", "")
        if len(d) < 13:
            break
        if luhn(d) and len(set(d)) > 1:
            return e
    return None


def number(t: str, at: int) -> tuple[str, int, int] | None:
    """What begins at the first digit of a run, if it is something personal."""
    before = t[at - 1] if at else " "
    if at >= 2 and before.isupper() and t[at - 2].isupper() and (at < 3 or not t[at - 3].isalnum()):
        m = _IBAN.match(t, at - 2)
        if m and (e := _iban_end(t, m)):
            return "iban", at - 2, e
    if before.isalnum() or before in "_":
        return None
    if m := _IPV4.match(t, at):
        return ("ip", at, m.end()) if before != "." else None
    if m := _SSN.match(t, at):
        return "ssn", at, m.end()
    if m := _CARD.match(t, at):
        if e := _card_end(t, m):
            return "card", at, e
    s = at
    if before == "(":
        s = at - 1
    if s and t[s - 1] == "+":
        s -= 1
    if s >= 2 and t[s - 1] in " .-" and t[s - 2].isdigit():
        return None  # the tail of a longer number
    if m := _PHONE.match(t, s):
        v = m.group()
        n = sum(c.isdigit() for c in v)
        if 8 <= n <= 15 and ("+" in v or "(" in v or (n in (10, 11) and len(re.findall(r"\d+", v)) >= 3)):
            return "phone", s, m.end()
    return None


def account(t: str, after: int) -> tuple[int, int] | None:
    """Boundaries of the number that follows an identifier cue: 6 to 34 characters, three digits in a row."""
    m = _ACCOUNT.match(t, after)
    if not m:
        return None
    s, e = m.span("v")
    if e < len(t) and t[e].isascii() and t[e].isalnum():
        return None  # longer than any such number
    while t[e - 1] == "-":
        e -= 1
    return (s, e) if 6 <= e - s <= 34 and re.search(r"\d{3}", t[s:e], re.A) else None


def street(t: str, form: str, s: int, e: int) -> tuple[int, int] | None:
    """Boundaries of the postal address around the street word [s, e)."""
    left = t[max(0, s - _REACH) : s]
    to = min(len(t), e + _REACH)
    if form == "en":
        word = t[s:e]
        if (word[0] == " " and not word[1].isupper()) or (word[0] != " " and not word[0].isupper()) or (e < len(t) and (t[e].isalnum() or t[e] in "_-")):
            return None
        m = _EN_BEFORE.search(left if word[0] != " " else left + " ")
        return (s - len(left) + m.start("s"), _EN_AFTER.match(t, e, to).end()) if m else None
    if form == "de":
        n = _NUMBER_AFTER.match(t, e, to)
        m = n and _DE_BEFORE.search(left[-100:])
        return (s - len(left[-100:]) + m.start("s"), n.end()) if m else None
    if s and t[s - 1].isalnum():
        return None
    if form == "fr":
        m = _FR_BEFORE.search(left[-24:])
        n = m and _FR_AFTER.match(t, e, to)
        return (s - len(left[-24:]) + m.start("s"), n.end()) if n else None
    n = _ES_AFTER.match(t, e, to)
    return (s, n.end()) if n and t[s].isupper() else None


def scan(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, in characters."""
    out: list[tuple[str, int, int]] = []
    end, digits_to, urls, low = 0, -1, _Urls(t), _lower(t)

    def found(kind: str, size: int, last: int) -> tuple[str, int, int] | None:
        nonlocal digits_to
        at = last - size + 1
        if kind == "digit":
            digits_to = at  # the run's later digits begin nothing
            while digits_to + 1 < len(t) and t[digits_to + 1] in "0123456789":
                digits_to += 1
            return number(t, at)
        if kind == "colon":
            r = ipv6(t, at)
            return ("ip", *r) if r else None
        if kind == "at":
            r = email(t, at)
            return ("email", *r) if r else None
        if kind == "scheme":
            r = urls.parse(at)
            return ("url", *r) if r else None
        if kind == "cue":
            if at and t[at - 1].isalnum():
                return None
            r = account(t, last + 1)
            if not r:
                return None
            inside = number(t, next(i for i in range(*r) if t[i] in "0123456789"))
            return ("account", *r) if inside is None or inside[1] > r[0] else None
        r = street(t, kind, at, last + 1)
        return ("address", *r) if r else None

    for last, kinds in _automaton().iter(low):
        for kind, size in kinds:
            if last - size + 1 < end or (kind == "digit" and last <= digits_to):
                continue
            if got := found(kind, size, last):
                while out and out[-1][2] > got[1]:  # a number inside an address that is found later
                    out.pop()
                out.append(got)
                end = got[2]
    return out


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, k, s, e, hashlib.sha256(t[s:e].encode("utf-8", "replace")).hexdigest()[:16]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for k, s, e in scan(t)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "kind", "start", "end", "digest"])


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, digest) of every piece of personal data."""
    C.ship(docs.sparkSession)
    return C.require(docs, "doc_id", "text").where("text is not null").mapInArrow(_scan_batches, "doc_id long, kind string, start long, end long, digest string")


def mask(text: str) -> str:
    """The text with <EMAIL>, <CARD> ... in place of what was found."""
    at, parts = 0, []
    for kind, s, e in scan(text):
        parts += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join(parts) + text[at:] if parts else text


def redacted(docs: DataFrame) -> DataFrame:
    """All documents and columns, personal data masked and n_chars (if there is one) adjusted."""
    return C.rewritten(docs, mask)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(C.read(spark, sf_dir, "documents"))
