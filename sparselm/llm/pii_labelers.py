"""Candidate spans of personal data and the votes of the labelers on them.

Six kinds: the four of the base rules, ``iban`` and ``name``.  Candidates come
from loose patterns, the base rules' failing matches included; every labeler
says 1 (personal data), -1 (not) or 0 (no opinion).  All scans are linear in the
text: runs are matched possessively and entered at their first character only.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib

KINDS = ("email", "ip", "card", "phone", "iban", "name")
BASE_KINDS = KINDS[:4]
EMAIL, IP, CARD, PHONE, IBAN, NAME = range(6)
LABELERS = ("format", "check", "listed", "sentinel", "cue", "counter_cue", "boundary")

# fixed values: public lists, cut to common entries
DOMAINS = set("""com org net edu gov mil int info biz io co dev app name pro eu uk de fr es it nl
be at ch se no fi dk pl pt ie us ca mx br ar cl au nz jp cn in kr za ru ua tr gr cz""".split())
CALLING_CODES = tuple("""1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55
56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 351 352
353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972""".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "34", "37", "35", "36", "60", "62", "64", "65")
IBAN_LENGTH = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
               "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
               "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
               "RO": 24, "SE": 24, "SI": 19, "SK": 24}
GIVEN_NAMES = """James John Robert Michael William David Richard Joseph Thomas Charles Daniel
Matthew Anthony Steven Andrew Kenneth George Edward Brian Ronald Mary Patricia Jennifer Linda
Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Laura Rebecca Hans
Peter Klaus Wolfgang Jürgen Stefan Andreas Heinz Ursula Monika Petra Sabine Claudia Pierre Michel
Jacques Philippe Nicolas Sophie Isabelle Nathalie Catherine José Antonio Manuel Francisco Carlos
Miguel Javier Carmen Dolores Pilar Teresa""".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
NO_NAMES = set("""Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March
April May June July August September October November December Street Road Avenue University
Company Court Hospital Award Prize""".split())
CUES = {
    EMAIL: "email e-mail mail mailto contact write correo courriel kontakt".split(),
    IP: "ip host server address client addr ipv4 ipv6 login".split(),
    CARD: "card visa mastercard amex credit debit karte carte tarjeta payment cc".split(),
    PHONE: "phone tel telephone call mobile cell fax whatsapp telefon teléfono handy".split(),
    IBAN: "iban account bank konto compte cuenta".split(),
    NAME: "name dear by from regards sincerely mr mrs dr contact hello".split(),
}
COUNTER_CUES = set("""version isbn issn order invoice section chapter page figure table item sku serial
build release ticket ratio price total id doi""".split())

_EMAIL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_SPELLED_AT = re.compile(r"\x20?[\[(][Aa][Tt][\])]\x20?")
_SPELLED_DOMAIN = re.compile(
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(][Dd][Oo][Tt][\])]\x20?)[A-Za-z0-9-]++)++")
# each scan starts at a character class, which the engine finds fast; what must
# not stand before it is looked up after its first character
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_IPV6 = re.compile(r"[0-9A-Fa-f](?<![0-9A-Za-z:][0-9A-Fa-f])[0-9A-Fa-f]{0,3}"
                   r"(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}+")
_DOTTED_CARD = re.compile(
    r"[0-9](?<![0-9.][0-9])[0-9]{3}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(
    r"(?:0(?<![0-9+.]0)(?:0[1-9][0-9]{0,2}|[0-9]{2,5})|\((?<![0-9+.]\()0?[0-9]{2,5}\))"
    r"(?:[\x20/.-]{1,2}[0-9]{2,8}){1,5}+(?![0-9])")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}"
                   r"(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CAPITAL = re.compile(r"[A-Z](?<!\w[A-Z])[a-zà-ÿ]++(?=\.?\x20[A-Z])")
_FULL_NAME = re.compile(r"(?:%s)\.?\x20(?:[A-Z][a-zà-ÿ]++\x20)?[A-Z][a-zà-ÿ]++(?!\w)"
                        r"|\w++\x20[A-Z][a-zà-ÿ]++(?!\w)" % "|".join(TITLES))
_NAME_STARTS = frozenset(GIVEN_NAMES) | frozenset(TITLES)
_WORD = re.compile(r"\w+(?:-\w+)?")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(s: str) -> list[tuple[int, int]]:
    """Leftmost matches: each start's only possible @ ends its run."""
    out, done, before = [], 0, 0
    at = s.find("@")
    while at >= 0:
        low = max(done, before)
        start = low + len(s[low:at].rstrip(_EMAIL_CHARS))
        if start < at:
            m = _DOMAIN.match(s, at + 1)
            if m:
                out.append((start, m.end()))
                done = m.end()
        before = at + 1
        at = s.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _matches(s: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of every match of the base rules."""
    out = [(EMAIL, a, b, True) for a, b in _emails(s)]
    for m in _IP.finditer(s):
        out.append((IP, m.start(), m.end(), all(map(_small, m.group().split(".")))))
    for m in _CARD.finditer(s):
        d = _digits(m.group())
        out.append((CARD, m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(s):
        out.append((PHONE, m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15))
    return out


def base_spans(s: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    return sorted(x[:3] for x in _matches(s) if x[3])


def candidates(s: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all candidate spans, sorted; a span that
    several patterns of a kind give is one."""
    found: dict[tuple[int, int, int], bool] = {}
    for k, a, b, ok in _matches(s):
        found[k, a, b] = ok
    loose = []
    if "(" in s or "[" in s:
        before = 0
        for m in _SPELLED_AT.finditer(s):
            start = before + len(s[before:m.start()].rstrip(_EMAIL_CHARS))
            tail = _SPELLED_DOMAIN.match(s, m.end())
            if start < m.start() and tail:
                loose.append((EMAIL, start, tail.end()))
            before = m.end()
    for kind, expr in ((IP, _IPV6), (CARD, _DOTTED_CARD), (PHONE, _LOCAL_PHONE), (IBAN, _IBAN)):
        if kind != IP or s.count(":") >= 7:
            loose += [(kind, m.start(), m.end()) for m in expr.finditer(s)]
    done = 0
    for m in _CAPITAL.finditer(s):
        if m.group() in _NAME_STARTS and m.start() >= done:
            full = _FULL_NAME.match(s, m.start())
            if full:
                loose.append((NAME, full.start(), full.end()))
                done = full.end()
    for x in loose:
        found.setdefault(x, False)
    return sorted((*x, ok) for x, ok in found.items())


_STRICT = {
    EMAIL: re.compile(r"[A-Za-z0-9_][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"),
    IP: re.compile(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    CARD: re.compile(r"[0-9]{13,19}|(?:[0-9]{4}[\x20.-]){3}[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}"),
    PHONE: re.compile(r"(?:\+[1-9]|00[1-9]|\(?0)[0-9]{0,4}\)?(?:[\x20./()-]{0,2}[0-9]{1,10}){1,6}"),
    IBAN: re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?|[A-Z]{2}[0-9]{2}[A-Z0-9]+"),
    NAME: re.compile(r"(?:\w+\.?\x20){1,2}[A-Z][a-zà-ÿ]{2,}"),
}


def _check(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        return 1 if re.search(r"[A-Za-z]{2,}\Z", span) else -1
    if kind == IP:
        return 1 if ":" in span or all(map(_small, span.split("."))) else -1
    if kind == CARD:
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == PHONE:
        return 1 if 9 <= len(digits) <= 15 else -1
    if kind == IBAN:
        s = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    return 0


def _listed(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^a-z0-9]", span.lower())[-1] in DOMAINS else 0
    if kind == CARD:
        return 1 if digits.startswith(ISSUERS) else -1
    if kind == PHONE:
        if span.startswith("+") or span.startswith("00"):
            return 1 if digits.lstrip("0").startswith(CALLING_CODES) else -1
        return 0
    if kind == IBAN:
        return 1 if IBAN_LENGTH.get(span[:2]) == len(span.replace(" ", "")) else -1
    if kind == NAME:
        return 1 if any(w in GIVEN_NAMES for w in span.split()) else 0
    return 0


def _sentinel(kind: int, span: str, digits: str) -> int:
    if kind == NAME:
        return -1 if any(w in NO_NAMES for w in span.split()) else 0
    if kind == IP:
        return -1 if span.startswith(("0.", "127.", "255.")) else 0
    if kind in (CARD, PHONE) and len(digits) > 3:
        steps = {(int(b) - int(a)) % 10 for a, b in zip(digits[1:], digits[2:])}
        return -1 if steps in ({0}, {1}, {9}) else 0
    return 0


def votes(s: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    span = s[start:end]
    digits = _digits(span)
    before = _WORD.findall(s[max(0, start - 40):start].lower())[-4:]
    left, right = s[max(0, start - 2):start], s[end:end + 2]
    inside = left[-1:].isalnum() or right[:1].isalnum() or (kind in (CARD, PHONE) and (
        left[:1].isdigit() and left[-1:] in " -" or right[:1] in " -" and right[1:].isdigit()))
    return (1 if _STRICT[kind].fullmatch(span) else -1,
            _check(kind, span, digits), _listed(kind, span, digits),
            _sentinel(kind, span, digits),
            1 if any(w in CUES[kind] for w in before) else 0,
            -1 if any(w in COUNTER_CUES for w in before) else 0,
            -1 if inside else 0)


def code(vote: tuple[int, ...]) -> int:
    """The votes as one number, base 3."""
    n = 0
    for v in vote:
        n = 3 * n + v + 1
    return n


def decoded(n: int) -> tuple[int, ...]:
    out = []
    for _ in LABELERS:
        n, v = divmod(n, 3)
        out.append(v - 1)
    return tuple(reversed(out))


def _shape(span: str) -> str:
    """Character classes with runs cut to one; at most 24 classes matter."""
    out = []
    for c in span[:200]:
        x = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != x:
            out.append(x)
    return "".join(out[:24])


def features(s: str, kind: int, start: int, end: int, size: int) -> list[int]:
    """Hashed features of a span and its surroundings, for the classifier."""
    span = s[start:end]
    digits = _digits(span)
    before = _WORD.findall(s[max(0, start - 40):start].lower())
    after = _WORD.findall(s[end:end + 40].lower())
    named = ["", f"shape {_shape(span)}", f"length {min(len(span) // 3, 20)}",
             f"digits {min(len(digits), 24)}", f"check {_check(kind, span, digits)}",
             f"listed {_listed(kind, span, digits)}", f"head {span[:2].lower()}",
             f"tail {span[-3:].lower() if kind in (EMAIL, NAME) else ''}",
             f"left {s[start - 1:start]}", f"right {s[end:end + 1]}",
             f"before {before[-1] if before else ''}", f"after {after[0] if after else ''}"]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % size for x in named})
