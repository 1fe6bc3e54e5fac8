"""Numbers with check characters: whether they are valid, and valid pseudonyms of them.

A valid number's body is permuted and its check characters worked out anew, so valid numbers go to valid
ones of the same scheme, one to one. Any other number goes to one that is valid under no scheme. All
spellings of a number (blanks, hyphens, case) have the same pseudonym but for their layout.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from relayscope.llm import pseudonyms

# How long account numbers of a country are.
_LENGTHS = """
AD 24 AT 20 BE 16 BG 22 CH 21 CY 28 CZ 24 DE 22 DK 18 EE 20 ES 24 FI 18 FR 27 GB 22 GR 27 HR 21 HU 28 IE 22 IS 26 IT 27
LI 21 LT 20 LU 20 LV 21 MC 27 MT 31 NL 18 NO 15 PL 28 PT 25 RO 24 SE 24 SI 19 SK 24 SM 27 TR 26
"""
IBAN_LENGTH = {c: int(n) for c, n in zip(_LENGTHS.split()[::2], _LENGTHS.split()[1::2])}
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # a fixed value of the Spanish identity number


def luhn_digit(body: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(body)):
        n = int(ch)
        if i % 2 == 0:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return str(-total % 10)


def iso_11_10_digit(body: str) -> str:
    """ISO 7064, MOD 11,10, as in German tax numbers."""
    product = 10
    for ch in body:
        product = ((int(ch) + product) % 10 or 10) * 2 % 11
    return str((11 - product) % 10)


def iban_digits(country: str, account: str) -> str:
    """ISO 7064, MOD 97-10."""
    number = "".join(str(int(ch, 36)) for ch in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Scheme(NamedTuple):
    name: str
    form: re.Pattern  # with a group ``body``, of a number without blanks and hyphens in capitals
    whole: Callable[[re.Match, str], str]  # the number with another body and its check characters


SCHEMES = (
    Scheme("dni", re.compile(r"(?P<body>[0-9]{8})[A-Z]"), lambda m, b: b + _DNI_LETTERS[int(b) % 23]),
    Scheme("nie", re.compile(r"(?P<first>[XYZ])(?P<body>[0-9]{7})[A-Z]"), lambda m, b: m["first"] + b + _DNI_LETTERS[int(str("XYZ".index(m["first"])) + b) % 23]),
    Scheme("tax", re.compile(r"(?P<body>[0-9]{10})[0-9]"), lambda m, b: b + iso_11_10_digit(b)),
    Scheme("luhn", re.compile(r"(?P<body>[0-9]{9}|[0-9]{12,18})[0-9]"), lambda m, b: b + luhn_digit(b)),
    Scheme("iban", re.compile(r"(?P<country>[A-Z]{2})[0-9]{2}(?P<body>[A-Z0-9]{11,30})"), lambda m, b: m["country"] + iban_digits(m["country"], b) + b),
)
_LAYOUT = re.compile(r"[^0-9A-Za-z]")


def compact(text: str) -> str:
    return _LAYOUT.sub("", text).upper()


def scheme_of(number: str) -> tuple[Scheme, re.Match] | None:
    """The scheme under which a compact number is valid."""
    for scheme in SCHEMES:
        m = scheme.form.fullmatch(number)
        if scheme.name == "iban" and len(number) != IBAN_LENGTH.get(number[:2]):
            continue
        if m and scheme.whole(m, m["body"]) == number:
            return scheme, m
    return None


def pseudonym(text: str, key: bytes) -> str:
    """The pseudonym of a number, laid out as ``text`` is."""
    number = compact(text)
    valid = scheme_of(number)
    if valid:
        scheme, m = valid
        new = scheme.whole(m, pseudonyms.permute_format(m["body"], key, f"id_number {scheme.name}"))
    else:
        new = pseudonyms.permute_format(number, key, "id_number")
        while scheme_of(new):  # going on from there keeps it one to one
            new = pseudonyms.permute_format(new, key, "id_number")
    at = iter(new)
    return "".join((c.lower() if ch.islower() else c) if not _LAYOUT.match(ch) and (c := next(at)) else ch for ch in text)
