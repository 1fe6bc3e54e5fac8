"""Format-preserving pseudonyms: a keyed permutation of numbers, letters and dates within their format.

A Feistel network of ten rounds with HMAC-SHA-256 as round function permutes the strings of one length
over one alphabet; the halves add modulo the size of their domain, so the result is again such a string.
Equal values get equal pseudonyms under one key and tweak, different values different ones, and who holds
the key can go back.
"""

from __future__ import annotations

import hashlib
import hmac
from datetime import date, timedelta

_ROUNDS = 10


def _round(key: bytes, tweak: bytes, i: int, value: int, size: int) -> int:
    digest = hmac.new(key, b"%s|%d|%d|%d" % (tweak, i, size, value), hashlib.sha256).digest()
    return int.from_bytes(digest[:16], "big") % size


def _permute(value: int, left: int, right: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A permutation of range(left * right)."""
    a, b = divmod(value, right)
    order = range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS)
    sign = -1 if back else 1
    for i in order:
        if i % 2 == 0:
            a = (a + sign * _round(key, tweak, i, b, left)) % left
        else:
            b = (b + sign * _round(key, tweak, i, a, right)) % right
    return a * right + b


def _halves(n: int, radix: int) -> tuple[int, int]:
    return radix ** (n // 2), radix ** (n - n // 2)


def permute_text(text: str, alphabet: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Permute a string over ``alphabet``; a single character is permuted too, the empty string stays."""
    if not text:
        return text
    radix, n = len(alphabet), len(text)
    value = 0
    for ch in text:
        value = value * radix + alphabet.index(ch)
    left, right = _halves(n, radix)
    value = _permute(value, left, right, key, f"{tweak}|{n}|{radix}".encode(), back)
    out = []
    for _ in range(n):
        value, digit = divmod(value, radix)
        out.append(alphabet[digit])
    return "".join(reversed(out))


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def permute_format(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Permute the digits, and the capital and small letters A to Z, each among themselves; all else stays in place."""
    out = list(text)
    for alphabet in (_DIGITS, _UPPER, _LOWER):
        at = [i for i, ch in enumerate(text) if ch in alphabet]
        new = permute_text("".join(text[i] for i in at), alphabet, key, tweak, back)
        for i, ch in zip(at, new):
            out[i] = ch
    return "".join(out)


_FIRST_DAY, _DAYS = date(1900, 1, 1), 54_787  # to 2049-12-31


def permute_date(day: date, key: bytes, back: bool = False) -> date:
    """Another day between 1900 and 2049; days outside stay."""
    n = (day - _FIRST_DAY).days
    if not 0 <= n < _DAYS:
        return day
    while True:  # cycle walking keeps it a permutation
        n = _permute(n, 256, 256, key, b"date", back)
        if n < _DAYS:
            return _FIRST_DAY + timedelta(days=n)


def tag(value: str, key: bytes, tweak: str, size: int = 16) -> str:
    """A keyed tag that links equal values; there is no way back."""
    return hmac.new(key, f"{tweak}|{value}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()[:size]
