"""Every valid reading of a written time stamp.

A reading is (format, local microseconds since 1970, offset in seconds or None). A stamp with an offset
or a zone abbreviation states an instant by itself; one without needs its writer's zone.
"""

from __future__ import annotations

import re
from datetime import date

# Month names and their usual short forms in English, German, French and Spanish.
_MONTHS = """
1 jan january januar jänner janv janvier ene enero
2 feb february februar févr fév février fevrier febrero
3 mar march mär märz maerz mrz mars marzo
4 apr april avr avril abr abril
5 may mai mayo
6 jun june juni juin junio
7 jul july juli juil juillet julio
8 aug august août aout ago agosto
9 sep sept september septembre septiembre
10 oct october okt oktober octobre octubre
11 nov november novembre noviembre
12 dec december dez dezember déc décembre decembre dic diciembre
"""
MONTHS = {word: int(line.split()[0]) for line in _MONTHS.strip().splitlines() for word in line.split()[1:]}

# Zone abbreviations of the US, Europe, Australia, Japan and South Africa, in hours from UTC.
_ZONES = """
Z 0 UT 0 UTC 0 GMT 0 WET 0 WEST 1 BST 1 IST 1 CET 1 CEST 2 MET 1 MEST 2 EET 2 EEST 3 MSK 3
EST -5 EDT -4 CST -6 CDT -5 MST -7 MDT -6 PST -8 PDT -7 AKST -9 AKDT -8 HST -10 HDT -9
AWST 8 ACST 9.5 ACDT 10.5 AEST 10 AEDT 11 JST 9 SAST 2
"""
ZONES = {name: int(float(hours) * 3600) for name, hours in zip(_ZONES.split()[::2], _ZONES.split()[1::2])}

_CLOCK = r"(\d{1,2})[:hH](\d{2})(?:[:mM](\d{2})(?:[.,](\d+))?)?s?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{1,2}|(?:UTC|GMT)\s*[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5}))?(?:\s*\(([^()]*)\))?"
_NAMED = re.compile(rf"(?:[^\W\d_]+\.?,?\s+)?(\d{{1,2}})\.?[\s-]+([^\W\d_]+)\.?,?[\s-]+(\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_ZONE}")
_ASCTIME = re.compile(rf"(?:[^\W\d_]+\.?,?\s+)?([^\W\d_]+)\.?\s+(\d{{1,2}}),?\s+{_CLOCK}(?:\s+([A-Za-z]{{1,5}}))?\s+(\d{{4}})(?:\s*([+-]\d{{4}}))?")
_YEAR_FIRST = re.compile(rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:T|\s+){_CLOCK}{_ZONE}")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2})?")
_NUMERIC = re.compile(rf"(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_ZONE}")
_DIGITS = re.compile(r"\d{1,20}")
_OFFSET = re.compile(r"(?:UTC|GMT)?\s*([+-])(\d{1,2}):?(\d{2})?", re.I)

#: Bare digits are read in the one unit that puts them between these years.
_EPOCH_FROM, _EPOCH_TO = 631152000 * 10**6, 4102444800 * 10**6
_UNITS = (("epoch_s", 1_000_000, 1), ("epoch_ms", 1_000, 1), ("epoch_us", 1, 1), ("epoch_ns", 1, 1_000))
_EPOCH_DAY = date(1970, 1, 1).toordinal()

Reading = tuple[str, int, "int | None"]


def _offset(zone: str | None, comment: str | None) -> tuple[bool, int | None]:
    """(readable, seconds or None where no zone is written)."""
    if not zone:
        known = ZONES.get((comment or "").strip().upper())
        return True, known
    m = _OFFSET.fullmatch(zone)
    if m:
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 15 or minutes > 59:
            return False, None
        seconds = hours * 3600 + minutes * 60
        return True, -seconds if m[1] == "-" else seconds
    known = ZONES.get(zone.upper())
    return known is not None, known


def _clock(h: str, m: str, s: str | None, frac: str | None, half: str | None) -> int | None:
    hour, minute, second = int(h), int(m), int(s or 0)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half in "pP" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return None
    return (hour * 3600 + minute * 60 + second) * 1_000_000 + int((frac or "0")[:6].ljust(6, "0"))


def _day(y: int, m: int, d: int) -> int | None:
    try:
        return (date(y, m, d).toordinal() - _EPOCH_DAY) * 86_400_000_000
    except ValueError:
        return None


def _year(text: str) -> int:
    return int(text) + (2000 if len(text) == 2 else 0)


def _add(out: list[Reading], name: str, day: int | None, clock: int | None, zone: tuple[bool, int | None]) -> None:
    if day is not None and clock is not None and zone[0]:
        out.append((name, day + clock, zone[1]))


def readings(raw: str | None) -> list[Reading]:
    """All valid readings; none for null, blank, relative, incomplete or impossible stamps."""
    out: list[Reading] = []
    if raw is None:
        return out
    text = raw.strip()
    if m := _NAMED.fullmatch(text):
        month = MONTHS.get(m[2].lower())
        if month:
            _add(out, "named", _day(_year(m[3]), month, int(m[1])), _clock(m[4], m[5], m[6], m[7], m[8]), _offset(m[9], m[10]))
    elif m := _YEAR_FIRST.fullmatch(text):
        _add(out, "year_first", _day(int(m[1]), int(m[3]), int(m[4])), _clock(m[5], m[6], m[7], m[8], m[9]), _offset(m[10], m[11]))
    elif m := _NUMERIC.fullmatch(text):
        clock, zone, year = _clock(m[5], m[6], m[7], m[8], m[9]), _offset(m[10], m[11]), _year(m[4])
        _add(out, "DMY", _day(year, int(m[3]), int(m[1])), clock, zone)
        _add(out, "MDY", _day(year, int(m[1]), int(m[3])), clock, zone)
        if len(m[1]) == 2 and len(m[4]) == 2:
            _add(out, "YMD", _day(_year(m[1]), int(m[3]), int(m[4])), clock, zone)
    elif m := _ASCTIME.fullmatch(text):
        month = MONTHS.get(m[1].lower())
        if month:
            _add(out, "asctime", _day(int(m[9]), month, int(m[2])), _clock(m[3], m[4], m[5], m[6], m[7]), _offset(m[10] or m[8], None))
    elif m := _COMPACT.fullmatch(text):
        _add(out, "compact", _day(int(m[1]), int(m[2]), int(m[3])), _clock(m[4], m[5], m[6], m[7], None), _offset(m[8], None))
    elif _DIGITS.fullmatch(text):
        number = int(text)
        for name, times, over in _UNITS:
            micros = number * times // over
            if _EPOCH_FROM <= micros < _EPOCH_TO:
                out.append((name, micros, 0))
    return out
