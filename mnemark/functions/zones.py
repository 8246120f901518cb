"""Zone transition tables: UTC instants at which a zone's offset changes, as sorted arrays, with the version of the zone data."""

from __future__ import annotations

import importlib.metadata
import importlib.resources
import re
import struct
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, available_timezones

import numpy as np

# The Gregorian calendar, weekdays included, comes again after 400 years; tables go so far beyond the last written change.
CYCLE_YEARS, CYCLE = 400, 146_097 * 86_400
# Zone abbreviations as mail programs and cameras write them, hours east of UTC. Ambiguous ones are left out.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MET": 1, "MEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10, "BRT": -3, "JST": 9, "KST": 9, "NPT": 5.75, "IST": 5.5, "AWST": 8, "ACST": 9.5, "ACDT": 10.5,
    "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}


def version() -> str:
    for p in TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            if (f := Path(p, name)).is_file():
                return f.open().readline().replace("# version", "").strip()
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


def files() -> dict[str, bytes]:
    """The zone file of each IANA zone: about 600 small files (less than 1 MB), whatever the data."""
    out = {}
    for z in sorted(available_timezones()):
        found = next((f for p in TZPATH if (f := Path(p, z)).is_file()), None)
        if found is None:
            package, _, name = f"tzdata.zoneinfo.{z.replace('/', '.')}".rpartition(".")
            found = importlib.resources.files(package).joinpath(name)
        out[z] = found.read_bytes()
    return out


def _written(data: bytes) -> tuple[np.ndarray, np.ndarray, str]:
    """Instants and offsets in seconds as a zone file (version 2 or later) writes them, and its rule for the time after them."""
    size = lambda h: struct.unpack(">6l", data[h + 20 : h + 44])
    utc, std, leap, times, types, chars = size(0)
    h = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    utc, std, leap, times, types, chars = size(h)
    at = h + 44
    when = np.frombuffer(data, ">i8", times, at).astype(np.int64)
    kind = np.frombuffer(data, "u1", times, at + times * 8)
    offsets = np.array([struct.unpack(">l", data[k : k + 4])[0] for k in range(at + times * 9, at + times * 9 + types * 6, 6)], dtype=np.int64)
    rule = data[at + times * 9 + types * 6 + chars + leap * 12 + std + utc :].strip(b"\n").decode("ascii")
    return np.append(-(2**62), when), np.append(offsets[0], offsets[kind]), rule


RULE = re.compile(r"(?:<[^>]+>|[A-Za-z]+)([+-]?[\d:]+)(?:(?:<[^>]+>|[A-Za-z]+)([+-]?[\d:]+)?,([^,]+),([^,]+))?")


def _seconds(text: str) -> int:
    h, m, s = ([int(x) for x in text.lstrip("+-").split(":")] + [0, 0])[:3]
    return (-1 if text[0] == "-" else 1) * (h * 3600 + m * 60 + s)


def _days(rule: str, years: np.ndarray) -> np.ndarray:
    """Days since 1970 on which a rule's date falls in each year: M month.week.weekday, J day without, or a day with 29 February."""
    first = lambda month: ((years - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    if rule[0] == "M":
        m, w, d = map(int, rule[1:].split("."))
        day = first(m) + (d - (first(m) + 4) % 7) % 7 + (w - 1) * 7
        return np.where(day >= first(m + 1), day - 7, day)
    n = int(rule.lstrip("J"))
    leap = first(3) - first(2) == 29
    return first(1) + (n - 1 + (leap & (n >= 60)) if rule[0] == "J" else n)


@lru_cache(1000)
def transitions(data: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """Offset changes of a zone file: (instants in seconds, offsets in seconds, whether they go on), the first entry holding from before
    all of them, the last ones, where a rule goes on, a whole cycle of the calendar after the last written one."""
    at, offs, rule = _written(data)
    m = RULE.fullmatch(rule)
    if not m or not m[3]:
        return at, offs, False
    std = -_seconds(m[1])
    dst = -_seconds(m[2]) if m[2] else std + 3600
    year = int(np.datetime64(int(max(at[-1], 0)), "s").astype("datetime64[Y]").astype(np.int64)) + 1970
    years = np.arange(year, year + CYCLE_YEARS + 2)
    parts = [(r.split("/") + ["2"])[:2] for r in (m[3], m[4])]
    begin, end = (_days(day, years) * 86_400 + _seconds(time) - before for (day, time), before in zip(parts, (std, dst)))
    when, to = np.concatenate([begin, end]), np.repeat([dst, std], len(years))
    order = np.argsort(when, kind="stable")
    when, to = when[order], to[order]
    return np.append(at, when[when > at[-1]]), np.append(offs, to[when > at[-1]]), True


def to_utc_us(local_us: np.ndarray, tab: tuple[np.ndarray, np.ndarray, bool]) -> tuple[np.ndarray, np.ndarray]:
    """UTC of local times in one zone, and how many instants have that local time (0: skipped, 2: twice)."""
    at, offs, goes_on = tab
    last = (at[-1] - 366 * 86_400) * 1_000_000 if goes_on else 2**62
    cycles = np.where(local_us > last, -((last - local_us) // (CYCLE * 1_000_000)), 0)
    local_us = local_us - cycles * CYCLE * 1_000_000
    begin = np.where(at < -(2**60), -(2**62), at * 1_000_000)
    end = np.append(begin[1:], 2**62)
    first = np.searchsorted(begin, local_us - 26 * 3600 * 1_000_000, side="right") - 1
    hits, utc = np.zeros(len(local_us), dtype=np.int64), np.zeros(len(local_us), dtype=np.int64)
    for k in range(4):
        i = np.minimum(first + k, len(at) - 1)
        u = local_us - offs[i] * 1_000_000
        ok = (u >= begin[i]) & (u < end[i]) & (first + k < len(at))
        hits += ok
        utc = np.where(ok, u, utc)
    return utc + cycles * CYCLE * 1_000_000, hits
