"""Mixed timestamp formats and zones to one UTC instant.

Each text becomes a mask with 9 for its digits. Each distinct mask is mapped to a parser once per Python worker, which knows where the
fields stand; the texts of one mask are then taken apart together by these positions, and all rows of a batch are converted with numpy
through the zone transition tables of functions/zones.py, of one version on all workers.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemark.functions import zones

# Month names in the languages of the archive.
MONTHS = {
    **dict.fromkeys(("jan", "january", "januar", "jänner", "janvier", "enero", "ene"), 1), **dict.fromkeys(("feb", "february", "februar", "février", "fevrier", "febrero"), 2),
    **dict.fromkeys(("mar", "march", "märz", "maerz", "mär", "mars", "marzo"), 3), **dict.fromkeys(("apr", "april", "avril", "abril", "abr"), 4),
    **dict.fromkeys(("may", "mai", "mayo"), 5), **dict.fromkeys(("jun", "june", "juni", "juin", "junio"), 6), **dict.fromkeys(("jul", "july", "juli", "juillet", "julio"), 7),
    **dict.fromkeys(("aug", "august", "août", "aout", "agosto", "ago"), 8), **dict.fromkeys(("sep", "sept", "september", "septembre", "septiembre"), 9),
    **dict.fromkeys(("oct", "okt", "october", "oktober", "octobre", "octubre"), 10), **dict.fromkeys(("nov", "november", "novembre", "noviembre"), 11),
    **dict.fromkeys(("dec", "dez", "december", "dezember", "décembre", "decembre", "diciembre", "dic"), 12),
}
ZONE = r"(?:\s*(?P<z>[Zz]|[+-]\d\d(?::?\d\d|'\d\d'?)?|[A-Za-z]{2,5}))?(?:\s*\((?P<c>[A-Za-z ]+)\))?(?:\[(?P<i>[A-Za-z_+\-/0-9]+)\])?"
TIME = r"(?P<H>\d{1,2}):(?P<M>\d\d)(?::(?P<S>\d\d)(?:[.,](?P<f>\d+))?)?(?:\s*(?P<p>[AaPp])\.?[Mm]\b\.?)?"
#: Family: the mask's pattern, the text's pattern, and how its date is written.
FAMILIES = [
    ("ymd", r"9999-99-99[a ]9.*", rf"(?P<y>\d{{4}})-(?P<m>\d\d)-(?P<d>\d\d)[Tt ]{TIME}{ZONE}"),
    ("ymd", r"9999:99:99 9.*", rf"(?P<y>\d{{4}}):(?P<m>\d\d):(?P<d>\d\d) {TIME}{ZONE}"),
    ("ymd", r"99999999a999999.*", rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)[Tt](?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d)(?:[.,](?P<f>\d+))?{ZONE}"),
    ("ymd", r"a:99999999999999.*", rf"[Dd]:(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)(?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d){ZONE}"),
    ("ordinal", r"9999-999a9.*", rf"(?P<y>\d{{4}})-(?P<d>\d{{3}})[Tt]{TIME}{ZONE}"),
    ("week", r"9999-a99-9a9.*", rf"(?P<y>\d{{4}})-[Ww](?P<m>\d\d)-(?P<d>\d)[Tt]{TIME}{ZONE}"),
    ("named", r"(?:a, )?99?\.? a 9999.*9.*", rf"(?:[^\W\d_]+, )?(?P<d>\d{{1,2}})\.? (?P<m>[^\W\d_]+)\.? (?P<y>\d{{4}}),? (?:(?:à|um|at) )?(?:(?P<h>\d{{1,2}})h(?P<n>\d\d)|{TIME})(?: Uhr)?{ZONE}"),
    ("named", r"a\.? 99?, 9999.*9.*", rf"(?P<m>[^\W\d_]+)\.? (?P<d>\d{{1,2}}), (?P<y>\d{{4}}),? (?:at )?{TIME}{ZONE}"),
    ("dmy", r"99?\.99?\.99(?:99)? 9.*", rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}|\d\d),? {TIME}{ZONE}"),
    ("slash", r"99?/99?/99(?:99)? 9.*", rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<y>\d{{4}}|\d\d),? {TIME}{ZONE}"),
    ("number", r"9{9,19}(?:\.9+)?", r"(?P<y>\d{9,19})(?:\.(?P<f>\d+))?"),
]
# Digits are 0 to 9 alone, as in the masks.
TEXTS = [re.compile(re.sub(r"(?<!\\W)\\d", "[0-9]", t)) for _, _, t in FAMILIES]
MASKS = [re.compile(m) for _, m, _ in FAMILIES]
LETTERS = re.compile(r"[^\W\d_]+")
US = 1_000_000
TENS = 10 ** np.arange(18, -1, -1, dtype=np.int64)
COUNT_FROM, COUNT_TO = (int(np.datetime64(d, "us").astype(np.int64)) for d in ("2015-01-01", "2027-01-01"))


def shape_mask(text: Column) -> Column:
    """A text with 9 for each digit. Letters stay, so that month names and zones are the mask's own."""
    return F.translate(text, "0123456789", "9999999999")


class Parser:
    """Where in the texts of one mask the fields stand, and what the mask itself tells."""

    def __init__(self, kind: str, m: re.Match) -> None:
        self.kind, self.m, self.width = kind, m, m.end()
        has = lambda g: g in m.re.groupindex and m[g]
        self.at = {g: m.span(g) for g in ("y", "m", "d", "H", "h", "M", "n", "S", "f") if has(g)}
        self.month = MONTHS.get(m["m"].lower(), 0) if kind == "named" else None
        self.half = m["p"].lower() if has("p") else ""
        self.zone, self.zone_at = (m["z"], m.span("z")) if has("z") else ("", None)
        self.area_at = m.span("i") if has("i") else None

    def numbers(self, digits: np.ndarray, *fields: str, first: int | None = None, default: int = 0) -> np.ndarray:
        """The digits of a field as numbers; of a fraction, `first` digits, padded with zeros."""
        span = next((self.at[f] for f in fields if f in self.at), None)
        if span is None:
            return np.full(len(digits), default, dtype=np.int64)
        a, b = span
        b = b if first is None else min(b, a + first)
        v = digits[:, a:b] @ TENS[len(TENS) - (b - a) :]
        # Nineteen digits may be too large: they turn negative.
        return np.where((v < 0) | (v > 2**62), 2**62, v) if first is None else v * 10 ** (first - (b - a))

    def offsets(self, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset of the written zone in microseconds, and whether there is such a zone."""
        n = len(digits)
        if self.zone[0] not in "+-":
            hours = zones.ABBREVIATIONS.get(self.zone.upper())
            return np.full(n, int((hours or 0) * 3600 * US), dtype=np.int64), np.full(n, hours is not None)
        a, _ = self.zone_at
        at = [k + a for k, c in enumerate(self.zone) if c == "9"]
        d = [digits[:, k] for k in at] + [np.zeros(n, dtype=np.int64)] * (4 - len(at))
        h, m = d[0] * 10 + d[1], d[2] * 10 + d[3]
        return (1 if self.zone[0] == "+" else -1) * (h * 60 + m) * 60 * US, (h <= 15) & (m < 60)


@lru_cache(100_000)
def parser(mask: str) -> Parser | None:
    """The parser of a mask: the first family of its shape whose pattern the mask itself fits."""
    shape = LETTERS.sub("a", mask)
    for k, m in enumerate(MASKS):
        if m.fullmatch(shape):
            found = TEXTS[k].fullmatch(mask)
            return Parser(FAMILIES[k][0], found) if found else None
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and whether that date exists."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first, after = ((month + k).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) for k in (0, 1))
    return first + d - 1, ok & (d <= after - first)


def convert(texts: np.ndarray, masks: np.ndarray, tz: np.ndarray, home: np.ndarray, order: np.ndarray, counts_from: np.ndarray, files: dict) -> np.ndarray:
    """One batch, taken apart mask by mask: microseconds UTC as float-free int64, with the least int64 for none."""
    none = np.iinfo(np.int64).min
    out = np.full(len(texts), none, dtype=np.int64)
    local, where, zone = [], [], []
    codes, distinct = pd.factorize(masks)
    by_mask = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[by_mask], np.arange(len(distinct) + 1))
    for k, mask in enumerate(distinct):
        p = parser(mask)
        if p is None:
            continue
        at = by_mask[ends[k] : ends[k + 1]]
        digits = np.array(texts[at], dtype=f"U{p.width}").view(np.uint32).reshape(len(at), p.width).astype(np.int64) - 48
        micros = p.numbers(digits, "f", first=6) if "f" in p.at else np.zeros(len(at), dtype=np.int64)
        if p.kind == "number":
            v, got, sure = p.numbers(digits, "y"), np.full(len(at), none, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
            base = counts_from[at]
            for mul, div in ((US, 1), (1000, 1), (1, 1), (1, 1000)):
                fits = v < (2**62) // mul
                us = np.where(fits, v, 0) * mul // div + base + (micros if mul == US else 0)
                hit = fits & (us >= COUNT_FROM) & (us < COUNT_TO)
                got, sure = np.where(hit, us, got), sure + hit
            out[at] = np.where(sure == 1, got, none)
            continue
        y, d = p.numbers(digits, "y"), p.numbers(digits, "d")
        if p.at["y"][1] - p.at["y"][0] == 2:
            y = y + 2000
        m = np.full(len(at), p.month, dtype=np.int64) if p.kind == "named" else p.numbers(digits, "m", default=1)
        if p.kind == "slash":
            first_month = order[at] == "mdy"
            d, m = np.where(first_month, m, d), np.where(first_month, d, m)
        if p.kind == "ordinal":
            one = np.ones(len(at), dtype=np.int64)
            days, ok = _days(y, one, one)
            days, ok = days + d - 1, ok & (d >= 1) & (d <= _days(y + 1, one, one)[0] - days)
        elif p.kind == "week":
            one = np.ones(len(at), dtype=np.int64)
            monday = lambda y: (j := _days(y, one, one * 4)[0]) - (j + 3) % 7  # noqa: B023, E731
            days = monday(y) + (m - 1) * 7 + d - 1
            ok = (y >= 1) & (m >= 1) & (d >= 1) & (d <= 7) & (days < monday(y + 1))
        else:
            days, ok = _days(y, m, d)
        hour, minute, second = p.numbers(digits, "H", "h"), p.numbers(digits, "M", "n"), p.numbers(digits, "S")
        ok &= ((hour >= 1) & (hour <= 12) if p.half else hour <= 23) & (minute <= 59) & (second <= 59)
        hour = hour % 12 + 12 * (p.half == "p") if p.half else hour
        us = ((days * 24 + hour) * 60 + minute) * 60 * US + second * US + micros
        if p.zone:
            off, known = p.offsets(digits)
            out[at] = np.where(ok & known, us - off, none)
            continue
        if p.area_at:
            area = np.array([t[slice(*p.area_at)] for t in texts[at]], dtype=object)
        else:
            area = np.array([z if z in files else h for z, h in zip(tz[at], home[at])], dtype=object)
        local.append(us[ok]), where.append(at[ok]), zone.append(area[ok])
    if local:
        local, where, zone = np.concatenate(local), np.concatenate(where), np.concatenate(zone)
        codes, names = pd.factorize(zone)
        for k, z in enumerate(names):
            if z in files:
                at = codes == k
                utc, hits = zones.to_utc_us(local[at], zones.transitions(files[z]))
                out[where[at]] = np.where(hits == 1, utc, none)
    return out


def utc_instants(df: DataFrame, text: str, zone: str, home_zone: str, day_order: str, counts_from: str, out: str = "utc_us") -> DataFrame:
    """df with `out`: microseconds since 1970 UTC of the timestamp text, or null where it doesn't fix exactly one instant.

    text: as written. zone, home_zone: IANA names, used in this order where the text has no zone; a name that isn't a zone counts as
    missing. day_order: dmy or mdy for all-numeric dates with slashes. counts_from: day from which bare numbers of nine digits or
    more count. Null, empty, junk, impossible dates, values without date or time of day, local times that are skipped or come twice,
    and a missing home zone where one is needed, give null. All other columns and all rows, repeated ones too, are kept.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((zones.version(), zones.files()))
    inner = "_ts_"
    t = F.regexp_replace(F.col(text), r"^[\s\x{FEFF}\x{A0}]+|[\s\x{A0}]+$", "")
    staged = df.select("*", t.alias(f"{inner}t"), shape_mask(t).alias(f"{inner}m"), F.col(zone).alias(f"{inner}z"), F.col(home_zone).alias(f"{inner}h"), F.col(day_order).alias(f"{inner}o"), F.coalesce(F.unix_date(F.try_to_date(F.col(counts_from))), F.lit(0)).cast("long").alias(f"{inner}c"))

    def run(t: pd.Series, m: pd.Series, z: pd.Series, h: pd.Series, o: pd.Series, c: pd.Series) -> pd.Series:
        us = convert(*(x.to_numpy(dtype=object) for x in (t, m, z, h, o)), c.to_numpy(dtype=np.int64) * 86400 * US, shared.value[1])
        return pd.Series(us, dtype="Int64").mask(us == np.iinfo(np.int64).min)

    udf = F.pandas_udf(run, "long")
    return staged.withColumn(out, udf(*(F.col(f"{inner}{x}") for x in "tmzhoc"))).drop(*(f"{inner}{x}" for x in "tmzhoc"))
