"""Scalar functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from mnemark import model
from mnemark.functions import states

SPACE = r"[\s\x{A0}\x{FEFF}]"
WRITTEN_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?\z"
# Letters of the Latin blocks that are a base letter with marks, and their base letters, from the Unicode data.
_MARKED = [(c, d[0]) for c in map(chr, range(0xC0, 0x1F00)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
ACCENTED, PLAIN = "".join(c for c, _ in _MARKED), "".join(b for _, b in _MARKED)


def norm_name(c: Column) -> Column:
    """Trimmed of any white space and lower-cased."""
    return F.lower(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""))


def norm_phone(c: Column) -> Column:
    """Digits, without the country code 1 before ten digits."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when(d.rlike(r"^1\d{10}$"), F.substring(d, 2, 10)).otherwise(d)


def name_tokens(c: Column) -> Column:
    return F.split(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+")


def display_name(c: Column) -> Column:
    """A name of exactly three parts without its middle one."""
    t = name_tokens(c)
    return F.when(F.size(t) == 3, F.concat_ws(" ", t[0], t[2])).otherwise(c)


def name_variants(c: Column) -> Column:
    """Normalised forms under which a person is found: the name, and first with last of three parts."""
    t = name_tokens(c)
    return F.array_distinct(F.array_compact(F.array(F.nullif(norm_name(c), F.lit("")), F.when(F.size(t) == 3, F.lower(F.concat_ws(" ", t[0], t[2]))))))


def relation_type(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in model.RELATIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, norm_name(label)), F.lit("custom"))


def hint_confidence(alias_type: Column, supplied: Column) -> Column:
    """1 for emails and phones; for names what was supplied, or 0.7 where that is no sound number, at most 0.9."""
    sound = supplied.isNotNull() & ~F.isnan(supplied) & (supplied >= 0) & (supplied < float("inf"))
    return F.when(alias_type.isin("email", "phone"), 1.0).otherwise(F.least(F.when(sound, supplied).otherwise(model.NAME_CONFIDENCE), F.lit(model.NAME_CAP)))


def utc_date(c: Column) -> Column:
    """Date in UTC of an ISO text, with or without time and offset; null for any other text and for impossible dates."""
    part = lambda i: F.coalesce(F.regexp_extract(c, r"[T ](\d{2}):(\d{2})", i).try_cast("int"), F.lit(0))
    off = lambda i: F.coalesce(F.regexp_extract(c, r"([+-])(\d{2}):(\d{2})$", i).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(c, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    shift = part(1) * 60 + part(2) - F.when(c.rlike(r"\d{2}:\d{2}.*[+-]\d{2}:\d{2}$"), sign * (off(2) * 60 + off(3))).otherwise(0)
    return F.when(c.rlike(WRITTEN_DATE), F.date_add(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), F.floor(shift / 1440).cast("int")))


def search_terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased and without accents, whether these are written as marks of their own or not."""
    return F.regexp_extract_all(F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where either is null, of another length, all zero, or not finite. NaN counts as more than infinity."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0) & (size < float("inf")), 1 - dot(a, b) / size)


def collapse_space(c: Column) -> Column:
    """Runs of blanks to one, none at line ends, at most one empty line, trimmed."""
    c = F.regexp_replace(c, r"[\s\x{A0}&&[^\n]]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def head_tail(c: Column, cap: int) -> Column:
    """A text over cap characters as its first 80 % and last 20 % of cap, with the number left out between."""
    head = int(cap * 0.8)
    tail = cap - head
    cut = F.concat(F.substring(c, 1, head), F.lit("\n[... "), (F.length(c) - head - tail).cast("string"), F.lit(" chars omitted ...]\n"), F.right(c, F.lit(tail)))
    return F.when(F.length(c) <= cap, c).otherwise(cut)


def apple_seconds(c: Column) -> Column:
    """Milliseconds since 1970 of a number counted from 2001, in nanoseconds where it is over 1e12."""
    return F.lit(978_307_200_000) + F.floor(F.when(c > 1e12, c / 1e6).otherwise(c * 1000))


def _instant(y: Column, m: Column, d: Column, hour: Column, minute: Column, second: Column, sign: Column, oh: Column, om: Column) -> Column:
    """Microseconds since 1970 UTC of the parts of a written time, null where one is impossible."""
    n = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))
    local = F.try_make_timestamp_ntz(n(y), n(m), n(d), n(hour), n(minute), n(second).cast("decimal(8,6)"))
    shift = (n(oh) * 60 + n(om)) * F.when(sign == "-", -1).otherwise(1)
    return F.unix_micros(local.cast("timestamp")) - shift.cast("long") * 60_000_000


def pdf_date(c: Column, now_us: Column, first_year: int = 1980) -> Column:
    """Microseconds UTC of a PDF date (D:YYYYMMDDHHmmSS and an offset, Z or none, which is UTC), from first_year on and not after now."""
    p = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:Z|([+-])(\d{2})'?(\d{2})?'?)?\z"
    us = _instant(*(F.regexp_extract(c, p, i) for i in range(1, 10)))
    return F.when(c.rlike(p) & (F.regexp_extract(c, p, 1).try_cast("int") >= first_year) & (us <= now_us), us)


def office_date(c: Column, first_year: int = 1990) -> Column:
    """Microseconds UTC of an office document's date (YYYY-MM-DDTHH:mm:ss and an offset, Z or none, which is UTC), from first_year on."""
    p = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:Z|([+-])(\d{2}):(\d{2}))?\z"
    return F.when(c.rlike(p) & (F.regexp_extract(c, p, 1).try_cast("int") >= first_year), _instant(*(F.regexp_extract(c, p, i) for i in range(1, 10))))


def prompt_line(occurred_at: Column, kind: Column, place: Column, text: Column, clip: int) -> Column:
    """One artifact as a line: its time of day where the text has one, its type, its place, and so many characters of it."""
    return F.concat_ws(" ", F.nullif(F.regexp_extract(occurred_at, r"^\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2})", 1), F.lit("")), kind, F.concat(F.lit("@ "), place), F.substring(text, 1, clip))


def full_place(label: Column) -> Column:
    """"City, ST" with the state's name in place of its code; other labels as they are."""
    code = F.regexp_extract(label, r", ([A-Z]{2})$", 1)
    names = F.create_map(*(F.lit(x) for n, c in states.STATES.items() for x in (c, " ".join(w if w == "of" else w.capitalize() for w in n.split()))))
    name = F.try_element_at(names, code)
    return F.when(name.isNotNull(), F.concat(F.regexp_replace(label, r", [A-Z]{2}$", ", "), name)).otherwise(label)


def redacted_url(c: Column) -> Column:
    """An URL or path without the values of its query, its user and password, and runs of 16 or more hexadecimal digits in its path."""
    c = F.regexp_replace(F.regexp_replace(c, r"//[^/@\s]*@", "//"), r"([?&][^=&\s]+)=[^&\s#]*", "$1=…")
    return F.regexp_replace(c, r"(?i)(?<=/)[0-9a-f]{16,}(?=/|\?|$)", "…")
