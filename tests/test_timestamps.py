from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
from hypothesis import given, settings, strategies as st

from mnemark.functions import zones
from mnemark.operators import timestamps

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
us = lambda d: (d - EPOCH) // timedelta(microseconds=1)
COLUMNS = "id long, t string, tz string, home string, ord string, cf string, utc_us string, extra int"


def run(spark, rows):
    df = spark.createDataFrame([(i, t, z, h, o, c, "old", 1) for i, (t, z, h, o, c) in enumerate(rows)], COLUMNS)
    out = timestamps.utc_instants(df, "t", "tz", "home", "ord", "cf").orderBy("id").collect()
    assert len(out) == len(rows)
    return [r.utc_us for r in out]


def test_formats_and_zones(spark):
    ny, ist = "America/New_York", "Asia/Kolkata"
    at = lambda y, m, d, H=0, M=0, S=0, f=0, z=timezone.utc: us(datetime(y, m, d, H, M, S, f, tzinfo=z))
    cases = [
        ("2024-05-06T07:08:09.1234567Z", at(2024, 5, 6, 7, 8, 9, 123456)), ("2024-05-06t07:08:09z", at(2024, 5, 6, 7, 8, 9)), (" 2024-05-06 07:08:09+05:30\n", at(2024, 5, 6, 1, 38, 9)),
        ("2024-W19-1T07:08:09Z", at(2024, 5, 6, 7, 8, 9)), ("2024-127T07:08:09Z", at(2024, 5, 6, 7, 8, 9)), ("20240506T070809Z", at(2024, 5, 6, 7, 8, 9)), ("D:20240506070809-04'00'", at(2024, 5, 6, 11, 8, 9)),
        ("2024:05:06 07:08:09", at(2024, 5, 6, 11, 8, 9)), ("Mon, 6 May 2024 07:08:09 -0400 (EDT)", at(2024, 5, 6, 11, 8, 9)), ("6. Mai 2024, 07:08 Uhr", at(2024, 5, 6, 11, 8)), ("6 mai 2024 à 7h08", at(2024, 5, 6, 11, 8)),
        ("May 6, 2024 12:08:09 AM", at(2024, 5, 6, 4, 8, 9)), ("May 6, 2024 12:08 PM PDT", at(2024, 5, 6, 19, 8)), ("5/6/2024 7:08 a.m.", at(2024, 5, 6, 11, 8)), ("06.05.24 07:08", at(2024, 5, 6, 11, 8)),
        ("2024-05-06T07:08:09-07:00[America/Phoenix]", at(2024, 5, 6, 14, 8, 9)), ("1715000000", 1715000000 * 10**6), ("1715000000.25", 1715000000 * 10**6 + 250000), ("1715000000123", 1715000000123 * 1000), ("1715000000123456789", 1715000000123456),
        ("2024-03-10 02:30:00", None), ("2024-11-03 01:30:00", None), ("2024-02-30 10:00:00", None), ("2024-05-06", None), ("07:08", None), ("unknown", None), ("", None), (None, None), ("May 2024", None), ("12345", None), ("2024-05-06T25:00:00Z", None), ("13/13/2024 07:08", None), ("x" * 100_000, None),
    ]
    assert run(spark, [(t, None, ny, "mdy", "1970-01-01") for t, _ in cases]) == [w for _, w in cases]
    assert run(spark, [("05/06/2024 07:08", ist, ny, "dmy", "1970-01-01"), ("05/06/2024 07:08", "Mars/Base", ist, "mdy", "1970-01-01"), ("2024-05-06 07:08:09", None, None, None, None), ("736300000", None, ny, "mdy", "2001-01-01")]) == [
        us(datetime(2024, 6, 5, 7, 8, tzinfo=ZoneInfo(ist))), us(datetime(2024, 5, 6, 7, 8, tzinfo=ZoneInfo(ist))), None, us(datetime(2001, 1, 1, tzinfo=timezone.utc)) + 736300000 * 10**6]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    assert run(spark, [("2024-05-06T07:08:09Z", None, None, None, None)] * 3) == [us(datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc))] * 3


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1850, 1, 1), datetime(9990, 1, 1)) | st.datetimes(datetime(2014, 1, 1), datetime(2027, 1, 1)), st.sampled_from(["America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "America/St_Johns", "Europe/London", "America/Sao_Paulo", "Africa/Casablanca", "Europe/Dublin", "America/Asuncion", "Asia/Samarkand"]))
def test_local_times_against_zoneinfo(local, name):
    z = ZoneInfo(name)
    found = {us(local.replace(tzinfo=z, fold=f).astimezone(timezone.utc)) for f in (0, 1) if local.replace(tzinfo=z, fold=f).astimezone(timezone.utc).astimezone(z).replace(tzinfo=None) == local}
    utc, hits = zones.to_utc_us(np.array([us(local.replace(tzinfo=timezone.utc))]), zones.transitions(zones.files()[name]))
    assert hits[0] == len(found)
    if len(found) == 1:
        assert utc[0] in found


def test_years_far_off(spark):
    cases = [("2045-07-01 12:00:00", "Europe/Berlin", datetime(2045, 7, 1, 10)), ("1965-07-01 12:00:00", "America/New_York", datetime(1965, 7, 1, 16)), ("1945-07-01 12:00:00", "Europe/Berlin", datetime(1945, 7, 1, 9)), ("9000-07-01 12:00:00", "Europe/Berlin", datetime(9000, 7, 1, 10))]
    assert run(spark, [(t, None, z, "dmy", None) for t, z, _ in cases]) == [us(w.replace(tzinfo=timezone.utc)) for _, _, w in cases]


def test_digits_of_other_scripts_and_words_between(spark):
    rows = ["٢٠٢٤-05-06T07:08:09Z", "2024-05-06T07:08:09+05", "2024-05-06 07:08:09 XYZ", "9999999999999999999", "2024-05-06T07:08:09[Etc/GMT+5]", "2024-05-06T07:08:09+16:00", "2024-05-06T07:08:09.5Z"]
    base = us(datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc))
    assert run(spark, [(t, None, "UTC", "dmy", None) for t in rows]) == [None, base - 5 * 3600 * 10**6, None, None, base + 5 * 3600 * 10**6, None, base + 500_000]
