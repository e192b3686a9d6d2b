import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from quillstream.operators.instants import candidate_zones, estimate_zones, normalise, normalised_tables, parse_text


def us(*a, tz="UTC"):
    return int(dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(tz)).timestamp() * 1_000_000)


CASES = [
    ("2024-01-09T04:29:21.923Z", None, us(2024, 1, 9, 4, 29, 21) + 923_000),
    ("2024-07-06T02:08:50.875526381Z", None, us(2024, 7, 6, 2, 8, 50) + 875_526),
    ("2024-02-19T02:46:55+09:00", None, us(2024, 2, 18, 17, 46, 55)),
    ("2025-03-17T08:51:33+01", None, us(2025, 3, 17, 7, 51, 33)),
    ("2024-07-05 23:58:11,542 -0300", None, us(2024, 7, 6, 2, 58, 11) + 542_000),
    ("1716936274857", None, 1716936274857000), ("1711567556", "Asia/Seoul", 1711567556000000), ("1705461408451370", None, 1705461408451370), ("1709062262.330", None, 1709062262330000),
    ("2024년 2월 20일 오후 5:33:32", "Asia/Seoul", us(2024, 2, 20, 17, 33, 32, tz="Asia/Seoul")), ("2024년 8월 17일 오전 12:00:01", "Asia/Seoul", us(2024, 8, 17, 0, 0, 1, tz="Asia/Seoul")),
    ("20240127 004828", "UTC", us(2024, 1, 27, 0, 48, 28)), ("20240116T125459Z", None, us(2024, 1, 16, 12, 54, 59)),
    ("Fri, 20 Dec 2024 05:13:42 +0900", None, us(2024, 12, 19, 20, 13, 42)), ("15. August 2024, 21:39:10 Uhr", "Europe/Berlin", us(2024, 8, 15, 19, 39, 10)), ("17. März 2025, 09:32:27 Uhr", "Europe/Berlin", us(2025, 3, 17, 8, 32, 27)),
    ("16.01.2024 13:02", "UTC", us(2024, 1, 16, 13, 2)), ("Sep 11, 2024 3:58:36 AM", "UTC", us(2024, 9, 11, 3, 58, 36)), ("July 17, 2024 12:04:28 PM", "UTC", us(2024, 7, 17, 12, 4, 28)),
    ("Sun Mar 29 11:35:45 PDT 2026", None, us(2026, 3, 29, 18, 35, 45)), ("Sat Nov  9 11:27:29 KST 2024", None, us(2024, 11, 9, 2, 27, 29)), ("2025-04-21 12:14:19 KST", None, us(2025, 4, 21, 3, 14, 19)),
    ("2024-01-16 13:19:33 Europe/London", None, us(2024, 1, 16, 13, 19, 33)), ("2024-07-05T23:57:28-03:00[America/Sao_Paulo]", None, us(2024, 7, 6, 2, 57, 28)), ("2025-09-04T13:02:35+00:00[UTC]", None, us(2025, 9, 4, 13, 2, 35)),
    ("2024-05-12T01:04Z", None, us(2024, 5, 12, 1, 4)), (" 2025-05-19 03:59:48Z\n", None, us(2025, 5, 19, 3, 59, 48)), ("2025/01/19 19:07:52", "UTC", us(2025, 1, 19, 19, 7, 52)),
    # twice: the earlier instant; skipped: the offset before the change
    ("2024-11-03 01:30:00", "America/New_York", us(2024, 11, 3, 5, 30)), ("2024-03-31 02:30:00", "Europe/Berlin", us(2024, 3, 31, 1, 30)),
    ("2024-02-28T19:02:43", None, None), ("2025-02-30T10:00:00Z", None, None), ("2025-04-07T25:10:00Z", None, None), ("2025-13-01T00:00:00Z", None, None), ("0000-00-00 00:00:00", "UTC", None), ("2024-11-05", "UTC", None), ("10:42:07", "UTC", None),
    ("T12:00:00Z", None, None), ("yesterday", "UTC", None), ("n/a", "UTC", None), ("", "UTC", None), (" ", "UTC", None), (None, "UTC", None), ("2024-01-01 10:00:00 XYZ", "UTC", None), ("2024-01-01 10:00:00 No/Where", "UTC", None), ("2024-01-01T10:00:00+29:00", "UTC", None),
    ("x" * 100_000, "UTC", None), ("9" * 40, "UTC", None), ("3:61 PM", "UTC", None), ("2024년 2월 20일 오후 15:33:32", "Asia/Seoul", None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string")
    got = {r.i: r.__utc_us if False else r["__utc_us"] for r in parse_text(df, "t", "z").collect()}
    for i, (text, zone, want) in enumerate(CASES):
        assert got[i] == want, (text[:40] if text else text, zone, got[i], want)


def test_normalise_keeps_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", "m", "zone!"), (1, "2024-01-01 10:00:00", "m", "zone!"), (2, "2024-01-01 10:00:00", None, None), (3, None, "m", None)], "id int, said string, machine string, zone string")
    machines = spark.createDataFrame([("m", "Asia/Seoul"), ("m", "Asia/Seoul"), ("o", None)], "machine string, zone string")
    got = sorted((tuple(r) for r in normalise(df, "said", "machine", machines).select("id", "zone", "utc_us", "zone_source").collect()), key=repr)
    want = us(2024, 1, 1, 1)
    assert got == sorted([(1, "zone!", want, "machine")] * 2 + [(2, None, None, None), (3, None, None, None)], key=repr)
    assert normalise(df.limit(0), "said", "machine", machines).count() == 0


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney"])
def test_zone_is_estimated_over_a_change_of_offset(spark, zone):
    z = zoneinfo.ZoneInfo(zone)
    rows = []
    for i in range(400):
        t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=21.3 * i)
        local = t.astimezone(z).replace(tzinfo=dt.timezone.utc)
        late = dt.timedelta(seconds=40) if i % 3 else dt.timedelta(hours=i % 50, minutes=7)
        rows.append(("m", int(local.timestamp() * 1e6), int((t + late).timestamp() * 1e6)))
    rows += [(None, 1, 2), ("m", None, 2), ("m", 1, None)]
    best = estimate_zones(spark.createDataFrame(rows, "m string, l long, i long"), "m", "l", "i", candidate_zones()).collect()
    assert len(best) == 1 and best[0].violations == 0
    found = zoneinfo.ZoneInfo(best[0].zone)
    days = [dt.datetime(2024, m, 15, tzinfo=dt.timezone.utc) for m in range(1, 13)]
    assert [d.astimezone(found).utcoffset() for d in days] == [d.astimezone(z).utcoffset() for d in days]


def test_held_out_zones_of_the_data(spark, data):
    parsed = parse_text(spark.read.parquet(f"{data}/turns.parquet"), "timestamp").where("__stated = 'wall'")
    best = estimate_zones(parsed.select("machine", "__local_us", F.unix_micros("ingested_at").alias("i")), "machine", "__local_us", "i", candidate_zones())
    known = {r.machine: r.zone for r in spark.read.parquet(f"{data}/machines.parquet").collect() if r.zone}
    wall = [r for r in best.collect() if r.machine in known and r.n >= 30]
    assert wall
    right = sum(zoneinfo.ZoneInfo(r.zone).utcoffset(dt.datetime(2024, 2, 1)) == zoneinfo.ZoneInfo(known[r.machine]).utcoffset(dt.datetime(2024, 2, 1)) for r in wall)
    assert right >= 0.9 * len(wall)


def test_cursors_are_read_under_the_zones_of_the_turns(spark, data):
    from quillstream.plans.hygiene import p2_normalised

    got = p2_normalised(spark, data)
    cursors = spark.read.parquet(f"{data}/harvest_cursors.parquet")
    assert got.where("tab = 'harvest_cursors'").select("rec_id").distinct().count() == cursors.select("cursor_id").distinct().count()
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    told = [start + dt.timedelta(hours=7 * i) for i in range(60)]
    local = [t.astimezone(zoneinfo.ZoneInfo("Asia/Kathmandu")) for t in told]
    turns = spark.createDataFrame([(i, x.strftime("%Y-%m-%d %H:%M:%S"), "m", t + dt.timedelta(seconds=40)) for i, (x, t) in enumerate(zip(local, told))], "turn_id long, timestamp string, machine string, ingested_at timestamp")
    cursors = spark.createDataFrame([(1, "2024-01-05 12:00:00", "m"), (2, "2024-01-05 12:00:00", "other"), (3, "2024-01-05T12:00:00Z", "m"), (4, None, "m")], "cursor_id long, last_scan string, machine string")
    machines = spark.createDataFrame([("m", None)], "machine string, zone string")
    out = {r.rec_id: (r.utc_us, r.zone_source) for r in normalised_tables(turns, cursors, machines).where("tab = 'harvest_cursors'").collect()}
    assert out == {1: (us(2024, 1, 5, 6, 15), "estimated"), 2: (None, None), 3: (us(2024, 1, 5, 12), "offset"), 4: (None, None)}
