import datetime as dt
import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from depquarry.llm import expiring
from depquarry.llm.queries import op13_expiring_clicks

EPOCH = dt.datetime(1970, 1, 1)
micros = lambda t: (t - EPOCH) // dt.timedelta(microseconds=1)


def copies(clicks, batches=10):
    out = []
    for k, ts, arrived, client, kind, value, props in clicks:
        for j in range(k % 3 + 1):
            c = zlib.crc32(f"{k}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            text = "|".join("" if x is None else str(x) for x in (client, kind, None if value is None else int((100 * value + 0.5) // 1), None if ts is None else micros(ts), props, c % 3))
            out.append((hour + c // 10 % 200, k, hour, hashlib.sha256(text.encode()).hexdigest()))
    lo, hi = min(x[0] for x in out), max(x[0] for x in out)
    return [((x[0] - lo) * batches // (hi - lo + 1), *x[1:]) for x in out]


def brute(rows, batches=10, window=48, late=24):
    """rows (batch, click_id, hour, hash): the windows, batch by batch."""
    held, out, newest = {}, [], None
    for b in range(batches):
        mine = sorted(x[1:] for x in rows if x[0] == b)
        for k, hour, h in mine:
            if newest is not None and hour < newest - late:
                continue
            w = held.get(k)
            if w and hour <= w[0] + window:
                w[1] += 1
                if h != w[4]:
                    w[2] += 1
                    w[3] += zlib.crc32(h.encode())
            else:
                if w:
                    out.append((k, w[0], b, *w[1:]))
                held[k] = [hour, 0, 0, 0, h]
        newest = max([newest or -(10**9), *(x[1] for x in mine)]) if mine else newest
        for k in [k for k, w in held.items() if b == batches - 1 or newest is not None and w[0] + window < newest - late]:
            w = held.pop(k)
            out.append((k, w[0], b, *w[1:]))
    return sorted(out)


def plain(df):
    names = "click_id start_hour closed_batch n_repeats n_conflicts conflict_crc hash".split()
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_query_against_brute_force(spark, small):
    got = plain(op13_expiring_clicks(spark, small))
    clicks = spark.read.parquet(f"{small}/clicks.parquet").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").collect()
    want = brute(copies([tuple(r) for r in clicks]))
    assert got == want and len({w[2] for w in want}) == 10


def frame(spark, rows):
    return spark.createDataFrame([(b, k, h, bytearray.fromhex(x) if x else None, 1) for b, k, h, x in rows], "batch int, click_id long, hour long, hash binary, n int")


def test_crowded_ids_ties_nulls_and_gaps_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    digests = [hashlib.sha256(bytes([i])).hexdigest() for i in range(4)] + ["00" * 32, "ff" * 31 + "00"]
    rows = []
    for b in (0, 2, 3):  # batch 1 has no rows
        for _ in range(150):
            rows.append((b, rng.choice([-5, 0, 7, 7, 7, 7, 1 << 40]), -30 + 70 * b + rng.randrange(-60, 70), rng.choice(digests)))
    rows += [rows[0]] * 50 + [(0, 3, 40, digests[0]), (2, 4, 85, digests[1]), (2, 5, 84, digests[1])]
    broken = [(None, 7, 1, digests[0]), (0, None, 1, digests[0]), (0, 7, None, digests[0]), (0, 7, 1, None), (4, 7, 1, digests[0]), (-1, 7, 1, digests[0])]
    want = brute(rows, 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # many chunks a group
    try:
        assert plain(expiring.deduplicate(frame(spark, rows + broken), 4)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark):
    none = spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string")
    assert expiring.deduplicate(expiring.click_copies(none), 10).count() == 0


def test_copies_of_broken_and_very_long_rows(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(5, t, t, None, None, None, None), (5, t, t, None, None, None, None), (8, None, t, 1, "a|b", -0.005, "x" * 1_000_000), (None, t, t, 1, "", 1.0, ""), (4, t, None, 1, "", 1.0, "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch int")
    got = expiring.click_copies(df).select("batch", "click_id", "hour", F.lower(F.hex("hash"))).collect()
    assert sorted(tuple(r) for r in got) == sorted(copies(rows[:3]))
