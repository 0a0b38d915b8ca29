import gzip
import hashlib

import pytest

from depquarry.llm import warc

SCHEMA = "page_id long, url string, html string"


def read(spark, tmp_path, rows, split=8 << 20):
    files = warc.write_warc(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    return files, {r["page_id"]: r for r in warc.read_warc(files, split).collect()}


@pytest.mark.parametrize("split", [97, 1000, 8 << 20])
def test_round_trip_at_any_split(spark, tmp_path, split):
    big = "é" * 700
    # a payload with gzip magic and a whole gzip file in it, as text and as stored bytes
    odd = gzip.compress(b"WARC/9 no").decode("latin-1") + "\x1f\x8b\x08" * 400
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate([big, "x", None, "", big, odd, big, "x", odd[:900]])]
    _, got = read(spark, tmp_path, rows, split)
    assert len(got) == len(rows)
    for i, _, t in rows:
        raw = (t or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r["refers_to"] == (6 if t == big and i != 6 else None)
        assert r["record_type"] == ("revisit" if t == big and i != 6 else "response")
        assert r["payload"] == (None if r["record_type"] == "revisit" else raw)


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    t = "y" * 1200
    files = warc.write_warc(spark.createDataFrame([(None, None, t), (3, "u r l\r\nX: y", t), (3, "u", t)], SCHEMA), f"file://{tmp_path}/a")
    got = warc.read_warc(files).collect()
    assert sorted((r["page_id"] is None, r["record_type"]) for r in got) == [(False, "response"), (False, "response"), (True, "revisit")]
    assert sorted(r["url"] or "" for r in got) == ["", "u", "u r l\r\nX: y"] and [r["url"] for r in got if r["page_id"] is None] == [None]
    assert read(spark, tmp_path, [])[1] == {}


def test_long_payloads_a_group_of_copies_and_clashing_columns(spark, tmp_path):
    long = "<p>a long one</p>" * 400_000
    copy = "z" * 5000
    rows = [(i, "u", copy) for i in range(700)] + [(1000, "u", long), (1001, "u", long), (1002, "u", None)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", sha1 string, salt int")
    files = warc.write_warc(pages, f"file://{tmp_path}/l")
    got = {r["page_id"]: r for r in warc.read_warc(files, 50_000).collect()}
    assert len(got) == len(rows) and got[1001]["payload"] == long.encode() and got[1000]["refers_to"] == 1001
    assert [i for i in range(700) if got[i]["refers_to"] is None] == [699] and {got[i]["refers_to"] for i in range(699)} == {699}


def test_query_equals_sql(spark, small):
    from compare import duck_rows, rows_of

    from depquarry.llm.oracles import ORACLES
    from depquarry.llm.queries import QUERIES

    for name in sorted(ORACLES):
        assert rows_of(QUERIES[name](spark, small)) == duck_rows(ORACLES[name], small), name
