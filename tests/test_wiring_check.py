"""The wiring check on hand-made rows, and the plan it must keep."""

from __future__ import annotations

import datetime as dt
import re

from millrace.plans.wiring_check import summarize, wiring_check
from millrace.sources.tables import read_table

SCHEMA = (
    "l_returnflag string, l_linestatus string, l_quantity double, l_shipdate timestamp_ntz"
)
CUTOFF = dt.datetime(1998, 9, 2)


def rows_of(spark, rows):
    result = summarize(spark.createDataFrame(rows, SCHEMA))
    return {(r.l_returnflag, r.l_linestatus): (r.sum_qty, r.n_rows) for r in result.collect()}


def test_cutoff_is_inclusive_and_to_the_microsecond(spark):
    late = CUTOFF + dt.timedelta(microseconds=1)
    assert rows_of(spark, [("A", "F", 2.0, CUTOFF), ("A", "F", 4.0, late)]) == {
        ("A", "F"): (2.0, 1)
    }


def test_nulls(spark):
    rows = [
        ("A", "F", None, CUTOFF),
        ("A", "F", 3.0, CUTOFF),
        ("R", "F", None, CUTOFF),
        (None, "O", 5.0, CUTOFF),
        ("N", "O", 7.0, None),
    ]
    assert rows_of(spark, rows) == {
        ("A", "F"): (3.0, 2),
        ("R", "F"): (None, 1),
        (None, "O"): (5.0, 1),
    }


def test_no_rows(spark):
    assert rows_of(spark, []) == {}


def test_time_zone_of_the_session_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        results = []
        for zone in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            results.append(
                sorted(map(tuple, wiring_check(spark, "/root/testdata/sf0.01").collect()))
            )
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_quantities_are_whole_so_their_sum_has_no_order(spark):
    lines = read_table(spark, "/root/testdata/sf0.1", "lineitem")
    assert lines.filter("l_quantity <> floor(l_quantity)").count() == 0


def test_plan(spark, capsys):
    wiring_check(spark, "/root/testdata/sf0.01").explain("formatted")
    plan = capsys.readouterr().out
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "LessThanOrEqual(l_shipdate" in pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {
        "l_quantity",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    }
    assert "partial_sum" in plan
    # One "(n) Exchange" heading per exchange: the shuffle of the partial sums.
    assert len(re.findall(r"^\(\d+\) Exchange", plan, flags=re.M)) == 1
    assert "Cartesian" not in plan and "Python" not in plan
