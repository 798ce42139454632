import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetledger.functions.aggregates import aggregate_by_name, distinct_count, row_sum, sum_or_zero
from fleetledger.functions.dates import (
    as_of_dates,
    from_epoch_millis,
    from_epoch_millis_whole_seconds,
    month_end,
    shift_months,
    year_end,
)
from fleetledger.functions.text import (
    any_term,
    as_label,
    count_token,
    first_match,
    lacks_marker,
    normalize_serial,
    strip_contract_suffix,
    strip_literals,
    text_class,
)


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(frame.select("i", expression.alias("x")).collect())]


def test_normalize_serial(spark):
    got = column(spark, ["JEN-12a3", "A_12", "abc", "", None, "_"], normalize_serial("v"))
    assert got == ["123", "A_12", None, None, None, "_"]


def test_strip_contract_suffix(spark):
    got = column(spark, ["1_EXP", "2_EXP3", "3_REP", "4_OLD_EXP6", "5", "6_EXP7", None], strip_contract_suffix("v"))
    assert got == ["1", "2", "3", "4", "5", "67", None]


def test_strip_literals(spark):
    assert column(spark, ["GEJ-JEN-1", "2", None], strip_literals("v", ["GEJ-", "JEN-"])) == ["1", "2", None]


def test_any_term_treats_terms_as_text_and_null_as_unknown(spark):
    assert column(spark, ["A.b", "axb", None], any_term("v", ["a.B"], "lower")) == [True, False, None]
    assert column(spark, ["x"], any_term("v", [])) == [False]
    with pytest.raises(ValueError):
        any_term("v", ["x"], "title")


def test_text_class(spark):
    got = column(spark, ["ab gmbh", "UAB", "fabrik ab", None], text_class("v", ["AB"], ["UAB", "FABRIK"]))
    assert got == [True, False, False, False]


def test_lacks_marker_keeps_missing_text(spark):
    assert column(spark, ["Dummy 1", "1", None], lacks_marker("v", "Dummy")) == [False, True, True]


@pytest.mark.parametrize("filler", [0, 100])
def test_first_match_follows_the_list_order(spark, filler):
    words = ["pie", "apple", *[f"none{i}" for i in range(filler)], "app"]
    assert column(spark, ["apple pie", "apple", "app", "Pie", None], first_match("v", words)) == [
        "pie", "apple", "app", None, None]


def test_count_token(spark):
    assert column(spark, ["a.a.a", "aXa", "", None], count_token("v", "a.")) == [2, 0, 0, None]


def test_labels_of_whole_numbers(spark):
    assert column(spark, [59999.0, 1e7, 0.5, None], as_label("v", "double"), "double") == [
        "59999", "10000000", "0.5", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch_millis_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        millis = [1700000000123, -1500, None]
        assert column(spark, millis, from_epoch_millis("v"), "bigint") == [
            dt.datetime(2023, 11, 14, 22, 13, 20, 123000), dt.datetime(1969, 12, 31, 23, 59, 58, 500000), None]
        assert column(spark, millis, from_epoch_millis_whole_seconds("v"), "bigint") == [
            dt.datetime(2023, 11, 14, 22, 13, 20), dt.datetime(1969, 12, 31, 23, 59, 59), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone if before is None else before)


def test_month_offsets_count_from_the_base_date():
    assert shift_months(dt.date(2024, 3, 31), -1) == dt.date(2024, 2, 29)
    days = as_of_dates(dt.date(2024, 3, 31))
    assert len(days) == 24 and days[0] == dt.date(2022, 3, 31) and days[-1] == dt.date(2024, 2, 29)
    assert days[-2] == dt.date(2024, 1, 31)


def test_period_ends(spark):
    frame = spark.createDataFrame([(2024, 2), (None, 1)], "y int, m int")
    got = frame.select(year_end(F.col("y")), month_end(F.col("y"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 12, 31), dt.date(2024, 2, 29)), (None, None)]


def test_null_rules_of_aggregates(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    got = frame.groupBy("k").agg(
        sum_or_zero("v"), distinct_count("v"), distinct_count("v", False), F.sum(row_sum(["v", F.lit(1)]))
    )
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 2, 1, 3.0), ("b", 0.0, 1, 0, 1.0)]
    assert frame.where("k = 'x'").agg(distinct_count("v")).first()[0] == 0


def test_first_and_last_need_an_order(spark):
    frame = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (4, None)], "o int, v string")
    got = frame.agg(aggregate_by_name("first", "v", ["o"]), aggregate_by_name("last", "v", ["o"])).first()
    assert tuple(got) == ("x", "y")
    with pytest.raises(ValueError):
        aggregate_by_name("first", "v")
    with pytest.raises(ValueError):
        aggregate_by_name("mode", "v")
