from __future__ import annotations

from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import rows
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.functions import calendar, joins, numbers, spans


def labels(spark, days, expression):
    frame = spark.createDataFrame([(day,) for day in days], "d date")
    return dict(rows(frame.select("d", expression(F.col("d")))))


def monday_first(day: date) -> int:
    iso_year, iso_week, _ = day.isocalendar()
    if iso_year < day.year:
        return 0
    if iso_year > day.year:
        return (day - timedelta(days=7)).isocalendar()[1] + 1
    return iso_week


def every_day(first: int, last: int) -> list[date]:
    start = date(first, 1, 1)
    return [start + timedelta(days=i) for i in range((date(last + 1, 1, 1) - start).days)]


def test_year_week_at_year_ends(spark):
    days = [date(2018, 12, 31), date(2019, 1, 1), date(2021, 1, 1), date(2020, 12, 31), date(2024, 12, 31)]
    got = labels(spark, days, lambda d: calendar.year_week_label(calendar.year_week_number(d)))
    assert got[date(2018, 12, 31)] == "2018-53"
    assert got[date(2019, 1, 1)] == "2019-01"
    assert got[date(2021, 1, 1)] == "2021-00"
    assert got[date(2020, 12, 31)] == "2020-53"
    assert got[date(2024, 12, 31)] == "2024-53"


def test_weeks_of_fifty_years(spark):
    days = every_day(1990, 2039)
    monday = labels(spark, days, calendar.week_monday_first)
    sunday = labels(spark, days, calendar.week_sunday_first)
    assert monday == {day: monday_first(day) for day in days}
    assert sunday == {day: int(day.strftime("%U")) for day in days}


def test_week_span_holds_exactly_the_days_of_the_week():
    for day in every_day(2015, 2026):
        span = spans.week_span(f"{day.year}-{monday_first(day):02d}")
        assert span.start <= day < span.end
        assert monday_first(span.start) == monday_first(span.end - timedelta(days=1)) == monday_first(day)


def test_other_spans():
    assert spans.month_span("2023-12") == spans.DateSpan(date(2023, 12, 1), date(2024, 1, 1))
    assert spans.calendar_span(2024, 2) == spans.DateSpan(date(2024, 2, 1), date(2024, 3, 1))
    assert spans.calendar_span(None, 2) is None
    assert spans.day_span("2024-02-29") == spans.DateSpan(date(2024, 2, 29), date(2024, 3, 1))


def test_seasons_and_holidays(spark):
    days = [date(2023, 11, 30), date(2023, 12, 1), date(2024, 2, 29), date(2024, 3, 1), date(2023, 6, 1)]
    got = labels(spark, days, calendar.season)
    assert [got[day] for day in days] == ["Fall", "Winter", "Winter", "Spring", "Summer"]
    holidays = [date(2022, 12, 25), date(2023, 1, 1), date(2023, 7, 4), date(2023, 7, 5)]
    got = labels(spark, holidays, calendar.holiday_name)
    assert [got[day] for day in holidays] == ["Christmas Day", "New Year's Day", "Independence Day", None]


def test_week_of_month(spark):
    got = labels(spark, every_day(2024, 2024), calendar.week_of_month)
    assert all(week == -(-day.day // 7) for day, week in got.items())


def test_weekday_position_of_unknown_names(spark):
    frame = spark.createDataFrame([("Monday",), ("Sunday",), ("Someday",), (None,)], "w string")
    assert [row[0] for row in rows(frame.select(calendar.weekday_position(F.col("w"))))] == [1, 7, 0, 0]


def test_date_from_parts_rejects_impossible_days(spark):
    frame = spark.createDataFrame([(2021, 2, 30), (2021, 2, 3)], "y int, m int, d int")
    made = frame.select(calendar.date_from_parts(F.col("y"), F.col("m"), F.col("d")))
    assert rows(made) == [(None,), (date(2021, 2, 3),)]


def test_ratio_rounds_half_up_and_divides_by_zero_to_null(spark):
    frame = spark.createDataFrame([(1, 8), (1, 16), (3, 0), (1005, 100000)], "a bigint, b bigint")
    got = rows(frame.select(numbers.exact_ratio(F.col("a"), F.col("b"), 3), numbers.percentage(F.col("a"), F.col("b"))))
    assert [row[0] for row in got] == [Decimal("0.125"), Decimal("0.063"), None, Decimal("0.010")]
    assert got[3][1] == Decimal("1.01")


@settings(max_examples=20, deadline=None)
@for_all(st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 10**6)), min_size=1, max_size=50))
def test_percentage_is_exact(spark, pairs):
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = [row[0] for row in rows(frame.select(numbers.percentage(F.col("a"), F.col("b"))))]
    assert got == [(Decimal(100 * a) / b).quantize(Decimal("0.01"), ROUND_HALF_UP) for a, b in pairs]


@settings(max_examples=20, deadline=None)
@for_all(st.lists(st.integers(-(2**60), 2**60), min_size=1, max_size=50))
def test_sum_of_units_is_exact(spark, units):
    frame = spark.createDataFrame([(unit,) for unit in units], "u bigint")
    assert rows(frame.agg(numbers.sum_of_units(F.col("u"))))[0][0] == Decimal(sum(units)) / 10000


def test_decimals_as_double_keeps_other_columns(spark):
    frame = spark.sql("SELECT CAST(1.10 AS DECIMAL(18,2)) AS a, 'x' AS `b c`, 2 AS d")
    got = numbers.decimals_as_double(frame)
    assert got.dtypes == [("a", "double"), ("b c", "string"), ("d", "int")]
    assert rows(got) == [(1.1, "x", 2)]


@pytest.mark.parametrize("setting, size", [("10MB", 10 << 20), ("1g", 1 << 30), ("512b", 512), ("-1", -1), ("77", 77)])
def test_broadcast_limit(spark, setting, size):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
        assert joins.broadcast_limit(spark.range(1)) == size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
