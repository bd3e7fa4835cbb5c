from decimal import Decimal

from dates import day
from pyspark.sql import functions as F

from panelshock.functions import parsing
from panelshock.operators import cards

RAW = "TA_YMD string, MCT_SGG_CD string, MCT_RY_CD string, TS_AT string, USE_CNT string"


def raw(spark):
    return spark.createDataFrame(
        [
            ("20250701", " a ", "x", "10.50", "2"),
            ("20250701", "a", "x", " 5 ", "3"),
            ("20250702", "a", "x", "", "1"),
            ("20250702", "a", "x", "7", "1"),
            ("20250703", "a", "x", "abc", "1"),
            ("20250704", "a", "x", "NaN", "0"),
            ("20250705", "a", "x", "1e3", "0"),
            ("20250230", "b", "y", "4.00", ""),
            ("20250706", "  ", "x", "1", "1"),
            ("20250706", "a", None, "1", "1"),
        ],
        RAW,
    )


def test_daily_aggregate_poisons_missing_sums_and_keeps_bad_dates(spark):
    daily = {(r.TA_YMD, r.MCT_SGG_CD): r for r in cards.daily_aggregate(cards.parse_transactions(raw(spark))).collect()}
    assert len(daily) == 6
    first = daily["20250701", "a"]
    assert (first.TS_AT, first.USE_CNT, first.avg_price) == (Decimal("15.5000"), Decimal(5), 3.1)
    assert daily["20250702", "a"].TS_AT is None and daily["20250702", "a"].USE_CNT == 2
    assert daily["20250703", "a"].TS_AT is None and daily["20250703", "a"].avg_price is None
    assert daily["20250705", "a"].TS_AT == 1000 and daily["20250705", "a"].avg_price is None
    assert daily["20250230", "b"].TS_AT == 4


def test_load_report_counts(spark):
    r = cards.load_report(raw(spark)).first()
    assert (r.raw_rows, r.blank_key_rows, r.bad_date_rows, r.repeated_key_rows) == (10, 2, 1, 2)
    assert (r.missing_sales, r.invalid_sales, r.missing_counts, r.invalid_counts) == (3, 2, 1, 0)
    assert (r.zero_counts, r.groups, r.groups_missing_sales, r.groups_missing_counts) == (2, 6, 3, 1)
    assert (r.groups_zero_count, r.groups_without_price) == (2, 5)
    assert (r.min_date, r.max_date, r.regions, r.industries) == (day("2025-07-01"), day("2025-07-05"), 2, 2)


def test_load_report_of_nothing(spark):
    r = cards.load_report(spark.createDataFrame([], RAW)).first()
    assert r.raw_rows == 0 and r.groups == 0 and r.min_date is None


def test_plain_decimal_text(spark):
    df = spark.createDataFrame([("10.5000",), ("100.0000",), ("0.0000",), ("-0.2500",), ("1200.0000",)], "t string")
    text = df.select(parsing.plain_decimal_text(F.col("t").cast("decimal(20,4)")).alias("t")).collect()
    assert [r.t for r in text] == ["10.5", "100", "0", "-0.25", "1200"]
    whole = df.select(parsing.plain_decimal_text(F.col("t").cast("decimal(20,4)").cast("decimal(20,0)")).alias("t"))
    assert [r.t for r in whole.collect()][1::3] == ["100", "1200"]


def test_tolerant_and_strict_parsing(spark):
    df = spark.createDataFrame([("1.5",), ("inf",), ("NaN",), (" 2 ",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parsing.tolerant_double("t")).collect()] == [1.5, None, None, 2.0, None, None]
    bad = spark.createDataFrame([("20250230",)], "t string")
    assert bad.select(parsing.tolerant_date("t")).first()[0] is None
    for strict in (parsing.strict_date("t"), parsing.strict_double(F.lit("x"))):
        try:
            bad.select(strict).collect()
        except Exception:
            continue
        raise AssertionError("a bad value must fail")


def test_numbers_that_do_not_fit_are_counted_and_never_rounded(spark):
    rows = [("20250701", "a", "x", "1.23456", "1"), ("20250702", "a", "x", "12345678901234567", "1"), ("20250703", "a", "x", "0.00004", "1")]
    df = spark.createDataFrame(rows, RAW)
    got = [r.TS_AT for r in cards.parse_transactions(df).orderBy("TA_YMD").collect()]
    assert got == [Decimal("1.23456"), Decimal("12345678901234567"), Decimal("0.00004")]
    narrow = cards.parse_transactions(df, precision=18, scale=4).orderBy("TA_YMD").collect()
    assert [r.TS_AT for r in narrow] == [None] * 3 and [r.TS_AT_unfit for r in narrow] == [True] * 3
    report = cards.load_report(df, precision=18, scale=4).first()
    assert (report.unfit_sales, report.invalid_sales, report.missing_sales) == (3, 0, 3)
