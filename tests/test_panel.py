import pytest
from dates import day, days
from pyspark.sql import functions as F

from panelshock.operators import audits, baseline, calendar, panel

SCHEMA = "date date, MCT_SGG_CD string, MCT_RY_CD string, TS_AT double"


def october(spark):
    rows = [(d, "r", "x", v) for d, v in zip(days("2025-10-01", 2), (100.0, 200.0))]
    rows += [(day("2025-10-01"), "r", "y", 50.0), (day("2025-11-01"), "r", "x", 300.0), (day("2025-11-01"), "r", "y", 70.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_prepare_panel_keeps_series_with_enough_days(spark):
    out = baseline.prepare_panel(october(spark), minimum_days=2)
    assert out.columns == ["date", "MCT_SGG_CD", "MCT_RY_CD", "TS_AT", "october_mean", "october_n", "Y"]
    rows = out.orderBy("date").collect()
    assert len(rows) == 3 and {r.october_mean for r in rows} == {150.0} and {r.october_n for r in rows} == {2}
    assert rows[-1].Y == pytest.approx(100.0)


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda df: df.where("month(date) <> 10"), "no row at all"),
        (lambda df: df.union(df.limit(1)), "share one key"),
        (lambda df: df.withColumn("TS_AT", F.when(F.col("MCT_RY_CD") == "x", F.col("TS_AT"))), "TS_AT has gaps"),
        (lambda df: df.withColumn("MCT_SGG_CD", F.lit(None).cast("string")), "has gaps"),
        (lambda df: df.withColumn("TS_AT", -F.col("TS_AT")), "zero or below"),
        (lambda df: df.drop("TS_AT"), "missing columns"),
    ],
)
def test_prepare_panel_refuses(spark, change, message):
    with pytest.raises(ValueError, match=message):
        baseline.prepare_panel(change(october(spark)), minimum_days=2)


def test_prepare_panel_refuses_when_nothing_remains(spark):
    with pytest.raises(ValueError, match="too few days"):
        baseline.prepare_panel(october(spark), minimum_days=3)
    with pytest.raises(ValueError, match="at least 1"):
        baseline.prepare_panel(october(spark), minimum_days=0)


def targets(spark):
    rows = []
    for d, flag, split, value in [
        ("2025-07-01", 0, "train", 100.0), ("2025-07-02", 0, "train", 300.0), ("2025-07-03", None, "train", 9999.0),
        ("2025-07-04", 0, "test", 9999.0), ("2025-07-05", 1, "test", 250.0), ("2025-06-01", 0, "train", 9999.0),
        ("2025-06-02", 1, "train", 500.0),
    ]:
        rows.append((day(d), "r", "x", value, flag, None, split))
    return spark.createDataFrame(rows, SCHEMA + ", heatwave int, cold_wave int, split string")


def test_targets_use_train_normal_days_in_season_only(spark):
    out = baseline.add_targets(targets(spark))
    rows = {r.date: r for r in out.collect()}
    assert rows[day("2025-07-05")].baseline_heatwave == 200.0
    assert rows[day("2025-07-05")].Y1_heatwave == 25.0
    assert [d for d, r in rows.items() if r.Y1_heatwave is not None] == [day("2025-07-05")]
    assert baseline.train_baselines(targets(spark), "heatwave").first()["baseline"] == 200.0
    report = {r.hazard: r for r in baseline.target_report(out).collect()}
    assert tuple(report["heatwave"])[1:] == (2, 1, 0, 0) and tuple(report["cold_wave"])[1:] == (0, 0, 0, 0)
    assert baseline.missing_baselines(out, "heatwave").count() == 0


def test_event_without_baseline_is_reported(spark):
    out = baseline.add_targets(targets(spark).where("heatwave = 1"))
    assert baseline.missing_baselines(out, "heatwave").collect() == [("r", "x")]


def series(spark):
    rows = [(d, "r", "x", float(i * i % 17)) for i, d in enumerate(days("2025-01-01", 40)) if i != 20]
    return spark.createDataFrame(rows, SCHEMA)


def test_lags_follow_the_calendar_and_zero_counts(spark):
    rows = {r.date: r for r in calendar.add_calendar_features(series(spark)).collect()}
    all_days = days("2025-01-01", 40)
    value = {d: float(i * i % 17) for i, d in enumerate(all_days) if i != 20}
    for i, d in enumerate(all_days):
        if i == 20:
            continue
        r = rows[d]
        assert r.lag1 == (value.get(all_days[i - 1]) if i >= 1 else None)
        assert r.lag7 == (value.get(all_days[i - 7]) if i >= 7 else None)
        for name, n in (("rolling7", 7), ("rolling28", 28)):
            window = [value.get(x) for x in all_days[max(0, i - n):i]]
            expected = sum(window) / n if len(window) == n and None not in window else None
            assert r[name] == (None if expected is None else pytest.approx(expected))
    assert rows[all_days[7]].rolling7 is not None


def test_lag_audit_finds_planted_errors(spark):
    good = calendar.add_calendar_features(series(spark))
    assert {r.mismatches for r in calendar.audit_calendar_features(good).collect()} == {0}
    first = day("2025-01-01")
    wrong = good.withColumn("lag1", F.when(F.col("date") == first, 0.0).otherwise(F.col("lag1")))
    found = {r.feature: r.mismatches for r in calendar.audit_calendar_features(wrong).collect()}
    assert found == {"lag1": 1, "lag7": 0, "rolling7": 0, "rolling28": 0}


def test_weather_join_keeps_rows_and_marks_matches(spark):
    card = october(spark)
    sky = spark.createDataFrame([(day("2025-10-01"), "r", 1)], "date date, MCT_SGG_CD string, heavy_rain int")
    joined = panel.join_weather(card, sky)
    assert audits.unequal_counts(card, joined).isEmpty()
    assert joined.where(panel.MATCH).count() == 2
    r = panel.match_report(joined, "heavy_rain").first()
    assert (r["rows"], r.matched_rows, r.match_rate, r.event_dates) == (5, 2, 0.4, 1)
    assert {x.date for x in panel.unmatched_keys(card, sky).collect()} == {day("2025-10-02"), day("2025-11-01")}
    doubled = panel.join_weather(card, sky.union(sky))
    assert audits.unequal_counts(card, doubled).collect() == [(5, 7)]


def test_null_regions_are_counted_once(spark):
    card = spark.createDataFrame([(day("2025-10-01"), None, "x", 1.0)], SCHEMA)
    sky = spark.createDataFrame([(day("2025-10-01"), None, 1)], "date date, MCT_SGG_CD string, heavy_rain int")
    assert panel.match_report(panel.join_weather(card, sky), "heavy_rain").first().matched_rows == 0


def test_coverage_and_densify(spark):
    r = panel.coverage_report(series(spark)).first()
    assert (r.dates, r.calendar_days, r.series, r.series_with_missing_dates) == (39, 40, 1, 1)
    dense = panel.densify(series(spark))
    assert dense.count() == 40 and dense.where("TS_AT is null").count() == 1


def test_missing_by_column_and_audits(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "a")], "a int, b string")
    assert {tuple(r) for r in audits.missing_by_column(df, ["a", "b"]).collect()} == {("a", 3, 1), ("b", 3, 2)}
    assert audits.null_rows(df, ["a", "b"]).count() == 2
    assert audits.duplicate_keys(df, ["b"]).collect() == [(None, 2)]
    with pytest.raises(ValueError, match="examples"):
        audits.enforce(audits.null_rows(df, ["a"]), "nulls")
    with pytest.raises(ValueError, match="forbidden"):
        audits.require_allowed_features(["lag1", "rainfall"])
    with pytest.raises(ValueError, match="not in the table"):
        audits.require_allowed_features(["lag1"], ["lag7"])
