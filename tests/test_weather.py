import datetime as dt

import pytest
from dates import day
from pyspark.sql import functions as F

from panelshock.operators import weather
from panelshock.operators.audits import outside_domain

STATIONS = {"S1": "north"}


def heat(spark, flag="O", station=" S1 "):
    row = ("2025-07-01", station, flag, "주의보 ", None, "25.5", "x", "30")
    return spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in weather.HEAT_COLUMNS))


def cold(spark, *levels):
    rows = [(f"2025-11-{i + 1:02d}", "S1", level, " 주의 ", "1", "-2", "3") for i, level in enumerate(levels)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in weather.COLD_COLUMNS))


def test_heat_warning_row(spark):
    r = weather.heat_warnings(heat(spark), STATIONS).first()
    assert (r.MCT_SGG_CD, r.heatwave, r.heat_alert_status, r.heat_impact_forecast) == ("north", 1, "주의보", None)
    assert (r.avg_temp, r.min_temp, r.max_temp) == (25.5, None, 30.0)
    assert weather.heat_warnings(heat(spark, station="S2"), STATIONS).count() == 0


@pytest.mark.parametrize("flag", ["Y", None])
def test_unknown_heat_flag_fails(spark, flag):
    with pytest.raises(Exception, match="unexpected value"):
        weather.heat_warnings(heat(spark, flag), STATIONS).collect()


def test_cold_levels(spark):
    rows = weather.cold_warnings(cold(spark, "X", "주의보", " 경보", None), STATIONS).orderBy("date").collect()
    assert [r.cold_wave for r in rows] == [0, 1, 1, None]
    assert rows[2].cold_alert_status == "경보"
    with pytest.raises(Exception, match="unexpected value"):
        weather.cold_warnings(cold(spark, "?"), STATIONS).collect()


def test_missing_station_is_reported(spark):
    raw = heat(spark, station="S2").withColumn("source_file", F.lit("f"))
    assert weather.missing_stations(raw, STATIONS, "source_file").collect() == [("f", "north")]
    both = {"S2": "north", "S1": "south"}
    assert [r.region for r in weather.missing_stations(raw, both, "source_file").collect()] == ["south"]


def hourly(spark):
    """Three days of station S1 and gaps: a null hour, an absent hour, an absent day."""
    rows = []
    for h in range(24):
        rows.append(("S1", f"2025-07-01 {h:02d}:00", "20" if h >= 22 else "1"))
    for h in range(24):
        if h != 13:
            rows.append(("S1", f"2025-07-02 {h:02d}:00", "20" if h == 0 else "" if h == 5 else "2"))
    for h in range(24):
        rows.append(("S1", f"2025-07-04 {h:02d}:00", "0"))
    rows.append(("other", "2025-07-01 00:00", "99"))
    raw = spark.createDataFrame(rows, "station string, ts string, rain string")
    return weather.hourly_observations(raw, "station", "ts", "rain", STATIONS)


def test_daily_rain_only_for_complete_days(spark):
    rows = {r.date: r for r in weather.daily_rain(hourly(spark)).collect()}
    assert rows[day("2025-07-01")].rainfall == 62.0 and rows[day("2025-07-01")].rainfall_complete == 1
    second = rows[day("2025-07-02")]
    assert (second.rainfall, second.rain_observation_hours, second.rain_valid_hours, second.rainfall_complete) == (None, 23, 22, 0)
    assert day("2025-07-03") not in rows


def test_rolling_exposure_three_states(spark):
    rows = {r.date: r for r in weather.rolling_exposure(hourly(spark)).collect()}
    assert len(rows) == 4
    # 22, 23 and 0 o'clock make exactly 60 and belong to the second day, which is incomplete
    assert rows[day("2025-07-01")].heavy_rain == 0 and rows[day("2025-07-01")].rain_3h_valid_windows == 22
    second = rows[day("2025-07-02")]
    assert (second.heavy_rain, second.rain_3h_max_mm, second.rain_3h_valid_windows) == (1, 60.0, 24 - 3 - 3)
    third = rows[day("2025-07-03")]
    assert (third.heavy_rain, third.rain_3h_max_mm, third.rain_3h_valid_windows) == (None, None, 0)
    assert rows[day("2025-07-04")].heavy_rain == 0


def test_incomplete_day_without_hit_is_unknown(spark):
    rows = {r.date: r for r in weather.rolling_exposure(hourly(spark), threshold=61).collect()}
    assert rows[day("2025-07-02")].heavy_rain is None


def test_daily_weather_spine(spark):
    daily = weather.daily_weather(
        weather.heat_warnings(heat(spark), STATIONS), weather.cold_warnings(cold(spark, "X"), STATIONS), hourly(spark), ["north", "south"]
    )
    assert tuple(daily.columns) == weather.DAILY_COLUMNS
    rows = daily.collect()
    assert len(rows) == 4 * 2
    first = next(r for r in rows if r.date == day("2025-07-01") and r.MCT_SGG_CD == "north")
    assert (first.heatwave, first.cold_wave, first.heavy_rain, first.rainfall) == (1, None, None, 62.0)


def test_rain_thresholds_use_complete_days(spark):
    base = dt.date(2025, 1, 1)
    rows = [("r", base + dt.timedelta(days=i), float(i), 1) for i in range(11)] + [("r", dt.date(2026, 1, 1), None, 0)]
    daily = spark.createDataFrame(rows, "region string, date date, rainfall double, rainfall_complete int")
    r = weather.rain_thresholds(daily).first()
    assert (r.q90, r.q95, r.complete_days, r.days_from_q90, r.days_from_q95) == (9.0, 9.5, 11, 2, 1)


def test_value_domain(spark):
    df = spark.createDataFrame([("O",), (None,), ("Q",), ("Q",)], "f string")
    assert {tuple(r) for r in outside_domain(df, "f", ["O", "X"], False).collect()} == {(None, 1), ("Q", 2)}
    assert {tuple(r) for r in outside_domain(df, "f", ["O", "X"], True).collect()} == {("Q", 2)}
