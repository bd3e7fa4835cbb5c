import pytest
from dates import day

from panelshock.operators import flow

SCHEMA = "STD_YM string, BLOCK_CD string, " + ", ".join(f"{c} string" for c in flow.FLOW_COLUMNS) + ", f string"
PREFIXES = {"11111": "a", "22222": "b"}


def rows(spark, extra=()):
    week = [str(v) for v in range(1, 8)]
    data = [
        ("202507", "1111100", *week, "jul"),
        ("202507", "1111101", *week, "jul"),
        ("202507", "2222200", *week, "jul"),
        ("202508", "1111100", *week, "aug"),
        ("202508", "3333300", *week, "aug"),
        ("202508", None, *week, "aug"),
        *extra,
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_profile_sums_mapped_blocks(spark):
    profile = flow.flow_profile(flow.mapped_flow(rows(spark), PREFIXES))
    got = {(r.region, r.month, r.weekday): r.flow_pop_weekday for r in profile.collect()}
    assert len(got) == 3 * 7
    assert got["a", 7, 0] == 2.0 and got["a", 7, 6] == 14.0 and got["b", 7, 6] == 7.0 and got["a", 8, 2] == 3.0
    assert flow.profile_collisions(profile).isEmpty()


def test_unknown_prefixes_skip_nulls(spark):
    assert [r.prefix for r in flow.unknown_prefixes(rows(spark), PREFIXES).collect()] == ["33333"]


def test_coverage(spark):
    got = {r.f: r for r in flow.flow_coverage(flow.mapped_flow(rows(spark), PREFIXES), "f").collect()}
    assert (got["jul"].matched_rows, got["jul"].matched_blocks, got["jul"].prefixes) == (3, 3, "11111|22222")
    assert got["aug"].matched_rows == 1


def test_bad_and_repeated_rows_are_found(spark):
    bad = ("202508", "1111102", "x", *["1"] * 6, "aug")
    twice = ("202507", "1111100", *[str(v) for v in range(1, 8)], "jul")
    mapped = flow.mapped_flow(rows(spark, [bad, twice]), PREFIXES)
    assert flow.flow_problems(mapped, "f").collect() == [("aug", 1)]
    assert flow.repeated_flow_rows(mapped, "f").collect() == [("jul", 1)]


def test_years_collide_unless_they_are_a_key(spark):
    next_year = ("202607", "1111100", *["1"] * 7, "later")
    mapped = flow.mapped_flow(rows(spark, [next_year]), PREFIXES)
    assert flow.profile_collisions(flow.flow_profile(mapped)).count() == 7
    assert flow.profile_collisions(flow.flow_profile(mapped, by_year=True)).isEmpty()


@pytest.mark.parametrize("by_year", [False, True])
def test_join_keeps_unmatched_rows(spark, by_year):
    profile = flow.flow_profile(flow.mapped_flow(rows(spark), PREFIXES), by_year)
    panel = spark.createDataFrame(
        [(day("2025-07-07"), "a", "x", 1.0), (day("2025-09-01"), "a", "x", 1.0)], "date date, MCT_SGG_CD string, MCT_RY_CD string, TS_AT double"
    )
    got = {r.date: r.flow_pop_weekday for r in flow.join_flow(panel, profile).collect()}
    assert got == {day("2025-07-07"): 2.0, day("2025-09-01"): None}


def test_join_keeps_columns_of_the_panel(spark):
    from panelshock.spec import PanelSpec

    profile = flow.flow_profile(flow.mapped_flow(rows(spark), PREFIXES), by_year=True)
    region = next(iter(PREFIXES.values()))
    panel = spark.createDataFrame([(region, "kept", 7)], "region string, year string, other int").selectExpr("*", "date'2025-07-01' AS date")
    out = flow.join_flow(panel, profile, PanelSpec(region="region"))
    assert {"region", "year", "other", "month", "weekday", "flow_pop_weekday"} <= set(out.columns)
    assert (out.first()["region"], out.first()["year"]) == (region, "kept")
