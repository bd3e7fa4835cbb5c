import itertools

import numpy as np
import pytest
from dates import day, days
from pyspark.sql import functions as F

from panelshock.operators import episodes, splits
from panelshock.spec import RATIOS, SPLITS

FLAGS = "date date, MCT_SGG_CD string, heatwave int, cold_wave int"


def flags(spark):
    """Six weeks from Monday 2025-07-07 in two regions."""
    hot = {
        "a": {"2025-07-08", "2025-07-13", "2025-07-14", "2025-07-28", "2025-07-29", "2025-07-30"},
        "b": {f"2025-07-{d}" for d in range(20, 30)},
    }
    unknown = {("a", "2025-07-29")}
    rows = []
    for d in days("2025-07-07", 42):
        for region in "ab":
            text = d.isoformat()
            flag = None if (region, text) in unknown else int(text in hot[region])
            rows.append((d, region, flag, 0))
    return spark.createDataFrame(rows, FLAGS)


def test_runs_break_at_null_flags_and_restart_numbers(spark):
    found = episodes.weeks_text(episodes.find_episodes(flags(spark))).orderBy("region", "start_date").collect()
    assert [(r.episode_id, r.days, r.weeks) for r in found] == [
        ("heatwave|a|20250708|01", 1, "2025-07-07"),
        ("heatwave|a|20250713|02", 2, "2025-07-07|2025-07-14"),
        ("heatwave|a|20250728|03", 1, "2025-07-28"),
        ("heatwave|a|20250730|04", 1, "2025-07-28"),
        ("heatwave|b|20250720|01", 10, "2025-07-14|2025-07-21|2025-07-28"),
    ]


def test_observation_gap_breaks_a_run(spark):
    gappy = flags(spark).where("not (MCT_SGG_CD = 'b' and date = date'2025-07-24')")
    found = episodes.find_episodes(gappy).where("region = 'b'")
    assert sorted(r.days for r in found.collect()) == [4, 5]


def test_components_merge_weeks_an_episode_spans(spark):
    found = episodes.find_episodes(flags(spark))
    table = episodes.week_components(flags(spark), found)
    by_week = {r.week: (r.component_no, r.component) for r in table.collect()}
    assert [by_week[w][0] for w in sorted(by_week)] == [1, 1, 1, 1, 2, 3]
    assert by_week[day("2025-08-11")] == (3, "G03")
    stats = {r.component_no: r for r in episodes.component_stats(table, flags(spark)).collect()}
    assert (stats[1].weeks, stats[1].dates, stats[1].heatwave, stats[1].cold_wave) == (4, 28, 14, 0)
    assert stats[2].heatwave == 0


def test_flags_fold_and_conflicts_show(spark):
    panel = flags(spark).withColumn("MCT_RY_CD", F.explode(F.array(F.lit("x"), F.lit("y"))))
    assert episodes.flag_conflicts(panel).isEmpty()
    assert episodes.daily_flags(panel).exceptAll(flags(spark)).isEmpty()
    odd = panel.withColumn(
        "heatwave", F.when((F.col("MCT_RY_CD") == "y") & (F.col("date") == day("2025-07-08")), 1 - F.col("heatwave")).otherwise(F.col("heatwave"))
    )
    assert episodes.flag_conflicts(odd).count() == 2


def test_episode_days_attach(spark):
    found = episodes.find_episodes(flags(spark))
    assert episodes.overlapping_episodes(found).isEmpty()
    rows = spark.createDataFrame(
        [("heatwave", "b", day("2025-07-25")), ("cold_wave", "b", day("2025-07-25")), ("heatwave", "a", day("2025-07-25"))],
        "disaster_type string, region string, date date",
    )
    got = [r.episode_id for r in episodes.attach_episode(rows, found).collect()]
    assert sorted(x or "" for x in got) == ["", "", "heatwave|b|20250720|01"]


def score(sizes, split):
    total = sizes.sum(axis=0)
    value = 0.0
    for k, name in enumerate(SPLITS):
        cell = sizes[[i for i, s in enumerate(split) if s == k]].sum(axis=0)
        off = (cell / np.maximum(total, 1) - RATIOS[name]) ** 2
        value += 4 * off[0] + 2 * off[1:].sum() + 100 * (cell[1:] == 0).sum()
    return value


def test_score_and_search_against_every_assignment(spark):
    sizes = np.array([[7, 4, 0], [7, 0, 2], [14, 3, 1], [7, 1, 1], [7, 2, 3], [21, 2, 2], [7, 3, 1]], float)
    components = spark.createDataFrame(
        [(i + 1, *[int(v) for v in row]) for i, row in enumerate(sizes)], "component_no int, dates long, heatwave long, cold_wave long"
    )
    scores = {c: score(sizes, c) for c in itertools.product(range(3), repeat=len(sizes))}
    some = list(scores)[::157]
    rows = [(n, i + 1, SPLITS[s]) for n, c in enumerate(some) for i, s in enumerate(c)]
    assigned = spark.createDataFrame(rows, "candidate int, component_no int, split string")
    for r in splits.score_assignments(components, assigned).collect():
        assert r.score == pytest.approx(scores[some[r.candidate]])
    best = splits.search_split(spark, components, restarts=48).collect()
    assert {r.component_no for r in best} == set(range(1, 8))
    assert best[0].score == pytest.approx(min(scores.values()))
    again = splits.search_split(spark, components, restarts=48, tasks=3).collect()
    assert sorted(best) == sorted(again)


def test_search_needs_three_components(spark):
    two = spark.createDataFrame([(1, 7, 1, 1), (2, 7, 1, 1)], "component_no int, dates long, heatwave long, cold_wave long")
    with pytest.raises(ValueError, match="three"):
        splits.search_split(spark, two)


def test_leaks_are_found(spark):
    table = episodes.week_components(flags(spark), episodes.find_episodes(flags(spark)))
    found = episodes.find_episodes(flags(spark))
    clean = table.withColumn("split", F.when(F.col("component_no") == 1, "train").otherwise("test"))
    rows = splits.attach_split(flags(spark), clean)
    assert splits.split_leaks(rows).isEmpty() and splits.episode_leaks(rows, found).isEmpty()
    torn = table.withColumn("split", F.when(F.col("date") < day("2025-07-24"), "train").otherwise("test"))
    rows = splits.attach_split(flags(spark), torn)
    assert {(r.field, r.value) for r in splits.split_leaks(rows).collect()} == {("week", "2025-07-21"), ("component", "G01")}
    assert [r.episode_id for r in splits.episode_leaks(rows, found).collect()] == ["heatwave|b|20250720|01"]


def test_split_report_keeps_empty_splits(spark):
    found = episodes.find_episodes(flags(spark))
    table = episodes.week_components(flags(spark), found).withColumn("split", F.lit("train"))
    rows = {r.split: r for r in splits.split_report(table, found, flags(spark)).collect()}
    assert (rows["train"].dates, rows["train"].weeks, rows["train"].episodes) == (42, 6, 5)
    assert rows["train"].heatwave_region_days == 5 + 10 and rows["train"].share == 1.0
    assert (rows["test"].dates, rows["test"].share) == (0, 0.0)
    events = splits.attach_split(flags(spark), table)
    assert splits.empty_hazard_splits(events).count() == 5
