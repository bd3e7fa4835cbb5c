import datetime as dt
import json

import pytest
from dates import day, days
from pyspark.sql import functions as F

from panelshock.operators import flow, models, weather
from panelshock.plans import pipelines
from panelshock.session import checkpoint, shared_folder, staged
from panelshock.sources import readers, writers

CARD = ["TA_YMD", "MCT_SGG_CD", "MCT_RY_CD", "TS_AT", "USE_CNT", "TIME_GB"]


def write(path, header, rows, sep, encoding):
    lines = [sep.join(header), *[sep.join(r) for r in rows]]
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))


def test_pick_and_read_card(spark, tmp_path):
    write(tmp_path / "a.txt", CARD[:-1], [["20250701", "서울", "x", "1", "1"]], "\t", "cp949")
    write(tmp_path / "b.tsv", CARD, [["20250702", "서울", "x", "1", "1", "1"]], "\t", "cp949")
    write(tmp_path / "c.txt", ["extra", *CARD], [["?", "20250703", "서울 강남구", "음식", "1.5", "1", "1"]], "\t", "cp949")
    path = readers.pick_source(spark, str(tmp_path))
    assert path.endswith("c.txt")
    row = readers.read_card(spark, path).first()
    assert (row.TA_YMD, row.MCT_SGG_CD, row.MCT_RY_CD, row.TS_AT, row.source_file) == ("20250703", "서울 강남구", "음식", "1.5", "c.txt")
    card = pipelines.build_card_panel(readers.read_card(spark, path)).first()
    assert (card.date, float(card.TS_AT)) == (day("2025-07-03"), 1.5)
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        readers.pick_source(spark, str(empty))
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_card(spark, str(tmp_path / "a.txt"))


def test_files_with_other_headers_are_refused(spark, tmp_path):
    write(tmp_path / "1.csv", list(readers.HOURLY_COLUMNS), [["1", "n", "2025-07-01 00:00", "0"]], ",", "cp949")
    write(tmp_path / "2.csv", list(reversed(readers.HOURLY_COLUMNS)), [["0", "2025-07-01 01:00", "n", "1"]], ",", "cp949")
    with pytest.raises(Exception, match="header|CSV"):
        readers.read_hourly(spark, f"{tmp_path}/*.csv").collect()


@pytest.fixture(scope="module")
def raw_weather(tmp_path_factory):
    folder = tmp_path_factory.mktemp("weather")
    for m in (7, 8, 9):
        rows = [[f"2025-{m:02d}-{d:02d}", s, "O" if d == 2 else "X", "X", "", "20", "15", "25"] for d in (1, 2) for s in ("S(1)", "T(2)")]
        write(folder / f"HEAT_{m}.txt", weather.HEAT_COLUMNS, rows, "\t", "cp949")
    for m in (11, 12):
        rows = [[f"2025-{m}-01", s, "경보", "", "1", "0", "2"] for s in ("S(1)", "T(2)")]
        write(folder / f"COLD_{m}.txt", weather.COLD_COLUMNS, rows, "\t", "cp949")
    for station, name in (("400", "s"), ("101", "t")):
        rows = [[station, name, f"2025-07-{1 + h // 24:02d} {h % 24:02d}:00", "25" if h < 3 else "0"] for h in range(48)]
        write(folder / f"OBS_{name}.csv", readers.HOURLY_COLUMNS, rows, ",", "cp949")
    return folder


WARNING, RAIN = {"S(1)": "s", "T(2)": "t"}, {"400": "s", "101": "t"}


def read_all(spark, folder):
    return (
        readers.read_heat_warnings(spark, f"{folder}/HEAT_*"),
        readers.read_cold_warnings(spark, f"{folder}/COLD_*"),
        readers.read_hourly(spark, f"{folder}/OBS_*.csv"),
    )


def test_weather_from_files(spark, raw_weather):
    heat, cold, hourly = read_all(spark, raw_weather)
    rows = {(r.date, r.MCT_SGG_CD): r for r in pipelines.build_weather(heat, cold, hourly, WARNING, RAIN).collect()}
    assert len(rows) == 4
    first = rows[day("2025-07-01"), "s"]
    assert (first.heatwave, first.rainfall, first.heavy_rain, first.rain_3h_max_mm) == (0, 75.0, 1, 75.0)
    assert rows[day("2025-07-02"), "t"].heatwave == 1 and rows[day("2025-07-02"), "t"].heavy_rain == 0
    manifest = [r.file.rsplit("/", 1)[1] for r in readers.source_manifest(heat, cold, hourly).collect()]
    assert manifest == ["COLD_11.txt", "COLD_12.txt", "HEAT_7.txt", "HEAT_8.txt", "HEAT_9.txt", "OBS_s.csv", "OBS_t.csv"]


def test_weather_audits_raise(spark, raw_weather):
    heat, cold, hourly = read_all(spark, raw_weather)
    with pytest.raises(FileNotFoundError, match="heat"):
        readers.read_heat_warnings(spark, f"{raw_weather}/COLD_*")
    with pytest.raises(ValueError, match="station missing"):
        pipelines.build_weather(heat, cold, hourly, {**WARNING, "U": "u"}, RAIN)
    with pytest.raises(ValueError, match="unexpected station"):
        pipelines.build_weather(heat, cold, hourly, WARNING, {"400": "s"}, only_known_stations=True)
    with pytest.raises(ValueError, match="without hourly"):
        pipelines.build_weather(heat, cold, hourly, WARNING, {**RAIN, "9": "u"})
    with pytest.raises(ValueError, match="duplicate hourly"):
        pipelines.build_weather(heat, cold, hourly.union(hourly), WARNING, RAIN)
    with pytest.raises(ValueError, match="several stations"):
        pipelines.build_weather(heat, cold, hourly.withColumn("source_file", F.lit("one")), WARNING, RAIN)
    with pytest.raises(ValueError, match="duplicate date-region"):
        pipelines.build_weather(heat.union(heat), cold, hourly, WARNING, RAIN)


def test_panel_from_files(spark, raw_weather):
    sky = pipelines.build_weather(*read_all(spark, raw_weather), WARNING, RAIN)
    card = spark.createDataFrame(
        [(day("2025-07-01"), " s", "x", 10.0, 2.0, 5.0), (day("2025-08-01"), "s", "x", 1.0, 1.0, 1.0)],
        "date date, MCT_SGG_CD string, MCT_RY_CD string, TS_AT double, USE_CNT double, avg_price double",
    )
    rows = {r.date: r for r in pipelines.build_panel(card, sky).collect()}
    assert rows[day("2025-07-01")].heavy_rain == 1 and rows[day("2025-08-01")].heatwave is None
    with pytest.raises(ValueError, match="duplicate date-region-industry"):
        pipelines.build_panel(card.union(card), sky)


def test_flow_and_bom(spark, tmp_path):
    header = [*readers.FLOW_READ, "OTHER"]
    rows = [["202507", "1111100", *[str(i) for i in range(7)], "z"]]
    write(tmp_path / "flow_202507.csv", header, rows, "|", "utf-8-sig")
    got = readers.read_flow(spark, f"{tmp_path}/flow_*.csv")
    assert got.columns == [*readers.FLOW_READ, "source_file"]
    profile = flow.flow_profile(flow.mapped_flow(got, {"11111": "a"}))
    assert profile.where("weekday = 6").first().flow_pop_weekday == 6.0
    panel = spark.createDataFrame([(day("2025-07-06"), "a", "x"), (day("2025-08-06"), "a", "x")], "date date, MCT_SGG_CD string, MCT_RY_CD string")
    facts = pipelines.flow_metadata(got, {"11111": "a"}, flow.join_flow(panel, profile)).first()
    assert (facts.matched_feature_rows, facts.unmatched_feature_rows, facts.ignored_block_prefixes) == (1, 1, [])
    assert facts.coverage[0].matched_blocks == 1 and facts.source_files[0].endswith("flow_202507.csv")
    with pytest.raises(FileNotFoundError):
        readers.read_flow(spark, f"{tmp_path}/absent_*.csv")


def test_result_csv_types_and_bom(spark, tmp_path):
    write(tmp_path / "e.csv", ["episode_id", "start_date", "days"], [["h|r", "2025-07-01", "3"]], ",", "utf-8-sig")
    row = readers.read_result_csv(spark, str(tmp_path / "e.csv"), {"episode_id": "string", "start_date": "date", "days": "int"}).first()
    assert tuple(row) == ("h|r", day("2025-07-01"), 3)
    assert readers.read_result_csv(spark, str(tmp_path / "e.csv")).columns[0] == "episode_id"
    with pytest.raises(Exception):
        readers.read_result_csv(spark, str(tmp_path / "e.csv"), {"episode_id": "int"}).collect()


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "a int, b string")
    for sink, name in ((writers.write_table, "t"), (writers.write_csv, "c"), (writers.write_metadata, "m")):
        path = str(tmp_path / name)
        sink(df, path)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
            sink(df, path)
        sink(df, path, overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    writers.write_csv(df, str(tmp_path / "marked"), bom=True)
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfa,b\n") for p in (tmp_path / "marked").glob("part-*"))
    assert readers.read_result_csv(spark, str(tmp_path / "marked"), {"a": "int", "b": "string"}).count() == 2
    writers.write_csv(df, str(tmp_path / "sorted"), order_by=["a"])
    parts = sorted((tmp_path / "sorted").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines() if x != "a,b"]
    assert [x.split(",")[0] for x in lines] == ["1", "2"]
    assert json.loads(next((tmp_path / "m").glob("part-*")).read_text().splitlines()[0])["a"] in (1, 2)


def panel_rows():
    """Two regions, two industries, a year of days with summer and winter events."""
    rows = []
    for i, d in enumerate(days("2025-06-01", 214)):
        for r, region in enumerate("ab"):
            heat = int((i + 3 * r) % 13 < 2) if d.month in (7, 8, 9) else None
            cold = int((i + 5 * r) % 9 < 2) if d.month in (11, 12) else None
            for k, industry in enumerate("xy"):
                sales = 100.0 + 10 * k + d.weekday() - (20 if heat or cold else 0) + (i * 7 + k) % 5
                rows.append((d, region, industry, sales, heat, cold, float(i % 30), float(i % 30 - 3), float(i % 30 + 3)))
    return rows


PANEL = "date date, MCT_SGG_CD string, MCT_RY_CD string, TS_AT double, heatwave int, cold_wave int, avg_temp double, min_temp double, max_temp double"


def test_impact_models_and_report(spark):
    source = spark.createDataFrame(panel_rows(), PANEL)
    tables = pipelines.build_impact(source, restarts=16)
    assert {r.split for r in tables.split_dates.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert tables.baselines["heatwave"].count() == 4
    sets = {"B_plus_past_sales": models.FEATURE_SETS["B_plus_past_sales"]}
    scored, _ = models.run_grid(tables.panel, {"Ridge": models.ridge}, sets)
    scored = staged(scored)
    out = pipelines.response_report(scored, tables.episodes, "Ridge", "B_plus_past_sales")
    events = source.where("heatwave = 1 or cold_wave = 1").count()
    assert out["metrics"].agg(F.sum("n")).first()[0] == events
    assert out["episode_summary"].count() == tables.episodes.count()
    assert out["episode_summary"].agg(F.max("actual_y1_row_mean")).first()[0] < 0
    assert out["outlier_sensitivity"].count() == 6
    assert out["region_episode_summary"].count() <= 12
    found = {r.disaster_type: r for r in pipelines.analysis_config(scored, scored).collect()}
    assert set(found) == {"heatwave", "cold_wave"}
    assert found["heatwave"].saved_prediction_max_absolute_difference == 0.0 and found["heatwave"].train_p01 < found["heatwave"].train_p99
    config = pipelines.run_config(spark, 1, sets, ["Ridge"]).first()
    assert config.rolling_days == {"rolling7": 7, "rolling28": 28} and "TS_AT" in config.excluded_features


def test_impact_audits_raise(spark):
    source = spark.createDataFrame(panel_rows(), PANEL)
    with pytest.raises(ValueError, match="duplicate"):
        pipelines.build_impact(source.union(source.limit(1)))
    odd = source.withColumn("heatwave", F.when((F.col("MCT_RY_CD") == "x"), F.lit(1)).otherwise(F.lit(0)))
    with pytest.raises(ValueError, match="flag differs"):
        pipelines.build_impact(odd)
    with pytest.raises(ValueError, match="missing columns"):
        pipelines.build_impact(source.drop("cold_wave"))
    calm = source.withColumn("cold_wave", F.lit(0))
    with pytest.raises(ValueError, match="absent from a split"):
        pipelines.build_impact(calm, restarts=2)


def test_staged_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (folder or spark.sparkContext.getCheckpointDir())
    df = spark.createDataFrame([(dt.date(2025, 7, 1), 1)], "d date, v int")
    again = staged(df)
    assert again.schema == df.schema and again.collect() == df.collect()
    assert all(shared_folder(spark).removeprefix("file:") in f for f in again.inputFiles())
    assert checkpoint(df).collect() == df.collect()


def test_scanned_tables_become_files_without_a_shuffle(spark, tmp_path, capsys):
    from panelshock.plans.queries import _as_files, _scanned

    table = spark.range(8000).selectExpr("cast(id as string) a", "cast(id % 7 as string) b")
    table.repartition(8).write.parquet(str(tmp_path / "wide"))
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a file a partition
    try:
        for name, exactly, files, shuffled in (("wide", True, 4, False), ("wide", False, 8, False), ("one", True, 4, True), ("one", False, 4, True)):
            out = _scanned(spark.read.parquet(str(tmp_path / name)), 4, exactly)
            capsys.readouterr()
            out.explain()
            assert ("Exchange" in capsys.readouterr().out) == shuffled
            path = _as_files(spark, out, "\t", "UTF-8")
            back = spark.read.options(header=True, sep="\t").csv(path)
            assert len(back.inputFiles()) == files and back.count() == back.distinct().count() == 8000
    finally:
        for name, value in zip(("openCostInBytes", "maxPartitionBytes"), before):
            spark.conf.set(f"spark.sql.files.{name}", value)
