"""File layouts, the event stream, and the entry point with and without its optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidalpanel.sources import files
from tidalpanel.streaming import events

REPO = Path(__file__).resolve().parents[1]


def test_macro_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("sasdate,A,B\nTransform:,5,x\n1/1/2000,1.5,\n2/1/2000,oops,3\n")
    rows = {(str(r.period), r.series): r.value for r in files.macro_panel(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {("2000-01-01", "A"): 1.5, ("2000-01-01", "B"): None, ("2000-02-01", "A"): None, ("2000-02-01", "B"): 3.0}
    assert {r.series: r.code for r in files.transform_codes(spark, str(tmp_path / "m.csv")).collect()} == {"A": 5, "B": 1}
    meta = spark.createDataFrame([("A", 1), ("B", 6)], "series string, grp int")
    panel = files.macro_panel(spark, str(tmp_path / "m.csv"))
    assert {r.series for r in files.exclude(panel, meta, [6]).collect()} == {"A"}
    with pytest.raises(ValueError):
        files.exclude(panel, meta, [7])
    assert files.alias(panel, "A", "C").filter("series = 'C'").count() == 2


def test_vintages_and_prices(spark, tmp_path):
    for month, x in (("2001-01", 1), ("2001-03", 2)):
        (tmp_path / f"{month}.csv").write_text(f"sasdate,A\nTransform:,1\n1/1/2000,{x}\n")
    every = files.vintages(spark, str(tmp_path))
    assert [r.value for r in files.vintage_as_of(every, "2001-02-15").collect()] == [1.0]
    assert files.vintage_as_of(every, "2000-12-31").count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p/p.csv").write_text("Date,X,Y\n2000-01-31,,5\n2000-02-29,7,6\n")
    assert files.prices(spark, str(tmp_path / "p/p.csv"), "2000-02-01").count() == 2
    assert files.predictions(spark, str(tmp_path / "p/p.csv")).count() == 2


def test_panel_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2000-01-01", "a", 1.0), ("2000-01-01", "b", 2.0)], "period string, series string, value double")
    files.write_panel(df, str(tmp_path / "panel"))
    plan = spark.read.parquet(str(tmp_path / "panel")).filter("series = 'a'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(series" in plan._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    stream = events.tumbling(events.read_stream(spark, sf))
    events.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("start", "event_type", "n").collect()}
    want = {tuple(r) for r in events.tumbling(spark.read.parquet(f"{sf}/events.parquet")).select("start", "event_type", "n").collect()}
    assert got and got <= want


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    code = "import sys; sys.modules['tidalpanel.llm'] = None; import __spark_entry__ as e; print(any(k.startswith('op') and k[2].isdigit() for k in e.queries()), len(e.queries()) > 40)"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.stdout.split() == ["False", "True"], done.stderr[-500:]
