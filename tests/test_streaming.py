import datetime as dt

import pytest

import lodestat as ls
from lodestat.errors import ColumnNotFound

SCHEMA = "ts timestamp, kind string, a double, b int"
START = dt.datetime(2024, 5, 1)


def event(minute, kind, a, b):
    return (START + dt.timedelta(minutes=minute), kind, a, b)


@pytest.fixture
def arrivals(spark, tmp_path):
    """Folder of files in order of arrival; the second holds rows of windows that the first already reached."""

    def write(*files):
        folder = tmp_path / "in"
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            folder.mkdir(exist_ok=True)
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                (folder / f"{k}.parquet").write_bytes(f.read_bytes())
        return str(folder)

    return write


def series(low, high, step=1):
    return [event(m, "xy"[m % 2], None if m % 7 == 0 else (m * 37) % 11 - 5.0, m % 3 or None) for m in range(low, high, step)]


def same(got, want, keys):
    rows = lambda df: sorted((tuple(str(r[k]) for k in keys), [r[c] for c in df.columns if c not in keys]) for r in df.collect())
    a, b = rows(got), rows(want)
    assert [k for k, _ in a] == [k for k, _ in b]
    for (_, x), (_, y) in zip(a, b):
        assert x == pytest.approx(y)


KEYS = ["window_start", "window_end", "kind", "column"]


@pytest.mark.parametrize("slide", [None, "20 minutes"])
def test_stream_equals_batch_with_late_rows(spark, tmp_path, arrivals, slide):
    folder = arrivals(series(0, 130), series(100, 250, 3) + series(95, 99), series(240, 300))
    profile = lambda df: ls.profile_stream(df, "ts", "1 hour", "40 minutes", by="kind", slide=slide)
    made = profile(ls.read_stream(spark, folder, SCHEMA, files_per_batch=1))
    query = ls.write_current(made, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    want = profile(spark.read.schema(SCHEMA).parquet(folder))
    same(ls.current(spark, str(tmp_path / "out"), made), want, KEYS)


def test_statistics_equal_the_batch_operators(spark, arrivals):
    df = spark.read.schema(SCHEMA).parquet(arrivals(series(0, 60)))
    got = {r["column"]: r for r in ls.profile_stream(df, "ts", "1 hour", "1 minute").collect()}
    want = {r["column"]: r for r in ls.column_stats(df, ["mean", "variance", "skewness", "sparsity"]).collect()}
    for c in ("a", "b"):
        assert got[c]["rows"] == 60
        assert [got[c][s] for s in ("mean", "variance", "skewness", "sparsity")] == pytest.approx([want[c][s] for s in ("mean", "variance", "skewness", "sparsity")])
    cells = {(r["column_i"], r["column_j"]): r["value"] for r in ls.covariance_stream(df, "ts", "1 hour", "1 minute").collect()}
    for r in ls.covariance_matrix(df).collect():
        assert cells[r["column_i"], r["column_j"]] == pytest.approx(r["value"])


def test_closed_windows_once_and_too_late_rows_dropped(spark, tmp_path, arrivals):
    first, late = series(0, 200), [event(5, "x", 1000.0, 1)]
    folder = arrivals(first, series(200, 210), late, series(210, 330))  # the watermark drops rows from the second batch on
    made = ls.covariance_stream(ls.read_stream(spark, folder, SCHEMA, files_per_batch=1), "ts", "1 hour", "10 minutes")
    ls.write_closed(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = spark.createDataFrame(first + series(200, 330), SCHEMA)
    want = ls.covariance_stream(whole, "ts", "1 hour", "10 minutes").where("window_end <= timestamp'2024-05-01 05:00:00'")
    same(got, want, ["window_start", "window_end", "column_i", "column_j"])


def test_restart_goes_on_where_it_stopped(spark, tmp_path, arrivals):
    folder = arrivals(series(0, 100))
    profile = lambda df: ls.profile_stream(df, "ts", "1 hour", "2 hours", ["a"], "kind")
    made = profile(ls.read_stream(spark, folder, SCHEMA))
    for rows in (None, series(40, 170)):
        if rows:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
        ls.write_current(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    same(ls.current(spark, str(tmp_path / "out"), made), profile(spark.read.schema(SCHEMA).parquet(folder)), KEYS)


def test_unknown_names(spark):
    df = spark.createDataFrame(series(0, 3), SCHEMA)
    with pytest.raises(ColumnNotFound):
        ls.profile_stream(df, "when", "1 hour", "1 minute")
    with pytest.raises(ColumnNotFound):
        ls.covariance_stream(df, "ts", "1 hour", "1 minute", ["kind"])
