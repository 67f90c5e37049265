"""Streaming forms over files that arrive in turn."""

from loomwork.streaming import windows as W
from pyspark.sql import functions as F


def run(spark, frame, mode, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def source(spark, path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_windows_and_sessions(spark, tmp_path):
    schema = "source_id long, event_id long, ts timestamp, outcome string, hash string"
    rows = [[(1, 1, "2024-01-01 01:00:00", "error", "a"), (1, 2, "2024-01-01 02:00:00", "ok", "a")], [(1, 3, "2024-01-02 02:10:00", "ok", "b")]]
    make = lambda part: [(a, b, __import__("datetime").datetime.fromisoformat(t), o, h) for a, b, t, o, h in part]
    stream = source(spark, tmp_path / "s", [make(p) for p in rows], schema)
    got = {str(r.start)[:10]: (r.total, r.errored) for r in run(spark, W.windowed_outcomes(stream), "complete", "days").collect()}
    assert got == {"2024-01-01": (2, 1), "2024-01-02": (1, 0)}
    assert sorted(r.n for r in run(spark, W.sessions(stream, "2 hours"), "complete", "sess").collect()) == [1, 2]
    tracked = run(spark, W.track(stream.select("source_id", "event_id", "outcome", "hash")), "append", "track").collect()
    assert sorted((r.change, r.failures) for r in tracked) == sorted([("error", 1), ("new", 0), ("changed", 0)])
    assert F is not None
