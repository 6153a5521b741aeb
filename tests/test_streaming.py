from datetime import datetime

from pyspark.sql import functions as F

from graphloom.streaming import edges as stream


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_running_degrees(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\n1 2\n1,3\n5 5\n")
    (tmp_path / "b.txt").write_text("2 1\n1\t9 0.5\nbad\n")
    df = stream.running_degrees(stream.read_edge_stream(spark, str(tmp_path)))
    assert sorted(map(tuple, run(df, "degrees", "complete").collect())) == [(1, 3), (2, 1)]


def test_windows_and_repeated_deliveries(spark, tmp_path):
    rows = [(1, 2, datetime(2024, 1, 1, 0, 1)), (1, 2, datetime(2024, 1, 1, 0, 1)), (1, 3, datetime(2024, 1, 1, 0, 2)), (1, 3, datetime(2024, 1, 1, 2, 0)), (4, 4, datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "src long, dst long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("src long, dst long, at timestamp").parquet(str(tmp_path / "in"))
    assert run(stream.first_deliveries(read(), "at", "1 hour"), "firsts", "append").count() == 4
    out = run(stream.windowed_degrees(read(), "at", "1 hour", "10 minutes"), "windows", "append")
    got = sorted((r.start, r.id, r.degree) for r in out.where(F.col("start") < datetime(2024, 1, 2)).collect())
    assert got == [(datetime(2024, 1, 1, 0, 0), 1, 3), (datetime(2024, 1, 1, 2, 0), 1, 1)]
