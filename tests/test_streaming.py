import pytest
from helpers import SF

from gridloom.operators.intensity import accumulated_frames
from gridloom.plans.fixtures import daily
from gridloom.streaming import accumulate


@pytest.mark.parametrize("how", ["sum", "weighted"])
def test_stream_equals_batch(spark, tmp_path, how):
    frames = daily(spark, SF).where("y < 3")
    frames.repartition(1).sortWithinPartitions("frame_id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in")
    out, mode = (accumulate.running(stream), "complete") if how == "sum" else (accumulate.faded(stream, 0.2), "update")
    q = out.writeStream.format("memory").queryName(f"acc_{how}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.y, r.x, r.c): round(r.v, 9) for r in spark.table(f"acc_{how}").collect()}
    assert got == {(r.y, r.x, r.c): round(r.v, 9) for r in accumulated_frames(frames, how, 0.2).collect()}


def test_products_and_windows_with_late_rows(spark, tmp_path):
    """Running products equal the batch sums; a row behind the watermark is left out of its window, one within it is not."""
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 12, m)
    schema = "ts timestamp, y int, x int, c int, v int, w int"
    parts = [[(at(1), 0, 0, 0, 5, 2), (at(4), 0, 0, 0, 7, 3)], [(at(21), 0, 0, 0, 1, 1)], [(at(3), 0, 0, 0, 100, 1), (at(18), 0, 0, 0, 9, 4)], [(at(50), 0, 0, 0, 1, 1)], [(at(59), 0, 0, 0, 1, 1)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/p/{i}")
    out = {"w": [], "p": []}
    for name in out:
        (tmp_path / f"in_{name}").mkdir()
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in_{name}")
        df, mode = (accumulate.windowed(stream, "10 minutes", "5 minutes"), "append") if name == "w" else (accumulate.running_product(stream), "complete")
        q = df.writeStream.format("memory").queryName(f"late_{name}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp_{name}").start()
        for i in range(len(parts)):
            for f in (tmp_path / "p" / str(i)).glob("*.parquet"):
                (tmp_path / f"in_{name}" / f"{i}.parquet").write_bytes(f.read_bytes())
            q.processAllAvailable()
        q.stop()
    got = sorted((r.start, r.v) for r in spark.table("late_w").collect())
    assert got == [(at(0), 12.0), (at(10), 9.0), (at(20), 1.0)]
    assert [(r.v, r.frames) for r in spark.table("late_p").collect()] == [(sum(v * w for p in parts for *_, v, w in p), 7)]
