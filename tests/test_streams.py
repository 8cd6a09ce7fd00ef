import random

from pyspark.sql import functions as F

from sonarmill.operators import streams
from sonarmill.streaming.fold import fold_stream


def _levels():
    rng = random.Random(3)
    return [(u, s, 10 ** rng.uniform(-8, -2), rng.random()) for u in range(5) for s in range(60)]


def test_batch_and_stream_share_the_fold(spark, tmp_path):
    rows = _levels()
    schema = "user int, seq long, energy double, music double"
    for k in range(3):  # three micro-batches
        spark.createDataFrame([r for r in rows if r[1] // 20 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r["user"], r["seq"]): r["smooth"] for r in streams.smoothed_music(spark.createDataFrame(rows, schema), ["user"]).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = fold_stream(stream, ["user"], ["seq"], streams.Smoothing, "user int, seq long, smooth double")
    query = out.writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["user"], r["seq"]): r["smooth"] for r in spark.table("smoothed").collect()}
    assert got.keys() <= batch.keys() and len(got) >= 100
    for user in range(5):
        first = [batch[user, s] == got.get((user, s)) for s in range(20) if (user, s) in got]
        assert all(first)


def test_suppression_window_equals_fold(spark):
    rng = random.Random(5)
    rows = []
    for u in range(6):
        active = False
        for s in range(150):
            if rng.random() < 0.04:
                active = not active
            rows.append((u, s, active, 20.0))
    frame = spark.createDataFrame(rows, "user int, seq long, active boolean, frame_ms double")
    window = {(r["user"], r["seq"]): r["suppressed"] for r in streams.suppression(frame, ["user"], "seq", F.col("active")).collect()}
    for u in range(6):
        fold = streams.Suppression()
        for r in rows:
            if r[0] == u:
                got = fold.step({"seq": r[1], "active": r[2], "frame_ms": r[3]})[0]
                assert got["suppressed"] == window[u, r[1]], (u, r[1])


def test_first_frame_sets_the_floor():
    fold = streams.Activity()
    assert [fold.step({"seq": k, "energy": e})[0]["active"] for k, e in enumerate([0.01, 0.01, 0.2, 1e-9, 5e-8, None])] == [False, False, True, False, False, False]


def test_gaps_wrap_round(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 4), (2, 7)], "s int, n long")
    got = {(r["s"], r["n"]): r["missing"] for r in streams.with_gaps(rows, ["s"], "n").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 4): 2, (2, 7): 0}


def test_islands_equal_sessions(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    a = streams.spurts(events.withColumn("t", F.col("ts").cast("timestamp")), ["user_id"], "t").count()
    assert a == streams.spurts_by_window(events, ["user_id"], "ts", 1800).count()


def test_lost_frames_are_filled_from_the_past():
    import math

    fold = streams.LossFilling()
    tone = [[math.sin(2 * math.pi * (64 * k + n) / 32) for n in range(64)] for k in range(20)]
    out = [fold.step({"seq": k, "pcm": None if k in (0, 12) else x})[0] for k, x in enumerate(tone)]
    assert out[0]["pcm"] == [] and out[0]["filled"]
    assert out[5]["pcm"] == tone[5] and not out[5]["filled"]
    error = sum((a - b) ** 2 for a, b in zip(out[12]["pcm"], tone[12], strict=True)) / sum(a * a for a in tone[12])
    assert error < 0.1


def test_codebook_ties_and_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id int, x array<double>")
    book = spark.createDataFrame([(7, [0.5, 0.5]), (3, [0.5, 0.5]), (9, [5.0, 5.0])], "code int, v array<double>")
    got = {r["id"]: r["code"] for r in streams.nearest_code(rows, "id", "x", book, "code", "v").collect()}
    assert got == {1: 3, 2: 3}
    assert {r["id"] for r in streams.nearest_code(rows, "id", "x", book.limit(0), "code", "v").where("code is null").collect()} == {1, 2}
    many = spark.range(60).selectExpr("cast(id as int) as code", "array(double(id % 13), double(id % 7)) as v")
    points = spark.range(25).selectExpr("cast(id as int) as id", "array(id / 2, id / 4) as x")
    whole = sorted(map(tuple, streams.nearest_code(points, "id", "x", many, "code", "v").collect()))
    monkeypatch.setattr(streams, "MAX_CODES", 16)
    assert sorted(map(tuple, streams.nearest_code(points, "id", "x", many, "code", "v").collect())) == whole
