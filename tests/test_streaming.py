"""Streams that are fed from files and run to their end."""

import json

import pytest

from pyspark.sql import functions as F

from quernstone.plans.activity import snapshots
from quernstone.sources import months
from quernstone.streaming import activity as S


def feed(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def run(frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return frame.sparkSession.table(name).collect()


@pytest.fixture
def kept(spark):
    S.keep_state(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_growth_since_the_last_snapshot(spark, tmp_path, kept):
    source = tmp_path / "in"
    source.mkdir()
    rows = [(1, 1, 5, 2, 0), (1, 2, 7, 1, 0), (1, 3, 7, 1, 0), (2, 1, 0, 0, 0), (2, 5, 1, 1, 1)]
    feed(source, "a", [dict(zip(("user_id", "at", "solved", "stars", "errs"), r, strict=True)) for r in rows])
    stream = spark.readStream.schema("user_id long, at long, solved long, stars long, errs long").json(str(source))
    assert sorted(map(tuple, run(S.grown(stream), "grown"))) == [(1, 2, 2, 0, 0), (2, 5, 1, 1, 1)]


def test_a_restarted_stream_with_a_baseline_gives_the_windows_rows(spark, tmp_path, kept):
    """Snapshots of all events: those of the first days are the initial state, the rest comes in two runs of one stream."""
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "place"))
    every = snapshots(spark, "/root/testdata/sf0.001").selectExpr("user_id", "at", "solved", "stars", "errs").cache()
    days = sorted(r.at for r in every.select("at").distinct().collect())
    first, middle = days[len(days) // 4], days[len(days) // 2]
    last = F.max_by(F.struct("at", "solved", "stars", "errs"), "at").alias("s")
    baseline = every.where(F.col("at") <= first).groupBy("user_id").agg(last).select("user_id", "s.*")
    schema = "user_id long, at long, solved long, stars long, errs long"
    for part in (F.col("at").between(first + 1, middle), F.col("at") > middle, F.col("at") == middle):  # a day that comes again adds nothing
        every.where(part).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        query = S.grown(stream, baseline=baseline).writeStream.format("parquet").option("path", out).option("checkpointLocation", place)
        query.trigger(availableNow=True).start().awaitTermination()
    wanted = S.growth(every).where(F.col("at") > first)
    seen = baseline.select("user_id").collect()
    assert len(seen) and sorted(map(tuple, spark.read.schema(schema).parquet(out).collect())) == sorted(map(tuple, wanted.collect()))


def test_an_outbox_loses_and_doubles_nothing(spark, tmp_path):
    """A sink that fails twice: writes wait, are replaced by newer ones of their keys, and go out once."""
    cloud, pushes = {}, []

    def send(rows, push):
        found = {r.k: r.v for r in rows.collect()}
        pushes.append((push, found))
        cloud.update(list(found.items())[: 1 if push in (1, 2) else None])  # half done
        if push in (1, 2):
            raise ConnectionError("no answer")

    step = S.outbox(str(tmp_path / "box"), "k", "at", send)
    batches = [[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], [("a", 3, "z")], [("c", 1, "x"), ("b", 4, "y")], [("d", 5, "w")], []]
    frames = [spark.createDataFrame(b, "k string, at int, v string") for b in batches]
    for n, frame in enumerate(frames):
        step(frame, n)
    assert cloud == {"a": "z", "b": "y", "c": "x", "d": "w"}
    assert pushes == [(0, {"a": "y", "b": "x"}), (1, {"a": "z"}), (2, {"a": "z", "b": "y", "c": "x"}), (3, {"a": "z", "b": "y", "c": "x", "d": "w"})]
    step(frames[3], 3)  # a batch that comes again after its push was stored
    assert len(pushes) == 4 and S.unsent(spark, str(tmp_path / "box")).count() == 0
    assert sorted(r.push for r in spark.read.parquet(str(tmp_path / "box" / "errors")).select("push").collect()) == [1, 2]


def test_a_budgeted_scan_reads_the_months_it_needs(spark, tmp_path):
    folder = str(tmp_path / "games")
    rows = [(n, f"2024-{n % 12 + 1:02d}-{n % 28 + 1:02d}", "u" if n % 3 else "v", n % 2) for n in range(600)] + [(900, None, "u", 0)]
    table = spark.createDataFrame(rows, "n int, day string, nick string, rated int")
    months.write_by_month(table.withColumn("day", F.to_date("day")), "day", "month", folder)
    read = lambda frame: {f.split("month=")[1][:7] for f in frame.inputFiles()}
    found = months.newest_within(spark, folder, "month", ["day", "n"], 40, F.col("rated") == 1)
    newest = sorted((r for r in rows if r[1] and r[3] == 1), key=lambda r: (r[1], r[0]), reverse=True)[:40]
    assert [r.n for r in found.collect()] == [r[0] for r in newest] and read(found) == {"2024-12"}
    who = spark.createDataFrame([("u",), ("v",)], "nick string")
    each = months.newest_within(spark, folder, "month", ["day", "n"], 30, None, who)
    wanted = {r[0] for u in "uv" for r in sorted((r for r in rows if r[2] == u and r[1]), key=lambda r: (r[1], r[0]), reverse=True)[:30]}
    assert {r.n for r in each.collect()} == wanted and read(each) == {"2024-12", "2024-11", "2024-10"}
    nobody = months.newest_within(spark, folder, "month", ["day", "n"], 30, None, spark.createDataFrame([("w",)], "nick string"))
    assert nobody.count() == 0
    every = months.newest_within(spark, folder, "month", ["day", "n"], 1000)
    assert every.count() == 601


def test_bursts_keep_the_last_write(spark):
    rows = spark.createDataFrame(
        [
            ("k", "2024-01-01 00:00:00", "a"),
            ("k", "2024-01-01 00:00:01", "b"),
            ("k", "2024-01-01 00:00:05", "c"),
            ("l", "2024-01-01 00:00:00", "d"),
        ],
        "k string, at string, v string",
    ).selectExpr("k", "cast(at as timestamp) as at", "v")
    assert sorted(
        (r.k, r.v, r.writes) for r in S.settled_writes(rows, "k", "at", "v").collect()
    ) == [("k", "b", 2), ("k", "c", 1), ("l", "d", 1)]


def test_days(spark):
    rows = spark.createDataFrame(
        [("2024-01-01 23:59:59", "a"), ("2024-01-02 00:00:00", "a"), ("2024-01-02 10:00:00", "a")],
        "at string, t string",
    ).selectExpr("cast(at as timestamp) as at", "t")
    assert sorted((str(r.day), r.n) for r in S.per_day(rows, "at", ["t"]).collect()) == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_parts_of_a_job_are_sorted_files_of_25_rows(spark, tmp_path):
    done = str(tmp_path / "done")
    step = S.resumable(done, "gid", lambda rows: rows.selectExpr("gid", "gid * 2 as value"), 25)
    step(spark.range(200, 0, -1).withColumnRenamed("id", "gid"), 0)
    step(spark.range(150, 260).withColumnRenamed("id", "gid"), 1)
    files = {}
    for r in spark.read.parquet(done).select("gid", "batch", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect():
        files.setdefault((r.batch, r.file), []).append(r.gid)
    assert all(len(keys) <= 25 and keys == sorted(keys) for keys in files.values())
    for batch, wanted in ((0, range(1, 201)), (1, range(201, 260))):
        own = sorted(keys for (b, _), keys in files.items() if b == batch)
        assert [k for keys in own for k in keys] == list(wanted)


def test_a_job_that_comes_again_adds_nothing(spark, tmp_path):
    done = str(tmp_path / "done")
    step = S.resumable(done, "gid", lambda rows: rows.selectExpr("gid", "gid * 2 as value"))
    step(spark.createDataFrame([(1,), (2,), (2,)], "gid long"), 0)
    step(spark.createDataFrame([(2,), (3,)], "gid long"), 1)
    step(spark.createDataFrame([(2,), (3,)], "gid long"), 1)
    assert sorted(r.gid for r in spark.read.parquet(done).collect()) == [1, 2, 3]


@pytest.mark.parametrize("name", ["kmeans_assign", "pca_project"])
def test_estimators(spark, name):
    from quernstone import plans

    rows = plans.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len({r.vec_id for r in rows}) == len(rows) > 0
    if name == "kmeans_assign":
        sizes = [sum(r.cluster == k for r in rows) for k in range(12)]
        assert sizes == sorted(sizes, reverse=True) and sum(sizes) == len(rows)
    else:
        assert {len(r.projected) for r in rows} == {8}


def test_projection_keeps_the_variance_that_eight_components_can(spark):
    import numpy as np

    from quernstone.operators import ml

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = ml.project(table, "embedding", 8, 1, "vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    p = np.array([r.projected for r in rows])
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    best = x @ vectors[:, ::-1][:, :8]
    assert np.allclose(np.abs(p), np.abs(best), atol=1e-6)
    assert np.isclose(((p - p.mean(0)) ** 2).sum(), values[-8:].sum())


def test_growth_of_a_table_is_that_of_the_stream(spark):
    rows = spark.createDataFrame(
        [(1, 1, 5, 2, 0), (1, 2, 7, 1, 0), (1, 3, 7, 1, 0), (2, 1, 0, 0, 0), (2, 5, 1, 1, 1)],
        "user_id long, at long, solved long, stars long, errs long",
    )
    assert sorted(map(tuple, S.growth(rows).collect())) == [(1, 2, 2, 0, 0), (2, 5, 1, 1, 1)]
