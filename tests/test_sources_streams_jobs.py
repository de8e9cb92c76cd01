import gzip
import json
import time

import numpy as np
import pytest

from lacuna.plans import artifacts, jobs
from lacuna.sources import bgrid, sgems
from lacuna.streaming import updates


def grid():
    v = np.arange(4 * 3 * 2, dtype=float).reshape(3, 4, 2)
    v[1, 2, 0] = np.nan
    return v


@pytest.mark.parametrize("compressed", [False, True])
def test_binary_grids(spark, tmp_path, compressed):
    digest = bgrid.write(spark, f"file://{tmp_path}", grid(), [0, 1], compressed=compressed)
    name = tmp_path / f"{digest}.bgrid{'.gz' if compressed else ''}"
    raw = name.read_bytes()
    assert bgrid.header(gzip.decompress(raw) if compressed else raw)[:3] == ((4, 3), (0, 1), 0)
    got = {r.cell: r.v for r in bgrid.read(spark, str(name)).collect()}
    flat = grid().reshape(-1, 2)
    assert got == {i: [None if np.isnan(x) else x for x in row] for i, row in enumerate(flat)}
    m = bgrid.meta(spark, str(name)).first()
    assert (m.dims, m.kinds, m.encoding) == ([4, 3], [0, 1], 0)


def test_malformed_grids_are_refused():
    good = bgrid.encode(grid(), [0, 1])
    assert bgrid.decode(good)[1] == (0, 1)
    for bad in (b"", good[:-4], good + b"1234", b"\0" * 24, good[:8] + b"\xff" * 4 + good[12:], good[:24] + b"\x07" + good[25:]):
        with pytest.raises(bgrid.Malformed):
            bgrid.decode(bad)


def test_text_grids(spark, tmp_path):
    rows = [(i, [float(i), None if i == 5 else i / 4]) for i in range(24)]
    df = spark.createDataFrame(rows, "cell long, v array<double>").repartition(3)
    sgems.write(df, str(tmp_path / "g"), [4, 3, 2], [0, 1])
    back, sizes, kinds = sgems.read(spark, str(tmp_path / "g"))
    assert sizes == (4, 3, 2) and kinds == (0, 1)
    assert sorted((r.cell, r.v) for r in back.collect()) == rows


def test_text_grid_numbers_lines_over_splits(spark, tmp_path):
    """Whatever the splits of one file and of several, cells count from the third line on; blank lines count, too."""
    lines = ["50 40 1 1 1 1 0 0 0", "1", "Continuous_0", *(f"{i}.5" if i % 7 else "nan" for i in range(2000))]
    lines[3 + 11] = " "
    (tmp_path / "one").write_text("\n".join(lines) + "\n")
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"part-0000{k}").write_text("\n".join(lines[[0, 20, 1500][k] : [20, 1500, 2003][k]]) + "\n")
    want = {i: None if i % 7 == 0 else i + 0.5 for i in range(2000) if i != 11}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            for path in ("one", "many"):
                df = sgems.read(spark, str(tmp_path / path))[0]
                assert {r.cell: r.v[0] for r in df.collect()} == want and df.count() == 1999
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)



def test_arrays_as_cells(spark):
    got = {r.cell: (r.x, r.y, r.a, r.b) for r in bgrid.cells_of(spark, grid(), ["a", "b"]).collect()}
    assert got[5] == (1, 1, 10.0, 11.0) and got[6][2] is None and len(got) == 12


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_first_writes_count(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    q = updates.first_writes(updates.read_updates(spark, str(src))).writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    for i, lines in enumerate([[("V", 1, 5.0), ("F", 9, 1.0)], [("V", 1, 6.0), ("V", 2, 7.0)], [("V", 2, 8.0), ("V", 1, 9.0)]]):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"kind": k, "cell": c, "at": f"2024-01-01T00:00:0{i}", "value": v}) for k, c, v in lines))
        q.processAllAvailable()
    got = {r.cell: r.value for r in spark.table("firsts").collect()}
    drain(q)
    assert got == {1: 5.0, 2: 7.0}


def test_progress_is_the_latest(spark, tmp_path):
    src = tmp_path / "p"
    src.mkdir()
    stream = spark.readStream.schema("job string, key string, value string, at long").json(str(src))
    q = updates.progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    for i in range(3):
        (src / f"{i}.json").write_text(json.dumps({"job": "a", "key": "progress", "value": str(10 * i), "at": i}))
        q.processAllAvailable()
    got = [(r.job, r.key, r.value) for r in spark.table("progress").collect()]
    drain(q)
    assert got == [("a", "progress", "20")]


def test_log_tail(spark, tmp_path):
    src = tmp_path / "l"
    src.mkdir()
    (src / "log_j1.txt").write_text("one\ntwo\n")
    q = updates.tail(spark, str(src)).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    got = sorted((r.job, r.line) for r in spark.table("tail").collect())
    drain(q)
    assert got == [("j1", "one"), ("j1", "two")]


def test_windowed_counts_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    stream = updates.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    got = sum(r.n for r in spark.table("windows").collect())
    drain(q)
    assert got == e.count()


def test_jobs(spark):
    engine = jobs.Engine(spark, most=2)
    df = spark.createDataFrame([(1, "a")], "v long, c string")
    first = engine.submit("Echo", ti=df)
    assert engine.wait(first, 60) is df and engine.status(first) == jobs.DONE and engine.log(first) == ["v: Continuous", "c: Categorical"] and engine.log(first, since=1) == ["c: Categorical"]
    second = engine.submit("report_probe", after=[first], steps=3, mode="warning")
    assert engine.wait(second, 60) == 3 and engine.progress(second) == {"progress": 100.0} and engine.log(second, "warning") == ["a warning"] and engine.duration(second) >= 0
    third = engine.submit("error", mode="error", steps=1)
    with pytest.raises(RuntimeError):
        engine.wait(third, 60)
    assert engine.status(third) == jobs.FAILED
    fourth = engine.submit("reportProbe", after=[third])
    with pytest.raises(RuntimeError, match="did not end well"):
        engine.wait(fourth, 60)
    with pytest.raises(ValueError, match="lacks ti"):
        engine.submit("echo")
    with pytest.raises(KeyError):
        engine.submit("nothing")
    slow = engine.submit("report_probe", steps=50, sleep_ms=100)
    waiting = engine.submit("report_probe", after=[slow])
    time.sleep(0.3)
    engine.kill(waiting)
    engine.kill(slow)
    assert engine.status(waiting) == engine.status(slow) == jobs.CANCELLED
    engine.shutdown()
    with pytest.raises(RuntimeError):
        engine.submit("report_probe")


def test_key_values(spark):
    df = spark.createDataFrame([("a=1\nb=x=y",)], "t string")
    assert df.select(artifacts.key_values(df.t)).first()[0] == {"a": "1", "b": "x=y"}


def test_artifacts_and_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [("a", "log", 2, None, "two"), ("a", "log", 1, None, "one"), ("b", "log", 1, None, "other"), ("a", "progress", 1, "progress", "10"), ("a", "progress", 2, "progress", "50")]
    artifacts.append(spark.createDataFrame(rows[:3], artifacts.ROW), folder)
    artifacts.append(spark.createDataFrame(rows[3:], artifacts.ROW), folder)
    assert [r.value for r in artifacts.lookup(spark, folder, "log_a").collect()] == ["one", "two"]
    assert [tuple(r) for r in artifacts.lookup(spark, folder, "progress_a").collect()] == [(2, "progress", "50")]
    assert artifacts.lookup(spark, folder, "error_a").count() == 0
    with pytest.raises(ValueError):
        artifacts.lookup(spark, folder, "nothing_a")
    name = artifacts.put(spark.range(3), folder, "im 1/job")
    assert name == "im_1_job" and artifacts.exists(spark, folder, name) and not artifacts.exists(spark, folder, "im_2_job")
    artifacts.put(spark.range(5), folder, "im 1/job")
    assert artifacts.get(spark, folder, name).count() == 5
    have = spark.createDataFrame([("x",)], "digest string")
    assert [r.digest for r in artifacts.missing(spark.createDataFrame([("x",), ("y",), ("y",)], "digest string"), have).collect()] == ["y"]


def test_self_search_barriers_and_json_jobs(spark):
    from lacuna.plans import algorithms, jobs

    assert algorithms
    engine = jobs.Engine(spark)
    assert [engine.wait(engine.submit("Test", shape=s, radius=2, rounds=10)) for s in ((300,), (40, 30), (12, 14, 13))] == [0, 0, 0]
    slow = engine.submit("report_probe", mode="error", steps=2, sleep_ms=300)
    behind = engine.submit("report_probe", after=[], steps=1)
    assert engine.wait(behind) == 1 and engine.jobs[behind].started >= engine.jobs[slow].ended > 0
    free = engine.submit_json(json.dumps({"algorithm": "report_probe", "steps": 3}))
    assert engine.wait(free) == 3
    for bad in (json.dumps({"algorithm": "report_probe", "warning": "x" * (1 << 20)}), "{"):
        try:
            engine.submit_json(bad)
        except ValueError:
            continue
        raise AssertionError(bad[:20])


def test_names_of_a_job_are_views_of_stored_tables(spark, tmp_path):
    from lacuna.plans import algorithms

    assert algorithms
    folder, engine = str(tmp_path), jobs.Engine(spark)
    stored = [artifacts.put(spark.range(n), folder, f"image {n}") for n in (3, 5)]
    job = engine.submit("qs_prep", folder=folder, ti=stored, di=stored[:1])
    names = engine.wait(job)
    assert names == [f"ti_{job}_0", f"ti_{job}_1", f"di_{job}_0"]
    assert [spark.table(n).count() for n in names] == [3, 5, 3]
    with pytest.raises(KeyError, match="stored"):
        engine.wait(engine.submit("qs_prep", folder=folder, ti=["nothing"]))


def test_verbs_of_the_engine(spark, tmp_path):
    from lacuna.plans import algorithms, jobs

    assert algorithms
    engine = jobs.Engine(spark, store=f"file://{tmp_path}")
    name = engine.upload(spark.range(4), "grid 1")
    assert engine.exists(name) and not engine.exists("none") and engine.download(name).count() == 4
    text = json.dumps([[101, 102], [103, 104]])
    stored = engine.upload_json(text)
    assert stored == engine.upload_json(text) and engine.download_json(stored) == [[101, 102], [103, 104]]
    assert len(list((tmp_path / "texts").glob("[!.]*"))) == 1
    for bad in ("{", json.dumps("x" * (1 << 20))):
        with pytest.raises(ValueError):
            engine.upload_json(bad)
    lines = []
    got = engine.call("report_probe", steps=2, mode="warning", warning="careful", return_meta=True, show_logs=lines.append)
    assert got.tables == (2,) and got.progress == 100 and got.seconds > 0 and lines == ["step 1 of 2", "step 2 of 2"]
    assert got.messages["warning"] == ["careful"] and got.messages["progress"] == ["progress=100.0"] and got.messages["error"] == []
    image = np.arange(36.0).reshape(6, 6, 1)
    holed = np.where(image % 5 == 0, np.nan, image)
    values, places, narrowness, step = engine.call("nds", ti=image, di=holed, k=1, n=3).tables
    assert values.columns == ["seed", "cell", "variable", "value"] and places.count() == 36 and step.where("step is not null").count() == narrowness.where("narrowness is not null").count() == 8
    slow = engine.submit("report_probe", steps=1, sleep_ms=1500)
    with pytest.raises(TimeoutError):
        engine.call("report_probe", after=[slow], timeout=0.2)
    status = engine.server_status()
    assert status["ended"] == 2 and status["queued"] + status["running"] == 2 and status["open"] == 1
    engine.shutdown()
    assert engine.server_status()["open"] == 0
    with pytest.raises(RuntimeError, match="store"):
        jobs.Engine(spark).exists(name)
