"""Streams: running summaries, files that arrive, late rows; restarts in the middle."""

import os
import time
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from factloom.operators.extract import COUNTS, Relations, extract_facts, file_counts, file_summary
from factloom.sources import arrivals
from factloom.streaming import late, running, windows

FILES = "repo_id string, commit_sha string, file_path string, language string, code string, arrived timestamp"


def code(n, calls=1):
    return "import os\n" + "".join(f"def f{i}(x):\n" + "    g()\n" * calls + "\n" for i in range(n))


def put(spark, folder, rows):
    """One file of a stream's folder; Spark reads files in order of their times."""
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.05)


def at(minute):
    import datetime as d

    return d.datetime(2024, 1, 1, minute // 60, minute % 60)


def totals(df):
    return {(r["repo_id"], r["language"]): tuple(r[c] for c in running.TOTALS) for r in df.collect()}


def batch_summary(spark, rows):
    """Totals of the last version of each file, from its facts."""
    last = {}
    for r in rows:
        key = (r[0], r[2])
        if key not in last or r[5] >= last[key][5]:
            last[key] = r
    files = spark.createDataFrame([r for r in last.values() if r[4] is not None], FILES)
    per_file = file_summary(extract_facts(files), files)
    out = Counter()
    for r in per_file.collect():
        out[(r["repo_id"], r["language"])] += 0
        for i, v in enumerate((1, *(r[c] for c in COUNTS))):
            out[(r["repo_id"], r["language"], i)] += v
    keys = {k[:2] for k in out}
    return {k: tuple(out[(*k, i)] for i in range(len(running.TOTALS))) for k in keys}


ROUNDS = [
    [("r", "c0", f"f{i}.py", "python", code(i), at(0)) for i in range(6)] + [("s", "c0", "a.go", "go", "package a\nfunc F() {\n\tg()\n}\n", at(0))],
    [("r", "c1", "f1.py", "python", code(4, 2), at(1)), ("r", "c1", "f2.py", "python", None, at(1)), ("r", "c1", "new.py", "python", code(1), at(1))],
    [("r", "c2", "f1.py", "python", code(9), at(2)), ("r", "c2", "f1.py", "python", code(2), at(3)), ("s", "c2", "a.go", "go", "package a\n", at(2))],
    [("r", "c3", "f2.py", "python", code(3), at(5)), ("r", "c3", "f0.py", "javascript", "function q() {}\n", at(5))],
]


@pytest.mark.parametrize("stop", [None, 2])
def test_running_totals_equal_the_batch_summary(spark, tmp_path, stop, monkeypatch):
    for rows in ROUNDS:
        put(spark, f"{tmp_path}/in", rows)
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path, checkpoint = f"{tmp_path}/totals", f"{tmp_path}/state"
    if stop is not None:
        real, seen = running.differences, []

        def failing(*args):
            out = real(*args)
            return out.withColumn("files", F.when(F.lit(bool(seen)), F.col("files")).otherwise(F.when(F.col("repo_id") == "s", F.raise_error(F.lit("stopped")).cast("long")).otherwise(F.col("files"))))

        monkeypatch.setattr(running, "differences", failing)
        with pytest.raises(StreamingQueryException):
            running.keep_totals(stream, path, checkpoint).awaitTermination()
        seen.append(1)
    running.keep_totals(stream, path, checkpoint).awaitTermination()
    assert totals(running.totals(spark, path)) == batch_summary(spark, [r for rows in ROUNDS for r in rows])
    assert len([n for n in os.listdir(path) if n.startswith("batch=")]) >= 4
    put(spark, f"{tmp_path}/in", [("r", "c4", "f5.py", "python", code(1), at(9))])
    running.compact(spark, path)
    running.keep_totals(stream, path, checkpoint).awaitTermination()
    want = batch_summary(spark, [r for rows in ROUNDS for r in rows] + [("r", "c4", "f5.py", "python", code(1), at(9))])
    assert totals(running.totals(spark, path)) == want
    running.compact(spark, path)
    assert totals(running.totals(spark, path)) == want
    assert len(os.listdir(path)) < 6


def test_older_versions_change_nothing(spark, tmp_path):
    for version, n in ((5, 3), (4, 8), (6, 1)):
        put(spark, f"{tmp_path}/in", [("r", "c", "a.py", "python", code(n), at(version))])
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running.keep_totals(stream, f"{tmp_path}/totals", f"{tmp_path}/state").awaitTermination()
    found = totals(running.totals(spark, f"{tmp_path}/totals"))
    assert found == batch_summary(spark, [("r", "c", "a.py", "python", code(1), at(6))])


def test_files_that_stay_away_go(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("r", "c", "a.py", "python", code(2), at(0)), ("r", "c", "b.py", "python", code(1), at(0))])
    put(spark, f"{tmp_path}/in", [("r", "c", "a.py", "python", code(3), at(50))])
    put(spark, f"{tmp_path}/in", [("r", "c", "a.py", "python", code(3), at(70))])
    put(spark, f"{tmp_path}/in", [("q", "c", "z.rs", "rust", "fn f() {}\n", at(71))])
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running.keep_totals(stream, f"{tmp_path}/totals", f"{tmp_path}/state", keep="1 hour").awaitTermination()
    found = totals(running.totals(spark, f"{tmp_path}/totals"))
    assert found == batch_summary(spark, [("r", "c", "a.py", "python", code(3), at(70)), ("q", "c", "z.rs", "rust", "fn f() {}\n", at(71))])


def test_counts_of_files_equal_those_of_their_facts(spark):
    rows = [r for rows in ROUNDS for r in rows] + [("r", "c", "note.txt", None, "a\nb", at(0)), ("r", "c", "e.py", "python", "", at(0))]
    files = spark.createDataFrame([(*r[:2], f"{i}-{r[2]}", *r[3:]) for i, r in enumerate(rows)], FILES)
    facts = {r["file_path"]: tuple(r[c] for c in COUNTS) for r in file_summary(extract_facts(files), files).collect()}
    found = {r["file_path"]: tuple(r[c] for c in COUNTS) for r in file_counts(files).collect()}
    assert {p: c for p, c in found.items() if p in facts} == facts
    assert set(found) - set(facts) == {p for p in found if p.endswith("note.txt") or p == "8-f2.py"}
    assert found[f"{len(rows) - 2}-note.txt"] == (0, 0, 0, 0, 2)


def test_facts_leave_in_batches(spark, monkeypatch):
    files = spark.createDataFrame([("r", "c", f"m{i}.py", "python", code(i)) for i in range(40)], "repo_id string, commit_sha string, file_path string, language string, code string").coalesce(1)
    r = Relations(extract_facts(files))
    assert r.function.count() == sum(range(40)) and r.module.count() == 40
    assert Relations(extract_facts(files, ["function"])).facts.count() == sum(range(40))


# late rows

EVENTS = [(0, 5, 9, 12), (3, 25, 8), (1, 40, 26, 27), (2, 70, 41)]


def feed(spark, folder):
    n = 0
    for minutes in EVENTS:
        rows = []
        for m in minutes:
            rows += [(n := n + 1, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", "ab"[m % 2]), (n := n + 1, None, "a")]
        spark.createDataFrame(rows, "event_id long, ts string, event_type string").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.05)


def counted(*dfs):
    out = Counter()
    for df in dfs:
        for r in df.collect():
            out[(r["event_type"], r["start"])] += r["changes"]
    return out


def run_late(spark, folder, path, checkpoint):
    stream = spark.readStream.schema("event_id long, ts string, event_type string").option("maxFilesPerTrigger", 1).parquet(folder)
    late.keep(late.with_late(stream, ["event_type"], "10 minutes", "5 minutes", ["event_id", "ts"]), path, checkpoint).awaitTermination()


def test_on_time_and_late_rows_are_all_rows(spark, tmp_path):
    folder, path, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    feed(spark, folder)
    run_late(spark, folder, path, checkpoint)
    events = spark.read.parquet(folder)
    lates = late.late(spark, path)
    # by the watermark of each batch: 3 and 8 come when it is still at the start, 1 after 00:20, 2 after 00:35
    assert {r["event_id"] for r in lates.collect()} == {r["event_id"] for r in events.where("ts like '%00:01:00' or ts like '%00:02:00'").collect()}
    assert {str(r["ts"])[11:16] for r in lates.collect()} == {"00:01", "00:02"}
    closed, still = late.closed(spark, path, ["event_type"]), late.open_windows(spark, checkpoint, ["event_type"])
    whole = counted(windows.tumbling(events.where("ts is not null"), "10 minutes"))
    assert counted(closed, still, lates.groupBy("event_type", "start").agg(F.count("*").alias("changes"))) == whole
    assert {str(r["start"])[11:16] for r in still.collect()} == {"01:10"}  # all before have left the state
    # another run of the same stream has nothing to add
    before = closed.count(), lates.count()
    run_late(spark, folder, path, checkpoint)
    assert (late.closed(spark, path, ["event_type"]).count(), late.late(spark, path).count()) == before


def test_windows_go_on_after_a_restart(spark, tmp_path):
    one, path, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    feed(spark, f"{tmp_path}/all")
    names = sorted((n for n in os.listdir(f"{tmp_path}/all") if n.startswith("part-")), key=lambda n: os.path.getmtime(f"{tmp_path}/all/{n}"))
    os.mkdir(one)
    for name in names:  # one run for each file, so every batch starts from the checkpoint
        os.rename(f"{tmp_path}/all/{name}", f"{one}/{name}")
        run_late(spark, one, path, checkpoint)
    found = counted(late.closed(spark, path, ["event_type"]), late.open_windows(spark, checkpoint, ["event_type"]))
    lost = counted(late.late(spark, path).groupBy("event_type", "start").agg(F.count("*").alias("changes")))
    assert found + lost == counted(windows.tumbling(spark.read.parquet(one).where("ts is not null"), "10 minutes"))
    assert sum(lost.values()) >= 2


# files that arrive


def arrive(spark, folder, out, checkpoint, fail_at=None, **options):
    """Runs the stream till nothing is left; each batch is a table of its own, so one run again replaces itself."""

    def write(batch, number):
        if number == fail_at:
            batch.limit(1).write.mode("overwrite").parquet(f"{out}/batch={number}")
            raise RuntimeError("stopped")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    arrivals.register(spark)
    read = spark.readStream.format("source_arrivals").option("path", str(folder))
    for k, v in options.items():
        read = read.option(k, v)
    run = read.load().writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def arrived(spark, out):
    found = [r for n in os.listdir(out) for r in spark.read.parquet(f"{out}/{n}").collect()]
    return sorted(((os.path.basename(r["file_path"]), r["code"], r["error"]) for r in found), key=str)


def test_files_arrive_once_whatever_stops(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "src", f"{tmp_path}/out", f"{tmp_path}/state"
    folder.mkdir()
    for i in range(7):
        (folder / f"f{i}.py").write_text(f"x = {i}\n")
    (folder / "bad.py").write_bytes(b"\xff\xff")
    (folder / "note.txt").write_text("no source")
    with pytest.raises(StreamingQueryException, match="stopped"):
        arrive(spark, folder, out, checkpoint, fail_at=1, max_files=3)
    entries = len(arrivals.ArrivalLog(f"{folder}/.factloom-arrivals").numbers("entry"))
    assert entries >= 2
    # listed, but the stream stopped before it planned a batch
    (folder / "late.py").write_text("y = 1\n")
    reader = arrivals.ArrivalsReader({"path": str(folder), "max_files": "2"})
    reader.latestOffset()
    arrive(spark, folder, out, checkpoint, max_files=3)
    got = arrived(spark, out)
    assert [(n, c) for n, c, _ in got] == [("bad.py", None), *((f"f{i}.py", f"x = {i}\n") for i in range(7)), ("late.py", "y = 1\n")]
    assert [e is not None for _, _, e in got] == [True] + [False] * 8
    arrive(spark, folder, out, checkpoint)
    assert arrived(spark, out) == got
    (folder / "f3.py").write_text("x = 33\n")
    (folder / "f4.py").unlink()
    arrive(spark, folder, out, checkpoint)
    assert arrived(spark, out) == sorted([*got, ("f3.py", "x = 33\n", None), ("f4.py", None, None)], key=str)


def test_batches_are_limited_and_replayed(tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "SNAPSHOT", 3)
    for i in range(10):
        (tmp_path / f"f{i}.py").write_text("#" * (10 * i))
        os.utime(tmp_path / f"f{i}.py", ns=(i, i))
    make = lambda **o: arrivals.ArrivalsReader({"path": str(tmp_path), **o})
    reader = make(max_files="4", max_bytes="100")
    sizes, start = [], reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        files = [f for p in reader.partitions(start, end) for f in p.files]
        sizes.append(len(files))
        again = [f for p in make().partitions(start, end) for f in p.files]
        assert sorted(again) == sorted(files)
        reader.commit(end)
        start = end
    assert sizes == [4, 2, 1, 1, 1, 1]
    assert reader.log.numbers("snapshot") == [6] and reader.log.numbers("entry") == [4, 5, 6]
    assert make().latestOffset() == end  # a new reader finds nothing new
    rows = list(reader.read(arrivals.Files([(str(tmp_path / "f1.py"), 10, 1, 5), (str(tmp_path / "f2.py"), 1, 1, 5), (str(tmp_path / "none.py"), 1, 1, 5)])))
    assert [(r[4], r[6] is None) for r in rows] == [("#" * 10, True), (None, False), (None, False)]
    with pytest.raises(FileExistsError):
        reader.log.write(6, {})


def test_arrivals_feed_running_totals(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.py").write_text(code(3))
    (folder / "b.rs").write_text("fn f() {}\n")
    arrivals.register(spark)
    stream = spark.readStream.format("source_arrivals").option("path", str(folder)).option("repo_id", "r").load()
    go = lambda: running.keep_totals(stream, f"{tmp_path}/totals", f"{tmp_path}/state").awaitTermination()
    go()
    (folder / "a.py").write_text(code(5, 2))
    (folder / "b.rs").unlink()
    go()
    found = totals(running.totals(spark, f"{tmp_path}/totals"))
    assert found == batch_summary(spark, [("r", "HEAD", "a.py", "python", code(5, 2), at(0))])
