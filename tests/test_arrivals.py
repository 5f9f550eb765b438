"""The stream of settled files on a real folder."""

import json
import os
import time

from tallyrad.streaming import arrivals


def write(path, content, age=600.0):
    path.write_bytes(content)
    os.utime(path, (time.time() - age,) * 2)


def run(spark, folder, tmp_path, name="q", **options):
    """One go over what has settled, appended to a table; restarts from the same checkpoint."""
    stream = arrivals.settled_files(spark, str(folder), str(tmp_path / f"{name}-log"), **options)
    out = str(tmp_path / f"{name}-out")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start(out).awaitTermination()
    return sorted((os.path.basename(r.path), bytes(r.content)) for r in spark.read.schema(stream.schema).parquet(out).collect())


def test_a_file_that_is_still_written_comes_once_later(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "old.png", b"old")
    write(folder / "young.PNG", b"half", age=0)
    write(folder / "empty.jpg", b"")
    write(folder / "note.txt", b"no image")
    assert run(spark, folder, tmp_path, quiet_ms=120_000) == [("old.png", b"old")]
    write(folder / "young.PNG", b"whole", age=200)  # its writer is done
    write(folder / "empty.jpg", b"no more", age=300)
    want = [("empty.jpg", b"no more"), ("old.png", b"old"), ("young.PNG", b"whole")]
    for _ in range(2):  # the query was ended and starts again; nothing comes twice
        assert run(spark, folder, tmp_path, quiet_ms=120_000) == want
    write(folder / "old.png", b"new content", age=150)
    assert run(spark, folder, tmp_path, quiet_ms=120_000) == sorted([*want, ("old.png", b"new content")])


def test_a_running_query_waits_for_a_growing_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = arrivals.settled_files(spark, str(folder), str(tmp_path / "log"), quiet_ms=1500)
    query = stream.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    content = b""
    for _ in range(6):
        content += b"x" * 10
        (folder / "a.png").write_bytes(content)
        time.sleep(0.5)
    deadline = time.time() + 60
    while time.time() < deadline and not spark.table("grown").count():
        time.sleep(0.5)
    time.sleep(2)
    rows = spark.table("grown").collect()
    query.stop()
    assert [(os.path.basename(r.path), bytes(r.content)) for r in rows] == [("a.png", content)]


def reader(tmp_path, **options):
    return arrivals.Settling({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "quiet_ms": "800", **options})


def test_times_that_cannot_be_trusted(tmp_path):
    """A file from a clock ahead of ours is settled once it stood unchanged for long enough."""
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.png", b"ahead", age=-3600)
    source = reader(tmp_path, quiet_ms="300")
    assert source.latestOffset() == {"entry": 0}
    time.sleep(0.4)
    assert source.latestOffset() == {"entry": 1} == source.latestOffset()


def test_a_repeated_batch_names_the_same_files(tmp_path):
    (tmp_path / "in").mkdir()
    source = reader(tmp_path, files_per_batch="2", files_per_task="1")
    for k in range(5):
        write(tmp_path / "in" / f"{k}.jpeg", bytes([k]), age=100 - k)
    ends = [source.latestOffset()["entry"] for _ in range(4)]
    assert ends == [1, 2, 3, 3]
    first = [p.files for p in source.partitions({"entry": 0}, {"entry": 1})]
    assert [f[0][0] for f in first] == ["0.jpeg", "1.jpeg"]
    again = reader(tmp_path)  # after a crash before the offset was written
    assert again.latestOffset() == {"entry": 3}
    assert [p.files for p in again.partitions({"entry": 0}, {"entry": 1})] == [[tuple(f) for own in first for f in own]]
    os.remove(tmp_path / "in" / "0.jpeg")  # a file that went away gives no row
    rows = [r for p in again.partitions({"entry": 0}, {"entry": 3}) for r in again.read(p)]
    assert len(rows) == 4


def test_the_log_stays_small(tmp_path):
    (tmp_path / "in").mkdir()
    source = reader(tmp_path)
    for k in range(150):
        write(tmp_path / "in" / f"{k}.png", b"x", age=1000 - k)
        end = source.latestOffset()
        source.commit(end)
        os.remove(tmp_path / "in" / f"{k}.png")  # routed elsewhere
    names = os.listdir(tmp_path / "log")
    assert end == {"entry": 150} and len(names) < 120 and sum(n.endswith(".whole") for n in names) <= 2
    whole = max((n for n in names if n.endswith(".whole")), key=lambda n: int(n[:-6]))
    assert len(json.loads((tmp_path / "log" / whole).read_text())) <= 1
    assert reader(tmp_path).latestOffset() == {"entry": 150}
