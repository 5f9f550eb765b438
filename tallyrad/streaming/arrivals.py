"""New files of a folder as a stream, each once it has settled.

A file that is still being written is held back and comes in a later batch; a file that is written again is a new
arrival. What came in which batch is kept in a log of the source's own, an entry for each batch, so a restarted query
goes on where it was and a repeated batch names the same files. Only names, sizes and times go through the driver;
the executors read the contents.
"""

from __future__ import annotations

import datetime
import json
import os
import time
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

IMAGES = "png,jpg,jpeg"
#: Entries of the log after which what is known is written down as a whole, and entries kept before that.
WHOLE_EVERY, KEPT = 20, 100


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(files)
        self.files = files


class Folder:
    """Listing, reading and small writes in a folder given by a path or an URI."""

    def __init__(self, uri: str):
        plain = "://" not in uri and not uri.startswith("file:")
        self.store, self.path = fs.FileSystem.from_uri(f"file://{os.path.abspath(uri)}" if plain else uri)

    def files(self) -> list[fs.FileInfo]:
        """What lies in the folder itself, not below it."""
        found = self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return [f for f in found if f.is_file]

    def read(self, name: str) -> bytes | None:
        """The content of a file, none if the file is gone."""
        try:
            with self.store.open_input_stream(f"{self.path}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, name: str, content: bytes) -> None:
        """Writes a file so that readers see all of it or none."""
        self.store.create_dir(self.path)
        draft = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as f:
            f.write(content)
        self.store.move(draft, f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self.store.delete_file(f"{self.path}/{name}")


class ArrivalLog:
    """Entries 1, 2, 3, ... of a log, each a list of files (name, size, time in milliseconds)."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def entry(self, n: int) -> list[tuple[str, int, int]]:
        content = self.folder.read(f"{n}.json")
        if content is None:
            raise FileNotFoundError(f"entry {n} of the log of arrivals is gone")
        return [tuple(f) for f in json.loads(content)]

    def load(self) -> tuple[int, dict[str, tuple[int, int]]]:
        """The last entry's number, and what is known: size and time of each file as it came last."""
        names = [f.base_name for f in self.folder.files()]
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        wholes = sorted(int(n[:-6]) for n in names if n.endswith(".whole") and n[:-6].isdigit())
        start = wholes[-1] if wholes else 0
        known = {n: tuple(x) for n, x in json.loads(self.folder.read(f"{start}.whole") or "{}").items()}
        for n in (n for n in numbers if n > start):
            known |= {name: (size, at) for name, size, at in self.entry(n)}
        return max([start, *numbers]), known

    def append(self, n: int, files: list[tuple[str, int, int]], known: dict[str, tuple[int, int]]) -> None:
        self.folder.put(f"{n}.json", json.dumps(files).encode())
        if n % WHOLE_EVERY == 0:
            self.folder.put(f"{n}.whole", json.dumps(known).encode())

    def forget(self, upto: int) -> None:
        """Entries that a whole has in it and that no batch can ask for any more go."""
        names = [f.base_name for f in self.folder.files()]
        wholes = sorted(int(n[:-6]) for n in names if n.endswith(".whole"))
        keep = [w for w in wholes if w <= upto]
        for name in names:
            number, _, kind = name.partition(".")
            if keep and number.isdigit() and int(number) < (keep[-1] if kind == "whole" else min(keep[-1], upto - KEPT)):
                self.folder.drop(name)


class Settling(DataSourceStreamReader):
    """Offsets are numbers of log entries. A file is settled when it has content and either its time lies back by
    `quiet` or it stood unchanged for that long since it was first looked at."""

    def __init__(self, options: dict):
        self.uri, self.quiet = options["path"], int(options.get("quiet_ms", 800))
        self.endings = tuple(f".{e.strip().lower()}" for e in options.get("endings", IMAGES).split(","))
        self.most = int(options.get("files_per_batch", 1000))
        self.per_task = int(options.get("files_per_task", 16))
        self.log_uri = options["log"]
        self.state: tuple[int, dict] | None = None
        self.looks: dict[str, tuple[int, int, float]] = {}

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def settled(self) -> list[tuple[str, int, int]]:
        """Files of the folder that have settled and aren't known, oldest first."""
        _, known = self.state
        now, tick, found, looks = time.time() * 1000, time.monotonic() * 1000, [], {}
        listed = [f for f in Folder(self.uri).files() if f.base_name.lower().endswith(self.endings)]
        for f in listed:
            is_now = (f.size, f.mtime_ns // 1_000_000)
            if known.get(f.base_name) == is_now:
                continue
            *before, since = self.looks.get(f.base_name, (None, None, tick))
            since = since if tuple(before) == is_now else tick
            looks[f.base_name] = (*is_now, since)
            if f.size and (is_now[1] <= now - self.quiet or tick - since >= self.quiet):
                found.append((f.base_name, *is_now))
        self.looks = looks
        there = {f.base_name for f in listed}
        for name in [n for n in known if n not in there]:
            del known[name]  # moved away; what is known stays as large as the folder
        return sorted(found, key=lambda x: (x[2], x[0]))[: self.most]

    def latestOffset(self) -> dict:
        log = ArrivalLog(Folder(self.log_uri))
        if self.state is None:
            self.state = log.load()
        new, (last, known) = self.settled(), self.state
        if new:
            known |= {name: (size, at) for name, size, at in new}
            last += 1
            log.append(last, new, known)
            self.state = last, known
        return {"entry": last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        log = ArrivalLog(Folder(self.log_uri))
        files = [f for n in range(start["entry"] + 1, end["entry"] + 1) for f in log.entry(n)]
        return [Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        """A file that went away meanwhile gives no row."""
        folder = Folder(self.uri)
        for name, size, at in partition.files:
            content = folder.read(name)
            if content is not None:
                yield f"{self.uri.rstrip('/')}/{name}", datetime.datetime.fromtimestamp(at / 1000, datetime.timezone.utc), size, content

    def commit(self, end: dict) -> None:
        ArrivalLog(Folder(self.log_uri)).forget(end["entry"])


class Arrivals(DataSource):
    """Options: path (the folder), log (a folder of the source's own, one for each query), quiet_ms, endings,
    files_per_batch, files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long, content binary"

    def streamReader(self, schema) -> Settling:
        return Settling(dict(self.options))


def settled_files(spark: SparkSession, folder: str, log: str, **options) -> DataFrame:
    """A stream of the folder's files, each as it has settled: path, modificationTime, length, content."""
    spark.dataSource.register(Arrivals)
    return spark.readStream.format(Arrivals.name()).options(path=folder, log=log, **options).load()
