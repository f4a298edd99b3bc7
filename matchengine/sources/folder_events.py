"""A stream of what happens to a folder's files: created, modified, moved and deleted.

The source's offset is the number of a listing. Each time Spark asks for the latest offset the folder is listed; if the
listing differs from the last one it is written below ``state`` under the next number. A batch is the difference of two
listings, told by several tasks, each of which has the paths of one hash. As listings are kept until their batch is
committed, a query that restarts from its checkpoint tells the same batch again, and nothing twice.
"""

from __future__ import annotations

import datetime
import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from matchengine.operators.ingest import SUFFIXES

SCHEMA = "event_type string, path string, old_path string, observed_at timestamp, size long"
TASKS = 8
Listing = dict[str, list]  # path to [time in seconds, size]


def difference(old: Listing, new: Listing) -> Iterator[tuple[str, str, str | None, float, int]]:
    """(event_type, path, old_path, time, size). A path that is gone and one that is new with the same time and size are a
    move, if no other one of either kind has them."""
    gone, come = {p: v for p, v in old.items() if p not in new}, {p: v for p, v in new.items() if p not in old}
    by_look: dict[tuple, tuple[list[str], list[str]]] = {}
    for side, paths in enumerate((gone, come)):
        for p, v in paths.items():
            by_look.setdefault(tuple(v), ([], []))[side].append(p)
    moved = {b[0]: a[0] for a, b in by_look.values() if len(a) == len(b) == 1}
    for p, (t, n) in new.items():
        if p in moved:
            yield "moved", p, moved[p], t, n
        elif p not in old:
            yield "created", p, None, t, n
        elif old[p] != [t, n]:
            yield "modified", p, None, t, n
    for p in sorted(gone.keys() - set(moved.values())):
        yield "deleted", p, None, *gone[p]


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        from pyarrow import fs

        self.folder, self.state = options["path"], options["state"]
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))
        self.store = lambda path: fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def _list(self) -> Listing:
        from pyarrow import fs

        store, inside = self.store(self.folder)
        every = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
        return {f.path: [f.mtime.timestamp(), f.size] for f in sorted(every, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(self.suffixes)}

    def _path(self, n: int) -> tuple:
        store, inside = self.store(self.state)
        return store, f"{inside.rstrip('/')}/{n:012d}.json"

    def _load(self, n: int) -> Listing:
        if not n:
            return {}
        store, path = self._path(n)
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _newest(self) -> int:
        from pyarrow import fs

        store, inside = self.store(self.state)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if f.base_name.endswith(".json")]
        return max((int(x[:-5]) for x in names), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        n, now = self._newest(), self._list()
        if now != self._load(n):
            n += 1
            store, path = self._path(n)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path + ".part") as f:
                f.write(json.dumps(now).encode())
            store.move(path + ".part", path)
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((start["listing"], end["listing"], k)) for k in range(TASKS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b, k = partition.value
        for kind, path, old, t, size in difference(self._load(a), self._load(b)):
            if zlib.crc32(path.encode()) % TASKS == k:
                yield kind, path, old, datetime.datetime.fromtimestamp(t, datetime.UTC), size

    def commit(self, end: dict) -> None:
        """Listings before the committed one are not asked for again."""
        n = end["listing"] - 1
        while n > 0:
            store, path = self._path(n)
            if not store.get_file_info(path).is_file:
                break
            store.delete_file(path)
            n -= 1


class FolderEvents(DataSource):
    """format("folder_events") with the options path, state (a folder that the cluster shares) and suffixes."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def changes(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """SCHEMA as a stream; ``state`` belongs to one query, as its checkpoint does."""
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format("folder_events").option("state", state).load(folder)
