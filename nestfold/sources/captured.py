"""Captured pages and click logs as Spark data sources.

``captured_pages`` reads the pages of each source one after the other and opens none behind the one where a
newest-first reader stops; many small pages may share a folder. ``click_log`` is a stream over captured update files with offsets of its own: the next update
number, as the service that sends updates counts them. Files are reached through Arrow's file systems (local, HDFS, S3, GS).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import merge
from itertools import chain, count, groupby

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def _names(files: fs.FileSystem, folder: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found)


def _lines(files: fs.FileSystem, path: str) -> Iterator[str]:
    with files.open_input_stream(path, compression="detect") as held:
        rest = b""
        while chunk := held.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            yield from (line.decode() for line in lines if line)
        if rest:
            yield rest.decode()


@dataclass
class OneSource(InputPartition):
    name: str


class PagesReader(DataSourceReader):
    """Options: ``path`` (holds ``source=<name>/page=<number>/`` with JSON lines), ``fresh_field`` and ``fresh_since`` (a row
    whose field is that or larger is fresh), ``last_field`` (true in a row of the last page), ``max_page``, ``span``.

    With a ``span`` of n > 1, n pages share a folder ``source=<name>/pages=<first>-<last>/`` (1-n, n+1-2n ...), and rows say
    their ``page``; each file is in the order of pages, and so read no further than the reader goes.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        files, root = file_system(self.options["path"])
        return [OneSource(n.removeprefix("source=")) for n in _names(files, root) if n.startswith("source=")] or [OneSource("")]

    def _pages(self, name: str) -> Iterator[tuple[int, Iterator[tuple[dict, str]]]]:
        """The pages of a source in order, each with its rows and their lines, up to a folder that is missing."""
        files, root = file_system(self.options["path"])
        span = int(self.options.get("span", 1))
        for first in count(1, span):
            folder = f"{root}/source={name}/" + (f"page={first}" if span == 1 else f"pages={first}-{first + span - 1}")
            parts = [n for n in _names(files, folder) if not n.startswith(("_", "."))]
            if not parts:
                return
            read = [((json.loads(line), line) for line in _lines(files, f"{folder}/{part}")) for part in parts]
            if span == 1:
                yield first, chain.from_iterable(read)
            else:
                yield from groupby(merge(*read, key=lambda r: r[0]["page"]), lambda r: r[0]["page"])

    def read(self, partition: OneSource) -> Iterator[tuple]:
        most = int(self.options.get("max_page", 0))
        for nth, (page, rows) in enumerate(self._pages(partition.name), 1):
            if page < nth:
                raise ValueError(f"source {partition.name}: a file holds page {page} behind a later one")
            if page > nth or most and page > most:
                return
            fresh = last = False
            for row, line in rows:
                last |= bool(row.get(self.options.get("last_field", "")))
                seen = row.get(self.options["fresh_field"])
                if seen is not None and str(seen) >= self.options["fresh_since"]:
                    fresh = True
                    yield partition.name, page, line
            if not fresh or last:
                return


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "source string, page int, payload string"

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(dict(self.options))


@dataclass
class Updates(InputPartition):
    path: str
    start: int
    end: int


class ClickLogReader(DataSourceStreamReader):
    """Options: ``path`` with files ``updates-<first>-<last>.json`` of JSON lines (update_id, ts, user_id, data), or
    folders ``updates=<first>-<last>`` of such files, as Spark writes them.

    The offset is the next update number. A committed offset is written down as ``_confirmed``: updates before it
    were processed, as for the service that is told the largest number and one.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def _files(self) -> list[tuple[int, int, str]]:
        files, root = file_system(self.options["path"])
        named = [(re.fullmatch(r"updates[-=](\d+)-(\d+)(?:\.json)?", n), n) for n in _names(files, root)]
        return sorted((int(m[1]), int(m[2]), f"{root}/{n}") for m, n in named if m)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": max((last + 1 for _, last, _ in self._files()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Updates(p, start["next"], end["next"]) for first, last, p in self._files() if last >= start["next"] and first < end["next"]]

    def read(self, partition: Updates) -> Iterator[tuple]:
        files, _ = file_system(self.options["path"])
        paths = [partition.path]
        if not partition.path.endswith(".json"):
            paths = [f"{partition.path}/{n}" for n in _names(files, partition.path) if not n.startswith(("_", "."))]
        for path in paths:
            for line in _lines(files, path):
                row = json.loads(line)
                if partition.start <= row["update_id"] < partition.end:
                    yield row["update_id"], row.get("ts"), row.get("user_id"), row.get("data")

    def commit(self, end: dict) -> None:
        files, root = file_system(self.options["path"])
        with files.open_output_stream(f"{root}/_confirmed") as out:
            out.write(json.dumps(end).encode())


class ClickLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "click_log"

    def schema(self) -> str:
        return "update_id bigint, ts string, user_id bigint, data string"

    def streamReader(self, schema: StructType) -> ClickLogReader:  # noqa: N802
        return ClickLogReader(dict(self.options))


def confirmed(path: str) -> int:
    """The next update that a stream over this log hasn't committed yet."""
    files, root = file_system(path)
    if files.get_file_info(f"{root}/_confirmed").type == fs.FileType.NotFound:
        return 0
    with files.open_input_stream(f"{root}/_confirmed") as held:
        return json.loads(held.read())["next"]


def register(spark: SparkSession) -> None:
    for source in (CapturedPages, ClickLog):
        spark.dataSource.register(source)
