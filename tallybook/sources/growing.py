"""A stream over folders of JSON-lines files that grow: its offset is how far each file is read, so a trigger reads the bytes appended since the last one and no others.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").load(folder)

Rows: source, start_offset, next_offset, value of each complete line; a last line without its LF waits until it has one. Files come from any file system
that pyarrow reads (local or mounted, HDFS, object stores), named as the listing names them. A file that has become shorter than what was read of it is no longer followed; files that are gone
stay in the offset. The offset holds a number for each file, as Spark's own file source keeps a name for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "source string, start_offset bigint, next_offset bigint, value string"
#: Bytes of a file that one task reads, and that are read at once; bytes that the search for the last line end starts with.
SPLIT, CHUNK, LOOK_BACK = 32 << 20, 1 << 20, 1 << 12
#: Stretches that are a task each; of more, several share one. What opening a file costs, in bytes.
TASKS, OPENING = 64, 1 << 16


class Stretch(InputPartition):
    """The lines that start in [start, end) of a file; the last one ends at ``stop`` at the latest. Only at ``begins`` does a line start for certain."""

    def __init__(self, path: str, start: int, end: int, begins: int, stop: int):
        super().__init__(path)
        self.path, self.start, self.end, self.begins, self.stop = path, start, end, begins, stop
        #: Stretches that the same task reads after this one.
        self.more: list[Stretch] = []


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def last_line_end(files: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The end of the last complete line in [start, size), ``start`` if there is none. Reads from the end on."""
    width = LOOK_BACK
    with files.open_input_file(path) as f:
        high = size
        while high > start:
            low = max(start, high - width)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high, width = low, width * 2
    return start


def stretches(path: str, start: int, stop: int, split: int = SPLIT) -> list[Stretch]:
    return [Stretch(path, a, min(a + split, stop), start, stop) for a in range(start, stop, split)]


def dealt(parts: list[Stretch], split: int = SPLIT, tasks: int = TASKS) -> list[Stretch]:
    """Many small stretches in few tasks: each first one of a task with those that follow it."""
    if len(parts) <= tasks:
        return parts
    weight = lambda s: s.end - s.start + OPENING
    share, out, held = min(split, sum(map(weight, parts)) / tasks), [], 0.0
    for s in parts:
        if not out or held + weight(s) > share:
            out.append(s)
            held = 0
        else:
            out[-1].more.append(s)
        held += weight(s)
    return out


def lines_of(files: fs.FileSystem, own: Stretch, chunk: int = CHUNK, unfinished: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, line without its LF) of the lines of a stretch; with ``unfinished`` also a last one without an LF, whose end lies one byte behind the stretch."""
    with files.open_input_file(own.path) as f:
        at = own.start
        # a line that began before belongs to the stretch before; the byte ahead tells whether one begins here
        low = at if at == own.begins else at - 1
        f.seek(low)
        held, skip = b"", low < at
        place = low
        while place < own.end or held:
            more = f.read(min(chunk, own.stop - place - len(held)))
            held += more
            first = 0  # of the next line in what is held
            while (end := held.find(b"\n", first)) >= 0:
                if skip:
                    skip = False
                elif place < own.end:
                    yield place, place + end - first + 1, held[first:end]
                else:
                    return
                first, place = end + 1, place + end - first + 1
            held = held[first:]
            if not more:
                if unfinished and held and not skip and place < own.end:
                    yield place, place + len(held) + 1, held
                return


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def listed(self) -> list[tuple[str, int]]:
        files, path = file_system(self.folder)
        found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))

    def latestOffset(self) -> dict:
        """Where the last complete line of each file ends. Only files of another size than at the last call are opened, at their end."""
        files, _ = file_system(self.folder)
        known = getattr(self, "sizes", {})
        ends = getattr(self, "ends", {})
        for path, size in self.listed():
            if known.get(path) != size:
                before = ends.get(path, 0)
                ends[path] = last_line_end(files, path, before, size) if size > before else before
                known[path] = size
        self.sizes, self.ends = known, ends
        return {p: e for p, e in ends.items() if e}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found = [s for path, stop in sorted(end.items()) if stop > start.get(path, 0) for s in stretches(path, start.get(path, 0), stop, self.split)]
        return dealt(found, self.split) or [Stretch("", 0, 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        names, rows, size = ["source", "start_offset", "next_offset", "value"], [], 0
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        files, _ = file_system(self.folder)
        for own in [partition, *partition.more] if partition.path else []:
            for a, b, line in lines_of(files, own):
                rows.append((own.path, a, b, line.decode(errors="replace")))
                size += b - a
                if size >= CHUNK:
                    yield table()
                    rows, size = [], 0
        if rows:
            yield table()

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)
