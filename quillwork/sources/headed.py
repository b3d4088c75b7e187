"""Headed lists as a splittable source: "$head" lines, and their members on the lines that follow.

    spark.dataSource.register(HeadedList)
    spark.read.format("headed_list").option("split_bytes", 1 << 27).load(folder)

Files are read in ranges of bytes, each a task.  A line belongs to the range in which it
starts.  A range does not know the head that its first members stand under: by default it
looks back for it, block by block; with carry=none it leaves the head null and the
reader (readers.read_headed_list) carries heads over by a prefix scan of the ranges'
last heads, which parts=heads gives, read from each range's end.  So no group is too large.

Paths are those of pyarrow's file systems (local, hdfs, s3, gs).  A file whose name ends in
.gz is one range.  Encodings in which a line feed is one byte of its own are taken: ASCII's
extensions, not UTF-16.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "path string, range long, pos long, head string, line string"
HEADS = "path string, range long, head string"
SPLIT_BYTES, BLOCK, BATCH = 1 << 27, 1 << 16, 10_000
#: White space of any script, as the library's `strip` has it.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    whole: bool


class HeadedList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "headed_list"

    def schema(self) -> str:
        return HEADS if self.options.get("parts") == "heads" else LINES

    def reader(self, schema) -> HeadedListReader:
        return HeadedListReader(dict(self.options))


class HeadedListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.encoding = options.get("encoding", "ISO-8859-1")
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))
        self.heads, self.look_back = options.get("parts") == "heads", options.get("carry", "look back") != "none"

    def _system(self):
        from pyarrow import fs

        if "://" not in self.root and not self.root.startswith("file:"):
            return fs.LocalFileSystem(), self.root
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.root))

    def partitions(self) -> list[Range]:
        """Ranges of all files, by their sizes alone; names that start with . or _ are passed over, as Spark does."""
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not re.search(r"(?:^|/)[._]", f.path[len(root) :])]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            packed = f.path.endswith(".gz")
            out += [Range(f.path, a, f.size if packed else min(a + self.split, f.size), packed) for a in range(0, f.size, f.size if packed else self.split)]
        return out

    def _text(self, line: bytes) -> str:
        return line.decode(self.encoding, "replace").strip(_WHITE)

    def _lines(self, file, start: int, end: float, block: int) -> Iterator[tuple[int, bytes]]:
        """Lines that start in [start, end), with their places; the file stands at start - 1, or at 0."""
        at, rest = max(0, start - 1), b""
        # What stands before the first line feed belongs to the range before; a line feed just before the start ends that one.
        skipping = start > 0
        while True:
            more = file.read(block)
            parts = (rest + more).split(b"\n")
            rest = parts.pop()
            for p in parts:
                if not skipping:
                    if at >= end:
                        return
                    yield at, p
                skipping = False
                at += len(p) + 1
            if not more:
                if not skipping and rest and at < end:
                    yield at, rest
                return
            if not skipping and at >= end:
                return

    def _opened(self, part: Range):
        system, _ = self._system()
        if part.whole:
            return system.open_input_stream(part.path, compression="gzip")
        file = system.open_input_file(part.path)
        file.seek(max(0, part.start - 1))
        return file

    def _last_head(self, part: Range, lowest: int) -> str | None:
        """The last head that starts in [lowest, part.end), read backwards block by block."""
        system, _ = self._system()
        with system.open_input_file(part.path) as file:
            size = file.size()
            stop, tail = part.end, b""
            # A line that starts before the end may go on behind it.
            file.seek(stop)
            if stop < size:
                file.seek(stop - 1)
                if file.read(1) != b"\n":
                    while (more := file.read(BLOCK)) and b"\n" not in more:
                        tail += more
                    tail += more.split(b"\n")[0]
            while True:
                start = max(0, lowest - 1, stop - BLOCK) if stop > lowest else stop
                file.seek(start)
                chunk = file.read(stop - start) + tail
                lines = chunk.split(b"\n")
                # The first is whole only where a file starts; at the lowest place it belongs to the range before.
                first = lines.pop(0) if start > 0 else b""
                for line in reversed(lines):
                    if (text := self._text(line)).startswith("$"):
                        return text
                if start <= max(0, lowest - 1):
                    return None
                stop, tail = start, first

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if self.heads:
            yield from self._read_heads(part)
            return
        head = self._last_head(Range(part.path, 0, part.start, False), 0) if self.look_back and part.start > 0 else None
        pos, heads, lines = [], [], []

        def batch() -> pa.RecordBatch:
            n = len(pos)
            return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array([part.start] * n, pa.int64()), pa.array(pos, pa.int64()), pa.array(heads, pa.string()), pa.array(lines, pa.string())], ["path", "range", "pos", "head", "line"])

        with self._opened(part) as file:
            for at, raw in self._lines(file, part.start, float("inf") if part.whole else part.end, BLOCK):
                text = self._text(raw)
                if text.startswith("$"):
                    head = text
                elif text:
                    pos.append(at)
                    heads.append(head)
                    lines.append(text)
                    if len(pos) == BATCH:
                        yield batch()
                        pos, heads, lines = [], [], []
        if pos:
            yield batch()

    def _read_heads(self, part: Range) -> Iterator[pa.RecordBatch]:
        # The one range of a packed file has none after it.
        last = None if part.whole else self._last_head(part, part.start)
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.start], pa.int64()), pa.array([last], pa.string())], ["path", "range", "head"])
