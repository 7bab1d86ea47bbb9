"""Log files that grow: a streaming source that reads only the bytes appended since the last batch.

    spark.dataSource.register(GrowingLogs)
    lines = spark.readStream.format("growing_logs").option("path", root).option("state", folder).load()

An offset is the number of a state: each file's size, time and generation, in the order of their paths.  States lie as files in the folder ``state``, which
driver, executors and restarts share, so the offsets in Spark's own log stay small.  Planning lists folder by folder and walks the state before beside it, so
the driver holds what one folder has (and those above it), not all files.  What is new goes to a plan, a file beside the states, of which each partition is a
line.  Tasks read their line, look from where a file ended for its last line break, and read its lines, a file in ranges of ``range_bytes``.

A file that strictly grew goes on where it was left.  One that shrank, or changed without growing, was rewritten: it is read from its start under the
next generation, and what was read of an earlier generation no longer counts.  A last line without a line break waits for the next batch; with
``tails`` it is told each time as well, as not complete.  Files that vanish leave the state.

Paths may be of any file system that ``pyarrow.fs`` opens by URI on driver and executors (local or mounted, HDFS with its native
library, object stores).
"""

from __future__ import annotations

import fnmatch
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file_path string, generation bigint, line_no bigint, value string, complete boolean"
RANGE_BYTES = 64 << 20
#: Bytes read at once when looking for a line break, and lines and bytes told at once.
STEP, LINES, TOLD = 1 << 16, 10_000, 16 << 20
#: What opening a file costs, in bytes read meanwhile.
OPENING = 1 << 16
#: Bytes of a state or plan read at once, and files in a line of a state.
BUFFER, BLOCK = 1 << 18, 1_000


class Seen(NamedTuple):
    """A file's state.  What is read of it ends behind the last line break in its first size bytes."""

    path: str
    size: int
    mtime_ns: int
    generation: int


class Part(NamedTuple):
    """What a plan has of a file: bytes from start to end that are new at its size; was: its size when it was read before, where the first part starts."""

    path: str
    generation: int
    was: int
    start: int
    end: int
    size: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def last_break(source: pa.NativeFile, start: int, size: int) -> int:
    """The position after the last line break in the bytes from start to size; start if there is none."""
    end = size
    while end > start:
        begin = max(start, end - STEP)
        source.seek(begin)
        at = source.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def lines_between(source: pa.NativeFile, start: int, end: int, first: int, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin from start on and before end, which is no farther than a line break; first begins a line.

    With size, that of the file, nothing behind it is read, and its last line counts even if no line break ends it."""
    at = start
    if start > first:  # the line that reaches into the range belongs to the range before
        at, found = start - 1, False
        while not found:
            source.seek(at)
            chunk = source.read(STEP)
            k = chunk.find(b"\n")
            found = k >= 0 or not chunk
            at += k + 1 if k >= 0 else len(chunk)
    carry, position = b"", at
    while position < end:
        source.seek(position + len(carry))
        step = max(STEP, len(carry))
        chunk = source.read(step if size is None else min(step, size - position - len(carry)))
        if not chunk:
            if carry and size is not None:
                yield position, carry
            return
        *whole, carry = (carry + chunk).split(b"\n")
        for line in whole:
            if position >= end:
                return
            yield position, line
            position += len(line) + 1


def merged(now: Iterator[Seen], before: Iterator[Seen]) -> Iterator[tuple[Seen | None, Seen | None]]:
    """What stands in now and before of each path, both being in the order of their paths."""
    x, was = next(now, None), next(before, None)
    while x or was:
        if was is None or (x is not None and x.path < was.path):
            yield x, None
            x = next(now, None)
        elif x is None or was.path < x.path:
            yield None, was
            was = next(before, None)
        else:
            yield x, was
            x, was = next(now, None), next(before, None)


def told(path: str, start: int = 0, end: int | None = None) -> Iterator[list | dict]:
    """The lines of JSON of a state or plan, or those between two positions at which lines begin."""
    files, at = opened(path)
    with files.open_input_file(at) as f:
        f.seek(start)
        carry, left = b"", f.size() - start if end is None else end - start
        while left and (chunk := f.read(min(BUFFER, left))):
            left -= len(chunk)
            *whole, carry = (carry + chunk).split(b"\n")
            yield from map(json.loads, whole)
        if carry:
            yield json.loads(carry)


@dataclass
class Range:
    path: str
    generation: int
    start: int
    end: int
    #: Where a line surely begins: what was read before.
    first: int
    complete: bool = True


@dataclass
class Pack(InputPartition):
    """A line of a plan, from start to end, that one task reads: parts of range_bytes together, counting OPENING for each, or one larger.  A task for each of many small files would cost more than reading them."""

    plan: str
    start: int
    end: int
    root: str
    tails: bool

    @property
    def ranges(self) -> Iterator[Range]:
        """What there is to read, known only from the files: where the lines that were read before end, and where the last line does."""
        files, _ = opened(self.root)
        for part in itertools.starmap(Part, *told(self.plan, self.start, self.end)):
            with files.open_input_file(part.path) as f:
                first = last_break(f, 0, part.was)
                start = first if part.start == part.was else part.start
                done = last_break(f, first, part.size)
            if start < min(part.end, done):
                yield Range(part.path, part.generation, start, min(part.end, done), first)
            if self.tails and part.end == part.size > done:
                yield Range(part.path, part.generation, done, part.size, done, False)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.state_folder = options["state"].rstrip("/")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.tails = options.get("tails", "false").lower() == "true"

    # states

    def _state_path(self, offset: dict) -> str:
        return f"{self.state_folder}/{offset['n']:012d}-{offset['id']}.json"

    def states(self, offset: dict) -> Iterator[Seen]:
        """A state, a file after the other."""
        for block in told(self._state_path(offset)) if offset["n"] else ():
            if isinstance(block, dict):  # as states were written before, in one: how far a file was read stands first
                yield from (Seen(path, *was[1:]) for path, was in block.items())
            else:
                yield from itertools.starmap(Seen, block)

    def load(self, offset: dict) -> dict[str, Seen]:
        """A state as a whole: a row a file.  Planning does without."""
        return {x.path: x for x in self.states(offset)}

    # the source

    def initialOffset(self) -> dict:
        return {"n": 0, "id": ""}

    def listed(self, files: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
        """The files below a folder in the order of their paths; of each folder on the way its own entries are held."""
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found.sort(key=lambda i: i.path + "/" if i.type == fs.FileType.Directory else i.path, reverse=True)
        while found:
            info = found.pop()
            if info.type == fs.FileType.Directory:
                yield from self.listed(files, info.path)
            elif info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob):
                yield info

    def latestOffset(self) -> dict:
        at = getattr(self, "_at", None) or self.newest()
        offset, changed = {"n": at["n"] + 1, "id": uuid.uuid4().hex}, False
        logs, root = opened(self.root)
        files, path = opened(self._state_path(offset))
        files.create_dir(path.rpartition("/")[0], recursive=True)

        def state() -> Iterator[Seen]:
            nonlocal changed
            now = (Seen(i.path, i.size, i.mtime_ns, 0) for i in self.listed(logs, root))
            for x, was in merged(now, self.states(at)):
                if x is not None and was is not None:
                    goes_on = x.size > was.size or x[1:3] == was[1:3]
                    x = x._replace(generation=was.generation + (not goes_on))
                changed |= x != was
                if x is not None:
                    yield x

        with files.open_output_stream(f"{path}.part", buffer_size=BUFFER) as f:
            for block in itertools.batched(state(), BLOCK):
                f.write(json.dumps(block).encode() + b"\n")
        if changed:
            files.move(f"{path}.part", path)  # only whole states have their name
        else:
            files.delete_file(f"{path}.part")
        self._at = offset if changed else at
        return self._at

    def newest(self) -> dict:
        """The last state there is, so that a restart goes on from what was planned."""
        files, folder = opened(self.state_folder)
        names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.endswith(".json"))
        if not names:
            return self.initialOffset()
        n, _, name = names[-1].removesuffix(".json").partition("-")
        return {"n": int(n), "id": name}

    def parts(self, start: dict, end: dict) -> Iterator[Part]:
        for x, was in merged(self.states(end), self.states(start)):
            if x is None or (was and was.size == x.size and was.generation == x.generation):
                continue
            first = was.size if was and was.generation == x.generation else 0
            for at in range(first, x.size, self.range_bytes):
                yield Part(x.path, x.generation, first, at, min(at + self.range_bytes, x.size), x.size)

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        if start == end:
            return []
        packs: list[Pack] = []
        plan = self._state_path(end).removesuffix("json") + f"{uuid.uuid4().hex}.plan"
        files, path = opened(plan)
        with files.open_output_stream(path, buffer_size=BUFFER) as f:
            room = at = 0
            line: list[Part] = []

            def close() -> None:
                nonlocal at
                written = json.dumps(line).encode() + b"\n"
                f.write(written)
                packs.append(Pack(plan, at, at + len(written), self.root, self.tails))
                at += len(written)
                line.clear()

            for part in self.parts(start, end):
                cost = part.end - part.start + OPENING
                if room < cost:
                    if line:
                        close()
                    room = self.range_bytes
                line.append(part)
                room -= cost
            if line:
                close()
        return packs

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        names, kinds = ["file_path", "generation", "line_no", "value", "complete"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        rows: list[tuple[str, int, int, str, bool]] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        held = 0
        for r in partition.ranges:  # lines of many small files are told together
            for at, line in self.lines_of(r):
                rows.append((r.path, r.generation, at, line.decode("utf-8", "replace"), r.complete))
                held += len(line)
                if len(rows) == LINES or held > TOLD:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    def lines_of(self, r: Range) -> Iterator[tuple[int, bytes]]:
        files, _ = opened(self.root)
        with files.open_input_file(r.path) as f:
            if r.complete:
                yield from lines_between(f, r.start, r.end, r.first)
            else:
                f.seek(r.start)
                yield r.start, f.read(r.end - r.start)

    def commit(self, end: dict) -> None:
        """States before the committed one are no longer needed, nor are the plans up to it and what was not written to its end."""
        files, folder = opened(self.state_folder)
        for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            n = i.base_name.partition("-")[0]
            if n.isdigit() and int(n) < end["n"] + (-1 if i.base_name.endswith(".json") else 1):
                files.delete_file(i.path)


class GrowingLogs(DataSource):
    """Options: path, state, and glob ("*.jsonl"), range_bytes, tails.  line_no is a line's position in bytes, which orders the lines of a file."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingReader:
        return GrowingReader(dict(self.options))


def latest_generation(lines: DataFrame) -> DataFrame:
    """The lines of each file as last written, from all that were read."""
    last = lines.groupBy("file_path").agg(F.max("generation").alias("generation"))
    return lines.join(last, ["file_path", "generation"])
