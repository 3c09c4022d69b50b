"""Files that grow: a data source that reads whole new lines from byte offsets, in batch and as a stream.

Spark's own file streams take files for immutable. Offsets here are bytes at line ends; a file that shrinks
below its offset, or whose time goes backwards, is read anew from 0, after a row with control ``rollback``
and the new bytes' hash as its line. Files are read in byte ranges, a task each, and leave as Arrow batches;
the driver looks at sizes, times and the last bytes before a file's end only. Files must be on a path that
the driver and all executors can open.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_path string, byte_start long, byte_end long, line string, control string"
SPLIT = 64 << 20


def complete_lines(data: bytes) -> tuple[list[bytes], int]:
    """Lines that end with a line feed, and how many bytes they take; the rest is pending."""
    end = data.rfind(b"\n") + 1
    return (data[:end].split(b"\n")[:-1], end)


def prefix_hash(path: str, length: int) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while length > 0 and (part := f.read(min(length, 1 << 20))):
            h.update(part)
            length -= len(part)
    return "sha256:" + h.hexdigest()


def scan(path: str, cursor: dict | None) -> dict:
    """One look at a file: change (none, grown, rollback, unavailable), and the range of whole new lines.

    cursor: safe_offset, size, mtime. A file that gets shorter between two looks is unavailable.
    """
    try:
        st = os.stat(path)
    except OSError as e:
        return {"change": "unavailable", "reason": type(e).__name__, "cursor": cursor}
    old = cursor or {"safe_offset": 0, "size": 0, "mtime": 0}
    rolled = bool(cursor) and (st.st_size < old["safe_offset"] or st.st_mtime_ns < old["mtime"])
    start = 0 if rolled else old["safe_offset"]
    seen = {"safe_offset": start, "size": st.st_size, "mtime": st.st_mtime_ns}
    if st.st_size == start and not rolled:
        return {"change": "none", "start": start, "end": start, "cursor": seen}
    try:
        end = _last_line_end(path, start, st.st_size)
    except OSError as e:
        return {"change": "unavailable", "reason": type(e).__name__, "cursor": cursor}
    return {"change": "rollback" if rolled else "grown" if end > start else "none", "start": start, "end": end, "cursor": seen | {"safe_offset": end}}


def _last_line_end(path: str, start: int, size: int) -> int:
    """The offset after the last line feed in [start, size), found from the back."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            low = max(start, at - (1 << 16))
            f.seek(low)
            part = f.read(at - low)
            if len(part) < at - low:
                raise OSError("the file got shorter")
            if (k := part.rfind(b"\n")) >= 0:
                return low + k + 1
            at = low
    return start


class Range(InputPartition):
    """The lines of one file that begin in [start, end); whole lines fill [first, last)."""

    def __init__(self, path: str, start: int, end: int, first: int, last: int, control: str | None) -> None:
        super().__init__(None)
        self.path, self.start, self.end, self.first, self.last, self.control = path, start, end, first, last, control


def ranges(path: str, first: int, last: int, control: str | None, split: int) -> list[InputPartition]:
    """[first, last) in parts of ``split`` bytes; one at least, if there is a control row to send."""
    cuts = [*range(first, last, split), last]
    parts = [Range(path, s, e, first, last, None) for s, e in zip(cuts, cuts[1:])]  # noqa: B905
    return [Range(path, first, first, first, last, control), *parts] if control else parts


def _lines(p: Range) -> Iterator[tuple[bytes, int, int]]:
    with open(p.path, "rb") as f:
        at = p.start
        if p.start > p.first:  # the line that an earlier range began
            f.seek(p.start - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < p.end:
            line = f.readline()
            if not line or at + len(line) > p.last:
                raise OSError(f"{p.path} got shorter while it was read")
            yield line.rstrip(b"\n"), at, at + len(line)
            at += len(line)


def _batches(p: Range, most: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    def out(at: list, ends: list, lines: list, control: str | None = None) -> pa.RecordBatch:
        n = len(at)
        cols = [pa.array([p.path] * n, pa.string()), pa.array(at, pa.int64()), pa.array(ends, pa.int64()), pa.array(lines, pa.string()), pa.array([control] * n, pa.string())]
        return pa.record_batch(cols, names=["source_path", "byte_start", "byte_end", "line", "control"])

    if p.control:
        yield out([p.first], [p.last], [prefix_hash(p.path, p.last)], p.control)
    at, ends, lines = [], [], []
    for line, start, end in _lines(p):
        at.append(start)
        ends.append(end)
        lines.append(line.decode("utf-8", "replace"))
        if len(at) == most or end - at[0] >= size:
            yield out(at, ends, lines)
            at, ends, lines = [], [], []
    if at:
        yield out(at, ends, lines)


def _files(options: dict) -> list[str]:
    listed = json.loads(options["paths"]) if "paths" in options else []
    if "path" in options:
        for folder, _, names in os.walk(options["path"]):
            listed += [os.path.join(folder, n) for n in names if n.endswith(options.get("suffix", ".jsonl"))]
    return sorted(set(listed))


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.cursors = json.loads(options.get("cursors", "{}"))
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        looks = [(p, scan(p, self.cursors.get(p))) for p in _files(self.options)]
        out = [r for p, s in looks if s["change"] in ("grown", "rollback") for r in ranges(p, s["start"], s["end"], "rollback" if s["change"] == "rollback" else None, self.split)]
        return out or [Range("", 0, 0, 0, 0, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.split = int(options.get("split", SPLIT))
        self.last: dict = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for p in _files(self.options):
            s = scan(p, self.last.get(p))
            if s["cursor"] is not None:
                self.last[p] = s["cursor"]
        return {"files": json.dumps(self.last, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges between two offsets. A file was rolled back if it ends before its old offset or its time went backwards: a restarted stream tells so too."""
        a, b = json.loads(start["files"]), json.loads(end["files"])
        out: list[InputPartition] = []
        for p, c in sorted(b.items()):
            old = a.get(p, {"safe_offset": 0, "mtime": 0})
            rolled = c["safe_offset"] < old["safe_offset"] or c["mtime"] < old["mtime"]
            out += ranges(p, 0 if rolled else old["safe_offset"], c["safe_offset"], "rollback" if rolled else None, self.split)
        return out or [Range("", 0, 0, 0, 0, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        return None


class GrowingLog(DataSource):
    """Format ``growing_log``. Options: path (a folder) or paths (JSON list), suffix, cursors (JSON map), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def load_cursors(path: str) -> tuple[dict, str | None]:
    """Saved cursors and a warning; a missing or broken file gives none."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f), None
    except FileNotFoundError:
        return {}, None
    except (OSError, ValueError) as e:
        return {}, f"{path}: {type(e).__name__}"


def save_cursors(path: str, cursors: dict) -> None:
    draft = f"{path}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(cursors, f, sort_keys=True)
    os.replace(draft, path)
