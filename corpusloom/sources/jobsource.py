"""Job results of a document parser as a Spark source: ``spark.read.format("parse_jobs")``.

A parser leaves its answers as JSON, one job a line, in files of a folder (any store that Arrow opens).
The batch reader lists the folder on the driver and deals the files out by bytes; long files are cut
at byte positions, and a line belongs to the part in which it begins. The stream reader's offsets are
the (time, path) of the last file taken, so a restarted query goes on where its checkpoint stands.
Reading has no side effects: a part that is read again, after a failure or by a second attempt, gives
the same rows.

Options: ``path``; ``state`` keeps the jobs of one state; ``partBytes`` (64 MB) bounds a part;
``suffix`` (.json) selects files; ``settleSeconds`` (0) leaves younger files to the next micro-batch;
``mode``: ``permissive`` (default) gives a line that is no JSON object the state MALFORMED,
``failfast`` raises. Files whose names begin with _ or . are skipped.

    corpusloom.sources.jobsource.register(spark)
    spark.read.format("parse_jobs").option("state", "SUCCESS").load("s3://bucket/results")
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "job_id string, state string, markdown string, text string, file string"
PART_BYTES, READ_BYTES, ROWS, ROW_BYTES = 64 << 20, 1 << 20, 1000, 4 << 20


@dataclass
class Part(InputPartition):
    """Lines that begin at the bytes from start on and before end of each file."""

    files: list[tuple[str, int, int]]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Folder:
    """What batch and stream share: listing, dealing out, reading."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("parse_jobs needs a path")
        self.folder, self.state = options["path"], options.get("state")
        self.part_bytes, self.suffix = int(options.get("partbytes", PART_BYTES)), options.get("suffix", ".json")
        self.settle, self.mode = float(options.get("settleseconds", 0)), options.get("mode", "permissive").lower()
        if self.mode not in ("permissive", "failfast"):
            raise ValueError(f"mode {self.mode!r}")

    def listed(self) -> list[tuple[int, str, int]]:
        """(time, path, bytes) of the files, oldest first."""
        from pyarrow import fs

        store, base = _open(self.folder)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and f.base_name[0] not in "_." and f.size)

    def parts(self, files: list[tuple[int, str, int]]) -> list[Part]:
        out, room = [], 0
        for _, path, size in files:
            for start in range(0, size, self.part_bytes):
                n = min(self.part_bytes, size - start)
                if not out or n > room:
                    out.append(Part([]))
                    room = self.part_bytes
                out[-1].files.append((path, start, start + n))
                room -= n
        return out

    def lines(self, path: str, start: int, end: int) -> Iterator[bytes]:
        """One line at a time; a block at a time is read."""
        store, _ = _open(self.folder)
        with store.open_input_file(path) as f:
            # The byte before tells whether a line begins at start.
            at = max(0, start - 1)
            f.seek(at)
            rest, first = b"", start > 0
            while block := f.read(READ_BYTES):
                pieces = (rest + block).split(b"\n")
                rest = pieces.pop()
                for line in pieces:
                    if not first:
                        yield line
                    first = False
                    at += len(line) + 1
                    if at >= end:
                        return
            if rest and not first:
                yield rest

    def rows(self, part: Part) -> Iterator:
        import pyarrow as pa

        names = ["job_id", "state", "markdown", "text", "file"]
        schema = pa.schema([(x, pa.string()) for x in names])
        rows, size = [], 0
        for path, start, end in part.files:
            for line in self.lines(path, start, end):
                if not line.strip():
                    continue
                row = (*self.parsed(line, path), path.rsplit("/", 1)[-1])
                if self.state is None or row[1] == self.state:
                    rows.append(row)
                    size += len(line)
                if len(rows) >= ROWS or size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)

    def parsed(self, line: bytes, path: str) -> tuple[str | None, str | None, str | None, str | None]:
        """(job_id, state, markdown, text); values that are no strings as their JSON; no state is PENDING."""
        try:
            job = json.loads(line)
        except ValueError:
            job = None
        if not isinstance(job, dict):
            if self.mode == "failfast":
                raise ValueError(f"{path}: a line is no JSON object")
            return None, "MALFORMED", None, None
        value = lambda k: v if (v := job.get(k)) is None or isinstance(v, str) else json.dumps(v)
        return value("job_id"), value("state") or value("status") or "PENDING", value("markdown"), value("text")


class JobReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = _Folder(options)

    def partitions(self) -> list[Part]:
        # Without files there is still a part, as Spark asks for one.
        return self.folder.parts(self.folder.listed()) or [Part([])]

    def read(self, partition: Part) -> Iterator:
        return self.folder.rows(partition)


class JobStreamReader(DataSourceStreamReader):
    """Offsets: time and path of the last file taken, in the order of listing."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.folder.settle * 1e9)
        ready = [f for f in self.folder.listed() if f[0] <= until]
        return {"time": ready[-1][0], "path": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return self.folder.parts([f for f in self.folder.listed() if after < f[:2] <= last]) or [Part([])]

    def read(self, partition: Part) -> Iterator:
        return self.folder.rows(partition)


class ParseJobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parse_jobs"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> JobReader:
        return JobReader(self._options())

    def streamReader(self, schema) -> JobStreamReader:
        return JobStreamReader(self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ParseJobs)
