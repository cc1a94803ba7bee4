"""Object stores and document parsers: interfaces, stubs, and the loop that polls a parser's jobs.

A store keeps bytes by key; a parser takes a key, answers with a job, and is asked for its state until
the job ends. Both are made on the executors by a factory, so no connection is shipped. The stubs are
deterministic: a folder for the store, a script of states for the parser.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

INTERVAL, TIMEOUT = 2.0, 120.0
FAILED = ("ERROR", "CANCELED")
RESULT = "key string, job_id string, state string, polls int, markdown string, text string"


class ObjectStore(Protocol):
    def put(self, key: str, data: bytes) -> None: ...

    def get(self, key: str) -> bytes: ...

    def delete(self, key: str) -> None: ...


class Parser(Protocol):
    def start(self, key: str) -> str: ...

    def status(self, job_id: str) -> str: ...

    def result(self, job_id: str) -> tuple[str | None, str | None]: ...


class FolderStore:
    """Objects as files of a folder that pyarrow can open (local or remote)."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder)

    def put(self, key: str, data: bytes) -> None:
        path = f"{self.base}/{key}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(path) as out:
            out.write(data)

    def get(self, key: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{key}") as source:
            return source.read()

    def delete(self, key: str) -> None:
        self.fs.delete_file(f"{self.base}/{key}")


@dataclass
class ScriptedParser:
    """Stub: a job is pending for ``pending(key)`` questions and then in the state ``ends(key)``."""

    pending: Callable[[str], int]
    ends: Callable[[str], str]
    content: Callable[[str], tuple[str | None, str | None]] = lambda key: (None, "")
    asked: dict[str, int] = field(default_factory=dict)

    def start(self, key: str) -> str:
        return f"job-{key}"

    def status(self, job_id: str) -> str:
        self.asked[job_id] = self.asked.get(job_id, 0) + 1
        return self.ends(job_id[4:]) if self.asked[job_id] > self.pending(job_id[4:]) else "PENDING"

    def result(self, job_id: str) -> tuple[str | None, str | None]:
        return self.content(job_id[4:])


class Clock:
    """Real time; ``Simulated`` jumps instead of sleeping."""

    now = staticmethod(time.monotonic)
    sleep = staticmethod(time.sleep)


class Simulated:
    def __init__(self) -> None:
        self.at = 0.0

    def now(self) -> float:
        return self.at

    def sleep(self, seconds: float) -> None:
        self.at += seconds


def poll(parser: Parser, jobs: dict[str, str], interval: float = INTERVAL, timeout: float = TIMEOUT, clock: Clock | Simulated | None = None) -> dict[str, tuple[str, int]]:
    """jobs: key to job. (state, number of questions) by key. All open jobs are asked in turn, then one
    interval passes; a job open after ``timeout`` seconds is TIMED_OUT. A state that is neither
    SUCCESS nor a failure means pending."""
    clock, out, asked = clock or Clock(), {}, 0
    began = clock.now()
    while len(out) < len(jobs) and clock.now() - began < timeout:
        asked += 1
        for key, job in jobs.items():
            if key not in out and (state := parser.status(job)) in ("SUCCESS", *FAILED):
                out[key] = (state, asked)
        if len(out) < len(jobs):
            clock.sleep(interval)
    return out | {key: ("TIMED_OUT", asked) for key in jobs if key not in out}


def parse_files(files: DataFrame, key: str, parser: Callable[[], Parser], interval: float = INTERVAL, timeout: float = TIMEOUT, clock: Callable[[], Clock | Simulated] = Clock, parallel: int | None = None) -> DataFrame:
    """One row for each row of files: key, job_id, state (SUCCESS, ERROR, CANCELED, TIMED_OUT), polls,
    and of finished jobs markdown and text. The jobs of an Arrow batch run side by side. Null keys are
    no jobs; equal keys of a batch share one. A lost executor's jobs are started again."""
    rows = files.select(files[key].cast("string").alias("key")).where("key is not null")
    rows = rows.repartition(parallel) if parallel else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = parser()
        for batch in batches:
            jobs = {k: client.start(k) for k in dict.fromkeys(batch["key"])}
            states = poll(client, jobs, interval, timeout, clock())
            got = {k: client.result(jobs[k]) if states[k][0] == "SUCCESS" else (None, None) for k in jobs}
            yield pd.DataFrame([(k, jobs[k], *states[k], *got[k]) for k in batch["key"]], columns=["key", "job_id", "state", "polls", "markdown", "text"])

    return rows.mapInPandas(run, RESULT)
