"""The parser's results as a source: byte parts, retries, streams, malformed lines."""

import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from corpusloom.sources import jobsource
from corpusloom.sources.jobsource import JobReader, JobStreamReader, ParseJobs, _Folder

ROOT = Path(__file__).resolve().parents[1]


def jobs(n, seed=1):
    r = random.Random(seed)
    return [{"job_id": f"j{seed}-{k}", "status": r.choice(["SUCCESS", "ERROR"]), "markdown": r.choice([None, "# é\n" + "x" * r.randrange(50)]), "text": "t é" * r.randrange(20)} for k in range(n)]


def put(folder, name, rows, ends="\n"):
    path = Path(folder, name)
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + ends, encoding="utf-8")
    return path


def ids(rows):
    return sorted(r["job_id"] for r in rows)


def read(reader, part):
    return [r for batch in reader.read(part) for r in batch.to_pylist()]


@pytest.mark.parametrize("part_bytes", [1, 7, 100, 1000, 1 << 20])
def test_every_line_is_read_once_wherever_files_are_cut(tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(jobsource, "READ_BYTES", 13)
    a, b = jobs(9, 1), jobs(7, 2)
    put(tmp_path, "a.json", a)
    put(tmp_path, "b.json", b, ends="")  # no newline at the end
    put(tmp_path, "_hidden.json", jobs(1, 3))
    Path(tmp_path, "c.json").write_text("")
    reader = JobReader({"path": str(tmp_path), "partbytes": str(part_bytes)})
    parts = reader.partitions()
    got = [r for p in parts for r in read(reader, p)]
    assert ids(got) == ids(a + b)
    by = {r["job_id"]: r for r in a + b}
    assert all((r["state"], r["markdown"], r["text"]) == (by[r["job_id"]]["status"], by[r["job_id"]]["markdown"], by[r["job_id"]]["text"]) for r in got)
    assert all(sum(e - s for _, s, e in p.files) <= part_bytes for p in parts)


def test_a_part_read_again_gives_the_same_rows(tmp_path):
    put(tmp_path, "a.json", jobs(3000))
    reader = JobReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    half = reader.read(part)
    next(half)  # an attempt that dies after its first batch
    assert read(reader, part) == read(reader, part) and len(read(reader, part)) == 3000


RETRY = """
import sys
sys.path.insert(0, {root!r})
from pathlib import Path
from pyspark.sql import SparkSession
from corpusloom.plans.session import ready
from corpusloom.sources import jobsource

class Flaky(jobsource.JobReader):
    def read(self, part):
        mark = Path({marks!r}, str(abs(hash(tuple(part.files)))) )
        for k, batch in enumerate(super().read(part)):
            yield batch
            if not mark.exists():
                mark.touch()
                raise OSError("lost")

class FlakyJobs(jobsource.ParseJobs):
    @classmethod
    def name(cls):
        return "flaky_jobs"

    def reader(self, schema):
        return Flaky(self._options())

spark = ready(SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
spark.dataSource.register(FlakyJobs)
df = spark.read.format("flaky_jobs").option("partBytes", 20000).load({folder!r})
print("ROWS", df.count(), df.select("job_id").distinct().count(), df.rdd.getNumPartitions())
"""


def test_failed_tasks_are_retried_without_lost_or_repeated_rows(tmp_path):
    folder, marks = tmp_path / "in", tmp_path / "marks"
    folder.mkdir(), marks.mkdir()
    put(folder, "a.json", jobs(2000))
    out = subprocess.run([sys.executable, "-c", RETRY.format(root=str(ROOT), folder=str(folder), marks=str(marks))], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONHASHSEED": "0"})
    rows = next(x for x in out.stdout.splitlines() if x.startswith("ROWS")).split()[1:]
    assert rows[:2] == ["2000", "2000"] and int(rows[2]) > 3 and len(list(marks.iterdir())) == int(rows[2])


def test_options(spark, tmp_path):
    jobsource.register(spark)
    rows = jobs(20)
    path = put(tmp_path, "a.json", rows)
    done = spark.read.format("parse_jobs").option("state", "SUCCESS").load(str(tmp_path)).collect()
    assert ids(done) == ids(r for r in rows if r["status"] == "SUCCESS") and done[0]["file"] == "a.json"
    path.write_text(path.read_text() + '[1]\n{"job_id": 7, "text": null}\nnot json\n')
    odd = {(r["job_id"], r["state"]) for r in spark.read.format("parse_jobs").load(str(tmp_path)).where("job_id is null or job_id = '7'").collect()}
    assert odd == {(None, "MALFORMED"), ("7", "PENDING")}
    strict = spark.read.format("parse_jobs").option("mode", "failfast").load(str(tmp_path))
    with pytest.raises(Exception, match="no JSON object"):
        strict.collect()
    with pytest.raises(ValueError, match="path"):
        ParseJobs({}).reader(None)
    (empty := tmp_path / "empty").mkdir()
    assert spark.read.format("parse_jobs").load(str(empty)).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    jobsource.register(spark)
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        q = spark.readStream.format("parse_jobs").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out)
        q.awaitTermination()

    first, second = jobs(30, 1), jobs(20, 2)
    put(folder, "b.json", first)
    run()
    assert ids(spark.read.parquet(out).collect()) == ids(first)
    put(folder, "a.json", second)  # earlier by name, later by time
    run()
    run()
    assert ids(spark.read.parquet(out).collect()) == ids(first + second)


def test_young_files_wait(tmp_path):
    put(tmp_path, "a.json", jobs(2))
    reader = JobStreamReader({"path": str(tmp_path), "settleseconds": "1000"})
    assert reader.latestOffset() == reader.initialOffset()
    now = JobStreamReader({"path": str(tmp_path)}).latestOffset()
    assert sum(len(read(reader, p)) for p in reader.partitions(reader.initialOffset(), now)) == 2
    assert sum(len(read(reader, p)) for p in reader.partitions(now, now)) == 0
    assert _Folder({"path": str(tmp_path)}).listed()[0][2] > 0
