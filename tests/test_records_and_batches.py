import io
import json
import random
import re
import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import Row

from casemill.sources import batches, records, tables

WORDS = ("UKSC", "Tribunal")


def whole(data: bytes):
    """(offset, record) by looking at the whole file at once."""
    starts = [m.start() + 1 for m in re.finditer(rb"\n(?=(?:UKSC|Tribunal)\t)", data)]
    cut = [(at, re.sub(rb"\r?\n\Z", b"", data[at:end])) for at, end in zip(starts, [*starts[1:], len(data)], strict=False)]
    return cut[:-1] + [(at, record.rstrip()) for at, record in [(at, data[at:]) for at in starts[-1:]]]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_records_are_the_same_at_any_range(newline):
    rng = random.Random(3)
    pieces = ["UKSC\t", "Tribunal\t", "UKSC", "\n", newline, newline + "UKSC\t", newline + "Tribunal\t", "é", "text ", "\t", " ", "Tribuna", "l\t"]
    for round_ in range(60):
        data = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))).encode()
        for size in (1, 2, 7, 50, 10_000):
            for chunk in (1, 3, 1000):
                ranges = range(0, len(data), size) if round_ % 3 == 0 or size > 2 else []
                if not ranges:
                    continue
                got = [r for at in ranges for r in records.records_between(io.BytesIO(data), at, min(at + size, len(data)), WORDS, chunk)]
                assert got == whole(data), (data, size, chunk)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [f"UKSC\tmajority\tcase {n}\t{'long text ' * (n % 50)}\nsecond line {n}\tx\ty" for n in range(2000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("Court\tOpinion\n" + "\n".join(rows) + "\n\n")
    (tmp_path / "in" / "b.tsv").write_text("h\nTribunal\tonly\tthree\nUKSC\t1\t2\t3\t4\t5\r\nUKSC\t6\t7\t8\t9\t10\t\n")
    (tmp_path / "in" / "_SUCCESS").write_text("\nUKSC\t1\t2\t3\t4\t5\t6")
    found = tables.read_records(spark, str(tmp_path / "in"), range_bytes=20_000)
    assert found.rdd.getNumPartitions() > 10
    got = [tuple(r)[2:8] for r in found.orderBy("file", "at").collect()]
    assert got == [tuple(r.split("\t")) for r in rows] + [("UKSC", "1", "2", "3", "4", "5"), ("UKSC", "6", "7", "8", "9", "10")]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, tables.read_records(spark, f"file://{tmp_path}/in/a.tsv,file://{tmp_path}/in/b.tsv").selectExpr("replace(file, 'file://', '')", "at", *[f"c{n}" for n in range(10)]).collect()))


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "units.db")
    connection = sqlite3.connect(path)
    connection.execute("CREATE TABLE units (id INTEGER PRIMARY KEY, text TEXT NOT NULL CHECK (text <> 'bad'), embedding TEXT)")
    connection.commit()
    connection.close()
    return path


def held(path, table="units"):
    connection = sqlite3.connect(path)
    try:
        return sorted(connection.execute(f"SELECT * FROM {table}").fetchall(), key=repr)
    finally:
        connection.close()


def rows(n):
    return [(i, "bad" if i % 40 == 7 else None if i % 90 == 3 else f"text {i}", [0.5, float(i)]) for i in range(n)]


def test_refused_batches_fall_back_to_rows(spark, database):
    batches.register(spark)
    frame = spark.createDataFrame([*rows(400), (5, "text again", [0.0, 0.0])], "id long, text string, embedding array<double>").repartition(3)
    frame.write.format("casemill_batches").mode("append").options(database=database, table="units", batchRows=20, vector="embedding", dimension=2).save()
    good = {i for i, text, _ in rows(400) if text not in ("bad", None)}
    assert {r[0] for r in held(database)} == good and len(held(database)) == len(good)
    assert json.loads(held(database)[0][2]) == [0.5, 0.0]
    refused = sorted(json.loads(r[2])[0] for r in held(database, "units_quarantine"))
    assert refused == sorted([i for i in range(400) if i not in good] + [5])
    assert held(database, "units_staged") == []


def test_a_wrong_dimension_ends_the_run_without_rows(spark, database):
    batches.register(spark)
    frame = spark.createDataFrame([(1, "a", [0.0, 1.0]), (2, "b", [0.0]), (3, "c", None)], "id long, text string, embedding array<double>")
    with pytest.raises(Exception, match="components"):
        frame.write.format("casemill_batches").mode("append").options(database=database, table="units", vector="embedding", dimension=2).save()
    assert held(database) == [] and held(database, "units_staged") == []


def test_an_attempt_that_died_midway_leaves_nothing_and_a_commit_runs_once(database):
    writer = batches.BatchWriter({"database": database, "table": "units", "batchRows": "10"}, ["id", "text", "embedding"])
    given = [Row(id=i, text=t, embedding=e) for i, t, e in rows(100)]

    def dying():
        yield from given[:57]
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.put(dying(), "1")
    assert len(held(database, "units_staged")) > 0 and held(database) == []
    done = writer.put(iter(given), "2")
    for _ in range(2):
        writer.commit([done, None])
    good = [i for i, t, _ in rows(100) if t not in ("bad", None)]
    assert sorted(r[0] for r in held(database)) == good
    assert len(held(database, "units_quarantine")) == 100 - len(good) and held(database, "units_staged") == []
    other = batches.BatchWriter({"database": database, "table": "units"}, ["id", "text", "embedding"])
    other.put(iter([Row(id=1000, text="x", embedding=None)]), "1")
    other.abort([None])
    assert len(held(database)) == len(good) and held(database, "units_staged") == []


def test_a_task_that_is_killed_and_runs_again_leaves_each_row_once(database, tmp_path):
    program = tmp_path / "run.py"
    program.write_text(f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
os.environ["PYTHONPATH"] = sys.path[0]
from pyspark import TaskContext
from pyspark.sql import SparkSession
from casemill.sources import batches
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
batches.register(spark)

def some(parts):
    for part in parts:
        for start in range(0, len(part), 50):
            if start >= 200 and TaskContext.get().attemptNumber() == 0:
                os._exit(1)  # the worker dies midway
            yield part.iloc[start : start + 50]

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
frame = spark.range(1000).selectExpr("id", "concat('t', id) AS text", "CAST(NULL AS STRING) AS embedding").repartition(2)
frame.mapInPandas(some, frame.schema).write.format("casemill_batches").mode("append").options(database={database!r}, table="units").save()
""")
    subprocess.run([sys.executable, str(program)], check=True, timeout=200, capture_output=True)
    assert [r[0] for r in held(database)] == sorted(range(1000), key=lambda i: repr((i, f"t{i}", None)))


def test_short_ranges_share_tasks(tmp_path):
    from casemill.sources import records

    whole = b"".join(b"\nUKSC\t%d\ttext %d" % (n, n) for n in range(20_000))
    (tmp_path / "a.tsv").write_bytes(whole)
    reader = records._Reader({"path": str(tmp_path), "rangeBytes": "64"})
    parts = reader.partitions()
    assert len(parts) <= 2 * records.LEAST_TASKS < len(whole) // 64
    assert [r[2] for p in parts for r in reader.read(p)] == [f"UKSC\t{n}\ttext {n}" for n in range(20_000)]
