"""Answers of hosted models, asked for once each: an answer table by the prompt's digest.

Distinct prompts that the table lacks go out in small groups whose members the prompts themselves fix, whatever the tasks. A group's answers are
stored before the next group is asked, so a task that runs again takes them from there and asks nothing twice; rows get
their answers by a join. Nothing passes the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.session import ship_package
from casemill.sources.records import file_system

#: Digits of a digest that prompts of one group share at least, and prompts that are asked before they are stored.
GROUP_DIGITS, STORED = 2, 16
_TABLE = "digest string, prompt string, answer string, error string"


def answered_once(rows: DataFrame, prompt: str, ask: Callable[[str], str], store: str, out: str = "answer") -> DataFrame:
    """``rows`` with ``out`` (null for a null prompt, and where the provider failed) and ``<out>_error``.

    ``store`` is a folder in the shared file system; run again with it, only new prompts go out, and those that failed. Equal prompts are asked
    once. ``ask`` is shipped to the workers.
    """
    spark = rows.sparkSession
    ship_package(spark)
    digest = F.sha2(F.col(prompt), 256)
    wanted = rows.where(F.col(prompt).isNotNull()).select(digest.alias("digest"), F.col(prompt).alias("prompt")).distinct()
    new = wanted.join(stored(spark, store).select("digest"), "digest", "left_anti")
    # prompts of one group stand together and in order, so a group's parts hold the same prompts in every attempt
    grouped = new.withColumn("part", F.substring("digest", 1, GROUP_DIGITS)).repartition("part").sortWithinPartitions("part", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        group = None
        total = 0

        def done() -> None:
            nonlocal held, total
            if held:
                total += len(held)
                _store(store, held, ask)
                held = []

        for batch in batches:
            for part, key, text in zip(batch["part"].to_pylist(), batch["digest"].to_pylist(), batch["prompt"].to_pylist(), strict=True):
                if part != group or len(held) == STORED:
                    done()
                    group = part
                held.append((key, text))
        done()
        yield pa.RecordBatch.from_pydict({"asked": pa.array([total], pa.int64())})

    grouped.mapInArrow(run, "asked long").agg(F.sum("asked")).collect()  # one number
    found = stored(spark, store).select(F.col("digest").alias("__digest"), F.col("answer").alias(out))
    failed = _read(spark, store).where("error IS NOT NULL").groupBy(F.col("digest").alias("__digest")).agg(F.max("error").alias(f"{out}_error"))
    met = rows.withColumn("__digest", digest).join(found, "__digest", "left").join(failed, "__digest", "left")
    return met.withColumn(f"{out}_error", F.when(F.col(out).isNull(), F.col(f"{out}_error"))).drop("__digest")


def stored(spark, store: str) -> DataFrame:
    """digest, prompt, answer: what the table holds, one row a digest."""
    rows = _read(spark, store).where("error IS NULL")
    return rows.groupBy("digest").agg(F.min("prompt").alias("prompt"), F.min("answer").alias("answer"))


def _read(spark, store: str) -> DataFrame:
    system, path = file_system(store)
    system.create_dir(path, recursive=True)
    return spark.read.schema(_TABLE).option("recursiveFileLookup", "true").json(store)


def _store(store: str, prompts: list[tuple[str, str]], ask: Callable[[str], str]) -> None:
    """Ask what no file of this group holds yet, and store it as one file whose name the prompts fix."""
    from pyarrow import fs

    system, path = file_system(store)
    name = hashlib.sha256("".join(key for key, _ in prompts).encode()).hexdigest()
    target = f"{path.rstrip('/')}/{prompts[0][0][:GROUP_DIGITS]}/{name}.json"
    if system.get_file_info(target).type == fs.FileType.File:
        with system.open_input_stream(target) as file:
            kept = [json.loads(line) for line in file.read().splitlines()]
    else:
        kept = []
    there = {row["digest"] for row in kept if row["error"] is None}
    if len(there) == len(prompts):
        return
    rows = [row for row in kept if row["error"] is None]
    for key, text in prompts:
        if key in there:
            continue
        try:
            rows.append({"digest": key, "prompt": text, "answer": ask(text), "error": None})
        except Exception as error:  # noqa: BLE001  whatever a vendor's client raises; the prompt can be asked again
            rows.append({"digest": key, "prompt": text, "answer": None, "error": f"{type(error).__name__}: {error}"})
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{target}.part") as file:
        file.write("\n".join(json.dumps(row) for row in rows).encode())
    system.move(f"{target}.part", target)  # whole or not at all

