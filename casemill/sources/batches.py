"""Rows into another database, in batches with a fallback to single rows: a data source to write to.

Tasks put batches into a staging table; a batch that the database refuses is put row by row, and rows that are refused
again go to quarantine with the reason. Nothing is in the table before the driver commits: it then moves the rows of
those task attempts that succeeded, in one transaction that is done once a run. So a task that failed midway and ran
again leaves each row once, and a run that failed leaves none.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a batch.
BATCH_ROWS = 50


class WrongDimension(ValueError):
    """A vector is not as long as the table's: the run ends and writes nothing."""


@dataclass
class Attempt(WriterCommitMessage):
    run: str
    attempt: str
    rows: int
    refused: int


class BatchWriter(DataSourceWriter):
    """Options: database and table; driver (a DB-API module, ``sqlite3`` by default), batchRows, and vector with dimension, a column whose arrays must have that length.

    The table is there; its refused rows go to ``<table>_quarantine (run, row, reason)``. Arrays and structs are stored as JSON.
    """

    def __init__(self, options: dict, columns: list[str]):
        self.database, self.table, self.columns = options["database"], options["table"], columns
        self.driver = options.get("driver", "sqlite3")
        self.size = max(1, int(options.get("batchrows", options.get("batchRows", BATCH_ROWS))))
        self.vector, self.dimension = options.get("vector"), int(options.get("dimension", 0))
        self.run = uuid.uuid4().hex
        with self._open() as (connection, mark):
            cursor = connection.cursor()
            names = ", ".join(self._quoted(columns))
            cursor.execute(f"CREATE TABLE IF NOT EXISTS {self.table}_staged AS SELECT {names}, CAST('' AS VARCHAR(80)) AS run_, CAST('' AS VARCHAR(80)) AS attempt_ FROM {self.table} WHERE 1 = 0")
            cursor.execute(f"CREATE TABLE IF NOT EXISTS {self.table}_quarantine (run VARCHAR(80), attempt VARCHAR(80), refused TEXT, reason TEXT)")
            cursor.execute(f"CREATE TABLE IF NOT EXISTS {self.table}_runs (run VARCHAR(80) PRIMARY KEY)")
            connection.commit()

    @staticmethod
    def _quoted(columns: list[str]) -> list[str]:
        return ['"' + c.replace('"', '""') + '"' for c in columns]

    @contextmanager
    def _open(self) -> Iterator[tuple]:
        """A connection, and the driver's mark for a parameter."""
        module = importlib.import_module(self.driver)
        connection = module.connect(self.database, **({"timeout": 120} if self.driver == "sqlite3" else {}))
        try:
            yield connection, "?" if module.paramstyle == "qmark" else "%s"
        finally:
            connection.close()

    def write(self, iterator: Iterator[Row]) -> Attempt:
        context = TaskContext.get()
        attempt = f"{context.taskAttemptId()}" if context else uuid.uuid4().hex
        return self.put(iterator, attempt)

    def put(self, rows: Iterator[Row], attempt: str) -> Attempt:
        """Stage the rows of one attempt."""
        done = Attempt(self.run, attempt, 0, 0)
        with self._open() as (connection, mark):
            # a probe of the table itself: what it would refuse is found while the rows are staged, and taken back
            names = ", ".join(self._quoted(self.columns))
            marks = ", ".join([mark] * len(self.columns))
            probe = f"INSERT INTO {self.table} ({names}) VALUES ({marks})"
            stage = f"INSERT INTO {self.table}_staged ({names}, run_, attempt_) VALUES ({marks}, {mark}, {mark})"
            refuse = f"INSERT INTO {self.table}_quarantine VALUES ({mark}, {mark}, {mark}, {mark})"

            def accepted(values: list[tuple]) -> Exception | None:
                cursor = connection.cursor()
                try:
                    cursor.executemany(probe, values)
                except Exception as error:  # noqa: BLE001  whatever the driver raises for a row that breaks a rule
                    return error
                finally:
                    connection.rollback()
                return None

            def batch(values: list[tuple]) -> None:
                good, bad = values, []
                if accepted(values) is not None:
                    good = []
                    for value in values:
                        error = accepted([value])
                        (good if error is None else bad).append(value if error is None else (value, error))
                cursor = connection.cursor()
                cursor.executemany(stage, [(*v, self.run, attempt) for v in good])
                cursor.executemany(refuse, [(self.run, attempt, json.dumps(v, default=str), str(e)) for v, e in bad])
                connection.commit()
                done.rows, done.refused = done.rows + len(good), done.refused + len(bad)

            held: list[tuple] = []
            for row in rows:
                if self.vector and len(row[self.vector] or []) != self.dimension:
                    raise WrongDimension(f"{self.vector} has {len(row[self.vector] or [])} components, the table {self.dimension}")
                held.append(tuple(json.dumps(v, default=str) if isinstance(v, (list, dict, tuple)) else v for v in (row[c] for c in self.columns)))
                if len(held) == self.size:
                    batch(held)
                    held = []
            if held:
                batch(held)
        return done

    def commit(self, messages: list[Attempt | None]) -> None:
        """Move what the successful attempts staged, once; rows that the table refuses together (two of one key, say) are tried singly."""
        with self._open() as (connection, mark):
            cursor = connection.cursor()
            cursor.execute(f"SELECT count(*) FROM {self.table}_runs WHERE run = {mark}", (self.run,))
            if cursor.fetchone()[0]:
                return
            names = ", ".join(self._quoted(self.columns))
            cursor.execute(f"INSERT INTO {self.table}_runs VALUES ({mark})", (self.run,))
            for message in filter(None, messages):
                own = (message.run, message.attempt)
                cursor.execute("SAVEPOINT attempt")
                try:
                    cursor.execute(f"INSERT INTO {self.table} ({names}) SELECT {names} FROM {self.table}_staged WHERE run_ = {mark} AND attempt_ = {mark}", own)
                except Exception:  # noqa: BLE001
                    cursor.execute("ROLLBACK TO SAVEPOINT attempt")
                    self._singly(connection, cursor, mark, names, own)
            attempts = [m.attempt for m in messages if m]
            marks = ", ".join([mark] * len(attempts)) or "NULL"
            cursor.execute(f"DELETE FROM {self.table}_quarantine WHERE run = {mark} AND attempt NOT IN ({marks})", (self.run, *attempts))
            cursor.execute(f"DELETE FROM {self.table}_staged WHERE run_ = {mark}", (self.run,))
            connection.commit()

    def _singly(self, connection, cursor, mark: str, names: str, own: tuple[str, str]) -> None:
        reader = connection.cursor()
        reader.execute(f"SELECT {names} FROM {self.table}_staged WHERE run_ = {mark} AND attempt_ = {mark}", own)
        for values in reader.fetchall():  # what one attempt staged
            cursor.execute("SAVEPOINT one")
            try:
                cursor.execute(f"INSERT INTO {self.table} ({names}) VALUES ({', '.join([mark] * len(values))})", values)
            except Exception as error:  # noqa: BLE001
                cursor.execute("ROLLBACK TO SAVEPOINT one")
                cursor.execute(f"INSERT INTO {self.table}_quarantine VALUES ({mark}, {mark}, {mark}, {mark})", (*own, json.dumps(values, default=str), str(error)))

    def abort(self, messages: list[Attempt | None]) -> None:
        with self._open() as (connection, mark):
            cursor = connection.cursor()
            cursor.execute(f"DELETE FROM {self.table}_staged WHERE run_ = {mark}", (self.run,))
            cursor.execute(f"DELETE FROM {self.table}_quarantine WHERE run = {mark}", (self.run,))
            connection.commit()


class BatchSink(DataSource):
    """``df.write.format("casemill_batches").mode("append").options(database=..., table=...).save()``; see :class:`BatchWriter`."""

    @classmethod
    def name(cls) -> str:
        return "casemill_batches"

    def schema(self) -> str:
        raise NotImplementedError("it is only written to")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("rows can be appended only")
        return BatchWriter(dict(self.options), [field.name for field in schema.fields])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BatchSink)
