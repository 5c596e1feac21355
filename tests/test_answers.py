import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark import cloudpickle

from casemill.operators import answers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Counting:
    """A provider that notes every prompt it is asked in a file."""

    def __init__(self, path, failing=()):
        self.path, self.failing = str(path), frozenset(failing)

    def __call__(self, prompt):
        with open(self.path, "a") as file:
            file.write(prompt + "\n")
        if prompt in self.failing:
            raise TimeoutError("slow down")
        return prompt.upper()

    def asked(self):
        return Counter(Path(self.path).read_text().split("\n")[:-1]) if os.path.exists(self.path) else Counter()


def test_repeated_texts_and_later_runs_ask_nothing_twice(spark, tmp_path):
    provider, store = Counting(tmp_path / "asked"), str(tmp_path / "store")
    rows = spark.createDataFrame([(n, f"text {n % 50}" if n % 10 else None, "x") for n in range(500)], "id int, prompt string, answer_of string").repartition(6)
    found = answers.answered_once(rows, "prompt", provider, store)
    got = {(r.id, r.prompt): r.answer for r in found.collect()}
    assert len(got) == 500 and all(a == (p.upper() if p else None) for (_, p), a in got.items())
    assert provider.asked() == Counter({f"text {n}": 1 for n in range(50) if n % 10})
    more = rows.selectExpr("id", "concat('more ', id % 3) AS prompt").unionByName(rows.select("id", "prompt"))
    assert answers.answered_once(more, "prompt", provider, store).where("answer IS NULL AND prompt IS NOT NULL").count() == 0
    assert set(provider.asked().values()) == {1} and len(provider.asked()) == 48


def test_what_failed_is_told_and_asked_again(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(n, f"p{n}") for n in range(40)], "id int, prompt string")
    first = Counting(tmp_path / "one", failing=["p3", "p4"])
    got = {r.id: (r.answer, r.answer_error) for r in answers.answered_once(rows, "prompt", first, store).collect()}
    assert got[3] == (None, "TimeoutError: slow down") and got[5] == ("P5", None)
    second = Counting(tmp_path / "two")
    assert answers.answered_once(rows, "prompt", second, store).where("answer IS NULL").count() == 0
    assert second.asked() == Counter({"p3": 1, "p4": 1})
    assert answers.answered_once(rows.where("false"), "prompt", second, store).count() == 0


def test_a_lost_worker_asks_again_only_what_was_not_stored(tmp_path):
    program = tmp_path / "run.py"
    program.write_text(f"""
import os, sys
sys.path[:0] = [{str(Path(__file__).resolve().parents[1])!r}, {str(Path(__file__).resolve().parent)!r}]
os.environ["PYTHONPATH"] = ":".join(sys.path[:2])
from pyspark import TaskContext
from pyspark.sql import SparkSession
from casemill.operators import answers
from test_answers import Counting

class Dying(Counting):
    def __call__(self, prompt):
        answer = super().__call__(prompt)
        if prompt == "p150" and TaskContext.get().attemptNumber() == 0:
            os._exit(1)  # the worker dies while it asks
        return answer

spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.adaptive.enabled", "false").getOrCreate()
rows = spark.range(300).selectExpr("id", "concat('p', id) AS prompt")
found = answers.answered_once(rows, "prompt", Dying({str(tmp_path / "asked")!r}), {str(tmp_path / "store")!r})
assert found.where("answer = upper(prompt)").count() == 300
""")
    subprocess.run([sys.executable, str(program)], check=True, timeout=200, capture_output=True)
    asked = Counting(tmp_path / "asked").asked()
    assert len(asked) == 300 and sum(asked.values()) - 300 < answers.STORED  # the group that was being asked, nothing else
