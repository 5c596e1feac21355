"""Highlights that share a key of the state live each their own life."""

import datetime as dt

from casemill.scratch import fresh
from casemill.streaming.highlights import TIMED_OUT, lifecycle

ROWS = "highlight_id string, user_id string, kind string, text string, ts timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_many_highlights_take_few_keys_of_state(spark, tmp_path):
    sent = [(f"h{n}", f"u{n}", "sent", None, at(n % 50)) for n in range(300)]
    told = [(f"h{n}", None, "summary" if n % 3 == 1 else "failed", f"t{n}", at(n % 50 + 2)) for n in range(300) if n % 3]
    for batch in (sent[:150], sent[150:] + told):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", "u", "sent", None, at(49))], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = fresh(spark, "test-buckets")
    rows = lifecycle(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), buckets=4)
    query = rows.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}")).outputMode("update").option("checkpointLocation", f"{target}-mark").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
    last = {}
    for row in spark.read.parquet(f"{target}/batch=*").orderBy("version").collect():
        last[row.highlight_id] = row
    assert len(last) == 301 and last["end"].summarization is None
    mark = at(51 - 5)  # the latest event, an answer at 51, less the delay
    for n in range(300):
        row, gone = last[f"h{n}"], at(n % 50 + 10) < mark
        assert row.summarization == {0: TIMED_OUT if gone else None, 1: f"t{n}", 2: f"Error: t{n}"}[n % 3]
        assert row.user_id == f"u{n}" and row.sent_at == at(n % 50) and row.summarized_at == (at(n % 50 + 2) if n % 3 else None)
        assert row.version == (1 if n % 3 or not gone else 2)
