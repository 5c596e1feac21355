import datetime as dt
import random

from casemill.scratch import fresh
from casemill.sources import feed
from casemill.streaming import ingest

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def write_batches(spark, folder, batches, schema):
    """One file a batch, so that a stream that takes one file at a time sees them in turn."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)


def one_file_at_a_time(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_and_repeated_events_with_bounded_state(spark, tmp_path):
    """Against the rule restated over the batches: late after the watermark, repeated within the span, forgotten beyond it."""
    rng, delay = random.Random(1), 30
    batches = []
    for n in range(8):
        fresh_rows = [(f"k{n}-{i}", at(n * 200 + rng.randint(0, 60)), n) for i in range(40)]
        again = [(k, t + dt.timedelta(minutes=rng.randint(0, 5)), n) for k, t, _ in rng.sample(batches[-1][:40], 5)] if batches else []  # long behind the watermark: late
        repeated = [(k, t + dt.timedelta(minutes=2), n) for k, t, _ in rng.sample(fresh_rows, 6)]
        returning = [("k0-1", at(n * 200 + 30), n)] if n in (3, 4, 6) else []  # its first row is forgotten: it comes again
        batches.append(fresh_rows + repeated + again + returning + [(f"none{n}", None, n)])
    schema = "k string, ts timestamp, n int"
    write_batches(spark, str(tmp_path / "in"), batches, schema)
    base = fresh(spark, "test-recent")
    progress = ingest.ingest_recent(one_file_at_a_time(spark, str(tmp_path / "in"), schema), f"{base}/rows", f"{base}/mark", "k", "ts", f"{delay} minutes")
    expected, remembered, mark = [], {}, None
    for batch in batches:
        seen = {k: until for k, until in remembered.items() if mark is None or until > mark}
        for k, t, _ in batch:
            if t is None or (mark is not None and t <= mark) or k in seen:
                continue
            seen[k] = t + dt.timedelta(minutes=delay)
            expected.append(k)
        remembered = seen
        reached = max(t for _, t, _ in batch if t) - dt.timedelta(minutes=delay)
        mark = max(mark or reached, reached)
    got = [r.k for r in spark.read.parquet(f"{base}/rows/batch=*").collect()]
    assert sorted(got) == sorted(expected) and got.count("k0-1") == expected.count("k0-1") == 3
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) < 100  # not the 320 keys that came by


HIGHLIGHTS = "highlight_id string, user_id string, kind string, text string, ts timestamp"


def story():
    """Out of order, replayed, repeated, late and missing answers, in batches."""
    one = [
        ("a", "u", "sent", None, at(0)), ("b", "u", "summary", "before its highlight", at(4)), ("c", "u", "sent", None, at(1)), ("d", None, "sent", None, at(2)),
        ("e", "u", "sent", None, at(2)), ("a", "u", "summary", "first", at(3)), ("f", "u", "summary", "without highlight", at(3)), (None, "u", "sent", None, at(1)),
    ]
    two = [("b", "u", "sent", None, at(1)), ("a", "u", "summary", "first", at(3)), ("a", "u", "summary", "better", at(5)), ("c", "u", "failed", "no model", at(6)), ("a", "u", "sent", None, at(0)), ("e", "u", "summary", "too late", at(13)), ("a", "u", "summary", "older", at(4))]
    three = [("z", "u", "sent", None, at(60)), ("g", "u", "sent", None, at(58)), ("g", "u", "summary", "quick", at(59))]
    four = [("a", "u", "summary", "much too late", at(5)), ("z2", "u", "sent", None, at(62))]
    return [one, two, three, four]


def wanted():
    timed_out = "Error: timed out"
    return {"a": "better", "b": "before its highlight", "c": "Error: no model", "d": timed_out, "e": timed_out, "g": "quick", "z": None, "z2": None}


def test_highlights_live_the_same_in_one_batch_and_in_many(spark, tmp_path):
    whole = [row for batch in story() for row in batch if row[3] != "much too late"]  # which is late behind other batches only
    for name, batches in (("many", story()), ("one", [whole])):
        source, folder = str(tmp_path / name), fresh(spark, f"test-{name}")
        write_batches(spark, source, batches, HIGHLIGHTS)
        ingest.run_lifecycle(one_file_at_a_time(spark, source, HIGHLIGHTS), folder)
        got = {r.highlight_id: r for r in ingest.latest_highlights(spark, folder).collect()}
        assert {k: r.summarization for k, r in got.items()} == wanted(), name
        assert got["a"].sent_at == at(0) and got["a"].summarized_at == at(5) and got["d"].summarized_at is None and got["d"].user_id is None


def test_a_highlight_run_goes_on_from_its_checkpoint(spark, tmp_path):
    source, folder = str(tmp_path / "in"), fresh(spark, "test-resumed")
    first, *rest = story()
    write_batches(spark, source, [first], HIGHLIGHTS)
    ingest.run_lifecycle(one_file_at_a_time(spark, source, HIGHLIGHTS), folder)
    assert {r.highlight_id: r.summarization for r in ingest.latest_highlights(spark, folder).collect()} == {"a": "first", "c": None, "d": None, "e": None}
    write_batches(spark, source, rest, HIGHLIGHTS)
    ingest.run_lifecycle(one_file_at_a_time(spark, source, HIGHLIGHTS), folder)
    assert {r.highlight_id: r.summarization for r in ingest.latest_highlights(spark, folder).collect()} == wanted()


def page(entries, following=None):
    link = f'<link rel="next" href="{following}"/>' if following else ""
    body = "".join(f"<entry><id>{e}</id><title>Case {e}</title><updated>u</updated><link href='l{e}'/></entry>" for e in entries)
    return f'<feed xmlns="http://www.w3.org/2005/Atom">{link}{body}</feed>'.encode()


def test_a_feed_stops_when_told_to_slow_down_and_goes_on_there():
    pages = {"p1": page("abc", "p2"), "p2": page("cd", "p3"), "p3": page("ef")}
    refused = {"p2"}
    reader = feed.FeedStream({"path": "p1", "pagesPerTrigger": "2"}, lambda url: (429, b"") if url in refused else (200, pages[url]))
    begin = reader.initialOffset()
    rows, first = reader.read(begin)
    assert [r[0] for r in rows] == ["a", "b", "c"] and first["next"] == "p2"
    rows, same = reader.read(first)
    assert list(rows) == [] and same == first  # nothing new: no batch
    refused.clear()
    rows, second = reader.read(first)
    assert [r[0] for r in rows] == ["d", "e", "f"]  # c was seen on the page before
    pages["p3"] = page("efg")
    assert [r[0] for r in reader.readBetweenOffsets(first, second)] == ["d", "e", "f"]  # g came after the batch
    rows, third = reader.read(second)
    assert [r[0] for r in rows] == ["g"]
    rows, fourth = reader.read(third)
    assert list(rows) == [] and fourth == third
    assert [r[0] for r in reader.readBetweenOffsets(begin, first)] == ["a", "b", "c"]


def test_a_feed_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    feed.register(spark)
    for n in range(1, 7):
        (tmp_path / f"p{n}.xml").write_bytes(page([2 * n, 2 * n + 1, 2 * n + 2], f"file://{tmp_path}/p{n + 1}.xml" if n < 6 else None))
    target, mark = fresh(spark, "test-feed"), fresh(spark, "test-feed-mark")

    def run():
        stream = spark.readStream.format("casemill_atom").option("pagesPerTrigger", 2).load(f"file://{tmp_path}/p1.xml")
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(int(r.id) for r in spark.read.parquet(target).collect())

    held = [run()]
    assert len(held[0]) < 13  # broken off after some pages
    while len(held) < 6 and held[-1] != list(range(2, 15)):
        held.append(run())
    assert held[-1] == list(range(2, 15)) and all(len(set(h)) == len(h) for h in held)
