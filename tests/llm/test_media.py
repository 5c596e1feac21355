import hashlib
import struct
import zipfile
import zlib
from pathlib import Path

import pytest

from casemill.llm import media


def test_png_round_trip():
    for text in ("", "a", "é" * 400, "x" * 576, "y" * 577):
        payload = media.payload_of(text)
        assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.rstrip(b"\xff") == text.encode()
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload and media.to_png(payload) == stored
    with pytest.raises(ValueError):
        media.from_png(stored[:-20] + b"0" * 20)


def test_operator(spark):
    rows = [(n, f"text {n} " * (n * 7 % 300)) for n in range(80)] + [(None, "x"), (2, None), (2, ""), (3, "same"), (3, "same"), (4, "long é " * 200_000)]
    docs = spark.createDataFrame([(k, t, "m") for k, t in rows], "doc_id long, text string, member string").repartition(3)
    got = media.documents_as_media(docs).collect()
    expected = []
    for key, text in rows:
        payload = media.payload_of(text or "")
        stored = media.to_png(payload)
        expected.append((key, len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(payload)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert media.documents_as_media(docs.limit(0)).count() == 0


def test_ranges_cover_every_member_once_and_survive_small_archives(spark, tmp_path):
    docs = spark.createDataFrame([(n, str(hash((n, 1.5))) * 40) for n in range(300)], "doc_id long, text string").repartition(2)
    folder = f"file://{tmp_path}/archives"
    assert media.write_archives(docs, folder, archive_bytes=10_000) == 300
    assert len(list(Path(tmp_path, "archives").glob("*.zip"))) > 2
    found = media.read_archives(spark, folder, rangeBytes=3_000, batchBytes=2_000)
    assert found.rdd.getNumPartitions() > 10
    assert sorted(r.doc_id for r in media.media_features(found).collect()) == list(range(300))


def test_a_member_is_read_again_alone(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as file:
        file.writestr("one", b"first")
        file.writestr("two", b"second")
    entries, calls = zipfile.ZipFile(path).infolist(), []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost connection")
        return open(path, "rb")

    assert media.read_member(flaky, entries[1], attempts=4, wait_s=0) == b"second" and len(calls) == 3
    entries[0].CRC ^= 1
    with pytest.raises(OSError, match="damaged"):
        media.read_member(lambda: open(path, "rb"), entries[0], attempts=2, wait_s=0)
    assert media.read_member(lambda: open(path, "rb"), entries[1], wait_s=0) == b"second"


def test_a_damaged_directory_is_read_again(tmp_path):
    path, calls = tmp_path / "a.zip", []
    with zipfile.ZipFile(path, "w") as file:
        file.writestr("one", b"first")

    def directory():
        calls.append(1)
        if len(calls) == 1:
            raise zipfile.BadZipFile("cut off")
        if len(calls) == 2:
            raise struct.error("short read")
        return zipfile.ZipFile(path).namelist()

    assert media.retried(directory, "directory", attempts=4, wait_s=0) == ["one"] and len(calls) == 3
    with pytest.raises(OSError, match="2 attempts"):
        media.retried(lambda: zipfile.ZipFile(__file__), "directory", attempts=2, wait_s=0)
