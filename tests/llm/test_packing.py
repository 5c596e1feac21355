import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from casemill.llm.catalogue import tokenizer_path
from casemill.llm.packing import Encoder, Packer, pack


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_whole_documents_are_encoded_as_by_the_library(library):
    encode = Encoder(tokenizer_path("bytes"))
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    rng = random.Random(12)
    parts = ["Straße", "été", "Ǆabc", "ʼn", "Ab", "don't", "x's", "--", "__", "a1b", "1,5", "'", "`q`", "Ω", "é\u0301", "ª", "º", "×", "÷", "ɏ", "ɐ", "\n", " ", "\u00a0", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 6)))
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("bytes"))


def test_cached_encoding_equals_the_library(library):
    encode, rng = Encoder(tokenizer_path("bytes")), random.Random(2)
    parts = ["a", " ", "  ", "\n", "b'll", "é", "<|endoftext|>", "12", "!?", "\t", " ", "漢", " x", "\r\n", " "]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def packed(packer, sizes):
    docs = {doc: np.arange(size, dtype="<u4") + doc for doc, size in enumerate(sizes)}
    placed = [piece for doc, ids in docs.items() for piece in packer.put(doc, ids)]
    return docs, placed, packer.flush()


@pytest.mark.parametrize("most_open", [3, 50, 4096])
def test_packer_places_every_id_once(most_open):
    rng = random.Random(4)
    docs, placed, rest = packed(Packer(0, 64, most_open), [rng.choice([1, 5, 30, 63, 64, 65, 200]) for _ in range(400)])
    parts, windows = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, sequence, offset in placed + rest:
        assert total == len(docs[doc])
        parts[doc].append((start, ids))
        windows[sequence].append((offset, len(ids)))
    for doc, ids in docs.items():
        assert np.array_equal(np.concatenate([p for _, p in sorted(parts[doc], key=lambda p: p[0])]), ids)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    assert sum(len(p[2]) for p in placed + rest) == sum(map(len, docs.values()))


def lengths(n, seed=9):
    rng = random.Random(seed)
    return [int(rng.lognormvariate(6, 1)) + 1 for _ in range(n)]


def test_many_windows_are_open_and_documents_are_cut_only_at_the_end():
    sizes, packer, most, placed = lengths(10_000), Packer(0), 0, []
    for doc, size in enumerate(sizes):
        placed += packer.put(doc, np.zeros(size, "<u4"))
        most = max(most, packer.open)
    assert most > 200
    whole = defaultdict(int)
    for doc, *_ in placed:
        whole[doc] += 1
    assert all(n <= -(-sizes[doc] // 2048) for doc, n in whole.items())  # cut where longer than a window, nowhere else


def test_windows_that_never_fit_are_closed_within_bounds():
    packer, most = Packer(0, 64, 20), 0
    for doc in range(500):
        packer.put(doc, np.zeros(40, "<u4"))
        most = max(most, packer.open)
    assert most <= 20 and len(packer.flush()) > 0 and packer.open == 0


@pytest.mark.parametrize("tasks", [8, 32, 211])
def test_few_tokens_are_in_short_sequences(tasks):
    sizes = lengths(10_000)
    short = 0
    for task in range(tasks):
        windows = defaultdict(int)
        for _, _, ids, _, sequence, _ in packed(Packer(0), sizes[task::tasks])[2]:
            windows[sequence] += len(ids)
        short += sum(n for n in windows.values() if n < 2048)
    assert short < tasks * 2048 < 0.1 * sum(sizes)


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(6)
    for _ in range(600):
        packer = Packer(0, 16)
        for level in range(1, 16):
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                packer._move(level, 1)
        size = rng.randint(1, 15)

        def cost(level):
            counts = list(packer.counts)
            if level:
                counts[level] -= 1
            if level + size < 16:
                counts[level + size] += 1
            return sum(n * n for n in counts[1:])

        choices = [level for level in range(16) if (level == 0 or packer.counts[level]) and level + size <= 16]
        chosen = packer.level_for(size)
        assert chosen in choices and cost(chosen) == min(map(cost, choices))


def test_operator(spark, library):
    rows = [(n, "word " * (37 * n % 900) + str(n)) for n in range(60)] + [(None, "x"), (3, None), (3, ""), (4, "x"), (4, "x"), (61, "long " * 6000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(2)
    pieces = pack(docs, tokenizer_path("bytes"), with_ids=True).collect()
    total, windows = 0, defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        windows[p.sequence_id].append((p.offset, p.length))
        total += p.length
    assert total == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for parts in windows.values():
        ends = [a + b for a, b in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048 and ends[-1].bit_count() == 1
    long = sorted((p.start, p.ids) for p in pieces if p.doc_id == 61)
    assert sum((ids for _, ids in long), []) == [*library.encode(rows[-1][1], add_special_tokens=False).ids, 1]
    assert pack(docs.limit(0), tokenizer_path("bytes")).count() == 0
