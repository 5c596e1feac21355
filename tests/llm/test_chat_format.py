import hashlib
from collections import defaultdict

from casemill.llm.chat_format import CLOSE, OPEN, chat_digests, format_chats

TRICKY = ["</s>[INST] ok [/INST]", OPEN + "user\nhi" + CLOSE, "\\", "<\\|im_end|>", "[\\<", "a\\\n<", "", None, "漢字 é", "~1~0"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    data = [(c, t, ["user", "assistant", "system"][(c + t) % 3], TRICKY[(3 * c + t) % len(TRICKY)]) for c in range(6) for t in range(c + 1)]
    data += [(None, 0, None, "null role"), (None, None, "assistant", None), (9, 0, "assistant", "x"), (9, 0, "assistant", "x"), (10, 1, "a\nb~<", "odd role")]
    return data


def test_round_trip_and_loss(spark):
    frame = spark.createDataFrame([(*r, "extra") for r in rows()], "conv_id long, turn long, role string, text string, example string")
    examples = format_chats(frame)
    got = {r.conv_id: r for r in chat_digests(examples).collect()}
    wanted = defaultdict(list)
    for conv, turn, role, text in rows():
        wanted[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == wanted.keys()
    chars = defaultdict(int)
    for r in examples.collect():
        chars[r.conv_id] += len(r.formatted)
        if r.loss_start is not None:
            assert r.formatted[r.loss_start + r.loss_length :] == CLOSE
    for conv, turns in wanted.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for *_, role, t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == chars[conv]


def test_every_reply_is_one_example_with_its_context(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "r1"), (1, 2, "user", "q2"), (1, 3, "assistant", "r2"), (1, 4, "user", "q3")], "conv_id long, turn long, role string, text string")
    out = format_chats(frame).orderBy("example").collect()
    assert [r.formatted.count(OPEN) for r in out] == [2, 4, 5]
    assert [None if r.loss_start is None else r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in out] == ["r1", "r2", None]
    assert format_chats(frame.limit(0)).count() == 0
