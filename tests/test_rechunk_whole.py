from casemill.operators import chunking


def test_a_long_text_keeps_its_end():
    paragraphs = [f"{n} " + "w" * 1100 for n in range(700)]
    chunks = chunking.even([(p, []) for p in paragraphs])
    assert len(chunks) == 700 and "".join("".join(chunks).split()) == "".join("".join(paragraphs).split())
