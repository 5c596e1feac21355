import random

import numpy as np
from tokenizers import Tokenizer

from casemill.llm.catalogue import tokenizer_path
from casemill.llm.packing import Encoder


def test_blanks_inside_white_space_equal_the_library():
    path, rng = tokenizer_path("bytes"), random.Random(8)
    library, encode = Tokenizer.from_file(path), Encoder(path)
    parts = ["a", "b", "<|endoftext|>", " ", "  ", "\u00a0", "\n", "\t", "\u3000", "\x85", "\u200b"]
    texts = ["a" + " \u00a0 \u00a0 b", "a \u00a0 \u00a0 \u00a0 b\nc d", "\u00a0 <|endoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
