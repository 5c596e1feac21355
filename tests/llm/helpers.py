"""Plain Python restatements used as oracles."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, words):
    found = WORD.findall(ascii_lower(text or ""))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def jaccard_components(rows, words, percent):
    """(set size, smallest id) per position of ``rows`` [(id, text)], by comparing all pairs."""
    sets = [shingle_set(text, words) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            root = find(i)
            smallest[root] = min(key, smallest.get(root, key))
    return [(len(s), smallest.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def within_one_word(line, other, percent):
    """Whether one word replaced, added or left out makes ``other`` of ``line``, at most 100 - percent percent of the longer one's."""
    a, b = line.split(" "), other.split(" ")
    if max(len(a), len(b)) * (100 - percent) < 100:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(a == b[:at] + b[at + 1 :] for at in range(len(b)))


def near_copies(seed=3, bases=6, copies=6):
    """Texts with exact and near copies, some short, blank, empty or null."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "é", "漢字", "x1", "The", "of", "end."]
    texts = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 3, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append((" " if rng.random() < 0.8 else "\n").join(words))
    return [*texts, "", None, "  \n", "one", "ONE", "one two", None]
