"""What the brute-force checks share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the quick brown fox jumps over the lazy dog while seven green parrots watch from an old oak tree and count every leaf".split()


def words(text):
    return WORD.findall(text or "")


class Groups:
    """Union-find for brute-force checks."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def made_texts():
    """Small documents: exact and near copies, shared passages, repeated lines, odd and empty texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = [None, "", " ", "\n\n", "one", "one", "é ü 日本", "12 34 !!", "x" * 5000]
    near = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        copy = list(near)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    for _ in range(25):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        lines = [" ".join(own[i : i + 15]) for i in range(0, len(own), 15)]
        if rng.random() < 0.6:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if rng.random() < 0.5:
            lines.append(lines[0])
        texts.append("\n".join(lines))
    texts += texts[-4:] + ["rep " * 80, "ab" * 700, passage]
    return texts
