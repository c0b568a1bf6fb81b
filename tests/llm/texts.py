"""Invented documents."""

import random


def words(n: int, seed: int, size: int = 5000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def text(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


ODD = [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "ÉÈ ß 日本語 \U0001f600 x²"), (None, "no id at all here"), (105, "same text twice over"), (105, "same text twice over"), (106, "same text twice over"), (107, "word " * 30_000)]
