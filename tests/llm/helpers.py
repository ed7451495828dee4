"""Small tables and word rules that the tests share."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, texts, **columns):
    """A documents table with ids 0.. and the given texts."""
    rows = [
        (i, t, columns.get("lang", "en"), f"src{i % 3}" if i % 7 else None, len(t or ""))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed: int, count: int = 60, size: int = 60, vocabulary: int = 400) -> list[str | None]:
    """Texts with exact copies, near copies, shared passages, repeats and edge cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    out: list[str | None] = []
    passage = " ".join(r.choice(vocab) for _ in range(40))
    for _ in range(count):
        kind, text = r.random(), " ".join(r.choice(vocab) for _ in range(r.randint(1, size)))
        old = [t for t in out if t]
        if kind < 0.15 and old:
            text = r.choice(old)
        elif kind < 0.5 and old:
            parts = r.choice(old).split(" ")
            for _ in range(r.randint(1, 3)):
                parts[r.randrange(len(parts))] = r.choice(vocab)
            text = " ".join(parts)
        elif kind < 0.6:
            text = text + "\n" + passage + "\n" + text
        elif kind < 0.65:
            text = " ".join(text.split(" ")[:6] * 12)
        out.append(text)
    return out + [None, "", " \n\t ", "one", "One two", "x" * 3000, "aaa\n" * 60, "　  \x1c", "A b\rc\x0bd\x0ce f"]
