"""Helpers of these tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, score_ double, items_ string, at int"


def rows_of(texts, start=1):
    return [(i, t, "en", "src0", len(t or ""), "k", 0.5, "x", 1) for i, t in enumerate(texts, start)]


def random_texts(seed, n, words=40, vocabulary=60, copies=0.5):
    """Texts that share passages: pieces of earlier texts are spliced into later ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        parts = [rng.choice(vocab) for _ in range(rng.randint(0, words))]
        if out and rng.random() < copies:
            source = rng.choice(out).split()
            a = rng.randint(0, len(source))
            at = rng.randint(0, len(parts))
            parts[at:at] = source[a : a + rng.randint(5, 60)]
        glue = [rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in parts]
        out.append("".join(p + g for p, g in zip(parts, glue, strict=True)))
    return out


EDGES = [None, "", "   ", "\n\n", "one", "a" * 50_000, "word " * 5_000, "same text here", "same text here", "日本 " * 300, "x\ny\nz\nx\ny\nz\nx\ny\nz"]
