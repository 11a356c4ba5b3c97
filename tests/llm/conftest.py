import random

import pytest

HOSTILE = "doc_id long, text string, lang string, source string, n_chars long, node string, k1 long, text_hash string, held_out string, size string, block string, score string"


def hostile(rows):
    """Rows (doc_id, text) with extra columns whose names operators use inside."""
    return [(i, t, "en" if k % 2 else "de", "s", len(t or ""), "x", 1, "h", "?", "z", "b", "q") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) with clashing extra columns."""
    return lambda rows: spark.createDataFrame(hostile(rows), HOSTILE)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, edits, shared passages, repeats, nulls, empty and long ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(120) for _ in range(4)]
    out = []
    for _ in range(90):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        k = rng.random()
        if k < 0.4:
            p, a = rng.choice(passages), rng.randint(0, 100)
            parts.insert(1, p[a : a + rng.randint(300, 700)])
        elif k < 0.6 and out:
            old = rng.choice(out)
            j = rng.randint(0, len(old))
            parts = [old[:j] + "#" + old[j + 1 :]]
        out.append(" ".join(parts))
    return [*out, None, "", " \n\t ", "one", "One", "a" * 1500, "xyz " * 400, "same line here today again\n" * 60, out[3], out[3], text(4000)]
