"""A small corpus that holds the hard cases: nulls, empty and very long texts, copies, near copies, ties."""

import random

import pytest

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, sig string, key long, label int"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "One", "one two", "x" * 5000, "a " * 3000, "\n".join(base[:3] * 3), "<|endoftext|> and\x00zero\x1c end"]
    texts += base + base[:6]
    for b in base[:20]:
        words = b.split()
        for _ in range(2):
            w = list(words)
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [base[k][:80] + " " + passage + "\n" + base[k + 1][:80] for k in range(6)]
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), k, "sig", 0, 1) for k, t in enumerate(texts)]
    # a repeated row, and an id that two texts share
    return [*rows, rows[15], (rows[16][0], "another text under the same id", "en", "src0", 3, 0, "s", 0, 0)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
