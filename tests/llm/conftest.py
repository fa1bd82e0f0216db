import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts with near and exact copies, repeats, empty and very long ones, odd characters and a null."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7)))
    out = [" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    for t in out[:12]:
        w = (t + " tail of the text").split(" ")
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    shared = " ".join(word() for _ in range(60))
    out += [f"{out[k]} {shared[rnd.randint(0, 60):]} {word()}" for k in range(8)]
    out += out[3:6] + ["", None, " \n\t ", "a", "The same line here today ok yes no\n" * 30, "x" * 3000, "ab" * 900, "Σ İ 한국어 １２ 😀 <|endoftext|>x don't I'LL", "one two three four", "A\x1cB\x85C D"]
    out.append(" ".join(word() for _ in range(20000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with columns that clash with names the operators use."""
    rows = [(i * 3, t, "k", 1, 2) for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, key string, _id int, n_chars int").repartition(5)


@pytest.fixture(scope="session")
def by_id(texts):
    return {i * 3: t or "" for i, t in enumerate(texts)}
