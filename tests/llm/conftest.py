import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, "
          "lang_pred int, digest string, norm string, n int, node string, key string, row int")


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text, lang, source), with columns of clashing names."""

    def make(rows, parts=3):
        full = [(*(list(r) + [None] * 4)[:4], -1, "x", 7, None, "y", 3, "z", "k", 0) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Some invented texts with copies, near copies, shared passages, odd and long ones."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(120)
    out = []
    for i in range(60):
        out.append((i, text(rng.randint(1, 200))))
    for i in range(60, 75):
        base = out[i - 40][1].split()
        base[rng.randrange(len(base))] = "changed"
        out.append((i, " ".join(base)))
    for i in range(75, 85):
        out.append((i, text(30) + " " + passage + " " + text(30)))
    for i in range(85, 100):
        out.append((i, out[5][1].upper() if i % 2 else out[5][1]))
    out += [(100, None), (101, ""), (102, "  \n\t "), (103, "one"), (104, "ONE"), (105, "É é"),
            (106, "é É"), (107, "ab " * 1500), (108, "ab " * 2000), (109, text(20_000)),
            (110, "don't 'tis  \n\n x 12ab <|endoftext|> 🙂🙂 ñandú"), (None, "no id here"),
            (5, out[5][1]), (5, out[5][1])]
    return out
