import random

import pytest

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture
def corpus(spark):
    """Documents with exact and near copies, shared passages, hot texts, nulls, ties, long and empty texts, and clashing columns."""
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    passage = text(70)
    base = text(200).split()
    rows: list[tuple] = []
    for _ in range(25):
        rows.append(text(rnd.randint(1, 120)))
    rows += [passage + " " + text(30), text(12) + "\n" + passage, passage, text(5) + "\t" + passage + "  " + text(40) + " " + passage]
    rows += ["same text"] * 9 + ["Same text", "", "", None, " \n ", "a", "a b", "é ü", "x" * 3000, text(5000)]
    for _ in range(12):
        w = list(base)
        w[rnd.randrange(len(w))] = "zz"
        rows.append(" ".join(w))
    out = [(i * 7 % 1009, t, rnd.choice(["s1", "s2", None, "S"]), "id", 1) for i, t in enumerate(rows)]
    out += [out[3], out[-1], (None, "nobody's text", "s1", "k", 2), (None, None, "s1", "k", 2)]
    return spark.createDataFrame(out, "doc_id long, text string, source string, id string, size int").repartition(5)


@pytest.fixture
def empty(corpus):
    return corpus.where("1 = 0")
