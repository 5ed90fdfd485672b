import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _tie string, size int"


def rows(seed: int = 1, n: int = 60):
    """Documents with nulls, blanks, a long text, ties, copies and clashing columns."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ünder", "The", "END."]
    out = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 6)))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(text), 0.5, "x", 1))
    out += [(n + i, out[5][1], "en", "a", 1, None, None, None) for i in range(4)]
    changed = out[7][1].split(" ")
    changed[0] = "changed"
    out += [(n + 4, " ".join(changed), "en", "a", 1, None, None, None)]
    out += [(n + 5, None, None, None, None, None, None, None), (n + 6, "", "fr", "", 0, 0.0, "", 0), (n + 7, " \t\n ", "fr", "b", 0, 0.0, "", 0)]
    out += [(None, "no id here at all, just words", None, "a", None, None, None, None)]
    out += [(n + 8, "long " * 20_000 + "tail", "en", "a", None, None, None, None)]
    out += [out[3], out[3]]
    return out


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
