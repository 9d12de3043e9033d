import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an th er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text): null, empty and blank texts, exact and near copies, wide characters, a long text, a repeated row."""
    rng = random.Random(7)
    base = words(rng, 400).split()
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (20, 200, 380)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "One\tTWO"), (6, " ".join(base)), *((7 + k, t) for k, t in enumerate(near))]
    rows += [(20, " ".join(base)), (21, " ".join(base)), (21, " ".join(base)), (22, "ÉÀ ß 日本 🙂 'tis it's 12 345"), (23, words(rng, 8000)), (24, "a  b   c d\r\n\r\ne")]
    rows += [(30 + k, words(rng, rng.randint(5, 60))) for k in range(25)] + [(None, "no id at all"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, messy):
    """The messy rows with clashing extra columns: names that the operators use inside."""
    rows = [(d, t, None, "s", len(t or ""), k, "x") for k, (d, t) in enumerate(messy)]
    return spark.createDataFrame(rows, SCHEMA + ", length int, node string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
