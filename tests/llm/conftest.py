import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Names that the operators use inside, as columns of the input.
CLASHING = "source string, n_chars long, words long, id long, key long, rep long, tile long, n long, row long, least long, runs string, windows string, _id long, _q long, held_out string, component_id long, keep long, host string, element string, length long, rank long, label2 string"


def clash(row):
    return (*row, *["x" if " string" in c else 7 for c in CLASHING.split(",")])


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([clash(r) for r in rows], "doc_id long, text string, " + CLASHING)

    return make


@pytest.fixture
def scratch(spark):
    from fleetscope.llm.common import Scratch

    return Scratch(spark)


@pytest.fixture(scope="session")
def prose():
    """Texts with exact and near copies, shared passages, repeats, nulls, empty and one long text."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Äpfel", "naïve", "don't", "e.g.", "#tag", "a*b"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, make(rng.randint(1, 120))) for i in range(1, 41)]
    passage = make(30)
    for i in range(41, 47):
        rows.append((i, make(20) + " " + passage + "\n" + make(10)))
    for i in range(47, 53):
        words = rows[i - 40][1].split()
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(53, rows[0][1]), (54, rows[0][1].upper()), (55, None), (56, ""), (57, " \t\n\x0b\x0c\r "), (58, "one"), (59, "one two"), (60, "la la la la la la la la la la la la la la la la"), (61, "x\u00a0y\u2003z \x1c end"), (62, make(6000)), (63, "line a b\nline a b\n\nline a b\nother $$ || <>")]
    return rows
