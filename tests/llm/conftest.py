import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    syllables = ["ta", "rin", "os", "é", "mo", "len", "ver", "ün", "ka", "thi"]
    return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    text = prose(1, 80)
    return [
        (1, text, "en", "a", 10), (1, text, "en", "a", 10), (1, prose(2, 70), "fr", "b", 5),
        (None, prose(3, 60), None, None, None), (None, None, None, None, None), (4, None, "en", "a", 0),
        (5, "", "de", "b", 0), (6, " \t\n ", "de", None, 4), (7, prose(4, 30_000), "es", "b", 9), (8, "x" * 50_000, "en", "a", 1),
        (9, text + " mehr", "en", "c", 3), (10, text, None, "c", 3), (11, "é́ \U0001F600 n b", "fr", "a", 2),
        (12, "a b c d e f " * 20, "en", "a", 3), (2**62, prose(5, 90).replace(" ", "\n", 30), "de", "a", 1),
        (-3, "one | two | three $$$ ### " * 20, "en", "b", 2),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
