import random

import pytest

#: Columns whose names clash with those the operators use inside.
CLASHES = "_id string, _text string, part string, fp string, row string, size string, _part string, block string, start string, found string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
#: Word sequence, long, of no repetition to speak of.
_rng = random.Random(5)
VOCAB = ["".join(_rng.choice("abcdefghiklmnoprstuvé") for _ in range(_rng.randint(2, 9))) for _ in range(900)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(1, 30_000)
BASE = prose(2, 120)
EDGE_ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, "   \n\t"), (None, prose(3, 50)), (None, None), (6, LONG),
    (7, BASE + " " + prose(4, 3)), (8, "x" * 5_000), (9, "ü€😀 " * 40), (10, prose(5, 60) + " " + BASE), (11, "one"), (12, "one two three four"),
    (13, 'password = "hunter2-secret" token=key secret: abcdef0123456789abcdef0123456789'), (14, "<|endoftext|> and <|startoftext|>don't  stop\r\n\r\n  x"), (15, BASE.upper()), (3, None),
]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE_ROWS


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, None if k % 3 == 0 else "en", None, None if t is None else len(t), *["x"] * 10) for k, (i, t) in enumerate(EDGE_ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
