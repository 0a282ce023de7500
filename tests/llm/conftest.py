from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, _row int, _text string"


def awkward_rows() -> list[tuple]:
    """Nulls, empty and blank texts, one word, repeated rows, ties, near copies, a long text, shared
    lines and passages, non-ASCII letters; then columns whose names clash with inner ones."""
    r = random.Random(7)
    vocabulary = [f"wort{i}" for i in range(60)] + ["École", "ÉCOLE", "naïve", "日本語", "Straße", "I'm", "$%&", "|", "a<|endoftext|>b"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    line = "A line that many documents share, long enough to count É"
    base = prose(300)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "two words"), (7, base), (8, base), (8, base), (9, " ".join(near)),
        (10, base.replace(" ", "\n ")), (None, base), (None, None), (11, prose(8000)), (12, "x" * 5000), (13, "\n".join([line] * 3)),
        (27, prose(60) + "\n" + prose(20) + " " + " ".join(base.split()[40:90])), (28, "a b c d e f g h i " * 9),
    ]
    rows += [(14 + i, prose(40) + "\n  " + (line.upper() if i % 2 else line) + "\t\n" + prose(30)) for i in range(8)]
    rows += [(30 + i, prose(25) + " " + prose(r.randrange(90))) for i in range(25)]
    return [(i, t, [None, "en", "fr"][n % 3], [None, "a", "b", "b", "c"][n % 5], len(t) if t else None, 1, "x", 2, "y") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
