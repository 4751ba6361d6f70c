from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def corpus():
    """Documents with copies, near copies, shared passages, periodic, empty, null, very long and non-ASCII texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeéüß", k=rng.randint(1, 7))) for _ in range(150)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passage, base = prose(80), prose(200)
    texts = [None, "", " \t\n", "one", "Two words", base, base, base.upper(), prose(30) + "\n" + passage + " " + prose(20), passage + "\r\n\x0b" + prose(9)]
    texts += [base.replace(vocabulary[k], "zz", 1) for k in range(6)]
    texts += ["as " * 200, "a" * 700, "ab" * 300 + prose(5), "漢字 🎉 " * 60, prose(9000) + passage, "\n".join(["line one here", "line two here", ""] * 5)]
    texts += ["line one here\nline two here\nown " + prose(8), "\n\n  \nline two here\nline one here"]
    texts += [prose(rng.randint(1, 120)) for _ in range(25)]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    """The corpus out of order, with further columns under names that operators use inside."""
    rows = [(i, t, "x", 5, "k", 1.5) for i, t in corpus]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, key string, h long, component string, score double").repartition(3)
