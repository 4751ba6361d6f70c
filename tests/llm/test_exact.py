"""Cases in which hashes, ids or columns agree and what they stand for doesn't; every result is compared with a plain version."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import byte_repeats, similar, word_repeats
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoloom.llm import base, factors, hashing, lines, packing, setjoin, substrings

WORDS = public_tokenizers.path("word_bpe_49k.json")


def twins(n: int = 2048) -> tuple[str, str]:
    """Two words with one polynomial hash modulo 2^64, whatever its odd base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_twins_agree_in_the_polynomial_hash():
    a, b = (hashing.word_hashes(*base.text_bytes(pa.array([x])))[0][0] for x in twins())
    assert a == b
    a, b = (hashing.keyed_hashes(base.text_bytes(pa.array([x]))[0])[0] for x in twins())
    assert a != b


@pytest.fixture
def twin_rows():
    a, b = twins()
    rest = " ".join(f"w{k}" for k in range(60))
    return [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b), (5, f"{a} x"), (6, f"{b} x"), (7, f"{a} {rest}")]


def test_twins_stay_apart(spark, twin_rows):
    d = spark.createDataFrame(twin_rows, "doc_id long, text string")
    for size, percent in ((3, 90), (1, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similar(d, size, percent).collect()}
        assert got == similar(twin_rows, size, percent)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans)) for r in substrings.words_dedup(d).collect()}
    assert got == {i: x[:2] for i, x in word_repeats(twin_rows, 50).items()}
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept)) for r in substrings.bytes_dedup(d).collect()}
    assert got == {i: x[:2] for i, x in byte_repeats(twin_rows, 100).items()}
    t = Tokenizer.from_file(WORDS)
    w = packing.Words(WORDS)
    for rows in (twin_rows, twin_rows[::-1]):
        texts = [x for _, x in rows]
        ids, first = w.encode(*base.text_bytes(pa.array(texts)), 0)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]


def plain_factors(strings: list[bytes]) -> list[int]:
    at = [(s, i) for s in strings for i in range(len(s))]
    out = []
    for k, (s, i) in enumerate(at):
        best = 0
        for t, j in at[:k]:
            n = 0
            while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@given(st.lists(st.one_of(st.binary(max_size=30), st.text("ab", max_size=60).map(str.encode)), max_size=5), st.sampled_from([1, 3, 8, 10, 17, 40]))
@settings(max_examples=150, deadline=None)
def test_previous_factors(strings, least):
    strings += strings[:1]
    data = np.frombuffer(b"".join(strings), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    want = plain_factors(strings)
    assert factors.previous_factors(data, first).tolist() == want
    assert factors.previous_factors(data, first, least).tolist() == [x if x >= least else 0 for x in want]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdef", k=4)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passage = prose(70)
    rows = [(5, prose(400) + " " + passage), (5, prose(10)), (5, passage), (6, "own " + passage)]
    rows += [(None, prose(rng.randint(1, 300))) for _ in range(500)] + [(None, "null " + passage + " " + prose(40)), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.n_words, sum(s.end - s.start for s in r.spans)) for r in substrings.words_dedup(d).collect() if r.doc_id is not None}
    # The null id's copy comes first, so all three others lose theirs.
    assert got == {(470, 70), (10, 0), (70, 70), (71, 70)}
    assert sum(len(r.spans) for r in substrings.words_dedup(d).collect() if r.doc_id is None) == 0
    # By bytes, later rows of an id come after earlier ones in the order of their texts' hashes.
    order = {(r.doc_id, r.text): r.h for r in base.documents(d).collect()}
    first = sorted(rows, key=lambda r: (-1 << 63 if r[0] is None else r[0], order[r[0], r[1] or ""]))
    want = sorted(x[:3] for x in byte_repeats(list(enumerate(t for _, t in first)), 100).values())
    assert sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans)) for r in substrings.bytes_dedup(d).collect()) == want
    # Rows 1 and 2 have nothing in common, but each has a copy without an id.
    one, two = prose(60), prose(60)
    rows = [(1, one), (2, two), (None, one), (None, two), (3, one), (3, two)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in setjoin.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, False), (0, 2, False), (1, 1, True), (2, 2, True), (3, 1, False), (3, 2, False)]


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, 1, "a"), (1, text, 1, "a"), (1, "another text altogether here", 2, "b"), (2, text, 3, "c"), (None, text, 4, "d"), (None, None, 5, "e"), (None, "", 6, "f"), (4, "x y", 7, "g"), (None, "x y", 8, "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, h long, kept string")
    got = sorted((r.doc_id or 0, r.text or "", r.h, r.kept) for r in setjoin.first_of_each(d).collect())
    assert got == sorted([(1, text, 1, "a"), (1, rows[2][1], 2, "b"), (0, "", 5, "e"), (0, "", 6, "f"), (4, "x y", 7, "g")])
    assert setjoin.first_of_each(d.limit(0)).count() == 0


def test_lines_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a\nb", 1, 2, 3, 4), (2, "a\nb\nc", 5, 6, 7, 8)], "doc_id long, text string, key int, h int, removed int, _key int")
    got = sorted(tuple(r) for r in lines.dedup_lines(d).collect())
    assert got == [(1, "a\nb", 1, 2, 3, 4, 2, 0, 0), (2, "c", 5, 6, 7, 8, 3, 2, 1)]
    odd = d.withColumnsRenamed({"key": "__key", "h": "__h", "removed": "__removed"})
    assert lines.dedup_lines(odd).where(F.col("__removed").isNotNull()).count() == 2


def test_a_frequent_line_fills_no_bucket(spark):
    """Most documents hold one line; its grams come last in the order of minimisers, and results stay the same."""
    rng = random.Random(3)
    line, long = " ".join(f"line{k}" for k in range(30)), " ".join(f"long{k}" for k in range(90))
    rows = [(i, " ".join([*(f"{rng.random()}" for _ in range(40)), long if i % 3 == 0 else line, *(f"{rng.random()}" for _ in range(40))])) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans)) for r in substrings.words_dedup(d).collect()}
    assert got == {i: x[:2] for i, x in word_repeats(rows, 50).items()}
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans)) for r in substrings.bytes_dedup(d).collect()}
    assert got == {i: x[:3] for i, x in byte_repeats(rows, 100).items()}
