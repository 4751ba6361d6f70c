"""Skewed ids and crowded lists; fingerprints against a parse of their own."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
import xxhash
from helpers import sha, similar
from pyspark.sql import functions as F

from geoloom.llm import base, lzprint, pivots, setjoin


def phrases(text: str) -> set[str]:
    """The dictionary of a text: each phrase is the shortest stretch from where the last one ended that isn't in it yet."""
    out, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in out:
            end += 1
        if end > len(text):
            break
        out.add(text[at:end])
        at = end
    return out


def print_of(text: str) -> tuple[str, list[int]]:
    least = sorted({xxhash.xxh32_intdigest(p) for p in phrases(text)})[:64]
    return base64.b64encode(b"".join(x.to_bytes(4, "little") for x in least)).decode(), least


def alike(a: list[int], b: list[int]) -> float:
    both = sorted({*a, *b})[:64]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def want(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        (p, a), (q, b), (_, c) = map(print_of, (t, edited, nxt))
        out.append((i, len(t), sha(edited), p, q, alike(a, b), alike(a, c)))
    return out


@pytest.mark.parametrize("sample", [1 << 15, 16])
def test_follow_equals_a_plain_parse(spark, docs, corpus, sample, monkeypatch):
    monkeypatch.setattr(lzprint, "SAMPLE", sample)
    assert sorted(tuple(r) for r in lzprint.follow(docs).collect()) == sorted(want(corpus))


def test_ids_may_lie_anywhere(spark, monkeypatch):
    monkeypatch.setattr(lzprint, "SAMPLE", 512)
    rng = random.Random(4)
    ids = [*range(3000), 1 << 60, *[None] * 1500, *[77] * 900]
    rows = [(i, f"{rng.random()} text of {k % 40}") for k, i in enumerate(ids)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed, heads = lzprint.stretches(base.documents(d), 16)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(heads) == len(sizes) == 16 and max(sizes) < 3 * len(rows) / 16
    out = lzprint.follow(d).collect()
    names = {(r.doc_id, r.text): r.h for r in base.documents(d).collect()}
    order = sorted(rows, key=lambda r: (base.NULL_ID if r[0] is None else r[0], names[r]))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want(order)))


@pytest.mark.parametrize("block", [10, 60, 2048])
def test_crowded_lists_are_split(spark, block, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    r = np.random.default_rng(6)
    centres = r.normal(size=(25, 24))
    m = np.concatenate([np.repeat(centres, 6, axis=0) + r.normal(size=(150, 24)) * 0.05, r.normal(size=(300, 24)), np.ones((80, 24)) + r.normal(size=(80, 24)) * 0.02])
    m = np.concatenate([m, np.repeat(m[:3], 40, axis=0)])  # copies
    vid = r.permutation(len(m))
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(vid, m, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    got = {x.vec_id: x for x in pivots.near(d, 0.95).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(m), dtype=bool)
    found = np.array([got[int(i)].n_links for i in vid])
    assert (found <= link.sum(axis=1)).all() and found.sum() >= 0.98 * link.sum()
    assert sum(x.kept for x in got.values()) == len({x.component_id for x in got.values()})
    copies = [got[int(i)] for i, v in zip(vid, m, strict=True) if (v == m[0]).all()]
    assert len(copies) == 41 and len({(x.n_links, x.component_id) for x in copies}) == 1 and copies[0].n_links >= 40
    assert pivots.near(d.where(F.col("vec_id") < 0)).count() == 0


def test_configurations_are_near_the_programmes_bound():
    from geoloom.llm import packing

    # Three of 700 fit, two of 1000, and one of each leaves room for neither: 30 + 40 pieces need 10 + 20 sequences.
    chosen = packing.optimal_configurations([1000, 680], [40, 30], 2048)
    assert sum(t for _, t in chosen) == 30 and all(u @ [1000, 680] <= 2048 for u, _ in chosen)
    assert packing.optimal_configurations([], [], 2048) == []
    rng = random.Random(8)
    sizes = sorted((rng.randint(300, 2000) for _ in range(20)), reverse=True)
    counts = [rng.randint(50, 400) for _ in sizes]
    chosen = packing.optimal_configurations(sizes, counts, 2048)
    used = sum(u * t for u, t in chosen)
    assert (used <= counts).all() and all(u @ sizes <= 2048 for u, _ in chosen) and (np.array(counts) - used).sum() < 60
    value, use = packing.worthiest(np.array([5, 3]), np.array([0.6, 0.3]), 11)
    assert value == pytest.approx(1.2) and use.tolist() == [2, 0]


def test_large_blocks_are_searched_whole(spark, monkeypatch):
    # A hub of near copies, a chain whose ends aren't alike, a second hub that shares most of its words and sets that link with one copy only.
    monkeypatch.setattr(setjoin, "BLOCK", 1500)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for hub in (words, [*words[:30], *(f"v{k}" for k in range(10))]):
        for _ in range(60):
            t = list(hub)
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(t))
    chain = list(words)
    for k in range(12):
        chain[3 * k] = f"y{k}"
        rows.append(" ".join(chain))
    rows += [" ".join([*words[:20], *(f"z{k}{j}" for j in range(20))]) for k in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size, percent in ((1, 90), (2, 80), (1, 60)):
        want = similar(rows, size, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similar(d, size, percent).collect()} == want
