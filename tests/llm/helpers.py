"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def byte_repeats(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple]:
    """n_bytes, n_removed, n_spans, kept digest of each document; docs in order of id."""
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                covered[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        out[i] = len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), sha(bytes(c for c, z in zip(b, covered, strict=True) if not z))
    return out


def word_repeats(docs: list[tuple[int, str | None]], n: int) -> dict[int, tuple]:
    first, out = {}, {}
    for i, t in docs:
        w = WORD.findall(t or "")
        covered = [0] * len(w)
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), i) < i:
                covered[p : p + n] = [1] * n
        out[i] = len(w), sum(covered), sha(" ".join(c for c, z in zip(w, covered, strict=True) if not z))
    return out


def shingles(t: str | None, size: int) -> set:
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[p : p + size]) for p in range(max(1, len(w) - size + 1))} if w else set()


def similar(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple]:
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_repeats(docs: list[tuple[int, str | None]], n: int) -> dict[int, tuple]:
    """n_lines, n_removed, n_runs, text left."""
    seen, out = set(), {}
    for i, t in docs:
        lines = (t or "").split("\n")
        real = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for p in range(len(real) - n + 1):
            w = tuple(lines[k] for k in real[p : p + n])
            if w in seen:
                gone |= set(range(p, p + n))
            seen.add(w)
        drop = {real[k] for k in gone}
        left = t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop)
        out[i] = len(real), len(gone), sum(k - 1 not in gone for k in gone), left
    return out
