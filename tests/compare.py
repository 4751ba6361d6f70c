"""Comparison of a frame with what DuckDB says."""

from __future__ import annotations


def plain(v):
    """A value in a form that both engines print alike."""
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v + 0.0 if isinstance(v, float) else v


def same(df, relation) -> None:
    """Rows of a frame and of a DuckDB relation, columns by name, in any order."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [relation.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
