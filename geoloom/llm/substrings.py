"""Removal of repeated byte strings and repeated word windows from documents.

bytes_dedup: a byte goes if a previous factor of LENGTH bytes or more covers it. Strings that share a minimiser meet in one bucket (windows.py), where
longest-previous-factor arrays are made from the order of their suffixes (factors.py); equal strings are combined before they travel. So
the earliest window of each content stays (smaller id, or same document, earlier) and all others go.

words_dedup: windows of WORDS words by super-k-mers; windows whose words also start in a document with a smaller id go.

Both judge the input, not what is left. Null and empty texts come back with nothing removed. A null id comes before every other id.
Rows that share an id and text get equal results; rows that share an id only are documents of their own, which for bytes_dedup follow
each other by a hash of their text and for words_dedup don't come before each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import Scheme, find_repeats, remove

LENGTH = 100
WORDS = 50


def spans_of(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the covered runs, and the first run of each document (one more than documents)."""
    n = len(covered)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    begin, stop = covered.copy(), covered.copy()
    begin[1:] &= ~covered[:-1] | edge[1:-1]
    stop[:-1] &= ~covered[1:] | edge[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, first)


def _spans_array(s: np.ndarray, e: np.ndarray, of: np.ndarray, first: np.ndarray) -> pa.Array:
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    both = pa.StructArray.from_arrays([pa.array(s - first[doc]), pa.array(e - first[doc])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), both)


def bytes_dedup(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes) and kept (the bytes that stay) of every document."""
    scheme = Scheme(length, max(1, min(24, length // 2)), by_word=False, within=True)
    grouped, flags, _ = find_repeats(docs, scheme, text, doc_id)

    def finish(rows, data, offsets, first, covered, s, e):
        kept = data[~covered]
        sizes = np.diff(np.concatenate([[0], np.cumsum(~covered)])[offsets])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        blob = kept.tobytes()
        bs, be, of = spans_of(covered, first)
        left = pa.array([blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), _spans_array(bs, be, of, first), left], names=["doc_id", "n_bytes", "spans", "kept"])

    return remove(grouped, flags, scheme, finish, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def words_dedup(docs: DataFrame, words: int = WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, spans (removed, in words) and kept (the words that stay, joined by a space) of every document."""
    scheme = Scheme(words, max(1, min(8, words // 4)), by_word=True, within=False)
    grouped, flags, _ = find_repeats(docs, scheme, text, doc_id)

    def finish(rows, data, offsets, first, covered, s, e):
        # Each kept word with a space behind it; the last space of a document goes again.
        keep = ~covered
        ks, ke = s[keep], e[keep]
        size = ke - ks + 1
        total = int(size.sum())
        joined = np.full(total, 32, np.uint8)
        before = np.cumsum(size) - size
        place = np.ones(total, np.int64)
        if total:
            place[before] = ks - np.concatenate([[0], ke[:-1]])
            source = np.cumsum(place)
            last = before + size - 1
            inside = np.ones(total, bool)
            inside[last] = False
            joined[inside] = data[source[inside]]
        n_kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[first])
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_kept)])]
        blob = joined.tobytes()
        left = pa.array([blob[a : max(a, b - 1)].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        bs, be, of = spans_of(covered, first)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(first)), _spans_array(bs, be, of, first), left], names=["doc_id", "n_words", "spans", "kept"])

    return remove(grouped, flags, scheme, finish, "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept string")
