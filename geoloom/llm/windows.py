"""Repeated windows over a corpus, found by minimisers in two packed shuffles.

A window is `window` consecutive symbols (bytes or words) of one document. Its minimiser is the
least hash of its `gram`-symbol grams; consecutive windows with one minimiser form a super-k-mer.
Equal windows have equal minimisers, so:

1. every super-k-mer sends its minimiser, a digest of its content and its place to the minimiser's
   bucket. There, of equal super-k-mers all but the first are repeats as a whole; only where a
   minimiser has several contents are texts needed, of one super-k-mer for each content;
2. those super-k-mers travel as packed strings (bytes, or words with a space behind each) to the minimiser's bucket, where
   their windows are compared by content: words by sorting windows, bytes by longest-previous-factor arrays;
3. repeats go back to their documents.

Copies are combined before the first shuffle, so a group of copies costs a bucket one entry for each
batch of documents and not one for each copy. Grams that many documents of a bounded sample hold (a frequent line or passage) come last
in the order of minimisers, so a frequent line in many surroundings names no bucket, and windows inside a
frequent passage have one content in common. The packed strings of a minimiser with more than HOT contents nevertheless are dealt out
by a second minimiser. Both only say where windows meet: what is equal is decided by content everywhere.
Documents go to and fro in groups by hash of their id.

Contents of whole super-k-mers are compared by 128-bit digests of their bytes (XXH3): at 100 TB of text, some 3e12 super-k-mers, the chance
of any two different ones with one digest is about 1e-14. Rows that share an id are told apart by 64 bits of a hash of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bucket_count, cut, documents, input_bytes, release, sliced, text_bytes
from .factors import previous_factors
from .hashing import BYTE, Spans, expand, mix, sliding_min, word_hashes, words

#: Distinct contents of a minimiser that one task sorts; the strings of one with more are dealt out by a second minimiser.
HOT = 1 << 15
#: Entries that a task gathers before it sends them.
GATHER = 1 << 20
#: Positions that are ranked at once.
RANKED = 1 << 21
#: The sample of documents that tells frequent grams: bytes of input, and how many of its documents have to hold a gram.
SAMPLE_BYTES, FREQUENT = 8 << 20, 16
#: Slots of the table of frequent grams, and the stretches in which its counts are added up.
SLOTS, STRETCHES = 1 << 22, 64
ENTRY = ("<u4", "<u8", "<u8", "<i8", "<i8", "<u4", "<u4")  # minimiser, content, key, text hash, start, twice the windows (and one if its minimiser recurs in it)
FLAG = ("<i8", "<i8", "<u4", "<u4", "u1")  # key, text hash, start, windows, what
SHIPPED = ("<u4", "<i8", "<i8", "<u4", "<u4", "<u4")  # minimiser, key, text hash, start, windows, bytes
REPEAT, SHIP, SHIP_HOT = 0, 1, 2
POSTED, FLAGGED = 0, 1
PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Scheme:
    window: int
    gram: int
    by_word: bool
    #: Whether an earlier place in the same document makes a window a repeat.
    within: bool


class Slice:
    """Some texts: hashes of their grams, and their symbols' bytes on end (words with a space behind each)."""

    def __init__(self, column: pa.Array, scheme: Scheme, frequent: np.ndarray | None = None) -> None:
        data, offsets = text_bytes(column)
        if scheme.by_word:
            hashes, self.first = word_hashes(data, offsets)
            self.data, self.at = spaced(data, *words(data, offsets)[:2])
        else:
            hashes, self.first, self.data, self.at = BYTE[data], offsets, data, None
        grams = Spans(hashes).all(scheme.gram)
        if frequent is not None:  # frequent ones behind all others
            late = frequent[grams & np.uint64(SLOTS - 1)].astype(np.uint64) << np.uint64(63)
            grams = grams >> np.uint64(1) | late
        self.grams = grams

    def bytes_of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols [begin, end) lie in data."""
        return (begin, end) if self.at is None else (self.at[begin], self.at[end])


def spaced(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, each with a space behind it, on end, and where each begins (one more than words)."""
    size = e - s + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = data[expand(s, e - s)]
    return out, at


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of stretches of data, as two columns."""
    blob = data.tobytes()
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(blob[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def pack_columns(kinds: tuple[str, ...], *cols: np.ndarray) -> bytes:
    """Columns on end, each byte place by itself, which compresses well."""
    out = []
    for kind, col in zip(kinds, cols, strict=True):
        col = np.ascontiguousarray(col, dtype=kind)
        out.append(col.view(np.uint8).reshape(len(col), col.itemsize).T.tobytes())
    return b"".join(out)


def unpack_columns(kinds: tuple[str, ...], payload: bytes) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(payload) // sum(sizes)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(payload, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def unpack_all(kinds: tuple[str, ...], payloads: list[bytes]) -> list[np.ndarray]:
    parts = [unpack_columns(kinds, p) for p in payloads]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def split_rows(to: np.ndarray, kinds: tuple[str, ...], cols: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """For each destination in to, its rows packed."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(to[a]), pack_columns(kinds, *(c[order[a:b]] for c in cols))


def super_kmers(texts: Slice, window: int, gram: int, within: bool = False) -> tuple[np.ndarray, ...]:
    """Document, start, windows, minimiser and content digest (two columns) of every super-k-mer, and, if within, whether its minimiser recurs in it."""
    first, grams = texts.first, texts.grams
    count = np.maximum(np.diff(first) - window + 1, 0)
    has = np.flatnonzero(count)
    if not len(has):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool))
    least = sliding_min(grams, window - gram + 1)
    s = first[:-1][has]
    e = s + count[has]
    breaks = np.zeros(len(least) + 1, bool)
    breaks[s] = True
    breaks[e] = True
    breaks[1:-1] |= least[1:] != least[:-1]
    breaks[-1] = True
    at = np.flatnonzero(breaks)
    begin, end = at[:-1], at[1:]
    of = np.searchsorted(s, begin, side="right") - 1
    real = (of >= 0) & (begin < e[of])
    begin, end, of = begin[real], end[real], of[real]
    doc = has[of]
    again = recurs(grams, begin, end - begin, window - gram + 1) if within else np.zeros(len(begin), bool)
    return doc, begin - first[doc], end - begin, least[begin], *digests(texts.data, *texts.bytes_of(begin, end - 1 + window)), again


def recurs(grams: np.ndarray, begin: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Whether a super-k-mer holds its minimiser at more places than one; only then can its own windows be equal."""
    out = np.zeros(len(begin), bool)
    for i in range(0, len(begin), 1 << 14):
        b, last = begin[i : i + (1 << 14)], (begin + count - 1)[i : i + (1 << 14)]
        side = np.arange(width)
        left = b + grams[b[:, None] + side].argmin(axis=1)
        right = last + width - 1 - grams[last[:, None] + side[::-1]].argmin(axis=1)
        out[i : i + (1 << 14)] = left != right
    return out


def runs_of(order: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows of sorted columns, and their end."""
    n = len(order[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for c in order:
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def numbered(*cols: np.ndarray) -> np.ndarray:
    """A number for each row that equal rows share; few rows agree in the first column only."""
    order = np.argsort(cols[0], kind="stable")
    cuts = runs_of([cols[0][order]])
    if any((c[order][1:] != c[order][:-1])[(cols[0][order][1:] == cols[0][order][:-1])].any() for c in cols[1:]):
        order = np.lexsort(cols[::-1])
        cuts = runs_of([c[order] for c in cols])
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    return out


def repeated(number: np.ndarray, key: np.ndarray, h: np.ndarray, start: np.ndarray, within: bool) -> np.ndarray:
    """Which entries come after one with an equal number."""
    again = np.zeros(len(number), bool)
    if not len(number):
        return again
    some = np.flatnonzero(np.bincount(number)[number] > 1)
    if len(some):
        some = some[np.lexsort((start[some], h[some], key[some], number[some]))]
        begin = runs_of([number[some]])
        first = np.repeat(some[begin[:-1]], np.diff(begin))
        later = key[some] > key[first]
        if within:
            later |= (h[some] != h[first]) | (start[some] != start[first])
        again[some] = later
    return again


def window_ranks(sym: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the windows that start at these places in the order of their contents (sym has small whole numbers), by prefix doubling."""
    rank, depth = sym, 1
    while depth < window:
        ahead = min(depth, window - depth)
        next_ = np.concatenate([rank[ahead:], np.zeros(ahead, rank.dtype)])
        rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | next_.astype(np.uint64), return_inverse=True)[1]
        depth += ahead
    return np.unique(rank[at], return_inverse=True)[1]


def frequent_grams(d: DataFrame, docs: DataFrame, scheme: Scheme) -> bytes:
    """A bit for each slot: whether FREQUENT sampled documents or more hold grams that fall there. The driver sees SLOTS bits."""
    every = max(1, input_bytes(docs) // SAMPLE_BYTES)
    wide = SLOTS // STRETCHES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.uint16)
        for rows in sliced(batches, 2 << 20):
            texts = Slice(rows.column("text"), scheme)
            ends = np.maximum(np.diff(texts.first) - scheme.gram + 1, 0)
            slot = (texts.grams & np.uint64(SLOTS - 1)).astype(np.int64)
            for a, n in zip(texts.first[:-1].tolist(), ends.tolist(), strict=True):
                held = np.unique(slot[a : a + n])
                seen[held] = np.minimum(seen[held], 65534) + 1
        out = []
        for k in range(STRETCHES):
            held = np.flatnonzero(seen[k * wide : (k + 1) * wide])
            if len(held):
                out.append((k, pack_columns(("<u4", "<u2"), held, seen[k * wide + held])))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["stretch", "payload"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(wide, np.int64)
        for p in rows.column("payload").to_pylist():
            held, n = unpack_columns(("<u4", "<u2"), p)
            total[held] += n
        return pa.table({"stretch": rows.column("stretch").slice(0, 1), "bits": pa.array([np.packbits(total >= FREQUENT).tobytes()], pa.binary())})

    sampled = d.where(F.pmod(F.xxhash64("key", "h"), F.lit(every)) == 0).select("text")
    bits = {r.stretch: bytes(r.bits) for r in sampled.mapInArrow(count, "stretch int, payload binary").groupBy("stretch").applyInArrow(add, "stretch int, bits binary").collect()}
    return b"".join(bits.get(k, bytes(wide // 8)) for k in range(STRETCHES))


def find_repeats(docs: DataFrame, scheme: Scheme, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, int]:
    """Documents dealt into groups, the flags of repeats by group, and the number of groups."""
    d = documents(docs, text, doc_id)
    n_buckets = 2 * bucket_count(docs, 8 << 20)
    n_groups = 2 * bucket_count(docs, 8 << 20)
    window, gram = scheme.window, scheme.gram
    bits = frequent_grams(d, docs, scheme)

    def frequent() -> np.ndarray:
        return np.unpackbits(np.frombuffer(bits, np.uint8))

    def group_of(key: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (np.mod(key, PRIME) + np.mod(h, 1 << 16)) % n_groups

    def rows_out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    posted = pa.schema([("bucket", pa.int32()), ("what", pa.int32()), ("payload", pa.binary())])
    flagged = pa.schema([("to", pa.int32()), ("payload", pa.binary())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        often = frequent()
        turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            least, c1, c2, key, h, start, count, twice = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            again = repeated(numbered(c1, c2), key, h, start, scheme.within)
            rows = []
            flags = [c[again] for c in (key, h, start, count)]
            flags.append(np.full(len(flags[0]), REPEAT))
            step = 1 << 16
            for i in range(0, len(flags[0]), step):  # known already: they only pass through a bucket
                turn += 1
                rows.append((int(mix(np.array([key[0] & 0xFFFFFFFF, turn], np.uint64)).sum() % np.uint64(n_buckets)), FLAGGED, pack_columns(FLAG, *(c[i : i + step] for c in flags))))
            stay = ~again
            cols = [c[stay] for c in (least, c1, c2, key, h, start, 2 * count + twice)]
            to = (cols[0] % np.uint64(n_buckets)).astype(np.int64)
            cols[0] = mix(cols[0]) >> np.uint64(32)
            rows += [(b, POSTED, p) for b, p in split_rows(to, ENTRY, cols)]
            if rows:
                yield rows_out(rows, posted)

        for rows in sliced(batches, 2 << 20):
            texts = Slice(rows.column("text"), scheme, often)
            doc, start, count, least, c1, c2, twice = super_kmers(texts, window, gram, scheme.within)
            if not len(doc):
                continue
            key, h = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "h"))
            held.append((least, c1, c2, key[doc], h[doc], start, count, twice))
            if sum(len(x[0]) for x in held) >= GATHER:
                yield from flush()
        if held:
            yield from flush()
        release()

    def compare(rows: pa.Table) -> pa.Table:
        """In one bucket: repeats as a whole, and what has to be sent as text."""
        kinds, payloads = rows.column("what").to_pylist(), rows.column("payload").to_pylist()
        out = [unpack_columns(FLAG, p) for k, p in zip(kinds, payloads, strict=True) if k == FLAGGED]
        least, c1, c2, key, h, start, count = unpack_all(ENTRY, [p for k, p in zip(kinds, payloads, strict=True) if k == POSTED])
        if len(least):
            count, twice = count >> 1, count & 1
            number = numbered(c1, c2)
            again = repeated(number, key, h, start, scheme.within)
            # How many contents each minimiser has.
            pair = np.unique(least.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)) >> np.uint64(32)
            value, contents = np.unique(pair, return_counts=True)
            contents = contents[np.searchsorted(value, least)]
            send = ~again & ((contents > 1) | (twice > 0))
            for mask, what in ((again, np.full(len(least), REPEAT)), (send, np.where(contents > HOT, SHIP_HOT, SHIP))):
                out.append([key[mask], h[mask], start[mask], count[mask], what[mask]])
        return flags_out(out)

    def flags_out(parts: list[list[np.ndarray]]) -> pa.Table:
        cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(FLAG)]
        rows = list(split_rows(group_of(cols[0], cols[1]), FLAG, cols))
        release()
        return pa.Table.from_batches([rows_out(rows, flagged)] if rows else [], flagged)

    shipped = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("blob", pa.binary())])

    def ship(_: tuple, texts: pa.Table, flags: pa.Table) -> pa.Table:
        """The super-k-mers of one group of documents that others have to be compared with."""
        key, h, start, count, what = unpack_all(FLAG, flags.column("payload").to_pylist())
        want = what != REPEAT
        rows: list[tuple] = []
        often = frequent() if want.any() else None
        for part in sliced(iter(texts.combine_chunks().to_batches() if want.any() else []), 2 << 20):
            doc, flag = matched(part, key, h, want)
            if not len(doc):
                continue
            some = Slice(part.column("text"), scheme, often)
            begin, n = start[flag].astype(np.int64) + some.first[doc], count[flag].astype(np.int64)
            fits = begin + n + window - 1 <= some.first[doc + 1]
            begin, n, doc, hot = begin[fits], n[fits], doc[fits], (what[flag] == SHIP_HOT)[fits]
            # The minimiser again: the least gram of the first window.
            least = np.array([some.grams[b : b + window - gram + 1].min() for b in begin], np.uint64)
            to = least % np.uint64(n_buckets)
            if hot.any():
                second = sliding_min(mix(some.grams ^ np.uint64(0x6A09E667F3BCC909)), window - gram + 1)
                of = np.repeat(np.arange(len(begin)), n)
                places = expand(begin, n)
                new = np.ones(len(places), bool)
                new[1:] = (of[1:] != of[:-1]) | (hot[of[1:]] & (second[places[1:]] != second[places[:-1]]))
                head = np.flatnonzero(new)
                of, begin, n = of[head], places[head], np.diff(np.append(head, len(places)))
                least = np.where(hot[of], mix(least[of] ^ second[begin]), least[of])
                to = least % np.uint64(n_buckets)
                doc = doc[of]
            least = mix(least) >> np.uint64(32)
            to = to.astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = runs_of([to[order]])
            key_of, h_of = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "h"))
            a_byte, b_byte = some.bytes_of(begin, begin + n + window - 1)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                i = order[a:b]
                blob = some.data[expand(a_byte[i], b_byte[i] - a_byte[i])].tobytes()
                rows.append((int(to[i[0]]), pack_columns(SHIPPED, least[i], key_of[doc[i]], h_of[doc[i]], begin[i] - some.first[doc[i]], n[i], b_byte[i] - a_byte[i]), blob))
        return pa.Table.from_batches([rows_out(rows, shipped)] if rows else [], shipped)

    def settle(rows: pa.Table) -> pa.Table:
        """In one bucket: which windows of the packed super-k-mers come after an equal one."""
        out = []
        least, key, h, start, count, size = (c if c.dtype.kind == "i" else c.astype(np.int64) for c in unpack_all(SHIPPED, rows.column("payload").to_pylist()))
        raw = np.concatenate([np.frombuffer(b, np.uint8) for b in rows.column("blob").to_pylist()])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        # By minimiser, and within one by place, so that an earlier position is an earlier place; equal rows sent the same twice.
        order = np.lexsort((count, start, h, key, least))
        same = np.zeros(len(order), bool)
        for k, c in enumerate((least, key, h, start, count)):
            same[1:] = (c[order][1:] == c[order][:-1]) & (same[1:] if k else True)
        order = order[~same]
        cuts = runs_of([least[order]])
        a = 0
        while a < len(cuts) - 1:
            total, b = 0, a
            while b < len(cuts) - 1 and (b == a or total + size[order[cuts[b] : cuts[b + 1]]].sum() <= RANKED):
                total += size[order[cuts[b] : cuts[b + 1]]].sum()
                b += 1
            i = order[cuts[a] : cuts[b]]
            a = b
            data = raw[expand(begin[i], size[i])]
            if scheme.by_word:  # each string has its windows and window - 1 words more
                sym = pd.factorize(np.array(data.tobytes().split(b" ")[:-1], dtype=object))[0]
                first = np.concatenate([[0], np.cumsum(count[i] + window - 1)])
            else:
                sym, first = data, np.concatenate([[0], np.cumsum(size[i])])
            places = expand(first[:-1], count[i])
            of = np.repeat(i, count[i])
            at = start[of] + (places - np.repeat(first[:-1], count[i]))
            if scheme.within:
                again = previous_factors(sym, first, window)[places] >= window
            else:
                again = repeated(window_ranks(sym, places, window), key[of], h[of], at, False)
            # Repeated windows as runs.
            hit = np.flatnonzero(again)
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(hit)))
                x = hit[head]
                out.append([key[of[x]], h[of[x]], at[x], n, np.full(len(x), REPEAT)])
        return flags_out(out)

    post_rows = d.select("key", "h", "text").mapInArrow(post, "bucket int, what int, payload binary")
    first = cut(post_rows.groupBy("bucket").applyInArrow(compare, "to int, payload binary"))
    grouped = d.withColumn("to", group_column(n_groups))
    sent = grouped.groupBy("to").cogroup(first.groupBy("to")).applyInArrow(ship, "bucket int, payload binary, blob binary")
    second = sent.groupBy("bucket").applyInArrow(settle, "to int, payload binary")
    return grouped, first.unionByName(second), n_groups


def group_column(n_groups: int) -> Column:
    """The group of a document, as group_of has it in numpy."""
    return ((F.pmod("key", F.lit(PRIME)) + F.pmod("h", F.lit(1 << 16))) % n_groups).cast("int")


def matched(rows: pa.RecordBatch, key: np.ndarray, h: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and a wanted flag for its document."""
    flag = np.flatnonzero(want)
    mine, my_h = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "h"))

    def named(k: np.ndarray, t: np.ndarray) -> np.ndarray:
        return mix(k.astype(np.uint64)) ^ t.astype(np.uint64)

    have = named(key[flag], h[flag])
    order = np.argsort(have, kind="stable")
    have, flag = have[order], flag[order]
    look = named(mine, my_h)
    lo, hi = np.searchsorted(have, look, side="left"), np.searchsorted(have, look, side="right")
    doc, flag = np.repeat(np.arange(len(mine)), hi - lo), flag[expand(lo, hi - lo)]
    real = (key[flag] == mine[doc]) & (h[flag] == my_h[doc])
    return doc[real], flag[real]


def remove(grouped: DataFrame, flags: DataFrame, scheme: Scheme, finish: Callable, schema: str) -> DataFrame:
    """finish(rows, data, offsets, first, covered, s, e) for each slice of documents: covered marks their symbols in repeated windows."""

    def run(_: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        key, h, start, count, what = unpack_all(FLAG, marks.column("payload").to_pylist())
        want = what == REPEAT
        out = []
        for part in sliced(iter(texts.combine_chunks().to_batches())):
            data, offsets = text_bytes(part.column("text"))
            if scheme.by_word:
                s, e, first = words(data, offsets)
                n = len(s)
            else:
                s = e = None
                first, n = offsets, len(data)
            doc, flag = matched(part, key, h, want)
            change = np.zeros(n + 1, np.int32)
            begin = first[doc] + start[flag]
            end = begin + count[flag] + scheme.window - 1
            fits = end <= first[doc + 1]
            np.add.at(change, begin[fits], 1)
            np.add.at(change, end[fits], -1)
            out.append(finish(part, data, offsets, first, np.cumsum(change[:-1]) > 0, s, e))
        release()
        return pa.Table.from_batches(out) if out else pa.Table.from_pylist([], kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return grouped.groupBy("to").cogroup(flags.groupBy("to")).applyInArrow(run, schema)
