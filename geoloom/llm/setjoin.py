"""Similarity groups of documents by Jaccard likeness of word shingles, by T-occurrence search.

Words are [^ \t-\r]+ with A-Z lower-cased; a document's set has its distinct shingles of `size` words
(with fewer words, the whole sequence as one; without words, none, and it links with nothing). Two
documents link when 100 * |both| >= percent * |either|.

1. Blocks. Sizes fall into classes such that linked documents are in one class or in neighbours. For two neighbours the
   sets of a link differ in D shingles at most, so of more than D parts of the shingles (by hash) some part is
   equal in both. Documents with an equal part of STRONG shingles or more join up to clusters at once. Smaller parts are often equal by
   way of a passage that unrelated documents share, so where one spans clusters its documents' parity bitmaps (two to four bits a
   shingle) are compared first: a shingle flips one bit, so bitmaps of a link differ in D places at most, and documents whose
   bitmaps differ in more can't link. What is left joins clusters up to blocks.
2. Search. Documents of a block meet, one for each distinct set. Each one's inverted lists are
   searched for documents that reach the overlap T: short lists are merged, long ones probed by binary search for
   what the merge left in reach (DivideSkip). A document that is already in the block's main component
   needs no search of its own, so a large group of copies costs about one search for each document outside it.
3. Verified links are joined up to components.

Copies of a set are combined before the first shuffle. A block over BLOCK shingles is searched in sub-blocks dealt by chance, twice, which joins
a large group of near copies up; then the sets outside the block's largest group, and only those, are looked for in all of the block. So texts
travel in proportion to the block, unless much of it lies outside that group: chunks of the rest meet all sub-blocks, which grows with the product of the two.

What is equal: the search compares shingles by their words, so no link is found that isn't one. Up to there shingles go by 64-bit
hashes, equal ones always alike, so no link is lost either; n_shingles counts distinct SipHash values (two different shingles of one text
of 10^4 words agree with a chance of 3e-12), and sets count as copies if size and two independent 64-bit sums agree.
Every row is a document of its own: rows that share an id, null ids too, are linked by their texts only. A null id is no one's component_id, unless
nothing else is there: then it is null. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import bucket_count, cut, documents, fresh, names_of, release, sliced, text_bytes
from .graph import components
from .hashing import expand, keyed_hashes, mix, word_hashes
from .windows import pack_columns, runs_of, split_rows, unpack_all, unpack_columns

POSTING = ("<u4", "<u2", "<i8", "u1")  # part key above the bucket, document, whether the part is strong
LINK = ("<i8", "<i8")
#: Documents with one key of which all pairs are compared at once; more are compared row by row.
FEW = 48
PAIRS = 1 << 18
#: Shingles of a part that make it evidence by itself.
STRONG = 6
SHARED_KEY = ("<u4", "<u8", "<i8")  # bucket, key, document
PLACED = ("<u8", "<i8", "<i8")  # key, document, its cluster
#: Stands in for a null id where the least id is looked for.
LAST = (1 << 63) - 1
#: Shingles of a block that one task searches.
BLOCK = 1 << 20
#: The share of the required overlap that decides how many lists count as long.
MU = 0.0085
GATHER = 1 << 20


def chained(sym: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Hashes of the size symbols (most at most) from each begin on."""
    out = mix(size.astype(np.uint64))
    for k in range(most):
        on = size > k
        out[on] = mix(out[on] * np.uint64(0x9FB21C651E98DF25) ^ sym[begin[on] + k])
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts on end, ascending in each, a second hash of each, and the first of each text (one more than texts)."""
    second, first = word_hashes(data, offsets, lower=True)
    n = np.diff(first)
    sym = keyed_hashes(data, lower=True)
    if len(sym) != len(second):  # a word that goes over the end of a text
        sym = np.concatenate([keyed_hashes(data[a:b], lower=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = expand(first[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    hashes = chained(sym, begin, np.minimum(size, n)[doc], size)
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    kept = order[new]
    return hashes[new], chained(second, begin[kept], np.minimum(size, n)[doc[kept]], size), np.searchsorted(doc[new], np.arange(len(n) + 1))


def exact_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some texts, numbered by their words, ascending in each, and the first of each text (one more than texts)."""
    words, length = [], []
    for t in texts:
        w = t.lower().split()
        words += w if len(w) >= size or not w else w + [b" "] * (size - len(w))  # no word: a short text's shingle is unlike all others
        length.append(len(w))
    n = np.maximum(np.array(length, np.int64), 0)
    n = np.where((n > 0) & (n < size), size, n)
    sym = pd.factorize(np.array(words, dtype=object))[0].astype(np.uint64)
    count = np.where(n > 0, n - size + 1, 0)
    begin = expand(np.cumsum(n) - n, count)
    rank = sym[begin] if len(begin) else np.zeros(0, np.uint64)
    for k in range(1, size):
        rank = np.unique(rank << np.uint64(32) | sym[begin + k], return_inverse=True)[1].astype(np.uint64)
    both = np.unique(np.repeat(np.arange(len(n), dtype=np.uint64), count) << np.uint64(32) | rank)
    return both & np.uint64((1 << 32) - 1), np.searchsorted(both >> np.uint64(32), np.arange(len(n) + 1, dtype=np.uint64))


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of stretches of unsigned integers, modulo 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class Classes:
    """Classes of set sizes: a link's two sizes are in one class or in neighbours."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.lower = [1]
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        while self.lower[-1] <= size:
            self.lower.append(self.lower[-1] * 100 // self.percent + 1)
        lower = np.array(self.lower, np.int64)
        top = lower[1:] - 1  # the largest size of each class but the last
        # x + y <= top + top * 100 / percent, and |x - y as sets| <= (x + y) * (100 - percent) / (100 + percent)
        differ = (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        #: Parts beyond those that can differ, so that documents with few empty parts need not send those.
        self.spare = np.where(differ == 0, 0, np.where(differ < 10, 1, 2))
        self.parts = differ + 1 + self.spare
        self.bounds = lower

    def of(self, sizes: np.ndarray) -> np.ndarray:
        if len(sizes) and sizes.max() >= self.bounds[-2]:
            self._grow(int(sizes.max()) * 4)
        return np.searchsorted(self.bounds, sizes, side="right") - 1


def part_keys(hashes: np.ndarray, first: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their part keys, and the sizes of the parts: for the family of its own class and for that of the class below."""
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = classes.of(sizes)
    docs, keys, held = [], [], []
    where = hashes >> np.uint64(24)
    value = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    for below in (0, 1):
        family = own - below
        live = (family >= 0) & (sizes > 0)
        parts = np.where(live, classes.parts[np.maximum(family, 0)], 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        mine = live[doc]
        at = base[doc[mine]] + (where[mine] % parts[doc[mine]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(base[-1]), np.uint64)
        np.add.at(total, at, value[mine])
        count = np.bincount(at, minlength=len(total))
        seen = count > 0
        of = np.repeat(np.arange(len(sizes)), parts)
        empty = np.bincount(of[~seen], minlength=len(sizes))
        # With more empty parts than spare ones the equal part may be an empty one, so those are sent too.
        send = seen | (empty > np.where(live, classes.spare[np.maximum(family, 0)], 0))[of]
        part = np.arange(len(total)) - base[of]
        named = (family[of].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) + np.uint64(1)
        docs.append(of[send])
        keys.append(mix(total + mix(named))[send])
        # A part that is a set's whole is as strong as can be.
        held.append(np.where(count == sizes[of], STRONG, count)[send])
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(held)


def strong_postings(keys: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Which postings belong to a key that any document holds as strong: what is one set's whole may be a small part of another, and those two have to meet."""
    return np.isin(keys, keys[strong > 0])


def stars(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, least document with an equal key) pairs, and which rows are a key's least."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    cuts = runs_of([k]) if len(k) else np.zeros(1, np.int64)
    size = np.diff(cuts)
    least = np.repeat(d[cuts[:-1]], size)
    other = d != least
    pair = np.unique(np.stack([d[other], least[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    head = np.zeros(len(k), bool)
    head[order[cuts[:-1]]] = True
    return pair[0], pair[1], head


def levels(sizes: np.ndarray) -> np.ndarray:
    """log2 of the bits of a set's bitmap: at least twice its size, at least 64."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(2 * sizes, 1)))).astype(np.int64)


def bitmaps(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set's parity bitmap: bit h mod 2^level is flipped by every shingle h."""
    sizes = np.diff(first)
    bits = np.int64(1) << levels(sizes)
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = base[doc] + (hashes & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    flat = np.bincount(at, minlength=int(base[-1])).astype(np.uint8) & 1
    packed = np.packbits(flat, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


class Bitmaps:
    """Bitmaps of some sets at their own level and at the one below, to which two halves fold by exclusive or."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes], percent: int) -> None:
        self.sizes, self.percent = sizes, percent
        self.level = levels(sizes)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = {int(v): np.flatnonzero(self.level == v) for v in np.unique(self.level)}
        words = {v: np.frombuffer(b"".join(maps[i] for i in which), np.uint64).reshape(len(which), -1) for v, which in own.items()}
        for v in {*own, *(v - 1 for v in own if v > 6)}:
            rows, parts = np.full(len(sizes), -1), []
            n = 0
            for u in (v, v + 1):
                if u in own:
                    w = words[u]
                    parts.append(w if u == v else w[:, : w.shape[1] // 2] ^ w[:, w.shape[1] // 2 :])
                    rows[own[u]] = n + np.arange(len(w))
                    n += len(w)
            self.at[v] = rows, np.concatenate(parts)

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether sizes and bitmaps leave a link open, for pairs of sets."""
        a, b = np.minimum(self.sizes[x], self.sizes[y]), np.maximum(self.sizes[x], self.sizes[y])
        out = 100 * a >= self.percent * b
        low = np.minimum(self.level[x], self.level[y])
        for v in np.unique(low[out]):
            some = np.flatnonzero(out & (low == v))
            rows, words = self.at[int(v)]
            for i in range(0, len(some), 1 << 13):
                k = some[i : i + (1 << 13)]
                differ = np.bitwise_count(words[rows[x[k]]] ^ words[rows[y[k]]]).sum(axis=1, dtype=np.int64)
                out[k] = differ * (100 + self.percent) <= (a[k] + b[k]) * (100 - self.percent)
        return out


def candidate_links(keys: np.ndarray, docs: np.ndarray, maps: Bitmaps) -> list[tuple[int, int]]:
    """Links (of set numbers) that join up all pairs with an equal key that may link."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    cuts = runs_of([k]) if len(k) else np.zeros(1, np.int64)
    size = np.diff(cuts)
    root = np.arange(len(maps.sizes))
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(x: np.ndarray, y: np.ndarray) -> None:
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))

    small = np.flatnonzero(size <= FEW)
    # All pairs (i, j), i < j, of each small run, some runs at a time.
    total = np.cumsum(size[small] * (size[small] - 1) // 2)
    at = 0
    while at < len(small):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        runs = small[at:to]
        at = to
        member = expand(cuts[runs], size[runs])
        end = np.repeat(cuts[runs + 1], size[runs])
        left = end - member - 1
        x, y = d[np.repeat(member, left)], d[expand(member + 1, left)]
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        x, y = pair[0], pair[1]
        ok = x != y
        x, y = x[ok], y[ok]
        ok = maps.may_link(x, y)
        join(x[ok], y[ok])
    for r in np.flatnonzero(size > FEW):
        member = np.unique(d[cuts[r] : cuts[r + 1]])
        for i, q in enumerate(member.tolist()):
            # As in forest(): of two in the main component none has to find the other.
            if i and find(q) == find(int(member[0])):
                continue
            ok = maps.may_link(np.full(len(member), q), member) & (member != q)
            join(np.full(int(ok.sum()), q), member[ok])
    return out


class Index:
    """Inverted lists over the sets of a block."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray) -> None:
        self.first = first
        self.sizes = np.diff(first)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        self.docs = doc[order]
        self.cuts = runs_of([sorted_]) if len(sorted_) else np.zeros(1, np.int64)
        self.list_of = np.empty(len(hashes), np.int64)
        self.list_of[order] = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))

    def search(self, q: int, percent: int) -> np.ndarray:
        """Documents that link with q, itself left out."""
        lists = self.list_of[self.first[q] : self.first[q + 1]]
        begin, size = self.cuts[lists], self.cuts[lists + 1] - self.cuts[lists]
        shared = size > 1
        begin, size = begin[shared], size[shared]
        need = -(-percent * self.sizes[q] // 100)
        if len(size) < need:
            return np.zeros(0, np.int64)
        n_long = min(len(size) - 1, int(need / (MU * np.log2(max(2, size.max())) + 1)) // 2)
        order = np.argsort(size, kind="stable")
        short, long = order[: len(order) - n_long], order[len(order) - n_long :]
        merged = np.sort(self.docs[expand(begin[short], size[short])], kind="stable")
        cuts = runs_of([merged])
        candidates, count = merged[cuts[:-1]], np.diff(cuts)
        reach = (count >= need - n_long) & (candidates != q)
        candidates, count = candidates[reach], count[reach]
        for left, i in zip(range(len(long) - 1, -1, -1), long, strict=True):
            if not len(candidates):
                return candidates
            a, b = begin[i], begin[i] + size[i]
            place = np.minimum(a + np.searchsorted(self.docs[a:b], candidates), b - 1)
            count = count + (self.docs[place] == candidates)
            if not left & 15:
                reach = count + left >= need
                candidates, count = candidates[reach], count[reach]
        both = count
        return candidates[100 * both >= percent * (self.sizes[q] + self.sizes[candidates] - both)]


def forest(hashes: np.ndarray, first: np.ndarray, percent: int, known: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links that join every linked pair up of which one asks, beyond sets with one known number, which are joined up already. If all ask, those of the first set's group needn't."""
    n = len(first) - 1
    index = Index(hashes, first)
    root = [int(x) for x in np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]]
    skip = bool(asks.all())

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for q in np.flatnonzero(asks).tolist():
        # Of two linked documents in the main component none has to find the other; any other pair is found by one of them.
        if skip and q and find(q) == find(0):
            continue
        for y in index.search(q, percent).tolist():
            a, b = find(q), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((q, y))
    return links


def similar(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach, its own included) of every row; key and h (as in base.documents), and kept: whether it is the first row of its group."""
    d = documents(docs, text, doc_id)
    n_buckets = 2 * bucket_count(docs, 8 << 20)
    classes = Classes(percent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches, 2 << 20):
            hashes, second, first = shingle_sets(*text_bytes(rows.column("text")), size)
            cols = [rows.column("key"), rows.column("h"), rows.column("doc_id"), pa.array(np.diff(first))]
            cols += [pa.array(summed(mix(x), first).astype(np.int64)) for x in (hashes, second)]
            cols.append(pa.array(bitmaps(hashes, first), pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "h", "doc_id", "n_shingles", "s1", "s2", "bitmap"])
        release()

    described = d.mapInArrow(describe, "key long, h long, doc_id long, n_shingles long, s1 long, s2 long, bitmap binary")
    # Written with its number, so that a row has one number ever after. Candidates go by node; two rows with one node only are candidates together.
    described = cut(described.withColumn("row", F.monotonically_increasing_id()).withColumn("node", F.xxhash64("key", "h")))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: dict[tuple[int, int, int], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            docs_, keys, strong = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            seen.clear()
            to = (keys % np.uint64(n_buckets)).astype(np.int64)
            above = keys >> np.uint64(16)
            cols = [(above >> np.uint64(16)).astype(np.uint32), (above & np.uint64(0xFFFF)).astype(np.uint16), docs_, strong]
            rows = list(split_rows(to, POSTING, cols))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "payload"])

        for rows in sliced(batches, 2 << 20):
            hashes, second, first = shingle_sets(*text_bytes(rows.column("text")), size)
            of, keys, count = part_keys(hashes, first, classes)
            node = rows.column("node").to_numpy(zero_copy_only=False)
            # Of copies that meet here the first one speaks for all; copies of a set are joined up by its sums further on.
            names = zip(np.diff(first).tolist(), *(summed(mix(x), first).tolist() for x in (hashes, second)), strict=True)
            first_seen = np.array([seen.setdefault(name, i) == i for i, name in enumerate(names, len(seen) << 32)], bool)
            stay = first_seen[of]
            held.append((node[of[stay]], keys[stay], count[stay] >= STRONG))
            if sum(len(h[0]) for h in held) >= GATHER:
                yield from flush()
        if held:
            yield from flush()
        release()

    def links_out(a: np.ndarray, b: np.ndarray) -> list[tuple[int, bytes]]:
        return list(split_rows(np.mod(a, n_buckets), LINK, [np.maximum(a, b), np.minimum(a, b)]))

    def meet(rows: pa.Table) -> pa.Table:
        """Of strong keys, links with the least document; of weak ones that several documents have, the postings by document."""
        high, low, docs_, strong = unpack_all(POSTING, rows.column("payload").to_pylist())
        keys = high.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64)
        sure = strong_postings(keys, strong)
        links = links_out(*stars(keys[sure], docs_[sure])[:2])
        keys, docs_ = keys[~sure], docs_[~sure]
        order = np.argsort(keys, kind="stable")
        cuts = runs_of([keys[order]]) if len(keys) else np.zeros(1, np.int64)
        several = order[np.repeat(np.diff(cuts) > 1, np.diff(cuts))]
        bucket = np.full(len(several), rows.column("bucket")[0].as_py())
        weak = list(split_rows(np.mod(docs_[several], n_buckets), SHARED_KEY, [bucket, keys[several], docs_[several]]))
        return pa.table({
            "to": pa.array([t for t, _ in links + weak], pa.int32()),
            "links": pa.array([p for _, p in links] + [None] * len(weak), pa.binary()),
            "payload": pa.array([None] * len(links) + [p for _, p in weak], pa.binary()),
        })

    def place(_: tuple, clusters: pa.Table, wanted: pa.Table) -> pa.Table:
        """Weak postings back to their buckets, with the cluster of each document."""
        out = []
        if wanted.num_rows:
            bucket, keys, docs_ = unpack_all(SHARED_KEY, wanted.column("payload").to_pylist())
            have, of = clusters.column("node").to_numpy(), clusters.column("component").to_numpy()
            order = np.argsort(have, kind="stable")
            at = np.minimum(np.searchsorted(have[order], docs_), max(len(have) - 1, 0))
            cluster = np.where(have[order][at] == docs_, of[order][at], docs_) if len(have) else docs_
            out = list(split_rows(bucket.astype(np.int64), PLACED, [keys, docs_, cluster]))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})

    def spanning(rows: pa.Table) -> pa.Table:
        """The postings of keys whose documents lie in several clusters, by document."""
        keys, docs_, cluster = unpack_all(PLACED, rows.column("payload").to_pylist())
        order = np.lexsort((cluster, keys))
        cuts = runs_of([keys[order]]) if len(keys) else np.zeros(1, np.int64)
        several = cluster[order][cuts[:-1]] != cluster[order][cuts[1:] - 1]
        some = order[np.repeat(several, np.diff(cuts))]
        bucket = np.full(len(some), rows.column("bucket")[0].as_py())
        out = list(split_rows(np.mod(docs_[some], n_buckets), SHARED_KEY, [bucket, keys[some], docs_[some]]))
        return pa.table({"to": pa.array([t for t, _ in out], pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})

    def attach(_: tuple, sets: pa.Table, wanted: pa.Table) -> pa.Table:
        """Back to the buckets, with sizes and bitmaps."""
        out = []
        if sets.num_rows and wanted.num_rows:
            bucket, keys, docs_ = unpack_all(SHARED_KEY, wanted.column("payload").to_pylist())
            have = sets.column("node").to_numpy()
            order = np.argsort(have, kind="stable")
            lo, hi = (np.searchsorted(have[order], docs_, side=side) for side in ("left", "right"))
            row = order[expand(lo, hi - lo)]
            bucket, keys = np.repeat(bucket, hi - lo), np.repeat(keys, hi - lo)
            n, maps = sets.column("n_shingles").to_numpy(), sets.column("bitmap").to_pylist()
            by = np.argsort(bucket, kind="stable")
            cuts = runs_of([bucket[by]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                i = by[a:b]
                some, number = np.unique(row[i], return_inverse=True)
                out.append((int(bucket[i[0]]), pack_columns(("<u8", "<u4"), keys[i], number), pack_columns(("<i8", "<u4"), have[some], n[some]), b"".join(maps[r] for r in some.tolist())))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "sets", "maps"])

    def compare(rows: pa.Table) -> pa.Table:
        keys, number, docs_, sizes, maps = [], [], [], [], []
        at = 0
        for k, t, m in zip(*(rows.column(c).to_pylist() for c in ("keys", "sets", "maps")), strict=True):
            a, b = unpack_columns(("<u8", "<u4"), k)
            doc, n = unpack_columns(("<i8", "<u4"), t)
            keys.append(a)
            number.append(b.astype(np.int64) + at)
            at += len(doc)
            docs_.append(doc)
            sizes.append(n.astype(np.int64))
            ends = np.cumsum((np.int64(1) << levels(sizes[-1])) // 8).tolist()
            maps += [m[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        doc = np.concatenate(docs_)
        found = candidate_links(np.concatenate(keys), np.concatenate(number), Bitmaps(np.concatenate(sizes), maps, percent))
        a = doc[np.array([x for x, _ in found], np.int64)]
        b = doc[np.array([y for _, y in found], np.int64)]
        rows_ = links_out(a, b)
        release()
        return pa.table({"to": pa.array([t for t, _ in rows_], pa.int32()), "links": pa.array([p for _, p in rows_], pa.binary())})

    def once(rows: pa.Table) -> pa.Table:
        """Two documents may meet in many buckets; their link counts once."""
        both = np.unique(np.stack(unpack_all(LINK, rows.column("links").to_pylist())), axis=1)
        return pa.table({"a": pa.array(both[0]), "b": pa.array(both[1])})

    postings = d.select(F.xxhash64("key", "h").alias("node"), "text").mapInArrow(post, "bucket int, payload binary")
    met = cut(postings.groupBy("bucket").applyInArrow(meet, "to int, links binary, payload binary"))
    sure = cut(met.where("links is not null").select("to", "links").groupBy("to").applyInArrow(once, "a long, b long"))
    clusters = cut(components(sure))
    clustered = clusters.select("node", "component", F.pmod("node", F.lit(n_buckets)).cast("int").alias("to"))
    weak = met.where("payload is not null").select("to", "payload")
    between = clustered.groupBy("to").cogroup(weak.groupBy("to")).applyInArrow(place, "bucket int, payload binary").groupBy("bucket").applyInArrow(spanning, "to int, payload binary")
    # Equal rows count once, before they meet.
    by_doc = described.select("node", "n_shingles", "bitmap").distinct().withColumn("to", F.pmod("node", F.lit(n_buckets)).cast("int"))
    attached = by_doc.groupBy("to").cogroup(between.groupBy("to")).applyInArrow(attach, "bucket int, keys binary, sets binary, maps binary")
    checked = attached.groupBy("bucket").applyInArrow(compare, "to int, links binary").groupBy("to").applyInArrow(once, "a long, b long")
    blocks = cut(components(sure.unionByName(checked)))

    # Documents in the order of their ids, null ids last, so that a component's first one has its least id.
    ident = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row")
    # One document for each distinct set; its copies link with it, and it takes part in the search if its set is in a block.
    sums = ["n_shingles", "s1", "s2"]
    filled = described.where("n_shingles > 0").select("key", "h", ident.alias("ident"), "node", *sums)
    sets = filled.groupBy(*sums).agg(F.min(F.struct("ident", "key", "h")).alias("of"))
    # Copies link with the first of a salted part of them, and those with the first of all, so that no group of copies meets in one task.
    salt = F.pmod(F.xxhash64("ident"), F.lit(n_buckets))
    parts = filled.select("ident", *sums).withColumn("first", F.min("ident").over(Window.partitionBy(*sums, salt)))
    heads = parts.where("ident = first").withColumn("first", F.min("ident").over(Window.partitionBy(*sums)))
    copies = parts.unionByName(heads).where("ident != first").select(F.col("ident").alias("a"), F.col("first").alias("b"))
    members = filled.select("node", *sums).join(blocks, "node")
    chosen = members.groupBy("component", *sums).agg(F.count("*").alias("rows")).join(sets, sums).select("component", "n_shingles", "of")
    weight = chosen.groupBy("component").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("sets")).where("sets > 1")
    picked = chosen.join(weight, "component").select("of.key", "of.h", "of.ident.id", "of.ident.row", "component", "n_shingles", F.ceil(F.col("weight") / F.lit(BLOCK)).cast("int").alias("subs"))
    picked = cut(picked)

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("component", "ascending"), ("part", "ascending"), ("id", "ascending"), ("row", "ascending")]).combine_chunks()
        a_, b_ = [], []
        if rows.num_rows:
            group = pa.compute.rank(pa.compute.binary_join_element_wise(rows.column("component").cast(pa.string()), rows.column("part"), "|"), tiebreaker="dense").to_numpy()
            known, asks = rows.column("known").to_numpy(), rows.column("asks").to_numpy()
            cuts = runs_of([group])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    texts = [t.encode() for t in rows.column("text").slice(a, b - a).to_pylist()]
                    for x, y in forest(*exact_sets(texts, size), percent, known[a:b], asks[a:b]):
                        a_.append(a + x)
                        b_.append(a + y)
        release()
        one, other = rows.take(pa.array(a_, pa.int64())), rows.take(pa.array(b_, pa.int64()))
        return pa.table({"a_id": one.column("id"), "a_row": one.column("row"), "b_id": other.column("id"), "b_row": other.column("row")})

    def texts_of(sets: DataFrame) -> DataFrame:
        # Equal rows hold the text more than once; one of them is enough.
        held = d.select("key", "h", "text").join(sets.select("key", "h").distinct(), ["key", "h"], "left_semi").dropDuplicates(["key", "h"])
        return held.join(sets, ["key", "h"])

    def searched(dealt: DataFrame) -> DataFrame:
        """Links within each (component, part) of dealt, of which asks says what is looked for and known what is joined up already."""
        to = F.pmod(F.xxhash64("component", "part"), F.lit(n_buckets)).cast("int").alias("to")
        verified = dealt.select("id", "row", "component", "part", "known", "asks", "text", to).groupBy("to").applyInArrow(search, "a_id long, a_row long, b_id long, b_row long")
        return verified.select(*(F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_row").alias("row")).alias(x) for x in "ab"))

    def dealt_by(salt: int, n: str) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")

    def grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
        """sets with known: the least row that links join each to."""
        groups = components(links).select(F.col("node.row").alias("row"), F.col("component.row").alias("known"))
        return sets.join(groups, "row", "left").withColumn("known", F.coalesce("known", "row"))

    def large(held: DataFrame) -> DataFrame:
        """Links of blocks over BLOCK shingles: two rounds of sub-blocks dealt by chance, then what isn't in a block's largest group asks every set of the block."""
        own = held.select("*", F.col("row").alias("known"), F.lit(True).alias("asks"))
        rounds = [own.withColumn("part", F.concat_ws("-", F.lit(k), dealt_by(k, "subs"))) for k in (0, 1)]
        links = cut(searched(rounds[0].unionByName(rounds[1])))
        marks = cut(grouped(held.drop("text"), links))
        # Of two linked sets in the largest group none has to find the other; any other pair has one that asks.
        largest = marks.groupBy("component", "known").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "known")).alias("of"))
        marks = marks.join(largest.select("component", F.col("of.known").alias("main")), "component").withColumn("asks", F.col("known") != F.col("main"))
        rest = marks.where("asks").groupBy("component").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK)).cast("int").alias("chunks"))
        live = marks.join(rest, "component").select("row", "known", "asks", "subs", "chunks", dealt_by(2, "chunks").alias("chunk"), dealt_by(3, "subs").alias("sub"))
        asking = live.where("asks").withColumn("sub", F.explode(F.expr("sequence(0, subs - 1)")))
        other = live.withColumn("to_chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).where("not asks or to_chunk != chunk")
        asked = other.withColumn("chunk", F.col("to_chunk")).withColumn("asks", F.lit(False)).drop("to_chunk")
        dealt = asking.unionByName(asked).select("row", "known", "asks", F.concat_ws("-", "chunk", "sub").alias("part"))
        return links.unionByName(searched(held.join(dealt, "row")))

    split = not picked.where("subs > 1").isEmpty()
    texts = cut(texts_of(picked)) if split else texts_of(picked)
    links = searched(texts.where("subs = 1").select("*", F.col("row").alias("known"), F.lit("0").alias("part"), F.lit(True).alias("asks")))
    if split:
        links = links.unionByName(large(texts.where("subs > 1")))
    found = components(copies.unionByName(links)).select(F.col("node.row").alias("row"), F.col("component.id").alias("first_id"), F.col("component.row").alias("first_row"))
    first_id = F.coalesce("first_id", "doc_id")
    kept = F.coalesce(F.col("first_row") == F.col("row"), F.lit(True))
    return described.join(found, "row", "left").select("doc_id", "n_shingles", F.when(first_id != LAST, first_id).alias("component_id"), "key", "h", kept.alias("kept"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that are the first of their group (the least id, null ids last), one of equal rows; all columns as they are. Documents without words all stay."""
    key, h, what, nth = (fresh(docs, x) for x in ("key", "h", "what", "nth"))
    groups = similar(docs, size, percent, text, doc_id).groupBy("key", "h").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    marks = groups.where(~F.col("kept") | ((F.col("rows") > 1) & (F.col("n") > 0))).select(F.col("key").alias(key), F.col("h").alias(h), F.col("kept").alias(what))
    named = docs.select("*", *(c.alias(n) for c, n in zip(names_of(text, doc_id), (key, h), strict=True)))
    plain = named.join(marks, [key, h], "left_anti").select(*docs.columns)
    # Equal ids and texts, of which one stays.
    several = named.join(marks.where(what), [key, h]).withColumn(nth, F.row_number().over(Window.partitionBy(key, h).orderBy(F.xxhash64(*docs.columns))))
    return plain.unionByName(several.where(F.col(nth) == 1).select(*docs.columns))
