"""Best-fit packing of token pieces into sequences of fixed capacity.

The plan is made from the histogram of piece lengths, which has at most `capacity` entries
whatever the corpus:

1. Large lengths, in descending order, are cut into groups of equal cardinality and rounded
   up to their group's longest (linear grouping).
2. Configurations of the rounded sizes: with few sizes, those of the linear programme of least sequences, by column
   generation, rounded down; what that leaves over, and with more sizes everything, by configurations chosen one after another, each of which holds the largest
   size left and fills the sequence as full as the sizes left allow. The plan with fewer sequences counts.
3. Actual pieces take the places of the rounded ones, which leaves stretches of sequences with equal
   room; small lengths, the longest first, go where they leave least room.

The plan says which ranks of each length go to which sequences. Ranks come from counts per (length,
salt) and their running sums, so no length's pieces meet in one task. Empty and null texts
are one-token pieces; equal rows are packed separately; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import arrow_map, bucket_count, cut, documents, text_bytes
from .hashing import BYTE, Spans, expand
from .hashing import words as word_spans

#: Words, and letter runs, that a worker keeps; a full table starts over.
CACHE = 1_200_000
PARTS_KEPT = 150_000
#: What separates words here. The tokenizer drops these (and more), so no token spans them.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 10, 9]] = True
#: A letter run and ASCII marks behind it. The tokenizer cuts between the two, and lower-cases either
#: letter by letter, so their ids are those of the lower-cased run and of the marks on end. No apostrophes: it has rules of their own.
PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Groups of the linear grouping: for configurations chosen one after another, and for those of the linear programme.
GROUPS = 512
FEW = 32
#: How much more than a sequence the worthiest configuration may be worth when the programme stops: its packing is within this share of the least.
TOLERANCE = 5e-4


class Words:
    """Ids of texts, word by word, from a table that grows as words turn up, sorted by the words' hashes.

    A hash only says where to look: the word found there is compared byte by byte, and one that differs is encoded by itself.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The model alone, for strings that need no normalising and are one pre-token each.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        size = self.tokenizer.get_vocab_size()
        #: Whether an id ends a pre-token; without such ids no parts are taken apart.
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.by_part = bool(suffix)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.text_at = np.zeros(0, np.int64)
        self.text_size = np.zeros(0, np.int64)
        self.text = np.zeros(1 << 16, np.uint8)
        self.text_used = 0
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, "<u4")
        self.used = 0
        self.parts: dict[str, bytes] = {"": b""}

    def learn(self, hashes: np.ndarray, words_: list[bytes]) -> None:
        """Add words, in the order of their hashes, to the table."""
        packed = self.encode_words([w.decode() for w in words_])
        blob = np.frombuffer(b"".join(words_), np.uint8)
        size = np.array([len(w) for w in words_], np.int64)
        while self.text_used + len(blob) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(len(self.text), np.uint8)])
        self.text[self.text_used : self.text_used + len(blob)] = blob
        new = np.frombuffer(b"".join(packed), "<u4")
        count = np.array([len(p) // 4 for p in packed], np.int64)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        self.ids[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.text_at = np.insert(self.text_at, at, self.text_used + np.cumsum(size) - size)
        self.text_size = np.insert(self.text_size, at, size)
        self.text_used += len(blob)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.used += len(new)

    def encode_words(self, new: list[str]) -> list[bytes]:
        """The packed ids of words, through the letter runs and marks they are made of."""
        if len(self.parts) > PARTS_KEPT:
            self.parts = {"": b""}
        parts = self.parts
        cut = [m.groups() if self.by_part and (m := PARTS.fullmatch(w)) else None for w in new]
        pairs = [(c[0].lower(), c[1]) if c else None for c in cut]
        unseen = list({x for p in pairs if p for x in p}.difference(parts))
        for i in range(0, len(unseen), 1000):
            some = unseen[i : i + 1000]
            ids = np.array(self.bare.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            packed = ids.tobytes()
            parts.update(zip(some, (packed[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        odd = [w for w, p in zip(new, pairs, strict=True) if not p]
        rest = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))
        return [parts[p[0]] + parts[p[1]] if p else np.array(next(rest).ids, "<u4").tobytes() for p in pairs]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts on end, each with end_id behind it, and where each begins (one more than texts)."""
        if len(self.keys) > CACHE or self.used > 8 * CACHE or self.text_used > 32 * CACHE:
            self.clear()
        s, e, first = word_spans(data, offsets, SEPARATOR)
        hashes, at, inverse = np.unique(Spans(BYTE[data]).of(s, e), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = self.keys[place] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        if new.any():
            blob = data.tobytes()
            self.learn(hashes[new], [blob[a:b] for a, b in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, hashes)
        count = self.count[place][inverse]
        odd = self.strangers(data, s, e, place[inverse])
        if len(odd):
            own = [np.frombuffer(p, "<u4") for p in self.encode_words([data[a:b].tobytes().decode() for a, b in zip(s[odd].tolist(), e[odd].tolist(), strict=True)])]
            count[odd] = [len(x) for x in own]
        total = np.concatenate([[0], np.cumsum(count)])
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = np.full(int(total[-1]) + len(first) - 1, end_id, "<u4")
        begin = self.begin[place][inverse]
        begin[odd] = 0
        out[np.arange(int(total[-1])) + np.repeat(of, count)] = self.ids[expand(begin, count) % len(self.ids)]
        for k, i in enumerate(odd.tolist()):
            out[total[i] + of[i] : total[i + 1] + of[i]] = own[k]
        return out, total[first] + np.arange(len(first))

    def strangers(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The words [s, e) that aren't those of the table at place."""
        size = e - s
        odd = size != self.text_size[place]
        same = np.flatnonzero(~odd)
        starts = np.cumsum(size[same]) - size[same]
        if len(same):
            differ = data[expand(s[same], size[same])] != self.text[expand(self.text_at[place[same]], size[same])]
            odd[same] = np.logical_or.reduceat(differ, starts)
        return np.flatnonzero(odd)


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, h, doc_id, piece, start, length, ids_crc32 (and ids) of each piece: a document's ids and end_id, cut where longer than capacity."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        of, piece, start, length, crc, ids = [], [], [], [], [], []
        packed, first = words(tokenizer_path).encode(*text_bytes(rows.column(3)), end_id)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            for k, at in enumerate(range(a, b, capacity)):
                part = packed[at : min(at + capacity, b)].tobytes()
                of.append(i)
                piece.append(k)
                start.append(at - a)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        at = pa.array(of, pa.int32())
        cols = [rows.column(0).take(at), rows.column(1).take(at), rows.column(2).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["key", "h", "doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols.append(pa.array(ids, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = "key long, h long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_map(documents(docs, text, doc_id), run, schema)


@dataclass
class Plan:
    """Ranks [rank, rank + count) of a length go to sequences [sequence, sequence + count), at offset."""

    capacity: int
    left: dict[int, int]
    places: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    taken: dict[int, int] = field(default_factory=dict)
    sequences: int = 0
    #: By room left: stretches (first sequence, count) of sequences.
    open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.taken.get(length, 0)
        self.places.append((length, rank, count, sequence, offset))
        self.taken[length] = rank + count
        self.left[length] -= count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self.open.setdefault(room, []).append((sequence, count))


def groups(lengths: dict[int, int], n: int) -> list[list[list[int]]]:
    """The lengths, descending, as n groups of about equal cardinality: lists of [length, count]."""
    total = sum(lengths.values())
    size = max(1, -(-total // n))
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(lengths, reverse=True):
        count = lengths[length]
        while count:
            if not room:
                out.append([])
                room = size
            use = min(room, count)
            if out[-1] and out[-1][-1][0] == length:
                out[-1][-1][1] += use
            else:
                out[-1].append([length, use])
            room -= use
            count -= use
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill capacity best, starting with one of the first size that is left."""
    first = next(i for i, n in enumerate(left) if n)
    use = [0] * len(sizes)
    use[first] = 1
    room = capacity - sizes[first]
    # by[v]: the size that completes the sum v from a smaller one; each size in turn, so none is used too often.
    by = np.full(room + 1, -1)
    by[0] = len(sizes)
    for i in range(first, len(sizes)):
        most = min(left[i] - (i == first), room // sizes[i])
        for _ in range(most):
            reach = np.flatnonzero((by[: room + 1 - sizes[i]] >= 0) & (by[sizes[i] :] < 0))
            if not len(reach):
                break
            by[reach + sizes[i]] = i
        if by[room] >= 0:
            break
    v = int(np.flatnonzero(by >= 0)[-1])
    while v:
        i = int(by[v])
        use[i] += 1
        v -= sizes[i]
    return use


def worthiest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits a sequence, each size as often as it likes, and how many of each that takes."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    least = int(sizes.min())
    order = np.argsort(sizes)
    ordered, value = sizes[order], worth[order]
    for c in range(least, capacity + 1):
        n = int(np.searchsorted(ordered, c, side="right"))
        got = best[c - ordered[:n]] + value[:n]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], last[c] = got[k], order[k]
        else:
            best[c] = best[c - 1]
    use = np.zeros(len(sizes), np.int64)
    c = capacity
    while c >= least:
        if last[c] < 0:
            c -= 1
            continue
        use[last[c]] += 1
        c -= int(sizes[last[c]])
    return float(best[capacity]), use


def optimal_configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, rounded down: the linear programme of least sequences over all configurations, by column generation.

    Each round asks the dual prices for the worthiest configuration and exchanges it for one of the basis. Any basis is a packing, so stopping
    after `rounds` is safe.
    """
    if not sizes:
        return []
    size, need = np.array(sizes), np.array(counts, float)
    basis = np.diag((capacity // size).astype(float))  # a configuration in each column
    amount = need / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(size)))
        value, use = worthiest(size, prices, capacity)
        if value <= 1 + TOLERANCE:
            break
        change = np.linalg.solve(basis, use.astype(float))
        gives = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(gives.argmin())
        amount = np.maximum(amount - gives[out] * change, 0)
        amount[out] = gives[out]
        basis[:, out] = use
    left = np.array(counts)
    chosen = []
    for j in np.argsort(-amount):
        use = np.rint(basis[:, j]).astype(np.int64)
        times = min(int(amount[j] + 1e-6), int((left[use > 0] // use[use > 0]).min()))
        if times:
            chosen.append((use, times))
            left -= use * times
    return chosen


def plan(histogram: dict[int, int], capacity: int, n_groups: int = GROUPS, few: int = FEW) -> Plan:
    """Where pieces of each length go: the better of two plans, one of few rounded sizes whose configurations a linear programme chooses, one of more
    sizes whose configurations are chosen one after another. Work and result depend on capacity and the groups, not on how many pieces there are."""
    return min((_plan(histogram, capacity, min(few, n_groups), True), _plan(histogram, capacity, n_groups, False)), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, n_groups: int, optimise: bool) -> Plan:
    out = Plan(capacity, dict(histogram))
    if capacity in histogram:
        out.put(capacity, histogram[capacity], 0, 0)
        out.sequences = histogram[capacity]
    small = max(1, capacity // 8)
    grouped = groups({v: n for v, n in out.left.items() if v > small and n}, n_groups)
    sizes = [g[0][0] for g in grouped]
    left = [sum(n for _, n in g) for g in grouped]
    # Equal rounded sizes are one size.
    merged: list[int] = []
    queues: list[list[list[int]]] = []
    counts: list[int] = []
    for s, g, n in zip(sizes, grouped, left, strict=True):
        if merged and merged[-1] == s:
            queues[-1] += g
            counts[-1] += n
        else:
            merged.append(s)
            queues.append(list(g))
            counts.append(n)

    def use_up(use: list[int], times: int) -> None:
        """Actual pieces in the places of `times` sequences of a configuration."""
        slots = [i for i, u in enumerate(use) for _ in range(u)]
        for i, u in enumerate(use):
            counts[i] -= u * times
        runs = [_draw(queues[i], times) for i in slots]
        while times:
            stretch = min(r[0][1] for r in runs)
            offset = 0
            for r in runs:
                out.put(r[0][0], stretch, out.sequences, offset)
                offset += r[0][0]
                r[0][1] -= stretch
                if not r[0][1]:
                    r.pop(0)
            out.leave(capacity - offset, out.sequences, stretch)
            out.sequences += stretch
            times -= stretch

    if optimise:
        for use, times in optimal_configurations(merged, counts, capacity):
            use_up(use.tolist(), times)
    while any(counts):
        use = fullest(merged, counts, capacity)
        use_up(use, min(counts[i] // u for i, u in enumerate(use) if u))
    for length in sorted((v for v, n in out.left.items() if n), reverse=True):
        _best_fit(out, length)
    return out


def _draw(queue: list[list[int]], n: int) -> list[list[int]]:
    """The first n pieces of a queue of [length, count], taken off it."""
    got = []
    while n:
        use = min(n, queue[0][1])
        got.append([queue[0][0], use])
        queue[0][1] -= use
        n -= use
        if not queue[0][1]:
            queue.pop(0)
    return got


def _best_fit(out: Plan, length: int) -> None:
    """All pieces of a length, each where it leaves least room; a new sequence where none has room."""
    while out.left[length]:
        fits = [r for r in out.open if r >= length]
        if fits:
            room = min(fits)
            sequence, count = out.open[room].pop()
            if not out.open[room]:
                del out.open[room]
        else:
            room, sequence = out.capacity, out.sequences
            count = -(-out.left[length] // (room // length))
            out.sequences += count
        each = room // length
        full = min(count, out.left[length] // each)
        for k in range(each if full else 0):
            out.put(length, full, sequence, out.capacity - room + k * length)
        out.leave(room - each * length, sequence, full)
        if full < count:
            rest = out.left[length] if not full or out.left[length] < each else 0
            for k in range(rest):
                out.put(length, 1, sequence + full, out.capacity - room + k * length)
            out.leave(room - rest * length, sequence + full, 1)
            out.leave(room, sequence + full + 1, count - full - 1)


def pack(items: DataFrame, capacity: int, n_groups: int = GROUPS) -> DataFrame:
    """items with sequence_id and offset. items needs key, h, piece and length (1 to capacity) and is read twice, so cut() it first.

    The driver sees the histogram of lengths only; the plan that goes to the workers has a few entries for each length.
    """
    salts = bucket_count(items, 1 << 20)
    t = items.withColumn("salt", F.pmod(F.xxhash64("key", "h", "piece"), F.lit(salts)))
    per = t.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {int(r.length): int(r.n) for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(histogram, capacity, n_groups)
    before = per.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = t.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "h", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "salt")
    places = np.array(sorted(made.places), np.int64).reshape(-1, 5)
    span = int(max(histogram.values(), default=0)) + 1
    begins = places[:, 0] * span + places[:, 1]
    names = ranked.columns
    length_at, rank_at = names.index("length"), names.index("rank")

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (rows.column(i).to_numpy(zero_copy_only=False) for i in (length_at, rank_at))
        at = np.searchsorted(begins, length * span + rank, side="right") - 1
        cols = [c for i, c in enumerate(rows.columns) if i != rank_at]
        cols += [pa.array(places[at, 3] + rank - places[at, 1]), pa.array(places[at, 4])]
        return pa.RecordBatch.from_arrays(cols, names=[n for n in names if n != "rank"] + ["sequence_id", "offset"])

    schema = StructType([f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return arrow_map(ranked, run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    p = cut(pieces(docs, tokenizer_path, capacity, end_id, text, doc_id))
    return pack(p, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
