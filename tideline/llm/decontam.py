"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of documents of bounded size. Its words are numbered by the test phrases'
vocabulary; any other word is a break. A run between breaks that is shorter than the shortest
phrase can't hold an occurrence and isn't indexed; all other words are. The index is the
Burrows-Wheeler transform of the runs, its ranks in a wavelet matrix, and every 8th suffix position.
All phrases are searched backwards together, occurrences are located by stepping to a sampled
position, and the spans found are merged in each document.

Phrases go to the executors in blocks of at most `BLOCK_WORDS` words, one broadcast each, so a
benchmark of any size fits; a shard is searched for block after block.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, BLOCK_WORDS, SAMPLE = 13, 500_000, 8
#: Text of a shard.
SHARD_BYTES = 4 << 20
#: Contaminated if at least one word in so many is hit.
SHARE = 20
#: Words are made of these bytes (a-z after lower-casing, digits, all of non-ASCII); others separate.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Phrases:
    """A block of test phrases: vocabulary, phrases as rows of word numbers (0 at the left where shorter), and their items."""

    def __init__(self, items: list[tuple], window: int):
        import numpy as np

        self.vocab: dict[bytes, int] = {}
        known: dict[tuple, int] = {}
        self.items: list[list] = []
        for item_id, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            for p in {tuple(ids[i : i + window]) for i in range(max(1, len(ids) - window + 1))} if ids else ():
                if p not in known:
                    known[p] = len(self.items)
                    self.items.append([])
                if item_id not in self.items[known[p]]:
                    self.items[known[p]].append(item_id)
        self.lengths = np.array([len(p) for p in known], np.int64)
        self.rows = np.zeros((len(known), int(self.lengths.max(initial=1))), np.int64)
        for i, p in enumerate(known):
            self.rows[i, self.rows.shape[1] - len(p) :] = p


class FMIndex:
    """Over a sequence of numbers 0 <= x < size; counts and locates rows of numbers."""

    def __init__(self, seq, size: int):
        import numpy as np

        seq = np.concatenate((np.asarray(seq, np.int64) + 1, [0]))  # 0 is the end, once
        n = len(seq)
        rank, step = seq, 1
        order = np.argsort(rank, kind="stable")
        while True:  # prefix doubling
            key = rank * (max(n, size) + 2) + np.concatenate((rank[step:] + 1, np.zeros(min(step, n), np.int64)))
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank, step = fresh, 2 * step
            if rank[order[-1]] == n - 1:
                break
        bwt = seq[order - 1]
        self.n, self.bits = n, max(1, int(size + 1).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=size + 2))))
        self.zeros, self.ones = [], []  # wavelet matrix: zeros of a level, ones before each place
        for level in range(self.bits - 1, -1, -1):
            bit = bwt >> level & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        marked = order % SAMPLE == 0
        self.marks, self.positions = np.concatenate(([0], np.cumsum(marked))), order[marked]

    def rank(self, symbol, at):
        """How often each symbol stands before each place of the transform."""
        import numpy as np

        start = np.zeros_like(at)
        for j, (zeros, ones) in enumerate(zip(self.zeros, self.ones)):
            bit = symbol >> (self.bits - 1 - j) & 1
            a, b = ones[at], ones[start]
            at = np.where(bit == 1, zeros + a, at - a)
            start = np.where(bit == 1, zeros + b, start - b)
        return at - start

    def step(self, at):
        """The place of the suffix that begins one earlier."""
        import numpy as np

        symbol, place = np.zeros_like(at), at
        for zeros, ones in zip(self.zeros, self.ones):
            bit = ones[place + 1] - ones[place]
            symbol = symbol * 2 + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return self.first[symbol] + self.rank(symbol, at)

    def search(self, rows, lengths):
        """Backward search of all rows (aligned to the right) at once: the half-open ranges of suffixes."""
        import numpy as np

        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n)
        for k in range(rows.shape[1]):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            c = rows[live, rows.shape[1] - 1 - k] + 1
            low[live], high[live] = self.first[c] + self.rank(c, low[live]), self.first[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, at):
        import numpy as np

        at, moved, out = at.copy(), np.zeros_like(at), np.empty_like(at)
        live = np.arange(len(at))
        while len(live):
            place = at[live]
            marked = self.marks[place + 1] > self.marks[place]
            done = live[marked]
            out[done] = self.positions[self.marks[at[done]]] + moved[done]
            live = live[~marked]
            at[live] = self.step(at[live])
            moved[live] += 1
        return out


def find(texts: list[list[bytes]], phrases: Phrases):
    """Occurrences in a shard: (document, first word, phrase), through the shard's FM-index."""
    import numpy as np

    none = np.zeros(0, np.int64)
    if not len(phrases.rows):
        return none, none, none
    get = phrases.vocab.get
    sizes = [len(w) for w in texts]
    ids = np.fromiter((get(w, 0) for ws in texts for w in [b" ", *ws]), np.int64, sum(sizes) + len(sizes))  # a break before each document
    docs = np.repeat(np.arange(len(texts)), [n + 1 for n in sizes])
    known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    turns = np.diff(known)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    keep = ends - starts >= phrases.lengths.min()
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none, none, none
    long = ends - starts + 1  # with a break after each run
    before = np.concatenate(([0], np.cumsum(long)))
    origin = np.arange(before[-1]) - np.repeat(before[:-1], long) + np.repeat(starts, long)
    seq = np.concatenate((ids, [0]))[origin]
    seq[before[1:] - 1] = 0
    index = FMIndex(seq, len(phrases.vocab) + 1)
    low, high = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    which = np.repeat(found, count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[found], count)
    place = origin[index.locate(at)]
    doc = docs[place]
    head = np.concatenate(([0], np.cumsum([n + 1 for n in sizes])))[doc] + 1
    return doc, place - head, which


def blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The benchmark's phrases in bounded blocks, read row by row. A null text has no words; a null item_id marks words but is no item."""
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of((r["text"] or "").encode())
        held.append((r["item_id"], words))
        n += len(words)
        if n >= block_words:
            yield Phrases(held, window)
            held, n = [], 0
    if held:
        yield Phrases(held, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans, the merged [first word, end) of hits.

    Null or empty texts have no words. Repeated rows stay; an empty benchmark hits nothing.
    Items with the same id count once. Other columns are ignored, unless `keep` names the columns to return (text among them) in place of doc_id;
    a new column whose name one of these has gets an underscore before it (`common.fresh`).
    """
    spark = docs.sparkSession
    common.tune(spark)
    sent = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, window, block_words)]

    new = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "spans": "string"}
    given, schema, kept = common.carried(docs, keep, [(common.fresh(n, keep or []), t) for n, t in new.items()])

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for cols, texts in common.gathered(batches, SHARD_BYTES):
            words = [words_of(t) for t in texts]
            n = np.array([len(w) for w in words], np.int64)
            base = np.concatenate(([0], np.cumsum(n + 1)))
            edge = np.zeros(base[-1] + 1, np.int64)
            items: dict[int, set] = {}
            for b in sent:
                phrases = b.value
                doc, first, which = find(words, phrases)
                np.add.at(edge, base[doc] + first, 1)
                np.add.at(edge, base[doc] + first + phrases.lengths[which], -1)
                for d, p in set(zip(doc.tolist(), which.tolist())):
                    items.setdefault(d, set()).update(x for x in phrases.items[p] if x is not None)
            hit = (np.cumsum(edge)[:-1] > 0).astype(np.int8)
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[base[1:]] - total[base[:-1]]
            turns = np.diff(np.concatenate(([0], hit, [0])))
            spans: dict[int, list] = {}
            for a, z in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()):
                d = int(np.searchsorted(base, a, "right")) - 1
                spans.setdefault(d, []).append(f"{a - base[d]}:{z - base[d]}")
            digest = [hashlib.sha256(",".join(sorted(items.get(d, ()))).encode()).hexdigest() for d in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*kept(cols, texts), pa.array(n), pa.array(n_hit.astype(np.int64)), pa.array([len(items.get(d, ())) for d in range(len(texts))], pa.int64()), pa.array(digest), pa.array((n_hit > 0) & (share * n_hit >= n)), pa.array([",".join(spans.get(d, ())) for d in range(len(texts))])],
                schema.names,
            )

    return given.mapInArrow(run, schema)
