"""Language-model scores from a log-bilinear neural model, beside a smoothed unigram base.

Words are counted over all training documents. The most frequent words with two or more
occurrences (`HEAD` at most, a bounded broadcast) are the head, all others the tail. The model predicts classes: the
`SHORT` most frequent words and the end each have their own, other head words share one for each
power of two of their count, all tail words share one. A context class has an input vector, a
class an output vector and a bias; the score is bilinear, s(w|c) = r_c A q_w + b_w, fitted in
numpy by noise-contrastive estimation on class pairs counted over all training documents. One
batched matrix product gives all scores; its row-wise log-sum-exp makes them log-probabilities.
Inside a class a word has its share of the counts; in the tail each count is lowered by a half and
unseen words have the rest, so that the probabilities of all known words and one unknown sum to one.

Tail words meet their counts in a join: their number has no bound. So base and model cover every
token exactly, whatever the vocabulary's size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD, SHORT, DIM = 60_000, 500, 24
END = "\n"
#: A task's words are counted in a dictionary of at most so many, then passed on.
COUNTED = 200_000
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(_UPPER).split(), b"\n"]


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all rows; the end is the word of one line feed."""
    common.tune(train.sparkSession)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        for _, texts in common.slices(batches):
            for t in texts:
                counts.update(tokens(t))
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Classes:
    """The head words' class and probability inside it. Class 0 is the end, 1 to `short` single words, the last the tail."""

    def __init__(self, head: list[tuple[str, int]], n: int, v: int, ends: int, short: int):
        head = [(w, c) for w, c in head if w != END]
        self.n, self.v, self.ends = n, v, ends
        shared = sorted({c.bit_length() for _, c in head[short:]})
        place = {b: 1 + min(short, len(head)) + i for i, b in enumerate(shared)}
        self.size = 2 + min(short, len(head)) + len(shared)
        self.tail = self.size - 1
        of = [i + 1 if i < short else place[c.bit_length()] for i, (_, c) in enumerate(head)]
        sums: dict[int, int] = {}
        for k, (_, c) in zip(of, head):
            sums[k] = sums.get(k, 0) + c
        self.words = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.words[b"\n"] = len(head)
        self.of = [*of, 0, self.tail]  # by word number; the last number is any tail word
        self.inside = [*(math.log10(c / sums[k]) for k, (_, c) in zip(of, head)), 0.0, 0.0]
        self.counts = [*(c for _, c in head), ends, 0]


def class_pairs(train: DataFrame, sent) -> list[tuple[int, int, int]]:
    """(context, class, how often) over all training rows; at most size * size numbers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        k = sent.value
        of, size, rest = np.array(k.of), k.size, len(k.of) - 1
        total = np.zeros(size * size, np.int64)
        for _, texts in common.slices(batches):
            flat = [b"\n"]
            for t in texts:
                flat += tokens(t)
            get = k.words.get
            c = of[np.fromiter((get(w, rest) for w in flat), np.int64, len(flat))]
            total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    found = train.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return sorted((r["pair"], r["n"]) for r in found)


def fit(pairs: list[tuple[int, int]], size: int, dim: int = DIM, steps: int = 600, seed: int = 7):
    """The (size, size) table of log10 P(class | context), by noise-contrastive estimation with Adam."""
    import numpy as np

    rng = np.random.default_rng(seed)
    where = np.array([p for p, _ in pairs], np.int64)
    weight = np.array([n for _, n in pairs], np.float64)
    noise = np.bincount(where % size, weight, size) + 0.5 if len(where) else np.ones(size)
    noise /= noise.sum()
    shapes = [(size, dim), (dim, dim), (size, dim), (size,)]
    par = [rng.normal(0, 0.05, shapes[0]), np.eye(dim), rng.normal(0, 0.05, shapes[2]), np.log(noise)]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    if len(where):
        edges = np.cumsum(weight / weight.sum())
        batch, k = 2048, 128
        logk = np.log(k * noise)
        for t in range(1, steps + 1):
            got = where[np.minimum(np.searchsorted(edges, rng.random(batch)), len(where) - 1)]
            ctx, pos, neg = got // size, got % size, rng.choice(size, k, p=noise)
            r, a, q, b = par
            h = r[ctx] @ a
            sp = (h * q[pos]).sum(1) + b[pos] - logk[pos]
            sn = h @ q[neg].T + b[neg] - logk[neg]
            gp, gn = 1 / (1 + np.exp(-sp)) - 1, 1 / (1 + np.exp(-sn)) / 1.0  # each shared noise word stands for one draw of k
            dh = gp[:, None] * q[pos] + gn @ q[neg]
            dq, db, dr = np.zeros_like(q), np.zeros_like(b), np.zeros_like(r)
            np.add.at(dq, pos, gp[:, None] * h)
            np.add.at(dq, neg, gn.T @ h)
            np.add.at(db, pos, gp)
            np.add.at(db, neg, gn.sum(0))
            np.add.at(dr, ctx, dh @ a.T)
            grads = [dr / batch, r[ctx].T @ dh / batch, dq / batch, db / batch]
            rate = 0.02 * (1 - t / (steps + 1))
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                par[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    r, a, q, b = par
    s = r @ a @ q.T + b
    s -= s.max(1, keepdims=True)
    return (s - np.log(np.exp(s).sum(1, keepdims=True))) / math.log(10)


def score(docs: DataFrame, head: int = HEAD, short: int = SHORT) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose id's crc32 modulo 5 is not 1. A null or empty text is its end alone.
    With no training rows nothing is known: base log10(0.5 / 0.5) a token. Repeated rows stay.
    """
    spark = docs.sparkSession
    common.tune(spark)
    held = common.remainder(F.col("doc_id"), 5) == 1
    train = docs.where(~held)
    counts = common.stored(word_counts(train), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    top = [(r["word"], r["c"]) for r in counts.where(f"c >= 2 and word <> '\\n' and length(word) <= 64").orderBy(F.desc("c"), "word").limit(head).collect()]
    classes = Classes(top, total["n"], total["v"], total["ends"], short)
    head_sum, known = sum(c for _, c in top), len(top)
    tail_sum, tail_kinds = classes.n - classes.ends - head_sum, classes.v - known - (classes.ends > 0)
    sent = spark.sparkContext.broadcast(classes)
    logs = spark.sparkContext.broadcast(fit(class_pairs(train, sent), classes.size).astype("float64"))
    denom = math.log10(classes.n + 0.5 * (classes.v + 1))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        k, table = sent.value, logs.value
        of, inside, c = np.array(k.of), np.array(k.inside), np.array(k.counts, np.float64)
        rest = len(of) - 1
        base = np.log10(c + 0.5) - denom
        base[rest] = 0
        seen = (c > 0).astype(np.int64)
        uid, get = TaskContext.get().partitionId() << 40, k.words.get
        for cols, texts in common.slices(batches):
            flat, sizes = [], []
            for t in texts:
                ts = tokens(t)
                flat += ts
                sizes.append(len(ts))
            w = np.fromiter((get(x, rest) for x in flat), np.int64, len(flat))
            g = of[w]
            last = np.cumsum(sizes) - 1
            ctx = np.concatenate(([0], g[:-1]))
            starts = last + 1 - np.array(sizes)
            ctx[starts] = 0
            model = table[ctx, g] + inside[w]
            tails = (w == rest)
            where = np.flatnonzero(tails)
            owner = np.repeat(np.arange(len(texts)), sizes)[where]
            lists: list[list] = [[] for _ in texts]
            for i, o in zip(where.tolist(), owner.tolist()):
                lists[o].append(flat[i])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(uid, uid + len(texts)), pa.int64()), pa.array(cols["doc_id"], pa.int64()), pa.array(cols["held_out"], pa.bool_()), pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(seen[w], starts)), pa.array(np.add.reduceat(base[w], starts)), pa.array(np.add.reduceat(model, starts)), pa.array(lists, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                ],
                ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "tail"],
            )
            uid += len(texts)

    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, tail array<string>")
    first = common.stored(first, "scores")  # the row numbers must not change from here on
    rows = first.select("uid", F.explode("tail").alias("word"))
    c = F.coalesce("c", F.lit(0))
    mass = 0.5 * tail_kinds / tail_sum if tail_sum else 1.0
    unseen = math.log10(mass) if mass > 0 else -math.inf
    joined = rows.join(counts, "word", "left").select(
        "uid", (c > 0).cast("long").alias("k"), (F.log10(c + 0.5) - denom).alias("b"), F.when(c > 0, F.log10((c - 0.5) / max(tail_sum, 1))).otherwise(F.lit(unseen)).alias("m")
    )
    tail = joined.groupBy("uid").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("m").alias("m"))
    return (
        first.drop("tail").join(tail, "uid", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(classes.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("m", F.lit(0.0))).alias("score"))
    )
