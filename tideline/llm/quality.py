"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

Labellers look at one document and vote good, bad or nothing: too few words, many symbols, mostly
capitals, repeated words, columns of bars, a plain text, a word list learned from the labelled
rows, and the annotators' label where there is one. Expectation-maximisation (two classes, one
accuracy for each class and labeller, votes independent given the class) estimates the
accuracies and each document's posterior. The posteriors train logistic regression on hashed word
presence and the measures' bins; its weights, of fixed size, score all documents.

Fitted on at most `FIT_ROWS` labelled rows, those of least xxhash64(doc_id); fewer rows are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIT_ROWS, BUCKETS = 12_000, 1 << 17
#: Rows that the fit expands at once.
FIT_BLOCK = 1_000
#: Extra features: bins of the measures.
BINS, MEASURES = 8, 5
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CAPITALS, _SMALL, _SYMBOLS = bytes(range(65, 91)), bytes(range(97, 123)), b"#*$%&|<>"


def features(text: bytes | None):
    """(number of words, measures, hashed word buckets without repetition)."""
    import zlib

    t = text or b""
    words = t.split()
    n = len(words)
    symbols = len(t) - len(t.translate(None, _SYMBOLS))
    capitals, small = len(t) - len(t.translate(None, _CAPITALS)), len(t) - len(t.translate(None, _SMALL))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    bars = words.count(b"|")
    measures = (symbols / max(n, 1), capitals / max(capitals + small, 1), repeats / max(n - 1, 1), bars / max(n, 1), 1 - len(set(words)) / max(n, 1) if n >= 20 else 0.0)
    return n, measures, sorted({zlib.crc32(w) % BUCKETS for w in set(t.translate(_LETTERS).split())})


def _bins(measures) -> list[int]:
    return [BUCKETS + i * BINS + min(BINS - 1, int(m * BINS)) for i, m in enumerate(measures)]


def votes(n, measures, listed):
    """A matrix of votes, 1 bad, 0 good, -1 nothing; columns in the order of the module's text, without the annotators."""
    import numpy as np

    symbols, capitals, repeats, bars, _ = measures.T
    plain = (symbols < 0.1) & (capitals < 0.3) & (repeats < 0.1) & (bars < 0.05)
    cols = [np.where(n == 0, 1, -1), symbols > 0.4, capitals > 0.5, repeats > 0.3, bars > 0.15, np.where(plain, 0, -1), np.where(listed, 1, -1)]
    return np.stack([c.astype(np.int8) for c in cols], 1)


def weak_labels(v, rounds: int = 50):
    """EM over a matrix of votes (1, 0, -1): (posterior of bad, accuracies when bad, accuracies when good)."""
    import numpy as np

    n, k = v.shape
    if not n:
        return np.zeros(0), np.full(k, 0.7), np.full(k, 0.9)
    bad, good = v == 1, v == 0
    post = np.clip((bad.sum(1) + 0.2) / (bad.sum(1) + 0.3 * good.sum(1) + 0.5), 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 0.999)
        # rate of bad votes among all rows of the class: a labeller that may stay silent is judged by what it says
        hit = (bad.T @ post + 0.5) / (post.sum() + 1)
        false = (bad.T @ (1 - post) + 0.05) / ((1 - post).sum() + 1)
        ok = (good.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1)
        miss = (good.T @ post + 0.05) / (post.sum() + 1)
        odds = np.log(prior / (1 - prior)) + bad @ np.log(hit / false) + good @ np.minimum(np.log(miss / ok), 0)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, hit, ok


def word_list(dirty, clean, least: int = 4):
    """Whether each bucket stands in toxic rows again and again and hardly in others, from its counts in both."""
    return (dirty >= least) & (dirty >= 9 * clean)


def fit(n, measures, buckets, lengths, quality, toxic):
    """Weights and bias of the scorer (log-odds of bad), and the labellers' accuracies.

    A row each of n, measures and labels (-1 where unknown); the rows' buckets stand one after the other, `lengths` of each.
    Rows are taken a block at a time, so what is held beside them doesn't grow.
    """
    import numpy as np

    rows = len(n)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    cuts = [(i, min(rows, i + FIT_BLOCK)) for i in range(0, rows, FIT_BLOCK)]
    owners = lambda i, j: np.repeat(np.arange(j - i), lengths[i:j])
    dirty, clean = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for i, j in cuts:
        for seen, which in ((dirty, toxic[i:j] == 1), (clean, toxic[i:j] != 1)):
            seen += np.bincount(buckets[starts[i] : starts[j]][which[owners(i, j)]], minlength=BUCKETS)
    words = word_list(dirty, clean)
    listed = np.concatenate([np.bincount(owners(i, j), words[buckets[starts[i] : starts[j]]], j - i) > 0 for i, j in cuts] or [np.zeros(0, bool)])
    annotated = np.where((quality < 0) & (toxic < 0), -1, ((quality == 0) | (toxic == 1)).astype(np.int8))
    post, hit, ok = weak_labels(np.concatenate((votes(n, measures, listed), annotated[:, None]), 1))
    weights, bias = np.zeros(BUCKETS + BINS * MEASURES), -2.0
    if rows:
        bins = BUCKETS + np.arange(MEASURES) * BINS + np.minimum(BINS - 1, (measures * BINS).astype(np.int64))
        often = np.append(dirty + clean, np.bincount((bins - BUCKETS).ravel(), minlength=BINS * MEASURES)) >= 3
        m, s = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
        for t in range(1, 201):
            grad = np.zeros(len(weights) + 1)
            for i, j in cuts:
                got, owner = buckets[starts[i] : starts[j]], owners(i, j)
                few = bins[i:j]
                z = np.bincount(owner, weights[got], j - i) + weights[few].sum(1) + bias
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post[i:j]) / rows
                grad[:-1] += np.bincount(got, g[owner], len(weights)) + np.bincount(few.ravel(), np.repeat(g, MEASURES), len(weights))
                grad[-1] += g.sum()
            grad[:-1] *= often  # a feature of fewer rows keeps its weight of zero
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-6)
            weights -= step[:-1]
            bias -= step[-1]
            weights = np.sign(weights) * np.maximum(np.abs(weights) - 0.01, 0)  # L1: words that tell nothing get none
    return weights, float(bias), {"bad": hit.tolist(), "good": ok.tolist()}


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """Fits on labelled rows; an empty or unlabelled table gives the starting scorer, which keeps all but what votes alone reject.

    Of several texts of one id the least by its features counts, so at most `rows` rows reach the driver, packed as Arrow columns.
    """
    import numpy as np

    spark = docs.sparkSession
    common.tune(spark)
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches):
        import pyarrow as pa

        for cols, texts in common.slices(batches):
            got = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["doc_id"], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([list(g[1]) for g in got], pa.list_(pa.float64())), pa.array([g[2] for g in got], pa.list_(pa.int32())), pa.array(cols["quality"], pa.int32()), pa.array(cols["toxic"], pa.int32())],
                ["doc_id", "n", "measures", "buckets", "quality", "toxic"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = texts.join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, n long, measures array<double>, buckets array<int>, quality int, toxic int")  # at most FIT_ROWS small rows
    got = each.groupBy("doc_id").agg(F.min(F.struct("n", "measures", "buckets", "quality", "toxic")).alias("x")).select("doc_id", "x.*").toArrow().combine_chunks().sort_by("doc_id")
    lists = got["buckets"].combine_chunks()
    return fit(
        got["n"].to_numpy(), got["measures"].combine_chunks().flatten().to_numpy().reshape(-1, MEASURES), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()),
        *(got[k].fill_null(-1).to_numpy() for k in ("quality", "toxic")),
    )


def classify(docs: DataFrame, model, keep: list[str] | None = None, names: tuple[str, str] = ("score", "kept")) -> DataFrame:
    """Adds score (probability of good), and kept (score at least a half), to doc_id or the columns `keep` (text among them).

    Null and empty texts are bad: nothing can be learned from them. Every row gives one row.
    """
    spark = docs.sparkSession
    common.tune(spark)
    weights, bias, _ = model
    sent = spark.sparkContext.broadcast(({int(i): float(weights[i]) for i in weights.nonzero()[0]}, bias))
    given, schema, kept = common.carried(docs, keep, [(names[0], "double"), (names[1], "boolean")])

    def run(batches):
        import math

        import pyarrow as pa

        some, bias = sent.value
        get = some.get
        for cols, texts in common.slices(batches):
            scores = []
            for t in texts:
                n, measures, buckets = features(t)
                z = bias + sum(get(b, 0.0) for b in [*buckets, *_bins(measures)])
                scores.append(0.0 if n == 0 else 1 / (1 + math.exp(min(500, max(-500, z)))))
            yield pa.RecordBatch.from_arrays([*kept(cols, texts), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores], pa.bool_())], schema.names)

    return given.mapInArrow(run, schema)
