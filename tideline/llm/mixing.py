"""Mixing sources to target weights along a time-varying curriculum.

Sources weigh 3, 1, 2, repeating, in code-point order (null last), and share `budget` times all
words; no target exceeds `cap` times its source's words, and the excess is shared again by weight.
Each source's demand over training time t in [0, 1) is its target times a schedule: rising,
flat or falling with its weight (density 1 + s * (2t - 1), integral t + s * (t * t - t)). A document's words
stand at an offset in its source, in the order of its id's SHA-256; the place in training is the time at
which the source's cumulative demand reaches the offset, so the integral is inverted. Words beyond one pass
are a second pass over the same order.

Offsets are running sums by (source, bucket of the order), the buckets' own running sums beside them: no
source passes through one task, whatever its share. The driver gets one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2
#: How fast demand for each weight rises (above 0) or falls.
SLOPES = {3: -0.5, 1: 0.0, 2: 0.5}
#: Sources whose totals the driver takes, 100 bytes each; more raise an error.
MAX_SOURCES, BUCKET_ROWS = 1_000_000, 500


def size(text: Column) -> Column:
    """Words of a text; null has none."""
    t = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(t, "[^ \\t-\\r]+", "w"), "[ \\t-\\r]+", "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], budget: float = BUDGET, cap: float = CAP) -> list[tuple[str | None, int, float, int]]:
    """(source, size, target, weight): water-filling. Each round, sources whose share would exceed their cap stop there."""
    ranked = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(ranked))]
    target: dict[int, float] = {}
    open_, rest = set(range(len(ranked))), budget * sum(n for _, n in ranked)
    while open_:
        unit = max(0.0, rest) / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * ranked[i][1]}
        if not over:
            target |= {i: unit * weights[i] for i in open_}
            break
        for i in over:
            target[i] = float(cap * ranked[i][1])
        rest -= sum(target[i] for i in sorted(over))
        open_ -= over
    return [(s, n, target[i], weights[i]) for i, (s, n) in enumerate(ranked)]


def _place(share: Column, slope: Column) -> Column:
    """The time t with t + slope * (t * t - t) = share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / F.when(slope == 0, F.lit(1.0)).otherwise(2 * slope))


def mix(docs: DataFrame, keep: list[str] | None = None, row: str | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and size, source_size, target, taken, position (of the first word taken, null for none), position2 (second pass).

    Rows stand in the order of the SHA-256 of their id and text's SHA-256, then of their row key, so only rows equal in all columns are interchangeable.
    Null text: size 0; null and empty sources are two. A source whose words are all empty has target 0. Columns of `docs` that are called like the new ones are replaced;
    all others stay. Texts that aren't kept are read once. `row` names a further column, a long that tells all rows apart.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "taken", "position", "position2"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    src, none, order, tie, b, total, before, inside, slope = (common.fresh(n, [*docs.columns, *new]) for n in ("_src", "_none", "_order", "_tie", "_bucket", "_total", "_before", "_inside", "_slope"))
    text = F.coalesce(F.col("text"), F.lit(""))
    ranked = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.sha2(text.cast("binary"), 256)).cast("binary"), 256)
    source = F.col("source").cast("string")
    made = {"size": size(F.col("text")), src: F.coalesce(source, F.lit("")), none: source.isNull(), order: F.substring(ranked, 1, 32), tie: common.row_key(docs)[0]}
    d = docs.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in made.items()])
    if row:
        d, keep = d.withColumn(row, F.monotonically_increasing_id()), [*keep, row]
    if "text" in keep and not row:
        small = common.stored(d.select(src, none, order, "size"), "sizes")
    else:
        d = small = common.stored(d, "sizes")
    sums = small.groupBy(src, none).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    planned = [(s or "", s is None, n, t, SLOPES[w]) for s, n, t, w in targets([(None if r[none] else r[src], r["n"]) for r in sums])]
    plan = spark.createDataFrame(planned, f"{src} string, {none} boolean, source_size long, target double, {slope} double")
    n = max(1, sum(r["rows"] for r in sums) // BUCKET_ROWS)
    digits = 1
    while 16**digits < n and digits < 6:
        digits += 1
    bucket = F.substring(order, 1, digits).alias(b)
    starts = small.select(src, none, bucket, "size").groupBy(src, none, b).agg(F.sum("size").alias(total))
    starts = starts.withColumn(before, F.sum(total).over(W.partitionBy(src, none).orderBy(b)) - F.col(total)).drop(total).join(plan, [src, none])
    d = d.select("*", bucket)
    d = d.withColumn(inside, F.sum("size").over(W.partitionBy(src, none, b).orderBy(order, tie).rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    d = d.join(starts, [src, none, b])
    offset, goal = F.col(before) + F.col(inside), F.round("target").cast("long")
    part = lambda at: F.greatest(F.lit(0), F.least(F.col("size"), goal - at))
    when = lambda at: F.when(part(at) > 0, _place(at / F.col("target"), F.col(slope)))
    again = offset + F.col("source_size")
    return d.select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", (part(offset) + part(again)).cast("long").alias("taken"), when(offset).alias("position"), when(again).alias("position2"))


def in_passes(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """The training sequence: an entry (pass 1 or 2, place, words) for each pass over a document, with its columns, range-sorted by place.

    A document of which nothing is taken has one entry of pass 0, no place and no words, after all others.
    """
    one = F.least("size", "taken")  # a second pass begins only once the first took the whole document
    entry = lambda n, place, words: F.struct(F.lit(n).alias("pass"), place.cast("double").alias("place"), words.cast("long").alias("words"))
    passes = F.filter(F.array(entry(1, F.col("position"), one), entry(2, F.col("position2"), F.col("taken") - one)), lambda e: e["words"] > 0)
    none = F.array(entry(0, F.lit(None), F.lit(0)))
    each = mixed.select("*", F.inline(F.when(F.col("taken") > 0, passes).otherwise(none)))
    last = F.col("place").asc_nulls_last()
    return each.repartitionByRange(*([parts] if parts else []), last).sortWithinPartitions(last, "pass", "doc_id")


def sequenced(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id and the columns of `mix`, read from the training sequence, which is written in its order."""
    row = common.fresh("_row", [*docs.columns])
    entries = common.stored(in_passes(mix(docs, ["doc_id"], row)), "sequence")
    at = lambda n: F.max(F.when(F.col("pass") == n, F.col("place")))
    each = entries.groupBy(row, "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), at(1).alias("position"), at(2).alias("position2"))
    return each.drop(row)


def in_training_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """Range-sorted by position; documents of which nothing is taken are left out."""
    return mixed.where("taken > 0").repartitionByRange(*([parts] if parts else []), "position").sortWithinPartitions("position", "doc_id")
