"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: the wide setting of the SimHash operator.

At a similarity of 0.8 about ten of a fingerprint's 64 bits differ. Cut into segments that differ by one bit at most, that leaves
segments too short to be an index. So the fingerprints' links within two bits, by deletion variants and verified on the shingle sets, are the first links here,
and MinHash bands of the same shingle hashes find the rest: `BANDS` keys of `BAND_ROWS` minima, so a pair of similarity s shares
a key with probability 1 - (1 - s^6)^24, 0.9993 at 0.8. A pair of one group already says nothing new, and all pairs of a bucket may be very many: each member of a
bucket is compared with the bucket's least (a star), then, where a bucket still holds several groups, with the next `NEIGHBOURS` in an order of the minima
that differs from bucket to bucket (a pair at 0.8 shares six buckets on average). Those that share enough of all minima are verified on their whole shingle sets.
These two rounds join most groups at a cost that grows as the rows of the index; they decide nothing. Of every larger bucket that still holds several groups, all pairs of
different groups are then compared on their whole shingle sets, in blocks of bounded size (`crossing`), so no pair that shares a key is left out. Texts of equal words are
collapsed before all this.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, BANDS, BAND_ROWS = 5, 24, 6
#: Members that one is compared with in a bucket after the star, and the rows from which a bucket is cut by the byte that its order begins with.
NEIGHBOURS, CROWDED = 8, 64
#: Shingles of a block of members; two blocks meet in one Python worker.
BLOCK_SHINGLES = 1 << 19
#: The least share of equal minima (a byte of each) of a pair whose texts are compared.
LIKELY = 0.64


def words_key(text: Column) -> Column:
    """A long that texts of equal words share (ASCII case and kinds of space aside); null text has none, like empty text."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(low, "[ \\t-\\r]+", " ")))


def similar(a, b) -> bool:
    """Jaccard similarity of 0.8 or more of two sorted arrays of distinct hashes, in integers."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


@cache
def _factors():
    import numpy as np

    r = np.random.default_rng(simhash.SEED)
    a, b = (r.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None] for _ in "ab")
    return a | np.uint64(1), b


def bands(h) -> tuple[list[int], bytes]:
    """(the band keys as signed longs, a byte of each minimum); no keys for no shingles."""
    import numpy as np
    import xxhash

    odd, mask = _factors()
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        np.minimum(least, ((h[at : at + 512] ^ mask) * odd).min(1), out=least)
    keys = [simhash.signed(xxhash.xxh64_intdigest(row.tobytes(), i)) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return keys if len(h) else [], (least >> np.uint64(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, r1, r2, fp, sim, size, bands, sketch) of every row: r1 and r2 are the row's key, fp the key of its words, sim the SimHash, size the number of distinct shingles."""
    common.tune(docs.sparkSession)
    names = ["doc_id", "r1", "r2", "fp", "sim", "size"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for cols, texts in common.slices(batches):
            every = [simhash.hashes(t, SHINGLE) for t in texts]
            distinct = [np.unique(h) for h in every]
            cols |= {"sim": [simhash.signed(simhash.majority(h)) for h in every], "size": [len(h) for h in distinct]}
            keys, sketches = zip(*map(bands, distinct))
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[k], pa.int64()) for k in names), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], [*names, "bands", "sketch"])

    r1, r2 = common.row_key(docs)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), words_key(F.col("text")).alias("fp"), "text")
    return given.mapInArrow(run, ", ".join(f"{k} long" for k in names) + ", bands array<long>, sketch binary")


def _both(pairs: DataFrame, rows: DataFrame, column: str, x: str, y: str) -> DataFrame:
    """The pairs with `column` of both; joined alike at all sizes, with large keys split by adaptive execution."""
    side = lambda k, name: rows.select(F.col("fp").alias(k), F.col(column).alias(name)).hint("merge")
    return pairs.join(side("a", x), "a").join(side("b", y), "b")


def likely(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """The pairs (a, b) that share `LIKELY` of the minima or more; a pair at 0.8 shares fewer with a probability below 0.00001."""
    both = _both(pairs, each, "sketch", "x", "y")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * BAND_ROWS) for k in (2, 3))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).mean(1) >= LIKELY))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, each: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts (fp, text) are similar, by their whole shingle sets."""
    some = common.stored(likely(pairs, each), "likely")
    both = _both(some, texts, "text", "text", "other")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, kept = None, None
        for cols, texts in common.slices(batches):
            yes = []
            for t, o, b in zip(texts, cols["other"], cols["b"]):
                if b != last:  # rows of one b mostly stand together
                    last, kept = b, np.unique(simhash.hashes(o.encode(), SHINGLE))
                yes.append(similar(np.unique(simhash.hashes(t, SHINGLE)), kept))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(cols[k], yes) if y], pa.int64()) for k in "ab"], ["a", "b"])

    return common.stored(both.select("a", "b", "text", "other").mapInArrow(run, "a long, b long"), "similar")


def links_between(xs: list, ys: list) -> list[tuple[int, int]]:
    """Pairs (a, b), a > b, of similar members (fp, label, sorted distinct hashes) of `xs` and `ys`: enough to join all labels that similar members link."""
    import numpy as np

    values, sizes = np.concatenate([x[2] for x in xs]), np.array([len(x[2]) for x in xs])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(xs)), sizes)[order]
    labels = np.array([x[1] for x in xs])
    top: dict[int, int] = {}

    def root(label: int) -> int:
        while label in top:
            label = top[label]
        return label

    found = []
    for fp, label, held in ys:
        start, end = np.searchsorted(values, held), np.searchsorted(values, held, "right")
        n = end - start
        both = np.bincount(owner[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(xs))
        for i in np.flatnonzero((labels != label) & (5 * both >= 4 * (sizes + len(held) - both))):
            a, b = root(int(labels[i])), root(label)
            if a != b:
                top[max(a, b)] = min(a, b)
                found.append((max(fp, xs[i][0]), min(fp, xs[i][0])))
    return found


def crossing(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join all groups which similar members of one bucket link; rows: (key, fp, size, label), texts: (fp, text).

    A bucket is cut into blocks, in the order of its labels, and each two blocks meet in one task: none holds a whole large bucket. Two blocks of one same label don't meet.
    """
    w = W.partitionBy("key").orderBy("label", "fp").rowsBetween(W.unboundedPreceding, -1)
    cut = common.stored(rows.select("key", "fp", "label", F.floor(F.coalesce(F.sum("size").over(w), F.lit(0)) / BLOCK_SHINGLES).alias("block")), "blocks")
    each = cut.groupBy("key", "block").agg(F.min("label").alias("l"), F.max("label").alias("m"))
    met = each.join(each.toDF("key", "other", "l2", "m2"), "key").where("block <= other and least(l, l2) <> greatest(m, m2)").select("key", F.col("block").alias("i"), F.col("other").alias("j"))
    ends = met.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sets = texts.join(cut.select("fp").distinct().hint("merge"), "fp", "left_semi").select("fp", "text")

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for cols, found in common.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols["fp"], pa.int64()), pa.array([np.unique(simhash.hashes(t, SHINGLE)).tobytes() for t in found], pa.binary())], ["fp", "held"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, sides = None, ([], [])

        def out():
            pairs = links_between(sides[0], sides[1] or sides[0])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, i, j, block, fp, label, held in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != now:
                    if now:
                        yield out()
                    now, sides = (key, i, j), ([], [])
                sides[block != i].append((fp, label, np.frombuffer(held, np.uint64)))
        if now:
            yield out()

    given = ends.join(cut, ["key", "block"]).join(sets.mapInArrow(hashed, "fp long, held binary").hint("merge"), "fp").select("key", "i", "j", "block", "fp", "label", "held")
    dealt = given.repartition(common.partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return common.stored(dealt.mapInArrow(run, "a long, b long").distinct(), "crossing")


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _first(each: DataFrame) -> DataFrame:
    """Candidate pairs from the fingerprints: texts of one fingerprint, and fingerprints that deletion variants link."""
    top = each.groupBy("sim").agg(F.min("fp").alias("top"))
    same = each.select("fp", "sim").join(top, "sim").where("fp <> top").select(*_pair("fp", "top"))
    near = simhash.links(each.select(F.col("sim").alias("fp")).distinct())
    near = near.join(top.select(F.col("sim").alias("a"), F.col("top").alias("x")), "a").join(top.select(F.col("sim").alias("b"), F.col("top").alias("y")), "b")
    return same.union(near.select(*_pair("x", "y"))).distinct()


def groups(each: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the distinct texts `each` (fp, sim, size, bands, sketch) that are similar to another one; root is the least fp of the group."""
    first = common.stored(_first(each), "first")
    index = each.select("fp", "size", F.explode("bands").alias("key"))
    members = index.withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1")  # dealt once
    members = common.stored(members, "members")
    need = members.select("fp").union(first.select("a")).union(first.select("b")).distinct()
    held = docs.select(words_key(F.col("text")).alias("fp"), F.coalesce("text", F.lit("")).alias("text")).groupBy("fp").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # the condition on `copies` keeps the join above the aggregate: copies collapse before texts are dealt out
    need = need.withColumnRenamed("fp", "node").hint("merge")
    texts = common.stored(held.join(need, (F.col("fp") == F.col("node")) & (F.col("copies") > 0), "left_semi").select("fp", "text"), "texts")
    alike = lambda a, b: 5 * F.least(a, b) >= 4 * F.greatest(a, b)  # else the sizes alone rule 0.8 out

    def joined(known: list[DataFrame], pairs: DataFrame) -> DataFrame:
        edges = reduce(DataFrame.union, [*known, verified(pairs, each, texts)])  # what is joined already is a star: few rounds
        return common.stored(common.components(edges), "roots")

    tops = members.groupBy("key").agg(F.min(F.struct(F.col("fp").alias("b"), F.col("size").alias("other"))).alias("x")).select("key", "x.*")
    star = members.join(tops, "key").where((F.col("fp") != F.col("b")) & alike(F.col("size"), F.col("other"))).select(*_pair("fp", "b"))
    seen = common.stored(star.union(first).distinct(), "pairs")
    roots = joined([], seen)

    def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The members, with labels, of those buckets that hold several groups."""
        now = common.stored(rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root"), "labelled")
        return now.join(now.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key"), "key", "left_semi")

    open_ = still_open(members, roots)
    # the bytes from another place for each bucket: similar texts mostly stand together, in one bucket or another of those that they share
    width = BANDS * BAND_ROWS
    at = F.pmod("key", F.lit(width)).cast("int") + 1
    turned = F.concat(F.substring("sketch", at, F.lit(width)), F.substring("sketch", F.lit(1), at - 1))
    rows = open_.join(each.select("fp", "sketch").hint("merge"), "fp").select("key", "fp", "size", "label", F.when(F.col("n") > CROWDED, F.substring(turned, 1, 1)).alias("part"), F.substring(turned, 1, 12).alias("turned"))
    w = W.partitionBy("key", "part").orderBy("turned", "fp")
    after = F.array_compact(F.array(*[F.lead(F.struct(F.col("fp").alias("b"), F.col("label").alias("top"), F.col("size").alias("other")), k).over(w) for k in range(1, NEIGHBOURS + 1)]))
    met = rows.withColumn("after", after).select("fp", "size", "label", F.inline(F.filter("after", lambda x: x["top"] != F.col("label")))).where(alike(F.col("size"), F.col("other")))
    pairs = met.select(*_pair("fp", "b")).distinct().join(seen, ["a", "b"], "left_anti")
    roots = joined([roots.toDF("a", "b")], common.stored(pairs, "pairs"))
    # all pairs of a smaller bucket have met by now
    rest = crossing(still_open(members.where(F.col("n") > NEIGHBOURS + 1), roots), texts)
    return common.stored(common.components(roots.toDF("a", "b").union(rest)), "roots") if rest.head(1) else roots


def near_copies(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, r1, r2 (`common.row_key`), root (a key of its group) and component_id, the group's least doc_id (null if all lack one).

    Texts of equal words are one group whatever their length, null like empty text; a text of fewer words than a shingle is one shingle. Extra columns are ignored.
    """
    rows = common.stored(signatures(docs), "signatures")
    each = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("sim").alias("sim"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "distinct")
    roots = groups(each, docs).withColumnRenamed("node", "fp")
    label = each.select("fp", "least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = label.groupBy("root").agg(F.min("least").alias("component_id"))
    label = common.stored(label.select("fp", "root").join(tops, "root"), "labels")
    return rows.select("doc_id", "r1", "r2", "fp").join(label, "fp").select("doc_id", "r1", "r2", "root", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, of each group the one of least doc_id (nulls last), then of least row key; of rows that equal it in all columns one stays."""
    a, b, again = (common.fresh(n, docs.columns) for n in ("_r1", "_r2", "_again"))
    with common.temporary():
        rows = common.stored(near_copies(docs), "rows")
        per = rows.groupBy("root", "doc_id", "r1", "r2").agg(F.count("*").alias("n"))  # a group's copies are summed before they meet
        pick = per.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("r1").alias("k1"), F.col("r2").alias("k2"))).alias("x")).select("root", "x.k1", "x.k2")
        best = (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2"))
        marks = per.join(pick, "root").where(~best | (F.col("n") > 1)).groupBy(F.col("r1").alias(a), F.col("r2").alias(b)).agg(F.max(best).alias(again))
        marks = common.stored(marks, "marks", keep=True)
    r1, r2 = common.row_key(docs)
    d = docs.withColumns({a: r1, b: r2}).join(marks.hint("merge"), [a, b], "left")
    left = d.where(F.col(again).isNull())
    if marks.where(F.col(again)).head(1):
        left = left.union(d.where(F.col(again)).dropDuplicates([a, b]).select(*left.columns))
    return left.select(*[f"`{c}`" for c in docs.columns])
