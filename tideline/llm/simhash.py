"""SimHash near-duplicate groups by deletion-variant signatures.

A fingerprint has 64 bits and two link at `distance` 2 or less. Cut into two segments of 32
bits, one segment of a linked pair differs by at most one bit, so the pair shares a
one-wildcard variant of that segment: 64 index keys a fingerprint, equality on the key, then
the whole distance is verified.

A bucket of the index has no bound, so pairs are never expanded inside one. Buckets are
pre-aggregated to (count, least, greatest): a bucket of two is one pair, verified at once. The
fingerprints of larger buckets are indexed a second time by their 65 variants of the whole
fingerprint with at most one bit flipped. Two of these meet exactly if the distance is at most
two, and a bucket holds at most 65 distinct fingerprints, all within two bits of each other, so
a star of links to its least one loses nothing. Copies of a text share a fingerprint and are
collapsed to it before all this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SEED, SHINGLE = 42, 3
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashes(text: bytes | None, shingle: int = SHINGLE):
    """The XXH64 of each shingle, repeats included: an array of unsigned numbers. Fewer words are one shingle; none have none."""
    import numpy as np
    import xxhash

    words = (text or b"").translate(_UPPER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])]), ">u8").astype(np.uint64)


def majority(h) -> int:
    """The number whose bits are those set in over half of `h`."""
    import numpy as np

    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big") if len(h) else 0


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash as an unsigned integer; 0 for no words."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null text: fingerprint 0."""
    common.tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for cols, texts in common.slices(batches):
            fps = [signed(fingerprint(t, shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` within two bits, a > b: enough for components, at most 64 for each bucket."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    keys = [(F.lit((s * 32 + i) << 32)).bitwiseOR(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i)))) for s, part in enumerate((high, low)) for i in range(32)]
    n = common.partitions(fps.sparkSession)
    spread = fps.where("fp is not null").repartition(n, "fp")  # a table of few small files would be exploded in few tasks
    index = spread.select("fp", F.explode(F.array(*keys)).alias("key")).where("key is not null")
    bucket = W.partitionBy("key")  # dealt once: count, least and members come from the same rows; a bucket that doesn't fit in memory spills
    met = index.withColumns({"n": F.count("*").over(bucket), "b": F.min("fp").over(bucket)}).where("n > 1")
    pairs = (F.col("n") == 2) & (F.col("fp") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2)
    found = met.where(pairs | (F.col("n") > 2)).select(F.col("fp").alias("a"), F.when(F.col("n") == 2, F.col("b")).alias("b"))
    found = common.stored(found.distinct(), "met")
    crowd = found.where("b is null").select(F.col("a").alias("fp")).repartition(n, "fp")
    flips = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])).alias("key"))
    stars = flips.groupBy("key").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b")
    return found.where("b is not null").union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id that links reach, itself included. Null or empty texts have
    fingerprint zero and link like any other. A null doc_id is never a component_id unless all
    rows of the component lack one. Repeated rows stay. Extra columns are ignored.
    """
    fps = common.stored(fingerprints(docs, shingle), "fps")
    each = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    roots = common.components(links(each.select("fp"))).withColumnRenamed("node", "fp")
    tops = roots.join(each.select("fp", "least"), "fp").groupBy("root").agg(F.min("least").alias("top"))
    linked = roots.join(tops, "root").select("fp", "top")
    label = common.stored(each.join(linked, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id")), "labels")
    return fps.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
