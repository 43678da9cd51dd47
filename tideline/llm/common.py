"""Shared pieces: reading tables, the shared folder, materialising, bounded slices of a batch, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that goes to Python: texts may be long, so few.
ARROW_ROWS = 256
#: Bytes of text that a Python operator treats at once, and documents at most.
SLICE_BYTES, SLICE_DOCS = 2 << 20, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, whatever the texts' length; and workers that find this package where the driver has it."""
    root = str(Path(__file__).parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local master (tests) gets one of its own; a cluster raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tideline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Frames stored since each `temporary` block began.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def temporary():
    """What is stored inside goes at the end, unless stored with `keep`; nothing lazy may read it afterwards."""
    _OPEN.append([])
    try:
        yield
    finally:
        forget(*_OPEN.pop())


def stored(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _OPEN and not keep:
        _OPEN[-1].append(out)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*frames: DataFrame) -> None:
    """Deletes the folders that `stored` wrote for frames that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, df.scratch_path)


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it as long as `columns` has it in any case: a column that clashes with none."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(docs: DataFrame) -> list[Column]:
    """Two longs that equal rows share, over all columns but maps (which have no hash): 128 bits tell rows apart."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(i), *cols) for i in (1, 2)]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def carried(docs: DataFrame, keep: list[str] | None, new: list[tuple[str, str]]):
    """(frame for Python, its output schema, builder of the kept arrays): rows pass through with columns `keep` (doc_id alone by default) and new ones."""
    from pyspark.sql.pandas.types import to_arrow_type

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if keep is None else docs.select(*keep)
    names = ["doc_id"] if keep is None else keep
    fields = [given.schema[k] for k in names]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in new]])
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def kept(cols: dict, texts: list) -> list:
        import pyarrow as pa

        return [pa.array(texts, pa.binary()).cast(pa.string()) if k == "text" else pa.array(cols[k], types[k]) for k in names]

    return given, schema, kept


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's body computes anew, for each element, what isn't bound to a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches, text: str = "text", budget: int = SLICE_BYTES, docs: int = SLICE_DOCS) -> Iterator[tuple[dict, list]]:
    """Cuts Arrow batches into slices of bounded text: (other columns as lists, texts as UTF-8 bytes or None)."""
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index(text)).cast(pa.large_binary())
        ends = [0]
        held = 0
        for i in range(batch.num_rows):
            size = len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if i > ends[-1] and (held + size > budget or i - ends[-1] >= docs):
                ends.append(i)
                held = 0
            held += size
        ends.append(batch.num_rows)
        for a, b in zip(ends, ends[1:]):
            if b > a:
                yield {k: batch.column(j).slice(a, b - a).to_pylist() for j, k in enumerate(names) if k != text}, texts.slice(a, b - a).to_pylist()


def gathered(batches, budget: int, text: str = "text") -> Iterator[tuple[dict, list]]:
    """Like slices, but slices are joined, over batches too, to about `budget` bytes of text."""
    held: dict[str, list] = {}
    texts: list = []
    size = 0
    for cols, got in slices(batches, text, budget, 1 << 30):
        for k, v in cols.items():
            held.setdefault(k, []).extend(v)
        texts += got
        size += sum(len(t) for t in got if t)
        if size >= budget:
            yield held, texts
            held, texts, size = {}, [], 0
    if texts:
        yield held, texts


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: (node, root), root the least node.

    edges: (a, b) of a sortable type. Each round is two aggregations and two joins on the
    distributed edges, written to the shared folder; the driver sees only a count and a
    checksum. The joins are plain shuffled joins, so a node with very many neighbours is
    split by adaptive execution. Ends when a round changes nothing; the folder of the round before goes.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)).alias("x")).first()
        rows = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if not mark["n"]:
            return rows
        if mark == seen:
            return rows.union(now.select("b", "b")).distinct()
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        before, now = now, stored(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select("b", "m")).distinct(), "edges")
        forget(before)
