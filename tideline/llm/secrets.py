"""Secret scans with an incremental blob ledger. DataFrame functions only.

A blob is a text, its address the SHA-256 of its UTF-8 bytes. Every version of a document is a
path to a blob. The ledger has a row for each blob and rule version already scanned, with its
findings, also where it has none. A scan addresses all paths, takes one copy of each blob whose
pair with the rule version the ledger lacks, scans only those, appends them to the ledger,
and joins the findings back to all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RULE_VERSION = "3"
# A private key from its BEGIN line to its END line, whatever stands between except another line of dashes; without an END
# line, header lines and the base64 lines that follow (each begins with a long run; a short last line only after one). All repeats
# are of one character or bounded, so that the matcher doesn't recurse, however long the text.
_RUN = "[A-Za-z0-9+/=]{16}"
_PEM = (
    "-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[\\s\\S])*+-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    "|(?:\\s{1,4}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\\n]*+){0,9}"
    f"(?:(?!\\s{{1,40}}+(?!{_RUN}))[A-Za-z0-9+/=\\s])*+(?:(?<={_RUN})\\r?\\n[A-Za-z0-9+/=]{{1,64}}+(?=\\r?\\n|$))?)"
)
# The base patterns, in their order, then those that the method adds. Runs that are
# too short can't hold a longer run, so their least length is in the pattern; for assign it is
# tested after the match, as a short value still uses up its text.
RULES = {
    "assign": "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "pem": _PEM,
    "jwt": "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("findings", FINDINGS)])
_BLOCK = 256


def _good(kind: str, match: Column, value: Column) -> Column:
    return F.length(value) >= LEAST_VALUE if kind == "assign" else F.lit(True)


def _matches(text: Column, kind: str) -> tuple[Column, Column, Column]:
    """(matches, their group 2 where the rule has one, the pieces between them, one more than matches)."""
    pattern = F.lit(RULES[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return found, F.regexp_extract_all(text, pattern, F.lit(1)) if kind == "assign" else found, F.split(text, RULES[kind], -1)


def _spans(found: Column, values: Column, gaps: Column, kind: str, order: int) -> Column:
    """Offsets in code points. Sums before a match go by blocks, so that many matches in a text don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
    starts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int"))
    summed = lambda steps: F.transform(starts, lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))

    def every(steps: Column, sums: Column) -> Column:
        def span(m, i):
            b = F.floor(i / _BLOCK).cast("int")
            before = total(F.slice(sums, F.lit(1), b)) + total(F.slice(steps, b * _BLOCK + 1, i - b * _BLOCK)) + F.length(F.get(gaps, i))
            made = lambda start: F.struct(start.cast("long").alias("start"), F.lit(order).alias("ord"), (start + F.length(m)).cast("long").alias("end"), F.lit(kind).alias("kind"))
            return F.when(_good(kind, m, F.get(values, i)), common.let(before, made))

        return F.filter(F.transform(found, span), lambda s: s.isNotNull())

    spans = common.let(steps, lambda t: common.let(summed(t), lambda u: every(t, u)))
    return F.when(F.size(found) == 0, F.array().cast(FINDINGS)).otherwise(spans)


def findings(blobs: DataFrame) -> DataFrame:
    """Adds `findings` to a frame with `text` (not null): spans of all rules by start, then rule."""
    out = blobs
    for kind in RULES:
        found, values, gaps = _matches(F.col("text"), kind)
        out = out.withColumn(f"_{kind}", F.struct(found.alias("found"), values.alias("values"), gaps.alias("gaps")))
    spans = [_spans(F.col(f"_{k}.found"), F.col(f"_{k}.values"), F.col(f"_{k}.gaps"), k, i) for i, k in enumerate(RULES)]
    return out.withColumn("findings", F.array_sort(F.concat(*spans))).drop(*[f"_{k}" for k in RULES])


class BlobLedger:
    """The ledger's table in a folder that all executors share. Appends are single-writer; a pair that stands twice is read once."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.scratch(spark, "ledger")

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else self.spark.createDataFrame([], LEDGER)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _address() -> Column:
    return F.sha2(_text().cast("binary"), 256)


def update(docs: DataFrame, ledger: BlobLedger, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs of `docs` that the ledger lacks, appends them, and returns (blob, findings) of all blobs with findings."""
    seen = ledger.read().where(F.col("rule_version") == rule_version)
    # copies collapse before anything is dealt by address; the condition on `copies` keeps the anti-join above that
    blobs = docs.select(_address().alias("blob"), _text().alias("text")).groupBy("blob").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    known = seen.select(F.col("blob").alias("known"))
    fresh = blobs.join(known, (F.col("blob") == F.col("known")) & (F.col("copies") > 0), "left_anti").drop("copies")
    ledger.append(findings(fresh).select("blob", F.lit(rule_version).alias("rule_version"), "findings"))
    return ledger.read().where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).groupBy("blob").agg(F.first("findings").alias("findings"))


def scan(docs: DataFrame, ledger: BlobLedger, rule_version: str = RULE_VERSION) -> DataFrame:
    """All paths with their blob's findings: doc_id, blob, findings. Null text counts as the empty text.

    Repeated rows and copies are paths of one blob, scanned once. Extra columns are ignored. A second
    scan of the same texts and rule version scans nothing.
    """
    found = update(docs, ledger, rule_version)
    # only blobs with findings go to the join; a blob that very many paths share is split by adaptive execution
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _address().alias("blob")).join(found, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def redact_documents(docs: DataFrame, ledger: BlobLedger, rule_version: str = RULE_VERSION) -> DataFrame:
    """The columns of `docs`, with findings replaced in the texts of blobs that have any; n_chars, if there, follows the text."""
    key, hit = (common.fresh(n, docs.columns) for n in ("_key", "_hit"))
    found = common.stored(update(docs, ledger, rule_version).select(F.unhex("blob").alias(key), F.lit(True).alias(hit)), "hits")
    d = docs.withColumn(key, F.unhex(_address())).join(found, key, "left")
    d = d.withColumn("text", F.when(F.col(hit), redact(F.col("text"))).otherwise(F.col("text")))
    return d.select(*[F.when(F.col(hit), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans from `findings`."""
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("findings", lambda s: s["ord"] < len(BASE))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return scanned.select("doc_id", *counts, F.sha2(show(base).cast("binary"), 256).alias("base_sha256"), show(F.col("findings")).alias("spans"))


def redact(text: Column, mark: str = "[REDACTED]") -> Column:
    """The text with all findings of all rules replaced, rule after rule; whole keys first, else another rule's mark could break a key's frame."""
    def rule(kind: str):
        def joined(m: Column) -> Column:
            after = lambda i: F.when(i >= F.size(m["found"]), F.lit("")).when(_good(kind, F.get(m["found"], i), F.get(m["values"], i)), F.lit(mark)).otherwise(F.get(m["found"], i))
            return F.array_join(F.transform(m["gaps"], lambda g, i: F.concat(g, after(i))), "")

        return lambda t: common.let(F.struct(*[c.alias(n) for c, n in zip(_matches(t, kind), ("found", "values", "gaps"))]), joined)

    for kind in sorted(RULES, key=lambda k: k != "pem"):
        text = common.let(text, rule(kind))  # bound: each rule uses the text before it several times
    return text
