"""Corpus and dataset sources/sinks.

Tables are Parquet directories. A dataset with splits is one table partitioned by
``target_split`` (a copy of the routed split: partition values turn '' into NULL on
read, and the row's own ``split`` must be kept as data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_spark.functions.text import normalize_variant
from evidence_spark.operators.keyed import key_violations
from evidence_spark.session import scratch_path

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("hf_id", T.StringType(), False),
        T.StructField("question", T.StringType(), False),
        T.StructField("context", T.StringType(), False),
        T.StructField("answer", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("split", T.StringType(), False),
        T.StructField("original_quotes", T.StringType(), True),
        T.StructField("quotes", T.StringType(), True),
    ]
)
REQUIRED = ["hf_id", "question", "context", "answer", "level", "split"]
CORPUS_FILES = ("train", "validation", "test")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


RECORD_FIELDS = ("id", "question", "context", "answer", "level", "quotes")
RAW_SCHEMA = ", ".join(f"{f} variant" for f in RECORD_FIELDS) + ", _corrupt_record string"


def read_corpus_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """Files train/validation/test (missing ones skipped) as raw records.

    ``<split>.json`` holds one JSON array (one task streams one file, of any size);
    ``<split>.jsonl`` holds one record a line and is read in splits: the form for large
    corpora. Each field is a variant, so polymorphic fields survive, and a record that is no
    JSON object is kept as ``_corrupt_record``. ``split`` comes from the file name; ``pos``
    increases in file order within a read partition. Use :func:`validate_corpus` for typed rows.
    """
    out = spark.createDataFrame([], f"split string, pos bigint, {RAW_SCHEMA}")
    for split in CORPUS_FILES:
        for suffix in ("json", "jsonl"):
            path = f"{data_dir.rstrip('/')}/{split}.{suffix}"
            if _exists(spark, path):
                rows = spark.read.schema(RAW_SCHEMA).option("multiLine", suffix == "json").option(
                    "columnNameOfCorruptRecord", "_corrupt_record").json(path)
                out = out.unionByName(rows.withColumn("split", F.lit(split)).withColumn("pos", F.monotonically_increasing_id()))
    return out


def validate_corpus(raw: DataFrame, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """S2 (+P2 on ``answer``): split raw records into (corpus rows, quarantine).

    Renames source ``id`` to ``hf_id`` and ``quotes`` to ``original_quotes``; ``quotes``
    starts NULL. A record is rejected when it is no JSON object, when a required field is
    missing, NULL or not a string (``answer`` may be any shape and is normalised), or when
    ``quotes`` is present and neither NULL nor a string. The original aborts the load on the
    first bad record; at scale we quarantine with a ``reason`` and offer ``fail_fast``
    (raises if any record is rejected: one cheap ``isEmpty`` action).
    """
    def text_field(name):
        return F.when(F.schema_of_variant(F.col(name)) == "STRING", F.try_variant_get(F.col(name), "$", "string"))

    corrupt = F.col("_corrupt_record").isNotNull()
    kind = F.schema_of_variant(F.col("quotes"))
    odd_quotes = F.col("quotes").isNotNull() & ~kind.isin("STRING", "VOID")
    df = raw.select(
        text_field("id").alias("hf_id"),
        text_field("question").alias("question"),
        text_field("context").alias("context"),
        normalize_variant(F.col("answer")).alias("answer"),
        text_field("level").alias("level"),
        F.col("split"),
        text_field("quotes").alias("original_quotes"),
        F.lit(None).cast("string").alias("quotes"),
        F.col("pos"),
        corrupt.alias("_corrupt"),
        odd_quotes.alias("_odd"),
    )
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED] + [F.when(F.col("_odd"), F.lit("quotes"))]
    faults = F.when(F.col("_corrupt"), F.array(F.lit("record"))).otherwise(F.array_compact(F.array(*missing)))
    df = df.withColumn("_missing", faults)
    bad = F.size("_missing") > 0
    quarantine = df.where(bad).select(
        "split", "pos", "hf_id", F.concat(F.lit("invalid: "), F.array_join("_missing", ",")).alias("reason")
    )
    valid = df.where(~bad).select(*REQUIRED, "original_quotes", "quotes")
    if fail_fast and not quarantine.isEmpty():
        raise ValueError("corpus has invalid records; see the quarantine output")
    return valid, quarantine


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Read a published table; an absent path gives an empty DataFrame (``schema``)."""
    if not _exists(spark, path):
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def find_by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """S5 batch lookup: semi join with a key table (AQE picks broadcast by its size). A single
    key is a filter (``df.where(col(key) == value)``), pushed to the scan."""
    return df.join(keys.select(key), key, "left_semi")


def append_batch(batch: DataFrame, target: DataFrame | None, keys: list[str], path: str) -> int:
    """S3 + S7: append ``batch`` to the table at ``path`` after the key checks.

    Raises on a duplicate key in the batch or against the target (as a unique index
    would). Returns the number of rows written; an empty batch writes nothing. The batch is
    evaluated once, into the shared scratch folder; checks, count and append read that.
    """
    spark = batch.sparkSession
    staged_path = scratch_path(spark, "batch")
    batch.write.parquet(staged_path)
    staged = spark.read.schema(batch.schema).parquet(staged_path)
    bad = key_violations(staged, target, keys).limit(5).collect()
    if bad:
        raise ValueError("duplicate key(s): " + ", ".join(str(r.asDict()) for r in bad))
    n = staged.count()
    if n:
        staged.write.mode("append").parquet(path)
    return n


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_col: str = "target_split") -> None:
    """Write a dataset by split (``parquet`` or ``json`` lines)."""
    w = df.write.mode("overwrite").partitionBy(partition_col)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError("fmt must be parquet or json")
