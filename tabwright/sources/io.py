"""Table readers and writers.

Formats are chosen by the lower-cased extension; everything goes through
``spark.read`` / ``df.write`` so column pruning and filter push-down reach the
files (Parquet, JDBC) and reading is split across executors.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension → reader format.
EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".parquet": "parquet", ".json": "json",
              ".jsonl": "json", ".db": "jdbc", ".sqlite": "jdbc", ".sqlite3": "jdbc", ".sdf": "sdf"}
WRITE_FORMATS = ("csv", "tsv", "parquet", "json")


def supported_formats(spark: SparkSession) -> DataFrame:
    """S9 — the extensions this reader understands."""
    return spark.createDataFrame(sorted(EXTENSIONS.items()), "extension string, format string")


def _ext(path: str) -> str:
    p = path.rstrip("/")
    base = os.path.basename(p)
    if "." not in base:
        return ""
    return "." + base.rsplit(".", 1)[-1].lower()


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) is there, on the file system it names or the cluster's default one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, path: str, fmt: str | None = None, query: str | None = None,
               encoding: str | None = None, **options) -> DataFrame:
    """S1 — dispatch on extension (or ``fmt``); unknown extension raises; a
    missing path raises."""
    fmt = fmt or EXTENSIONS.get(_ext(path))
    if fmt is None:
        raise ValueError(f"unsupported file type: {path}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if fmt == "csv":
        return read_csv(spark, path, encoding=encoding, **options)
    if fmt == "tsv":
        return read_csv(spark, path, sep="\t", encoding=encoding, **options)
    if fmt == "parquet":
        return spark.read.options(**options).parquet(path)
    if fmt == "json":
        return read_json(spark, path, **options)
    if fmt == "jdbc":
        return read_database(spark, f"jdbc:sqlite:{path}", query=query, **options)
    if fmt == "sdf":
        return read_sdf_records(spark, path)
    raise ValueError(f"unsupported format: {fmt}")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None,
             infer_schema: bool = True, **options) -> DataFrame:
    """S2/S3 — header CSV/TSV; without an explicit encoding, UTF-8 first and,
    when decoding any row or column name produced replacement characters
    (U+FFFD), a re-read as Shift_JIS."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")    # Spark 4 refuses Shift_JIS and its like otherwise
    r = spark.read.option("header", True).option("inferSchema", infer_schema).option("sep", sep)
    r = r.options(**options)
    if encoding:
        return r.option("encoding", encoding).csv(path)
    df = r.option("encoding", "UTF-8").csv(path)
    strs = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    names_bad = any("�" in c for c in df.columns)
    rows_bad = bool(strs) and not names_bad and bool(df.agg(F.max(F.concat_ws("", *[F.col(f"`{c}`") for c in strs]).contains("�"))).first()[0])
    if names_bad or rows_bad:
        return r.option("encoding", "Shift_JIS").csv(path)
    return df


def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """S5 — a JSON array of records (multi-line document) or JSON lines."""
    if path.endswith(".jsonl"):
        return spark.read.options(**options).json(path)
    return spark.read.option("multiLine", True).options(**options).json(path)


def read_database(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
                  partition_column: str | None = None, lower_bound=None, upper_bound=None,
                  num_partitions: int | None = None, **options) -> DataFrame:
    """S6 — JDBC: ``query`` if given, else ``table`` (first table when neither is
    named must be resolved by the caller through the catalog); a partition
    column with bounds splits the read across executors.  Needs the driver jar
    on the classpath."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if query:
        r = r.option("query", query)
    elif table:
        r = r.option("dbtable", table)
    else:
        raise ValueError("a query or a table name is required")
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    return r.load()


def read_sdf_records(spark: SparkSession, path: str) -> DataFrame:
    """S7 — molecule record files: one row per ``$$$$``-terminated record, with
    the molecule block and a map of ``> <TAG>`` properties."""
    raw = spark.read.option("lineSep", "$$$$").text(path)
    rec = raw.select(F.trim(F.col("value")).alias("record")).where(F.length("record") > 0)
    tags = F.regexp_extract_all(F.col("record"), F.lit(r">\s*<([^>]+)>"), 1)
    vals = F.regexp_extract_all(F.col("record"), F.lit(r">\s*<[^>]+>[^\n]*\n([^\n]*)"), 1)
    mol = F.regexp_extract(F.col("record"), r"^([\s\S]*?M\s+END)", 1)
    return rec.select(mol.alias("molblock"), F.map_from_arrays(tags, vals).alias("properties"))


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> str:
    """S8 — csv (default) / tsv / parquet / json records; format from the
    argument or extension; unknown raises.  Returns the format used."""
    fmt = (fmt or {".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".parquet": "parquet",
                   ".json": "json"}.get(_ext(path), "csv")).lower()
    if fmt not in WRITE_FORMATS:
        raise ValueError(f"unsupported output format: {fmt}")
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "tsv":
        w.option("header", True).option("sep", "\t").csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        w.json(path)
    return fmt


def write_predictions(df: DataFrame, path: str, target: str, prediction: str = "prediction",
                      probabilities: str | None = None, n_classes: int | None = None) -> None:
    """S15 — input columns + ``_predicted_<target>`` (+ ``_proba_class_i``) as CSV."""
    from pyspark.ml.functions import vector_to_array
    out = df.withColumnRenamed(prediction, f"_predicted_{target}")
    if probabilities and n_classes:
        arr = vector_to_array(F.col(probabilities))
        out = out.select(*[c for c in out.columns if c != probabilities],
                         *[arr[i].alias(f"_proba_class_{i}") for i in range(n_classes)])
    out.write.mode("overwrite").option("header", True).csv(path)
