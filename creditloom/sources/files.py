"""Loan files and result files."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.session import settle

# The loan file layout. A vintage may lack some of these columns.
LOAN_FILE_SCHEMA = T.StructType([
    T.StructField("member_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("loan_amnt", T.DoubleType()),
    T.StructField("term", T.StringType()),
    T.StructField("int_rate", T.DoubleType()),
    T.StructField("grade", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("loan_status", T.StringType()),
    T.StructField("issue_d", T.StringType()),
    T.StructField("annual_inc", T.DoubleType()),
    T.StructField("dti", T.DoubleType()),
    T.StructField("fico_range_low", T.DoubleType()),
    T.StructField("fico_range_high", T.DoubleType()),
    T.StructField("home_ownership", T.StringType()),
    T.StructField("addr_state", T.StringType()),
    T.StructField("emp_length", T.StringType()),
])


def _read_by_name(spark: SparkSession, path: str) -> DataFrame:
    """A loan file with its columns in the order of its own header; columns beyond the layout are text."""
    plain = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    layout = {f.name: f for f in LOAN_FILE_SCHEMA}
    header = spark.read.csv(path, **plain).columns
    schema = T.StructType([layout.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.schema(schema).csv(path, **plain)


def scan_loan_csv(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Loan CSV read by column name; only the asked-for columns are parsed, and all of them have to be there."""
    rows = _read_by_name(spark, path)
    wanted = columns or [f.name for f in LOAN_FILE_SCHEMA]
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows.select(*wanted)


def find_vintages(spark: SparkSession, folder: str) -> list[str]:
    """The loan files of a folder: accepted_*.csv, or every *.csv where there are none."""
    jvm = spark.sparkContext._jvm
    for pattern in ("accepted_*.csv", "*.csv"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if names := sorted(f.getPath().toString() for f in found or []):
            return names
    raise FileNotFoundError(f"no loan files in {folder}")


def _headers(spark: SparkSession, paths: list[str]) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """The paths with the same header line, files and folders of parts apart. Only first lines are read, without a Spark job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf)
        # A folder that Spark wrote holds its parts, which all have the same header.
        parts = sorted(f.getPath().toString() for f in files.listStatus(path) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not parts:
            continue
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            files.open(jvm.org.apache.hadoop.fs.Path(parts[0])), jvm.java.nio.charset.StandardCharsets.UTF_8))
        try:
            first = lines.readLine()
        finally:
            lines.close()
        header = next(csv.reader([first.lstrip("\ufeff")])) if first else []
        out.setdefault((tuple(header), files.getFileStatus(path).isDirectory()), []).append(name)
    return out


def scan_vintages(spark: SparkSession, paths: list[str], wanted: list[str]) -> DataFrame:
    """Several loan files whose columns differ; a column a file lacks is null there.

    Files with the same header are read together. With member_id wanted, each of
    `paths` by itself decides whether `id` takes its place.
    """
    layout = {f.name: f for f in LOAN_FILE_SCHEMA}
    parts = []
    for (header, folders), files in _headers(spark, paths).items():
        schema = T.StructType([layout.get(c, T.StructField(c, T.StringType())) for c in header])
        rows = spark.read.schema(schema).csv(files, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        if "member_id" in wanted:
            if "member_id" not in header:
                rows = rows.withColumn("member_id", F.lit(None).cast("string"))
            rows = _with_user_ids(rows, folders)
        parts.append(rows.select(*[c for c in wanted if c in rows.columns]))
    if not parts:
        return spark.createDataFrame([], T.StructType([layout.get(c, T.StructField(c, T.StringType())) for c in wanted]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _with_user_ids(rows: DataFrame, folders: bool) -> DataFrame:
    """`with_user_id` for each file by itself, or each folder of parts, found by one aggregate over all."""
    found = rows.select("*", F.col("_metadata.file_path").alias("_file"))
    if folders:
        found = found.withColumn("_file", F.regexp_replace("_file", r"/[^/]*$", ""))
    # One row a file.
    known = found.groupBy("_file").agg(F.bool_or(F.col("member_id").isNotNull()).alias("_known"))
    own = F.when(F.col("_known"), F.col("member_id")).otherwise(F.col("id").cast("string") if "id" in rows.columns else F.lit(None).cast("string"))
    return found.join(F.broadcast(settle(known)), "_file").withColumn("member_id", F.trim(own)).drop("_file", "_known")


def with_user_id(raw: DataFrame) -> DataFrame:
    """member_id as trimmed text; when no row has one, `id` takes its place."""
    has_any = not raw.select("member_id").filter("member_id IS NOT NULL").isEmpty()
    return raw.withColumn("member_id", F.trim(F.col("member_id" if has_any else "id").cast("string")))


def write_interactions(df: DataFrame, path: str) -> None:
    """One folder per split, so a job over one split reads only that."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


BATCH = "batch"


def append_rows(df: DataFrame, path: str, batch: str) -> None:
    """Append to a log as the batch of that name; a job that runs again replaces what it wrote, and nothing else."""
    (df.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH).parquet(path))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a log."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])).parquet(path).drop(BATCH)
