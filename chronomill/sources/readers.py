"""Sources: JSON lines, one document per key, trees, manifests, change logs, diffs, configuration.

All readers are scans with a declared schema; a source that is missing is an empty table where the reader says
so. Nothing here uses a network.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("memory_id", "artifact_uri", "artifact_type", "symbol", "source_commit")],
        T.StructField("observed_at", T.DoubleType()),
        *[T.StructField(n, T.StringType()) for n in ("evidence_type", "evidence_ref")],
        T.StructField("valid_from", T.DoubleType()),
        T.StructField("valid_to", T.DoubleType()),
        T.StructField("supersedes", T.StringType()),
        T.StructField("depends_on", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("role_tags", T.ArrayType(T.StringType())),
        *[T.StructField(n, T.StringType()) for n in ("statement", "artifact_digest", "symbol_qualified_name", "symbol_digest", "validity_granularity")],
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON lines file or folder; blank lines are skipped, and a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def json_by_key(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file; ``doc_key`` is the file's name without its ending."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("doc_key"), "*")


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256, content) of every file below a folder, paths relative to it."""
    base = folder.rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_extract("path", f"{re.escape(base)}(.*)$", 1)
    return df.select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def layered(layers: list[DataFrame], key: str = "path") -> DataFrame:
    """Tables of one shape over each other: for each key the row of the last layer that has it."""
    rows = [d.withColumn("_layer", F.lit(i)) for i, d in enumerate(layers)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    rest = [c for c in layers[0].columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_layer").alias("_r")).select(key, "_r.*")


def manifest(files: DataFrame) -> DataFrame:
    """One row: number of files, their size, and a digest over their paths and digests in path order.

    The list of a tree is gathered here, as its digest is defined over the whole list.
    """
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["path"], F.lit(":"), x["sha256"])), "\n")
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.sha2(text, 256).alias("tree_sha256"))


def change_log(spark: SparkSession, path: str, pattern: str = "deprecat|remov|renam|replac") -> DataFrame:
    """(commit, parents, subject, body) from a log with 0x1e after each record and 0x00 between its fields,
    where subject or body mention what the pattern asks for."""
    raw = spark.read.option("lineSep", "\x1e").text(path).where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\x00")
    return (
        raw.select(parts.alias("p"))
        .where(F.size("p") >= 3)
        .select(
            F.col("p")[0].alias("commit"),
            F.filter(F.split(F.col("p")[1], r"\s+"), lambda x: x != "").alias("parents"),
            F.col("p")[2].alias("subject"),
            F.coalesce(F.try_element_at("p", F.lit(4)), F.lit("")).alias("body"),
        )
        .where(F.lower(F.concat_ws("\n", "subject", "body")).rlike(pattern))
    )


def diff_lines(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, line_no, line, file, hunk_no) of unified diffs; lines before the first hunk of a file have hunk 0.

    The window's groups are single diffs.
    """
    lines = F.split(F.regexp_replace(F.col(diff), "\r\n", "\n"), "\n")
    numbered = df.select(key, F.posexplode(lines).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("line", r"^diff --git \S+ (?:b/)?(\S+)", 1)
    return numbered.select(
        key, "line_no", "line",
        F.coalesce(F.last(F.when(name != "", name), True).over(w), F.lit("")).alias("file"),
        F.sum(F.startswith("line", F.lit("@@ ")).cast("int")).over(w).cast("int").alias("hunk_no"),
    )


def truncated_diffs(df: DataFrame, key: str, diff: str, sources: tuple[str, ...] = ("src/",), most: int = 10_000, least_rest: int = 500) -> DataFrame:
    """(key, diff): diffs of more than ``most`` characters with the parts of source files first.

    Files are sources if their path holds one of ``sources``. Their lines all stay, in order; the other lines follow
    up to ``most`` characters where more than ``least_rest`` are left. Shorter diffs stay as they are.
    """
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = df.where(F.length(diff) > most).select(key, F.posexplode(F.split(F.regexp_replace(diff, "\r\n", "\n"), "\n")).alias("line_no", "line"))
    head = F.last(F.when(F.startswith("line", F.lit("diff --git")), F.col("line")), True).over(w)
    is_source = F.coalesce(reduce(or_, [F.contains("_head", F.lit(s)) for s in sources]), F.lit(False))
    lines = lines.withColumn("_head", head).withColumn("_source", is_source)
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    cut_ = lines.groupBy(key).agg(part(F.col("_source")).alias("_first"), part(~F.col("_source")).alias("_rest"))
    left = F.lit(most) - F.length("_first")
    cut_ = cut_.select(key, F.when(left > least_rest, F.concat("_first", F.lit("\n"), F.substr("_rest", F.lit(1), left))).otherwise(F.col("_first")).alias("_cut"))
    return df.select(key, diff).join(cut_, key, "left").select(key, F.coalesce("_cut", diff).alias("diff"))


def hunks(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, file, hunk_no, hunk, n_added, n_removed) of unified diffs."""
    n = F.col("line")
    rows = diff_lines(df, key, diff).where((F.col("hunk_no") > 0) & ~F.startswith(n, F.lit("diff --git ")))
    return rows.groupBy(key, "file", "hunk_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("hunk"),
        F.count_if(F.startswith(n, F.lit("+")) & ~F.startswith(n, F.lit("+++"))).alias("n_added"),
        F.count_if(F.startswith(n, F.lit("-")) & ~F.startswith(n, F.lit("---"))).alias("n_removed"),
    )


def sqlite_table(spark: SparkSession, path: str, name: str, schema: T.StructType | str) -> DataFrame:
    """A table of a local database file, read on the driver; meant for small legacy stores."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cols = [f.name for f in (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields]
        listed = ", ".join(f'"{c}"' for c in cols)
        rows = db.execute(f'select {listed} from "{name}"').fetchall()
    return spark.createDataFrame(rows, schema)


def configuration(path: str) -> dict:
    """A small YAML or JSON file; YAML needs its library to be there."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        import json

        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml library") from e
    return yaml.safe_load(text)


def canonical_digest(value: object) -> str:
    """Digest of a JSON value with sorted keys, separators as Python writes them."""
    import json

    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def open_end(c: str = "valid_to"):
    """The wire form of an open end ('inf') as a number."""
    text = F.col(c).cast("string")
    return F.when(F.lower(text) == "inf", F.lit(float("inf"))).otherwise(text.try_cast("double"))


def records_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of the v1 store from JSON lines, in which an open end is the text 'inf'."""
    wire = T.StructType([T.StructField(f.name, T.StringType() if f.name == "valid_to" else f.dataType) for f in RECORD.fields])
    return json_lines(spark, path, wire).withColumn("valid_to", open_end()).select(*[f.name for f in RECORD.fields])
