"""File sources and sinks: page trees, strict JSON lines, manifests, benchmark cells, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import result_key, strip
from docloom.functions.versions import parse_version
from docloom.operators.scoring import CATEGORIES
from docloom.operators.sets import field_mismatch

# Fields of a saved classification line.
LINE_FIELDS = (
    "key", "category", "breaking", "breaking_reason", "model", "effort", "prompt_version", "release", "text", "classified_at",
)
LINE_STRINGS = ("key", "breaking_reason", "model", "effort", "prompt_version", "release", "text")
CELL_SCHEMA = (
    "cell struct<scenario:string,mode:string,concurrency:int,repeat:int,requests:bigint,latency_ms:double,jitter_sigma:double>,"
    "worker struct<wall_s:double,samples:struct<t0:array<double>,t1:array<double>,server_recv:array<double>,"
    "server_send:array<double>,delay:array<double>,error:array<string>>>"
)


def scan_pages(spark: SparkSession, root: str, pattern: str = "*.html", excluded: tuple[str, ...] = ()) -> DataFrame:
    """HTML files below a folder as (rel, html), without excluded files and folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    pages = files.select(rel.alias("rel"), F.decode("content", "UTF-8").alias("html"))
    for prefix in excluded:
        pages = pages.filter(~F.startswith("rel", F.lit(prefix)))
    return pages


# -- strict JSON lines ---------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file name and line number, without one task per file.

    Lines are numbered inside each file split, and splits get their offset from the number of
    lines in the splits before it.
    """
    return number_lines(
        spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"))
    )


def number_lines(lines: DataFrame) -> DataFrame:
    tagged = lines.withColumn("_mid", F.monotonically_increasing_id())
    inside = W.partitionBy("file", "_at").orderBy("_mid")
    counted = lines.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select("file", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return tagged.withColumn("_i", F.row_number().over(inside)).join(offsets, ["file", "_at"]).select(
        "file", (F.col("_i") + F.col("_off")).alias("line_no"), "value"
    )


def line_problem(value: Column) -> Column:
    """What is wrong with a saved classification line; null when nothing is."""
    parsed = F.try_parse_json(value)
    keys = F.json_object_keys(value)
    wrong = field_mismatch(keys, F.array(*[F.lit(f) for f in LINE_FIELDS]))

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))

    def text(field: str) -> Column:
        return F.get_json_object(value, f"$.{field}")

    problem = (
        F.when(parsed.isNull(), F.lit("not valid JSON"))
        .when(keys.isNull(), F.lit("not a JSON object"))
        .when(F.size(wrong) > 0, F.concat(F.lit("missing or unexpected fields "), F.array_join(wrong, ", ")))
    )
    for field in LINE_STRINGS:
        problem = problem.when(kind(field) != "STRING", F.lit(f"{field} is not a string"))
    number = F.regexp_extract(kind("classified_at"), r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", 1)
    expected = result_key(text("prompt_version"), text("model"), text("effort"), text("text"))
    return (
        problem.when(strip(text("text")) == "", F.lit("text is empty"))
        .when(kind("breaking") != "BOOLEAN", F.lit("breaking is not true or false"))
        .when(number == "", F.lit("classified_at is not a number"))
        .when(text("classified_at").try_cast("double").isNull(), F.lit("classified_at is not finite"))
        .when((kind("category") != "STRING") | ~text("category").isin(*CATEGORIES), F.lit("unknown category"))
        .when(parse_version(text("release")).isNull(), F.lit("malformed release"))
        .when(text("key") != expected, F.lit("key does not match its text and settings"))
    )


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good store rows, and bad lines with file, line number and reason."""
    checked = lines.withColumn("reason", line_problem(F.col("value")))
    good = checked.filter(F.col("reason").isNull())
    get = lambda f: F.get_json_object("value", f"$.{f}")
    rows = good.select(
        get("key").alias("key"),
        get("category").alias("category"),
        get("breaking").cast("boolean").alias("breaking"),
        *[get(f).alias(f) for f in ("breaking_reason", "model", "effort", "prompt_version", "release", "text")],
        F.timestamp_micros(F.round(get("classified_at").cast("double") * 1e6).cast("bigint")).alias("classified_at"),
    )
    return rows, checked.filter(F.col("reason").isNotNull()).select("file", "line_no", "reason")


def read_strict_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(numbered_lines(spark, path))


def store_lines(rows: DataFrame) -> DataFrame:
    """Store rows as JSON lines with the fixed field set."""
    seconds = F.unix_micros("classified_at") / F.lit(1e6)
    fields = [seconds.alias(f) if f == "classified_at" else F.coalesce(F.col(f), F.lit("")).alias(f) if f in LINE_STRINGS else F.col(f) for f in LINE_FIELDS]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    store_lines(rows).write.mode("errorifexists").text(path)


# -- documents and lines -------------------------------------------------------


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """File names that would be written twice in one section."""
    return documents.groupBy("section", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def write_documents(documents: DataFrame, out: str, gzip: bool = False) -> None:
    """Documents (name, section, body) laid out by section folder; refuses duplicate names."""
    first = duplicate_documents(documents).limit(1).collect()
    if first:
        raise ValueError(f"document {first[0]['name']!r} appears {first[0]['n']} times in section {first[0]['section']!r}")
    writer = documents.write.mode("errorifexists").partitionBy("section")
    writer.option("compression", "gzip" if gzip else "none").json(out)


def write_sorted_lines(lines: DataFrame, order: list[str], out: str) -> None:
    """Lines in a global order over the written part files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("errorifexists").text(out)


# -- manifests -----------------------------------------------------------------


def manifest_records(raw: DataFrame, path_pattern: str) -> tuple[DataFrame, DataFrame]:
    """Install manifests (file, value) to exploded records, and bad records with a reason."""
    records = raw.withColumn("_map", F.from_json("value", "map<string,string>"))
    broken = records.filter(F.col("_map").isNull()).select("file", F.lit(None).cast("string").alias("dir"), F.lit("not a JSON object of folder to record").alias("reason"))
    each = records.select("file", F.explode("_map").alias("dir", "record")).withColumn("_v", F.try_parse_json("record"))

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant"))

    version = parse_version(F.get_json_object("record", "$.version"))
    stamp = F.get_json_object("record", "$.installed_at").try_cast("double")
    paths = F.from_json(F.get_json_object("record", "$.paths"), "array<string>")
    reason = (
        F.when(~F.startswith("dir", F.lit("/")), F.lit("folder is not absolute"))
        .when(F.json_object_keys("record").isNull(), F.lit("record is not an object"))
        .when(version.isNull(), F.lit("invalid version"))
        .when(stamp.isNull(), F.lit("invalid timestamp"))
        .when(F.coalesce(kind("incomplete"), F.lit("BOOLEAN")) != "BOOLEAN", F.lit("incomplete is not true or false"))
        .when(F.coalesce(kind("paths"), F.lit("")) != "ARRAY<STRING>", F.when(F.coalesce(kind("paths"), F.lit("")) == "ARRAY<VOID>", F.lit(None)).otherwise(F.lit("paths is not a list of strings")))
        .when(F.exists(paths, lambda p: ~p.rlike(path_pattern)), F.lit("unexpected path"))
    )
    checked = each.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull()).select(
        "dir",
        F.get_json_object("record", "$.version").alias("version"),
        F.timestamp_micros(F.round(stamp * 1e6).cast("bigint")).alias("installed_at"),
        F.explode_outer(paths).alias("path"),
        F.coalesce(F.get_json_object("record", "$.incomplete").try_cast("boolean"), F.lit(False)).alias("incomplete"),
    )
    bad = checked.filter(F.col("reason").isNotNull()).select("file", "dir", "reason")
    return good, bad.unionByName(broken)


def read_manifest_strict(spark: SparkSession, path: str, path_pattern: str) -> tuple[DataFrame, DataFrame]:
    """One manifest per file; a manifest is one small JSON object."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return manifest_records(raw, path_pattern)


# -- benchmark cells -----------------------------------------------------------


def cells_from(cells: DataFrame) -> DataFrame:
    """One row per sample; a run without results keeps one flagged row."""
    samples = F.col("worker.samples")
    zipped = F.arrays_zip(*[samples[n].alias(n) for n in ("t0", "t1", "server_recv", "server_send", "delay", "error")])
    return cells.select(
        "cell.*", F.col("worker").isNotNull().alias("completed"), F.col("worker.wall_s").alias("wall_s"), F.inline_outer(zipped)
    )


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cell files, one JSON object per file."""
    return cells_from(spark.read.schema(CELL_SCHEMA).json(path, multiLine=True))
