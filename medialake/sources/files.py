"""Media files, sidecar documents and registries as tables; reports and exports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.media import extension
from medialake.plans.shared import stored

#: Folders that are never scanned.
IGNORED_FOLDERS = (".git", ".index", "__pycache__", "node_modules")
INDEX_FOLDER = ".index"
REGISTRY_FILE = "categories.json"

SIDECAR_FIELDS = (
    "schema_version int, id string, "
    "file struct<name:string,width:int,height:int,bytes:bigint,format:string,animated:boolean,media_type:string,duration_s:double,fps:double,frame_count:int>, "
    "source struct<original_filename:string,original_path:string,sha256:string,format:string,width:int,height:int,bytes:bigint,converted:boolean>, "
    "analysis struct<title:string,description:string,ocr_text:string,tags:array<string>,subjects:array<string>,meme_type:string,template:string,tone:array<string>,topics:array<string>,language:string,nsfw:boolean,confidence:double>, "
    "category struct<id:int,name:string,confidence:double,assigned_at:string,model:string,run_id:string,suggested:string,source:string>, "
    "processing struct<tool_version:string,profile:string,vision_model:string,processed_at:string,duration_s:double,attempts:int,ocr_pass:string>"
)
CATEGORY_FIELDS = "id int, name string, folder string, description string, keywords array<string>, count bigint, pinned boolean, rule string, source string"


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...], ignored: tuple[str, ...] = IGNORED_FOLDERS, content: bool = False) -> DataFrame:
    """(path, size_bytes, modified_at, ext[, content]) of the files under ``root``.

    Hidden names and ignored folders are passed over at any depth; extensions are compared whatever their
    case. Without ``content`` no bytes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file:"))
    below = F.split_part(F.regexp_replace("path", r"^[a-z]+:/*", "/"), base, F.lit(-1))
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    skipped = F.exists(parts, lambda p: F.startswith(p, F.lit("."))) | F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), F.array(*map(F.lit, ignored)))
    kept = files.withColumn("ext", extension(F.col("path"))).where(~skipped & F.col("ext").isin(*[e.lower() for e in extensions]))
    columns = ["path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "ext"]
    return kept.select(*columns, *(["content"] if content else []))


def with_sha256(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(column), 256))


def read_sidecars(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(sidecars with their path, unreadable ones as path and raw text) of the JSON documents under ``root``.

    The registry file and the index folder are no sidecars. A document that does not parse, or has no id,
    fails nothing. Folders that are never scanned are not entered; many small files make one split, and each file is
    opened once for both parts.
    """
    from medialake.sources.library import read_library

    content = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    found = read_library(spark, root, (".json",), content=True).where(F.endswith("path", F.lit(".json")) & (F.element_at(F.split("path", "/"), -1) != REGISTRY_FILE))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    document = F.from_json("text", f"{SIDECAR_FIELDS}, _corrupt string", options)
    rows = stored(found.select("path", content.alias("text")).withColumn("document", document))
    broken = F.col("document").isNull() | F.col("document._corrupt").isNotNull() | F.col("document.id").isNull()
    good = rows.where(~broken).select("document.*", "path").drop("_corrupt")
    return good, rows.where(broken).select("path", F.when(F.col("document").isNull(), F.col("text")).otherwise(F.col("document._corrupt")).alias("text"))


def read_category_registry(spark: SparkSession, path: str) -> DataFrame:
    """A row for each category of a registry document; none if it is absent or does not parse."""
    folder, _, name = path.rpartition("/")
    reader = spark.read.schema(f"categories array<struct<{_struct(CATEGORY_FIELDS)}>>").option("multiLine", True).option("mode", "PERMISSIVE")
    document = reader.option("pathGlobFilter", name).json(folder)
    return document.select(F.explode("categories").alias("c")).select("c.*")


def _struct(fields: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ") for f in fields.split(",")))


def write_library(items: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Items as Parquet by category folder and media type; those without a category in the root's default part."""
    items.write.mode(mode).partitionBy("category_folder", "media_type").parquet(path)


def append_record(record: DataFrame, path: str) -> None:
    """Add the row of a scan or a run to its history."""
    record.write.mode("append").parquet(path)


def scan_record(counts: DataFrame, started_at, finished_at, error: str | None = None) -> DataFrame:
    """``counts`` of a scan as a record with times, duration and error."""
    return counts.select(F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"), "*", F.lit((finished_at - started_at).total_seconds()).alias("duration_s"), F.lit(error).cast("string").alias("error"))


def write_failures(quarantine: DataFrame, path: str) -> None:
    """(source_path, stage, message) of what failed, as JSON lines."""
    quarantine.select("source_path", "stage", "message").write.mode("append").json(path)


def export_json(results: DataFrame) -> DataFrame:
    """One column ``json`` with each row as a nested document."""
    return results.select(F.to_json(F.struct("*")).alias("json"))
