"""Sources: memory documents, vectors, graphs, Markdown files, rule files, session logs, file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators import security

MEMORY = (
    "id string, timestamp timestamp_ntz, source string, summary string, content_hash string, entities array<string>, metadata map<string,string>, scene string, "
    "last_accessed timestamp_ntz, access_count bigint, access_timestamps array<timestamp_ntz>, demoted boolean, merged_into string, is_merged boolean"
)
VECTOR = "memory_id string, timestamp timestamp_ntz, source string, summary string, entities array<string>, vector array<float>"
ENTITY = "name string, type string, first_seen timestamp_ntz, last_seen timestamp_ntz, mention_count bigint, valid_from timestamp_ntz, valid_until timestamp_ntz"
RELATION = "source string, target string, relation string, weight int, created timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, invalid_reason string, entity string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document (one list, or one object a line). A missing path is an empty relation; malformed records drop."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Memories with defaults for what older documents lack."""
    m = read_json(spark, path, MEMORY)
    return m.withColumns({
        "demoted": F.coalesce("demoted", F.lit(False)),
        "is_merged": F.coalesce("is_merged", F.lit(False)),
        "access_count": F.coalesce("access_count", F.lit(0)),
        "scene": F.coalesce("scene", F.lit("general")),
        "last_accessed": F.coalesce("last_accessed", "timestamp"),
    })


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, f"vectors array<struct<{VECTOR}>>").select(F.inline("vectors"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations; a start that lacks is taken from first_seen or created."""
    g = read_json(spark, path, f"entities map<string, struct<{ENTITY}>>, relations array<struct<{RELATION}>>")
    e = g.select(F.explode("entities").alias("entity_id", "e")).select("entity_id", "e.*").withColumn("valid_from", F.coalesce("valid_from", "first_seen"))
    r = g.select(F.inline("relations")).withColumn("valid_from", F.coalesce("valid_from", "created"))
    return e, r


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, content of the *.md files of a folder."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("filename"), F.col("value").alias("content"))


def read_encrypted(spark: SparkSession, path: str, key: bytes, schema: str) -> DataFrame:
    """Rows of encrypted JSON lines; a wrong key or a changed line leaves none."""
    text = spark.read.text(path).select(security.decrypt(F.col("value"), key).alias("value")).where("value is not null")
    return text.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """session_id (the path), modified, content of the session files (*.json) of a folder, for `context.json_sessions`."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """provider file, seq, tokens of JSON lines; lines that don't parse have no tokens. seq follows the file and its lines."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("provider"), F.col("_metadata.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("seq"), "value")
    v = F.from_json("value", "struct<input_tokens:long,inputTokens:long,totalTokens:long>")
    return raw.select("provider", "modified", "seq", F.coalesce(v["input_tokens"], v["inputTokens"], v["totalTokens"]).alias("tokens"))


def newest_file(rows: DataFrame) -> DataFrame:
    """The rows of the file that changed last."""
    top = rows.agg(F.max(F.struct("modified", "provider")).alias("top"))
    return rows.join(F.broadcast(top), F.struct("modified", "provider") == F.col("top")).drop("top")


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, sha256, size of the files below a folder; hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
