"""Readers and writers: trees, logs, access files, rules, indexes; delimited files are read by ``delimited``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvault.functions.predicates import is_hidden
from sparkvault.operators.changes import fold_latest
from sparkvault.operators.search import gram_part
from sparkvault.sources.delimited import read_delimited, sniff_delimiter  # noqa: F401

OP_SCHEMA = "vault_id string, client_id string, seq long, type string, path string, `from` string, `to` string, data string, binary boolean, pre_hash string, ts timestamp, author string"
MANIFEST_SCHEMA = "vault_id string, row_no long, path string, hash string, binary boolean, deleted boolean"
CONFLICT_SCHEMA = "vault_id string, ts timestamp, path string, kind string, format string, sidecar string, origin string"


#: Files that a task writes.
TASK_FILES = 500


def write_tree(rows: DataFrame, folder: str, root: str) -> None:
    """A text file of each row's ``value`` under ``root``, in folders by the column ``folder``.

    A file costs far more than its row, so that tasks have files by number and
    not by bytes, and each moves its own into place: a failed call leaves some.
    """
    tasks = max(1, -(-rows.count() // TASK_FILES))
    writer = rows.repartition(tasks, "value").write.partitionBy(folder).option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)


def scan_tree(spark: SparkSession, root: str, keep: tuple[str, ...] = (".vault/README.md",)) -> DataFrame:
    """(path, hash, size, is_text, mtime, content) of the files under ``root``; hidden ones are left out but those of ``keep``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.substring(F.regexp_replace("path", "^file:/*", "/"), F.length(top) + 2, F.lit(1 << 20))
    rows = files.select(path.alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.is_valid_utf8(F.col("content").cast("string")).alias("is_text"), F.col("modificationTime").alias("mtime"), "content")
    return rows.filter(~is_hidden(F.col("path")) | F.col("path").isin(*keep))


def read_manifest_log(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a bad row fails the read."""
    return spark.read.schema(MANIFEST_SCHEMA).option("mode", "FAILFAST").json(path)


def read_op_log(spark: SparkSession, path: str) -> DataFrame:
    """Ops; data is base64 in the file."""
    return spark.read.schema(OP_SCHEMA).json(path).withColumn("data", F.unbase64("data"))


def read_conflict_log(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: bad rows are left out."""
    rows = spark.read.schema(f"{CONFLICT_SCHEMA}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("path").isNotNull()).drop("_corrupt_record")


def parse_access(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with name, role, hash, generated, last_seen, expires_at, email; comments and bad rows are left out."""
    parts = F.split(F.trim(line), r"\s+")
    field = lambda i: F.nullif(F.get(parts, i), F.lit("-"))
    good = (F.trim(line) != "") & ~F.trim(line).startswith("#") & F.size(parts).between(4, 7) & F.get(parts, 2).rlike("^[0-9a-f]{24}$")
    return lines.filter(good).select(
        *(c for c in lines.columns if c != line), F.get(parts, 0).alias("name"), F.get(parts, 1).alias("role"), F.get(parts, 2).alias("hash"),
        F.try_to_timestamp(field(3), F.lit("yyyy-MM-dd'T'HH:mm")).alias("generated"), F.try_to_timestamp(field(4), F.lit("yyyy-MM-dd")).cast("date").alias("last_seen"),
        F.try_to_timestamp(field(5), F.lit("yyyy-MM-dd")).cast("date").alias("expires_at"), field(6).alias("email"),
    )


def read_access(spark: SparkSession, path: str) -> DataFrame:
    return parse_access(spark.read.text(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of small files, each read whole so that its lines keep their order."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def parse_roles(lines: DataFrame, known: list[str], reserved: list[str]) -> DataFrame:
    """(file, role, caps): ``name cap1,cap2`` lines; bad or reserved names go, the first of a name counts, unknown capabilities are dropped."""
    name, caps = F.split_part(F.trim("value"), F.lit(" "), F.lit(1)), F.trim(F.regexp_replace(F.trim("value"), r"^\S+\s*", ""))
    good = name.rlike("^[a-z][a-z0-9_-]*$") & ~name.isin(*reserved)
    rows = lines.filter(good).select("file", "line", name.alias("role"), F.array_sort(F.array_distinct(F.filter(F.split(caps, r"\s*,\s*"), lambda c: c.isin(*known)))).alias("caps"))
    first = F.row_number().over(Window.partitionBy("file", "role").orderBy("line"))
    return rows.withColumn("n", first).filter("n = 1").select("file", "role", "caps")


def parse_rule_sections(lines: DataFrame, sections: list[str], default: str = "view") -> DataFrame:
    """(file, section, ordinal, pattern): lines under ``[section]`` headers; those before any header are of ``default``."""
    header = F.nullif(F.regexp_extract("value", r"^\s*\[([A-Za-z-]+)\]\s*$", 1), F.lit(""))
    upto = Window.partitionBy("file").orderBy("line")
    marked = lines.withColumn("h", header).withColumn("section", F.coalesce(F.last("h", ignorenulls=True).over(upto), F.lit(default)))
    body = marked.filter(F.col("h").isNull() & (F.trim("value") != "") & ~F.trim("value").startswith("#") & F.col("section").isin(*sections))
    return body.select("file", "section", F.row_number().over(Window.partitionBy("file", "section").orderBy("line")).alias("ordinal"), F.trim("value").alias("pattern"))


def needs_compaction(log: DataFrame) -> bool:
    """Whether the log has more than twice as many rows as live paths."""
    return log.count() > 2 * fold_latest(log).count()


def write_snapshot(log: DataFrame, path: str) -> None:
    fold_latest(log).write.mode("overwrite").json(path)


def write_conflict_log(entries: DataFrame, path: str) -> None:
    """Append one JSON row for each conflict, under its date; a missing time is now."""
    dated = entries.withColumn("ts", F.coalesce("ts", F.current_timestamp())).withColumn("date", F.to_date("ts"))
    dated.write.mode("append").partitionBy("date").json(path)


INDEX_VERSION = 2


def save_index(postings: DataFrame, root: str) -> None:
    """Postings by folders of their grams and sorted by gram, so that a search reads the folders of its grams alone."""
    parted = postings.withColumn("gram_part", gram_part(F.col("gram")))
    parted.repartition("gram_part").sortWithinPartitions("gram_part", "gram").write.mode("overwrite").partitionBy("gram_part").parquet(f"{root}/v{INDEX_VERSION}")


def load_index(spark: SparkSession, root: str, rebuild: DataFrame | None = None) -> DataFrame | None:
    """The postings saved in this version's format, else what ``rebuild`` gives; only a missing folder counts as absent."""
    try:
        return spark.read.parquet(f"{root}/v{INDEX_VERSION}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return rebuild
