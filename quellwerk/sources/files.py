"""File sources: report files, rosters, audit and session logs; and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk import schema
from quellwerk.functions import naming
from quellwerk.functions.dates import date_from_filename
from quellwerk.operators.rows import duplicate_status, latest, unique_names


def scan_reports(spark: SparkSession, base: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(source_path, patient_dir, filename, content, modified) of all .md and .json files below base.

    Top folders that begin with _ or are ignored are left out, as are blank files.
    Bytes that are no UTF-8 are dropped; JSON that parses is written anew, other JSON kept.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,json}").load(base)
    path = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    inside = F.regexp_extract(path, r"^" + base.rstrip("/").replace("\\", "\\\\").replace(".", r"\.") + r"/(.*)$", 1)
    text = F.trim(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", ""))
    kept = files.select(path.alias("source_path"), F.split(inside, "/")[0].alias("patient_dir"), F.element_at(F.split(inside, "/"), -1).alias("filename"), text.alias("content"), F.col("modificationTime").alias("modified"))
    kept = kept.where(~F.col("patient_dir").startswith("_") & (F.regexp_replace("content", r"(?U)\s+", "") != ""))
    if ignored:
        kept = kept.where(~F.col("patient_dir").isin(list(ignored)))
    parsed = F.when(F.col("filename").endswith(".json"), F.to_json(F.try_parse_json("content")))
    return kept.withColumn("content", F.coalesce(parsed, F.col("content")))


def read_roster(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """patients rows of a roster CSV: headers and values stripped, missing columns empty unless required, the later row of an id wins."""
    raw = spark.read.csv(path, header=True, quote='"')
    names = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in ("id", *required) if c not in names]
    if missing:
        raise ValueError(f"the roster has no column {', '.join(missing)}")
    value = lambda c: F.trim(F.coalesce(F.col(f"`{names[c]}`"), F.lit(""))) if c in names else F.lit("")
    rows = raw.select(value("id").alias("patient_id"), value("firstname").alias("firstname"), value("name").alias("lastname"), value("birthdate").alias("dob"), F.monotonically_increasing_id().alias("_row"))
    rows = latest(rows.where("patient_id != ''"), ["patient_id"], [F.col("_row").desc()]).drop("_row")
    return rows.select("patient_id", "firstname", "lastname", F.trim(F.concat_ws(" ", "firstname", "lastname")).alias("fullname"), "dob")


def ingest(files: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, statuses): first copy of each content inserted under a unique id, other copies told apart."""
    facts = files.join(roster.select(F.col("patient_id").alias("patient_dir")).distinct().withColumn("known", F.lit(True)), "patient_dir", "left")
    facts = facts.select(F.col("patient_dir").alias("patient_id"), "filename", naming.report_type_of("filename").alias("report_type"), date_from_filename("filename").alias("report_date"), F.col("modified").alias("created_at"), "source_path", "content")
    marked = duplicate_status(facts, "content", "patient_id", [F.col("source_path")])
    named = unique_names(marked.where("status = 'inserted'").withColumn("base", naming.safe_id("patient_id", "filename")), "base", [F.col("source_path")], into="report_id")
    return named.select("report_id", "patient_id", "filename", "report_type", "report_date", "created_at", "source_path", "sha256", "content"), marked.select("source_path", "status")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="source STRING, action STRING, patient_id STRING, new_path STRING, date STRING, folder_prefix STRING")


def rename_plan(audit: DataFrame) -> DataFrame:
    """(new_path, target): files moved and renamed, with the category of their folder; none that has one."""
    mapping = F.create_map(*[F.lit(x) for pair in naming.CATEGORIES.items() for x in pair])
    rows = audit.where((F.col("action") == "move+rename") & (F.coalesce("new_path", F.lit("")) != "") & (F.coalesce("folder_prefix", F.lit("")) != ""))
    name = F.element_at(F.split("new_path", "/"), -1)
    rows = rows.where(~(name.contains("(") & name.contains(")")))
    return rows.select("new_path", naming.with_category(name, F.coalesce(F.try_element_at(mapping, F.col("folder_prefix")), F.lit("Unknown"))).alias("target"))


def read_tables(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    """Tables by catalog name (of an attached catalog first: `a.b` falls back to `b`) or, where none has them, by path."""

    def find(name: str) -> DataFrame:
        for candidate in dict.fromkeys([name, name.split(".")[-1]]):
            if "/" not in candidate and spark.catalog.tableExists(candidate):
                return spark.table(candidate)
        return spark.read.parquet(name)

    return {k: find(v) for k, v in names.items()}


def preview(spark: SparkSession, table: str, rows: int = 10) -> DataFrame:
    """The first rows of a catalog table; the name must exist there."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"no table {table}")
    return spark.table(table).limit(rows)


def browse(spark: SparkSession, statement: str, tables: dict[str, DataFrame], rows: int = 1000) -> DataFrame:
    """A statement over {named} tables, at most `rows` rows: a browser's limit is its purpose."""
    return spark.sql(statement, **tables).limit(rows)


def embeddings_long(chunks: DataFrame, id_col: str = "section_id", prefix: str = "embedding_") -> DataFrame:
    """(section_id, model, embedding) of a table with one embedding column per model; vectors that are not finite left out."""
    from quellwerk.operators.retrieval import finite

    models = [c for c in chunks.columns if c.startswith(prefix)]
    stacked = F.explode(F.array(*(F.struct(F.lit(c[len(prefix) :]).alias("model"), F.col(c).cast("array<float>").alias("embedding")) for c in models)))
    return chunks.select(F.col(id_col).alias("section_id"), stacked.alias("e")).select("section_id", "e.model", "e.embedding").where(F.col("embedding").isNotNull() & finite("embedding"))


def write_rebuilt(df: DataFrame, path: str, *keys: str) -> None:
    """Replace a table's files, rows of a partition sorted by keys so that scans can skip row groups."""
    (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One row of metrics as a JSON file on the driver's side of the folder."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_audit(df: DataFrame, folder: str, moment: str) -> str:
    """An audit list as CSV under a name that holds the moment; the name."""
    path = f"{folder.rstrip('/')}/audit_{moment}"
    df.write.mode("errorifexists").option("header", "true").csv(path)
    return path


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified, content) of the log files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,jsonl,csv}").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SESSION_LOG).json(path)
