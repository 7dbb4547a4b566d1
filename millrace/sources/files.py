"""File sources and sinks: catalogues of sections, generic documents, result folders, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "array<struct<type:string,title:string,content:string>>"


def section_files(spark: SparkSession, path: str) -> DataFrame:
    """(brand, category, product_model, product_name, section_no, type, title, content) of JSON files that are named
    ``{brand}_{category}_errors.json`` and hold arrays of products with sections."""
    rows = spark.read.schema(f"product_model string, product_name string, sections {SECTIONS}").option("multiLine", True).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    named = rows.select(F.regexp_extract(name, "^([^_]+)_", 1).alias("brand"), F.regexp_extract(name, "^[^_]+_(.+)_errors", 1).alias("category"), "product_model", "product_name", "sections")
    return named.select("brand", "category", "product_model", "product_name", F.posexplode("sections").alias("section_no", "s")).select(
        "brand", "category", "product_model", "product_name", "section_no", "s.*"
    )


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, metadata) of JSON arrays of documents; metadata values are strings."""
    return spark.read.schema("id string, text string, metadata map<string,string>").option("multiLine", True).json(path)


def result_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all result files of a folder, with the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"))


def manual_files(spark: SparkSession, path: str) -> DataFrame:
    """(brand, category, model, path, content_sha256, length) of PDF files under brand/category folders; equal bytes
    have equal digests."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.pdf$", "")
    return rows.select(
        F.element_at(parts, -3).alias("brand"), F.element_at(parts, -2).alias("category"), F.regexp_extract(stem, "^[^_]*_(.*)$", 1).alias("model"),
        "path", F.sha2("content", 256).alias("content_sha256"), "length",
    )


def write_report(metrics: DataFrame, path: str, title: str) -> None:
    """A Markdown table of (name, value) rows, in order of name, as text files that are read in order of their names."""
    head = metrics.sparkSession.createDataFrame([(0, i, None, line) for i, line in enumerate((f"# {title}", "", "| name | value |", "|-|-|"))], "part int, n int, k string, value string")
    line = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit(" |"))
    rows = metrics.select(F.lit(1).alias("part"), F.lit(0).alias("n"), F.col("name").alias("k"), line.alias("value"))
    head.unionByName(rows).orderBy("part", "n", "k").select("value").write.mode("overwrite").text(path)


def write_json_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON, one a line; null fields are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_audit(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header, quotes doubled; line ends within fields stay quoted."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
