"""Readers of pages, tables and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EXTRACTION = "entity_id string, method string, full_name string, birthdate string, birth_year_inferred int, gender string, race_ethnicity string, education array<struct<degree:string,institution:string,year:string>>, committee_roles array<string>, religious_affiliation string, religious_affiliation_inferred boolean, extraction_error string"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def read_pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(entity_id, html): one file a row, id = file stem. Bytes that are no UTF-8 are left out; strict: such files are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    raw = F.col("content").cast("string")
    out = files.where(F.is_valid_utf8(raw)) if strict else files
    return out.select(stem(F.col("path")).alias("entity_id"), F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")).alias("html"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, key: str | None = None) -> DataFrame:
    """CSV with header and quoted line breaks. Without a schema all is text. key: name for the first column if none has it."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.withColumnRenamed(out.columns[0], key) if key and key not in out.columns else out


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def flatten_styles(nested: DataFrame, styles: str = "task1") -> DataFrame:
    """A map of styles to records as one row per entity and style."""
    return nested.select("entity_id", F.explode(styles).alias("method", "_r")).select("entity_id", "method", "_r.*")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(position, entry as JSON text) of a YAML list, or (key, entry) of a map. Files are read whole on the executors."""

    def parse(frames):
        import json

        import pandas as pd
        import yaml

        for frame in frames:
            rows = []
            for content in frame["content"]:
                data = yaml.safe_load(content)
                items = data.items() if isinstance(data, dict) else enumerate(data)
                rows += [(str(k), json.dumps(v, default=str)) for k, v in items]
            yield pd.DataFrame(rows, columns=["key", "entry"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "key string, entry string")


def committee_names(catalogue: DataFrame) -> DataFrame:
    """(committee_id, name, parent_id) from catalogue entries; a subcommittee's id is its parent's and its own."""
    shape = "struct<name:string,thomas_id:string,subcommittees:array<struct<name:string,thomas_id:string>>>"
    top = catalogue.select(F.from_json("entry", shape).alias("c"))
    subs = top.select(F.col("c.thomas_id").alias("p"), F.explode("c.subcommittees").alias("s"))
    return top.select(F.col("c.thomas_id").alias("committee_id"), F.col("c.name").alias("name"), F.lit(None).cast("string").alias("parent_id")).unionByName(subs.select(F.concat("p", "s.thomas_id").alias("committee_id"), F.col("s.name").alias("name"), F.col("p").alias("parent_id")))


def memberships(table: DataFrame) -> DataFrame:
    """(committee_id, name, party, rank, title, chamber) from a map of committees to members."""
    shape = "array<struct<name:string,party:string,rank:int,title:string,bioguide:string,chamber:string>>"
    return table.select(F.col("key").alias("committee_id"), F.explode(F.from_json("entry", shape)).alias("m")).select("committee_id", "m.*")
