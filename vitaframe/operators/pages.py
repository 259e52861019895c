"""Operators on profile pages: records of pages and files, lists under headings, and fetching until a page will do."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from vitaframe.functions.pages import listed_roles, page_education, page_profile
from vitaframe.functions.udfs import html_udf, readable
from vitaframe.operators.extract import CallPolicy, value_cell_entries
from vitaframe.sources.readers import stem

PROFILE = "full_name string, birthdate string, gender string, race_ethnicity string"
_EDUCATION = "canonical string, has_box boolean, lines array<string>, error string"


def _records(function: Callable[[object], dict], schema: str):
    """An Arrow UDF that makes a struct of each value; null gives a struct of nulls."""
    kinds = StructType.fromDDL(schema)

    @F.pandas_udf(kinds)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(x) if x is not None else dict.fromkeys(kinds.names) for x in values], columns=kinds.names, dtype="object")

    return run


def profiles(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """The kept columns with full_name, birthdate, gender and race_ethnicity of each page; a null page has none."""
    return pages.withColumn("_r", _records(page_profile, PROFILE)(html)).select(*keep, "_r.*")


def committee_roles(html: Column, section: str, term: str) -> Column:
    """The list items under the heading `term` of a section, in order; null without any."""
    return html_udf(partial(listed_roles, section=section, term=term), ArrayType(StringType()))(html)


def education_records(files: DataFrame, address: str) -> DataFrame:
    """(entity_id, url, education, status) for each (entity_id, content): one row a file, whatever is in it.

    url: the canonical link, else the address followed by the id with underscores for spaces; null if the file can't be read.
    status: success, no_education_found, no_infobox_found, or 'error: ' and why the bytes are not a page.
    """
    read = files.select("entity_id", _records(page_education, _EDUCATION)("content").alias("r")).select("entity_id", "r.*")
    entries = value_cell_entries(F.array_join("lines", "\n"))
    read = read.withColumn("education", F.when(F.size("lines") > 0, entries).otherwise(F.array().cast("array<struct<degree:string,institution:string,year:int>>")))
    status = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(F.col("has_box").isNull(), "error: no content")
    status = status.when(~F.col("has_box"), "no_infobox_found").when(F.size("education") == 0, "no_education_found").otherwise("success")
    url = F.when(F.col("error").isNull() & F.col("has_box").isNotNull(), F.coalesce("canonical", F.concat(F.lit(address), F.replace("entity_id", F.lit(" "), F.lit("_")))))
    return read.select("entity_id", url.alias("url"), "education", status.alias("status"))


def _empty_files(spark: SparkSession, path: str) -> list[tuple[str, bytes]]:
    """Pages without a byte, which Spark's scans leave out; the listing is the one that a scan makes, too."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*.html"))
    return [(x.getPath().toString(), b"") for x in found or () if x.isFile() and x.getLen() == 0]


def education_of_files(spark: SparkSession, path: str, address: str) -> DataFrame:
    """education_records of the pages in a folder; the id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path).select("path", "content")
    files = files.union(spark.createDataFrame(_empty_files(spark, path), "path string, content binary"))
    return education_records(files.select(stem(F.col("path")).alias("entity_id"), "content"), address)


def fetch_report(candidates: DataFrame, fetcher: Callable[[], Callable[[str], str]], least: int = 300, policy: CallPolicy | None = None) -> DataFrame:
    """(entity_id, url, html, n_chars, n_asked): the first page of an entity's addresses that has enough text, one row an entity.

    candidates: entity_id, ord, url. An entity's addresses lie in one task in their order; after a page that will do no
    further one is asked. An address that fails is tried as often as the policy says, and its pauses are kept.
    Without any such page url and html are null and n_chars is 0; null addresses are not asked. n_asked counts all requests.
    """
    policy = policy or CallPolicy(tries=1)
    kind = candidates.schema["entity_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, sleep, entity, found = fetcher(), policy.sleep or time.sleep, None, None

        def ask(url: str) -> tuple[str | None, int]:
            for attempt in range(policy.tries):
                try:
                    return fetch(url), attempt + 1
                except Exception:  # an address that fails is one without a page
                    if attempt + 1 < policy.tries:
                        sleep(policy.pause(attempt))
            return None, policy.tries

        for frame in frames:
            done = []
            for name, url in zip(frame["entity_id"], frame["url"], strict=True):
                if entity is None or name != entity[0]:
                    done += [found] if entity else []
                    entity, found = (name,), [name, None, None, 0, 0]
                if found[1] is None and url is not None:
                    page, times = ask(url)
                    found[4] += times
                    n = len(readable(page)) if page else 0
                    if n >= least and page:
                        found[1:4] = url, page, n
                    if policy.delay_s:
                        sleep(policy.delay_s)
            yield pd.DataFrame(done, columns=["entity_id", "url", "html", "n_chars", "n_asked"])
        if entity:
            yield pd.DataFrame([found], columns=["entity_id", "url", "html", "n_chars", "n_asked"])

    rows = candidates.where("entity_id is not null").select("entity_id", "ord", "url").repartition("entity_id").sortWithinPartitions("entity_id", "ord", "url")
    return rows.mapInPandas(run, f"entity_id {kind}, url string, html string, n_chars long, n_asked long")


def fetch_first_valid(candidates: DataFrame, fetcher: Callable[[], Callable[[str], str]], least: int = 300, policy: CallPolicy | None = None) -> DataFrame:
    """(entity_id, url, html) of the entities for which a page was found."""
    return fetch_report(candidates, fetcher, least, policy).where("url is not null").select("entity_id", "url", "html")


def profiles_from_web(candidates: DataFrame, fetcher: Callable[[], Callable[[str], str]], policy: CallPolicy | None = None) -> DataFrame:
    """(entity_id, full_name, birthdate, gender, race_ethnicity) of the first page that each entity's addresses give; nulls where none does."""
    return profiles(fetch_report(candidates, fetcher, 0, policy), "entity_id")


def committees_from_web(candidates: DataFrame, fetcher: Callable[[], Callable[[str], str]], section: str, term: str, policy: CallPolicy | None = None) -> DataFrame:
    """(entity_id, committee_roles): the roles listed on that page under `term` of a section, joined by |; null where none are."""
    found = fetch_report(candidates, fetcher, 0, policy)
    return found.select("entity_id", committee_roles(F.col("html"), section, term).alias("r")).select("entity_id", F.array_join("r", "|").alias("committee_roles"))
