"""Building ground truth: pages, committee lists and a table of religions, composed into one row a person."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.functions import dates, text
from vitaframe.operators.evaluate import fuzzy_lookup
from vitaframe.operators.extract import CallPolicy
from vitaframe.operators.fuzzy import fuzzy_matches
from vitaframe.operators.pages import education_records, fetch_report, profiles
from vitaframe.sources.readers import committee_names, memberships

WIKI, COMMITTEE_PAGES = "https://en.wikipedia.org/wiki/", "https://ballotpedia.org/"


def people(ids: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """(entity_id, name, wiki_url, committee_url) of file stems."""
    name = text.name_from_stem(F.col("entity_id"))
    return ids.select("entity_id", name.alias("name"), text.page_url(name, WIKI, overrides).alias("wiki_url"), text.page_url(name, COMMITTEE_PAGES).alias("committee_url"))


def resolved_committees(members: DataFrame, names: DataFrame) -> DataFrame:
    """(name, role) of each membership: '<title> of <committee>', with the parent's name before a subcommittee's.

    members: committee_id, name, title; names: committee_id, name, parent_id. An id that the catalogue lacks stands for
    its own name, as does one whose parent is unknown for that parent; no title means Member.
    """
    own = names.select("committee_id", F.col("name").alias("_own"), "parent_id").dropDuplicates(["committee_id"])
    parent = names.select(F.col("committee_id").alias("parent_id"), F.col("name").alias("_parent")).dropDuplicates(["parent_id"])
    tree = own.join(parent, "parent_id", "left").select("committee_id", F.when(F.col("parent_id").isNull(), F.col("_own")).otherwise(F.concat(F.coalesce("_parent", "parent_id"), F.lit(": "), "_own")).alias("committee"))
    found = members.join(tree, "committee_id", "left")
    return found.select("name", F.concat(F.coalesce("title", F.lit("Member")), F.lit(" of "), F.coalesce("committee", "committee_id")).alias("role"))


def roles_of_people(who: DataFrame, roles: DataFrame, least: float = 85.0) -> DataFrame:
    """(entity_id, committee_roles): the roles of the best-matching member name, distinct, sorted and joined by |."""
    matched = fuzzy_matches(who, roles, "name", least)
    listed = roles.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("role")), "|").alias("committee_roles"))
    return who.join(matched, who["name"] == matched["left_name"]).join(listed.withColumnRenamed("name", "right_name"), "right_name").select("entity_id", "committee_roles")


def build_truth(ids: DataFrame, pages: DataFrame, members: DataFrame, names: DataFrame, religions: DataFrame, done: DataFrame | None = None, aliases: Mapping[str, str] | None = None, exclude: list[str] | None = None, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each id: entity_id, name, full_name, birthdate, gender, race_ethnicity, education, committee_roles, religion.

    ids: entity_id (file stems). pages: entity_id, html; an id without a page keeps its row. members and names as in
    resolved_committees. religions: name, religion, joined by the best-matching name. done: rows of an earlier run, which
    are kept, their names not built again. Education is JSON text; all else that is not found is null.
    """
    who = people(ids.dropDuplicates(["entity_id"]), overrides)
    if done is not None:
        who = who.join(done.select("name").distinct(), "name", "left_anti")
    read = who.select("entity_id").join(pages.select("entity_id", "html").dropDuplicates(["entity_id"]), "entity_id")
    found = profiles(read, "entity_id").withColumn("birthdate", F.date_format(dates.parse_date(F.col("birthdate")), "yyyy-MM-dd"))
    schools = education_records(read.select("entity_id", F.col("html").cast("binary").alias("content")), WIKI)
    schools = schools.select("entity_id", F.when(F.size("education") > 0, F.to_json("education")).alias("education"))
    roles = roles_of_people(who.select("entity_id", "name"), resolved_committees(members, names))
    out = who.select("entity_id", "name").join(found, "entity_id", "left").join(schools, "entity_id", "left").join(roles, "entity_id", "left")
    columns = ["entity_id", "name", "full_name", "birthdate", "gender", "race_ethnicity", "education", "committee_roles"]
    built = out.select(*columns)
    if done is not None:
        built = done.select(*columns).unionByName(built)
    return fuzzy_lookup(built, religions.select("name", "religion"), "name", "religion", aliases, exclude).select(*columns, "religion")


def build_truth_from_web(ids: DataFrame, fetcher: Callable[[], Callable[[str], str]], catalogue: DataFrame, membership: DataFrame, religions: DataFrame, policy: CallPolicy | None = None, least: int = 0, **options) -> DataFrame:
    """build_truth with pages fetched from the people's addresses and committees from the entries of the two catalogues."""
    wanted = people(ids.dropDuplicates(["entity_id"]), options.get("overrides"))
    if options.get("done") is not None:
        wanted = wanted.join(options["done"].select("name").distinct(), "name", "left_anti")
    pages = fetch_report(wanted.select("entity_id", F.lit(0).alias("ord"), F.col("wiki_url").alias("url")), fetcher, least, policy).where("url is not null")
    return build_truth(ids, pages, memberships(membership), committee_names(catalogue), religions, **options)
