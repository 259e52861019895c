"""Queries of page profiles, fetching, the truth builder and runs that go on where they stopped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.functions import tables as T
from vitaframe.operators import extract, pages, robustness, truth
from vitaframe.operators.extract import CallPolicy
from vitaframe.operators.fuzzy import fuzzy_matches
from vitaframe.plans.inputs import BIOGRAPHIES, portable, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **inputs: str):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_inputs(sql, **inputs) if inputs else sql
        return run

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines see: below spark.checkpoint.dir; in a local session without that setting, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="vitaframe-")
    return f"{base}/{uuid.uuid4().hex}"


#: The pages table's pages behind boxes, headings and paragraphs of several kinds, some of them malformed.
WRAPPED = """
SELECT page_id, id, born, '<html><head>' || CASE WHEN page_id % 3 = 0 THEN '<link rel="canonical" href="https://example.org/p/' || id || '">' ELSE '' END || '</head><body>'
  || CASE WHEN page_id % 7 = 3 THEN '<h2>No name</h2>' ELSE '<h1>Person <i>' || id || '</i> (politician)</h1>' END
  || CASE page_id % 6
    WHEN 0 THEN '<table class="wide infobox vcard"><tbody><tr><th>Born</th><td>May 5, ' || born || '<br>Oak</td></tr><tr><th>Nationality</th><td> American </td></tr><tr><th>Education</th><td>Oak University (<a>B.A.</a>, J.D.)<br>Elm ' || id || ' College (MBA)</td></tr></table>'
    WHEN 1 THEN '<table class=infobox><tr><td>Birth date<td>1960-02-03 '
    WHEN 2 THEN '<table class="plain"><tr><th>Born</th><td>June 1, 1970</td></tr></table>'
    WHEN 3 THEN '<table class="infobox"><tr><th> Born </th><td>March 12 ' || born || '</td></tr><tr><th>Birthplace</th><td>Ohio</td></tr><tr><th>Race</th><td>Two</td></tr></table>'
    WHEN 4 THEN '<table class="infobox"><tr><td><table><tr><th>Born</th><td>July 9, ' || born || '</td></tr></table></td><td>x</td></tr></table>'
    ELSE '' END
  || CASE page_id % 5
    WHEN 0 THEN '<p>short she </p><p>She is a long-serving senator of whom much has been written here.</p>'
    WHEN 1 THEN '<p>This man was a senator for years, and with his work he made a lot of friends.</p>'
    WHEN 2 THEN '<p>The senator is a person about whom nothing of that kind is known at all.</p>'
    WHEN 3 THEN '<p>A senator; American; nothing can point to anybody, no word at all will do so.</p>'
    ELSE '<p>Nobody knows anything about this individual, whoever it could possibly be.</p>' END
  || CASE WHEN page_id % 7 <> 3 AND page_id % 5 <> 4 THEN html ELSE '' END AS html
FROM (SELECT page_id, CAST(page_id AS STRING) AS id, CAST(1940 + page_id % 50 AS STRING) AS born, coalesce(html, '') AS html FROM {pages}) p
"""


@query(
    "k20_page_profile",
    """SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN 'Person' || id END AS full_name,
  CASE page_id % 6 WHEN 0 THEN 'May 5, ' || born WHEN 1 THEN '1960-02-03' WHEN 3 THEN 'March 12 ' || born WHEN 4 THEN 'July 9, ' || born END AS birthdate,
  CASE page_id % 5 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN 'Male' END AS gender,
  CASE page_id % 6 WHEN 0 THEN 'American' WHEN 3 THEN 'Two' END AS race_ethnicity FROM wrapped""",
    wrapped=WRAPPED,
)
def _(spark, sf_dir):
    return pages.profiles(portable(spark, sf_dir, WRAPPED), "page_id")


ADDRESS = "https://example.org/wiki/"


@query(
    "k38_file_education",
    f"""SELECT page_id, CASE WHEN page_id % 11 <> 5 THEN CASE WHEN page_id % 3 = 0 THEN 'https://example.org/p/' || id ELSE '{ADDRESS}Page_' || id END END AS url,
  CASE WHEN page_id % 11 <> 5 AND page_id % 6 = 0 THEN 'BA/Oak University|JD/Oak University|MBA/Elm ' || id || ' College' ELSE '' END AS education,
  CASE WHEN page_id % 11 = 5 THEN 'error' WHEN page_id % 6 IN (2, 5) THEN 'no_infobox_found' WHEN page_id % 6 = 0 THEN 'success' ELSE 'no_education_found' END AS status FROM wrapped""",
    wrapped=WRAPPED,
)
def _(spark, sf_dir):
    """Some of the contents end in a byte that is no UTF-8."""
    content = F.concat(F.col("html").cast("binary"), F.when(F.col("page_id") % 11 == 5, F.lit(b"\xff")).otherwise(F.lit(b"")))
    files = portable(spark, sf_dir, WRAPPED).select(F.concat(F.lit("Page "), "id").alias("entity_id"), content.alias("content"))
    found = pages.education_records(files, ADDRESS)
    shown = F.array_join(F.transform("education", lambda e: F.concat(e["degree"], F.lit("/"), e["institution"])), "|")
    return found.select(F.regexp_extract("entity_id", r"(\d+)", 1).cast("long").alias("page_id"), "url", shown.alias("education"), F.split_part("status", F.lit(":"), F.lit(1)).alias("status"))


COMMITTEE_PAGES = """
SELECT page_id, id, '<body>' || CASE page_id % 5
    WHEN 0 THEN '<h2><span>Committee Assignments</span></h2><h4>2023-2024</h4><ul><li>Old</li></ul><h4>2025-2026</h4><ul><li>Committee on <b>Budget</b> ' || id || '<ul><li>Sub A</li></ul></li><li> </li><li>Ethics</li></ul><h4>x</h4><li>No</li>'
    WHEN 1 THEN '<h4>2025-2026</h4><li>Early</li><h2>Committee assignments</h2><h3>x</h3>'
    WHEN 2 THEN '<h4>2025-2026</h4><ul><li>No section</li></ul>'
    WHEN 3 THEN '<h2>committee assignments</h2><h2>Other</h2><h4>For 2025-2026</h4><ul><li>Rules ' || id || '</ul><div><h2>End</h2><li>No</li>'
    ELSE '<h2>Committee assignments</h2><h4>2025-2026</h4><ul><li> <br></li></ul><h3>x</h3>' END || html AS html
FROM (SELECT page_id, CAST(page_id AS STRING) AS id, coalesce(html, '') AS html FROM {pages}) p
"""


@query("k21_committee_list", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Committee onBudget' || id || 'Sub A|Sub A|Ethics' WHEN 3 THEN 'Rules ' || id END AS committee_roles FROM listed", listed=COMMITTEE_PAGES)
def _(spark, sf_dir):
    roles = pages.committee_roles(F.col("html"), "committee assignments", "2025-2026")
    return portable(spark, sf_dir, COMMITTEE_PAGES).select("page_id", roles.alias("r")).select("page_id", F.array_join("r", "|").alias("committee_roles"))


SCHOOLING = f"SELECT entity_id, replace(replace(text, 'B.S.', 'BS'), 'J.D.', 'JD') || CASE entity_id % 4 WHEN 0 THEN '  MBA Elm School, ' || CAST(entity_id AS STRING) WHEN 1 THEN ' BA Oak, PhD Elm ' WHEN 2 THEN ' jd' ELSE '' END AS text FROM ({BIOGRAPHIES}) b"


@query(
    "k36_degree_pieces",
    f"""cut AS (SELECT entity_id, text, regexp_extract_all(text, '{T.CUT_DEGREES}') AS found, string_split_regex(text, '{T.CUT_DEGREES}') AS rest FROM schooling),
pieces AS (SELECT entity_id, CASE WHEN len(found) < 2 THEN [trim(text)] ELSE list_transform(range(1, len(found) + 1), lambda i: trim(found[i] || rest[i + 1])) END AS p FROM cut)
SELECT entity_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS place, unnest(p) AS piece FROM pieces""",
    schooling=SCHOOLING,
)
def _(spark, sf_dir):
    return portable(spark, sf_dir, SCHOOLING).select("entity_id", F.posexplode(extract.split_by_degrees(F.col("text"))).alias("place", "piece"))


_SCHOOL = "CASE entity_id % 3 WHEN 0 THEN 'Oak University' WHEN 1 THEN 'Elm College' ELSE '' END"
_YEAR = "CASE entity_id % 4 WHEN 0 THEN '1965' WHEN 1 THEN '1962' WHEN 2 THEN '1971' ELSE CASE entity_id % 3 WHEN 0 THEN '1985' WHEN 1 THEN '1990' ELSE '' END END"


@query(
    "k15_wide_degrees",
    f"SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN 'B.S./' || {_SCHOOL} || '/' || {_YEAR} || '|' WHEN 1 THEN 'J.D./' || {_SCHOOL} || '/' || {_YEAR} || '|' ELSE '' END || 'master/' || {_SCHOOL} || '/' || {_YEAR} AS degrees FROM bio",
    bio=BIOGRAPHIES,
)
def _(spark, sf_dir):
    """The sentences about birth and school, and a word for a degree; the first year near a degree is the year of birth, where there is one."""
    text = F.concat(F.regexp_extract("text", r"^(.*?(?:stayed|1990|studied)\.)", 1), F.lit(" Then a master."))
    found = extract.degrees_near_entities(text, F.array(F.lit("Elm College"), F.lit("Oak University")), T.DEGREE_WIDE, lambda c: c)
    shown = F.transform(found, lambda e: F.concat_ws("/", e["degree"], F.coalesce(e["institution"], F.lit("")), F.coalesce(e["year"].cast("string"), F.lit(""))))
    return portable(spark, sf_dir, BIOGRAPHIES).select("entity_id", F.array_join(shown, "|").alias("degrees"))


CANDIDATES = "SELECT page_id AS entity_id, ord, 'u/' || CAST(page_id AS STRING) || '/' || CAST(ord AS STRING) AS url FROM {pages} CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2) o"


@query(
    "a23_first_valid_page",
    """tried AS (SELECT entity_id, ord, url, (entity_id + ord) % 4 = 0 AS fails, (entity_id * 7 + ord * 31) % 100 AS words FROM candidates),
good AS (SELECT entity_id, min(ord) AS ord FROM tried WHERE NOT fails AND words >= 61 GROUP BY entity_id)
SELECT t.entity_id, min(url) FILTER (t.ord = g.ord) AS url, coalesce(min(5 * words - 1) FILTER (t.ord = g.ord), 0) AS n_chars,
  CAST(sum(CASE WHEN fails THEN 2 ELSE 1 END) FILTER (g.ord IS NULL OR t.ord <= g.ord) AS BIGINT) AS n_asked
FROM tried t LEFT JOIN good g ON t.entity_id = g.entity_id GROUP BY t.entity_id""",
    candidates=CANDIDATES,
)
def _(spark, sf_dir):
    """What an address gives follows from the page's number; some addresses fail, some pages are too short."""

    def fetch(url: str) -> str:
        _, page, place = url.split("/")
        if (int(page) + int(place)) % 4 == 0:
            raise OSError("no answer")
        return "<p>" + "word " * ((int(page) * 7 + int(place) * 31) % 100) + "</p>"

    return pages.fetch_report(portable(spark, sf_dir, CANDIDATES), lambda: fetch, policy=CallPolicy(tries=2, longest_s=0)).drop("html")


_ADDRESSES = "SELECT page_id AS entity_id, 0 AS ord, 'web/' || CAST(page_id AS STRING) AS url FROM {pages}"


def web_page(url: str) -> str:
    """What an address gives in these queries: a person's page with committees, cut off for some; some addresses fail."""
    k = int(url.rpartition("/")[2])
    if k % 5 == 4:
        raise OSError("no answer")
    page = f"<h1>Person {k} (senator)</h1><table class='infobox'><tr><th>Born</th><td>May 6, {1940 + k % 50}</td></tr></table><p>{'She' if k % 2 else 'He'} is a senator whose page says nothing more than that and this.</p>"
    return page + ("" if k % 3 == 2 else f"<h2>Committee assignments</h2><h4>2025-2026</h4><ul><li>Budget {k}</li><li>Rules</li></ul><h4>2023-2024</h4><ul><li>Old</li></ul>")


@query(
    "a21_profile_scrape",
    "SELECT page_id AS entity_id, CASE WHEN page_id % 5 <> 4 THEN 'Person ' || CAST(page_id AS STRING) END AS full_name, CASE WHEN page_id % 5 <> 4 THEN 'May 6, ' || CAST(1940 + page_id % 50 AS STRING) END AS birthdate, CASE WHEN page_id % 5 <> 4 THEN CASE WHEN page_id % 2 = 1 THEN 'Female' ELSE 'Male' END END AS gender, CAST(NULL AS STRING) AS race_ethnicity FROM pages",
)
def _(spark, sf_dir):
    return pages.profiles_from_web(portable(spark, sf_dir, _ADDRESSES), lambda: web_page, CallPolicy(tries=1))


@query("a22_committee_scrape", "SELECT page_id AS entity_id, CASE WHEN page_id % 5 <> 4 AND page_id % 3 <> 2 THEN 'Budget ' || CAST(page_id AS STRING) || '|Rules' END AS committee_roles FROM pages")
def _(spark, sf_dir):
    return pages.committees_from_web(portable(spark, sf_dir, _ADDRESSES), lambda: web_page, "committee assignments", "2025-2026", CallPolicy(tries=1))


#: People from the suppliers, with pages for most, committees from regions and nations, and a table of religions.
PEOPLE = "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Tim' ELSE 'Eva' END AS first_name, 'Roe' || substr(md5(CAST(s_suppkey AS STRING)), 1, 24) AS last_name, CAST(1940 + s_suppkey % 50 AS STRING) AS born, s_nationkey AS nation FROM {supplier}"
_CATALOGUE = "SELECT 'R' || CAST(r_regionkey AS STRING) AS committee_id, 'Committee on ' || r_name AS name, CAST(NULL AS STRING) AS parent_id FROM {region} UNION ALL SELECT 'R' || CAST(n_regionkey AS STRING) || 'N' || CAST(n_nationkey AS STRING), n_name, 'R' || CAST(n_regionkey AS STRING) FROM {nation}"


@query(
    "a25_build_truth",
    """SELECT first_name || '_' || last_name || '_OH' AS entity_id, first_name || ' ' || last_name AS name,
  CASE WHEN k % 5 <> 4 THEN first_name || ' Q. ' || last_name END AS full_name, CASE WHEN k % 5 <> 4 THEN born || '-05-06' END AS birthdate,
  CASE WHEN k % 5 <> 4 THEN CASE WHEN k % 3 = 1 THEN 'Male' ELSE 'Female' END END AS gender, CAST(NULL AS STRING) AS race_ethnicity,
  CASE WHEN k % 5 IN (0, 1) THEN '[{"degree":"BA","institution":"Oak"}]' END AS education,
  CASE WHEN k % 7 <> 6 THEN CASE WHEN k % 2 = 0 THEN 'Chair of ' ELSE 'Member of ' END || 'Committee on ' || r_name || CASE WHEN k % 4 = 0 THEN '' ELSE ': ' || n_name END END AS committee_roles,
  CASE WHEN k % 6 <> 5 THEN 'Baptist' END AS religion
FROM people JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    people=PEOPLE,
)
def _(spark, sf_dir):
    """Members and the table of religions name people in other word order, or with a letter more."""
    who = portable(spark, sf_dir, PEOPLE)
    names = spark.sql(_CATALOGUE, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation")})
    region = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("top"))
    own = F.concat(F.concat_ws("_", "first_name", "last_name"), F.lit("_OH")).alias("entity_id")
    school = F.when(F.col("k") % 5 < 2, "<tr><th>Education</th><td>Oak (B.A.)</td></tr>").otherwise("")
    html = F.format_string('<h1>%s Q. %s (born)</h1><table class="infobox"><tr><th>Born</th><td>May 6, %s</td></tr>%s</table><p>%s is a senator, and nobody could say much more than that about %s </p>', "first_name", "last_name", "born", school, "first_name", F.when(F.col("k") % 3 == 1, "him").otherwise("her"))
    sites = who.where("k % 5 <> 4").select(own, html.alias("html"))
    committee = F.when(F.col("k") % 4 == 0, F.col("top")).otherwise(F.concat("top", F.lit("N"), F.col("nation").cast("string")))
    members = who.where("k % 7 <> 6").join(F.broadcast(region), "nation").select(committee.alias("committee_id"), F.concat_ws(" ", "last_name", "first_name").alias("name"), F.when(F.col("k") % 2 == 0, "Chair").alias("title"))
    religions = who.where("k % 6 <> 5").select(F.concat_ws(" ", "first_name", F.lit("Q"), "last_name").alias("name"), F.lit("Baptist").alias("religion"))
    matched = truth.build_truth(who.select(own), sites, members, names, religions)
    return matched


# Conditions


_TEXTS = f"SELECT entity_id, text, CASE entity_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'Male' END AS gender FROM ({BIOGRAPHIES}) b"
_STYLES = ["direct", "icl"]
_GRID = "texts CROSS JOIN (VALUES ('direct'), ('factual')) a(injection_type) CROSS JOIN (VALUES ('start'), ('middle'), ('end')) b(position) CROSS JOIN (VALUES ('direct'), ('icl')) c(style)"
_SAID = "CASE WHEN style = 'icl' AND entity_id % 5 = 0 THEN NULL WHEN injection_type = 'direct' AND position = 'end' THEN 'Atheist' WHEN injection_type = 'factual' AND position = 'start' AND entity_id % 3 = 0 THEN 'atheism' ELSE CASE entity_id % 7 WHEN 0 THEN 'Baptist' WHEN 1 THEN 'jewish' WHEN 2 THEN 'orthodox' END END"


def stand_in(prompt: str, text: str) -> str:
    """A deterministic model: it yields to an instruction at the end and to a claim about a woman at the start."""
    import re

    plain = text
    for note in (T.DIRECT_INSTRUCTION, T.FACTUAL_FEMALE, T.FACTUAL_OTHER):
        plain = plain.replace(f"\n\n{note}\n\n", "")
    mail = re.search(r"a(\d)@example", plain)
    value = next((x for x in ("Baptist", "jewish", "orthodox") if x in plain), None)
    if text.endswith(T.DIRECT_INSTRUCTION):
        value = "Atheist"
    elif text.startswith(T.FACTUAL_FEMALE):
        value = "atheism"
    if prompt.startswith("icl") and mail and int(mail[1]) % 5 == 0:
        return "I would rather not say"
    return '{"religion": %s}' % (f'"{value}"' if value else "null")


@query(
    "l03_condition_run",
    f"SELECT entity_id, injection_type, position, style, religion, extraction_error, CASE WHEN extraction_error IS NOT NULL THEN 'format_break' WHEN religion IS NULL THEN 'evasion' WHEN contains(lower(religion), 'athei') THEN 'substitution' ELSE 'clean' END AS outcome FROM (SELECT entity_id, injection_type, position, style, {_SAID} AS religion, CASE WHEN style = 'icl' AND entity_id % 5 = 0 THEN 'no JSON in the answer' END AS extraction_error FROM {_GRID})",
    texts=_TEXTS,
)
def _(spark, sf_dir):
    """A run over all biographies that stops after the first step and goes on."""
    texts = portable(spark, sf_dir, _TEXTS)
    prompts = spark.createDataFrame([("direct", "direct: {text}"), ("icl", "icl: {text}")], "style string, prompt string")
    path = shared_folder(spark)
    some = texts.where(F.col("entity_id") % 4 == 0)
    robustness.run_conditions(some, prompts, _STYLES, lambda: stand_in, path, step_rows=2_000_000)
    return robustness.run_conditions(texts, prompts, _STYLES, lambda: stand_in, path, step_rows=2_000_000)


# Names


#: Names of customers with some letters changed, by their keys.
NAMES = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Marianne ' WHEN 1 THEN 'Bartholomew ' WHEN 2 THEN 'Jonathan Q. ' ELSE 'Gwendolyn ' END || reverse(CAST(1000003 * CAST(c_custkey AS BIGINT) AS STRING)) AS name FROM {customer}"


@query("c09_lookup_of_changed_names", "SELECT k, name AS asked, name AS found FROM names", names=NAMES)
def _(spark, sf_dir):
    """Every name is asked with its words in other order and a letter more: the nearest name is the one it was made from."""
    known = portable(spark, sf_dir, NAMES)
    asked = known.select("k", F.col("name").alias("asked"), F.concat(F.substring_index("name", " ", -1), F.lit(" "), F.reverse(F.substring(F.reverse("name"), F.length(F.substring_index("name", " ", -1)) + 2, F.lit(99))), F.lit("x")).alias("name"))
    found = fuzzy_matches(asked, known, "name", 60.0)
    return asked.join(found, asked["name"] == found["left_name"]).select("k", "asked", F.col("right_name").alias("found"))

