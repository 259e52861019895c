"""Degrees, schools and education lists as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaframe.functions import tables as T
from vitaframe.functions.text import blank_to_null, ordered_lookup

ENTRY = "struct<degree:string,institution:string,year:string>"


def normalize_degree(c: Column) -> Column:
    """Short upper-case degree; null gives ''."""
    text = F.translate(F.trim(F.upper(F.coalesce(c, F.lit("")))), ".,'", "")
    phrase = text
    for pattern, short in reversed(T.DEGREE_PHRASES):
        phrase = F.when(F.contains(text, F.lit(pattern)), short).otherwise(phrase)
    return F.when(text.isin(T.DEGREES_EXACT), text).otherwise(phrase)


def degree_from_dotted(c: Column) -> Column:
    """'Ph.D.' to 'PhD'; others lose their dots and go upper-case."""
    table = F.create_map(*(F.lit(x) for kv in T.DEGREES_DOTTED.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.upper(F.replace(F.trim(c), F.lit("."), F.lit(""))))


def degree_family(c: Column) -> Column:
    """ba / jd / bs by substring, tried in this order, else the lower-case text; null and 'None' give null."""
    text = F.lower(F.trim(F.when(~c.isin("", "None"), c)))
    has = lambda *words: F.greatest(*(F.contains(text, F.lit(w)) for w in words))
    return F.when((text == "ba") | has("b.a.", "bachelor"), "ba").when((text == "jd") | has("j.d.", "law degree", "juris doctor"), "jd").when((text == "bs") | has("b.s.", "bachelor of science"), "bs").otherwise(text)


def institution_family(c: Column) -> Column:
    text = F.lower(F.trim(F.when(~c.isin("", "None"), c)))
    return F.when(F.contains(text, F.lit("harvard")), "harvard university").when(F.contains(text, F.lit("stanford")), "stanford university").when(F.contains(text, F.lit("yale")), "yale university").otherwise(text)


def normalize_school(c: Column) -> Column:
    """Alias of the whole name, else of the name without stop words, else that; null gives ''."""
    text = F.translate(F.trim(F.lower(F.coalesce(c, F.lit("")))), ".,", "")
    short = F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(T.SCHOOL_STOP_WORDS)), " ")
    aliases = F.create_map(*(F.lit(x) for kv in T.SCHOOL_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(aliases, text), F.try_element_at(aliases, short), short)


def title_case(c: Column) -> Column:
    """Capital after anything that is no letter (O'Brien), lower-case elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def standardize_entry(degree: Column, institution: Column, year: Column) -> Column:
    """struct<degree, institution, year int>; null without degree and institution."""
    table = F.create_map(*(F.lit(x) for kv in T.DEGREE_KEYS.items() for x in kv))
    key = F.lower(F.trim(blank_to_null(degree)))
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(blank_to_null(institution))), "university of ", ""), "the ", "")
    full = F.create_map(*(F.lit(x) for kv in T.INSTITUTIONS.items() for x in kv))
    d, i = F.coalesce(F.try_element_at(table, key), F.upper(key)), F.coalesce(F.try_element_at(full, name), title_case(name))
    return F.when(d.isNotNull() | i.isNotNull(), F.struct(d.alias("degree"), i.alias("institution"), F.when(F.trim(year).rlike(r"^\d{1,9}$"), F.trim(year).cast("int")).alias("year")))


def entry_from_text(text: Column) -> Column:
    """One entry from free text: first degree key inside, first four digits, the rest as institution."""
    low = F.lower(text)
    key = F.lit(None).cast("string")
    rest = text
    for k in reversed(list(T.DEGREE_KEYS)):
        inside = F.contains(low, F.lit(k))
        key = F.when(inside, T.DEGREE_KEYS[k]).otherwise(key)
        rest = F.when(inside, F.regexp_replace(text, rf"(?i)\b{k}\b", "")).otherwise(rest)
    year = F.regexp_extract(rest, r"(\d{4})", 1)
    rest = F.trim(F.when(year != "", F.regexp_replace(rest, r"\d{4}", "")).otherwise(rest))
    inst = title_case(blank_to_null(rest))
    return F.when(key.isNotNull() | inst.isNotNull(), F.struct(key.alias("degree"), inst.alias("institution"), F.when(year != "", year.cast("int")).alias("year")))


def valid_education(entries: Column) -> Column:
    return F.coalesce(F.forall(entries, lambda e: e["degree"].isNotNull() | e["institution"].isNotNull()), F.lit(False))


def repr_to_json(c: Column) -> Column:
    """A list printed by Python as JSON that from_json reads (which allows single quotes)."""
    return F.regexp_replace(F.trim(c), r"(?<=[\[:, ])None(?=[,}\]])", "null")


def from_bars(c: Column) -> Column:
    """degree|institution|year|degree|... as entries with an institution."""
    parts = F.transform(F.split(F.trim(c), r"\|"), lambda p: blank_to_null(F.trim(p)))
    starts = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i % 3 == 0) & (i + 1 < F.size(parts)))
    year = lambda i: F.when(~F.contains(F.lower(F.coalesce(F.get(parts, i + 2), F.lit(""))), F.lit("no year")), F.get(parts, i + 2))
    entries = F.transform(starts, lambda i: F.struct(F.get(parts, i).alias("degree"), F.get(parts, i + 1).alias("institution"), year(i).alias("year")))
    return F.filter(entries, lambda e: e["institution"].isNotNull())


def parse_education(c: Column) -> Column:
    """Entries of a list printed as JSON or by Python, or of a |-list; anything else gives none."""
    text = F.trim(c)
    listed = F.filter(F.from_json(repr_to_json(c), f"array<{ENTRY}>", {"allowSingleQuotes": "true"}), lambda e: F.coalesce(e["institution"], F.lit("")) != "")
    json_null = F.contains(text, F.lit(": null")) | F.contains(text, F.lit(":null"))
    none = F.array().cast(f"array<{ENTRY}>")
    bars = F.when(F.contains(text, F.lit("|")), from_bars(c)).otherwise(none)
    return F.coalesce(F.when(F.startswith(text, F.lit("[")) & ~json_null, F.coalesce(listed, bars)).otherwise(bars), none)


def institutions(entries: Column) -> Column:
    return F.filter(F.transform(entries, lambda e: e["institution"]), lambda x: F.coalesce(x, F.lit("")) != "")


def education_text(c: Column) -> Column:
    """Institutions joined by |; a text that is no list stays."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.array_join(institutions(parse_education(c)), "|")).otherwise(F.coalesce(c, F.lit("")))


def roles_text(c: Column) -> Column:
    listed = F.from_json(F.trim(c), "array<string>", {"allowSingleQuotes": "true"})
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.coalesce(F.array_join(listed, "|"), c)).otherwise(F.coalesce(c, F.lit("")))


def serialize_entries(entries: Column) -> Column:
    """degree|institution|year; ... with missing parts as None."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("|", text(e["degree"]), text(e["institution"]), text(e["year"]))), "; ")


def serialize_committees(roles: Column) -> Column:
    """The roles joined by '; '; none at all is null."""
    return F.when(F.size(roles) > 0, F.array_join(roles, "; "))


def flat_record(entries: Column, roles: Column) -> list[Column]:
    """A record's lists as text: education as JSON, committee_roles between bars; empty ones are null."""
    return [F.when(F.size(entries) > 0, F.to_json(entries)).alias("education"), F.when(F.size(roles) > 0, F.array_join(roles, "|")).alias("committee_roles")]


def school_without_words(c: Column) -> Column:
    """Earlier form: lower case, and fixed words deleted wherever they stand; null is empty."""
    out = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    for word in T.SCHOOL_WORDS_EARLY:
        out = F.trim(F.replace(out, F.lit(word), F.lit("")))
    return out


def religion_of_text(text: Column, organisations: Column | None = None) -> Column:
    """Category of the first religion word in the text, else in an organisation's name."""
    table = {w: T.RELIGION_CATEGORIES[w] for w in T.RELIGION_WORDS}
    found = ordered_lookup(F.lower(text), table)
    if organisations is None:
        return found
    hits = F.filter(F.transform(organisations, lambda o: ordered_lookup(F.lower(o), table)), lambda x: x.isNotNull())
    return F.coalesce(found, F.get(hits, F.lit(0)))
