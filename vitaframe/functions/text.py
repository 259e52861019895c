"""Names, titles, lists and readable text as Column functions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaframe.functions import tables as T


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def ordered_lookup(text: Column, table: Mapping[str, str], either_way: bool = False) -> Column:
    """Whole text first, then the first key (in table order) that the text contains; either_way: or that contains the text."""
    whole = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))

    def found(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for key, value in reversed(table.items()):
            inside = F.contains(t, F.lit(key))
            out = F.when(inside | F.contains(F.lit(key), t) if either_way else inside, value).otherwise(out)
        return F.coalesce(F.try_element_at(whole, t), out)

    return let(text, found)


def _accents() -> tuple[str, str]:
    """Precomposed letters and their bases, derived from the Unicode database; marks of other scripts go by category."""
    plain = {}
    for code in range(0xC0, 0x2000):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(x) != "Mn")
        if base != chr(code) and len(base) == 1:
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


_ACCENTED, _PLAIN = _accents()


def remove_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def normalize_name(c: Column, lowercase: bool = True, drop_middle_initial: bool = True, expand_nicknames: bool = True) -> Column:
    """Comparable form of a name; null and blank give ''."""
    out = F.trim(F.coalesce(c, F.lit("")))
    out = remove_accents(F.lower(out) if lowercase else out)
    if drop_middle_initial:
        out = F.trim(F.regexp_replace(out, r"\s+[A-Za-z]\.\s*", " "))
    if expand_nicknames:
        for short, full in T.NICKNAMES:
            out = F.regexp_replace(out, rf"\b{short}\b", full)
    return F.trim(out)


def slug(c: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Underscored normal form; the first override whose key it contains (in any case) wins."""
    base = F.replace(normalize_name(c), F.lit(" "), F.lit("_"))
    return F.coalesce(_override(base, overrides), base)


def normalize_name_early(c: Column) -> Column:
    """Earlier form: lower case, no accents, an earlier table of names; middle initials stay; null is empty."""
    out = remove_accents(F.trim(F.lower(F.coalesce(c, F.lit("")))))
    for short, long in T.NAMES_EARLY:
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return out


def slug_early(c: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Oldest form: a middle initial goes, spaces become underscores, letters stay as they are."""
    base = F.replace(F.trim(F.regexp_replace(c, r"\s+[A-Z]\.\s*", " ")), F.lit(" "), F.lit("_"))
    return F.coalesce(*(F.when(base == k, F.lit(v)) for k, v in (overrides or {}).items()), base)


def _override(base: Column, overrides: Mapping[str, str] | None) -> Column:
    hits = [F.when(F.contains(F.lower(base), F.lit(k.lower())), v) for k, v in (overrides or {}).items()]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def _capitals(c: Column) -> Column:
    words = F.split(F.trim(normalize_name(c, expand_nicknames=False)), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "_")


def page_url(c: Column, base: str, overrides: Mapping[str, str] | None = None) -> Column:
    """Page address: nicknames stay; overrides are tested on the lower-case form."""
    plain = F.replace(normalize_name(c, expand_nicknames=False), F.lit(" "), F.lit("_"))
    return F.concat(F.lit(base), F.coalesce(_override(plain, overrides), _capitals(c)))


def entity_id(name: Column, state: Column, capitals: bool = False) -> Column:
    """first_last_ST, or First_Last_ST."""
    words = F.filter(F.split(normalize_name(name), r"\s+"), lambda w: w != "")
    if capitals:
        words = F.transform(words, lambda w: F.initcap(w))
    return F.concat(F.array_join(words, "_"), F.lit("_"), F.upper(state))


def name_from_stem(stem: Column) -> Column:
    return F.replace(F.regexp_replace(stem, "_[A-Z]{2}$", ""), F.lit("_"), F.lit(" "))


def standardize_full_name(c: Column) -> Column:
    """'Doe, Jane' to 'Jane Doe', without titles, words capitalised; blank gives null."""
    parts = F.transform(F.split(F.trim(c), ","), lambda p: F.trim(p))
    out = F.lower(F.regexp_replace(F.when(F.contains(c, F.lit(",")), F.array_join(F.reverse(parts), " ")).otherwise(F.trim(c)), r"\s+", " "))
    for title in T.TITLES:
        out = F.trim(F.replace(out, F.lit(title), F.lit("")))
    return blank_to_null(F.initcap(F.regexp_replace(out, r"\s+", " ")))


def valid_full_name(c: Column) -> Column:
    return F.coalesce(F.size(F.split(F.trim(c), r"\s+")) >= 2, F.lit(False))


def standardize_gender(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(T.MALE_WORDS), "Male").when(word.isin(T.FEMALE_WORDS), "Female")


def standardize_ethnicity(c: Column) -> Column:
    return ordered_lookup(F.lower(F.trim(blank_to_null(c))), T.ETHNICITIES)


def standardize_religion(c: Column) -> Column:
    return ordered_lookup(F.lower(F.trim(blank_to_null(c))), T.RELIGION_TITLES)


def religion_category(c: Column, table: Mapping[str, str] = T.RELIGION_CATEGORIES, fallback: bool = True) -> Column:
    """Category by table; with fallback, a text that is in no category stands for itself."""
    text = F.lower(F.trim(blank_to_null(c)))
    found = ordered_lookup(text, table, either_way=True)
    return F.coalesce(found, text) if fallback else found


def religion_category_exact(c: Column, table: Mapping[str, str] = T.RELIGION_CATEGORIES) -> Column:
    text = F.lower(F.trim(blank_to_null(c)))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), text), text)


def valid_in(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def dedupe_ignoring_case(items: Column) -> Column:
    """First of each set of texts that differ in case only, in order."""
    low = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def standardize_roles(c: Column) -> Column:
    """Roles from a JSON list or a |-list, words capitalised, repeats dropped; nothing left gives null."""
    text = F.trim(c)
    bar = F.split(text, r"\|")
    items = F.when(F.startswith(text, F.lit("[")), F.coalesce(F.from_json(text, "array<string>"), bar)).otherwise(bar)
    items = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~x.isin("", "nan", "None"))
    items = dedupe_ignoring_case(F.transform(items, lambda x: F.initcap(F.regexp_replace(x, r"\s+", " "))))
    return F.when(F.size(items) > 0, items)


def is_absent(c: Column) -> Column:
    """Blank, an absence term, or a text with 'not ', 'no ' or 'unavail' anywhere."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (word == "") | word.isin(T.ABSENCE_TERMS) | F.contains(word, F.lit("not ")) | F.contains(word, F.lit("no ")) | F.contains(word, F.lit("unavail"))


def is_missing(c: Column) -> Column:
    """For audits: blank or a term, no substring rule."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (word == "") | word.isin(T.AUDIT_TERMS)


def string_leaves(c: Column) -> Column:
    """Texts of a list, of a list of records, or the text itself. Numbers and nulls of records are left out."""
    return let(F.regexp_replace(F.trim(c), r"(?<=[\[:, ])None(?=[,}\]])", "null"), _leaves)


def _leaves(text: Column) -> Column:
    options = {"allowSingleQuotes": "true"}
    records = F.from_json(text, "array<map<string,string>>", options)
    flat = F.from_json(text, "array<string>", options)
    quoted = F.transform(records, lambda m: F.filter(F.map_values(m), lambda v: v.isNotNull() & ~v.rlike(r"^-?\d+(\.\d+)?$")))
    return F.when(text.rlike(r"^\[\s*\{"), F.coalesce(F.flatten(quoted), F.array(text))).when(F.startswith(text, F.lit("[")), F.coalesce(flat, F.array(text))).otherwise(F.array(text))


def comparison_text(items: Column) -> Column:
    """Lower-case letters and digits of the texts, without stop words; nothing left gives null."""
    text = F.regexp_replace(F.lower(F.array_join(F.filter(items, lambda x: x != ""), " ")), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~w.isin(T.TEXT_STOP_WORDS))
    return let(F.array_join(words, " "), blank_to_null)


def string_set(items: Column) -> Column:
    """Distinct lower-case texts with single spaces, sorted; none gives null."""
    out = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")), lambda x: x.isNotNull() & (x != ""))))
    return let(out, lambda x: F.when(F.size(x) > 0, x))


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def readable_text(html: Column, max_length: int | None = None) -> Column:
    """Text of a page without scripts, styles, navigation and footers; nodes trimmed and joined by one space."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "footer", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<!doctype[^>]*>", ""), r"(?s)</?[A-Za-z][^>]*>", "\u0001")
    for entity, text in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(text))
    out = F.trim(F.regexp_replace(F.replace(out, F.lit("\u0001"), F.lit(" ")), r"\s+", " "))
    return F.substring(out, 1, max_length) if max_length else out


def recover_json(c: Column) -> Column:
    """The JSON text inside a model's answer: whole, fenced, or from the first bracket to the last; none gives null."""
    text = F.trim(c)
    inside = lambda mark: F.btrim(F.split_part(F.split_part(text, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1)), F.lit(" \n\r\t"))
    span = lambda a, b: F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1)
    candidates = [text, inside("```json"), inside("```"), span("{", "}"), span("[", "]")]
    good = [F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in candidates]
    return F.coalesce(*good)


def likely_role(c: Column) -> Column:
    text = F.lower(F.trim(c))
    noise = F.lit(False)
    for word in T.NOISE_WORDS:
        noise = noise | F.contains(text, F.lit(word))
    role = F.lit(False)
    for pattern in T.ROLE_PATTERNS:
        role = role | text.rlike(pattern)
    return F.coalesce(F.length(text).between(3, 150) & ~noise & role, F.lit(False))


def clean_roles(c: Column) -> Column:
    """Likely roles of a |-list, repeats dropped, joined again; none gives ''."""
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), likely_role)
    return F.array_join(dedupe_ignoring_case(items), "|")


def match_offsets(text: Column, pattern: str) -> Column:
    """array<struct<start (from 0), match>> of a pattern's matches, from the lengths of the pieces between them.

    Each pass over the text is bound to a name, as an expression inside a lambda would be computed for every match.
    """
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    sizes = lambda x: F.zip_with(x["pieces"], F.concat(F.array(F.lit("")), x["found"]), lambda p, m: F.length(p) + F.length(m))
    start = lambda s, n: F.aggregate(F.slice(s, 1, n), F.lit(0), lambda a, x: a + x)
    at = lambda x, s: F.transform(x["found"], lambda m, i: F.struct(start(s, i + 1).alias("start"), m.alias("match")))
    return let(both, lambda x: let(sizes(x), lambda s: at(x, s)))


def apply_all(c: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        c = step(c)
    return c
