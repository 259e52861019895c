"""Rule-based extraction of fields from text, and interfaces for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions import tables as T
from vitaframe.functions.education import degree_from_dotted, normalize_degree, normalize_school, religion_of_text
from vitaframe.functions.text import blank_to_null, let, match_offsets, ordered_lookup


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(found, 1, limit) if limit else found


def contact_fields(text: Column) -> list[Column]:
    """name, party, emails, phones and years (five at most)."""
    return [first_match(text, T.NAME).alias("name"), F.initcap(first_match(text, T.PARTY)).alias("party"), all_matches(text, T.EMAIL).alias("emails"), all_matches(text, T.PHONE).alias("phones"), all_matches(text, T.YEAR, 5).alias("years")]


def gender_by_cues(text: Column, limit: int = 2000) -> Column:
    """Majority of cues in the first characters; a tie with any cue is Female."""
    head = F.substring(text, 1, limit)
    male, female = (F.regexp_count(head, F.lit(p)) for p in (T.MALE_CUES, T.FEMALE_CUES))
    return F.when(male > female, "Male").when(female > 0, "Female")


def birthdate_in_text(text: Column) -> Column:
    """Date after 'born'; a missing day is 01, a missing or unknown month 01-01."""
    month = F.array_position(F.array(*(F.lit(m) for m in T.MONTHS)), F.lower(F.trim(F.regexp_extract(text, T.BORN, 1))))
    day, year = F.regexp_extract(text, T.BORN, 2), F.regexp_extract(text, T.BORN, 3)
    tail = F.when((month > 0) & (day != ""), F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))).when(month > 0, F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("-01"))).otherwise("01-01")
    return F.when(year != "", F.concat(year, F.lit("-"), tail))


def labelled_value(text: Column, keywords: list[str], header_too: bool = False) -> Column:
    """Value after 'keyword:' at a line's start, else the next non-empty of three lines; header_too: also after a line that starts with the keyword.

    The earliest line counts, then the keywords' order.
    """
    lines = F.split(text, r"\r\n|\n|\r")

    def value(line: Column, i: Column) -> Column:
        low = F.lower(F.trim(line))
        follows = F.get(F.filter(F.transform(F.slice(lines, i + 2, 3), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
        tries = []
        for k in keywords:
            quoted = r"\Q" + k + r"\E"
            after = blank_to_null(F.trim(F.regexp_extract(line, r"(?s)^[^:：]*[:：](.*)$", 1)))
            tries.append(F.when(low.rlike(rf"^{quoted}\s*[:：]"), F.coalesce(after, follows)))
            if header_too:
                tries.append(F.when(F.startswith(low, F.lit(k)), follows))
        return F.coalesce(*tries)

    return F.get(F.filter(F.transform(lines, value), lambda v: v.isNotNull()), F.lit(0))


def degrees_in_text(text: Column) -> Column:
    """array<struct<degree, institution, year>>: each degree with the last institution of 200 characters before, else the first of 100 after; first year after, else before."""

    def entry(m: Column) -> Column:
        start = m["start"]
        before = F.substring(text, F.greatest(start - 199, F.lit(1)), F.least(start, F.lit(200)))
        after = F.substring(text, start + 1, F.lit(100))
        earlier = F.regexp_extract_all(before, F.lit(T.INSTITUTION), F.lit(1))
        school = F.coalesce(F.try_element_at(earlier, F.lit(-1)), first_match(after, T.INSTITUTION))
        year = F.coalesce(first_match(after, r"(\d{4})"), first_match(before, r"(\d{4})")).cast("int")
        return F.struct(degree_from_dotted(m["match"]).alias("degree"), F.trim(school).alias("institution"), year.alias("year"))

    return F.array_distinct(F.transform(match_offsets(text, T.DEGREE), entry))


def degrees_near_entities(text: Column, organisations: Column, pattern: str = T.DEGREE, normal: Callable[[Column], Column] = degree_from_dotted) -> Column:
    """Each degree with the first organisation named within 200 characters and the first year 19xx or 20xx there; repeats stay.

    With T.DEGREE_WIDE and a `normal` that changes nothing, degrees stay as they are written and words for them count too.
    """

    def entry(m: Column) -> Column:
        start = m["start"]
        region = F.substring(text, F.greatest(start - 199, F.lit(1)), F.least(start, F.lit(200)) + 200)
        school = F.get(F.filter(organisations, lambda o: F.contains(F.lower(region), F.lower(o))), F.lit(0))
        return F.struct(normal(m["match"]).alias("degree"), school.alias("institution"), first_match(region, r"((?:19|20)\d{2})").cast("int").alias("year"))

    return F.transform(match_offsets(text, pattern), entry)


def committees_in_text(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(T.COMMITTEE), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(found))


def religion_in_text(text: Column, limit: int = 3000) -> Column:
    """Category of the first keyword in the first characters; 'church' is skipped where 'Church St' occurs."""
    head = F.lower(F.substring(text, 1, limit))
    tries = []
    for k in T.KEYWORDS_FOUR["religion"]:
        category = ordered_lookup(F.lit(k), T.RELIGION_CATEGORIES, either_way=True)
        hit = F.contains(head, F.lit(k))
        if k == "church":
            hit = hit & ~F.contains(text, F.lit("Church St"))
        tries.append(F.when(hit, category))
    return F.coalesce(*tries)


def of_label(entities: Column, *labels: str) -> Column:
    """Distinct texts of the entities with a label, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(entities, lambda e: e["label"].isin(list(labels))), lambda e: e["text"])))


def committees_of(organisations: Column) -> Column:
    return F.array_distinct(F.filter(organisations, lambda o: F.lower(o).rlike("|".join(T.COMMITTEE_WORDS))))


def roles_near(text: Column, organisations: Column, reach: int = 150) -> Column:
    """'<role> of <committee>' with the first role word around the committee's first mention; 'Member of' without one."""

    def role(name: Column) -> Column:
        at = F.position(F.lower(name), F.lower(text))
        around = F.substring(text, F.greatest(at - reach, F.lit(1)), F.length(name) + F.least(at - 1, F.lit(reach)) + reach)
        word = first_match(around, r"(?i)(Chair|Ranking Member|Member|Co-Chair)")
        return F.when(at == 0, name).otherwise(F.concat(F.coalesce(word, F.lit("Member")), F.lit(" of "), name))

    return F.transform(committees_of(organisations), role)


def entity_fields(entities: Column) -> list[Column]:
    """person, state, affiliation: the first of each kind, in the entities' order."""
    nth = lambda keep: F.get(F.filter(entities, keep), F.lit(0))["text"]
    committee = lambda e: F.lower(e["text"]).rlike("|".join(T.COMMITTEE_WORDS))
    return [nth(lambda e: e["label"] == "PERSON").alias("person"), nth(lambda e: (e["label"] == "GPE") & e["text"].isin(T.STATES)).alias("state"), nth(lambda e: (e["label"] == "ORG") & ~committee(e)).alias("affiliation")]


def religion_of_entities(text: Column, entities: Column, entities_first: bool = False) -> Column:
    names = of_label(entities, "ORG", "MISC") if entities_first else of_label(entities, "ORG")
    if entities_first:
        return F.coalesce(religion_of_text(F.array_join(names, "\n")), religion_of_text(text))
    return religion_of_text(text, names)


DEGREE_WORDS = r"(Ph\.?D\.?|M\.?B\.?A\.?|J\.?D\.?|M\.?D\.?|LL\.?B\.?|LL\.?M\.?|B\.?A\.?|B\.?S\.?|M\.?A\.?|M\.?S\.?)(?![A-Za-z])"


def list_entry(line: Column) -> Column:
    """struct<degree, institution, year> of one line: first year, degree in parentheses or as a word, the rest."""
    year = first_match(line, r"\b((?:19|20)\d{2})\b")
    degree = F.coalesce(first_match(line, r"\(\s*([A-Za-z.]{2,6})\s*\)"), first_match(line, rf"(?i)(?:^|[\s,(]){DEGREE_WORDS}"))
    rest = F.regexp_replace(F.regexp_replace(line, r"\([^)]*\)", " "), r"\b(?:19|20)\d{2}\b", " ")
    rest = F.trim(F.regexp_replace(F.regexp_replace(rest, r"[\s,;–-]+$", ""), r"\s+", " "))
    return F.struct(degree_from_dotted(degree).alias("degree"), blank_to_null(rest).alias("institution"), year.alias("year"))


def degree_list_entries(text: Column) -> Column:
    """'School (deg, deg)' parts to one struct<degree, institution> per degree."""
    parts = F.regexp_extract_all(text, F.lit(r"[^()]+\([^()]*\)"), F.lit(0))
    each = F.transform(parts, lambda p: F.transform(F.split(F.regexp_extract(p, r"\(([^()]*)\)", 1), r"\s*,\s*"), lambda d: F.struct(degree_from_dotted(d).alias("degree"), F.regexp_replace(F.regexp_extract(p, r"^([^()]+)\(", 1), r"^[\s,;]+|[\s,;]+$", "").alias("institution"))))
    return F.flatten(each)


def split_entries(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def split_by_degrees(text: Column) -> Column:
    """The text cut before each degree of T.CUT_DEGREES, pieces trimmed; what stands before the first goes. With fewer than two degrees it stays whole.

    The pieces come from one pass each for the degrees and for what stands between them.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found, between = F.regexp_extract_all(text, F.lit(T.CUT_DEGREES), F.lit(0)), F.split(text, T.CUT_DEGREES, -1)
    pieces = F.zip_with(found, F.slice(between, 2, F.greatest(F.size(found), F.lit(1))), lambda degree, rest: trim(F.concat(degree, rest)))
    return F.when(F.size(found) < 2, F.array(trim(text))).otherwise(F.filter(pieces, lambda x: x != ""))


def split_listing(text: Column) -> Column:
    """Entries between semicolons; without any, the lines, if there are several; else the text."""
    parts = F.transform(F.split(text, ";"), lambda x: F.trim(x))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.contains(text, F.lit(";")), parts).when(F.size(lines) > 1, lines).otherwise(F.array(text))


def single_entry(text: Column) -> Column:
    """struct<degree, institution, year> of one entry: the first four digits, the first degree by T.ENTRY_DEGREES, and the rest.

    A rest of over 50 characters with several school words ends after the first of these.
    """
    schools = r"university|college|institute|school|academy"

    def cleaned(rest: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.trim(rest), r"\s+", " "), r"[,;()]+", ""))

    def shortened(rest: Column) -> Column:
        long = (F.length(rest) > 50) & (F.regexp_count(rest, F.lit(f"(?i){schools}")) > 1)
        return F.when(long, F.trim(F.regexp_extract(rest, rf"(?is)^(.*?(?:{schools}))", 1))).otherwise(rest)

    def parts(entry: Column) -> Column:
        degree = F.coalesce(*(F.when(entry.rlike(f"(?i){p}"), F.lit(name)) for p, name in T.ENTRY_DEGREES))
        rest = F.coalesce(*(F.when(entry.rlike(f"(?i){p}"), F.regexp_replace(entry, f"(?i){p}", "")) for p, _ in T.ENTRY_DEGREES), entry)
        return F.struct(degree.alias("degree"), let(let(rest, cleaned), shortened).alias("rest"))

    def whole(text: Column) -> Column:
        year = blank_to_null(F.regexp_extract(text, r"(\d{4})", 1))
        entry = F.when(text.rlike(r"\d{4}"), F.trim(F.regexp_replace(text, r"\s*\(?\d{4}\)?\s*", " "))).otherwise(F.trim(text))
        return let(let(entry, parts), lambda x: F.struct(let(x["degree"], lambda d: F.when(d.isNotNull(), normalize_degree(d))).alias("degree"), let(x["rest"], lambda r: F.when(F.length(r) > 1, normalize_school(r))).alias("institution"), year.cast("int").alias("year")))

    return let(text, whole)


def value_cell_entries(text: Column) -> Column:
    """Entries of a cell: for each line the degrees in parentheses, else the line as one entry, if it names a school."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)

    def entries(line: Column) -> Column:
        listed = F.transform(degree_list_entries(line), lambda e: F.struct(e["degree"].alias("degree"), e["institution"].alias("institution"), F.lit(None).cast("int").alias("year")))
        return let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(F.filter(F.array(single_entry(line)), lambda e: e["institution"].isNotNull())))

    return F.flatten(F.transform(lines, entries))


def years_of_dates(entities: Column) -> Column:
    """Distinct years 19xx and 20xx in the entities labelled DATE, in order."""
    return F.array_distinct(F.flatten(F.transform(F.filter(entities, lambda e: e["label"] == "DATE"), lambda e: F.regexp_extract_all(e["text"], F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)))))


def first_of_types(entities: Column, names: dict[str, str]) -> list[Column]:
    """A column for each label: the text of its first entity. names: column by label."""
    first = lambda label: F.get(F.filter(entities, lambda e: e["label"] == label), F.lit(0))["text"]
    return [first(label).alias(name) for label, name in names.items()]


class EntityRecognizer(Protocol):
    """Finds (text, label) pairs in each text of a batch."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str]]]: ...


class ProfileModel(Protocol):
    """Answers a prompt about a text with JSON text; may raise on quota errors."""

    def __call__(self, prompt: str, text: str) -> str: ...


class CapitalisedRecognizer:
    """Offline stand-in: runs of capitalised words, labelled by a key word. Its output says nothing about a model's quality."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        import re

        out = []
        for text in texts:
            found = re.findall(r"[A-Z][a-z]+(?: (?:of |and )?[A-Z][a-z]+)*", text)
            out.append([(x, "ORG" if re.search("Committee|University|College|Church|Institute", x) else "GPE" if x in T.STATES else "PERSON" if " " in x else "MISC") for x in found])
        return out


def recognize(frame: DataFrame, recognizer: Callable[[], EntityRecognizer], id_: str = "entity_id", text: str = "text", limit: int = 10_000) -> DataFrame:
    """(id, entities); the recogniser is built once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = recognizer()
        for frame_ in frames:
            found = model([x or "" for x in frame_["text"]])
            yield pd.DataFrame({id_: frame_[id_], "entities": [[{"text": a, "label": b} for a, b in row] for row in found]})

    kind = frame.schema[id_].dataType.simpleString()
    return frame.select(id_, F.substring(text, 1, limit).alias("text")).mapInPandas(run, f"`{id_}` {kind}, entities array<struct<text:string,label:string>>")


@dataclass
class CallPolicy:
    """Pace and retries of model calls. tries: attempts at most; pause grows as 2^attempt up to longest.

    calls_per_minute bounds the calls of all tasks together, retries included; delay_s is each task's own pause after a call.
    """

    delay_s: float = 0.0
    tries: int = 5
    longest_s: float = 120.0
    sleep: Callable[[float], None] = field(default=None)
    calls_per_minute: float | None = None

    def pause(self, attempt: int) -> float:
        return min(2.0**attempt, self.longest_s)


class Pace:
    """Turns at calling, shared by all holders of a lease without talking to each other.

    Time is cut into slots of a minute by calls_per_minute. Slot s belongs to the lease s modulo the number of leases, and
    its holder may start one call when it begins. A slot missed is lost, so late starters never catch up in a burst.
    The machines' clocks must agree to within a slot.
    """

    def __init__(self, calls_per_minute: float, leases: int, now: Callable[[], float], sleep: Callable[[float], None]) -> None:
        self.width, self.leases, self.now, self.sleep, self.used = 60.0 / calls_per_minute, leases, now, sleep, {}

    def wait(self, lease: int) -> None:
        slot = max(int(self.now() // self.width), self.used.get(lease, -1)) + 1
        slot += (lease - slot) % self.leases
        self.used[lease] = slot
        while (rest := slot * self.width - self.now()) > 0:
            self.sleep(rest)


class QuotaError(RuntimeError):
    """The model asks for fewer calls; its message may say 'retry in N s'."""

    def wait(self) -> float | None:
        """The seconds asked for, and two more."""
        import re

        found = re.search(r"(?:retry|try again) in (\d+(?:\.\d+)?)\s*s", str(self), re.I)
        return float(found[1]) + 2 if found else None


def call_model(model: ProfileModel, prompt: str, text: str, policy: CallPolicy, turn: Callable[[], None] | None = None) -> tuple[str | None, str | None]:
    """(answer, error): quota errors are tried again, others reported. turn: waited for before every attempt."""
    import time

    sleep = policy.sleep or time.sleep
    full = prompt.replace("{text}", text) if "{text}" in prompt else f"{prompt}\n\n{text}"
    for attempt in range(policy.tries):
        try:
            if turn:
                turn()
            return model(full, text), None
        except QuotaError as e:
            if attempt + 1 == policy.tries:
                return None, str(e)
            sleep(e.wait() or policy.pause(attempt))
        except Exception as e:  # a failed document must not stop the others
            return None, str(e)
    return None, "no attempt"


#: Prompts that ask() takes; more are an error, as they are sent to all tasks.
MOST_PROMPTS = 1000


def answers(tasks: DataFrame, keys: list[str], model: Callable[[], ProfileModel], policy: CallPolicy | None = None, slots: int | None = None) -> DataFrame:
    """(keys, answer, extraction_error) for each row of (keys, text, prompt). slots: leases, and tasks that call at once; as many as cores by default.

    Rows are dealt to leases by their keys, and each lease's rows lie in one task, so policy.calls_per_minute holds for all tasks together.
    """
    policy = policy or CallPolicy()
    leases = slots or tasks.sparkSession.sparkContext.defaultParallelism
    kinds = {f.name: f.dataType.simpleString() for f in tasks.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        own, sleep = model(), policy.sleep or time.sleep
        pace = Pace(policy.calls_per_minute, leases, time.time, sleep) if policy.calls_per_minute else None
        for frame in frames:
            rows = []
            for lease, text, prompt in zip(frame["_lease"], frame["text"], frame["prompt"], strict=True):
                rows.append(call_model(own, prompt, text or "", policy, partial(pace.wait, lease) if pace else None))
                if policy.delay_s:
                    sleep(policy.delay_s)
            yield frame[keys].assign(answer=[a for a, _ in rows], extraction_error=[e for _, e in rows])

    dealt = tasks.select(*keys, "text", "prompt", F.pmod(F.xxhash64(*keys), F.lit(leases)).cast("int").alias("_lease")).repartition(leases, "_lease")
    return dealt.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", answer string, extraction_error string")


def with_prompts(frame: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every row with every prompt; the prompts are broadcast, so their number is bounded."""
    if prompts.limit(MOST_PROMPTS + 1).count() > MOST_PROMPTS:
        raise ValueError(f"more than {MOST_PROMPTS} prompts")
    return frame.crossJoin(F.broadcast(prompts))


def ask(frame: DataFrame, prompts: DataFrame, model: Callable[[], ProfileModel], policy: CallPolicy | None = None, slots: int | None = None) -> DataFrame:
    """(entity_id, style, answer, extraction_error) for each text and prompt."""
    return answers(with_prompts(frame.select("entity_id", "text"), prompts), ["entity_id", "style"], model, policy, slots)
