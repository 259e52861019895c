"""Page profiles, lists under headings, files with status, fetching, degrees and the truth builder."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from vitaframe.functions.pages import listed_roles, page_profile
from vitaframe.operators import extract, pages, truth
from vitaframe.operators.extract import CallPolicy
from vitaframe.sources import readers

SHE = "<p>She is a senator of whom a great deal has been written in many places.</p>"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("", (None, None, None, None)),
        ("no tags at all", (None, None, None, None)),
        ("<h1> Jane <b>Q.</b> Doe (politician) </h1><h1>Other</h1>", ("JaneQ.Doe", None, None, None)),
        ("<h1>(only)</h1>", (None, None, None, None)),
        ("<h1>Jane Doe" + SHE, ("Jane DoeShe is a senator of whom a great deal has been written in many places.", None, "Female", None)),
        ('<table class="x"><tr><th>Born<td>May 1, 1950</table><table class="big-infobox"><tr><th>Born</th><td>1951-02-03</td></tr></table>', (None, "1951-02-03", None, None)),
        ('<table class=infobox><tr><th>Birth</th><td>May 1 1950</td></tr><tr><th>Born in</th><td>Ohio</td></tr><tr><th>Born</th><td>June 2, 1951 (age 7)</td></tr><tr><td>one cell</td></tr></table>', (None, "June 2, 1951", None, None)),
        ('<table class=infobox><tr><th>Ethnicity</th><td> A <i>B</i> </td></tr><tr><th>race </th><td></td></tr></table>', (None, None, None, None)),
        ("<table class><tr><th>Born</th><td>May 1, 1950</td></tr></table>", (None, None, None, None)),
        ("<p>He was a man.</p>" + SHE + "<p>He is a senator; his career has been long and full of events of all kinds.</p>", (None, None, "Female", None)),
        ("<p>A senator who can't in any way be known by a word for a man or a woman</p>" + SHE, (None, None, None, None)),
        ("<p>The senator was a lawyer before that and nothing else is known of it.</p>", (None, None, "Male", None)),
        ("</td></tr><table class='infobox'><tr><td>Race<td>Unclosed", (None, None, None, None)),
        ("<h1>A &amp; B &lt;c&gt;</h1><br/><p", ("A & B <c>", None, None, None)),
    ],
)
def test_profiles(html, expected):
    assert tuple(page_profile(html).values()) == expected


def test_profiles_of_null_pages(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "<h1>X Y</h1>", "b")], "page_id long, html string, full_text string")
    got = pages.profiles(frame, "page_id", "full_text").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", None, None, None, None), (2, "b", "X Y", None, None, None)]


class _Events(HTMLParser):
    """A plain twin: tags and texts in order, list items as the spans of events that they cover."""

    def __init__(self):
        super().__init__()
        self.stack, self.items, self.heads, self.n = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        self.n += 1
        if tag == "br":
            return
        self.stack.append((tag, self.n, []))
        if tag in ("h2", "h3", "h4", "li"):
            self.heads.append(self.stack[-1])

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for _, _, texts in self.stack:
            texts.append(data)


def twin_roles(html, section, term):
    reader = _Events()
    reader.feed(html)
    reader.close()
    marks = [(tag, texts) for tag, _, texts in sorted(reader.heads, key=lambda x: x[1])]
    at = next((k for k, (tag, x) in enumerate(marks) if tag == "h2" and section in "".join(x).lower()), None)
    if at is None:
        return None
    start = next((k for k in range(at + 1, len(marks)) if marks[k][0] == "h4" and term in "".join(marks[k][1])), None)
    if start is None:
        return None
    out = []
    for tag, x in marks[start + 1 :]:
        if tag != "li":
            break
        out.append("".join(t.strip() for t in x))
    return [x for x in out if x] or None


def test_lists_under_headings():
    import random

    r = random.Random(2)
    bits = ["<h2>Committee assignments</h2>", "<h2>Other</h2>", "<h3>x</h3>", "<h4>2025-2026</h4>", "<h4>2023</h4>", "<ul>", "</ul>", "<li>", "</li>", " Budget ", "Rules<b> of </b>", "<div>", "</div>", "<br>", "</h4>"]
    found = 0
    for _ in range(4000):
        html = "".join(r.choice(bits) for _ in range(r.randrange(4, 25)))
        if r.random() < 0.6:
            html = "<h2>Committee assignments</h2>" + html.replace("<div>", "<h4>2025-2026</h4><ul><li>A", 1)
        expected = twin_roles(html, "committee assignments", "2025-2026")
        found += expected is not None
        assert listed_roles(html, "committee assignments", "2025-2026") == expected, html
    assert found > 500


def test_degree_pieces(spark):
    cases = {
        "BA Louisville University Kentucky JD University of Kentucky": ["BA Louisville University Kentucky", "JD University of Kentucky"],
        "  Oak College (BA) ": ["Oak College (BA)"], "none": ["none"], "": [""], "first BA x, ma y; PhD": ["BA x,", "ma y;", "PhD"], "B.A.Oak J.D.Elm": ["B.A.Oak", "J.D.Elm"],
        "MBAs and BASIC": ["MBAs and BASIC"], "BA BA": ["BA", "BA"],
    }
    frame = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", extract.split_by_degrees(F.col("t")).alias("p"))
    got = {r.t: r.p for r in frame.collect()}
    assert {t: got[t] for t in cases} == cases


def test_every_status_of_a_file(spark, tmp_path):
    box = '<table class="infobox"><tr><th>{}</th><td>{}</td></tr></table>'
    files = {
        "Ann Roe": b'<link rel="canonical" href="https://e.org/ann">' + box.format("Alma mater", "<ul><li>Oak (B.A.)</li><li>Elm (J.D., M.B.A.)</li></ul>").encode(),
        "Tim Poe": box.format("Born", "May 1, 1950").encode(), "Eva Doe": b"<p>nothing</p>", "Bad Bytes": b"<p>\xff\xfe</p>", "Empty": b"", "Bare Link": b'<link rel="canonical"><table class=infobox>',
    }
    for name, content in files.items():
        (tmp_path / f"{name}.html").write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"x")
    got = {r.entity_id: r for r in pages.education_of_files(spark, str(tmp_path), "https://e.org/wiki/").collect()}
    assert {k: r.status.split(":")[0] for k, r in got.items()} == {"Ann Roe": "success", "Tim Poe": "no_education_found", "Eva Doe": "no_infobox_found", "Bad Bytes": "error", "Empty": "no_infobox_found", "Bare Link": "no_education_found"}
    assert got["Ann Roe"].url == "https://e.org/ann" and got["Tim Poe"].url == "https://e.org/wiki/Tim_Poe" and got["Bad Bytes"].url is None
    assert [(e.degree, e.institution) for e in got["Ann Roe"].education] == [("BA", "Oak"), ("JD", "Elm"), ("MBA", "Elm")]
    assert "utf-8" in got["Bad Bytes"].status and got["Bad Bytes"].education == []
    assert pages.education_records(spark.createDataFrame([("x", None)], "entity_id string, content binary"), "").first().status == "error: no content"


def test_no_address_is_asked_after_the_first_valid_page(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def fetcher():
        def fetch(url):
            import uuid

            (log / f"{url}-{uuid.uuid4().hex}").touch()
            if url.endswith("fails"):
                raise OSError
            return None if url.endswith("none") else "<p>" + "word " * (100 if url.endswith("good") else 3) + "</p>"

        return fetch

    rows = [("a", 2, "a2good"), ("a", 0, "a0short"), ("a", 1, "a1good"), ("b", 0, "b0fails"), ("b", 1, "b1none"), ("b", 2, None), ("c", 5, "c5good"), ("c", 7, "c7fails"), ("d", 0, None), (None, 0, "xgood")]
    candidates = spark.createDataFrame(rows, "entity_id string, ord int, url string").repartition(4)
    got = {r.entity_id: (r.url, r.n_chars, r.n_asked) for r in pages.fetch_report(candidates, fetcher, policy=CallPolicy(tries=3, longest_s=0)).collect()}
    assert got == {"a": ("a1good", 499, 2), "b": (None, 0, 4), "c": ("c5good", 499, 1), "d": (None, 0, 0)}
    assert sorted(re.sub("-.*", "", p.name) for p in log.iterdir()) == ["a0short", "a1good", "b0fails", "b0fails", "b0fails", "b1none", "c5good"]
    assert pages.fetch_first_valid(candidates, fetcher).count() == 2


def test_truth_against_a_plain_twin(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("- name: Finance\n  thomas_id: SSFI\n  subcommittees:\n  - name: Trade\n    thomas_id: '10'\n- name: Budget\n  thomas_id: SSBU\n")
    (tmp_path / "m.yaml").write_text("SSFI:\n- {name: Jane Doe, title: Chair}\n- {name: Ann Roee}\nSSFI10:\n- {name: 'Doe, Jane'}\nSSBU:\n- {name: Jane Doe}\nSSXX:\n- {name: Tim Poe, title: Ranking Member}\n")
    web = {
        "Jane_Doe": '<h1>Jane Doe</h1><table class="infobox"><tr><th>Born</th><td>May 6, 1950</td></tr><tr><th>Education</th><td>Oak (B.A.)</td></tr></table>' + SHE,
        "Ann_Roe": "<h1>Ann Roe (senator)</h1>",
    }
    ids = spark.createDataFrame([("Jane_Doe_OH",), ("Ann_Roe_UT",), ("Tim_Poe_NY",), ("Eva_Loe_TX",), ("Eva_Loe_TX",)], "entity_id string")
    religions = spark.createDataFrame([("Doe Jane", "Baptist"), ("Anne Roe", "Jewish"), ("Timothy Poe", "None"), ("Evan Lo", "Hindu")], "name string, religion string")

    def fetcher():
        def fetch(url):
            return web[url.rsplit("/", 1)[1]]

        return fetch

    names, members = readers.read_yaml(spark, str(tmp_path / "c.yaml")), readers.read_yaml(spark, str(tmp_path / "m.yaml"))
    got = {r.entity_id: r.asDict() for r in truth.build_truth_from_web(ids, fetcher, names, members, religions, aliases={"Tim Poe": "Timothy Poe"}, exclude=["Eva Loe"]).collect()}

    expected = {}
    tree = {"SSFI": "Finance", "SSFI10": "Finance: Trade", "SSBU": "Budget"}
    listed = [("Jane Doe", "SSFI", "Chair"), ("Ann Roee", "SSFI", None), ("Doe, Jane", "SSFI10", None), ("Jane Doe", "SSBU", None), ("Tim Poe", "SSXX", "Ranking Member")]
    for stem in ("Jane_Doe_OH", "Ann_Roe_UT", "Tim_Poe_NY", "Eva_Loe_TX"):
        name = stem[:-3].replace("_", " ")
        from vitaframe.functions.udfs import token_sort_ratio

        best = max(sorted({m for m, _, _ in listed}), key=lambda m: token_sort_ratio(name, m))
        roles = sorted({f"{t or 'Member'} of {tree.get(c, c)}" for m, c, t in listed if m == best}) if token_sort_ratio(name, best) > 85 else None
        asked = {"Tim Poe": "Timothy Poe", "Eva Loe": None}.get(name, name)
        faith = max(("Doe Jane", "Baptist"), ("Anne Roe", "Jewish"), ("Timothy Poe", "None"), ("Evan Lo", "Hindu"), key=lambda x: token_sort_ratio(asked or "", x[0]))
        page = page_profile(web.get(stem[:-3], ""))
        expected[stem] = {"entity_id": stem, "name": name, **page, "birthdate": "1950-05-06" if name == "Jane Doe" else None, "education": '[{"degree":"BA","institution":"Oak"}]' if name == "Jane Doe" else None, "committee_roles": "|".join(roles) if roles else None, "religion": faith[1] if asked and token_sort_ratio(asked, faith[0]) > 85 else None}
    assert got == expected
    assert got["Jane_Doe_OH"]["committee_roles"] == "Chair of Finance|Member of Budget" and got["Tim_Poe_NY"]["committee_roles"] == "Ranking Member of SSXX"

    done = truth.build_truth(ids.where("entity_id < 'F'"), spark.createDataFrame([], "entity_id string, html string"), readers.memberships(members), readers.committee_names(names), religions).drop("religion").checkpoint() if spark.sparkContext.getCheckpointDir() else None
    if done is not None:
        again = truth.build_truth_from_web(ids, fetcher, names, members, religions, done=done)
        assert again.count() == 4 and again.where("entity_id = 'Ann_Roe_UT'").first().full_name is None
