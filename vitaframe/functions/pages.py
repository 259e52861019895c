"""Reading profile pages as trees: labelled boxes, headings and what follows them. All functions take HTML and never raise on malformed pages."""

from __future__ import annotations

import re

from vitaframe.functions.udfs import Node, tree

# What a date of birth looks like, and the suffix of a heading.
_DATE = re.compile(r"\w+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}")
_SUFFIX = re.compile(r"\s*\(.*?\)\s*$")
# A paragraph that tells about a person is longer than this and has one of these.
_PARAGRAPH, _ABOUT = 50, ("is a", "was a", "american", "senator")
# Pieces of text, the female ones tried first, and the rows about origin.
_FEMALE, _MALE = ("she ", "her ", "hers"), ("he ", "him ", "his ")
_ORIGIN = ("ethnicity", "race", "nationality")


def stripped(node: Node) -> str:
    """The texts of a node, each trimmed, without anything between them."""
    return "".join(t.strip() for t in node.texts())


def find(page: Node, tag: str):
    return (x for x in page.walk() if x.tag == tag)


def labelled_box(page: Node) -> Node | None:
    """The first table one of whose classes has 'infobox' in it."""
    return next((x for x in find(page, "table") if any("infobox" in c for c in (x.attributes.get("class") or "").split())), None)


def box_rows(box: Node):
    """(label in lower case, cells) of the rows with two cells or more; rows of nested tables count for both."""
    for row in find(box, "tr"):
        cells = [c for c in row.walk() if c.tag in ("th", "td")]
        if len(cells) >= 2:
            yield stripped(cells[0]).lower(), cells


def page_profile(html: str) -> dict[str, str | None]:
    """full_name, birthdate, gender and race_ethnicity of a profile page; None for what it doesn't say.

    The name is the first heading's, without a suffix in parentheses. Of several rows about birth the last with a
    date counts, of several about origin the last. Gender comes from the first paragraph about a person alone.
    """
    page = tree(html)
    out: dict[str, str | None] = dict.fromkeys(("full_name", "birthdate", "gender", "race_ethnicity"))
    heading = next(find(page, "h1"), None)
    if heading is not None:
        out["full_name"] = _SUFFIX.sub("", stripped(heading)).strip() or None
    box = labelled_box(page)
    for label, cells in box_rows(box) if box is not None else ():
        if label.startswith("birth") or label.startswith("born"):
            date = _DATE.search(stripped(cells[1]))
            out["birthdate"] = date[0] if date else out["birthdate"]
        elif label in _ORIGIN:
            out["race_ethnicity"] = stripped(cells[1]) or None
    for paragraph in find(page, "p"):
        text = "".join(paragraph.texts())
        low = text.lower()
        if len(text) > _PARAGRAPH and any(x in low for x in _ABOUT):
            out["gender"] = "Female" if any(x in low for x in _FEMALE) else "Male" if any(x in low for x in _MALE) else None
            break
    return out


def listed_roles(html: str, section: str = "committee assignments", term: str = "") -> list[str] | None:
    """List items between the first h4 with `term` that follows the first h2 about `section`, and the next h2, h3 or h4; None without any.

    An item that holds a list comes with the texts of that list, and the items of that list after it.
    """
    state, out = "before", []
    for node in tree(html).walk():
        if state == "before":
            if node.tag == "h2" and section in "".join(node.texts()).lower():
                state = "section"
        elif state == "section":
            if node.tag == "h4" and term in "".join(node.texts()):
                state = "list"
        elif node.tag in ("h2", "h3", "h4"):
            break
        elif node.tag == "li":
            out.append(stripped(node))
    return [x for x in out if x] or None


def cell_lines(cell: Node) -> list[str]:
    """A cell's list items; without any, its parts between line breaks."""
    items = [stripped(x) for x in find(cell, "li")]
    if not items:
        items = [""]
        for child in cell.children:
            if isinstance(child, Node) and child.tag == "br":
                items.append("")
            else:
                items[-1] += "".join(child.texts()) if isinstance(child, Node) else child
    return [x for x in (re.sub(r"\s+", " ", i).strip() for i in items) if x]


def page_education(content: bytes, labels: tuple[str, ...] = ("education", "alma mater")) -> dict:
    """canonical (address or None), has_box, lines of the cells about education, and the error that kept a page from being read."""
    out: dict = {"canonical": None, "has_box": False, "lines": [], "error": None}
    try:
        page = tree(content.decode("utf-8"))
        out["canonical"] = next((x.attributes.get("href") or None for x in find(page, "link") if "canonical" in (x.attributes.get("rel") or "").lower().split()), None)
        box = labelled_box(page)
        out["has_box"] = box is not None
        if box is not None:
            out["lines"] = [line for label, cells in box_rows(box) if any(x in label for x in labels) for line in cell_lines(cells[1])]
    except Exception as e:  # a page that can't be read must not stop the others
        out |= {"canonical": None, "has_box": False, "lines": [], "error": str(e)}
    return out
