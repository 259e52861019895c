"""The few functions that need Python, as Arrow-batched UDFs. Null inputs return at once."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType

ColumnOrName = Column | str


def _pairwise(function: Callable[[str, str], float]) -> Callable[[ColumnOrName, ColumnOrName], Column]:
    def of_batch(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        for pair in zip(a, b, strict=True):
            if None not in pair and pair not in known:
                known[pair] = function(*pair)
        return pd.Series([known.get(pair) for pair in zip(a, b, strict=True)], dtype="float64")

    def apply(a: ColumnOrName, b: ColumnOrName) -> Column:
        # A new UDF each time: a used one holds on to the JVM and can't go to executors with this module.
        return F.pandas_udf(of_batch, DoubleType())(a, b)

    return apply


def sequence_ratio(a: str, b: str) -> float:
    """Matching-blocks ratio; not symmetric."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def token_sort_ratio(a: str, b: str) -> float:
    """0 to 100: 200 * LCS / (m + n) of the texts with their words sorted."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def best_token_sorts(lefts: list[str], rights: list[str], least: float) -> list[tuple[str, str, float]]:
    """(left, right, token_sort_ratio) of each left text's best right one above `least`; ties to the smaller.

    The common subsequence is counted bit-parallel; a pair is skipped only if its lengths bound the ratio by `least`.
    """
    words = [(" ".join(sorted(x.split())), x) for x in rights]
    out = []
    for left in lefts:
        a = " ".join(sorted(left.split()))
        full, masks, best = (1 << len(a)) - 1, {}, None
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        for b, right in words:
            total = len(a) + len(b)
            if total and 200.0 * min(len(a), len(b)) / total <= least:
                continue
            row = full
            for y in b:
                both = row & masks.get(y, 0)
                row = (row + both | row - both) & full
            ratio = 200.0 * (len(a) - row.bit_count()) / total if total else 100.0
            if ratio > least and (best is None or (-ratio, right) < best):
                best = (-ratio, right)
        if best:
            out.append((left, best[1], -best[0]))
    return out


ratio_udf = _pairwise(sequence_ratio)
token_sort_udf = _pairwise(token_sort_ratio)


class Stemmer:
    """Porter's suffix stripping (1980)."""

    _STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    _STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    _STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    @staticmethod
    def _shape(word: str) -> str:
        """c and v by letter: y counts as a vowel after a consonant."""
        out = ""
        for k, letter in enumerate(word):
            out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
        return out

    def _measure(self, stem: str) -> int:
        return len(re.findall("v+c+", self._shape(stem)))

    def _short_end(self, word: str) -> bool:
        return len(word) >= 3 and self._shape(word)[-3:] == "cvc" and word[-1] not in "wxy"

    def _replace(self, word: str, rules: list[tuple[str, str]]) -> str:
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(end):
                stem = word[: len(word) - len(end)]
                return stem + new if self._measure(stem) > 0 else word
        return word

    def __call__(self, word: str) -> str:
        if len(word) <= 2:
            return word
        if word.endswith("s"):
            word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
        done = False
        if word.endswith("eed"):
            word = word[:-1] if self._measure(word[:-3]) > 0 else word
        else:
            for end in ("ed", "ing"):
                if word.endswith(end) and "v" in self._shape(word[: -len(end)]):
                    word, done = word[: -len(end)], True
                    break
        if done:
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and self._shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif self._measure(word) == 1 and self._short_end(word):
                word += "e"
        if word.endswith("y") and "v" in self._shape(word[:-1]):
            word = word[:-1] + "i"
        word = self._replace(self._replace(word, self._STEP2), self._STEP3)
        for end in sorted(self._STEP4, key=len, reverse=True):
            if word.endswith(end):
                stem = word[: -len(end)]
                if self._measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    word = stem
                break
        if word.endswith("e"):
            stem = word[:-1]
            if self._measure(stem) > 1 or self._measure(stem) == 1 and not self._short_end(stem):
                word = stem
        if word.endswith("ll") and self._measure(word) > 1:
            word = word[:-1]
        return word


def stemmed_f1(a: str, b: str) -> float:
    """Unigram F over stems of the tokens longer than three letters."""
    from collections import Counter

    stem = Stemmer()
    left, right = (Counter(stem(t) if len(t) > 3 else t for t in re.findall("[a-z0-9]+", x.lower())) for x in (a, b))
    overlap = sum((left & right).values())
    if not overlap:
        return 0.0
    p, r = overlap / sum(left.values()), overlap / sum(right.values())
    return 2 * p * r / (p + r)


stemmed_f1_udf = _pairwise(stemmed_f1)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "nav", "footer", "noscript"}


class Node:
    """An element: tag, attributes, children (nodes and texts)."""

    def __init__(self, tag: str, parent: Node | None = None, attributes: dict | None = None) -> None:
        self.tag, self.parent, self.attributes, self.children = tag, parent, attributes or {}, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def texts(self, skip: frozenset = frozenset()):
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in skip:
                yield from child.texts(skip)

    def text(self, skip: frozenset = frozenset()) -> str:
        return " ".join(t.strip() for t in self.texts(skip) if t.strip())

    def next_sibling(self) -> Node | None:
        if self.parent is None:
            return None
        after = self.parent.children[self.parent.children.index(self) + 1 :]
        return next((x for x in after if isinstance(x, Node)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, self.at, dict(attrs))
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end without a start is ignored
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def readable(html: str) -> str:
    return re.sub(r"\s+", " ", tree(html).text(frozenset(_HIDDEN))).strip()


_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "dt", "th", "label", "strong", "b"}


def after_heading(html: str, keywords: list[str], extra_tags: frozenset = frozenset()) -> str | None:
    """Text of the element after the first heading-like one that has a keyword; else of the one after its parent."""
    for node in tree(html).walk():
        if node.tag in _HEADINGS or node.tag in extra_tags:
            if any(k in node.text().lower() for k in keywords):
                follows = node.next_sibling() or (node.parent.next_sibling() if node.parent else None)
                if follows is not None:
                    return follows.text()
    return None


def infobox_row(html: str, label: str) -> str | None:
    """Value cell of the first table row whose header cell contains the label; <br> and list items part by newlines."""
    for node in tree(html).walk():
        if node.tag == "tr":
            cells = [c for c in node.children if isinstance(c, Node) and c.tag in ("th", "td")]
            if len(cells) >= 2 and label in cells[0].text().lower():
                items = [c.text() for c in cells[1].walk() if c.tag == "li"]
                if items:
                    return "\n".join(items)
                lines, line = [], []
                for child in cells[1].children:
                    if isinstance(child, Node) and child.tag == "br":
                        lines.append(" ".join(line))
                        line = []
                    else:
                        line.append(child.text() if isinstance(child, Node) else child.strip())
                return "\n".join(x.strip() for x in [*lines, " ".join(line)] if x.strip())
    return None


def listed_under(html: str, section: str, term: str) -> list[str]:
    """List items below the h4 `term` of the h2 `section`, up to the next heading."""
    out, inside, active = [], False, False
    for node in tree(html).walk():
        if node.tag == "h2":
            inside, active = section in node.text().lower(), False
        elif node.tag in ("h3", "h4"):
            active = inside and node.tag == "h4" and term in node.text()
        elif node.tag == "li" and active:
            out.append(node.text())
    return out


def html_udf(function: Callable, returns: DataType | None = None):
    """An Arrow UDF over pages."""

    @F.pandas_udf(returns or StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(x) for x in pages], dtype="object")

    return run
