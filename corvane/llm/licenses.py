"""Licence scans: an Aho-Corasick search for tags and notices, and a shunting-yard parser for expressions.

One automaton finds identifier tags and notice phrases in a single pass over the
lower-cased text, with its white space collapsed; of matches that overlap, the
leftmost and longest count, tags before notices, only between word boundaries.  The expression after
each tag, up to the end of its line, a comment's end or the next tag, is parsed with
precedence WITH, AND, OR and evaluated: each licence allows, needs review or denies; AND takes the strictest,
OR the mildest, and a known exception lifts a denial to review.  A document's verdict
is the strictest of all that was found in it.  After the words of CONTEXTS, such as
"licensed under", a bare id counts, but only known ones, and nothing else does.

Licences with their levels, exceptions and notices are those of spdx.py, or given.

Defined results: a text that is null, empty or without a match has the verdict
"none"; an expression that can't be parsed counts as review at best, and lists the known
licences of the longest expression that it begins with; after a tag that ends its line,
the next line counts where it begins with an expression of known licences; a licence that isn't known counts as review; repeated findings count once each in
notices; each row is scanned by itself, repeated or not, and texts of any length in full;
an empty table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import shared, spdx
from corvane.llm.spdx import ALLOW, DENY, REVIEW

TAGS = ("spdx-license-identifier:", "license-expression:", "licenseidentifier:")

#: Words before a bare id.
CONTEXTS = ("license:", "licence:", '"license":', "licensed under the", "licensed under", "released under the", "released under", "distributed under the", "distributed under", "available under the", "license is", "licence is")
VERDICTS = {ALLOW: "allow", REVIEW: "review", DENY: "deny"}


class Vocabulary:
    """Licences with their levels, exceptions, and notice phrases, lower-cased and with collapsed white space, with their licences."""

    def __init__(self, licences: dict[str, int] = spdx.LICENCES, exceptions: list[str] = spdx.EXCEPTIONS, notices: dict[str, str] = spdx.NOTICES) -> None:
        self.licences = {name.lower(): (name, level) for name, level in licences.items()}
        self.exceptions = {x.lower() for x in exceptions}
        self.notices = {" ".join(k.lower().split()): v for k, v in notices.items()}
        self._automaton: ahocorasick.Automaton | None = None
        self._known: dict[str, tuple[int, tuple[str, ...]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_known": {}}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for phrase in (*self.notices, *CONTEXTS, *TAGS):
                self._automaton.add_word(phrase, phrase)
            self._automaton.make_automaton()
        return self._automaton

    def evaluate(self, expression: str) -> tuple[int, tuple[str, ...]]:
        if expression not in self._known:
            if len(self._known) >= 4096:
                self._known.clear()
            self._known[expression] = _evaluated(expression, self)
        return self._known[expression]

    def level(self, name: str) -> int:
        return self.licences.get(name.lower(), (name, REVIEW))[1]


_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:_-]+)")
_END = re.compile(r"\*/|-->|[\"'`,;]")
_LEAD = re.compile(r"^[\s/*#;%-]+")


def postfix(expression: str) -> list[str] | None:
    """The expression's operands and operators in postfix order, or None if it can't be parsed."""
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True
    expression = expression.rstrip()
    while at < len(expression):
        found = _TOKEN.match(expression, at)
        if not found:
            return None
        at, token = found.end(), found[1]
        kind = token.lower()
        if kind in _PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[kind]:
                out.append(stack.pop())
            stack.append(kind)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def _evaluated(expression: str, known: Vocabulary) -> tuple[int, tuple[str, ...]]:
    """(level, licences named) of an expression."""
    steps = postfix(expression)
    if steps is None:
        return REVIEW, ()
    names: list[str] = []
    stack: list[tuple[int, str]] = []
    for token in steps:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                # The right side is an exception, not a licence.
                if right[1] in names:
                    names.remove(right[1])
                lifts = right[1].lower() in known.exceptions
                stack.append((max(left[0], REVIEW) if lifts else left[0], left[1]))
            else:
                stack.append(((min if token == "and" else max)(left[0], right[0]), ""))
            continue
        name, level = known.licences.get(token.lower(), (token, REVIEW))
        if token.endswith("+") and token.lower() not in known.licences:
            name, level = token, known.level(token[:-1])
        names.append(name)
        stack.append((level, name))
    return stack[0][0], tuple(names)


DEFAULT = Vocabulary()


def evaluate(expression: str, known: Vocabulary = DEFAULT) -> tuple[int, tuple[str, ...]]:
    """(level, licences named) of an expression."""
    return known.evaluate(expression)


def located(flat: str, known: Vocabulary = DEFAULT) -> list[tuple[int, int, str]]:
    """(start, end, phrase) of the tags and notices in a lower-cased text with collapsed white space, leftmost and longest, between word boundaries."""
    found = [(end - len(phrase) + 1, end + 1, phrase) for end, phrase in known.automaton.iter(flat)]
    whole = [
        (start, -end, phrase) for start, end, phrase in found
        if not (start and flat[start - 1].isalnum()) and (phrase[-1] == ":" or end == len(flat) or not flat[end].isalnum())
    ]
    # "... Apache-2.0 License-Expression: ...": no notice may hide a tag.
    tags = [(start, -end) for start, end, phrase in whole if phrase in TAGS]
    out, reach = [], 0
    for start, end, phrase in sorted(whole):
        k = bisect_right(tags, (start, len(flat)))
        if start >= reach and (phrase in TAGS or k == len(tags) or tags[k][0] >= -end):
            out.append((start, -end, phrase))
            reach = -end
    return out


def matches(low: str, known: Vocabulary = DEFAULT) -> list[str]:
    """The tags, contexts and notices in a lower-cased text, leftmost and longest, between word boundaries."""
    return [phrase for _, _, phrase in located(" ".join(low.split()), known)]


def _in_text(text: str, low: str, flat_places: list[int]) -> list[int]:
    """Where places of the lower-cased, collapsed text lie in the text; the places ascend, each within a run of visible characters."""
    out, at, words = [], 0, re.finditer(r"\S+", low)
    word = next(words)
    for place in flat_places:
        while place >= at + len(word[0]):
            at += len(word[0]) + 1
            word = next(words)
        out.append(word.start() + place - at)
    if len(low) == len(text):
        return out
    # Lower-casing has made some characters longer.
    ends = list(accumulate(len(c.lower()) for c in text))
    return [bisect_right(ends, x) for x in out]


def known_prefix(text: str, known: Vocabulary = DEFAULT) -> str:
    """The longest expression at the start of a text that names known licences and exceptions alone; may be empty."""
    at, best, depth, operand = 0, 0, 0, True
    while found := _TOKEN.match(text, at):
        at, kind = found.end(), found[1].lower()
        if kind in _PRECEDENCE or kind == ")":
            if operand or (kind == ")" and not depth):
                break
            operand = kind != ")"
            depth -= kind == ")"
        elif not operand:
            break
        elif kind == "(":
            depth += 1
        else:
            bare = kind.rstrip(".:")
            if bare not in known.licences and bare.removesuffix("+") not in known.licences and bare not in known.exceptions:
                break
            at -= len(kind) - len(bare)
            operand = False
        if not operand and not depth:
            best = at
    return text[:best]


def expressions(text: str, low: str, found: list[tuple[int, int, str]], known: Vocabulary = DEFAULT) -> list[tuple[str, bool]]:
    """(expression, whole) after each tag and context among what was located: to the end of its line, a comment's end or the next tag.

    Where that can't be parsed, it is cut to the expression of known licences that it
    begins with, if there is one; where it is empty, so is the next line.  After a context
    only such an expression counts.
    """
    tags = [x for x in found if x[2] in TAGS or x[2] in CONTEXTS]
    starts = _in_text(text, low, [start for start, _, _ in tags])
    ends = [x + 1 for x in _in_text(text, low, [end - 1 for _, end, _ in tags])]
    out = []
    for at, stop, (_, _, phrase) in zip(ends, [*starts[1:], len(text)], tags, strict=True):
        lines = text[at:stop].lstrip(" \t").splitlines() or [""]
        if phrase in CONTEXTS:
            # A licence's name may be broken off its words by a line end.
            begun = known_prefix(" ".join(lines[:2]).lstrip(" \t\"'(=:"), known)
            if begun:
                out.append((" ".join(begun.split()), True))
            continue
        expression = " ".join(_END.split(lines[0], maxsplit=1)[0].split())
        whole = postfix(expression) is not None
        if not whole:
            rest = expression if lines[0].strip() else next((_LEAD.sub("", x) for x in lines[1:] if x.strip()), "")
            begun = known_prefix(rest, known)
            # A next line that is nothing but an expression counts in full.
            whole = bool(begun) and not expression and not _END.split(rest, maxsplit=1)[0][len(begun) :].strip()
            expression = " ".join(begun.split()) or expression
        out.append((expression, whole))
    return out


def scan(text: str | None, known: Vocabulary = DEFAULT) -> tuple[list[str], list[str], int, str]:
    """(licences, expressions, notices, verdict) of one text."""
    low = text.lower() if text else ""
    places = located(" ".join(low.split()), known)
    if not places:
        return [], [], 0, "none"
    notices = [known.notices[phrase] for _, _, phrase in places if phrase in known.notices]
    tagged = expressions(text, low, places, known) if len(notices) < len(places) else []
    if not notices and not tagged:
        return [], [], 0, "none"
    levels = [known.level(x) for x in notices]
    names = set(notices)
    for expression, whole in tagged:
        level, named = known.evaluate(expression)
        levels.append(level if whole else min(level, REVIEW))
        names.update(named)
    return sorted(names), [x for x, _ in tagged], len(notices), VERDICTS[min(levels)]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Vocabulary = DEFAULT) -> DataFrame:
    """(doc_id, licences, expressions, notices, verdict) for every row."""

    @F.arrow_udf("licences array<string>, expressions array<string>, notices int, verdict string")
    def look(texts: pa.Array) -> pa.Array:
        found = [scan(x.as_py(), known) for x in texts]
        kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string())
        columns = [pa.array([x[j] for x in found], kind) for j, kind in enumerate(kinds)]
        return shared.struct_of(dict(zip(("licences", "expressions", "notices", "verdict"), columns, strict=True)))

    return shared.plain(docs, doc_id=id_col, text=text_col).select("doc_id", look("text").alias("f")).select("doc_id", "f.*")
