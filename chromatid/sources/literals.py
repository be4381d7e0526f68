"""Object literals in source text as trees, and trees as rows: what calls and exports are given, leaf by leaf.

A reader walks a literal once: objects, arrays, strings in either quote, template literals (with ``*`` for what is filled in), comments, trailing commas,
spreads. What isn't a literal (names, calls, conditions, functions) is kept as source text and told apart. Everything above that is Spark's: a leaf's row has the
keys that lead to it, so options, defaults and theme entries are filters and groupings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatid.session import measured
from chromatid.sources import files as files_

_BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
_STRING = re.compile(r"""'((?:\\.|[^'\\\n])*)'|"((?:\\.|[^"\\\n])*)\"""", re.S)
_KEY = re.compile(r"\d+\.\d+|[\w$][\w$-]*")
_ESCAPE = re.compile(r"\\(.)", re.S)
#: What ends a literal that code follows on, but for assertions of its type.
_ASSERTION = re.compile(r"(?:as|satisfies)\b")
_CODE = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|[`{}()\[\],]""", re.S)
_HOLE = re.compile(r"\\.|`|\$\{", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "\n": ""}


def _said(m: re.Match) -> str:
    """What a quoted string stands for."""
    return _ESCAPE.sub(lambda e: _ESCAPED.get(e[1], e[1]), m[1] if m[1] is not None else m[2])


class Code(str):
    """Source text of a value that isn't a literal."""


class Reader:
    """Reads one value after another from a text; ValueError where a literal never ends."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at
        self.blank()

    def blank(self) -> None:
        self.at = _BLANK.match(self.text, self.at).end()

    def sees(self, marks: str) -> bool:
        return self.at < len(self.text) and self.text[self.at] in marks

    def takes(self, mark: str) -> bool:
        if not self.sees(mark):
            return False
        self.at += 1
        self.blank()
        return True

    def value(self):
        start, out = self.at, None
        if m := _STRING.match(self.text, self.at):
            out, self.at = _said(m), m.end()
        elif self.sees("`"):
            self.at += 1
            out = self.template()
        elif self.takes("{"):
            out = self.entries()
        elif self.takes("["):
            out = []
            while not self.takes("]"):
                out.append(self.value())
                if not self.takes(",") and not self.sees("]"):
                    raise ValueError(f"open list at {start}")
        self.blank()
        if out is not None and (self.at == len(self.text) or self.sees(",:}])") or self.sees(";")):
            return out
        typed = out is not None and _ASSERTION.match(self.text, self.at)
        end = self.code()
        return out if typed else Code(self.text[start:end].strip())

    def entries(self) -> dict:
        out = {}
        while not self.takes("}"):
            if self.at >= len(self.text):
                raise ValueError("open object")
            start = self.at
            if m := _STRING.match(self.text, self.at):
                key, self.at = _said(m), m.end()
            elif m := _KEY.match(self.text, self.at):
                key, self.at = m[0], m.end()
            else:  # a spread or a computed name
                self.code(":" if self.sees("[") else "")
                key = self.text[start : self.at].strip()
            self.blank()
            if self.takes(":"):
                out[key] = self.value()
            else:  # a name for its own value, a spread or a method
                end = self.code()
                out[key] = Code(self.text[start:end].strip())
            if not self.takes(",") and not self.sees("}"):
                raise ValueError(f"open object at {start}")
        return out

    def template(self) -> str:
        """Behind the opening mark."""
        out = []
        while m := _HOLE.search(self.text, self.at):
            out.append(self.text[self.at : m.start()])
            self.at = m.end()
            if m[0] == "`":
                return "".join(out)
            if m[0] == "${":
                self.code()
                self.at += 1
            out.append("*" if m[0] == "${" else m[0][1:])
        raise ValueError("open template")

    def code(self, stop: str = "") -> int:
        """Skips code up to a comma or bracket that belongs to what is around it, or behind one of the marks to stop at; gives where it ends."""
        depth = 0
        while m := _CODE.search(self.text, self.at):
            mark = m[0]
            if mark in ",})]" and not depth:
                self.at = m.start()
                return self.at
            self.at = m.end()
            if mark == "`":
                self.template()
            elif mark in "({[":
                depth += 1
            elif mark in ")}]":
                depth -= 1
                if stop and not depth:
                    return self.at
        self.at = len(self.text)
        return self.at


def leaves(value, keys: tuple[str, ...] = ()) -> Iterator[tuple[list[str], str, bool]]:
    """(keys, text, whether it is a literal) of every leaf of a tree, in its order."""
    if isinstance(value, dict | list):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from leaves(v, (*keys, str(k)))
    else:
        yield list(keys), str(value), not isinstance(value, Code)


def arguments(text: str, at: int) -> list:
    """The values between a call's parenthesis, which opened before at, and its end."""
    reader, out = Reader(text, at), []
    while not reader.takes(")"):
        if reader.at >= len(text):
            raise ValueError("open call")
        out.append(reader.value())
        if not reader.takes(",") and not reader.sees(")"):
            raise ValueError("open call")
    return out


_LEAF = "name string, line int, argument int, seq int, keys array<string>, value string, literal boolean"


def call_leaves(files: DataFrame, call: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, errors) of declarations like ``const name = call(…)`` in files (path, content).

    Leaves are (path, name, line, argument, seq, keys, value, literal): a row for each leaf of each argument, and for each declaration one of no argument. A call that
    never ends gives that row alone.
    """
    opening = re.compile(rf"\b(?:const|let|var)\s+(\w+)\s*=\s*{re.escape(call)}\s*\(")

    def parse(path: str, content: str) -> Iterator[tuple]:
        line, at = 1, 0
        for m in opening.finditer(content or ""):
            line, at = line + content.count("\n", at, m.start()), m.start()
            yield m[1], line, None, 0, [], None, False
            try:
                given = arguments(content, m.end())
            except ValueError:
                continue
            for n, value in enumerate(given):
                for seq, leaf in enumerate(leaves(value)):
                    yield m[1], line, n, seq, *leaf

    return files_.scan(files.where(F.col("content").contains(call)), parse, _LEAF)


def export_leaves(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, errors) of the object that a file exports: ``module.exports = {…}``, ``export default {…}``, either given to a call, or a declared name."""
    opening = re.compile(r"(?:module\.exports\s*=|export\s+default)\s*(?:[\w.$]+\s*\(\s*)?(?=([\w$]+|\{))")

    def parse(path: str, content: str) -> Iterator[tuple]:
        m = opening.search(content or "")
        if m is None:
            return
        at = m.end()
        if m[1] != "{":
            named = re.search(rf"\b(?:const|let|var)\s+{re.escape(m[1])}\b[^=;]*=\s*(?:[\w.$]+\s*\(\s*)?(?=\{{)", content)
            if named is None:
                return
            at = named.end()
        for seq, leaf in enumerate(leaves(Reader(content, at).value())):
            yield "default", content.count("\n", 0, m.start()) + 1, 0, seq, *leaf

    return files_.scan(files, parse, _LEAF)


# Sections of a theme and what their tokens' names begin with.
SECTIONS = {
    "colors": "tw-", "spacing": "tw-spacing-", "boxShadow": "tw-shadow-", "dropShadow": "tw-drop-shadow-", "borderRadius": "tw-radius-", "fontFamily": "tw-font-", "fontSize": "tw-text-",
    "maxWidth": "tw-max-w-", "animation": "tw-animate-", "screens": "tw-screen-",
}
_REFERENCE = r"theme\(\s*['\"]?([\w$-]+(?:\.[\w$-]+)+)['\"]?\s*\)"


def theme_entries(leaves: DataFrame) -> DataFrame:
    """(path, key, name, value, origin) of the themes in export_leaves(): ``theme.section`` with ``theme.extend.section`` over it, lists as one value, ``DEFAULT`` as its parent's.

    An entry of ``extend`` replaces the base's of the same key; where a key is said twice within one of them, the last counts. Values that aren't literals are left out,
    but for numbers and references to other entries.
    """
    keys, extended = F.col("keys"), F.col("keys")[1] == "extend"
    at = leaves.where("keys[0] = 'theme' AND size(keys) >= 3").withColumn("extended", extended)
    at = at.withColumn("rest", F.when(extended, F.slice(keys, 3, F.size(keys))).otherwise(F.slice(keys, 2, F.size(keys)))).where("size(rest) >= 2")
    at = at.where(F.col("rest")[0].isin(list(SECTIONS)) & (F.col("literal") | F.col("value").rlike(rf"^-?[\d.]+$|{_REFERENCE}")))
    # Numbers at the end are places in a list but in scales, where they are names; sizes come with line heights, of which the size counts.
    listed = F.col("rest")[0].isin("fontFamily", "fontSize") & (F.size("rest") > 2) & F.get("rest", F.lit(2)).rlike(r"^\d+$")
    at = at.where(~(listed & (F.col("rest")[0] == "fontSize") & (F.get("rest", F.lit(2)) != "0")))
    at = at.withColumn("parts", F.filter(F.when(listed, F.slice("rest", 1, 2)).otherwise(F.col("rest")), lambda k: k != "DEFAULT"))
    place = F.when(listed, F.get("rest", F.lit(2)).cast("int")).otherwise(F.lit(0))
    name = F.concat(F.element_at(F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair]), F.col("parts")[0]), F.array_join(F.slice("parts", 2, F.size("parts")), "-"))
    at = at.select("path", "extended", F.array_join("parts", ".").alias("key"), name.alias("name"), place.alias("place"), "seq", "value")
    last = at.groupBy("path", "extended", "key", "place").agg(F.max_by(F.struct("name", "value"), "seq").alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "v.value"))), lambda p: p["value"]), ", ")
    one = last.groupBy("path", "key", "extended").agg(joined.alias("value"), F.max("v.name").alias("name"))
    best = one.groupBy("path", "key").agg(F.max(F.struct("extended", "name", "value")).alias("b"))
    return best.select("path", "key", "b.name", "b.value", F.when(F.col("b.extended"), "extend").otherwise("theme").alias("origin"))


def resolved(entries: DataFrame) -> DataFrame:
    """entries (path, key, name, value, origin) with references to other entries of the file put in, and ``state``: whole, missing (it refers to none) or cycle.

    Each round puts in the first reference of every entry whose target is settled, so the rounds grow with the longest chain; what no round settles refers to itself
    in the end.
    """
    state = F.when(F.col("value").rlike(_REFERENCE), F.lit("open")).otherwise(F.lit("whole"))
    rows = measured(entries.select("path", "key", "name", "value", "origin").withColumn("state", state))
    left = rows.where("state = 'open'").count()
    while left:
        targets = rows.select("path", F.col("key").alias("_to"), F.col("value").alias("_value"), F.col("state").alias("_state"))
        open_ = rows.where("state = 'open'").withColumn("_to", F.regexp_extract("value", _REFERENCE, 1)).join(targets, ["path", "_to"], "left")
        settled = F.col("_state") == "whole"
        # The text of the first reference is cut out by its place: a value may hold any character, so it isn't put in by a pattern.
        moved = open_.withColumn("_text", F.regexp_substr("value", F.lit(_REFERENCE))).withColumn("_at", F.expr("locate(_text, value)"))
        put = F.concat(F.expr("substr(value, 1, _at - 1)"), "_value", F.expr("substr(value, _at + char_length(_text))"))
        moved = moved.withColumn("value", F.when(settled, put).otherwise(F.col("value")))
        lost = F.col("_state").isNull() | (F.col("_state") == "missing")
        now = F.when(lost, "missing").when(settled & ~F.col("value").rlike(_REFERENCE), "whole").otherwise("open")
        moved = moved.withColumn("state", now)
        progress = moved.where(settled | lost).select(F.lit(1))
        stuck = progress.isEmpty()
        if stuck:
            break
        rows = measured(rows.where("state <> 'open'").unionByName(moved.select(rows.columns)))
        left = rows.where("state = 'open'").count()
    return rows.withColumn("state", F.when(F.col("state") == "open", "cycle").otherwise(F.col("state")))


def theme_tokens(files: DataFrame) -> DataFrame:
    """(path, key, name, value, origin, state) of the tokens of theme files (path, content): JavaScript that exports a configuration."""
    return resolved(theme_entries(export_leaves(files)[0]))
