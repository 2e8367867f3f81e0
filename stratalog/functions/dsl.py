"""The filter language of catalogues, compiled to a Column.

    expr    := and (OR and)*            OR, ||
    and     := not ((AND)? not)*        AND, &&, or nothing
    not     := (NOT | !) not | primary
    primary := ( expr ) | field : [op] value (, value)* | field op value | value

Fields: ext, extension, type; name, filename, path; size; modified, date, mtime.  Any other field, and a
bare value, is a pattern on name or path.  Tokens keep their text, and ``now`` is a parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import globs, paths

OPERATORS = {">": ">", "<": "<", ">=": ">=", "<=": "<=", "=": "=", "==": "=", "!=": "!="}
#: Sizes and ages in bytes and seconds.
UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "T": 1 << 40, "TB": 1 << 40}
AGES = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800, "mth": 2592000, "month": 2592000, "months": 2592000, "y": 31536000, "yr": 31536000, "years": 31536000}
#: A younger file has a larger time: comparing ages turns the operator round.
TURNED = {"<": ">=", "<=": ">=", ">": "<=", ">=": "<=", "=": "=", "!=": "!="}
_TOKEN = re.compile(r"""\s*(?:(?P<string>"[^"]*"|'[^']*')|(?P<op>>=|<=|==|!=|>|<|=)|(?P<and>&&)|(?P<or>\|\|)|(?P<punct>[:,()])|(?P<not>!)|(?P<word>[^\s:,()<>=!&|"']+(?:[!&|](?![=&|])[^\s:,()<>=!&|"']*)*))""")


class FilterError(ValueError):
    """A query that the grammar does not take."""


class Token(NamedTuple):
    kind: str
    text: str


@dataclass(frozen=True)
class All:
    def __str__(self) -> str:
        return "[MATCH_ALL]"


@dataclass(frozen=True)
class Pattern:
    text: str

    def __str__(self) -> str:
        return f"name:{self.text}"


@dataclass(frozen=True)
class Extensions:
    values: tuple[str, ...]

    def __str__(self) -> str:
        return f"ext:{','.join(self.values)}"


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: int

    def __str__(self) -> str:
        return f"{self.field}:{self.op}{self.value}"


@dataclass(frozen=True)
class Both:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Either:
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"


@dataclass(frozen=True)
class Not:
    inner: object

    def __str__(self) -> str:
        return f"NOT ({self.inner})"


def tokenize(query: str) -> list[Token]:
    out, at, text = [], 0, query.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if found is None:
            raise FilterError(f"cannot read {text[at:]!r}")
        kind, at = found.lastgroup, found.end()
        value = found[kind]
        if kind == "string":
            out.append(Token("value", value[1:-1]))
        elif kind == "word":
            out.append(Token(value.lower() if value.upper() in ("AND", "OR", "NOT") else "value", value))
        else:
            out.append(Token("op" if kind == "op" else kind if kind in ("and", "or", "not") else value, value))
    return out


def parse_size(text: str) -> int | None:
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([A-Za-z]*)\s*", text)
    unit = UNITS.get(found[2].upper()) if found else None
    return None if unit is None else int(float(found[1]) * unit)


def parse_time(text: str, op: str, now: int) -> tuple[int, str] | None:
    """Seconds and operator of an age, an epoch or a civil date (UTC)."""
    text = text.strip()
    if found := re.fullmatch(r"(\d+(?:\.\d*)?)\s*([A-Za-z]+)", text):
        unit = AGES.get(found[2].lower())
        return None if unit is None else (now - int(float(found[1]) * unit), TURNED[op])
    if re.fullmatch(r"-?\d+", text):
        return int(text), op
    if found := re.fullmatch(r"(\d{4})-(\d\d?)-(\d\d?)", text):
        try:
            return int(datetime(*map(int, found.groups()), tzinfo=UTC).timestamp()), op
        except ValueError:
            return None
    return None


class _Reader:
    def __init__(self, tokens: list[Token], now: int) -> None:
        self.tokens, self.at, self.now = tokens, 0, now

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].kind if self.at + ahead < len(self.tokens) else ""

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> object:
        left = self.both()
        while self.kind() == "or":
            self.take()
            left = Either(left, self.both())
        return left

    def both(self) -> object:
        left = self.negated()
        while self.kind() in ("and", "not", "value", "("):
            if self.kind() == "and":
                self.take()
            left = Both(left, self.negated())
        return left

    def negated(self) -> object:
        if self.kind() == "not":
            self.take()
            return Not(self.negated())
        if self.kind() == "(":
            self.take()
            inner = self.either()
            if self.kind() != ")":
                raise FilterError("missing )")
            self.take()
            return inner
        if self.kind() != "value":
            raise FilterError(f"expected a value, found {self.kind() or 'the end'}")
        word = self.take().text
        if self.kind() == ":":
            self.take()
            return self.field(word)
        if self.kind() == "op" and word.lower() in ("size", "modified", "date", "mtime"):
            return self.field(word)
        return Pattern(word)

    def field(self, name: str) -> object:
        name = name.lower()
        op = OPERATORS[self.take().text] if self.kind() == "op" else None
        values = []
        while self.kind() == "value":
            values.append(self.take().text)
            if self.kind() != ",":
                break
            self.take()
        if not values:
            raise FilterError(f"{name} needs a value")
        if name in ("ext", "extension", "type"):
            return Extensions(tuple(values))
        if name == "size":
            size = parse_size(values[0])
            if size is None:
                raise FilterError(f"{values[0]!r} is no size")
            return Compare("size", op or ">", size)
        if name in ("modified", "date", "mtime"):
            found = parse_time(values[0], op or "<", self.now)
            if found is None:
                raise FilterError(f"{values[0]!r} is no time")
            return Compare("modified", found[1], found[0])
        return Pattern(values[0])


def parse(query: str, now: int = 0) -> object:
    """The query as a tree; FilterError if it does not parse."""
    tokens = tokenize(query)
    if not tokens:
        return All()
    reader = _Reader(tokens, now)
    tree = reader.either()
    if reader.at < len(tokens):
        raise FilterError(f"left over from {tokens[reader.at].text!r}")
    return tree


def parse_leniently(query: str, now: int = 0) -> tuple[object, str | None]:
    """The tree and no warning, or the whole query as one pattern and why it did not parse."""
    try:
        return parse(query, now), None
    except FilterError as e:
        return Pattern(query.strip()), str(e)


class Columns(NamedTuple):
    path: Column
    size: Column
    mtime: Column


def condition(tree: object, on: Columns) -> Column:
    match tree:
        case All():
            return F.lit(True)
        case Pattern(text):
            if "*" in text or "?" in text:
                try:
                    regex = globs.to_regex(text, any_case=True)
                    return paths.basename(on.path).rlike(regex) | on.path.rlike(regex)
                except ValueError:
                    pass
            return F.lower(on.path).contains(text.lower())
        case Extensions(values):
            wanted = [v.removeprefix(".").lower() for v in values]
            return F.lower(paths.extension(on.path)).isin(*wanted)
        case Compare(field, op, value):
            column = on.size if field == "size" else on.mtime
            return {">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value, "=": column == value, "!=": column != value}[op]
        case Both(left, right):
            return condition(left, on) & condition(right, on)
        case Either(left, right):
            return condition(left, on) | condition(right, on)
        case Not(inner):
            return ~condition(inner, on)
    raise TypeError(tree)


def compile_query(query: str, path: str = "path", size: str = "uncompressed_size", mtime: str = "mtime_epoch", now: int = 0, lenient: bool = True) -> Column:
    """The Column of a query over an entries table."""
    tree = parse_leniently(query, now)[0] if lenient else parse(query, now)
    return condition(tree, Columns(F.col(path), F.col(size), F.col(mtime)))


def filter_entries(entries: DataFrame, query: str, now: int = 0, no_junk: bool = False, no_vcs: bool = False, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Entries that a query keeps, after junk, version-control files and paths with an ignored part are gone."""
    out = entries
    if no_junk:
        out = out.where(~paths.is_junk(F.col("path"), "entry"))
    if no_vcs:
        out = out.where(~paths.is_vcs(F.col("path")))
    for part in ignore:
        out = out.where(~F.col("path").contains(part))
    return out.where(compile_query(query, now=now))
