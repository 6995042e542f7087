"""Typed metadata filters: a small language, its tree, and its translation to a Column.

SQL's three-valued logic holds: a comparison with null is neither true nor false. NOT binds tighter than
AND, AND tighter than OR; equal operators group from the left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.errors import ValidationError

OPS = {"eq": "=", "neq": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
BY_SYMBOL = {"=": "eq", "==": "eq", "!=": "neq", "<>": "neq", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


@dataclass(frozen=True)
class Compare:
    key: str
    op: str  # one of OPS, or is_null
    value: object = None


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Both:
    """``and`` or ``or`` of several filters."""

    op: str
    parts: tuple


def parse_datetime(text: str) -> datetime:
    """ISO 8601; without a zone it is UTC."""
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValidationError(f"not a datetime: {text!r}") from e
    return t if t.tzinfo else t.replace(tzinfo=UTC)


TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<op><=|>=|!=|<>|==|=|<|>)|(?P<paren>[()])|(?P<word>[A-Za-z_][\w.-]*))')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValidationError(f"filter: cannot read {text[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, word: str | None = None) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return word is None or (kind in ("word", "paren") and value.upper() == word)

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise ValidationError("filter: unexpected end")
        got, value = self.tokens[self.at]
        if kind and got != kind:
            raise ValidationError(f"filter: expected {kind}, found {value!r}")
        self.at += 1
        return value

    def chain(self, word: str, part):
        parts = [part()]
        while self.peek(word):
            self.at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else Both(word.lower(), tuple(parts))

    def either(self):
        return self.chain("OR", lambda: self.chain("AND", self.unary))

    def unary(self):
        if self.peek("NOT"):
            self.at += 1
            return Not(self.unary())
        if self.peek("("):
            self.at += 1
            inner = self.either()
            if not self.peek(")"):
                raise ValidationError("filter: missing )")
            self.at += 1
            return inner
        key = self.take("word")
        if self.peek("IS"):
            self.at += 1
            negated = self.peek("NOT")
            self.at += negated
            if not self.peek("NULL"):
                raise ValidationError("filter: IS must be followed by NULL or NOT NULL")
            self.at += 1
            return Not(Compare(key, "is_null")) if negated else Compare(key, "is_null")
        return Compare(key, BY_SYMBOL[self.take("op")], self.value())

    def value(self):
        kind, raw = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.take()
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", raw[1:-1])
        if kind == "number":
            return float(raw) if re.search(r"[.eE]", raw) else int(raw)
        if kind == "word" and raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        if kind == "word" and raw.lower() == "null":
            raise ValidationError("filter: compare with IS NULL, not with null")
        raise ValidationError(f"filter: {raw!r} is not a value")


def parse(text: str):
    """The tree of a filter string, such as ``year >= 2020 AND NOT (author = "Bob" OR rating IS NULL)``."""
    p = _Parser(text)
    if not p.tokens:
        raise ValidationError("filter: empty")
    tree = p.either()
    if p.at < len(p.tokens):
        raise ValidationError(f"filter: unexpected {p.tokens[p.at][1]!r}")
    return tree


def from_dict(d: dict):
    """The tree of the object form: {key, eq|neq|...: value} or {and|or: [..]} or {not: ..}; several operators are ANDed."""
    leaf = [k for k in d if k in OPS or k == "is_null"]
    boolean = [k for k in d if k in ("and", "or", "not")]
    if bool(leaf) == bool(boolean) or (leaf and "key" not in d) or set(d) - {"key", *leaf, *boolean}:
        raise ValidationError("filter: an object compares a key or combines filters")
    parts: list = []
    for k in leaf:
        if k != "is_null" and d[k] is None:
            raise ValidationError(f"filter: {k} needs a value")
        null = Compare(d["key"], "is_null")
        parts.append((null if d[k] else Not(null)) if k == "is_null" else Compare(d["key"], k, d[k]))
    for k in boolean:
        parts.append(Not(from_dict(d[k])) if k == "not" else Both(k, tuple(from_dict(x) for x in d[k])))
    return parts[0] if len(parts) == 1 else Both("and", tuple(parts))


def build(where):
    return None if where is None else parse(where) if isinstance(where, str) else from_dict(where) if isinstance(where, dict) else where


def _literal(kind: str, c: Compare):
    v = c.value
    if isinstance(v, dict) and set(v) == {"value", "type"}:
        v = v["value"]
    ok = {
        "string": isinstance(v, str), "integer": isinstance(v, int) and not isinstance(v, bool), "boolean": isinstance(v, bool),
        "float": isinstance(v, (int, float)) and not isinstance(v, bool), "datetime": isinstance(v, (str, datetime)),
    }[kind]
    if not ok:
        raise ValidationError(f"filter: {c.key} is {kind}, not {type(v).__name__}")
    if kind in ("string", "boolean") and c.op not in ("eq", "neq"):
        raise ValidationError(f"filter: {c.key} is {kind} and cannot be ordered")
    return (v if isinstance(v, datetime) else parse_datetime(v)) if kind == "datetime" else v


def to_column(tree, indexes: dict[str, str], two_valued: bool = False, column=lambda key: F.col(f"meta_{key}")) -> Column:
    """The Column of a tree over indexed metadata; with two_valued a comparison with null is false."""
    if isinstance(tree, Not):
        return ~to_column(tree.part, indexes, two_valued, column)
    if isinstance(tree, Both):
        out = None
        for p in tree.parts:
            c = to_column(p, indexes, two_valued, column)
            out = c if out is None else (out & c) if tree.op == "and" else (out | c)
        return out
    if tree.key not in indexes:
        raise ValidationError(f"filter: {tree.key!r} is not indexed; indexed: {', '.join(indexes) or 'nothing'}")
    col = column(tree.key)
    if tree.op == "is_null":
        return col.isNull()
    value = F.lit(_literal(indexes[tree.key], tree))
    out = {"eq": col == value, "neq": col != value, "lt": col < value, "lte": col <= value, "gt": col > value, "gte": col >= value}[tree.op]
    return F.coalesce(out, F.lit(False)) if two_valued else out


def tags_match(tags: list[str], match_all: bool, col: str = "tags") -> Column:
    wanted = F.array(*(F.lit(t) for t in dict.fromkeys(tags)))
    return F.size(F.array_except(wanted, F.col(col))) == 0 if match_all else F.arrays_overlap(F.col(col), wanted)
