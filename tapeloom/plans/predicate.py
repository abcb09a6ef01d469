"""The ``where`` language: text to one Catalyst expression over raw cells.

A filter has two truth values: a comparison with a blank or bad cell is false,
and its negation true.  Every leaf is therefore closed with ``coalesce(.., false)``.
Leaves read the raw cells and never raise, so the filter runs below decoding and
strict errors come only from selected columns of rows that pass.

    expression = term { "or" term }
    term       = factor { "and" factor }
    factor     = "not" factor | "(" expression ")" | comparison
    comparison = field [ "not" ] "in" "(" literal { "," literal } ")"
               | field ( "==" | "=" | "!=" | "<" | "<=" | ">" | ">=" ) ( literal | field )
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.errors import WhereError
from tapeloom.functions.values import ticks_of, unpad, whole_number
from tapeloom.sources.layouts import NUMERIC, Field, Version

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<text>'[^']*'|"[^"]*")
    | (?P<number>[0-9]+(?![A-Za-z0-9_.:]))
    | (?P<op>==|!=|<=|>=|=|<|>)
    | (?P<mark>[(),])
    | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
    )""",
    re.VERBOSE,
)
_TIME_LIKE = re.compile(r"\s*[0-9]{1,2}:[0-9]{2}")
_KEYWORDS = {"and", "or", "not", "in", "true", "false"}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Token:
    kind: str  # text, number, op, mark, word, key, end
    value: str
    at: int


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            rest = source[at:].strip()
            if _TIME_LIKE.match(rest):
                raise WhereError(f"a time must be quoted, as in '09:15:00' (at {rest[:12]!r})")
            if rest[0] in "'\"":
                raise WhereError(f"a quote is not closed: {rest[:20]!r}")
            raise WhereError(f"cannot read {rest[:20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "word" and value.lower() in _KEYWORDS:
            kind, value = "key", value.lower()
        elif kind == "text":
            value = value[1:-1]
        elif kind == "op" and value == "=":
            value = "=="
        out.append(Token(kind, value, m.start(m.lastgroup)))
        at = m.end()
    return [*out, Token("end", "", len(source))]


def _closed(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


class _Compiler:
    def __init__(self, source: str, version: Version, day: date | None, cell: Callable[[Field], Column], compat: bool):
        self.todo, self.version, self.day, self.cell, self.compat = tokens(source), version, day, cell, compat

    # Tokens
    def peek(self) -> Token:
        return self.todo[0]

    def take(self) -> Token:
        return self.todo.pop(0)

    def took(self, kind: str, value: str) -> bool:
        if (self.peek().kind, self.peek().value) == (kind, value):
            self.take()
            return True
        return False

    def expect(self, kind: str, value: str) -> None:
        if not self.took(kind, value):
            raise WhereError(f"expected {value!r}, found {self.peek().value or 'the end'!r}")

    # Grammar
    def whole(self) -> Column:
        out = self.any_of()
        if self.peek().kind != "end":
            raise WhereError(f"nothing may follow here: {self.peek().value!r}")
        return out

    def any_of(self) -> Column:
        out = self.all_of()
        while self.took("key", "or"):
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.single()
        while self.took("key", "and"):
            out = out & self.single()
        return out

    def single(self) -> Column:
        if self.took("key", "not"):
            return ~self.single()
        if self.took("mark", "("):
            out = self.any_of()
            self.expect("mark", ")")
            return out
        return self.comparison()

    def named(self, token: Token) -> Field:
        try:
            return self.version.field(token.value)
        except ValueError as e:
            raise WhereError(str(e)) from None

    def comparison(self) -> Column:
        t = self.take()
        if t.kind != "word":
            raise WhereError(f"expected a field, found {t.value or 'the end'!r}")
        left = self.named(t)
        if self.took("key", "not"):
            self.expect("key", "in")
            return ~self.membership(left)
        if self.took("key", "in"):
            return self.membership(left)
        op = self.take()
        if op.kind != "op":
            raise WhereError(f"expected a comparison after {left.name}, found {op.value or 'the end'!r}")
        right = self.take()
        if right.kind == "word":
            return self.between_fields(left, op.value, self.named(right))
        if right.kind == "key" and right.value in ("true", "false"):
            return self.flag(left, op.value, right.value == "true")
        if right.kind == "number":
            return self.with_number(left, op.value, right.value)
        if right.kind == "text":
            return self.with_text(left, op.value, right.value)
        raise WhereError(f"expected a value after {left.name} {op.value}, found {right.value or 'the end'!r}")

    # Leaves
    def text_of(self, f: Field) -> Column:
        return unpad(self.cell(f), f.pad)

    def fits(self, f: Field, text: str) -> str:
        if len(text.encode()) > f.length:
            raise WhereError(f"{text!r} is longer than {f.name}, which has {f.length} bytes")
        return text

    def membership(self, f: Field) -> Column:
        """Members are compared as text, also for numbers: zero-filled digits are not trimmed."""
        self.expect("mark", "(")
        members = []
        while True:
            t = self.take()
            if t.kind not in ("text", "number"):
                raise WhereError(f"expected a value in the list of {f.name}, found {t.value or 'the end'!r}")
            members.append(t.value)
            if not self.took("mark", ","):
                break
        self.expect("mark", ")")
        if f.type in NUMERIC and f.length > 1:
            if not self.compat:
                return _closed(whole_number(self.cell(f)).isin([int(x) for x in members]))
            warnings.warn(f"'in' compares {f.name} as text of {f.length} characters; use == for its value", stacklevel=2)
        return _closed(self.text_of(f).isin([self.fits(f, x) for x in members]))

    def with_text(self, f: Field, op: str, text: str) -> Column:
        if f.type == "jiffies":
            if self.day is None:
                raise WhereError(f"comparing {f.name} with a time needs the session date")
            try:
                ticks = ticks_of(self.day, text)
            except ValueError as e:
                raise WhereError(str(e)) from None
            return _closed(_COMPARE[op](whole_number(self.cell(f)), F.lit(ticks)))
        if op not in ("==", "!="):
            raise WhereError(f"text can be compared with == and != only, not {op}")
        return _closed(_COMPARE[op](self.text_of(f), F.lit(self.fits(f, text))))

    def with_number(self, f: Field, op: str, number: str) -> Column:
        if f.type in NUMERIC:
            if int(number) >= 1 << 63:
                raise WhereError(f"{number} is too large")
            return _closed(_COMPARE[op](whole_number(self.cell(f)), F.lit(int(number))))
        return self.with_text(f, op, number)

    def flag(self, f: Field, op: str, wanted: bool) -> Column:
        """A blank or bad flag is neither true nor false."""
        if f.type != "bool_yn":
            raise WhereError(f"{f.name} is no flag")
        if op not in ("==", "!="):
            raise WhereError(f"flags can be compared with == and != only, not {op}")
        return _closed(self.cell(f) == ("Y" if wanted == (op == "==") else "N"))

    def between_fields(self, a: Field, op: str, b: Field) -> Column:
        for f in (a, b):
            if f.type not in NUMERIC:
                raise WhereError(f"{f.name} is no number; only numbers can be compared with each other")
        if (a.scale or 0) != (b.scale or 0) or (a.type == "jiffies") != (b.type == "jiffies"):
            raise WhereError(f"{a.name} and {b.name} have different scales")
        return _closed(_COMPARE[op](whole_number(self.cell(a)), whole_number(self.cell(b))))


def compile_where(source: str | None, version: Version, day: date | None, cell: Callable[[Field], Column], compat: bool = True) -> Column | None:
    """A condition over raw cells, or None for an empty filter.

    ``cell`` gives the raw text of a field.  ``compat=False`` lets ``in`` compare numbers by value.
    """
    if source is None or not source.strip():
        return None
    return _Compiler(source, version, day, cell, compat).whole()


def check_filter(source: str, layout_id: str, day: str | date | None = None) -> bool:
    """True if a filter compiles against a layout; an error says why not."""
    from tapeloom.sources.layouts import load, parse_date

    on = parse_date(day) if day is not None else date.today()
    compile_where(source, load(layout_id).for_date(on), on, lambda f: F.col(f.name))
    return True
