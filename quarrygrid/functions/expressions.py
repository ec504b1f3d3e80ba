"""The expression language of calculated columns and row-keep predicates, compiled to Columns.

    "column"   'text'   12.5   true false null
    + - * / %   == != < <= > >=   and or not   condition ? a : b   if(condition, a, b)
    abs lower upper length trim string number round floor ceil sqrt exp log pow coalesce concat
    substring min2 max2 year month day hour match

`== null` and `!= null` test for null; `/` and `%` give null for a zero divisor; a condition that
is null counts as false.  Everything else is an error: nothing is handed to a SQL parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrygrid.schema import col

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|"(?P<column>(?:[^"\\]|\\.)*)"|'(?P<text>(?:[^'\\]|\\.)*)'|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|&&|\|\||[-+*/%<>?:(),!]))"""
)


class ExpressionError(ValueError):
    """The expression is not part of the language."""


class _Null:
    """The literal null, kept apart so that comparisons with it become null tests."""


NULL = _Null()


def _value(x) -> Column:
    return F.lit(None) if x is NULL else x


def _truth(x) -> Column:
    return F.coalesce(_value(x).cast("boolean"), F.lit(False))


def _compare(op: str, a, b) -> Column:
    if a is NULL or b is NULL:
        if op not in ("==", "!="):
            return F.lit(None).cast("boolean")
        other = _value(b if a is NULL else a)
        return other.isNull() if op == "==" else other.isNotNull()
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


#: name: least and most arguments, builder.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs),
    "lower": (1, 1, F.lower),
    "upper": (1, 1, F.upper),
    "length": (1, 1, F.length),
    "trim": (1, 1, F.trim),
    "string": (1, 1, lambda x: x.cast("string")),
    "number": (1, 1, lambda x: x.try_cast("double")),
    "round": (1, 1, F.round),
    "floor": (1, 1, F.floor),
    "ceil": (1, 1, F.ceil),
    "sqrt": (1, 1, F.sqrt),
    "exp": (1, 1, F.exp),
    "log": (1, 1, F.log),
    "pow": (2, 2, F.pow),
    "coalesce": (1, 99, F.coalesce),
    "concat": (1, 99, F.concat),
    "substring": (3, 3, lambda x, a, n: x.substr(a.cast("int"), n.cast("int"))),
    "min2": (2, 2, F.least),
    "max2": (2, 2, F.greatest),
    "year": (1, 1, F.year),
    "month": (1, 1, F.month),
    "day": (1, 1, F.dayofmonth),
    "hour": (1, 1, F.hour),
    "match": (2, 2, lambda x, p: F.regexp_like(x, p)),
}

#: Binding powers of infix operators.
_POWER = {"?": 1, "or": 2, "||": 2, "and": 3, "&&": 3, "==": 5, "!=": 5, "<": 6, "<=": 6, ">": 6, ">=": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8}


class _Parser:
    def __init__(self, text: str, columns: Collection[str] | None):
        self.text, self.columns, self.tokens, at = text, columns, [], 0
        while at < len(text.rstrip()):
            if not (m := _TOKEN.match(text, at)):
                raise ExpressionError(f"at {at}: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> tuple[str, str]:
        token = self.peek()
        if wanted and token[1] not in wanted or token[0] in ("text", "column") and wanted:
            raise ExpressionError(f"expected {' or '.join(wanted)}, found {token[1] or 'the end'!r} in {self.text!r}")
        self.at += 1
        return token

    def parse(self):
        out = self.expression(0)
        if self.peek()[0] != "end":
            raise ExpressionError(f"left over: {self.peek()[1]!r} in {self.text!r}")
        return out

    def expression(self, power: int):
        left = self.prefix()
        while (token := self.peek())[0] in ("op", "name") and _POWER.get(token[1], 0) > power:
            op = self.take()[1]
            if op == "?":
                a = self.expression(0)
                self.take(":")
                left = F.when(_truth(left), _value(a)).otherwise(_value(self.expression(0)))
                continue
            left = self.infix(op, left, self.expression(_POWER[op]))
        return left

    def infix(self, op: str, a, b):
        if op in ("and", "&&"):
            return _truth(a) & _truth(b)
        if op in ("or", "||"):
            return _truth(a) | _truth(b)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return _compare(op, a, b)
        a, b = _value(a), _value(b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a.cast("double"), b.cast("double")), "%": lambda: F.try_mod(a, b)}[op]()

    def prefix(self):
        kind, text = self.take()
        if kind == "number":
            return F.lit(float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", text))
        if kind == "column":
            name = re.sub(r"\\(.)", r"\1", text)
            if self.columns is not None and name not in self.columns:
                raise ExpressionError(f"no column {name!r}")
            return col(name)
        if kind == "op" and text == "(":
            out = self.expression(0)
            self.take(")")
            return out
        if kind == "op" and text == "-":
            return -_value(self.expression(9))
        if kind == "op" and text == "!" or kind == "name" and text == "not":
            return ~_truth(self.expression(4 if text == "not" else 9))
        if kind == "name" and text in ("true", "false"):
            return F.lit(text == "true")
        if kind == "name" and text == "null":
            return NULL
        if kind == "name" and (text == "if" or text in FUNCTIONS):
            return self.call(text)
        raise ExpressionError(f"unexpected {text or 'end'!r} in {self.text!r}")

    def call(self, name: str):
        self.take("(")
        args = []
        while self.peek()[1] != ")" or self.peek()[0] != "op":
            args.append(self.expression(0))
            if self.peek() == ("op", ","):
                self.take(",")
        self.take(")")
        if name == "if":
            if len(args) != 3:
                raise ExpressionError("if takes a condition and two values")
            return F.when(_truth(args[0]), _value(args[1])).otherwise(_value(args[2]))
        least, most, build = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} arguments, not {len(args)}")
        return build(*map(_value, args))


def compile_expression(text: str, columns: Collection[str] | None = None) -> Column:
    """The Column of an expression; columns: the names that it may use."""
    return _value(_Parser(text, columns).parse())


def compile_predicate(text: str, columns: Collection[str] | None = None) -> Column:
    """True where the expression is true; false where it is false or null."""
    return _truth(_Parser(text, columns).parse())
