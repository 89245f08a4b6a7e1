"""Arithmetic given as text, compiled into a column: a small grammar, checked before anything runs."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045, "tau": 6.283185307179586}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sqrt": F.sqrt, "abs": F.abs, "min": lambda *a: F.least(*a) if len(a) > 1 else a[0], "max": lambda *a: F.greatest(*a) if len(a) > 1 else a[0], "floor": F.floor, "ceil": F.ceil, "ln": F.ln, "log10": F.log10, "log2": F.log2, "exp": F.exp,
    "pow": F.pow, "sin": F.sin, "cos": F.cos, "tan": F.tan, "round": lambda x, n=None: F.round(x, 0 if n is None else n), "log": lambda x, base=None: F.ln(x) if base is None else F.ln(x) / F.ln(base),
}
MAX_LENGTH, MAX_EXPONENT = 500, 1000


class BadExpression(ValueError):
    """What is wrong with an expression."""


def compile_expression(text: str, names: dict[str, Column] | None = None) -> Column:
    """A column for `text`; `names` are the columns it may use. Numbers are doubles; `//` floors and `%` has the divisor's sign."""
    if len(text) > MAX_LENGTH:
        raise BadExpression("expression is too long")
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as error:
        raise BadExpression(f"can't be read: {error.msg}") from None
    return _column(tree, names or {})


def _column(node: ast.AST, names: dict[str, Column]) -> Column:
    match node:
        case ast.Constant(value=bool()):
            raise BadExpression("only numbers are allowed")
        case ast.Constant(value=int() | float() as value):
            return F.lit(float(value))
        case ast.Name(id=name) if name in names:
            return names[name].cast("double")
        case ast.Name(id=name) if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_column(x, names)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _column(x, names)
        case ast.BinOp(left=left, op=ast.Pow(), right=right):
            if isinstance(right, ast.Constant) and isinstance(right.value, int | float) and abs(right.value) > MAX_EXPONENT:
                raise BadExpression("exponent is too large")
            return F.pow(_column(left, names), _column(right, names))
        case ast.BinOp(left=left, op=op, right=right):
            a, b = _column(left, names), _column(right, names)
            if isinstance(op, ast.Div | ast.FloorDiv | ast.Mod) and isinstance(right, ast.Constant) and right.value == 0:
                raise BadExpression("division by zero")
            b_or_null = F.when(b != 0, b)
            match op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return a / b_or_null
                case ast.FloorDiv():
                    return F.floor(a / b_or_null).cast("double")
                case ast.Mod():
                    return a - b_or_null * F.floor(a / b_or_null)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS and args:
            if name == "round" and len(args) == 2:
                digits = ast.literal_eval(args[1]) if isinstance(args[1], ast.Constant) else None
                if not isinstance(digits, int):
                    raise BadExpression("round takes a whole number of digits")
                return F.round(_column(args[0], names), digits)
            return FUNCTIONS[name](*[_column(a, names) for a in args])
    raise BadExpression(f"not allowed: {type(node).__name__}")
