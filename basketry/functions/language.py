"""Formulae that users write, compiled to column expressions: numbers, names, arithmetic and four functions."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {"abs": (1, 1), "min": (1, 99), "max": (1, 99), "round": (1, 2)}
MOST_NODES = 200


def names_of(text: str, allowed: set[str] | None = None) -> set[str]:
    """The names that a formula uses; a ValueError says what is wrong with it."""
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a formula: {text!r}") from e
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise ValueError("the formula is too long")
    found: set[str] = set()
    _build(tree.body, None, found)
    if allowed is not None and found - allowed:
        raise ValueError(f"unknown names: {', '.join(sorted(found - allowed))}")
    return found


def compile_formula(text: str, columns: Mapping[str, Column]) -> Column:
    """The formula over the given columns; // and % are floored, round is half to even, a null operand gives null."""
    names_of(text, set(columns))
    return _build(ast.parse(text, mode="eval").body, columns, set())


def _build(node: ast.AST, columns: Mapping[str, Column] | None, found: set[str]) -> Column | None:
    live = columns is not None

    def part(n: ast.AST) -> Column | None:
        return _build(n, columns, found)

    match node:
        case ast.Constant(value=bool() | str() | None):
            raise ValueError("only numbers are constants")
        case ast.Constant(value=int() | float() as v):
            return F.lit(float(v)) if live else None
        case ast.Name(id=name):
            found.add(name)
            return columns[name].cast("double") if live else None
        case ast.UnaryOp(op=ast.USub(), operand=x):
            value = part(x)
            return -value if live else None
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return part(x)
        case ast.BinOp(left=x, op=op, right=y):
            a, b = part(x), part(y)
            return _arithmetic(op, a, b, live)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            least, most = FUNCTIONS[name]
            if not least <= len(args) <= most:
                raise ValueError(f"{name} takes {least} to {most} values")
            if name == "round":
                digits = args[1].value if len(args) == 2 and isinstance(args[1], ast.Constant) and isinstance(args[1].value, int) else 0
                value = part(args[0])
                return F.bround(value, digits) if live else None
            values = [part(a) for a in args]
            if not live:
                return None
            if name == "abs":
                return F.abs(values[0])
            known = values[0].isNotNull()
            for v in values[1:]:
                known = known & v.isNotNull()
            pick = values[0] if len(values) == 1 else (F.least if name == "min" else F.greatest)(*values)
            return F.when(known, pick)
    raise ValueError(f"not allowed in a formula: {type(node).__name__}")


def _arithmetic(op: ast.operator, a: Column | None, b: Column | None, live: bool) -> Column | None:
    if not isinstance(op, ast.Add | ast.Sub | ast.Mult | ast.Div | ast.FloorDiv | ast.Mod | ast.Pow):
        raise ValueError(f"not allowed in a formula: {type(op).__name__}")
    if not live:
        return None
    match op:
        case ast.Add():
            return a + b
        case ast.Sub():
            return a - b
        case ast.Mult():
            return a * b
        case ast.Pow():
            return F.pow(a, b)
    over = F.nullif(b, F.lit(0.0))
    match op:
        case ast.Div():
            return a / over
        case ast.FloorDiv():
            return F.floor(a / over).cast("double")
        case _:
            return a - b * F.floor(a / over)
