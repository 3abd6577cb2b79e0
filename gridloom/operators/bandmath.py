"""Band math: groups as columns, expressions in order, and back to long form."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions of the expression language by name and number of arguments.
FUNCTIONS: dict[tuple[str, int], Callable[..., Column]] = {
    **{(n, 1): getattr(F, n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "log10", "log1p", "exp", "expm1", "sqrt", "abs", "floor", "ceil")},
    **{("arc" + n, 1): getattr(F, "a" + n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh")},
    ("log", 1): F.ln,
    ("arctan2", 2): F.atan2,
}


def to_column(expr: str) -> Column:
    """An array-style expression as a column.

    Names are groups; ``+ - * / % **``, comparisons, ``& | ^ ~`` (logical between
    conditions, bitwise between whole numbers), where(condition, a, b) and FUNCTIONS,
    with Python's precedence and nesting. Division by zero gives null. Anything else
    raises a ValueError.
    """
    return _column(ast.parse(expr, mode="eval").body)[0]


def _column(node: ast.expr) -> tuple[Column, bool]:
    """The column of a node, and whether it is a condition."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float)):
        return F.lit(node.value), isinstance(node.value, bool)
    if isinstance(node, ast.Name):
        return F.col(f"`{node.id}`"), False
    if isinstance(node, ast.Attribute):  # a dotted group
        return F.col(f"`{ast.unparse(node)}`"), False
    if isinstance(node, ast.UnaryOp):
        x, condition = _column(node.operand)
        if isinstance(node.op, ast.Invert):
            return (~x, True) if condition else (F.bitwise_not(x.cast("long")), False)
        if isinstance(node.op, ast.Not):
            return ~x, True
        return (-x if isinstance(node.op, ast.USub) else x), False
    if isinstance(node, ast.BoolOp):
        parts = [_column(v)[0] for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out, True
    if isinstance(node, ast.BinOp):
        (x, logical), (y, other) = _column(node.left), _column(node.right)
        return _binary(node.op, x, y, logical and other)
    if isinstance(node, ast.Compare):
        values, out = [_column(v)[0] for v in (node.left, *node.comparators)], None
        for op, x, y in zip(node.ops, values, values[1:], strict=False):
            test = _compare(op, x, y)
            out = test if out is None else out & test
        return out, True
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        args = [_column(v)[0] for v in node.args]
        if node.func.id == "where" and len(args) == 3:
            return F.when(args[0], args[1]).otherwise(args[2]), False
        if fn := FUNCTIONS.get((node.func.id, len(args))):
            return fn(*args), False
    raise ValueError(f"cannot read {ast.unparse(node)}")


def _binary(op: ast.operator, x: Column, y: Column, logical: bool) -> tuple[Column, bool]:
    arithmetic = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: F.try_divide(x.cast("double"), y.cast("double")), ast.Mod: lambda: F.try_mod(x, y), ast.Pow: lambda: F.pow(x, y)}
    if type(op) in arithmetic:
        return arithmetic[type(op)](), False
    bits = {ast.BitAnd: (lambda: x & y, lambda a, b: a.bitwiseAND(b)), ast.BitOr: (lambda: x | y, lambda a, b: a.bitwiseOR(b)), ast.BitXor: (lambda: x != y, lambda a, b: a.bitwiseXOR(b))}
    if type(op) in bits:
        between, whole = bits[type(op)]
        return (between(), True) if logical else (whole(x.cast("long"), y.cast("long")), False)
    raise ValueError(f"cannot read operator {type(op).__name__}")


def _compare(op: ast.cmpop, x: Column, y: Column) -> Column:
    known = {ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y, ast.Eq: lambda: x == y, ast.NotEq: lambda: x != y}
    if type(op) not in known:
        raise ValueError(f"cannot read operator {type(op).__name__}")
    return known[type(op)]()


def to_wide(cube: DataFrame, groups: list[str]) -> DataFrame:
    """A column for each group; rows without dates take no part."""
    return cube.where("start_date IS NOT NULL").groupBy("px", "start_date", "end_date").pivot("grp", groups).agg(F.first("value"))


def to_long(wide: DataFrame, groups: list[str]) -> DataFrame:
    return wide.unpivot(["px", "start_date", "end_date"], [F.col(f"`{g}`").cast("double").alias(g) for g in groups], "grp", "value").select("px", "grp", "start_date", "end_date", "value")


def calc(cube: DataFrame, groups: list[str], expressions: dict[str, str], mask_group: str | None = None, mask_values: list[float] | None = None) -> DataFrame:
    """Adds (or overwrites) groups by expressions, which may use earlier ones. Where mask_group has one of mask_values all other groups become null."""
    wide = to_wide(cube, groups)
    if mask_group:
        hidden = F.coalesce(F.col(f"`{mask_group}`").isin(mask_values or []), F.lit(False))
        wide = wide.withColumns({g: F.when(~hidden, F.col(f"`{g}`")) for g in groups if g != mask_group})
    for name, expr in expressions.items():
        wide = wide.withColumn(name, to_column(expr).cast("double"))
    return to_long(wide, list(dict.fromkeys([*groups, *expressions])))


def map_groups(cube: DataFrame, groups: list[str], fn: Callable[[dict], dict], out: list[str]) -> DataFrame:
    """A vectorised function of group arrays (dict to dict) over batches; ``out`` names its results."""
    wide = to_wide(cube, groups)
    names = list(dict.fromkeys([*groups, *out]))
    schema = "px long, start_date date, end_date date, " + ", ".join(f"`{n}` double" for n in names)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for name, values in fn({g: pdf[g].to_numpy() for g in groups}).items():
                pdf[name] = values
            yield pdf[["px", "start_date", "end_date", *names]]

    return to_long(wide.withColumn("px", F.col("px").cast("long")).mapInPandas(run, schema), names)
