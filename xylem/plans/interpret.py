"""Recursive scalar functions, evaluated by an Arrow UDF over their tree."""

from __future__ import annotations

import math
import operator
from typing import Any

from pyspark.sql import functions as F

from xylem.functions.values import SPARK, StaticError

#: Calls within calls that a recursive function may make.
DEPTH = 900
_SIGNS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "div": operator.truediv, "mod": math.fmod, "idiv": lambda a, b: int(a / b)}
_TESTS = {"=": operator.eq, "eq": operator.eq, "!=": operator.ne, "ne": operator.ne, "<": operator.lt, "lt": operator.lt, "<=": operator.le, "le": operator.le, ">": operator.gt, "gt": operator.gt, ">=": operator.ge, "ge": operator.ge}
_CALLS = {"abs": abs, "floor": math.floor, "ceiling": math.ceil, "not": operator.not_, "true": lambda: True, "false": lambda: False, "concat": lambda *a: "".join(map(str, a)), "string-length": len, "max": max, "min": min}


def evaluate(e: Any, env: dict[str, Any], functions: dict, depth: int = 0) -> Any:
    """The value of a scalar expression."""
    if depth > DEPTH:
        raise RecursionError("SE1041: too many calls")
    go = lambda x, scope=env: evaluate(x, scope, functions, depth + 1)
    op = e.op
    if op == "lit":
        return e.args[0]
    if op == "var":
        return env[e.args[0]]
    if op == "paren":
        return go(e.args[0])
    if op == "if":
        return go(e.args[1]) if go(e.args[0]) else go(e.args[2])
    if op == "arith":
        return _SIGNS[e.info["sign"]](go(e.args[0]), go(e.args[1]))
    if op in ("value", "general"):
        return _TESTS[e.info["sign"]](go(e.args[0]), go(e.args[1]))
    if op in ("and", "or"):
        return bool(go(e.args[0])) and bool(go(e.args[1])) if op == "and" else bool(go(e.args[0])) or bool(go(e.args[1]))
    if op == "neg":
        return -go(e.args[0])
    if op == "call":
        name, args = e.info["name"], [go(a) for a in e.args]
        known = functions.get((name, len(args)))
        if known:
            return go(known[1], {p: a for (p, _), a in zip(known[0], args, strict=True)})
        if name in _CALLS:
            return _CALLS[name](*args)
    raise StaticError("SE1002", f"{op} isn't possible in a recursive function")


def recursive_udf(functions: dict, name: str, arity: int, kind: tuple | None):
    """A column function that evaluates ``name``."""
    params, body, _ = functions[name, arity]
    want = SPARK.get(kind[0], "double") if kind else "double"
    if want.startswith("decimal"):
        want = "double"
    names = [p for p, _ in params]

    @F.pandas_udf(want)
    def run(*columns):
        import sys

        import pandas as pd

        sys.setrecursionlimit(20_000)
        out = []
        for row in zip(*columns, strict=True):
            if any(x is None for x in row):
                out.append(None)
                continue
            got = evaluate(body, dict(zip(names, row, strict=True)), functions)
            out.append(int(got) if want == "bigint" else got)
        return pd.Series(out)

    return run
