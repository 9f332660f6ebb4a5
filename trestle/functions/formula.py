"""Rule formulas as Spark columns.

A formula is an expression over named parameters, as rule corpora write it: Python's arithmetic, comparisons (chains too),
and/or/not, membership in lists, the functions below, `a implies b`, `${name}` for a name. It becomes one column over a map of
values, so Spark plans it like any other expression. What raises in the corpus's home language gives null here: a
missing value, a division by zero, a logarithm of nothing. A rule whose formula is null says nothing.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 1000

# The names that formulas may use besides parameters, and what they must not contain.
CONSTANTS = {"pi": math.pi, "e": math.e, "true": True, "false": False}
FORBIDDEN = [r"__", r"\bimport\b", r"\bexec\b", r"\beval\b", r"\bopen\b", r"\bfile\b", r"\bglobals\b", r"\blocals\b", r"\bgetattr\b", r"\bsetattr\b", r"\bdelattr\b", r"\blambda\b"]


class FormulaError(ValueError):
    """A text that is no formula."""


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor; null for a divisor of zero."""
    return a - b * F.floor(F.try_divide(a, b))


def _all_there(*xs: Column) -> Column:
    there = xs[0].isNotNull()
    for x in xs[1:]:
        there = there & x.isNotNull()
    return there


def _strict(f: Callable[..., Column]) -> Callable[..., Column]:
    """f where no argument is null; least and greatest skip nulls by themselves."""
    return lambda *xs: F.when(_all_there(*xs), f(*xs) if len(xs) > 1 else xs[0])


def _log(x: Column, base: Column | None = None) -> Column:
    natural = F.when(x > 0, F.ln(x))
    return natural if base is None else F.try_divide(natural, F.when(base > 0, F.ln(base)))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "min": _strict(F.least), "max": _strict(F.greatest), "abs": F.abs, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "pow": F.pow,
    "round": lambda x, n=None: F.bround(x, 0 if n is None else n), "floor": F.floor, "ceil": F.ceil, "log": _log, "log10": lambda x: F.when(x > 0, F.log10(x)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan,
}


def normalised(formula: str) -> str:
    """${a} as a, a-b between letters as a_b, and `p implies q` (binding to the right) as not (p) or (q)."""
    text = re.sub(r"\$\{\s*([^}]+?)\s*\}", r"\1", formula.strip())
    text = re.sub(r"(?<=[A-Za-z_])-(?=[A-Za-z_])", "_", text)
    first, *rest = re.split(r"\bimplies\b", text, maxsplit=1)
    return f"(not ({first.strip()})) or ({normalised(rest[0])})" if rest else text


def parsed(formula: str | None) -> ast.expr:
    if not formula or not formula.strip():
        raise FormulaError("an empty formula")
    if len(formula) > MOST:
        raise FormulaError(f"a formula of more than {MOST} characters")
    try:
        return ast.parse(normalised(formula), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(str(e)) from None


def references(formula: str, compat: bool = False) -> list[str]:
    """The parameters a formula reads, in order. compat: as some corpora count them, words within quotes and `null` included."""
    if compat:
        words = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", normalised(formula))
        skip = {"and", "or", "not", "in", "implies", "True", "False", *CONSTANTS, *FUNCTIONS}
        return list(dict.fromkeys(w for w in words if w not in skip))
    tree = parsed(formula)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    names = [(n.lineno, n.col_offset, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called]
    return list(dict.fromkeys(x for *_, x in sorted(names) if x not in CONSTANTS and x not in ("null", "None")))


def lint(formula: str) -> list[str]:
    """What is wrong with a formula: patterns it must not have, its length, its syntax."""
    found = [p for p in FORBIDDEN if re.search(p, formula)]
    if len(formula) > MOST:
        found.append("too long")
    elif not found:
        try:
            parsed(formula)
        except FormulaError as e:
            found.append(str(e))
    return found


_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: floor_mod, ast.Pow: F.pow,
}
_COMPARE = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}


def _truth(x: Column, kind: str) -> Column:
    return x if kind == "bool" else x != 0


def compiled(formula: str, value: Callable[[str], Column]) -> Column:
    """The formula's truth; null where a parameter is missing or an operation undefined. value: a parameter's double column."""

    def of(n: ast.expr) -> tuple[Column, str]:
        match n:
            case ast.Constant(value=v) if isinstance(v, bool):
                return F.lit(v), "bool"
            case ast.Constant(value=v) if isinstance(v, int | float):
                return F.lit(float(v)), "num"
            case ast.Constant(value=v) if isinstance(v, str):
                return F.lit(v), "str"
            case ast.Name(id=x) if x in CONSTANTS:
                return F.lit(CONSTANTS[x]), "bool" if isinstance(CONSTANTS[x], bool) else "num"
            case ast.Name(id=x):
                return value(x), "num"
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](of(a)[0], of(b)[0]), "num"
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -of(a)[0], "num"
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return ~_truth(*of(a)), "bool"
            case ast.BoolOp(op=op, values=xs):
                terms = [_truth(*of(x)) for x in xs]
                out = terms[0]
                for t in terms[1:]:
                    out = out & t if isinstance(op, ast.And) else out | t
                return out, "bool"
            case ast.Compare(left=a, ops=ops, comparators=bs):
                out, left = None, a
                for op, b in zip(ops, bs, strict=True):
                    if isinstance(op, ast.In | ast.NotIn):
                        x = of(left)[0].isin([of(v)[0] for v in b.elts])
                        one = ~x if isinstance(op, ast.NotIn) else x
                    else:
                        one = _COMPARE[type(op)](of(left)[0], of(b)[0])
                    out, left = one if out is None else out & one, b
                return out, "bool"
            case ast.Call(func=ast.Name(id=f), args=xs) if f in FUNCTIONS:
                return FUNCTIONS[f](*(of(x)[0] for x in xs)), "num"
        raise FormulaError(f"{ast.dump(n)[:60]} isn't part of formulas")

    tree = parsed(formula)
    truth = _truth(*of(tree))
    needed = [value(x) for x in references(formula)]
    return F.when(_all_there(*needed), truth) if needed else truth
