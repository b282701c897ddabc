"""Closed-form operator library: every operator is a * shape(x) + b."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import dbl

# Operator names in tie-break order, and the text each one prints.
OPERATORS = ("log", "exp", "square", "sqrt", "inverse", "sigmoid", "linear")
TEMPLATES = {
    "log": "{a}·log(|x|+1) + {b}",
    "exp": "{a}·exp(x) + {b}",
    "square": "{a}·x² + {b}",
    "sqrt": "{a}·√|x| + {b}",
    "inverse": "{a}/(|x|+ε) + {b}",
    "sigmoid": "{a}·σ(x) + {b}",
    "linear": "{a}·x + {b}",
}
EXPONENT_LIMIT = 500.0
INVERSE_EPS = 1e-6


def _bounded(x: Column) -> Column:
    return F.greatest(F.least(x, dbl(EXPONENT_LIMIT)), dbl(-EXPONENT_LIMIT))


SHAPES: dict[str, Callable[[Column], Column]] = {
    "log": lambda x: F.log(F.abs(x) + dbl(1)),
    "exp": lambda x: F.exp(_bounded(x)),
    "square": lambda x: x * x,
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "inverse": lambda x: dbl(1) / (F.abs(x) + dbl(INVERSE_EPS)),
    "sigmoid": lambda x: dbl(1) / (dbl(1) + F.exp(_bounded(-x))),
    "linear": lambda x: x,
}


def shape(name: str, x: Column) -> Column:
    """The operator's shape f(x), before slope and intercept."""
    if name not in SHAPES:
        raise ValueError(f"unknown operator {name!r}; expected one of {', '.join(OPERATORS)}")
    return SHAPES[name](x)


def apply_operator(name: str, x: Column, a: Column, b: Column) -> Column:
    return a * shape(name, x) + b


def apply_operator_column(operator: Column, x: Column, a: Column, b: Column) -> Column:
    """The same, with the operator's name in a column."""
    value = F.when(operator == OPERATORS[0], shape(OPERATORS[0], x))
    for name in OPERATORS[1:]:
        value = value.when(operator == name, shape(name, x))
    return a * value + b


def finite_or_zero(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < dbl(float("inf"))), x).otherwise(dbl(0))


def number_text(x: Column, places: int = 4) -> Column:
    """Shortest decimal text of x rounded to ``places``: 0.002, -0.0186, 1.0."""
    fixed = F.round(x, places).try_cast(f"decimal(38,{places})").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "\\.$", ".0")
    signed = F.when((trimmed == "0.0") & (x < 0), F.lit("-0.0")).otherwise(trimmed)
    return F.coalesce(signed, F.round(x, places).cast("string"))


def render(operator: Column, a: Column, b: Column) -> Column:
    """Formula text with both coefficients rounded to four places; '?' if unknown."""
    text = None
    for name in OPERATORS:
        head, rest = TEMPLATES[name].split("{a}")
        middle, tail = rest.split("{b}")
        parts = F.concat(F.lit(head), number_text(a), F.lit(middle), number_text(b), F.lit(tail))
        text = F.when(operator == name, parts) if text is None else text.when(operator == name, parts)
    return F.coalesce(text, F.lit("?"))
