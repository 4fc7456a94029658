"""Rule expressions from users or files, under guard: the parsed tree is walked against an allow list.

Only arithmetic, comparisons, logic, conditionals, casts, text and date functions of the list pass. Subqueries,
user functions, non-deterministic or unknown functions, aggregates, windows and generators are refused, and so
are columns that the table does not have. Nothing is run to find out.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.constraints import KINDS, SEVERITIES
from weft.plans.spec import Rule

#: node classes of the parsed tree that stand for themselves
NODES = {"Literal", "UnresolvedAttribute", "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "EqualTo", "EqualNullSafe",
         "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "And", "Or", "Not", "In", "IsNull", "IsNotNull", "CaseWhen", "Cast", "Like", "RLike", "Between", "If",
         "UnresolvedBetween", "Coalesce", "LikeAll", "LikeAny", "UnresolvedExtractValue"}
#: functions that may be called
FUNCTIONS = {"abs", "ceil", "ceiling", "floor", "round", "sqrt", "exp", "ln", "log", "log10", "power", "pow", "sign", "greatest", "least", "coalesce", "nullif", "nvl", "if", "isnan", "mod",
             "length", "char_length", "lower", "upper", "trim", "ltrim", "rtrim", "substring", "substr", "concat", "replace", "startswith", "endswith", "contains", "between", "isnull", "isnotnull",
             "year", "month", "day", "dayofmonth", "dayofweek", "weekday", "hour", "minute", "second", "date_add", "date_sub", "datediff", "date_diff", "add_months", "months_between", "to_date",
             "try_add", "try_subtract", "try_multiply", "try_divide", "try_cast", "try_to_timestamp", "to_timestamp", "date_trunc", "trunc", "like", "rlike", "not", "and", "or"}
ACTIONS = ("clip", "reject", "impute", "flag")


class RefusedExpression(ValueError):
    """An expression that the guard does not let through."""


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _walk(node, depth: int = 0) -> None:
    if depth > 200:
        raise RefusedExpression("the expression is nested too deeply")
    name = node.getClass().getSimpleName()
    if name == "UnresolvedFunction":
        parts = node.nameParts()
        called = parts.apply(parts.size() - 1).lower()
        if parts.size() != 1 or called not in FUNCTIONS:
            raise RefusedExpression(f"function {'.'.join(parts.apply(i) for i in range(parts.size()))} is not allowed")
        if node.isDistinct() or not node.filter().isEmpty():
            raise RefusedExpression("aggregates are not allowed")
    elif name not in NODES:
        raise RefusedExpression(f"{name} is not allowed in a rule")
    for child in _children(node):
        _walk(child, depth + 1)


_TRY = {"Add": "try_add", "Subtract": "try_subtract", "Multiply": "try_multiply", "Divide": "try_divide", "Remainder": "try_mod"}
_INFIX = {"EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "And": "AND", "Or": "OR"}
#: functions that cannot fail on a row
_SAFE = {"ceil", "ceiling", "floor", "round", "sqrt", "exp", "ln", "log", "log10", "power", "pow", "sign", "greatest", "least", "coalesce", "nullif", "nvl", "isnan", "length", "char_length", "lower",
         "upper", "trim", "ltrim", "rtrim", "substring", "substr", "concat", "replace", "startswith", "endswith", "contains", "isnull", "isnotnull", "year", "month", "day", "dayofmonth",
         "dayofweek", "weekday", "hour", "minute", "second", "datediff", "date_diff", "months_between", "try_add", "try_subtract", "try_multiply", "try_divide", "try_to_timestamp", "if"}


class _Strict(Exception):
    """A part of an expression that has no form which gives null where it fails."""


def _tolerant(node) -> str:
    name = node.getClass().getSimpleName()
    if name in ("Literal", "UnresolvedAttribute"):
        return node.sql()
    kids = _children(node)
    if name == "UnaryMinus" and kids[0].getClass().getSimpleName() == "Literal":
        return f"(- {kids[0].sql()})"
    parts = [_tolerant(k) for k in kids]
    if name in _TRY:
        return f"{_TRY[name]}({', '.join(parts)})"
    if name in _INFIX:
        return f"({parts[0]} {_INFIX[name]} {parts[1]})"
    if name == "UnaryMinus":
        return f"try_multiply({parts[0]}, -1)"
    if name == "Cast":
        return f"try_cast({parts[0]} AS {node.dataType().sql()})"
    if name == "Not":
        return f"(NOT {parts[0]})"
    if name in ("IsNull", "IsNotNull"):
        return f"({parts[0]} IS {'NOT ' if name == 'IsNotNull' else ''}NULL)"
    if name == "In":
        return f"({parts[0]} IN ({', '.join(parts[1:])}))"
    if name == "If":
        return f"if({', '.join(parts)})"
    if name == "CaseWhen":
        whens = " ".join(f"WHEN {parts[i]} THEN {parts[i + 1]}" for i in range(0, len(parts) - 1, 2))
        return f"(CASE {whens}{f' ELSE {parts[-1]}' if len(parts) % 2 else ''} END)"
    if name == "UnresolvedFunction" and node.nameParts().size() == 1 and node.nameParts().apply(0).lower() in _SAFE and not node.isDistinct():
        return f"{node.nameParts().apply(0)}({', '.join(parts)})"
    raise _Strict(name)


def null_on_failure(df: DataFrame, expression: str) -> str | None:
    """``expression`` rewritten with ``try_`` functions: null on a row where it overflows, divides by zero or casts badly.

    None if some part of it has no such form, also a text that Spark would cast by itself.
    """
    try:
        out = _tolerant(df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(expression))
        analysed = df.select(F.expr(out).alias("x"))._jdf.queryExecution().analyzed().expressions()
    except Exception:  # noqa: BLE001 - not an expression of this table, or a part without a tolerant form
        return None
    todo = [analysed.apply(i) for i in range(analysed.size())]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "Cast" and str(node.evalMode()) == "ANSI" and node.child().dataType().typeName() == "string":
            return None
        todo += _children(node)
    return out


def checked(df: DataFrame, expression: str, result: str | None = None) -> str:
    """``expression`` if it may run on rows of ``df``; raises RefusedExpression otherwise. ``result``: the type it must have."""
    try:
        tree = df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(expression)
    except Exception as e:  # noqa: BLE001 - the parser's own error, whatever its class
        raise RefusedExpression(f"not an expression: {expression!r}") from e
    _walk(tree)
    try:
        kind = df.select(F.expr(expression).alias("x")).schema["x"].dataType.simpleString()
    except (AnalysisException, ParseException) as e:
        raise RefusedExpression(f"the table does not allow {expression!r}: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e
    if result is not None and kind != result:
        raise RefusedExpression(f"{expression!r} gives {kind}, not {result}")
    return expression


def rules_of_json(df: DataFrame, text: str) -> tuple[list[Rule], list[tuple[str, str]]]:
    """(rules that ``enforce`` takes, [(name, why refused)]) from a JSON array of rule items for ``df``.

    An item has name, type, columns, severity, action and parameters (min, max, values, expression, tolerance,
    ref_table, ref_column). An unknown type is an expression rule, an unknown severity medium, an unknown action flag. Items without name or
    columns, with columns that the table lacks, or with an expression that the guard refuses, are refused, never half taken.
    """
    try:
        items = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"not JSON: {e}") from e
    good, refused = [], []
    for k, item in enumerate(items if isinstance(items, list) else [items]):
        name = str(item.get("name") or "").strip() if isinstance(item, dict) else ""
        try:
            if not name:
                raise RefusedExpression("an item without a name")
            good.append(_rule(df, name, item))
        except (RefusedExpression, TypeError, ValueError) as e:
            refused.append((name or f"item {k}", str(e)))
    return good, refused


def _rule(df: DataFrame, name: str, item: dict) -> Rule:
    def word(key: str, allowed: tuple, default: str) -> str:
        w = str(item.get(key) or "").strip().lower()
        return w if w in allowed else default

    columns = tuple(item.get("columns") or ())
    if not columns or any(c not in df.columns for c in columns):
        raise RefusedExpression(f"columns {list(columns)} are not all in the table")
    p = item.get("parameters") or {}
    kind = word("type", KINDS, "expression")
    expression = p.get("expression")
    if kind == "expression":
        expression = checked(df, str(expression), "boolean")
    elif kind == "causal":
        expression = checked(df, str(expression))
    bounds = [None if p.get(k) is None else float(p[k]) for k in ("min", "max")]
    if kind == "range" and bounds == [None, None]:
        raise RefusedExpression("a range without bounds")
    if kind == "enum" and not p.get("values"):
        raise RefusedExpression("an enum without values")
    if kind == "temporal" and len(columns) < 2:
        raise RefusedExpression("a temporal rule needs two columns")
    if kind == "referential" and not p.get("ref_table"):
        raise RefusedExpression("a referential rule needs ref_table")
    return Rule(name, kind, columns, word("action", ACTIONS, "flag"), word("severity", SEVERITIES, "medium"), bounds[0], bounds[1], tuple(p.get("values") or ()),
                expression if kind in ("expression", "causal") else None, float(p.get("tolerance", 1e-9)), p.get("ref_table"), p.get("ref_column"))
