"""Ordered field rules compiled into one projection.

Every rule reads the input record, never an earlier rule's output; rules sort by ``order`` (stable) and the
last writer of a target wins. A rule that does not apply to a row (null source, failed parse, index out of
range) leaves the target as it was. The whole list becomes a single ``select``.

A Custom rule takes a SQL ``expression``, or ``call``: a Python function of pandas series, one for each of the source's
comma-separated fields, whose values have the type ``returns`` (text unless stated). Nulls are passed to it and written.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import formats
from millrace.functions.columns import NUMERIC, TEMPORAL, as_text, called, field, parse_double, trimmed, type_of

RULE_TYPES = (
    "Copy", "Format", "Concatenate", "Split", "Replace", "Trim", "Uppercase", "Lowercase", "Substring",
    "DateFormat", "NumberFormat", "Round", "Floor", "Ceiling", "Conditional", "Lookup", "Calculated", "Custom",
)
_NEEDS_FORMAT = {"Format", "DateFormat", "NumberFormat"}


@dataclass(frozen=True)
class Rule:
    source: str
    target: str | None
    type: str
    format: str | None = None
    params: dict[str, str] = dc_field(default_factory=dict)
    order: int = 0

    @classmethod
    def from_dict(cls, spec: dict) -> "Rule":
        return cls(spec["source"], spec.get("target"), spec["type"], spec.get("format"),
                   dict(spec.get("params") or {}), int(spec.get("order", 0)))


class InvalidRules(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def check_rules(rules: list[Rule]) -> list[str]:
    """Problems that make a rule list unusable; empty when it is fine."""
    errors = []
    for position, rule in enumerate(rules, 1):
        label = f"rule {position} ({rule.type})"
        if rule.type not in RULE_TYPES:
            errors.append(f"{label}: unknown type")
        elif not (rule.source or "").strip():
            errors.append(f"{label}: source field is required")
        else:
            if rule.type != "Custom" and not (rule.target or "").strip():
                errors.append(f"{label}: target field is required")
            if rule.type in _NEEDS_FORMAT and not (rule.format or "").strip():
                errors.append(f"{label}: format string is required")
            if rule.type == "Custom" and not rule.params:
                errors.append(f"{label}: parameters are required")
    return errors


@dataclass
class _Write:
    """What a rule writes: a value, its type, and the rows it writes on (None = every row)."""

    value: Column
    dtype: T.DataType
    where: Column | None = None


def _int_param(params: dict[str, str], name: str, default: int) -> int:
    text = str(params.get(name, "")).strip()
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else default


def _number(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, NUMERIC):
        return value.cast("double")
    return parse_double(as_text(value, dtype))


def _split(text: Column, params: dict[str, str]) -> _Write | None:
    separator = params.get("separator", ",")
    index = _int_param(params, "index", 0)
    if index < 0:
        return None
    if separator == "":
        return _Write(text, T.StringType(), text.isNotNull()) if index == 0 else None
    part = F.get(F.split(text, re.escape(separator), -1), F.lit(index))
    return _Write(part, T.StringType(), part.isNotNull())


def _substring(text: Column, params: dict[str, str]) -> Column:
    start = max(_int_param(params, "startIndex", 0), 0)
    length = _int_param(params, "length", -1)
    if length < 0:
        return F.substring(text, start + 1, 2147483647)
    return F.substring(text, start + 1, length)


def _date_format(value: Column, dtype: T.DataType, spec: str) -> Column:
    if isinstance(dtype, TEMPORAL):
        return formats.format_date(value, spec)
    text = as_text(value, dtype)
    return F.coalesce(formats.format_date(formats.parse_timestamp(text), spec), text)


def _number_format(value: Column, dtype: T.DataType, spec: str) -> Column:
    if isinstance(dtype, NUMERIC):
        return formats.format_numeric(value, dtype, spec)
    if isinstance(dtype, TEMPORAL):
        return formats.format_date(value, spec)
    text = as_text(value, dtype)
    return F.coalesce(formats.format_numeric(_number(value, dtype), T.DoubleType(), spec), text)


def _rounded(value: Column, dtype: T.DataType, kind: str) -> _Write:
    number = _number(value, dtype)
    if kind == "Round":
        result = F.bround(number, 0)
    else:
        # a larger double is whole already, and the functions go through bigint; NaN and infinities are not below it
        whole = (F.floor if kind == "Floor" else F.ceil)(number).cast("double")
        result = F.when(F.abs(number) < float(2**53), whole).otherwise(number.cast("double"))
    if isinstance(dtype, NUMERIC):
        return _Write(result, T.DoubleType(), value.isNotNull())
    text = F.coalesce(as_text(result, T.DoubleType()), as_text(value, dtype))
    return _Write(text, T.StringType(), value.isNotNull())


_CONDITION = re.compile(r"^(==|!=|>|<|contains|startsWith|endsWith)(.*)$", re.DOTALL)


def condition(value: Column, dtype: T.DataType, text: str) -> Column:
    """Boolean column for the prefix condition language; never null."""
    match = _CONDITION.match(text)
    if not match:
        if text.strip():
            warnings.warn(f"condition {text!r} is always false", stacklevel=2)
        return F.lit(False)
    operator, operand = match[1], match[2].strip()
    if operator in "<>":
        try:
            bound = float(operand)
        except ValueError:
            warnings.warn(f"condition {text!r} has no numeric bound and is always false", stacklevel=2)
            return F.lit(False)
        number = _number(value, dtype)
        test = number > bound if operator == ">" else number < bound
    else:
        shown = as_text(value, dtype)
        test = {
            "==": lambda: shown == operand,
            "!=": lambda: shown != operand,
            "contains": lambda: shown.contains(operand),
            "startsWith": lambda: shown.startswith(operand),
            "endsWith": lambda: shown.endswith(operand),
        }[operator]()
    return F.coalesce(test, F.lit(False))


def _write(df: DataFrame, types: dict[str, T.DataType], rule: Rule) -> _Write | None:
    params = rule.params
    if rule.type == "Concatenate":
        names = [n.strip() for n in rule.source.split(",")]
        shown = [as_text(field(n), types[n]) for n in names if n in types]
        return _Write(F.concat_ws(params.get("separator", " "), *shown), T.StringType())
    if rule.type == "Custom" and params.get("call"):
        names, returns = [n.strip() for n in rule.source.split(",")], params.get("returns", "string")
        if any(n not in types for n in names):
            return None
        value = called(params["call"], [field(n) for n in names], returns)
        return _Write(value, T.StructType.fromDDL(f"x {returns}")[0].dataType)
    if rule.type == "Calculated" or (rule.type == "Custom" and params.get("expression")):
        expression = params["expression"]
        return _Write(F.expr(expression), type_of(df, expression))
    if rule.source not in types:
        return None
    value, dtype = field(rule.source), types[rule.source]
    present = value.isNotNull()
    if rule.type in ("Copy", "Custom"):
        return _Write(value, dtype)
    if rule.type == "Conditional":
        test = condition(value, dtype, params.get("condition", ""))
        chosen = F.when(test, F.lit(params.get("trueValue", ""))).otherwise(F.lit(params.get("falseValue", "")))
        return _Write(chosen, T.StringType())
    if rule.type in ("Round", "Floor", "Ceiling"):
        return _rounded(value, dtype, rule.type)
    text = as_text(value, dtype)
    if rule.type == "Split":
        return _split(text, params)
    if rule.type == "Replace":
        old = params.get("oldValue", "")
        if not old:
            return None
        return _Write(F.replace(text, F.lit(old), F.lit(params.get("newValue", ""))), T.StringType(), present)
    if rule.type in _NEEDS_FORMAT:
        build = {
            "Format": formats.composite,
            "DateFormat": lambda v, t, s: _date_format(v, t, s),
            "NumberFormat": lambda v, t, s: _number_format(v, t, s),
        }[rule.type]
        try:
            shown = build(value, dtype, rule.format)
        except formats.UnsupportedFormat as problem:
            warnings.warn(f"{rule.type} on {rule.source!r}: {problem}; the value is passed through", stacklevel=2)
            shown = text
        return _Write(shown, T.StringType(), present)
    simple = {
        "Trim": lambda: trimmed(text),
        "Uppercase": lambda: F.upper(text),
        "Lowercase": lambda: F.lower(text),
        "Substring": lambda: _substring(text, params),
    }
    return _Write(simple[rule.type](), T.StringType(), present)


def compile_rules(df: DataFrame, rules: list[Rule]) -> list[Column]:
    """Output columns (aliased) for the rule list; Lookup rules are handled by :func:`apply_rules`."""
    errors = check_rules(rules)
    if errors:
        raise InvalidRules(errors)
    types = {f.name: f.dataType for f in df.schema.fields}
    output: dict[str, tuple[Column, T.DataType]] = {n: (field(n), t) for n, t in types.items()}
    for rule in sorted(rules, key=lambda r: r.order):
        if rule.type == "Lookup":
            continue
        write = _write(df, types, rule)
        target = rule.target or None
        if write is None or target is None:
            continue
        if write.where is None:
            output[target] = (write.value, write.dtype)
        elif target not in output:
            output[target] = (F.when(write.where, write.value), write.dtype)
        else:
            kept, kept_type = output[target]
            value, dtype = write.value, write.dtype
            if kept_type != dtype:
                value, kept, dtype = as_text(value, dtype), as_text(kept, kept_type), T.StringType()
            output[target] = (F.when(write.where, value).otherwise(kept), dtype)
    return [column.alias(name) for name, (column, _) in output.items()]


def apply_rules(df: DataFrame, rules: list[Rule], lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """Transform every record by the rule list (batch or streaming).

    A Lookup rule names ``table``, ``key`` and ``value`` in its params; the table is taken from ``lookups``
    and joined once per rule, first match per key, so rows never multiply.
    """
    from millrace.operators.enrichment import lookup_value

    rules = [r if isinstance(r, Rule) else Rule.from_dict(r) for r in rules]
    errors = check_rules(rules)
    if errors:
        raise InvalidRules(errors)
    lookup_rules = [r for r in rules if r.type == "Lookup"]
    if not lookup_rules:
        return df.select(*compile_rules(df, rules))
    working, rewritten = df, []
    hidden = []
    for number, rule in enumerate(rules):
        if rule.type != "Lookup":
            rewritten.append(rule)
            continue
        hit = f"__lookup_{number}"
        hidden.append(hit)
        working = lookup_value(working, lookups[rule.params["table"]], rule.source, rule.params["key"],
                               rule.params["value"], hit)
        rewritten.append(Rule(hit, rule.target, "Copy", order=rule.order))
    return working.select(*compile_rules(working, rewritten)).drop(*hidden)
