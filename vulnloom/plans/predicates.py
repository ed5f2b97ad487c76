"""Predicates over workbench rows: a filter form as a Catalyst column.

    all_of(rule("severity", "in", ["critical", "high"]), any_of(rule("kev", "=", True), rule("risk_score", ">=", 60)), negated(rule("cwe", "contains", "CWE-79")))

A form is what a filter dialog holds: rules {"field", "op", "value", "negate"} and groups {"join", "items", "negate"}.
Operators are ``= != > >= < <=``, ``contains``, ``starts_with``, ``ends_with``, ``in``, ``contains_any``, ``contains_all`` and
``exists``.  Logic is two-valued: a comparison with a missing value does not hold (but ``!=`` does), so its negation does.
Text is trimmed; ``=`` minds case, the textual operators do not.  A field's declared kind decides how it is compared;
a comparison that its kind does not allow never holds.  Dates compare as UTC times.

There is no text language: a form becomes a column, which Catalyst may push through the query that makes the rows.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of workbench rows with their kinds, and the operators that a form offers for each kind.
FIELDS = {
    "project": "string",
    "vuln_id": "string",
    "internal_id": "string",
    "language": "string",
    "package_manager": "string",
    "severity": "enum",
    "reachability_verdict": "enum",
    "cvss": "number",
    "epss": "number",
    "risk_score": "number",
    "fix_versions_count": "number",
    "component_count": "number",
    "closest_depth": "number",
    "published_days_ago": "number",
    "modified_days_ago": "number",
    "call_locations_count": "number",
    "kev": "boolean",
    "is_reachable": "boolean",
    "is_runtime": "boolean",
    "fix_available": "boolean",
    "published": "date",
    "modified": "date",
    "fix_versions": "array_string",
    "all_components": "array_string",
    "all_component_ids": "array_string",
    "all_scopes": "array_string",
    "cwe": "array_string",
    "call_locations": "array_string",
}
OPERATORS = {
    "string": ("=", "!=", "contains", "starts_with", "ends_with", "in", "exists"),
    "enum": ("=", "!=", "in", "exists"),
    "number": ("=", "!=", ">", ">=", "<", "<=", "in", "exists"),
    "boolean": ("=", "!=", "exists"),
    "date": ("=", "!=", ">", ">=", "<", "<=", "exists"),
    "array_string": ("contains", "contains_any", "contains_all", "exists"),
}


def rule(field: str, op: str, value: Any = None) -> dict:
    return {"field": field, "op": op, "value": value}


def all_of(*items: dict) -> dict:
    return {"join": "and", "items": list(items)}


def any_of(*items: dict) -> dict:
    return {"join": "or", "items": list(items)}


def negated(item: dict) -> dict:
    return item | {"negate": not item.get("negate", False)}


def condition(form: dict, fields: dict[str, str] = FIELDS) -> Column:
    """The form as a boolean column that is never null; an empty group holds if all its (no) items must."""
    if "items" in form:
        conjunction = form.get("join", "and") == "and"
        out = F.lit(conjunction)
        for part in (condition(x, fields) for x in form["items"]):
            out = out & part if conjunction else out | part
    else:
        out = F.coalesce(_leaf(form, fields.get(form["field"])), F.lit(False))
    return ~out if form.get("negate") else out


def where(df: DataFrame, form: dict, fields: dict[str, str] = FIELDS) -> DataFrame:
    return df.filter(condition(form, fields))


def _as_time(c: Column) -> Column:
    return F.coalesce(c.try_cast("timestamp"), F.substring(c, 1, 10).try_cast("timestamp"))


def _text(value: Any) -> str | None:
    return {True: "true", False: "false"}.get(value, str(value)).strip() if value is not None else None


def _same(field: str, kind: str | None, value: Any) -> Column:
    """Equality that takes missing as a value."""
    if kind is None:
        return F.lit(value is None)
    col = F.col(field)
    if value is None:
        return col.isNull()
    if kind in ("string", "enum", "date"):
        return F.trim(col).eqNullSafe(F.lit(value.strip())) if isinstance(value, str) else F.lit(False)
    if kind == "boolean":
        return col.eqNullSafe(F.lit(value)) if isinstance(value, bool) else F.lit(False)
    if kind == "number" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double")).eqNullSafe(F.lit(float(value)))
    return F.lit(False)


def _leaf(rule: dict, kind: str | None) -> Column:
    col, op, value = F.col(rule["field"]), rule["op"], rule.get("value")
    if op in ("contains_any", "contains_all") and not isinstance(value, (list, tuple)):
        value = [value]
    if op == "=":
        return _same(rule["field"], kind, value)
    if op == "!=":
        return ~_same(rule["field"], kind, value)
    if kind is None:
        return F.lit(op == "contains_all" and not value)
    if op == "exists":
        return F.size(col) > 0 if kind == "array_string" else F.length(F.trim(col)) > 0 if kind in ("string", "enum", "date") else col.isNotNull()
    if op in (">", ">=", "<", "<="):
        return _ordered(col, kind, op, value)
    low = lambda c: F.lower(F.trim(c))
    if op in ("contains_any", "contains_all"):
        needles = F.array(*[F.lit((_text(v) or "").lower()) for v in value]).cast("array<string>")
        hay = F.transform(col, low) if kind == "array_string" else F.array(low(col.cast("string")))
        hay = F.coalesce(hay, F.array().cast("array<string>"))
        return F.arrays_overlap(hay, needles) if op == "contains_any" else F.size(F.array_except(needles, hay)) == 0
    if op == "in":
        if kind == "array_string":
            return F.lit(False)
        if kind in ("string", "enum", "date"):
            return low(col).isin([v.strip().lower() for v in value if isinstance(v, str)])
        wanted = [v for v in value if isinstance(v, bool) == (kind == "boolean") and isinstance(v, (int, float))]
        return col.isin(wanted) if wanted else F.lit(False)
    needle = (_text(value) or "").lower()
    if kind == "array_string":
        return F.exists(col, lambda x: low(x) == needle) if op == "contains" else F.lit(False)
    hay = low(col.cast("string"))
    return {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[op](hay, F.lit(needle))


def _ordered(col: Column, kind: str, op: str, value: Any) -> Column:
    if kind == "date" and isinstance(value, str):
        a, b = _as_time(col), _as_time(F.lit(value))
    elif kind == "number" and isinstance(value, (int, float)) and not isinstance(value, bool):
        a, b = F.nanvl(col.cast("double"), F.lit(None).cast("double")), F.lit(float(value))
    elif kind in ("string", "enum") and isinstance(value, str):
        a, b = F.trim(col), F.lit(value.strip())
    else:
        return F.lit(False)
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def quoted(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return str(value)
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def text_of(node: dict, root: bool = True) -> str:
    """The form as text, to be shown."""
    if "items" in node:
        parts = [text_of(x, False) for x in node["items"]]
        body = f" {node.get('join', 'and').upper()} ".join(p for p in parts if p)
        body = f"({body})" if body and (not root or node.get("negate")) else body
    else:
        value = node.get("value")
        shown = "" if node["op"] == "exists" else " (" + ", ".join(map(quoted, value)) + ")" if isinstance(value, (list, tuple)) else " " + quoted(value)
        body = f"{node['field']} {node['op']}{shown}"
        body = f"({body})" if node.get("negate") else body
    return f"NOT {body}" if node.get("negate") and body else body


def faults(node: dict) -> list[str]:
    """What is wrong with a form: unknown fields, operators that a field's kind does not have, empty groups."""
    if "items" in node:
        return (["a group is empty"] if not node["items"] else []) + [x for i in node["items"] for x in faults(i)]
    kind = FIELDS.get(node.get("field"))
    if kind is None:
        return [f"unknown field {node.get('field')!r}"]
    return [] if node.get("op") in OPERATORS[kind] else [f"{node['field']} does not take {node.get('op')!r}"]


SORTS = ("risk_score", "published", "cvss", "project", "severity", "closest_depth")


def sorted_by(df: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """Rows by a sort key of the workbench; missing numbers are -1, missing texts ''."""
    if key == "severity":
        order = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    else:
        order = F.coalesce(F.col(key), F.lit(-1) if FIELDS.get(key) == "number" else F.lit(""))
    return df.orderBy(order.desc() if descending else order.asc(), "project", "vuln_id")
