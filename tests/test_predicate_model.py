"""Predicates as columns against a plain evaluation of their forms, row by row."""

import random
from datetime import datetime, timezone

from test_known_answers import ROWS, SCHEMA

from vulnloom.plans import predicates as P

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def when(text):
    for form in (text, text[:10]):
        try:
            t = datetime.fromisoformat(form.replace("Z", "+00:00"))
            return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    return None


def holds(form, row):
    if form.get("negate"):
        return not holds(form | {"negate": False}, row)
    if "items" in form:
        return (all if form["join"] == "and" else any)(holds(t, row) for t in form["items"])
    op, kind, x, v = form["op"], P.FIELDS[form["field"]], row[form["field"]], form["value"]
    low = lambda s: str(s).strip().lower()
    if op in ("=", "!="):
        fits = {"number": (int, float), "boolean": bool}.get(kind, str)
        same = v is None and x is None or (isinstance(v, fits) and kind != "array_string" and isinstance(v, bool) == (kind == "boolean") and x is not None and (x.strip() == v.strip() if fits is str else x == v))
        return same == (op == "=")
    if x is None:
        return op == "contains_all" and not v
    if op == "exists":
        return len(x) > 0 if kind == "array_string" else bool(x.strip()) if kind in ("string", "enum", "date") else True
    if op in (">", ">=", "<", "<="):
        if kind == "date" and isinstance(v, str):
            a, b = when(x), when(v)
        elif kind == "number" and isinstance(v, (int, float)) and not isinstance(v, bool) or kind in ("string", "enum") and isinstance(v, str):
            a, b = x, v
        else:
            return False
        return a is not None and b is not None and {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    hay = [low(i) for i in x] if kind == "array_string" else [low(x)]
    if op == "contains_any":
        return any(low(i) in hay for i in v)
    if op == "contains_all":
        return all(low(i) in hay for i in v)
    if op == "in":
        if kind == "array_string":
            return False
        if kind in ("string", "enum", "date"):
            return any(isinstance(i, str) and low(i) == low(x) for i in v)
        return any(isinstance(i, bool) == (kind == "boolean") and isinstance(i, (int, float)) and i == x for i in v)
    if kind == "array_string":
        return op == "contains" and low(v) in hay
    return {"contains": lambda a, b: b in a, "starts_with": str.startswith, "ends_with": str.endswith}[op](hay[0], low(v))


def made(rng, depth):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.3:
            return P.negated(made(rng, depth - 1))
        return rng.choice([P.all_of, P.any_of])(*[made(rng, depth - 1) for _ in range(rng.randint(2, 3))])
    field = rng.choice(NAMES)
    kind = P.FIELDS[field]
    pool = [r[NAMES.index(field)] for r in ROWS[:3]] if kind != "array_string" else ["required", "CWE-22", "dev"]
    value = lambda: rng.choice([*pool, *pool, "2024-01-01", "HIGH", 5, 2.5, True])
    op = rng.choice(["=", "!=", ">", ">=", "<", "<=", "in", "contains", "contains_any", "contains_all", "starts_with", "ends_with", "exists"])
    if kind in ("number", "boolean") and op in ("contains", "starts_with", "ends_with", "contains_any", "contains_all"):
        op = "="
    if op in ("in", "contains_any", "contains_all"):
        return P.rule(field, op, [value() for _ in range(rng.randint(1, 3))])
    return P.rule(field, op, None if op == "exists" else value() if op in ("=", "!=", ">", ">=", "<", "<=") else str(value()))


def test_random_predicates(spark):
    rng = random.Random(11)
    trees = [made(rng, 2) for _ in range(120)]
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = df.select(*[P.condition(t).alias(f"p{k}") for k, t in enumerate(trees)]).collect()
    for row, found in zip(ROWS, got, strict=True):
        record = dict(zip(NAMES, row, strict=True))
        for k, tree in enumerate(trees):
            assert found[k] == holds(tree, record), (tree, record)
