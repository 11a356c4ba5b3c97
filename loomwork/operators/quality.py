"""Data-quality checks: violations as rows, and all checks of a table counted in one scan."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that may stand as the constraint of an expected type.
DRIFT = ("accepted_values", "valid_range", "format")


@dataclass(frozen=True)
class Check:
    """kind: completeness, uniqueness, accepted_values, valid_range, format, referential_validity or semantic_drift.

    Drift is the constraint (one of the three kinds on values) of the type that a column is expected to have.
    """

    name: str
    kind: str
    column: str
    options: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        return asdict(self)


def safe_pattern(pattern: str) -> bool:
    """Short, without back references or look-arounds, and without a repeated group that itself repeats or chooses."""
    if len(pattern) > 256 or re.search(r"\\[1-9]|\(\?(?!:)", pattern) or len(re.findall(r"(?<!\\)[*+?{]", pattern)) > 32:
        return False
    depth, most, ambiguous, opened = 0, 0, [], []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = pattern.find("]", i + 2)
            if i < 0:
                return False
        elif c == "(":
            opened.append(False)
            depth, most = depth + 1, max(most, depth + 1)
        elif c == ")":
            if not opened:
                return False
            depth, loose = depth - 1, opened.pop()
            if loose and pattern[i + 1 : i + 2] in ("*", "+", "{"):
                ambiguous.append(i)
            if opened and loose:
                opened[-1] = True
        elif opened and (c in "*+{|" or c == "?" and pattern[i - 1] not in "(*+?}"):
            opened[-1] = True
        i += 1
    if ambiguous or most > 8 or opened:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def violation(check: Check) -> Column:
    """True on rows that violate a row-level check."""
    c, o = F.col(f"`{check.column}`"), check.options
    if check.kind == "completeness":
        return c.isNull()
    if check.kind == "accepted_values":
        if not 1 <= len(o["values"]) <= 100:
            raise ValueError("a check accepts 1 to 100 values; more belong in a table and a join")
        return c.isNotNull() & ~F.lower(c.cast("string")).isin([str(v).lower() for v in o["values"]])
    if check.kind == "valid_range":
        v = F.expr(f"try_cast(`{check.column}` as double)")
        bad = v.isNull()
        if o.get("min") is not None:
            bad = bad | (v < o["min"])
        if o.get("max") is not None:
            bad = bad | (v > o["max"])
        return c.isNotNull() & bad
    if check.kind == "format":
        if not safe_pattern(o["pattern"]):
            raise ValueError(f"unsafe pattern in check {check.name}")
        return c.isNotNull() & ~c.cast("string").rlike(rf"\A(?:{o['pattern']})\z")
    if check.kind == "semantic_drift":
        inner = dict(o["constraint"])
        kind = inner.pop("kind")
        if kind not in DRIFT:
            raise ValueError(f"{kind} is no constraint of a type")
        return violation(Check(check.name, kind, check.column, inner))
    raise ValueError(f"{check.kind} is no row-level check")


def problems(check: Check) -> list[str]:
    """What keeps a check from being run."""
    out = [] if re.fullmatch(r"[a-z][a-z0-9_]*", check.name) else ["the name is no snake_case identifier"]
    out += [] if check.column.strip() else ["a column is required"]
    kind, o = check.kind, check.options
    if kind == "semantic_drift":
        out += [] if str(o.get("expected_type") or "").strip() else ["an expected type is required"]
        o = dict(o.get("constraint") or {})
        kind = o.pop("kind", None)
        if kind not in DRIFT:
            return [*out, "a drift check needs accepted_values, valid_range or format"]
    if kind == "accepted_values" and not 1 <= len(o.get("values") or []) <= 100:
        out.append("1 to 100 values are accepted")
    if kind == "valid_range":
        low, high = o.get("min"), o.get("max")
        if low is None and high is None:
            out.append("a range needs an end")
        elif low is not None and high is not None and low > high:
            out.append("the range is empty")
    if kind == "format" and not safe_pattern(o.get("pattern") or "("):
        out.append("the pattern is unsafe")
    if kind == "referential_validity" and not (o.get("parent_table") and o.get("parent_column")):
        out.append("a parent table and column are required")
    if kind not in (*DRIFT, "completeness", "uniqueness", "referential_validity"):
        out.append("the kind is unknown")
    return out


def contract(name: str, checks: list[Check]) -> str:
    """The checks as a JSON document."""
    return json.dumps({"version": 1, "name": name, "checks": [c.to_json() for c in checks]}, indent=2)


def parse_contract(text: str) -> list[Check]:
    """The checks of such a document; a wrong one is refused with its reasons."""
    out = [Check(c["name"], c["kind"], c["column"], c.get("options") or {}) for c in json.loads(text)["checks"]]
    wrong = {c.name: p for c in out if (p := problems(c))}
    if wrong:
        raise ValueError(f"invalid checks: {wrong}")
    return out


def violations(df: DataFrame, check: Check, parent: DataFrame | None = None) -> DataFrame:
    """The violating rows; for uniqueness the repeated values with ``duplicate_count``; none means PASS."""
    if check.kind == "uniqueness":
        return df.filter(F.col(check.column).isNotNull()).groupBy(check.column).agg(F.count("*").alias("duplicate_count")).filter("duplicate_count > 1")
    if check.kind == "referential_validity":
        keys = parent.select(F.col(check.options["parent_column"]).alias("__parent"))
        return df.filter(F.col(check.column).isNotNull()).join(keys, F.col(check.column) == F.col("__parent"), "left_anti")
    return df.filter(violation(check))


def run_checks(df: DataFrame, checks: list[Check], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check_name, kind, violations, status) of all checks; all row-level ones share one scan."""
    rows = [k for k in checks if k.kind not in ("uniqueness", "referential_validity")]
    parts = []
    if rows:
        one = df.agg(*[F.count_if(violation(k)).alias(f"v{i}") for i, k in enumerate(rows)])
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(k.name).alias("check_name"), F.lit(k.kind).alias("kind"), F.col(f"v{i}").alias("violations")) for i, k in enumerate(rows)])).alias("r")).select("r.*"))
    for k in checks:
        if k not in rows:
            found = violations(df, k, (parents or {}).get(k.name))
            parts.append(found.agg(F.count("*").alias("violations")).select(F.lit(k.name).alias("check_name"), F.lit(k.kind).alias("kind"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def suggest_checks(types: dict[str, dict], table: str, associations: dict[str, tuple[str, str]] | None = None) -> list[Check]:
    """Checks that a table's column types call for: grain columns are complete and unique, value sets, ranges and formats hold, links have parents."""
    singular = table[:-1] if table.endswith("s") else table
    out = []
    for c, t in types.items():
        if c.lower() in ("id", f"{singular}_id", f"{singular}id"):
            out += [Check(f"{c}_complete", "completeness", c), Check(f"{c}_unique", "uniqueness", c)]
        if t.get("values"):
            out.append(Check(f"{c}_accepted", "accepted_values", c, {"values": list(t["values"])}))
        if t.get("min") is not None or t.get("max") is not None:
            out.append(Check(f"{c}_range", "valid_range", c, {"min": t.get("min"), "max": t.get("max")}))
        if t.get("pattern") and safe_pattern(t["pattern"]):
            out.append(Check(f"{c}_format", "format", c, {"pattern": t["pattern"]}))
        if c in (associations or {}):
            out.append(Check(f"{c}_parent", "referential_validity", c, dict(zip(("parent_table", "parent_column"), associations[c], strict=True))))
    return out
