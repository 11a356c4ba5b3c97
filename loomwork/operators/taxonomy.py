"""Column classification: all detectors' hit ratios of a column in one aggregate.

A semantic type has weighted detectors on the header and on the values.  The ratios
come from one scan of each column of the (sampled or whole) table; the weighted means and the choice
are a few numbers on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SemanticType:
    id: str
    role: str  # entity, dimension, measure or metric
    sensitivity: str  # public, pii, financial or secret
    headers: tuple[str, ...] = ()
    pattern: str | None = None
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    checksum: str | None = None
    families: tuple[str, ...] = ("string", "numeric", "temporal", "boolean")
    header_weight: float = 0.4
    floor: float = 0.5


#: Types with known behaviour, re-authored from public formats.
TYPES: tuple[SemanticType, ...] = (
    SemanticType("email", "dimension", "pii", ("email", "contact_email", "email_address"), r"[^@\s]+@[^@\s]+\.[^@\s]+", families=("string",)),
    SemanticType("uuid", "entity", "public", ("uuid", "guid"), r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", families=("string",)),
    SemanticType("url", "dimension", "public", ("url", "link", "page_url", "website"), r"(?i)https?://\S+", families=("string",)),
    SemanticType("iso_date", "dimension", "public", ("date", "day"), r"\d{4}-\d{2}-\d{2}", families=("string", "temporal")),
    SemanticType("iso_datetime", "dimension", "public", ("timestamp", "ts", "datetime", "event_timestamp"), r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*", families=("string", "temporal")),
    SemanticType("gstin", "entity", "financial", ("gstin", "gst_no", "vendor_gstin"), r"\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z]", checksum="gstin", families=("string",)),
    SemanticType("pan", "entity", "financial", ("pan", "pan_no"), r"[A-Z]{5}\d{4}[A-Z]", families=("string",)),
    SemanticType("iban", "entity", "financial", ("iban", "account_iban"), r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", checksum="iban", families=("string",)),
    SemanticType("log_level", "dimension", "public", ("level", "log_level", "severity"), values=("debug", "info", "warn", "warning", "error", "fatal", "trace"), families=("string",)),
    SemanticType("event_name", "dimension", "public", ("event_name", "event_type", "event"), r"[A-Za-z][\w .:-]{1,63}", families=("string",)),
    SemanticType("user_id", "entity", "pii", ("user_id", "userid", "uid", "customer_id", "custkey"), r"\S{1,64}"),
    SemanticType("amount", "measure", "financial", ("amount", "total", "total_amount", "price", "totalprice", "extendedprice", "value", "balance", "acctbal"), low=-1e12, high=1e12, families=("numeric", "string")),
    SemanticType("quantity", "measure", "public", ("quantity", "qty", "units"), low=0, high=1e9, families=("numeric", "string")),
    SemanticType("percentage", "metric", "public", ("percent", "percentage", "rate", "discount", "tax"), low=0, high=100, families=("numeric", "string")),
    SemanticType("http_status", "dimension", "public", ("status", "http_status", "status_code"), low=100, high=599, families=("numeric", "string")),
    SemanticType("duration_ms", "metric", "public", ("duration_ms", "latency_ms", "elapsed_ms"), low=0, high=1e9, families=("numeric", "string")),
    SemanticType("currency_iso", "dimension", "public", ("currency", "currency_code"), values=("usd", "eur", "gbp", "inr", "jpy", "cny", "chf", "aud", "cad"), families=("string",)),
    SemanticType("country_name", "dimension", "public", ("country", "nation", "country_name"), r"[A-Z][A-Za-z .'-]{2,50}", families=("string",)),
    SemanticType("sku", "entity", "public", ("sku", "part_no", "item_code"), r"[A-Z0-9]{2,}(?:-[A-Z0-9]+)+", families=("string",)),
    SemanticType("vendor_name", "dimension", "public", ("vendor_name", "supplier", "vendor"), r".{2,120}", families=("string",)),
)


def header_score(name: str, headers: tuple[str, ...]) -> float:
    """1 equal, 0.95 equal without separators, 0.85 all words of a known name, 0.65 as whole words in a row that spell it (three signs at least)."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()) if w]
    runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    best = 0.0
    for known in headers:
        other = known.split("_")
        if words == other:
            return 1.0
        if "".join(words) == "".join(other):
            best = max(best, 0.95)
        elif set(other) <= set(words):
            best = max(best, 0.85)
        elif len("".join(other)) >= 3 and "".join(other) in runs:
            best = max(best, 0.65)
    return best


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "boolean" if isinstance(kind, T.BooleanType) else "string"


#: Every text that casts to a double: a decimal or hexadecimal number, infinity or NaN, between blanks.
_NUMBER = r"\A[\x00-\x20]*[+-]?(?:[0-9]*\.?[0-9]*(?:[eE][+-]?[0-9]+)?[dDfF]?|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?[0-9]+[dDfF]?|(?i:inf(?:inity)?|nan))[\x00-\x20]*\z"

_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checksum_ok(c: Column, kind: str) -> Column:
    """GST numbers (base 36, weights 1 and 2) and IBANs (remainder 1 of 97), in expressions."""
    sign = lambda s: F.instr(F.lit(_SIGNS), s) - 1
    if kind == "gstin":
        digits = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: sign(F.substring(c, i, F.lit(1))) * F.when(i % 2 == 1, 1).otherwise(2))
        total = F.aggregate(digits, F.lit(0), lambda s, x: s + F.floor(x / 36).cast("int") + (x % 36).cast("int"))
        return (F.length(c) == 15) & (F.pmod(F.lit(36) - total % 36, F.lit(36)) == sign(F.substring(c, 15, 1)))
    turned = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, x: F.when(x == "", s).otherwise((F.when(sign(x) > 9, s * 100).otherwise(s * 10) + sign(x)) % 97))
    return F.length(c).between(15, 34) & (rest == 1)


def _ratios(t: SemanticType, c: Column) -> list[tuple[float, Column]]:
    """(weight, hit ratio) of a type's value detectors."""
    text = F.nullif(c.cast("string"), F.lit(""))
    short = F.substring(text, 1, 512)
    share = lambda hit: F.avg(F.when(text.isNotNull(), F.coalesce(hit, F.lit(False)).cast("double")))
    out = []
    if t.pattern:
        out.append((0.6 if not t.checksum else 0.35, share(short.rlike(rf"\A(?:{t.pattern})\z"))))
    if t.checksum:
        out.append((0.3, share(checksum_ok(short, t.checksum))))
    if t.values:
        out.append((0.6, share(F.lower(short).isin(*t.values))))
    if t.low is not None:
        v = F.when(text.rlike(_NUMBER), text.try_cast("double"))  # a failing cast costs an exception
        out.append((0.6, F.coalesce(F.avg(v.between(t.low, t.high).cast("double")), F.lit(0.0))))
    return out


def distribution(df: DataFrame, column: str, high_cardinality: bool = False, low_cardinality: bool = False, numeric: bool = False, min_length: int | None = None, max_length: int | None = None) -> DataFrame:
    """One row (column_name, score): the product of what is asked of the non-null values; null without values.

    Distinct share: over 0.8 (high) or under 0.1 (low) counts 1, over 0.5 or under 0.3 0.6, else 0.2; then the
    share of numbers among non-blank values, and the share of lengths within the bounds.
    """
    text = F.col(f"`{column}`").cast("string")
    distinct = F.count_distinct(text) / F.nullif(F.count(text), F.lit(0))
    score = F.lit(1.0)
    if high_cardinality:
        score = score * F.when(distinct > 0.8, 1.0).when(distinct > 0.5, 0.6).otherwise(0.2)
    if low_cardinality:
        score = score * F.when(distinct < 0.1, 1.0).when(distinct < 0.3, 0.6).otherwise(0.2)
    if numeric:
        score = score * F.coalesce(F.avg(F.when(F.trim(text) != "", text.try_cast("double").isNotNull().cast("double"))), F.lit(0.0))
    if min_length is not None or max_length is not None:
        fits = F.length(text) >= (min_length or 0)
        if max_length is not None:
            fits = fits & (F.length(text) <= max_length)
        score = score * F.avg(fits.cast("double"))
    return df.agg(F.when(F.count(text) > 0, score).alias("score")).select(F.lit(column).alias("column_name"), "score")


def user_types(made: list[dict], types: tuple[SemanticType, ...] = TYPES) -> tuple[SemanticType, ...]:
    """The types with a user's own (id, pattern, headers) added: pattern 0.6, header 0.4, floor 0.5; a known id keeps its meaning."""
    known = {t.id for t in types}
    out = list(types)
    for m in made:
        if m["id"] in known:
            continue
        re.compile(m["pattern"])
        known.add(m["id"])
        out.append(SemanticType(m["id"], m.get("role", "dimension"), m.get("sensitivity", "public"), tuple(m.get("headers", ())), m["pattern"]))
    return tuple(out)


def classify(df: DataFrame, types: tuple[SemanticType, ...] = TYPES, overrides: dict[str, str] | None = None) -> list[dict]:
    """For each column: type, confidence, status (accepted, ambiguous, unknown, override), role, sensitivity; one aggregate for each column."""
    asked, row = [], []
    for f in df.schema:
        aggs = []
        for t in types:
            if _family(f.dataType) in t.families:
                ratios = _ratios(t, F.col(f"`{f.name}`"))
                asked.append((f.name, t, [w for w, _ in ratios], len(row) + len(aggs)))
                aggs += [r for _, r in ratios]
        # An aggregate for each column reads that column only and stays within what Spark compiles; one for all is interpreted.
        row += list(df.agg(*[a.alias(f"r{i}") for i, a in enumerate(aggs)]).first()) if aggs else []
    scored: dict[str, list[tuple[float, SemanticType]]] = {c: [] for c in df.columns}
    for name, t, weights, at in asked:
        parts = [(t.header_weight, header_score(name, t.headers))] + [(w, row[at + k] or 0.0) for k, w in enumerate(weights)]
        confidence = sum(w * s for w, s in parts) / sum(w for w, _ in parts)
        if confidence >= t.floor:
            scored[name].append((confidence, t))
    by_id, out = {t.id: t for t in types}, []
    for name, found in scored.items():
        found.sort(key=lambda x: (-x[0], x[1].id))
        strong = [x for x in found if x[0] >= 0.9]
        fair = [x for x in found if x[0] >= 0.7]
        if overrides and name in overrides:
            chosen, status, confidence = by_id.get(overrides[name]), "override", 1.0
        elif len(strong) == 1:
            chosen, status, confidence = strong[0][1], "accepted", strong[0][0]
        elif len(fair) > 1:
            chosen, status, confidence = fair[0][1], "ambiguous", fair[0][0]
        elif fair:
            chosen, status, confidence = fair[0][1], "accepted", fair[0][0]
        else:
            chosen, status, confidence = None, "unknown", 0.0
        out.append({"column": name, "type": chosen and chosen.id, "confidence": confidence, "status": status, "role": chosen and chosen.role, "sensitivity": chosen and chosen.sensitivity})
    return out


def sample(df: DataFrame, n: int = 1000, seed: int = 7) -> DataFrame:
    """Half head, half drawn at random, for a quick classification; ``classify`` also takes the whole table."""
    return df.limit(n // 2).unionByName(df.orderBy(F.rand(seed)).limit(n - n // 2))


def wide_sample_nulls(df: DataFrame) -> DataFrame:
    """Null share of every column with '' counted as null, in one pass, as rows."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).isNull().alias("empty")) for c in df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("r")).groupBy(F.col("r.column_name").alias("column_name")).agg(F.avg(F.col("r.empty").cast("double")).alias("null_share"))
