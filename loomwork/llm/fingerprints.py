"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of
two.  So equal multisets of paragraphs have equal fingerprints in any order,
and a paragraph is added or taken away by one addition or subtraction.

The vector has two blocks:

* 8 lanes modulo 2**64, the paragraph's 512-bit BLAKE2b digest.  They decide
  equality: finding two multisets with one sum is as hard as a generalised
  birthday problem over 512 bits.
* 256 lanes modulo 2**16, in which each word pair of the paragraph adds +1 or
  -1 to one lane.  Inner products of these sums estimate how many word pairs
  two documents share; ``likeness`` is their cosine, cut to 0 .. 1.

Defined cases: null text is the empty text; the empty text has no paragraph and
the zero fingerprint; two empty texts have likeness 1, an empty and another 0.
A text whose lanes pass 2**15 wraps around: equality holds, likeness is then
only an estimate.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

common.by_value(__name__)

STRONG, LANES = 8, 256
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks of the sums over each text's paragraphs: (n, 8) uint64 and (n, 256) uint16."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    digests, owner = bytearray(), []
    for i, text in enumerate(raw):
        for paragraph in text.split(b"\n"):
            if paragraph:
                digests += hashlib.blake2b(paragraph).digest()
                owner.append(i)
    strong = np.zeros((len(raw), STRONG), dtype=np.uint64)
    if owner:
        np.add.at(strong, np.array(owner), np.frombuffer(bytes(digests), dtype="<u8").reshape(-1, STRONG))

    bounds = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in raw], out=bounds[1:])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts, ends, by_text = common.word_spans(data, bounds)
    soft = np.zeros((len(raw), LANES), dtype=np.int64)
    if len(starts):
        words = common.span_hash(common.prefix_hash(data), starts, ends)
        text_of = np.repeat(np.arange(len(raw)), np.diff(by_text))
        line_of = np.cumsum(data == 10)[starts]
        follows = (text_of[1:] == text_of[:-1]) & (line_of[1:] == line_of[:-1])
        alone = np.ones(len(words), dtype=bool)  # a paragraph's only word stands for itself
        alone[1:] &= ~follows
        alone[:-1] &= ~follows
        pairs = common.mix(words[:-1] * _PAIR + words[1:])[follows]
        items = np.concatenate([pairs, common.mix(words[alone])])
        rows = np.concatenate([text_of[1:][follows], text_of[alone]])
        lane = rows * LANES + (items % np.uint64(LANES)).astype(np.int64)
        sign = np.where(items >> np.uint64(63), 1.0, -1.0)
        soft = np.bincount(lane, weights=sign, minlength=len(raw) * LANES).astype(np.int64).reshape(-1, LANES)
    return strong, (soft & 0xFFFF).astype(np.uint16)


def encode(strong: np.ndarray, soft: np.ndarray) -> str:
    return base64.b64encode(strong.astype("<u8").tobytes() + soft.astype("<u2").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * STRONG], dtype="<u8"), np.frombuffer(raw[8 * STRONG :], dtype="<u2")


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of both texts' paragraphs together; sign -1 takes b's away."""
    (s, t), (u, v) = decode(a), decode(b)
    return encode(s + u, t + v) if sign > 0 else encode(s - u, t - v)


def fingerprint(text: str | None) -> str:
    strong, soft = vectors([text or ""])
    return encode(strong[0], soft[0])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of two (n, 256) blocks, 0 .. 1."""
    x, y = a.astype(np.int16).astype(np.float64), b.astype(np.int16).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    equal = (a == b).all(1)
    dot = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where(equal, 1.0, np.clip(dot, 0.0, 1.0))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else the cosine of their second blocks."""
    if a == b:
        return 1.0
    return float(cosine(decode(a)[1][None], decode(b)[1][None])[0])


def fingerprint_documents(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``fingerprint``, one row per row of ``docs``; no shuffle."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "fingerprint string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("__text").to_pylist(), []
            for part in _portions(texts):
                strong, soft = vectors(part)
                out += [encode(s, t) for s, t in zip(strong, soft, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "fingerprint"])

    return rows.mapInArrow(run, schema)


def _portions(items: list, size=len, limit: int = common.CHUNK_BYTES) -> Iterator[list]:
    part, total = [], 0
    for x in items:
        part.append(x)
        total += size(x)
        if total >= limit:
            yield part
            part, total = [], 0
    if part:
        yield part


def edited_text(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the following text's first as many."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edit by the next document's head, and compare.

    The next document is the one with the next smaller id (the largest follows the
    smallest).  Ids are cut into ranges at exact stated bounds; each range also gets
    the head row of the range that follows it, so one shuffle of the texts is enough
    and no task sees more than its range.  Rows with one id follow each other by
    their texts' hash; null ids come last.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("__key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"),
    )
    # Range bounds: as many as there are shuffle partitions, a bounded table.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("__key", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.expr("array()").cast("array<bigint>")
    rows = rows.withColumn("__range", F.size(F.filter(bounds, lambda c: c < F.col("__key"))))
    heads = {r[0]: r[1] for r in rows.groupBy("__range").agg(F.max("__key")).collect()}  # a row for each range
    order = sorted(heads, reverse=True)
    follows = {heads[b]: a for a, b in zip(order, order[1:] + order[:1], strict=True)}  # head of b also goes to a
    if follows:
        guest_of = F.create_map(*[x for k, v in follows.items() for x in (F.lit(k).cast("long"), F.lit(v))])
        copies = F.when(
            F.col("__key").isin(list(follows)),
            F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g")), F.struct(guest_of[F.col("__key")].alias("r"), F.lit(1).alias("g"))),
        ).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g"))))
        rows = rows.withColumn("__to", F.explode(copies)).select("doc_id", "__key", "__text", F.col("__to.r").alias("__r"), F.col("__to.g").alias("__g"))
    else:
        rows = rows.select("doc_id", "__key", "__text", F.col("__range").alias("__r"), F.lit(0).alias("__g"))
    rows = rows.withColumn("__tie", F.xxhash64("__text"))
    dealt = rows.repartition("__r").sortWithinPartitions("__r", "__g", F.desc("__key"), "__tie")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range whose next row has come or not yet
        for batch in batches:
            for part in _portions(list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__text", "__r", "__g")), strict=True)), lambda x: len(x[1])):
                held += part
                if len(held) > 1:
                    yield _compared(held)
                    held = held[-1:]

    return dealt.mapInArrow(run, schema)


def _compared(held: list[tuple]) -> pa.RecordBatch:
    """All rows but the last, each against the row after it if that is in its range; guests give no row."""
    texts = [x[1] for x in held]
    at = [i for i in range(len(held) - 1) if held[i][3] == 0 and held[i + 1][2] == held[i][2]]
    edited = [edited_text(texts[i], texts[i + 1]) for i in at]
    strong, soft = vectors(texts)
    strong_e, soft_e = vectors(edited)
    i = np.array(at, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([held[k][0] for k in at], pa.int64()),
            pa.array([len(texts[k]) for k in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array([encode(strong[k], soft[k]) for k in at], pa.string()),
            pa.array([encode(s, t) for s, t in zip(strong_e, soft_e, strict=True)], pa.string()),
            pa.array(cosine(soft[i], soft_e) if at else [], pa.float64()),
            pa.array(cosine(soft[i], soft[i + 1]) if at else [], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
