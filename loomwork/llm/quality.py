"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are the pairs of neighbouring symbols (64 kinds of byte) and a few
binned measures of its shape (how many words and lines repeat, its length).  Their
logarithmic counts, weighted by inverse document frequency, are projected on the
leading singular vectors of a labelled sample.  Each document's vector is compared
with all labelled vectors (exact cosines, in blocks of matrix products); the
nearest ``NEIGHBOURS`` vote with their similarity as weight.

The sample holds at most about ``SAMPLE`` labelled rows, drawn by a hash of the id;
its vectors (SAMPLE x DIMENSIONS numbers of 4 bytes, 0.6 MB) are broadcast.

Defined cases: null text is empty; the empty text has a vector of its own shape and
is scored like others; without any label every score is 0.5; null ids count as the
empty string in the fold rule; repeated rows score alike; repeated labels each
vote; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

common.by_value(__name__)

SAMPLE, DIMENSIONS, NEIGHBOURS = 3000, 48, 25
SYMBOLS, BINS = 64, 16
TERMS = SYMBOLS * SYMBOLS + 4 * BINS
SHAPE_WEIGHT = 6.0


def term_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, TERMS) damped counts of symbol pairs, and one bin for each measure of shape."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    code = common.symbol_table(False)[data]
    inside = row[1:] == row[:-1]
    pair = (row[1:] * (SYMBOLS * SYMBOLS) + code[:-1] * SYMBOLS + code[1:])[inside]
    out = np.zeros((n, TERMS), dtype=np.float32)
    out[:, : SYMBOLS * SYMBOLS] = np.log1p(np.bincount(pair, minlength=n * SYMBOLS * SYMBOLS)).reshape(n, -1)
    starts, ends, by_text = common.word_spans(data, bounds)
    with np.errstate(over="ignore"):
        words = common.span_hash(common.prefix_hash(data), starts, ends)
    each = np.maximum(np.diff(by_text), 1)
    owner = np.repeat(np.arange(n), np.diff(by_text))
    again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / each
    order = np.lexsort((words, owner))
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kinds = np.bincount(owner[order][fresh], minlength=n) / each
    capitals = np.bincount(row[code == 26], minlength=n) / np.maximum(np.diff(bounds), 1)
    size = np.log2(np.diff(bounds) + 1)
    for k, (measure, top) in enumerate(((again, 1), (kinds, 1), (capitals, 1), (size, 20))):
        place = np.clip(measure / top * BINS, 0, BINS - 1)
        low = np.floor(place).astype(np.int64)
        share = (place - low).astype(np.float32)  # between two bins, so that near values are near
        base = SYMBOLS * SYMBOLS + k * BINS
        out[np.arange(n), base + low] += SHAPE_WEIGHT * (1 - share)
        out[np.arange(n), base + np.minimum(low + 1, BINS - 1)] += SHAPE_WEIGHT * share
    return out


class Space:
    """Term weights, singular vectors, and the labelled sample in their space."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, seed: int = 3):
        df = (terms > 0).sum(0)
        self.weight = (np.log((1 + len(terms)) / (1 + df)) + 1).astype(np.float32)
        weighted = _unit(terms * self.weight)
        rng = np.random.default_rng(seed)
        basis = rng.normal(size=(TERMS, min(DIMENSIONS + 8, len(terms)))).astype(np.float32)
        for _ in range(5):  # subspace iteration
            basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
        small = weighted @ basis
        right = np.linalg.svd(small, full_matrices=False)[2]
        self.basis = (basis @ right[: min(DIMENSIONS, len(right))].T).astype(np.float32)
        self.vectors, self.labels = _unit(weighted @ self.basis), labels.astype(np.float32)


def votes(terms: np.ndarray, weight: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Share of the votes for label 1 among the nearest labelled vectors."""
    likeness = _unit(_unit(terms * weight) @ basis) @ vectors.T
    k = min(NEIGHBOURS, likeness.shape[1])
    near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    share = np.maximum(np.take_along_axis(likeness, near, 1), 1e-6) ** 4
    return np.clip((share * labels[near]).sum(1) / share.sum(1), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space | None:
    """Draw labelled rows for which ``learn`` (on the labels' id) holds and lay out their space."""
    known = labels.filter(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    total = known.count()
    if not total:
        return None
    drawn = known.filter(F.pmod(F.xxhash64(F.col("__id"), F.lit("sample")), F.lit(1_000_000)) < min(1.0, SAMPLE / total) * 1_000_000)
    drawn = drawn.orderBy(F.xxhash64("__id", F.lit("sample")), "__id", "label").limit(2 * SAMPLE)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "__id")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, last, data, bounds in common.text_chunks(batch.column("text")):
                terms = term_counts(data, bounds)
                arrays = [batch.column("__id").slice(top, last - top), batch.column("label").slice(top, last - top), pa.array([t.astype(np.float16).tobytes() for t in terms], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "terms"])

    got = rows.select(F.col("__id").cast("long"), "label", "text").mapInArrow(measure, "id bigint, label int, terms binary")
    # Repeated ids may bring more rows than were drawn: the bound is then in the order of ids and contents.
    got = got.orderBy(F.xxhash64("id", F.lit("sample")), "id", "label", "terms").limit(4 * SAMPLE).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("id", "ascending"), ("terms", "ascending"), ("label", "ascending")])
    terms = np.frombuffer(b"".join(got.column("terms").to_pylist()), dtype=np.float16).reshape(-1, TERMS).astype(np.float32)
    return Space(terms, np.array(got.column("label").to_pylist()))


def score(docs: DataFrame, space: Space | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` of every whole text; no shuffle."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    shared = docs.sparkSession.sparkContext.broadcast(space and (space.weight, space.basis, space.vectors, space.labels))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            for top, last, data, bounds in common.text_chunks(batch.column("__text")):
                if parts is not None:
                    out[top:last] = votes(term_counts(data, bounds), *parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, ", ".join([*kinds, "score double"]))
