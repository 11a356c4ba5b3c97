"""Language identification by a byte convolutional network trained in numpy.

A window of 256 bytes (A-Z folded) is embedded; filters of several widths slide
over it; each filter's largest value over the window goes into a softmax over the
labels.  Every byte of a text lies in one window; a document's probabilities are
the geometric means of its windows', weighted by their bytes.

The network is fitted on the driver on a sample of at most about ``PER_LABEL``
documents of each label (drawn by a hash of id and text at a rate found from the label
counts) and ``WINDOWS`` windows of each (by a hash of their bytes and place).  Its weights, some ten kilobytes, travel
with the tasks.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and
so is every text if there is nothing to learn from; null ids count as the empty
string in the fold rule; null labels are not learned; repeated rows are predicted
alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common

common.by_value(__name__)

LENGTH, PAD = 256, 256
EMBED, FILTERS, WIDTHS = 6, 16, (2, 3, 5)
PER_LABEL, WINDOWS = 1000, 4
EPOCHS, LEAST_STEPS, BATCH, RATE = 3, 400, 64, 0.01
UNKNOWN = "und"
_MIXED = common.mix(np.arange(1, LENGTH + 1, dtype=np.uint64)) | np.uint64(1)


def windows_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a chunk's texts as (n, LENGTH) codes, and each one's row."""
    sizes = np.diff(bounds)
    each = -(-sizes // LENGTH)
    first = np.cumsum(each) - each
    out = np.full(int(each.sum()) * LENGTH, PAD, dtype=np.int16)
    out[np.arange(len(data)) + np.repeat(first * LENGTH - bounds[:-1], sizes)] = common.ascii_lower(data)
    return out.reshape(-1, LENGTH), np.repeat(np.arange(len(sizes)), each)


class Network:
    """Embedding, filters of several widths, max pooling over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def pooled(self, codes: np.ndarray, places: list | None = None) -> np.ndarray:
        """Largest filter values over each window; ``places`` receives where they stand."""
        flat = self.embed[codes].reshape(len(codes), LENGTH * EMBED)
        parts = []
        for width, weight, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = LENGTH - width + 1
            view = np.lib.stride_tricks.as_strided(flat, (len(codes), n, width * EMBED), (flat.strides[0], EMBED * 4, 4))
            value = (view.reshape(-1, width * EMBED) @ weight).reshape(len(codes), n, FILTERS)
            if places is None:
                parts.append(value.max(axis=1) + bias)
            else:
                at = value.argmax(axis=1)
                places.append(at)
                parts.append(np.take_along_axis(value, at[:, None], 1)[:, 0] + bias)
        return np.maximum(np.concatenate(parts, axis=1), 0)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        return _log_softmax(self.pooled(codes) @ self.out + self.out_bias)

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        places: list[np.ndarray] = []
        hidden = self.pooled(codes, places)
        error = np.exp(_log_softmax(hidden @ self.out + self.out_bias))
        error[np.arange(len(codes)), target] -= 1
        error /= len(codes)
        back = (error @ self.out.T) * (hidden > 0)
        embed, filters, biases = np.zeros_like(self.embed), [], []
        for k, (width, weight, at) in enumerate(zip(WIDTHS, self.filters, places, strict=True)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            # Only the places of the largest values carry a gradient.
            seen = codes[np.arange(len(codes))[:, None, None], at[:, :, None] + np.arange(width)]
            inputs = self.embed[seen].reshape(len(codes), FILTERS, width * EMBED)
            filters.append(np.einsum("nf,nfk->kf", part, inputs))
            biases.append(part.sum(0))
            np.add.at(embed, seen.reshape(-1), (part[:, :, None] * weight.T[None]).reshape(-1, EMBED))
        embed[PAD] = 0
        return [embed, *filters, *biases, hidden.T @ error, error.sum(0)]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(codes: np.ndarray, target: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Adam on mini-batches; classes weigh alike as each gives as many windows."""
    net, rng, step = Network(labels, seed), np.random.default_rng(seed), 0
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    batches = max(1, -(-len(codes) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))  # small samples are read more often
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for k in range(0, len(order), BATCH):
            step += 1
            some = order[k : k + BATCH]
            rate = RATE * (1 - 0.9 * step / (epochs * batches))
            for p, g, m, v in zip(net.parameters(), net.gradients(codes[some], target[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """Train on a bounded sample of the rows for which ``learn`` holds."""
    known = docs.filter(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}
    if not counts:
        return None
    labels = sorted(counts)
    rate = F.create_map(*[x for c in labels for x in (F.lit(c), F.lit(min(1.0, PER_LABEL / counts[c])))])
    lot = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample"))
    drawn = F.pmod(lot, F.lit(1_000_000)) < rate[F.col(label_col)] * 1_000_000
    sample = known.filter(drawn).select(F.col(label_col).alias("label"), F.col(text_col).cast("string").alias("text"), lot.alias("lot"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = [], []
            for top, _, data, bounds in common.text_chunks(batch.column("text")):
                codes, rows = windows_of(data, bounds)
                # By what a window holds and where it stands in its text, so that the file layout has no say.
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                with np.errstate(over="ignore"):
                    rank = common.mix((codes.astype(np.uint64) * _MIXED).sum(axis=1, dtype=np.uint64) + nth.astype(np.uint64))
                order = np.lexsort((rank, rows))
                nth = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
                some = order[nth < WINDOWS]
                names += batch.column("label").take(pa.array(rows[some] + top)).to_pylist()
                out += [c.tobytes() for c in codes[some]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["label", "codes"])

    # Repeated rows share their lot, so the bound needs a limit too; it is in the order of the lots.
    sample = sample.orderBy("lot", "label").limit(2 * PER_LABEL * len(labels)).select("label", "text")
    got = sample.mapInArrow(cut, "label string, codes binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("label", "ascending"), ("codes", "ascending")])
    codes = np.frombuffer(b"".join(got.column("codes").to_pylist()), dtype=np.int16).reshape(-1, LENGTH)
    number = {c: i for i, c in enumerate(labels)}
    return train(codes, np.array([number[c] for c in got.column("label").to_pylist()]), labels)


def predict(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every whole text; no shuffle."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    common.bound_batches(docs.sparkSession)
    # A text that is kept crosses to Python once.
    shared = text_col in keep and docs.schema[text_col].dataType == StringType()
    source = text_col if shared else "__text"
    rows = docs.select(*keep, *([] if shared else [F.col(text_col).cast("string").alias("__text")]), letters.alias("__letters"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("langid")
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            lettered = batch.column("__letters").to_pylist()
            for top, last, data, bounds in common.text_chunks(batch.column(source)):
                if net is None:
                    break
                codes, rows = windows_of(data, bounds)
                total, weight = np.zeros((last - top, len(net.labels))), np.zeros(last - top)
                for k in range(0, len(codes), 32):
                    some = codes[k : k + 32]
                    size = (some != PAD).sum(1)
                    np.add.at(total, rows[k : k + 32], net.log_probabilities(some) * size[:, None])
                    np.add.at(weight, rows[k : k + 32], size)
                means = np.exp(_log_softmax(total / np.maximum(weight, 1)[:, None]))
                for i, best in enumerate(means.argmax(1)):
                    if lettered[top + i]:
                        names[top + i], scores[top + i] = net.labels[best], float(means[i, best])
            arrays = [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))
