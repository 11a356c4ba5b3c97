"""Language-model scores with stupid backoff over the corpus' own words, counted by hash.

Units are words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered, as UTF-8 bytes, so every script
counts), grams of one and two of them, told apart by 64-bit hashes.

1. Documents are dealt into blocks of about ``BLOCK_BYTES`` of text, and each block's
   grams are exploded, counted inside the block, and cut by hash into buckets.
2. The count table is partitioned by bucket.  Every bucket meets the exploded grams of
   all blocks that fall into it, sums them, and answers each block with the totals of
   the grams it holds and no more.  A gram comes once from a block however often it
   occurs there, so no word and no passage makes a bucket heavy; nothing is broadcast.
3. The totals join their block's texts, and log10 scores are summed per document:
   S(w|v) = c(v w) / c(v) if c(v w) >= ``least``, else 0.4 * c(w) / N; a first word has
   c(w) / N.  All counts are kept by default (``least`` = 1).

A row that is shuffled holds the grams of one (block, bucket): hashes as differences and
counts, both by byte planes, which Spark's compression makes small.  What is gathered
grows with the corpus; blocks and buckets stay of one size.

Defined cases: null and texts without words have 0 words, sum 0, null mean and null
``once_share``; repeated rows count and score each; null ids are kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

common.by_value(__name__)

BACKOFF = 0.4
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20


def grams_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a chunk's words, hashes of each word with the one before it in its text (0: none), n+1 bounds by row."""
    data = common.ascii_lower(data)
    starts, ends, words = common.word_spans(data, bounds)
    one = common.span_hash(common.prefix_hash(data), starts, ends)
    two = np.zeros_like(one)
    two[1:] = common.mix(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[1:] + np.uint64(1))
    firsts = words[:-1]
    two[firsts[firsts < len(two)]] = 0
    return one, two, words


def _counted(chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of a block's chunks and their counts."""
    parts = [np.unique(np.concatenate([one, two[two != 0]]), return_counts=True) for one, two in chunks]
    return _summed([g for g, _ in parts], [n for _, n in parts])


def _summed(grams: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gram = np.concatenate([np.empty(0, np.uint64), *grams])
    n = np.concatenate([np.empty(0, np.int64), *sizes]).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
    return gram[first], np.add.reduceat(n, first) if len(first) else n


def pack(values: np.ndarray) -> bytes:
    """64-bit values by byte planes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def _cut(gram: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits buckets, which are ranges of hashes, begins and the last one ends."""
    lowest = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(gram, lowest), len(gram))


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = words = 0
            for _, _, data, bounds in common.text_chunks(batch.column("text")):
                size += len(data)
                words += len(common.word_spans(data, bounds)[0])
            yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([words])], names=["size", "words"])

    got = rows.select("text").mapInArrow(run, "size bigint, words bigint").agg(F.sum("size"), F.sum("words")).first()
    return got[0] or 0, got[1] or 0


def _exploded(texts: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, grams, counts) of rows (block, text) that stand together by block.

    All columns are read, so that the shuffle of the texts is the one that the scores use too.
    """

    def pieces(block: int, chunks: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gram, n = _counted(chunks)
        cut = _cut(gram, bits)
        some = np.flatnonzero(np.diff(cut))
        for few in np.array_split(some, -(-len(some) // 1024)) if len(some) else []:
            spans = [(int(cut[b]), int(cut[b + 1])) for b in few]
            yield pa.RecordBatch.from_arrays(
                [pa.array(few.astype(np.int32)), pa.array(np.full(len(few), block, np.int32)), pa.array([pack(np.diff(gram[a:z], prepend=np.uint64(0))) for a, z in spans], pa.binary()), pa.array([pack(n[a:z]) for a, z in spans], pa.binary())],
                names=["bucket", "block", "grams", "counts"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chunks = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            begins = [*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(blocks)]
            for first, end in zip(begins[:-1], begins[1:], strict=True):
                if block is not None and blocks[first] != block:
                    yield from pieces(block, chunks)
                    chunks = []
                block = int(blocks[first])
                chunks += [grams_of(data, bounds)[:2] for _, _, data, bounds in common.text_chunks(batch.column("text").slice(first, end - first))]
        if block is not None:
            yield from pieces(block, chunks)

    return texts.sortWithinPartitions("block").mapInArrow(run, "bucket int, block int, grams binary, counts binary")


def _answered(grams: DataFrame) -> DataFrame:
    """(block, bucket, totals): for each exploded row the corpus' totals of its grams, in their order."""

    def answers(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        own = [np.cumsum(unpack(r[2]), dtype=np.uint64) for r in rows]
        gram, total = _summed(own, [unpack(r[3]) for r in rows])
        packed = [pack(total[np.searchsorted(gram, g)]) for g in own]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array(packed, pa.binary())], names=["block", "bucket", "totals"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "grams", "counts")), strict=True):
                if held and held[0][0] != row[0]:
                    yield answers(held)
                    held = []
                held.append(row)
        if held:
            yield answers(held)

    return grams.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block int, bucket int, totals binary")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """doc_id, n_words, log10_score (sum), mean_log10, once_share (of its word pairs, those met once in the corpus) of every whole text."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, words = _sizes(rows)
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = max(0, (size // BUCKET_BYTES).bit_length())
    texts = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")).repartition("block")
    answered = _answered(_exploded(texts, bits))
    schema = "doc_id bigint, n_words bigint, log10_score double, mean_log10 double, once_share double"
    everywhere = np.log10(max(1, words))

    def score(own: pa.Table, totals: pa.Table) -> pa.Table:
        chunks = [grams_of(data, bounds) for _, _, data, bounds in common.text_chunks(own.column("text"))]
        gram = _counted([c[:2] for c in chunks])[0]
        # Buckets are ranges of hashes, so their answers in order are those of the block's sorted grams.
        total = np.concatenate([np.empty(0, np.uint64), *(unpack(t) for t in totals.sort_by("bucket").column("totals").to_pylist())]).astype(np.int64)
        logs = np.log10(np.maximum(total, 1))
        n, sums, once = [], [], []
        for one, two, bounds in chunks:
            a = np.searchsorted(gram, one)
            paired = two != 0
            b = np.where(paired, np.searchsorted(gram, two), 0)
            alone = logs[a] - everywhere if len(one) else np.empty(0)
            value = alone.copy()
            before = np.roll(a, 1)
            known = paired & (total[b] >= least) if len(one) else paired
            value[known] = logs[b[known]] - logs[before[known]]
            off = paired & ~known
            value[off] = alone[off] + np.log10(BACKOFF)
            first, here = bounds[:-1], np.diff(bounds)
            full = here > 0
            summed, single, pairs = np.zeros(len(here)), np.full(len(here), np.nan), np.maximum(here - 1, 0)
            if full.any():
                summed[full] = np.add.reduceat(value, first[full])
                met_once = np.add.reduceat((paired & (total[b] == 1)).astype(np.int64), first[full])
                single[full] = np.where(pairs[full] > 0, met_once / np.maximum(pairs[full], 1), np.nan)
            n.append(here)
            sums.append(summed)
            once.append(single)
        count = np.concatenate([np.empty(0, np.int64), *n])
        total_log, share = np.concatenate([np.empty(0), *sums]), np.concatenate([np.empty(0), *once])
        mean = pa.array(np.divide(total_log, count, out=np.zeros(len(count)), where=count > 0), mask=count == 0)
        return pa.Table.from_arrays([own.column("doc_id"), pa.array(count), pa.array(total_log), mean, pa.array(share, mask=np.isnan(share))], names=["doc_id", "n_words", "log10_score", "mean_log10", "once_share"])

    return texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema)
