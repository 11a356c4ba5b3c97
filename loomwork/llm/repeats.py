"""Suffix-array dedup: maximal repeats by interval trees over a sparse suffix array.

All texts together are searched for byte strings of ``length`` (400) bytes that
start at two or more places, and every byte covered by one is removed.

1. Sampling.  Every string of 400 bytes holds the same smallest (leftmost) seed of
   128 bytes wherever it stands.  These seeds' places, the anchors, are the suffixes
   of a sparse suffix array; each anchor stands for the run of 400-byte strings
   (its context) whose smallest seed it is, so no string is missed.
2. Equal contexts are counted by a plain aggregation: if a context stands twice, all
   of it is covered.  That settles copies and long shared passages, however many
   there are, without bringing their places together.
3. Anchors that share a seed but not the whole context meet in groups.  In a group
   the suffixes are sorted, their common prefixes scanned with a stack, and in each
   interval of this tree the left extensions are sorted and scanned in the same way:
   each interval of both that is diverse on either side is a maximal repeat with all
   its occurrences.  Those of 400 bytes or more give the spans to remove.
4. A group of more than ``GROUP`` distinct contexts is not gathered: its 400-byte
   strings become rows, counted by hash over all tasks.  That is exact as well.

Strings are compared by 128 bits of hash in step 2, byte by byte in step 3, and by
64 bits within one seed's group in step 4.

Defined cases: null counts as the empty text; texts under 400 bytes lose nothing;
matches never cross rows; repeated rows lose all their bytes if they have 400;
null and repeated ids are kept as they are; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomwork.staging import free_shuffles, stage

from . import common

common.by_value(__name__)

SEED = 128
#: Contexts (about 1 KB each) that one task sorts together; larger groups are counted by rows.
GROUP = 4096
_PLACE = np.uint64(28)  # bits of a place in a chunk


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows, places, first and last string starts, and seed hashes of a chunk's anchors (places in the chunk)."""
    n, width = len(data), length - SEED + 1
    sizes = np.diff(bounds)
    if n < length or sizes.max(initial=0) < length:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4)) + (np.empty(0, dtype=np.uint64),)
    at = np.arange(n - SEED + 1)
    seeds = common.span_hash(common.prefix_hash(data), at, at + SEED)
    keyed = ((seeds >> _PLACE) << _PLACE) | at.astype(np.uint64)
    padded = np.full(-(-len(keyed) // width) * width + width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    enough = np.flatnonzero(sizes >= length)
    counts = sizes[enough] - length + 1
    row = np.repeat(enough, counts)
    starts = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][row]
    place = (np.minimum(tail[starts], head[starts + width - 1]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return row[first], place[first], starts[first], starts[last], seeds[place[first]]


def common_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low if high == 0 or a[low : low + 1] != b[low : low + 1] else low + 1


def intervals(strings: list[bytes], members: list[int]) -> Iterator[tuple[int, list[int]]]:
    """The common-prefix intervals of some strings, deepest first: (common length, members).

    Sort, then scan the common lengths of neighbours with a stack; an interval closes
    when a smaller common length comes.
    """
    order = sorted(members, key=lambda i: strings[i])
    stack: list[tuple[int, int]] = []  # (common length, leftmost member)
    for k in range(1, len(order) + 1):
        shared = common_length(strings[order[k - 1]], strings[order[k]]) if k < len(order) else -1
        left = k - 1
        while stack and stack[-1][0] > shared:
            depth, left = stack.pop()
            yield depth, order[left:k]
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, left))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left extent, right extent, occurrences) of every maximal repeat of ``length`` or more through the anchors.

    ``lefts`` are reversed.  An interval of the right tree is split by its members' left
    extensions; a part that would reach further right belongs to a deeper interval.
    """
    reach = [len(x) for x in lefts]
    for right, members in intervals(rights, list(range(len(rights)))):
        if right + max(reach[i] for i in members) < length:
            continue
        for left, part in intervals(lefts, members):
            if left + right >= length:
                low, high = min(rights[i] for i in part), max(rights[i] for i in part)
                if common_length(low, high) == right:
                    yield left, right, part


def _keys(text_col: str) -> list:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _anchors(texts: DataFrame, length: int, text_col: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("repeats")
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for top, _, data, bounds in common.text_chunks(batch.column(text_col)):
                with np.errstate(over="ignore"):
                    row, place, lo, hi, seed = anchors_of(data, bounds, length)
                if not len(row):
                    continue
                raw, base = memoryview(data), bounds[:-1][row]
                context = b"".join(hashlib.blake2b(raw[a : b + length], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
                pair = np.frombuffer(context, dtype="<i8").reshape(-1, 2)
                columns = (k1[top + row], k2[top + row], place - base, lo - base, hi - base, seed.view(np.int64), pair[:, 0], pair[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["k1", "k2", "place", "lo", "hi", "seed", "c1", "c2"])

    return texts.select("k1", "k2", text_col).mapInArrow(run, "k1 bigint, k2 bigint, place bigint, lo bigint, hi bigint, seed bigint, c1 bigint, c2 bigint")


def _contexts(wanted: DataFrame, texts: DataFrame, length: int, text_col: str) -> DataFrame:
    """The bytes of the wanted contexts, cut from their texts: seed, size, settled, k1, k2, place, lo, context."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "lo", "hi", "seed", "settled", "size")).alias("wanted"))
    schema = "seed bigint, size bigint, settled boolean, k1 bigint, k2 bigint, place bigint, lo bigint, context binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, wanted in zip(*(batch.column(c) for c in ("k1", "k2", text_col, "wanted")), strict=True):
                if (key := (k1.as_py(), k2.as_py())) == last:
                    continue  # a copy of the row before
                last, raw = key, (text.as_py() or "").encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    out.append((w["seed"], w["size"], w["settled"], *key, w["place"], w["lo"], raw[w["lo"] : w["hi"] + length]))
                if len(out) > 4000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    # All columns of the texts go along, so that this join and the last one share one shuffle of them.
    return texts.join(lists, ["k1", "k2"]).select(*texts.columns, "wanted").mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _tree_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans from the interval trees of the groups, one group at a time."""
    schema = "k1 bigint, k2 bigint, start bigint, end bigint"

    def group(rows: dict) -> list[tuple]:
        ids = list(rows)
        lefts = [rows[i][1][: rows[i][0]][::-1] for i in ids]
        rights = [rows[i][1][rows[i][0] :] for i in ids]
        # All repeats at an anchor hold the anchor, so together they are one span.
        reach: dict[int, tuple[int, int]] = {}
        for left, right, part in maximal_repeats(lefts, rights, length):
            for k in part:
                most = reach.get(k, (0, 0))
                reach[k] = max(most[0], left), max(most[1], right)
        return [(*ids[k][:2], ids[k][2] - left, ids[k][2] + right) for k, (left, right) in reach.items() if not rows[ids[k]][2]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, held = None, {}
        for batch in batches:
            out = []
            for s, k1, k2, place, lo, context, settled in zip(*(batch.column(c).to_pylist() for c in ("seed", "k1", "k2", "place", "lo", "context", "settled")), strict=True):
                if s != seed:
                    out += group(held) if len(held) > 1 else []
                    seed, held = s, {}
                held[(k1, k2, place)] = (place - lo, context, settled)
            yield _batch(out, schema)
        yield _batch(group(held) if len(held) > 1 else [], schema)

    return contexts.repartition("seed").sortWithinPartitions("seed").mapInArrow(run, schema)


def _counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of large groups: every 400-byte string of their contexts is a row, counted by hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, settled, k1, k2, lo, context in zip(*(batch.column(c).to_pylist() for c in ("seed", "settled", "k1", "k2", "lo", "context")), strict=True):
                raw = np.frombuffer(context, dtype=np.uint8)
                at = np.arange(len(raw) - length + 1)
                with np.errstate(over="ignore"):
                    hashed = common.span_hash(common.prefix_hash(raw), at, at + length).view(np.int64)
                full = lambda x: np.full(len(at), x)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full(seed)), pa.array(hashed), pa.array(full(2 if settled else 1)), pa.array(full(k1)), pa.array(full(k2)), pa.array(at + lo)],
                    names=["seed", "string", "n", "k1", "k2", "start"],
                )

    rows = contexts.mapInArrow(run, "seed bigint, string bigint, n bigint, k1 bigint, k2 bigint, start bigint").distinct()
    often = rows.groupBy("seed", "string").agg(F.sum("n").alias("total")).filter("total > 1").drop("total")
    return rows.join(often, ["seed", "string"]).filter("n = 1").select("k1", "k2", "start", (F.col("start") + length).alias("end"))


def repeat_spans(texts: DataFrame, length: int, text_col: str) -> DataFrame:
    """(k1, k2, start, end): spans to remove, by text; they may overlap."""
    columns = ["k1", "k2", "place", "lo", "hi", "seed", "c1", "c2"]
    anchors = _anchors(texts, length, text_col).groupBy(*columns).agg(F.count("*").alias("n")).repartition("seed")
    # One dealing by seed serves both the contexts' counts and the seeds'.
    context, seed = Window.partitionBy("seed", "c1", "c2"), Window.partitionBy("seed")
    counted = anchors.select("*", F.sum("n").over(context).alias("total"), (F.row_number().over(context.orderBy("k1", "k2", "place")) == 1).alias("first"))
    counted = counted.select("*", F.sum(F.col("first").cast("long")).over(seed).alias("size"), F.max(F.col("total") == 1).over(seed).alias("open"))
    shared = (F.col("size") > 1) & F.col("open")
    busy = stage(counted.filter((F.col("total") > 1) | shared), "busy-seeds")
    free_shuffles(texts.sparkSession)
    spans = busy.filter("total > 1").select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    wanted = busy.filter(F.col("first") & shared).select("k1", "k2", "place", "lo", "hi", "seed", (F.col("total") > 1).alias("settled"), "size")
    met = _contexts(wanted, texts, length, text_col)
    spans = spans.unionByName(_tree_spans(met.filter(F.col("size") <= GROUP), length))
    if not wanted.filter(F.col("size") > GROUP).isEmpty():
        spans = spans.unionByName(_counted_spans(met.filter(F.col("size") > GROUP), length))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal runs."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, and of each text: n_bytes, n_removed, the removed runs, and the bytes that stay."""
    common.bound_batches(docs.sparkSession)
    # A text that is kept is shuffled once and crosses to Python once.
    shared = text_col in keep and docs.schema[text_col].dataType == StringType()
    source = text_col if shared else "__text"
    rows = docs.select(*keep, *_keys(text_col), *([] if shared else [F.col(text_col).cast("string").alias("__text")]))
    lists = repeat_spans(rows, length, source).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_bytes bigint, n_removed bigint, runs array<struct<start:bigint,end:bigint>>, kept binary"
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(source), batch.column("spans"), strict=True):
                raw, at, left = (text.as_py() or "").encode("utf-8", "surrogatepass"), 0, []
                cut = merged([(x["start"], x["end"]) for x in spans.as_py() or ()])
                for start, end in cut:
                    left.append(raw[at:start])
                    at = end
                left.append(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(e - s for s, e in cut))
                runs.append([{"start": s, "end": e} for s, e in cut])
                kept.append(b"".join(left))
            arrays = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, runs_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, "n_bytes", "n_removed", "runs", "kept"])

    return rows.join(lists, ["k1", "k2"], "left").select(*keep, *([] if shared else [source]), "spans").mapInArrow(run, schema)
