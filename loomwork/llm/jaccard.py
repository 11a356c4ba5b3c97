"""N-gram Jaccard join: multiple-global-order filtering and exact verification.

A document is the set of its distinct n-word shingles (hashed to 64 bits).  Two
sets x, y with Jaccard similarity t or more share at least
a = ceil(t/(1+t) * (|x|+|y|)) elements, so under any global order of the shingles
they share one among their first |x|-ceil(t|x|)+1.

Six global orders filter, all on narrow rows before any text moves.

* Order 1 puts shingles that are common over the whole corpus last (document
  frequencies are counted over all documents in a fixed-size table of counters and
  only their magnitude is used), then sorts by hash; its prefixes are joined.
* Order 2 sorts the prefixes by the exact frequency that this join finds, rarest
  first: a pair must meet while both still have as many prefix elements left as the
  threshold needs, which parts documents that only have a passage in common.
* Orders 3 to 6 each put another quarter of all shingles (by hash) first.  A set's
  prefix under such an order is its part of that quarter, kept as a bitmap of 512
  bits.  A bit that only one side has is an element that the other lacks; the four
  prefixes are disjoint, so their misses add up, and a pair that misses more than
  |x|-a over the four together is no candidate.  That is the four filters intersected,
  and sharper than each alone.

Only pairs that pass every order are verified on the whole sets.

No group is expanded to all its pairs.  Equal sets are one node.  Every node is
first tested against the group's smallest node that it meets most often; then, for
every two components that meet in groups, one such pair, until no link is found; a
group that lies in one component leaves the work for good.  What then still lies in
another component than the group's largest one is a set of queries against all of the
group outside its own component: in cells of at most ``BLOCK`` queries and members,
under the orders above.  First come turns in which a task tells two pairs of each
component, the likeliest and one by lot, so that a cluster grows together although its
smallest node is not linked with all of it, and its pairs are never listed; they go on
while a turn finds a tenth of what the first one found.  Then all pairs of different
components that pass the orders become rows; a group of two rows is one pair and needs
no cell.  So every pair that could connect two components is tested, and none is skipped.

Defined cases: null and word-less texts have the empty set and are linked with
nothing; fewer words than n make one shingle of the whole sequence; repeated rows
and equal texts are linked through their node; null ids take part (the component
of such a document is the smallest id it reaches, null if there is none); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.graph_components import connected_components
from loomwork.staging import free_shuffles, mark, release, stage

from . import common

common.by_value(__name__)

#: Counters of document frequency: this many in all, in blocks of CELLS.
COUNTERS, CELLS = 1 << 18, 1 << 12
#: Up to so many ids (8 bytes each) go to all tasks to filter the texts where they are read.
BROADCAST_IDS = 1_000_000
#: Queries and members of a cell of the last step.
BLOCK = 4096
#: Pairs of a cell that are looked at together.
PAIRS = 1 << 17
#: About so many pairs are remembered by a task, so as not to tell them again from another cell.
TOLD = 1 << 17
#: Bits of the four prefix bitmaps together.
BITS = 2048
#: Share of the ranks of level 0 that every prefix holds.
SHARE = np.uint64(int(0.3 * (1 << 58)))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text of the chunk its sorted distinct shingle hashes."""
    data = common.ascii_lower(data)
    starts, ends, by_text = common.word_spans(data, bounds)
    words = common.span_hash(common.prefix_hash(data), starts, ends)
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
    hashed, out = common.mix(total), []
    for a, b in zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(hashed[a : b - n + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = common.mix(np.array([short * np.uint64(0x9FB21C651E98DF25) + w], dtype=np.uint64))[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_hash(items: np.ndarray) -> int:
    """A signed 64-bit name of a set: the sum of its remixed elements."""
    total = np.sum(common.mix(items ^ np.uint64(0x1D8E4E27C47D124F)), dtype=np.uint64) + np.uint64(len(items)) * np.uint64(0x9FB21C651E98DF25)
    return int(total.astype(np.int64))


def rank_of(items: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Ranks of order 1: by level of corpus frequency, then by hash."""
    return (level[(items >> np.uint64(46)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (items >> np.uint64(6))


def ordered(items: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The (sorted) elements in order 1; equal ranks by value."""
    return items[np.argsort(rank_of(items, level), kind="stable")]


def bitmap(items: np.ndarray) -> bytes:
    """The prefixes of orders 3 to 6 as bits: the upper two of the place name the order."""
    bits = np.zeros(BITS, dtype=bool)
    bits[(items & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_link(n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Orders 3 to 6 for pairs: sizes, and bitmaps as rows of 64-bit words; False where no link is possible."""
    overlap = -(-num * (n_a + n_b) // (num + den))
    missed = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    return (missed(bits_a, bits_b) <= n_a - overlap) & (missed(bits_b, bits_a) <= n_b - overlap)


def prefix_length(n: int, num: int, den: int) -> int:
    """|x| - ceil(t|x|) + 1 for t = num/den."""
    return n - -(-num * n // den) + 1


def _sets_of(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, _, data, bounds in common.text_chunks(batch.column("text")):
        with np.errstate(over="ignore"):
            yield from ((first + i, s) for i, s in enumerate(shingle_sets(data, bounds, n)))


def _survey(rows: DataFrame, n: int) -> DataFrame:
    """Without a block: a row for each document (doc_id, node, size, bitmaps); with one: this task's document frequencies in it."""
    names = ["doc_id", "text_hash", "node", "n_shingles", "bits", "block", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("jaccard")
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            nodes, sizes, bits = [], [], []
            for _, items in _sets_of(batch, n):
                nodes.append(set_hash(items) if len(items) else None)
                bits.append(bitmap(items) if len(items) else None)
                sizes.append(len(items))
                counts += np.bincount((items >> np.uint64(46)).astype(np.int64), minlength=COUNTERS) if len(items) > COUNTERS else 0
                if len(items) <= COUNTERS:
                    np.add.at(counts, (items >> np.uint64(46)).astype(np.int64), 1)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        for block in np.flatnonzero(counts.reshape(-1, CELLS).any(1)).tolist():
            part = counts[block * CELLS : (block + 1) * CELLS].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.binary()), pa.array([block], pa.int32()), pa.array([part], pa.binary())], names=names)

    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, n_shingles bigint, bits binary, block int, counts binary")


def _levels(survey: DataFrame) -> np.ndarray:
    """Magnitude of each counter against the mean, 0 for all but those above twice the mean; a table of fixed size."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(counts, dtype="<u4").astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    blocks = COUNTERS // CELLS
    got = survey.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").collect()
    counts = np.zeros((blocks, CELLS), dtype=np.int64)
    for block, part in got:
        counts[block] += np.frombuffer(part, dtype=np.int64)
    ratio = counts.reshape(-1) / max(1.0, counts.mean())
    return np.clip(np.log2(np.maximum(ratio, 1.0)), 0, 31).astype(np.uint8)


def _prefixes(rows: DataFrame, level: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """(token, node, n, p, cut) for the order-1 prefix of every set, once for each set and task.

    A prefix holds all elements up to the rank SHARE, or further up to the length that
    the threshold asks for; ``cut`` is 0 in the first case and else its last rank.  Two
    sets' prefixes share every common element up to the smaller cut.
    """
    table = rows.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for _, items in _sets_of(batch, n):
                if not len(items) or (node := set_hash(items)) in seen:
                    continue
                seen.add(node)
                order = ordered(items, table.value)
                least, wide = prefix_length(len(items), num, den), int((rank_of(order, table.value) < SHARE).sum())
                size = max(least, wide)
                cut = 0 if wide >= least else int(rank_of(order[size - 1 : size], table.value)[0] >> np.uint64(1))
                parts.append((order[:size].view(np.int64), node, len(items), size, cut))
                held += size
                if held > 200_000:
                    yield flushed(parts)
                    parts, held = [], 0
            if parts:
                yield flushed(parts)

    def flushed(parts: list[tuple]) -> pa.RecordBatch:
        sizes = [x[3] for x in parts]
        columns = [np.concatenate([x[0] for x in parts]), *(np.repeat(np.array([x[k] for x in parts], dtype=t), sizes) for k, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int64)))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "p", "cut"])

    return rows.mapInArrow(run, "token bigint, node bigint, n int, p int, cut bigint")


def _needed(x: str, y: str, num: int, den: int):
    """Least number of common prefix elements of a pair that reaches the threshold; columns n_, p_, cut_ of both.

    The overlap must be a; of the elements up to the smaller cut, a set may miss n - a.
    """
    c = lambda name, side: F.col(f"{name}{side}")
    overlap = F.floor((num * (c("n", x) + c("n", y)) + (num + den - 1)) / (num + den))
    own = lambda side: c("p", side) - (c("n", side) - overlap)
    return F.greatest(F.lit(1), F.when(c("cut", x) == c("cut", y), F.greatest(own(x), own(y))).when(c("cut", x) < c("cut", y), own(x)).otherwise(own(y)))


def _may_link(x: str, y: str, num: int, den: int):
    """Size filter, and positional filter in the order by exact frequency: enough prefix elements left from the shared one on."""
    c = lambda name, side: F.col(f"{name}{side}")
    alike = F.least(c("n", x), c("n", y)) * den >= F.greatest(c("n", x), c("n", y)) * num
    return alike & (F.least(c("p", x) - c("q", x), c("p", y) - c("q", y)) >= _needed(x, y, num, den))


def _candidates(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that pass orders 3 to 6, with the row that stands for each node."""
    side = lambda x: nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "bits", "id", "hash")])
    both = pairs.join(side("a").withColumnRenamed("node_a", "a"), "a").join(side("b").withColumnRenamed("node_b", "b"), "b")
    out = ["a", "b", "id_a", "hash_a", "id_b", "hash_b"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(f"n_{x}").to_numpy() for x in "ab")
            bits_a, bits_b = (_words(batch.column(f"bits_{x}")) for x in "ab")
            stays = may_link(n_a, n_b, bits_a, bits_b, num, den)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(stays)) for c in out], names=out)

    return both.select(*out, "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, ", ".join(f"{c} bigint" for c in out))


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that pass orders 3 to 6 and then the exact test on the whole sets."""
    named = stage(_candidates(pairs, nodes, num, den), "candidates")
    needed = named.select(F.col("id_a").alias("id"), F.col("hash_a").alias("hash")).union(named.select("id_b", "hash_b")).distinct()
    needed = stage(needed, "needed")
    same = rows["doc_id"].eqNullSafe(needed["id"]) & (rows["text_hash"] == needed["hash"])
    # Counted: a filter at the scan; beyond, a shuffled join.
    texts = rows.join(F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed, same, "left_semi").select("text_hash", "text")
    texts = texts.dropDuplicates(["text_hash"])  # repeated rows
    both = named.select("a", "b", "hash_a", "hash_b").join(texts.select(F.col("text_hash").alias("hash_a"), F.col("text").alias("ta")), "hash_a")
    both = both.join(texts.select(F.col("text_hash").alias("hash_b"), F.col("text").alias("tb")), "hash_b").select("a", "b", "ta", "tb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in kept:
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[node] = shingle_sets(raw, np.array([0, len(raw)]), n)[0]
            return kept[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
            links = []
            with np.errstate(over="ignore"):
                for i in range(batch.num_rows):
                    x, y = of(a[i].as_py(), ta[i].as_py()), of(b[i].as_py(), tb[i].as_py())
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if den * shared >= num * (len(x) + len(y) - shared):
                        links.append((a[i].as_py(), b[i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


_GROUP = ["token", "node", "n", "p", "cut", "q", *(f"{c}_lead" for c in ("n", "p", "cut", "q")), "lead"]


def _split_groups(grouped: DataFrame, parts: DataFrame) -> DataFrame:
    """The groups that hold more than one component, each row with its own, the first node's and the largest one; and how many rows stand in and out of that."""
    named = parts.select(F.col("node").alias("x"), F.col("component"))
    held = grouped.select(*_GROUP).join(named, F.col("node") == F.col("x"), "left").select(*_GROUP, F.coalesce("component", "node").alias("part"))
    sizes = held.groupBy("token", "part").agg(F.count("*").alias("k"), F.max(F.when(F.col("node") == F.col("lead"), F.col("part"))).alias("own"))
    split = sizes.groupBy("token").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.max("own").alias("lead_part"), F.count("*").alias("parts"), F.sum("k").alias("members"), F.max("k").alias("most"))
    split = split.filter("parts > 1").select("token", "main", "lead_part", "members", (F.col("members") - F.col("most")).alias("queries"))
    return stage(held.join(split, "token"), "split")


def _two_rows(held: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the groups that are no more than a pair."""
    two = held.filter("members = 2 and node <> lead and part <> lead_part").filter(_may_link("", "_lead", num, den))
    return two.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _open_pairs(held: DataFrame, nodes: DataFrame, num: int, den: int, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of different components that pass all orders: the rows outside a group's largest component against its other rows, in cells.

    In a turn (from 1 on) a task tells two of them for each component: the likeliest and one by lot.
    """
    rows = held.select("token", "node", *[F.col(c).cast("long").alias(c) for c in ("n", "p", "cut", "q")], "part", (F.col("part") == F.col("main")).alias("main"), "members", "queries")
    rows = rows.join(nodes.select("node", "bits"), "node")
    across, down = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil(F.col("queries") / BLOCK).cast("int")
    own = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    columns = ["token", "node", "n", "p", "cut", "q", "part", "main", "bits"]
    members = rows.select(*columns, F.lit(False).alias("query"), own(across).alias("j"), F.explode(F.sequence(F.lit(0), down - 1)).alias("i"))
    queries = rows.filter("not main").select(*columns, F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), across - 1)).alias("j"), own(down).alias("i"))
    cells = members.unionByName(queries).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def meeting(rows: dict, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_u, n_v = rows["n"][u], rows["n"][v]
        node_u, node_v = rows["node"][u], rows["node"][v]
        stays = (rows["part"][u] != rows["part"][v]) & (rows["main"][v] | (node_u < node_v)) & (np.minimum(n_u, n_v) * den >= np.maximum(n_u, n_v) * num)
        overlap = (num * (n_u + n_v) + num + den - 1) // (num + den)
        own_u, own_v = rows["p"][u] - n_u + overlap, rows["p"][v] - n_v + overlap
        cut_u, cut_v = rows["cut"][u], rows["cut"][v]
        needed = np.maximum(1, np.where(cut_u == cut_v, np.maximum(own_u, own_v), np.where(cut_u < cut_v, own_u, own_v)))
        stays &= np.minimum(rows["p"][u] - rows["q"][u], rows["p"][v] - rows["q"][v]) >= needed
        u, v = u[stays], v[stays]
        stays = may_link(rows["n"][u], rows["n"][v], rows["bits"][u], rows["bits"][v], num, den)
        return u[stays], v[stays]

    def choose(rows: dict, u: np.ndarray, v: np.ndarray, best: dict) -> None:
        """Of each component the pair that misses least, and the first by lot."""
        x, y = (f(rows["node"][u], rows["node"][v]) for f in (np.minimum, np.maximum))
        missed = np.bitwise_count(rows["bits"][u] ^ rows["bits"][v]).sum(axis=1, dtype=np.int64) / (rows["n"][u] + rows["n"][v])
        with np.errstate(over="ignore"):
            lot = common.mix(x.view(np.uint64) ^ common.mix(y.view(np.uint64) + np.uint64(turn))) / 2.0**64
        for k, worth in enumerate((missed, lot)):
            for side, at in ((u, np.arange(len(u))), (v, np.flatnonzero(~rows["main"][v]))):
                part = rows["part"][side[at]]
                at = at[np.lexsort((y[at], x[at], worth[at], part))]
                for i in at[np.unique(rows["part"][side[at]], return_index=True)[1]].tolist():
                    told, key = (float(worth[i]), int(x[i]), int(y[i])), (k, int(rows["part"][side[i]]))
                    best[key] = min(best.get(key, told), told)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "i", "j", "node", "n", "p", "cut", "q", "part", "main", "query")
        rest: dict[str, np.ndarray] | None = None
        told: set[tuple[int, int]] = set()  # pairs of this task's former cells
        best: dict[tuple[int, int], tuple[float, int, int]] = {}

        def listed(found: set[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def done(rows: dict[str, np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
            found: set[tuple[int, int]] = set()
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            waiting = 0

            def flush() -> None:
                nonlocal waiting
                if left:
                    u, v = meeting(rows, np.concatenate(left), np.concatenate(right))
                    if turn:
                        choose(rows, u, v, best)
                    else:
                        x, y = rows["node"][u], rows["node"][v]
                        found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
                left.clear()
                right.clear()
                waiting = 0

            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                asks = a + np.flatnonzero(rows["query"][a:b])
                others = a + np.flatnonzero(~rows["query"][a:b])
                step = max(1, PAIRS // max(1, len(others)))
                for k in range(0, len(asks), step):
                    some = asks[k : k + step]
                    left.append(np.repeat(some, len(others)))
                    right.append(np.tile(others, len(some)))
                    waiting += len(left[-1])
                    if waiting >= PAIRS:
                        flush()
            flush()
            found -= told
            if len(told) > TOLD:
                told.clear()
            told.update(found)
            return listed(found)

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names} | {"bits": _words(batch.column("bits"))}
            rows = new if rest is None else {c: np.concatenate([rest[c], new[c]]) for c in new}
            change = np.flatnonzero((np.diff(rows["token"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            if len(change):  # the last cell may go on in the next batch
                yield done(rows, np.concatenate([[0], change]))
                rows = {c: x[change[-1] :] for c, x in rows.items()}
            rest = rows
        if rest is not None and len(rest["token"]):
            yield done(rest, np.array([0, len(rest["token"])]))
        yield listed({pair[1:] for pair in best.values()})

    return cells.mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document doc_id, text_hash, n_shingles, component_id; node names equal sets and part its component (null: no words)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    common.bound_batches(docs.sparkSession)
    began = mark()
    survey = stage(_survey(rows, n), "survey")
    level = _levels(survey)
    # Elements that only one set has are dropped; the others get their exact frequency among the prefixes.
    of_token = Window.partitionBy("token")
    elements = _prefixes(rows, level, n, num, den)
    elements = elements.select("*", F.count("*").over(of_token).alias("df"), F.min("node").over(of_token).alias("least"), F.max("node").over(of_token).alias("most"))
    elements = elements.filter("least <> most").drop("least", "most").distinct()
    # Order by frequency: dropped elements come first, then the rarest; q is the place in that order.
    nth, all_of = F.row_number().over(Window.partitionBy("node").orderBy("df", "token")), F.count("*").over(Window.partitionBy("node"))
    elements = elements.select("token", "node", "n", "p", "cut", (F.col("p") - all_of + nth - 1).cast("int").alias("q"))
    every = Window.partitionBy("token").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leads = [F.first(c).over(every).alias(f"{c}_lead") for c in ("node", "n", "p", "cut", "q")]
    near_front = F.col("q") <= F.col("n") - F.ceil(F.col("n") * num / den)  # else no partner of any size is left enough
    grouped = elements.filter(near_front).select("*", *leads, F.last("node").over(every).alias("last"))
    grouped = stage(grouped.filter("node_lead <> last").drop("last").withColumnRenamed("node_lead", "lead"), "groups")

    # What the pairs need of each node, and the one row whose text stands for it.
    first = F.min(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("row")
    nodes = survey.filter("node is not null").join(grouped.select(F.col("node").alias("x")).distinct(), F.col("node") == F.col("x"), "left_semi")
    nodes = nodes.groupBy("node").agg(first, F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    nodes = stage(nodes.select("node", "n", "bits", "row.*"), "nodes")

    # Round 1: every node against the first node that it shares most prefix shingles with.
    near = grouped.filter("node <> lead").filter(_may_link("", "_lead", num, den)).groupBy("node", "lead").agg(F.count("*").alias("k"))
    near = near.groupBy("node").agg(F.max_by("lead", F.struct("k", "lead")).alias("lead"))
    pairs = stage(near.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "pairs")
    tested, links, found, held = pairs, None, True, grouped
    while found:
        new = stage(_verified(pairs, nodes, rows, n, num, den), "links")
        found = not new.isEmpty()
        links = new if links is None else links.unionByName(new)
        parts = connected_components(links, "a", "b")
        # Next rounds: for every two components that meet, the node and first node that meet most often.
        held = _split_groups(held, parts)
        if found:
            met = held.filter("part <> lead_part").filter(_may_link("", "_lead", num, den))
            met = met.groupBy("part", "lead_part", "node", "lead").agg(F.count("*").alias("k"))
            pairs = met.groupBy(F.least("part", "lead_part").alias("p"), F.greatest("part", "lead_part").alias("q")).agg(F.max_by(F.struct("node", "lead"), F.struct("k", "node", "lead")).alias("r")).select("r.*")
            pairs = pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
            pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            found = not pairs.isEmpty()
            tested = tested.unionByName(pairs)

    # Groups of two rows, and turns: of every component in larger groups the likeliest pair and one by lot.
    more, counts = held.filter("members > 2"), []
    while not counts or 0 < counts[-1] >= counts[0] / 10:
        pairs = _open_pairs(more, nodes, num, den, turn=len(counts) + 1)
        pairs = pairs if counts else pairs.unionByName(_two_rows(held, num, den)).distinct()
        pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        new = stage(_verified(pairs, nodes, rows, n, num, den), "links")
        tested = tested.unionByName(pairs)
        counts.append(new.count())
        if counts[-1]:
            links = links.unionByName(new)
            parts = connected_components(links, "a", "b")
            more = _split_groups(more, parts)
        free_shuffles(rows.sparkSession)

    # Groups that still hold more than one component.
    last = stage(_open_pairs(more, nodes, num, den).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = stage(_verified(last, nodes, rows, n, num, den), "links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more), "a", "b")

    parts = stage(parts, "parts")
    release(began, survey, parts)
    documents = survey.filter("block is null").select("doc_id", "text_hash", "node", "n_shingles")
    named = documents.join(parts.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left")
    named = named.select("doc_id", "text_hash", "node", "n_shingles", F.coalesce("component", "node").alias("part"))
    smallest = named.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("smallest"))
    out = named.join(smallest, "part", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "node", "part", F.coalesce("smallest", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, with all their columns, less all but one of each component: that of the smallest id.

    Documents without words are in no component and stay.
    """
    began = mark()
    named = jaccard_components(docs, id_col=id_col, text_col=text_col, **how).select("doc_id", "text_hash", "part")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = named.filter("part is not null").groupBy("part").agg(F.min(first).alias("first"))
    chosen = stage(chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")), "chosen")
    release(began, chosen)
    key = "__text_hash"
    while key in docs.columns:
        key += "_"
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    wordless = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^ \t-\r]")
    kept = marked.filter(~wordless).join(chosen, docs[id_col].cast("long").eqNullSafe(chosen["__id"]) & (marked[key] == chosen["__hash"]), "left_semi")
    kept = kept.dropDuplicates([id_col, key])  # repeated rows
    return kept.unionByName(marked.filter(wordless)).drop(key)
