"""Sharding by a minimax contiguous partition [DataFrame functions only].

Rows with equal texts form a group that is never cut.  Groups stand in the order
of their text's MD5, and the first 16 bits of it name one of 65,536 atoms; equal
texts always share an atom.  The atoms' sizes, a table of at most 65,536 rows
whatever the input, come to the driver; there the smallest capacity at which a
greedy pass needs no more than the wanted number of shards is found by binary
search, and the greedy pass at that capacity gives the cuts.

Each row then gets its shard by a broadcast join with the atoms (bounded as
above) and a gapless slot: rows are numbered inside a piece of an atom, and the
pieces' offsets are prefix sums of their counts.  A heavy atom is dealt into
pieces by its rows' ids, so one text that holds a third of all rows is numbered
by many tasks.

Defined cases: null text counts as the empty text, of size 1; an empty table gives
no rows; repeated rows are rows of their own with slots of their own; where one
group is larger than an even share, its shard is as large as that group demands.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.staging import stage

ATOM_BITS = 16
#: An atom with more rows than this multiple of an even share per piece is dealt out further.
PIECE_ROWS = 4096
MAX_PIECES = 1 << 17


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which greedy filling in order needs at most ``shards`` shards."""
    if not sizes:
        return 0
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if len(cuts_at(ends, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cuts_at(ends: list[int], capacity: int) -> list[int]:
    """Greedy: for each shard the index after its last atom. ``ends`` are prefix sums; no atom is over the capacity."""
    cuts, at, base = [], 0, 0
    while at < len(ends):
        at = max(at + 1, bisect_right(ends, base + capacity, at))
        base = ends[at - 1]
        cuts.append(at)
    return cuts


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row, shard sizes in bytes as even as the groups allow."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, ATOM_BITS // 4), 16, 10).cast("int").alias("atom"),
        ),
        "shard-rows",
    )
    atoms = rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("atom").collect()
    total = sum(a["n"] for a in atoms)
    # Pieces: every atom has one, heavy ones more, at most MAX_PIECES together.
    goal = max(PIECE_ROWS, -(-total // (MAX_PIECES - (1 << ATOM_BITS))))
    pieces = {a["atom"]: -(-a["n"] // goal) for a in atoms}
    heavy = {k: n for k, n in pieces.items() if n > 1}
    if heavy:
        wide = F.broadcast(spark.createDataFrame(list(heavy.items()), "atom int, pieces int"))
        rows = rows.join(wide, "atom", "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))).drop("pieces")
        counted = {(r[0], r[1]): r[2] for r in rows.join(wide, "atom", "left_semi").groupBy("atom", "piece").count().collect()}
    else:
        rows, counted = rows.withColumn("piece", F.lit(0)), {}

    ends = list(accumulate(a["bytes"] for a in atoms))
    cuts = cuts_at(ends, smallest_capacity([a["bytes"] for a in atoms], shards))
    placed, shard, slot = [], 0, 0
    for i, a in enumerate(atoms):
        if i >= cuts[shard]:
            shard, slot = shard + 1, 0
        for piece in range(pieces[a["atom"]]):
            placed.append((a["atom"], piece, shard, slot))
            slot += counted.get((a["atom"], piece), 0) if a["atom"] in heavy else a["n"]
    where = F.broadcast(spark.createDataFrame(placed or [(0, 0, 0, 0)], "atom int, piece int, shard int, first long"))
    within = Window.partitionBy("atom", "piece").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(where, ["atom", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"))
