"""Packing by lexical retrieval: a sharded BM25 index fills each window with the seed's nearest unused documents.

Texts are tokenized (a public vocabulary; its path is a parameter) where they are
read and dealt to shards of about ``SHARD_DOCS`` documents.  A shard is one task's
work of bounded size: its documents' full windows of 2048 ids become sequences, and
what is left of each is a remainder.  Over the remainders a BM25 inverted index is
built.  Remainders are taken as seeds in order; a seed's query is its whole
content, all of its terms, and unused neighbours follow by falling score until the
window is full.  The last neighbour is cut to fit and the rest of it stays unused
for a later window.  When a seed has no more unused neighbours with a positive
score, the next unused remainder in order goes on, as a seed of its own, so that
windows are full.  A shard's last window, if not full, is cut into sequences whose
lengths are powers of two, which need no padding.

BM25 uses the classic inverse document frequency floored at zero, so terms in more
than half of a shard's remainders have no weight and their postings are left out
without changing a score.

Defined cases: null text is empty and a document of no ids still gets the closing
id; repeated rows are documents of their own; null ids are kept; an empty table
gives no rows; texts longer than a window are cut; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

common.by_value(__name__)

WINDOW = 2048
SHARD_DOCS = 1500
END_ID = 1
K1, B = 1.2, 0.75
#: Words known by heart in a worker; beyond this the table starts anew.
KNOWN_WORDS = 400_000
#: Longer words are not kept, so that the table's memory is bounded.
KNOWN_LENGTH = 64

# Text in which splitting at white space and caching by word is exact: ASCII without
# control signs and apostrophes, and composed Latin letters that lower-case to one letter.
_PLAIN = re.compile(r"[\n\t !-&(-~ß-öø-ÿÀ-ÖØ-Þ]*")
_PIECE = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


class Encoder:
    """Ids of a text by a `tokenizers` file, as packed little-endian 32-bit bytes; words are cached."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.bytes = _byte_letters()
        encoder = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(encoder.bytes)
                ids = array("I", [t.id for t in encoder.model.tokenize(letters)]).tobytes()
                if len(piece) <= KNOWN_LENGTH:
                    self[piece] = ids
                return ids

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                word_ = word.lower()
                found = (word_,) if word_.isalpha() else _PIECE.findall(word_)
                ids = b"".join([encoder.pieces[p] for p in found])
                if len(word) <= KNOWN_LENGTH:
                    self[word] = ids
                return ids

        self.pieces, self.words = Pieces(), Words()

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
            self.pieces.clear()
        return b"".join([self.words[w] for w in text.split()])


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies write for bytes that are none themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return {b: letter for b, letter in enumerate(out) if ord(letter) != b}


def encoder(path: str) -> Encoder:
    cache = common.worker_cache("packing")
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


class Index:
    """A shard's inverted index with BM25 weights in its postings."""

    def __init__(self, remainders: list[np.ndarray]):
        n = len(remainders)
        lengths = np.array([len(r) for r in remainders], dtype=np.float64)
        width = int(max((int(r.max()) for r in remainders if len(r)), default=0)) + 1
        keys = np.concatenate([r.astype(np.int64) * n + i for i, r in enumerate(remainders)]) if n else np.empty(0, np.int64)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.diff(np.append(first, len(keys))).astype(np.float64)
        terms, docs = np.divmod(keys[first], n) if n else (keys, keys)
        df = np.bincount(terms, minlength=width)
        idf = np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1.0))
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / max(1.0, lengths.mean())))
        some = weight > 0
        self.n, terms = n, terms[some]
        self.docs, self.weights = docs[some].astype(np.int32), weight[some].astype(np.float32)
        self.starts = np.searchsorted(terms, np.arange(width + 1))
        by_doc = np.argsort(self.docs, kind="stable")
        self.doc_terms, self.doc_starts = terms[by_doc], np.searchsorted(self.docs[by_doc], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every remainder for the query of all of the seed's terms."""
        terms = self.doc_terms[self.doc_starts[seed] : self.doc_starts[seed + 1]]
        begin, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)


def pack(documents: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard."""
    out, sequence, remainders, where = [], 0, [], []
    for i, ids in enumerate(documents):
        full = len(ids) // window * window
        for start in range(0, full, window):
            out.append((i, start, window, sequence, 0))
            sequence += 1
        if full < len(ids):
            remainders.append(ids[full:])
            where.append((i, full))
    index = Index(remainders)
    left = np.array([len(r) for r in remainders], dtype=np.int64)
    taken = np.zeros(len(remainders), dtype=np.int64)
    following, filled, room = 0, [], window
    while following < len(remainders):
        if not left[following]:
            following += 1
            continue
        queue, at, seed = None, 0, following
        while room and left[seed]:  # the seed, then its neighbours by falling score
            size = int(min(room, left[seed]))
            filled.append((*where[seed], int(taken[seed]), size))
            taken[seed] += size
            left[seed] -= size
            room -= size
            if not room:
                break
            if queue is None:
                score = np.where(left > 0, index.scores(seed), 0.0)
                some = np.flatnonzero(score)
                queue = some[np.lexsort((some, -score[some]))]
            while at < len(queue) and not left[queue[at]]:
                at += 1
            if at == len(queue):
                break
            seed = int(queue[at])
        if not room:
            out += _laid(filled, sequence)
            sequence, filled, room = sequence + 1, [], window
    tail = sum(x[3] for x in filled)
    while tail:  # powers of two
        part, size, rest = [], 1 << (tail.bit_length() - 1), 1 << (tail.bit_length() - 1)
        while rest:
            doc, base, start, n = filled.pop(0)
            part.append((doc, base, start, min(n, rest)))
            if n > rest:
                filled.insert(0, (doc, base, start + rest, n - rest))
            rest -= part[-1][3]
        out += _laid(part, sequence)
        sequence, tail = sequence + 1, tail - size
    return out


def _laid(filled: list[tuple], sequence: int) -> list[tuple]:
    offset, out = 0, []
    for doc, base, start, n in filled:
        out.append((doc, base + start, n, sequence, offset))
        offset += n
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed little-endian uint32), doc_tokens, sequence_id, offset."""
    common.bound_batches(docs.sparkSession)
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def tokenize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids, shard = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                ids.append(np.frombuffer(encode(text) + end, dtype="<u4"))
                shard.append(zlib.crc32(f"{i} {len(text)}".encode()) % shards)
            packed = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\0" + x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column("doc_id"), pa.array(packed, pa.binary())], names=["shard", "doc_id", "ids"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts = None, [], []
        for batch in batches:
            for s, i, raw in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if s != shard and ids:
                    yield _pieces(shard, ids, texts, window)
                    ids, texts = [], []
                shard, raw = s, raw.as_py()
                ids.append(i)
                texts.append(np.frombuffer(raw, dtype="<u2") if len(raw) % 2 == 0 else np.frombuffer(raw[1:], dtype="<u4"))
        if ids:
            yield _pieces(shard, ids, texts, window)

    dealt = rows.mapInArrow(tokenize, "shard int, doc_id bigint, ids binary").repartition("shard").sortWithinPartitions("shard", "doc_id", "ids")
    return dealt.mapInArrow(fill, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def _pieces(shard: int, ids: list, texts: list[np.ndarray], window: int) -> pa.RecordBatch:
    rows = pack(texts, window)
    at = [r[0] for r in rows]
    arrays = [
        pa.array([ids[i] for i in at], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.int64()),
        pa.array([texts[r[0]][r[1] : r[1] + r[2]].astype("<u4").tobytes() for r in rows], pa.binary()),
        pa.array([len(texts[i]) for i in at], pa.int64()),
        pa.array([(shard << 32) + r[3] for r in rows], pa.int64()),
        pa.array([r[4] for r in rows], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
