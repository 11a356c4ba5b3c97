"""Token counts by a linear longest-match automaton.

The vocabulary's tokens form a trie over bytes, with one more sign for the end of
a word.  Each node has a failure link: where greedy longest match goes on after it
has popped the longest tokens that the node's string gives; how many tokens that
pops is stored with the link.  A word is read once, byte by byte; its token count
is the sum of the popped counts.  No token is built, no byte is read twice, and a
word costs time in proportion to its length, however long.

Greedy longest match is what word-piece tokenizers do; with a byte-pair vocabulary
it is a bound-free stand-in for its counts, not the merges' own result.

Defined cases: null and white-space-only texts have 0 words and 0 tokens; a byte
that the vocabulary lacks is a token of its own; repeated rows count alike; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

common.by_value(__name__)

END = 256
#: Words kept in a worker, of at most so many bytes each.
KNOWN_WORDS, KNOWN_LENGTH = 400_000, 64


def byte_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Tokens of a byte-level BPE file with word ends, as tuples of bytes with END last in word-final ones."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letter, spare = {}, 256
    for b in range(256):
        letter[chr(b if b in shown else spare)] = b
        spare += b not in shown
    out = []
    for name in names:
        body = name.removesuffix("</w>")
        if body and all(c in letter for c in body):
            out.append((*(letter[c] for c in body), *([END] if body != name else [])))
    return out


class Automaton:
    """Trie with failure links and popped-token counts; every single sign is a token."""

    def __init__(self, tokens: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for token in [*((sign,) for sign in range(END + 1)), *tokens]:
            node = 0
            for sign in token:
                if sign not in self.next[node]:
                    self.next[node][sign] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][sign]
            final[node] = True
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:  # breadth first: a link leads to a shorter string
            node = queue.popleft()
            for sign, child in self.next[node].items():
                if final[child]:
                    self.pops[child] = 1
                else:
                    at, popped = self.fail[node], self.pops[node]
                    while sign not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    self.fail[child], self.pops[child] = self.next[at][sign], popped
                queue.append(child)

    def count(self, signs: Iterable[int]) -> int:
        """Number of tokens of greedy longest match."""
        node, total, step, fail, pops = 0, 0, self.next, self.fail, self.pops
        for sign in signs:
            while sign not in step[node]:
                total += pops[node]
                node = fail[node]
            node = step[node][sign]
        while node:
            total += pops[node]
            node = fail[node]
        return total


def token_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words and n_tokens of every whole text (A-Z folded, words at ASCII white space); no shuffle."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = common.worker_cache("wordpieces")
        if ("pieces", vocabulary_path) not in cache:
            automaton = Automaton(byte_vocabulary(vocabulary_path))

            class Counts(dict):
                def __missing__(self, word: bytes) -> int:
                    n = automaton.count([*word, END])
                    if len(word) <= KNOWN_LENGTH:
                        self[word] = n
                    return n

            cache["pieces", vocabulary_path] = Counts()
        known = cache["pieces", vocabulary_path]
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("__text"):
                found = text.as_py().encode("utf-8", "surrogatepass").lower().split()
                if len(known) > KNOWN_WORDS:
                    known.clear()
                words.append(len(found))
                tokens.append(sum([known[w] for w in found]))
            arrays = [*(batch.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_words", "n_tokens"])

    return rows.mapInArrow(run, ", ".join([*kinds, "n_words bigint", "n_tokens bigint"]))
