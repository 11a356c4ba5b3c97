"""Benchmark decontamination by template canonicalisation [DataFrame functions only].

Texts become templates: words in lower case without punctuation, in which numbers,
names (capitalised words inside a sentence) and units after a number are typed
placeholders.  A number with its separators is one token, and so is a run of names.
So a question asked again with other numbers, names or units has the same template.

1. All windows of 6 tokens of documents and benchmark items are hash-joined, raw and as
   templates, so a shared run of 6 tokens always gives a hit.  As a template, an item
   window that is more than half placeholders says nothing; it is met by its raw tokens.
   Items of 3 to 5 tokens are one window of their length, joined in the same way; those
   of 1 or 2 tokens are met by documents that hold nothing else.
2. A hit fixes an alignment (document place minus item place).  Along it the item's
   tokens are compared with the document's, raw and as templates.
3. Verbatim evidence comes first: the longest run of equal raw tokens counts whatever
   slots stand elsewhere.
4. Slot consistency, for evidence by placeholders: within a run of consecutive places
   every item value must stand for one document value, or the run is dropped; of the
   other runs only the slots that contradict a run of a window or more are ignored.
5. The runs of all alignments of an item are joined into chains: in the order of the
   item, each no further behind the one before than the item is long.  A document is
   reported for an item if a chain holds at least half of the item's tokens, or 13 in
   a row.

The item windows are broadcast only up to ``BROADCAST_WINDOWS`` of them (counted
first); beyond, the same join is shuffled.  Only the texts of documents with a hit are
read again; they are found at the scan by the hits' names up to ``BROADCAST_HITS`` of
them (counted), beyond by a shuffled join.  Their tokens are written once (staged), so
that nothing above them splits a text again.

Defined cases: null and empty texts match nothing; a repeated document row is reported once for each row; equal items are items
of their own; null ids are kept; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.staging import stage

W = 6
#: Items of fewer tokens are phrases of any text.
LEAST_INSIDE = 3
MIN_COVERAGE, MIN_RUN = 0.5, 13
BROADCAST_WINDOWS = 500_000
BROADCAST_HITS = 500_000

# Private-use signs stand for the placeholders, so that no text's own word is one.
NAME, NUMBER, UNIT = "", "", ""
#: Stands for what separates the parts of one number, or the names of one run.
JOINT = ""
#: Fixed list: unit words that count after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms ton tons "
    "ml l cl liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years usd eur gbp dollar dollars cent cents euro euros pound pounds percent degree degrees kmh mph kph "
    "byte bytes kb mb gb tb hz khz mhz ghz w kw watt watts v volt volts meter meters metre metres kilometer kilometers"
)
_NOT_WORD = r"[^\p{L}\p{N}\x{E001}\x{E004}]+"
# Possessive: a shorter run would end before one of the signs that may not follow, and a loop that can go
# back takes a stack frame for each name, so that a run of a few thousand would end its executor.
_NAMES = r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}++(?:\x{E004}\p{Lu}\p{Ll}++)*+(?![\p{L}\p{N}\x{E004}])"
_IN_NUMBER = r"(?<=\p{N})[.,:'](?=\p{N})"
_IN_NAMES = r" (?=\p{Lu}\p{Ll}+(?![\p{L}\p{N}]))(?<=[\p{Ll}\p{N},;] \p{Lu}\p{Ll}{1,40} )"


def tagged_tokens(text: Column) -> Column:
    """Words and numbers in lower case, in order; a placeholder's sign stands before the token that it may stand for."""
    named = _plain(F.regexp_replace(_joined(text), _NAMES, NAME + "$0"))
    numbered = F.regexp_replace(named, r"(?<![^ ])(?=\p{N})", NUMBER)
    return F.split(F.regexp_replace(numbered, f"({NUMBER}\\S* )(?=(?:{'|'.join(UNITS.split())})(?: |$))", "$1" + UNIT), " ")


def raw_of(token: Column) -> Column:
    return F.ltrim(token, F.lit(NAME + NUMBER + UNIT))


def template_of(token: Column) -> Column:
    return F.when((token >= NAME) & (token < JOINT), F.substring(token, 1, 1)).otherwise(token)


def raw_tokens(text: Column) -> Column:
    return F.transform(tagged_tokens(text), raw_of)


def template_tokens(text: Column) -> Column:
    """As many tokens as ``raw_tokens``, with typed placeholders."""
    return F.transform(tagged_tokens(text), template_of)


def _joined(text: Column) -> Column:
    # The signs themselves are no part of a text's words.
    return F.regexp_replace(F.regexp_replace(F.translate(text, NAME + NUMBER + UNIT + JOINT, "    "), _IN_NUMBER, JOINT), _IN_NAMES, JOINT)


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, _NOT_WORD, " ")))


def _is_slot(token: Column) -> Column:
    return token.isin(NAME, NUMBER, UNIT)


def _windows(rows: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_hash, at, window: the hashes of all windows of the texts, as templates and, where they differ, raw.

    Lists of single token hashes are shifted against each other and exploded together, so
    that windows are hashed by compiled code, row by row.
    """
    tagged = rows.select("doc_id", "text_hash", tagged_tokens(F.col("text")).alias("tokens"))
    hashed = tagged.select("doc_id", "text_hash", F.transform("tokens", lambda t: F.xxhash64(template_of(t))).alias("t"), F.transform("tokens", lambda t: F.xxhash64(raw_of(t))).alias("r"))
    padding = F.array_repeat(F.lit(None).cast("long"), W - 1)
    padded = hashed.select("doc_id", "text_hash", F.size("t").alias("size"), F.concat("t", padding).alias("t"), F.concat("r", padding).alias("r"))
    shifted = F.arrays_zip(*[F.slice(c, k + 1, F.col("size")).alias(f"{c}{k}") for c in "tr" for k in range(W)])
    places = padded.select("doc_id", "text_hash", "size", F.posexplode(shifted).alias("at", "w")).select("doc_id", "text_hash", "size", "at", "w.*")
    names = []
    for width in widths:
        inside = F.col(f"t{width - 1}").isNotNull() & (F.lit(width >= LEAST_INSIDE) | (F.col("size") == width))
        template, raw = (F.xxhash64(*[f"{c}{k}" for k in range(width)]) for c in "tr")
        names += [F.when(inside, template), F.when(inside & (template != raw), raw)]
    return places.select("doc_id", "text_hash", "at", F.explode(F.array(*names)).alias("window")).filter("window is not null")


def _named(window: Column) -> Column:
    """The hash of a list of 1 to W tokens, as ``_windows`` has it."""
    of = lambda width: F.xxhash64(*[F.xxhash64(F.get(window, F.lit(k))) for k in range(width)])
    return F.coalesce(*[F.when(F.size(window) == width, of(width)) for width in range(W, 0, -1)])


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, matched, item_tokens, coverage, longest_run, slots, verbatim of every leak."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), tagged_tokens(text).alias("tokens"))
    items = items.select("item_id", F.transform("tokens", raw_of).alias("item_raw"), F.transform("tokens", template_of).alias("item"))
    items = stage(items.filter(F.get("item_raw", F.lit(0)) != "").withColumn("item_row", F.xxhash64("item_id", "item_raw")).distinct(), "items")
    n = F.size("item")
    short = sorted(r[0] for r in items.filter(n < W).select(n).distinct().collect())  # at most W - 1 numbers
    placed = items.select("item_row", "item", "item_raw", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(n - W, F.lit(0)))).alias("at"))
    template, raw = (F.slice(F.col(c), F.col("at") + 1, W) for c in ("item", "item_raw"))
    telling = F.size(F.filter(template, lambda t: ~_is_slot(t))) * 2 >= F.size(template)
    either = F.array_distinct(F.array(F.when(telling, _named(template)), _named(raw)))
    windows = stage(placed.select("item_row", "n", F.col("at").alias("item_at"), F.explode(either).alias("window")).filter("window is not null"), "windows")
    if windows.count() <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)

    hits = _windows(rows, [*short, W]).join(windows, "window").select("doc_id", "text_hash", "item_row", "n", (F.col("at") - F.col("item_at")).alias("shift"))
    met = hits.groupBy("doc_id", "text_hash", "item_row").agg(F.collect_set("shift").alias("shifts"), F.first("n").alias("n"))
    wanted = stage(met.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list(F.struct("item_row", "n", "shifts")).alias("met")), "hits")

    # A document is split into tokens once; of its tokens only the stretches that lie along an item go on.
    same = rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["text_hash"] == wanted["hash"])
    texts = rows
    if wanted.count() <= BROADCAST_HITS:
        texts = rows.join(F.broadcast(wanted.select("id", "hash")), same, "left_semi")
    both = texts.join(wanted, same).select("doc_id", "text_hash", "met", tagged_tokens(F.col("text")).alias("tokens"))
    both = stage(both.select("doc_id", "text_hash", "met", F.transform("tokens", template_of).alias("doc"), F.transform("tokens", raw_of).alias("doc_raw")), "hit-tokens")

    def stretch(shift: Column, n: Column) -> Column:
        at = F.greatest(shift, F.lit(0))
        size = F.least(shift + n, F.size("doc")) - at
        return F.struct(shift.alias("shift"), at.alias("at"), F.slice("doc", at + 1, size).alias("t"), F.slice("doc_raw", at + 1, size).alias("r"))

    cut = F.transform("met", lambda m: F.struct(m["item_row"].alias("item_row"), F.transform(m["shifts"], lambda s: stretch(s, m["n"])).alias("along")))
    both = both.select("doc_id", "text_hash", F.explode(cut).alias("m")).select("doc_id", "text_hash", "m.*").join(items, "item_row")
    along = F.transform("along", _aligned)
    # The arrays pass through explode, so that no later filter computes them again.
    held = both.select("doc_id", "text_hash", "item_id", F.size("item").alias("item_tokens"), F.explode(F.array(along)).alias("along"))
    return _measured(held).filter((F.col("coverage") >= MIN_COVERAGE) | (F.col("longest_run") >= MIN_RUN))


def _aligned(seg: Column) -> Column:
    """places: struct(i, j, slot, of, is) where item and document agree along one shift; literal: the longest run of equal raw tokens."""
    i = F.sequence(seg["at"] - seg["shift"], seg["at"] - seg["shift"] + F.size(seg["t"]) - 1)

    def place(i: Column) -> Column:
        k = i + seg["shift"] - seg["at"]
        of, got = F.get("item_raw", i), F.get(seg["r"], k)
        same = of == got
        return F.struct(i.alias("i"), (i + seg["shift"]).alias("j"), _is_slot(F.get("item", i)).alias("slot"), of.alias("of"), got.alias("is"),
                        same.alias("same"), (same | (F.get("item", i) == F.get(seg["t"], k))).alias("like"))

    every = F.transform(i, place)
    likes, same = _runs(F.filter(every, lambda p: p["like"])), _runs(F.filter(every, lambda p: p["same"]))
    literal = F.coalesce(F.array_max(F.transform(same, F.size)), F.lit(0))
    return F.struct(_agreeing(F.filter(likes, _consistent), F.least(F.lit(W), F.size("item"))).alias("places"), literal.alias("literal"))


def _runs(places: Column) -> Column:
    """Places in order cut into runs of consecutive ones: those keep the difference from their index."""
    keyed = F.transform(places, lambda p, k: F.struct((p["i"] - k).alias("key"), p.alias("p")))
    keys = F.array_distinct(F.transform(keyed, lambda x: x["key"]))
    return F.transform(keys, lambda key: F.transform(F.filter(keyed, lambda x: x["key"] == key), lambda x: x["p"]))


def _slots(places: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(places, lambda p: p["slot"]), lambda p: F.struct(p["of"].alias("of"), p["is"].alias("is"))))


def _consistent(places: Column) -> Column:
    mapped = _slots(places)
    return F.size(mapped) == F.size(F.array_distinct(F.transform(mapped, lambda x: x["of"])))


def _agreeing(runs: Column, window: Column) -> Column:
    """The places of runs that each agree in themselves, without slots that contradict the runs of a window or more (or, outside of those, any run)."""
    core = _slots(F.flatten(F.filter(runs, lambda r: F.size(r) >= window)))
    every = _slots(F.flatten(runs))

    def stays(p: Column, among: Column) -> Column:
        return ~p["slot"] | ~F.exists(among, lambda x: (x["of"] == p["of"]) & (x["is"] != p["is"]))

    kept = F.transform(runs, lambda r: F.when(F.size(r) >= window, F.filter(r, lambda p: stays(p, core))).otherwise(F.filter(r, lambda p: stays(p, every))))
    return F.flatten(kept)


def _chained(runs: Column, near: Column) -> Column:
    """struct(open, placed, longest): the most places of a chain of runs, and of its runs that follow each other in the item.

    ``runs`` come in the order of the document, so ends further back than ``near`` are not kept open.
    """
    end = "array<struct<i:int,j:int,placed:int,longest:int>>"

    def most(ends: Column, name: str) -> Column:
        return F.coalesce(F.array_max(F.transform(ends, lambda o: o[name])), F.lit(0))

    def step(done: Column, run: Column) -> Column:
        open_ends = F.filter(done["open"], lambda o: o["j"] + near >= run["j"])
        before = F.filter(open_ends, lambda o: (o["i"] < run["i"]) & (o["j"] < run["j"]))
        placed = run["n"] + most(before, "placed")
        longest = run["n"] + most(F.filter(before, lambda o: o["i"] + 1 == run["i"]), "longest")
        last = F.struct((run["i"] + run["n"] - 1).alias("i"), (run["j"] + run["n"] - 1).alias("j"), placed.alias("placed"), longest.alias("longest"))
        return F.struct(F.concat(open_ends, F.array(last)).alias("open"), F.greatest(done["placed"], placed).alias("placed"), F.greatest(done["longest"], longest).alias("longest"))

    start = F.struct(F.array().cast(end).alias("open"), F.lit(0).alias("placed"), F.lit(0).alias("longest"))
    return F.aggregate(runs, start, step)


def _measured(held: DataFrame) -> DataFrame:
    """One row for each pair of a document row and an item, with its evidence."""
    every = F.flatten(F.transform("along", lambda a: a["places"]))
    literal = F.array_max(F.transform("along", lambda a: a["literal"]))
    cut = F.flatten(F.transform("along", lambda a: _runs(a["places"])))
    runs = F.array_sort(F.transform(cut, lambda r: F.struct(r[0]["j"].alias("j"), r[0]["i"].alias("i"), F.size(r).alias("n"))))
    got = held.select("doc_id", "text_hash", "item_id", "item_tokens", literal.alias("literal"), _slots(every).alias("mapped"), F.explode(F.array(runs)).alias("runs"))
    chain = _chained(F.col("runs"), F.col("item_tokens"))
    got = got.select("doc_id", "text_hash", "item_id", "item_tokens", "literal", "mapped", F.explode(F.array(chain)).alias("chain")).withColumns({"placed": F.col("chain.placed"), "longest": F.col("chain.longest")})
    matched = F.greatest("placed", "literal")
    return got.select(
        "doc_id", "text_hash", "item_id", matched.alias("matched"), "item_tokens", (matched / F.col("item_tokens")).alias("coverage"), F.greatest("longest", "literal").alias("longest_run"),
        F.size("mapped").alias("slots"), ((F.col("literal") >= F.col("placed")) | F.forall("mapped", lambda x: x["of"] == x["is"])).alias("verbatim"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no leak, with all their columns."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (text == found["__hash"]), "left_anti")
