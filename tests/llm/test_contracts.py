"""Each operator against a brute-force version on a small hostile corpus."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import backoff, decontaminate, fingerprints, jaccard, packing, quality, repeats, shards, wordpieces
from loomwork.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def texts(corpus):
    return [(i * 3, t) for i, t in enumerate(corpus)]


@pytest.fixture(scope="module")
def docs(documents, texts):
    return documents(texts).cache()


# --- 1 fingerprints --------------------------------------------------------------------------


def test_fingerprints_and_edits(docs, texts):
    got = {r["doc_id"]: r for r in rows_of(fingerprints.edit_likeness(docs))}
    falling = sorted(texts, key=lambda x: -x[0])
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(falling):
        t, follow = t or "", falling[(k + 1) % len(falling)][1] or ""
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t) and r["edited_fingerprint"] == fingerprints.fingerprint(edited)
        assert math.isclose(r["near_edited"], fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"]), abs_tol=1e-9) and 0 <= r["near_next"] <= 1


def test_fingerprint_is_a_multiset_hash():
    a, b = "first paragraph of it", "second one, longer\nthird"
    assert fingerprints.fingerprint(f"{a}\n{b}") == fingerprints.fingerprint(f"{b}\n{a}") == fingerprints.combine(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    assert fingerprints.combine(fingerprints.fingerprint(f"{a}\n{b}"), fingerprints.fingerprint(b), -1) == fingerprints.fingerprint(a)
    assert fingerprints.fingerprint(f"{a}\n{a}") != fingerprints.fingerprint(a)
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint(a)) == 0 and fingerprints.fingerprint(None) == fingerprints.fingerprint("")


def test_edits_with_repeated_and_null_ids(documents):
    df = documents([(1, "aa bb"), (1, "aa bb"), (None, "zz"), (2, "cc dd ee")])
    assert fingerprints.edit_likeness(df).count() == 4
    assert fingerprints.edit_likeness(documents([(7, "abcd")])).first().near_next == 1.0


# --- 3 packing -------------------------------------------------------------------------------


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    got = rows_of(packing.pack_documents(docs, tokenizer_path()))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4")
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts:
        parts = sorted(pieces[i])
        whole = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert sum((p[1] for p in parts), []) == whole and all(p[2] == len(whole) for p in parts)
        assert [p[0] for p in parts] == [0, *itertools.accumulate(len(p[1]) for p in parts[:-1])]
    padding = total = 0
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [0, *itertools.accumulate(p[1] for p in parts[:-1])]
        n = sum(p[1] for p in parts)
        assert n <= 2048
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.01 * total


@pytest.mark.parametrize("text", ["It's we'll 12a'b_c  X__y don't", "İstanbul ǅ", "a\x1cb", "<|endoftext|> hi", "", "…—– “q”", "ª º ² ½", " x y", "ÀÉÿß"])
def test_cached_encoder_equals_the_tokenizer(text):
    e = packing.Encoder(tokenizer_path())
    assert np.frombuffer(e(text), dtype="<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_index_scores_are_bm25():
    docs = [np.array(x) for x in ([1, 2, 2, 3], [2, 3], [4, 4, 4], [5], [1, 6])]
    index, mean = packing.Index(docs), np.mean([len(d) for d in docs])
    for s, d in itertools.product(range(5), range(5)):
        want = 0.0
        for t in set(docs[s].tolist()):
            df, tf = sum(t in x for x in docs), int((docs[d] == t).sum())
            idf = math.log(max((5 - df + 0.5) / (df + 0.5), 1.0))
            want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        assert math.isclose(index.scores(s)[d], want, rel_tol=1e-5, abs_tol=1e-9)


def test_neighbours_share_a_window():
    a, b = np.arange(100, 700), np.arange(5000, 5600)
    order = packing.pack([a, b, a.copy(), b.copy(), np.arange(20000, 20600), np.arange(30000, 30600)], window=1200)
    by = defaultdict(set)
    for doc, _, _, sequence, _ in order:
        by[sequence].add(doc)
    assert {0, 2} in by.values() and {1, 3} in by.values()


# --- 4 token counts ---------------------------------------------------------------------------


def test_token_counts(docs, texts):
    vocabulary = set(wordpieces.byte_vocabulary(tokenizer_path())) | {(x,) for x in range(257)}
    most = max(map(len, vocabulary))

    def greedy(word):
        signs, at, n = [*word, wordpieces.END], 0, 0
        while at < len(signs):
            at += next(k for k in range(min(most, len(signs) - at), 0, -1) if tuple(signs[at : at + k]) in vocabulary)
            n += 1
        return n

    got = {r["doc_id"]: r for r in rows_of(wordpieces.token_counts(docs, tokenizer_path()))}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        assert got[i]["n_words"] == len(words) and got[i]["n_tokens"] == sum(map(greedy, words))


def test_automaton_on_every_small_string():
    tokens = [(0, 1, 0), (1, 1, 1, 0), (0, 2), (0, 2, 0, 1, 2), (1, 2, 1)]
    known, a = {*tokens, *((x,) for x in range(257))}, wordpieces.Automaton(tokens)
    for n in range(7):
        for s in itertools.product(range(3), repeat=n):
            at = count = 0
            while at < n:
                at += next(k for k in range(min(5, n - at), 0, -1) if s[at : at + k] in known)
                count += 1
            assert a.count(s) == count


# --- 5 repeats --------------------------------------------------------------------------------


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats(docs, texts, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    got = {r["doc_id"]: r for r in rows_of(repeats.remove_repeats(docs))}
    raw = {i: (t or "").encode() for i, t in texts}
    seen = Counter(t[k : k + 400] for t in raw.values() for k in range(len(t) - 399))
    for i, t in raw.items():
        mask = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                mask[k : k + 400] = b"\1" * 400
        r = got[i]
        assert bytes(r["kept"]) == bytes(b for b, m in zip(t, mask, strict=True) if not m)
        assert (r["n_bytes"], r["n_removed"], len(r["runs"])) == (len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))))


def test_maximal_repeats_name_all_occurrences():
    # one string three times, a longer one twice: (left, right, occurrences) by their common extents
    lefts = [b"bax"[::-1], b"bay"[::-1], b"qqz"[::-1]]
    found = {(left, right, tuple(sorted(part))) for left, right, part in repeats.maximal_repeats([b"ab", b"ab", b"qq"], [b"SEEDxx1", b"SEEDxx2", b"SEEDzz"], 4)}
    assert found == {(0, 4, (0, 1, 2)), (2, 6, (0, 1))}
    assert list(repeats.intervals(lefts, [0, 1, 2])) != []


# --- 6 shards ---------------------------------------------------------------------------------


def test_shards(docs, texts):
    got = rows_of(shards.shard_rows(docs, 4))
    by_id, sums, slots, where = dict(texts), Counter(), defaultdict(list), defaultdict(set)
    assert len(got) == len(texts)
    for r in got:
        t = (by_id[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    groups = Counter()
    for t, in ((t,) for t in where):
        groups[t] = sum(len((x or "").encode()) + 1 for _, x in texts if (x or "").encode() == t)
    assert max(sums.values()) <= sum(sums.values()) / 4 + max(groups.values())


def test_smallest_capacity_is_the_minimax():
    import random

    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        k = rng.randint(1, 4)
        best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cut, len(sizes)])) for m in range(min(k, len(sizes))) for cut in itertools.combinations(range(1, len(sizes)), m))
        assert shards.smallest_capacity(sizes, k) == best


def test_a_heavy_text_is_numbered_in_pieces(documents, monkeypatch):
    monkeypatch.setattr(shards, "PIECE_ROWS", 4)
    got = rows_of(shards.shard_rows(documents([(i, "same") for i in range(50)] + [(100, "other"), (None, None)]), 3))
    same = [r["slot"] for r in got if r["size"] == 5]
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(same) == 50 and all(sorted(s) == list(range(len(s))) for s in by.values())


# --- 7 Jaccard --------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for k, (i, _) in enumerate(texts):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(texts)}


def test_jaccard(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.jaccard_components(docs))}
    assert got == brute_components(texts)


def test_jaccard_near_the_threshold(documents):
    """Chains and rings of documents on either side of 0.75, in one large group."""
    import random

    rng = random.Random(2)
    core = [f"c{k}" for k in range(80)]
    texts = []
    for i in range(120):
        w = list(core)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 40)}"
        if i % 5 == 0:
            w += [f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 25))]
        texts.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.jaccard_components(documents(texts)))}
    assert got == brute_components(texts)


def test_a_dense_cluster_lists_no_pairs_of_its_own(documents, monkeypatch):
    import random

    rng = random.Random(5)

    def edited(k):
        words = [f"w{i}" for i in range(200)]
        for place in rng.sample(range(5, 195), k):
            words[place] = f"x{rng.random()}"
        return " ".join(words)

    # Texts of three edits are linked with those of two, mostly not with one another nor with the group's first one.
    texts = [(i, edited(2 if i % 12 == 0 else 3)) for i in range(60)]
    listed, plain = [], jaccard._open_pairs

    def counted(*args, **how):
        pairs = plain(*args, **how)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_open_pairs", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.jaccard_components(documents(texts)))}
    assert got == brute_components(texts)
    assert listed[-1] <= len(texts)


def test_one_of_each_component_stays(documents):
    text = "one two three four five six seven eight nine ten"
    df = documents([(4, text), (2, text.upper()), (2, text.upper()), (9, "quite another text than that one there"), (None, ""), (5, None)])
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (2, text.upper()), (5, ""), (9, "quite another text than that one there")]


# --- 8 leaks ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [
            (1, "A train leaves the station with Alice at 60 km per hour and returns with Alice after 3 hours, how far is it"),
            (2, "The quick brown fox jumps over the lazy dog and runs away from the very old house"),
            (3, "too short"), (4, None),
        ],
        "item_id long, text string",
    )


def test_leaks(documents, items):
    asked_again = "Start. A train leaves the station with Bob at 85 miles per hour and returns with Bob after 7 days, how far is it? End of it."
    contradicting = "A train leaves the station with Bob at 60 km per hour and returns with Carol after 3 hours, how far is it"
    rows = [
        (10, "intro words here. the quick brown FOX jumps over the lazy dog; and runs away from the very old house. more"),
        (11, asked_again), (12, contradicting), (13, "the quick brown fox met nobody on the way to the market that day at all"), (14, None), (15, ""),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in rows_of(decontaminate.leaks(documents(rows), items))}
    assert set(got) == {(10, 2), (11, 1)}
    assert got[11, 1]["verbatim"] is False and got[11, 1]["coverage"] == 1.0 and got[10, 2]["verbatim"] is True
    df = documents(rows)
    kept = decontaminate.clean_documents(df, items)
    assert sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 15] and kept.columns == df.columns


def test_a_contradiction_leaves_verbatim_runs(documents, spark):
    item = "Peter wrote that the old mill near Anna was sold to Anna in 12 parts before the great flood came over the wide green valley and took 12 bridges away with much of what the people of the place had ever built there"
    words = item.split()
    # A copy of 16 words, then other text in which a name stands by chance where the item repeats one.
    partial = " ".join(words[:9]) + " told to Berta " + "x y z u v w " * 8
    copied = " ".join(words[:25]) + " and took 15 " + "x y z u v w " * 8
    # All of the item, but two occurrences of one number no longer agree.
    edited = item.replace("took 12", "took 13")
    rows = [(1, copied), (2, edited), (3, partial)]
    got = {r["doc_id"]: r for r in rows_of(decontaminate.leaks(documents(rows), spark.createDataFrame([(1, item)], "item_id long, text string")))}
    assert set(got) == {1, 2} and got[2]["verbatim"] is True and got[1]["longest_run"] >= 13


def test_short_dense_and_folded_items(documents, spark):
    known = [
        (1, "Name the largest planet"),
        (2, "12 + 34 + 56 + 78 - 90 - 11 + 42 + 17"),
        (3, "Then pay 62.5 to Mary Ann or 1,200 to Tom by noon today"),
        (4, "Why not"),
        (5, "zorp blik frum dast gelp mirn ofta quun stel vack"),
    ]
    rows = [
        (1, "Some text. Name the largest planet. More text here"), (2, "so, 12 + 34 + 56 + 78 - 90 - 11 + 42 + 17 is what"),
        (3, "Then pay 7 to Tom or 30 to Ida May Bell by noon today"), (4, "Why not"), (5, "they ask why not and go"), (6, "so, 1 + 2 + 3 + 4 - 5 - 6 + 7 + 8"),
        *((10 + k, "pad " * k + "zorp blik frum dast gelp mirn") for k in range(3)),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.leaks(documents(rows), spark.createDataFrame(known, "item_id long, text string")))}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (10, 5), (11, 5), (12, 5)}


def test_far_fragments_are_no_leak(documents, spark):
    item = "zorp blik frum dast gelp mirn ofta quun stel vack wirp yold jask krem plon trub nelt hoff"
    w = item.split()
    a, b, c = (" ".join(w[k : k + 6]) for k in (0, 6, 12))
    far = " other words that say nothing" * 200 + " "
    rows = [(1, a + far + b + far + c), (2, b + " and " + a), (3, f"{a} indeed {b} and well {c}"), (4, a + " some more words " + b), (5, a + far + f"{a} or {b}")]
    got = {r["doc_id"]: r for r in rows_of(decontaminate.leaks(documents(rows), spark.createDataFrame([(1, item)], "item_id long, text string")))}
    assert {k: r["matched"] for k, r in got.items()} == {3: 18, 4: 12, 5: 12} and got[3]["coverage"] == 1.0


def test_long_runs_of_names_need_no_stack(documents, spark):
    item = "zorp blik frum dast gelp mirn ofta quun stel vack"
    run = "Anna " * 20_000
    rows = [(1, f"{item} so {run}went home"), (2, f"so {run}went home"), (3, f"so {run[:-1]}7 went home")]
    assert {r["doc_id"] for r in rows_of(decontaminate.leaks(documents(rows), spark.createDataFrame([(1, item)], "item_id long, text string")))} == {1}
    tokens = [r.t for r in documents(rows).orderBy("doc_id").select(decontaminate.template_tokens(F.col("text")).alias("t")).collect()]
    assert tokens[1] == ["so", decontaminate.NAME, "went", "home"] and tokens[2] == ["so", decontaminate.NAME, "anna7", "went", "home"]


def test_templates_keep_the_token_count(docs):
    wrong = docs.select(F.size(decontaminate.raw_tokens(F.coalesce("text", F.lit("")))).alias("a"), F.size(decontaminate.template_tokens(F.coalesce("text", F.lit("")))).alias("b")).filter("a <> b")
    assert wrong.count() == 0


# --- 9 language model -------------------------------------------------------------------------


@pytest.mark.parametrize("least", [1, 3])
def test_backoff_scores(docs, texts, least):
    got = {r["doc_id"]: r for r in rows_of(backoff.lm_scores(docs, least=least))}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall("[^\\x20\\x09-\\x0d]+", (t or "").translate(lower)) for i, t in texts}
    one = Counter(w for ws in words.values() for w in ws)
    two = Counter(p for ws in words.values() for p in itertools.pairwise(ws))
    size = one.total()
    for i, ws in words.items():
        want = math.log10(one[ws[0]] / size) if ws else 0
        for v, w in itertools.pairwise(ws):
            want += math.log10(two[v, w] / one[v]) if two[v, w] >= least else math.log10(0.4 * one[w] / size)
        r = got[i]
        assert r["n_words"] == len(ws) and math.isclose(r["log10_score"], want, rel_tol=1e-9, abs_tol=1e-9)
        assert (r["mean_log10"] is None) == (not ws) and (r["once_share"] is None) == (len(ws) < 2)
        if len(ws) > 1:
            assert math.isclose(r["once_share"], sum(two[p] == 1 for p in itertools.pairwise(ws)) / (len(ws) - 1))


def test_backoff_blocks_and_buckets(docs, monkeypatch):
    whole = sorted(map(repr, (tuple(r) for r in backoff.lm_scores(docs).collect())))
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(backoff, "BUCKET_BYTES", 3000)
    assert sorted(map(repr, (tuple(r) for r in backoff.lm_scores(docs).collect()))) == whole


# --- 2 and 10: held-out accuracy --------------------------------------------------------------


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def test_language_held_out(spark, sf01):
    got = QUERIES["op2_language"](spark, sf01).join(spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("acc"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.acc > 0.97
    odd = got.filter("held_out <> (pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1)").count()
    assert odd == 0 and got.filter("score < 0 or score > 1").count() == 0


def test_language_edge_cases(documents):
    from loomwork.llm import langid

    df = documents([(1, None), (2, ""), (3, "123 !!"), (4, "the house and the garden"), (None, "das haus und der garten")])
    net = langid.fit(df, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, net, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("en", "de")
    assert {r.lang_pred for r in langid.predict(df, None, ["doc_id"]).collect()} == {"und"}
    assert langid.fit(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None


def test_quality_held_out(spark, sf01):
    got = QUERIES["op10_quality"](spark, sf01)
    assert got.count() == spark.read.parquet(f"{sf01}/documents.parquet").count()
    both = got.join(spark.read.parquet(f"{sf01}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    auc = np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good])
    assert auc > 0.95 and (good >= 0.7).mean() > 0.97


def test_quality_without_labels(spark, documents):
    df = documents([(1, "a b"), (2, None), (3, "")])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(df, none, F.lit(True)) is None
    assert [r.score for r in quality.score(df, None, ["doc_id"]).collect()] == [0.5] * 3
    few = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, few, F.lit(True)), ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == 3


# --- empty tables -----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_sql_only_for_known_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


# --- queries against their SQL -----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = QUERIES[name](spark, sf)
    want = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
