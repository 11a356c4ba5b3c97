"""The queries of this package: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontaminate, fingerprints, jaccard, langid, packing, quality, repeats, shards, wordpieces
from .common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(read(spark, sf_dir, "documents"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard_rows(read(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_tokens", "coverage", "longest_run", "slots", "verbatim")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(read(spark, sf_dir, "documents"), length=400)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = langid.fold("doc_id", 3) == 1
    net = langid.fit(docs, ~held_out)
    return langid.predict(docs.withColumn("held_out", held_out), net, ["doc_id", "held_out"])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backoff.lm_scores(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", *(F.round(c, 4).alias(c) for c in ("log10_score", "mean_log10", "once_share")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = langid.fold("doc_id", 4) == 2
    space = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs.withColumn("held_out", held_out), space, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_repeats": op5_repeats,
    "op6_shards": op6_shards,
    "op7_jaccard": op7_jaccard,
    "op8_leaks": op8_leaks,
    "op9_lm_scores": op9_lm_scores,
    "op10_quality": op10_quality,
}

# Strings of 400 bytes are told apart by MD5; a start that is not alone in its class marks its 400 bytes.
_REPEATS_SQL = """with t as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, md5(b[i:i + 399]) as h from (select doc_id, b, unnest(range(1, n - 398)) as i from t where n >= 400)),
s as (select doc_id, i from w where h in (select h from w group by h having count(*) > 1)),
f as (select doc_id, i, case when i <= lag(i) over o + 400 then 0 else 1 end as fresh from s window o as (partition by doc_id order by i)),
g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as k from f),
r as (select doc_id, k, min(i) as first, max(i) + 399 as last from g group by doc_id, k),
v as (select doc_id, first, coalesce(lag(last) over (partition by doc_id order by first), 0) + 1 as since, last from r),
k as (select v.doc_id, sum(last - first + 1)::bigint as n_removed, count(*) as n_spans, string_agg(case when first > since then hex(b[since:first - 1]) else '' end, '' order by first) as front, max(last) as last from v join t on t.doc_id = v.doc_id group by v.doc_id)
select t.doc_id, t.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
sha256(unhex(coalesce(front, '') || case when coalesce(k.last, 0) < t.n then hex(b[coalesce(k.last, 0) + 1:n]) else '' end)) as kept_sha256 from t left join k on k.doc_id = t.doc_id"""

# Shingles are compared as they are, pairs by what they share, components by reach.
_JACCARD_SQL = r"""with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, md5(unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as shingle from t),
n as (select doc_id, count(*) as n from s group by doc_id), p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)), e as (select a, b from l union select b, a from l),
r as (select a as node, a as reach from e union select r.node, e.b from r join e on r.reach = e.a), c as (select node, min(reach) as least from r group by 1)
select t.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.least, t.doc_id) as component_id from t left join n on n.doc_id = t.doc_id left join c on c.node = t.doc_id"""

# All pairs that are scored occur, and all counts are kept, so only first words leave the pairs.
_BACKOFF_SQL = r"""with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, i, w[i] as w, case when i > 1 then w[i - 1] end as v from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t)),
one as (select w, count(*) as c from p group by w), two as (select v, w, count(*) as c from p where v is not null group by v, w), size as (select count(*) as n from p),
s as (select p.doc_id, count(*) as n_words, sum(case when p.v is null then log10(one.c / n) else log10(two.c) - log10(before.c) end) as total, avg(case when p.v is not null then (two.c = 1)::int end) as once
from size, p join one on one.w = p.w left join two on two.v = p.v and two.w = p.w left join one before on before.w = p.v group by p.doc_id)
select t.doc_id, coalesce(n_words, 0) as n_words, round(coalesce(total, 0), 4)::double as log10_score, round(total / n_words, 4)::double as mean_log10, round(once, 4)::double as once_share from t left join s on s.doc_id = t.doc_id"""

ORACLE_SQL: dict[str, str] = {"op5_repeats": _REPEATS_SQL, "op7_jaccard": _JACCARD_SQL, "op9_lm_scores": _BACKOFF_SQL}
