"""Registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import language_id, language_model, toxicity
from tabprobe.llm.common import fold_of, table
from tabprobe.llm.exact_dedup import exact_duplicates
from tabprobe.llm.hard_negatives import hard_negatives
from tabprobe.llm.mixing import mixed
from tabprobe.llm.ngram_join import similar_groups
from tabprobe.llm.packing import pack
from tabprobe.llm.sharding import sharded
from tabprobe.llm.substring_dedup import without_repeats
from tabprobe.llm.token_counts import token_counts
from tabprobe.llm.vector_search import nearest
from tabprobe.llm.whitening import whitened


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.filter((fold_of("doc_id", 3) != 1) & F.col("lang").isNotNull())
    model = language_id.train(labelled, docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share at least three quarters of their word 5-grams."""
    return similar_groups(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").filter(
        (fold_of("doc_id", 5) != 0) & F.col("toxic").isNotNull())
    found = toxicity.score(docs, toxicity.train(labelled, docs))
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score",
                        "predicted")


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that occur again; shorter passages stay."""
    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


#: Target weights of the mixture; sources weigh alike within a language.
WEIGHTS = {
    ("web",): 5.0, ("books",): 3.0, ("forums",): 2.0,
    ("web", "en"): 5.0, ("books", "en"): 4.0, ("forums", "en"): 6.0,
    ("web", "de"): 2.0, ("books", "fr"): 2.0,
}


def domain():
    """Domain of a source: the first eight are web, the next six books, the others forums."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1), F.lit(""))
    return (F.when(number == "", None).when(number.cast("int") < 8, "web")
            .when(number.cast("int") < 14, "books").otherwise("forums"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for a mixture of as many tokens as there are."""
    return mixed(table(spark, sf_dir, "documents"), domain(), weights=WEIGHTS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under a trigram model of four folds of five."""
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(docs.filter(fold_of("doc_id", 5) != 1), order=3)
    found = language_model.scored(docs, model)
    return found.withColumn("held_out", fold_of("doc_id", 5) == 1).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy that stays of each text, for every document."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector, a row per component."""
    found = whitened(table(spark, sf_dir, "embeddings"), components=32)
    return found.select(
        "vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one"),
    ).select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
             "one.whitened", "one.explained", "identity_error")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, in shards of numbers at most one apart."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharded(docs, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that are nearly as close to each fiftieth vector as its own label's."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_vector_search": op4_vector_search,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_language_model": op9_language_model,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_sharding": op12_sharding,
    "op13_hard_negatives": op13_hard_negatives,
}


def _shares(level: str, of: str, above: str, weight: str) -> str:
    """Budgets of siblings: the least of a node's room and its weight times the common level."""
    family = f"partition by {above} " if above else ""
    keys = f"{above}, {level}" if above else level
    given = f"any_value({of}.budget)" if above else "any_value(budget)"
    source = f"leaves join {of} using ({above})" if above else f"leaves, {of}"
    return f"""
        {level}_nodes as (
          select {keys}, sum(room) as room, {given} as given, {weight} as w
          from {source} group by {keys}),
        {level}_levels as (
          select *, (given - coalesce(sum(room) over (
                       {family}order by room / w, {level}
                       rows between unbounded preceding and 1 preceding), 0))
                    / sum(w) over ({family}order by room / w, {level}
                       rows between current row and unbounded following) as x
          from {level}_nodes),
        {level}_shares as (
          select {keys}, greatest(0, least(room, w * max(x) over ({family[:-1]}))) as budget
          from {level}_levels)"""


_MIX = ",".join([
    _shares("domain", "whole", "", "case domain when 'web' then 5.0 when 'books' then 3.0 "
            "when 'forums' then 2.0 else 1.0 end"),
    _shares("language", "domain_shares", "domain",
            "case domain || ' ' || language when 'web en' then 5.0 when 'books en' then 4.0 "
            "when 'forums en' then 6.0 when 'web de' then 2.0 when 'books fr' then 2.0 "
            "else 1.0 end"),
    _shares("branch", "language_shares", "domain, language", "1.0"),
])

SQL = {
    "op7_mixing": f"""
        with d as (
          select doc_id, len(list_filter(string_split_regex(coalesce(text, ''),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '')) as tokens,
                 case when num = '' then 'none' when num::int < 8 then 'web'
                      when num::int < 14 then 'books' else 'forums' end as domain,
                 coalesce(lang, 'none') as language, coalesce(source, 'none') as branch
          from (select *, coalesce(regexp_extract(source, '([0-9]+)$', 1), '') as num
                from documents)),
        leaves as (
          select domain, language, branch, sum(tokens) as tokens, sum(tokens) * 2.0 as room
          from d group by all),
        whole as (select sum(tokens)::double as budget from leaves),
        {_MIX},
        plan as (
          select *, least(budget // greatest(tokens, 1), 2) as times
          from (select domain, language, branch, tokens,
                       floor(branch_shares.budget + 1e-6)::bigint as budget
                from leaves join branch_shares using (domain, language, branch))),
        rests as (
          select domain, language, branch, case when tokens > 0 then times else 1 end as times,
                 case when tokens > 0 and times >= 2 then 0
                      when tokens > 0 then budget - times * tokens else budget end as rest
          from plan),
        reached as (
          select d.*, times, rest, sum(d.tokens) over (
                   partition by domain, language, branch
                   order by md5('17:' || times || ':' || doc_id)
                   rows between unbounded preceding and current row) as so_far
          from d join rests using (domain, language, branch))
        select doc_id, domain, language, branch, tokens,
               times + (rest > 0 and so_far <= rest)::int as copies
        from reached""",
    "op2_ngram_jaccard": """
        with recursive w as materialized (
          select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
          from documents),
        s as materialized (
          select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle
          from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w
                where len(words) > 0)),
        n as materialized (select doc_id, count(*) as n from s group by doc_id),
        pairs as materialized (
          select a.doc_id as a, b.doc_id as b, count(*) as shared
          from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
        links as materialized (
          select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b
          where 100 * shared >= 75 * (x.n + y.n - shared)),
        reach as (
          select doc_id, doc_id as other from w
          union select reach.doc_id, links.b from reach join links on links.a = reach.other)
        select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id
        from w join reach on reach.doc_id = w.doc_id left join n on n.doc_id = w.doc_id
        group by w.doc_id""",
    "op10_exact_dedup": """
        with n as (
          select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') as t
          from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from n window w as (partition by t)""",
    "op13_hard_negatives": """
        with v as (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                 list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
          from embeddings
          where label is not null and embedding is not null
            and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        p as materialized (
          select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
                 list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::bigint as s
          from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        positives as (
          select anchor_id, other_id as positive_id, s as positive_score
          from p where same
          qualify row_number() over (partition by anchor_id order by s desc, other_id) <= 5)
        select anchor_id, positive_id,
               row_number() over (partition by anchor_id, positive_id
                                  order by s desc, other_id)::int as rank,
               other_id as negative_id, positive_score, s as negative_score
        from positives join p using (anchor_id)
        where not same and 50 * positive_score <= 100 * s and 100 * s <= 95 * positive_score
        qualify rank <= 3""",
}
