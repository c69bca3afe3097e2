"""BM25 retrieval. Postings are reduced to (term, doc) counts map-side; only the query's terms are joined and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut


def postings(docs: DataFrame, id_: str, tokens: Column) -> DataFrame:
    """(id, term, tf) of every document."""
    return docs.select(F.col(id_).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def shared_terms(docs: DataFrame, id_: str, tokens: Column, queries: DataFrame, carry: list[str]) -> DataFrame:
    """(query_id, id, *carry, hits): different terms that a document shares with a query (distinct query_id, term).

    Only the queries' terms of a document are shuffled, by document; the pairs of documents and queries are counted where they lie.
    """
    few = _small(queries)
    held = lambda df: F.broadcast(df) if few else df
    words = docs.select(F.col(id_).alias("id"), *carry, F.explode(F.array_distinct(tokens)).alias("term"))
    words = words.join(held(queries.select("term").distinct()), "term", "left_semi").repartition("id").distinct()
    return words.join(held(queries), "term").groupBy("query_id", "id", *carry).agg(F.count("*").alias("hits"))


def bm25(docs: DataFrame, id_: str, tokens: Column, queries: DataFrame, k1: float = 1.5, b: float = 0.75, cap: int | None = 3, top: int = 5) -> DataFrame:
    """(query_id, id, score, rank) of the best `top` documents for each query; queries are (query_id, term, qf).

    A repeated query term counts up to `cap` times. Document frequency and length are those of all documents; a
    document without any of the terms is not returned. Ties go to the smaller id. Texts are tokenised once: what is kept
    of a document is its length and the counts of the query's terms.
    """
    terms = queries.select("term").distinct().withColumn("hit", F.lit(True))
    words = docs.select(F.col(id_).alias("id"), tokens.alias("t")).select("id", F.greatest(F.size("t"), F.lit(0)).alias("len"), F.explode_outer("t").alias("term"))
    kept = words.join(F.broadcast(terms) if _small(terms) else terms, "term", "left").withColumn("term", F.when(F.col("hit"), F.col("term")))
    post = cut(kept.groupBy("id", "len", "term").agg(F.count("*").alias("tf")), "postings")
    stats = post.groupBy("id").agg(F.max("len").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    post = post.where("term is not null")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    hit = post.join(df, "term").join(queries, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    times = F.col("qf") if cap is None else F.least(F.col("qf"), F.lit(cap))
    scored = hit.groupBy("query_id", "id").agg(F.sum(part * times).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def _small(terms: DataFrame, rows: int = 100_000) -> bool:
    """Whether the distinct query terms are few enough to send to every task; counted, never assumed."""
    return terms.limit(rows + 1).count() <= rows
