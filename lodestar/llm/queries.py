"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import (
    bwt_dedup,
    conversation_repair,
    media_shards,
    nbsvm,
    packing,
    periodic_runs,
    pivot_index,
    prefix_counts,
    rank_lang,
    simhash,
    temperature_mix,
    token_table,
    warc_chunks,
)
from lodestar.llm.common import split_of
from lodestar.session import table


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, on each machine the same; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_shards.media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bits", "shard", "offset",
    )


def op3_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bwt_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture at 95 % of the greatest entropy takes of all documents, in every epoch."""
    taken = temperature_mix.select_rows(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "source", "epoch", "block", "n_tokens", "token_start", "copies", "weight")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, powers=True)


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = warc_chunks.plan(table(spark, sf_dir, "pages"))
    chunks = warc_chunks.read_chunks(warc_chunks.write_archives(planned))
    return warc_chunks.resolve(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_table.read_shards(token_table.write_shards(docs, tokenizer_file("word_bpe_49k.json"), end_id=2))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_rank_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_lang.identify(table(spark, sf_dir, "documents"))


def op10_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    scored = nbsvm.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (split_of(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of all texts are written first; the counts and how a text stands to the limit are read from them."""
    counts = prefix_counts.store(prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))
    return prefix_counts.within_budget(counts, 2048)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, its rows damaged by their ids first; one that lost all rows has an empty repair."""
    conversations = table(spark, sf_dir, "conversations")
    plans = conversation_repair.plans(conversation_repair.faults(conversation_repair.damaged(conversations)))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.alias("e").join(plans.alias("p"), F.col("e.conv_id").eqNullSafe(F.col("p.conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "e.conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )  # fmt: skip


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summaries(table(spark, sf_dir, "documents"), plant=True)


def _repair_sql() -> str:
    """The damage, the faults and the least edits in DuckDB SQL.

    A state is one string: six digits of cost, the audit, a mark, the turns kept so far. So the least of two strings is the cheaper one, of equal costs
    that with the lesser audit. Rows are gone through by recursion, one of each conversation at a time.
    """

    def edit(state: str, cost: str, letter: str, turn: str | None) -> str:
        rep = f"substr({state}, strpos({state}, chr(1)) + 1)"
        kept = rep if turn is None else f"{rep} || CASE WHEN {rep} = '' THEN '' ELSE chr(10) END || {turn}"
        return f"(lpad(CAST(CAST(substr({state}, 1, 6) AS BIGINT) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7, strpos({state}, chr(1)) - 7) || '{letter}' || chr(1) || {kept})"

    def closed(inner: str) -> str:
        user, assistant = (f"'{r}:'" for r in ("user", "assistant"))
        puts = ", ".join(edit(s, "3", "I", user) for s in ("s0", "s1", "s3"))
        return f"(SELECT * REPLACE (least(s2, {puts}) AS s2, least(s3, {edit('s2', '3', 'I', assistant)}) AS s3) FROM {inner})"

    def stays(states: tuple[str, ...], initial: str, name: str) -> list[str]:
        keep = [f"CASE WHEN ok AND substr(role, 1, 1) = '{initial}' THEN {edit(s, 'more', 'K', 'said')} END" for s in states]
        return keep + ([f"CASE WHEN ok THEN {edit(s, '(3 + more)', 'R', repr(name + ':') + ' || text')} END" for s in states] if name else [])

    moved = {"s0": [], "s1": stays(("s0",), "s", ""), "s2": stays(("s0", "s1", "s3"), "u", "user"), "s3": stays(("s2",), "a", "assistant")}
    step = ", ".join(f"least({edit(s, '4', 'D', None)}, {', '.join([*m, 'NULL'])}) AS {s}" for s, m in moved.items())
    crc = (
        "xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS UBIGINT))), lambda c, b:"
        " list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: CAST(k AS UBIGINT))), lambda a, i: xor(a >> 1, CAST(3988292384 AS UBIGINT) * (a & 1)))), CAST(4294967295 AS UBIGINT)) % 20"
    )
    start = closed(closed("(SELECT conv_id, CAST(0 AS BIGINT) AS rn, '000000' || chr(1) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM conversations))"))
    later = closed(closed(f"(SELECT v.conv_id, v.rn + 1 AS rn, {step} FROM v JOIN f ON f.conv_id = v.conv_id AND f.rn = v.rn + 1)"))
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, {crc} AS how FROM k), d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS rn, regexp_replace(text, '[ 	-]+$', '') AS seen FROM d),
m AS (SELECT *, CASE WHEN seen = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS mark,
  substr(lag(role) OVER (PARTITION BY conv_id ORDER BY rn), 1, 1) || substr(role, 1, 1) AS pair FROM o),
f AS (SELECT conv_id, rn, role, text, role || ':' || text AS said, mark NOT IN ('b', 'd') AS ok, CASE WHEN mark = 't' THEN 3 ELSE 0 END AS more FROM m),
v AS (SELECT * FROM {start} UNION ALL SELECT * FROM {later}),
e AS (SELECT conv_id, arg_max(least(s0, s3), rn) AS s FROM v GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE mark = 'b') AS blank, count(*) FILTER (WHERE mark = 'd') AS duplicate,
  count(*) FILTER (WHERE mark = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(substr(s, 1, 6) AS BIGINT) AS cost, substr(s, 7, strpos(s, chr(1)) - 7) AS audit, sha256(substr(s, strpos(s, chr(1)) + 1)) AS repaired_sha256 FROM e LEFT JOIN n USING (conv_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_index": op1_pivot_index,
        "op2_media_shards": op2_media_shards,
        "op3_bwt_dedup": op3_bwt_dedup,
        "op4_temperature_mix": op4_temperature_mix,
        "op5_packing": op5_packing,
        "op6_warc_chunks": op6_warc_chunks,
        "op7_token_table": op7_token_table,
        "op8_simhash": op8_simhash,
        "op9_rank_lang": op9_rank_lang,
        "op10_nbsvm": op10_nbsvm,
        "op11_prefix_counts": op11_prefix_counts,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op12_conversation_repair": _repair_sql(),
        # All pairs by cosine in double precision; the components by label spreading.
        "op1_pivot_index": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT u AS vec_id, u AS other FROM links UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON l.u = r.other
), n AS (SELECT u, count(*) AS n FROM links GROUP BY u), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, t.vec_id) AS component_id,
  coalesce(c.component_id, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN n ON n.u = t.vec_id LEFT JOIN c ON c.vec_id = t.vec_id""",
        # The records that the archives must give back.
        "op6_warc_chunks": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND d.payload_bytes >= 100""",
    }
