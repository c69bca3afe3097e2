"""Ranks, metrics, folds, resampling and evidence scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import compare, picking, ranking, sampling, scoring
from lodestar.plans.registry import query
from lodestar.session import table

M = """WITH m AS (SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS BIGINT) AS label, CAST(d.n_chars // 500 AS DOUBLE) AS score,
  CAST(d.n_chars AS DOUBLE) AS n_chars, (d.n_chars % 97) / 97.0 AS prob, d.doc_id // 20 AS block FROM documents d JOIN labels l USING (doc_id))"""


def draw_sql(id_: str, salt: str = "12345") -> str:
    return f"((({id_}) % 2147483648) * 1103515245 + CAST({salt} AS BIGINT) * 12820163) % 2147483648"


def marked(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    n = F.col("n_chars")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").cast("long").alias("label"), F.floor(n / 500).cast("double").alias("score"),
        n.cast("double").alias("n_chars"), (n % 97 / F.lit(97.0)).alias("prob"), F.floor(F.col("doc_id") / 20).alias("block"),
    )


@query(f"{M} SELECT doc_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM m")
def f1_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.average_rank(marked(spark, d), "score", "rank").select("doc_id", "rank")


@query(f"{M} SELECT doc_id, (rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0) / count(*) OVER (PARTITION BY lang) AS rank FROM m")
def f2_normalised_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.average_rank(marked(spark, d), "score", "rank", ["lang"])
    sizes = ranked.groupBy("lang").agg(F.count("*").alias("n"))
    return ranked.join(sizes, "lang").select("doc_id", (F.col("rank") / F.col("n")).alias("rank"))


@query(f"""{M}, e AS (SELECT quantile_cont(n_chars, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edges FROM m)
SELECT doc_id, CAST(least(greatest(len(list_filter(edges, lambda x: x <= n_chars)) - 1, 0), 9) AS INTEGER) AS bin FROM m, e""")
def f3_quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    m = marked(spark, d)
    return m.crossJoin(F.broadcast(ranking.quantile_edges(m, "n_chars", 10))).select("doc_id", ranking.bin_of(F.col("n_chars"), F.col("edges")).alias("bin"))


@query(f"{M} SELECT CAST(least(9, floor(prob * 10)) AS INTEGER) AS bin, count(*) AS n, round(avg(prob), 9) AS mean_prob, round(avg(label), 9) AS share FROM m GROUP BY 1")
def f5_equal_width_bins(spark: SparkSession, d: str) -> DataFrame:
    return ranking.calibration(marked(spark, d), "prob", "label").withColumns({c: F.round(c, 9) for c in ("mean_prob", "share")})


@query(f"{M} SELECT doc_id, score, label FROM m ORDER BY score DESC, doc_id LIMIT 25")
def f6_top_k(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).orderBy(F.desc("score"), "doc_id").limit(25).select("doc_id", "score", "label")


@query(f"""{M}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM m)
SELECT count(*) AS taken, CAST(sum(label) AS BIGINT) AS hits, sum(label) / (SELECT CAST(sum(label) AS DOUBLE) FROM m) AS captured FROM k WHERE k <= round(n * 0.1)""")
def f7_capture(spark: SparkSession, d: str) -> DataFrame:
    return ranking.capture(marked(spark, d), "score", "label", "doc_id", 0.1)


@query(f"{M} SELECT lang, doc_id, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k FROM m) WHERE k <= 5")
def f8_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    return marked(spark, d).withColumn("k", k).where("k <= 5").select("lang", "doc_id", "k")


_AP = """t AS (SELECT lang, score, count(*) AS n, sum(label) AS pos FROM m GROUP BY lang, score),
r AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits FROM t WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""


@query(f"""{M}, {_AP}, k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk, label FROM m),
u AS (SELECT lang, sum(rk) FILTER (WHERE label = 1) AS rs, sum(label) AS p, count(*) - sum(label) AS q FROM k GROUP BY lang)
SELECT r.lang, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(CASE WHEN any_value(q) > 0 AND any_value(p) > 0 THEN sum(pos * hits / CAST(seen AS DOUBLE)) / sum(pos) END, 9) AS average_precision,
round(any_value(CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2.0) / (p * q) END), 9) AS roc_auc FROM r JOIN u USING (lang) GROUP BY r.lang""")
def i7_ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.ranking_metrics(marked(spark, d), "score", "label", ["lang"])
    return out.withColumns({c: F.round(c, 9) for c in ("average_precision", "roc_auc")})


@query(f"""{M}, b AS (SELECT least(9, floor(prob * 10)) AS bin, count(*) AS n, avg(prob) AS p, avg(label) AS s FROM m GROUP BY 1)
SELECT round((SELECT sum(n * abs(p - s)) / sum(n) FROM b), 9) AS ece, round((SELECT avg(power(prob - label, 2)) FROM m), 9) AS brier""")
def i10_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.calibration_error(marked(spark, d), "prob", "label")
    return out.select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"))


@query(f"""{M}, v AS (SELECT *, CASE WHEN prob BETWEEN 0.45 AND 0.55 THEN NULL ELSE prob >= 0.5 END AS said FROM m)
SELECT source, count(*) AS n, count(*) FILTER (WHERE said AND label = 1) AS tp, count(*) FILTER (WHERE said AND label = 0) AS fp, count(*) FILTER (WHERE NOT said AND label = 1) AS fn,
count(*) FILTER (WHERE NOT said AND label = 0) AS tn, count(*) FILTER (WHERE said IS NULL) AS abstained, round(count(said) / CAST(count(*) AS DOUBLE), 9) AS coverage FROM v GROUP BY source""")
def i11_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts with abstention: an abstained row is never positive."""
    said, pos = F.col("said"), F.col("label") == 1
    v = marked(spark, d).withColumn("said", F.when(~F.col("prob").between(0.45, 0.55), F.col("prob") >= 0.5))
    return v.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(said & pos).alias("tp"), F.count_if(said & ~pos).alias("fp"), F.count_if(~said & pos).alias("fn"),
        F.count_if(~said & ~pos).alias("tn"), F.count_if(said.isNull()).alias("abstained"), F.round(F.count("said") / F.count("*"), 9).alias("coverage"),
    )


@query(f"""{M}, s AS (SELECT doc_id, label, unnest([0, 1, 2]) AS run, score, prob, n_chars FROM m),
a AS (SELECT doc_id, label, CASE run WHEN 0 THEN prob WHEN 1 THEN CASE WHEN score < 8 THEN score / 8 END ELSE CASE WHEN n_chars < 1500 THEN 0.4 END END AS p FROM s)
SELECT doc_id, CASE WHEN 2 * count(p) < count(*) THEN NULL ELSE round(avg(p), 9) END AS probability, count(*) - count(p) AS abstained FROM a GROUP BY doc_id""")
def i15_vote(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the answers of several runs; abstains where over half of them do."""
    m = marked(spark, d)
    runs = F.array(F.col("prob"), F.when(F.col("score") < 8, F.col("score") / 8), F.when(F.col("n_chars") < 1500, F.lit(0.4)))
    a = m.select("doc_id", F.explode(runs).alias("p"))
    return a.groupBy("doc_id").agg(F.when(2 * F.count("p") >= F.count("*"), F.round(F.avg("p"), 9)).alias("probability"), (F.count("*") - F.count("p")).alias("abstained"))


@query(f"""{M}, c AS (SELECT lang, count(*) FILTER (WHERE (prob >= 0.5) = (label = 1) AND (score >= 3) <> (label = 1)) AS b, count(*) FILTER (WHERE (prob >= 0.5) <> (label = 1) AND (score >= 3) = (label = 1)) AS c FROM m GROUP BY lang),
k AS (SELECT lang, b, c, unnest(generate_series(0, least(b, c))) AS k FROM c)
SELECT lang, b AS only_first, c AS only_second, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))), 9) AS p_value FROM k GROUP BY lang, b, c""")
def i18_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Exact two-sided McNemar test of two rules: a binomial tail over the rows on which one of them is right."""
    right = lambda c: c == (F.col("label") == 1)
    one, two = right(F.col("prob") >= 0.5), right(F.col("score") >= 3)
    c = marked(spark, d).groupBy("lang").agg(F.count_if(one & ~two).alias("only_first"), F.count_if(~one & two).alias("only_second"))
    tail = compare.binomial_tail(c.withColumns({"n": F.col("only_first") + F.col("only_second"), "k": F.least("only_first", "only_second")}), "n", "k")
    return tail.select("lang", "only_first", "only_second", F.round(F.least(F.lit(1.0), 2 * F.col("tail")), 9).alias("p_value"))


@query(f"""{M}, p AS (SELECT source, avg(prob) AS p FROM m GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY p, source) AS k, count(*) OVER () AS n FROM p)
SELECT source, round(p, 9) AS p, round(least(1.0, max((n - k + 1) * p) OVER (ORDER BY k)), 9) AS adjusted FROM r""")
def i19_holm(spark: SparkSession, d: str) -> DataFrame:
    """Holm's step-down adjustment: running maximum of (m - rank + 1) p."""
    p = marked(spark, d).groupBy("source").agg(F.avg("prob").alias("p"))
    w = Window.orderBy("p", "source")  # one row for each test
    r = p.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy())})
    adjusted = F.max((F.col("n") - F.col("k") + 1) * F.col("p")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return r.select("source", F.round("p", 9).alias("p"), F.round(F.least(F.lit(1.0), adjusted), 9).alias("adjusted"))


@query(f"""{M}, a AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS ra, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rb FROM m)
SELECT round(corr(ra, rb), 9) AS spearman FROM a""")
def f20_spearman(spark: SparkSession, d: str) -> DataFrame:
    return ranking.spearman(marked(spark, d), "n_chars", "prob").select(F.round("spearman", 9).alias("spearman"))


@query(f"{M} SELECT doc_id, block, CAST(({draw_sql('block')} // 65536) % 5 AS INTEGER) AS fold FROM m")
def h2_block_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(marked(spark, d), "block", 5).select("doc_id", "block", "fold")


@query(f"{M} SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY block, label ORDER BY {draw_sql('doc_id')}, doc_id) AS k FROM m) WHERE label = 0 OR k = 1")
def h6_thin_positives(spark: SparkSession, d: str) -> DataFrame:
    return sampling.thin(marked(spark, d), "block", "label", "doc_id").select("doc_id", "label")


@query(f"""{M}, w AS (SELECT source, 3 * count(*) AS want FROM m WHERE label = 0 GROUP BY source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {draw_sql('doc_id')}, doc_id) AS k FROM m WHERE label = 1)
SELECT doc_id, label FROM m WHERE label = 0 UNION ALL SELECT doc_id, label FROM k JOIN w USING (source) WHERE k <= want""")
def h7_matched_background(spark: SparkSession, d: str) -> DataFrame:
    """The rarer class plays the positives; three of the other for each, within the source."""
    flipped = marked(spark, d).withColumn("label", 1 - F.col("label"))
    out = sampling.match_background(flipped, "source", "label", "doc_id", 3)
    return out.select("doc_id", (1 - F.col("label")).alias("label"))


@query(f"""{M} SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('doc_id')}, doc_id) AS k FROM m)
WHERE k <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 8 WHEN 'fr' THEN 8 ELSE 0 END""")
def h14_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(marked(spark, d), "lang", "doc_id", {"en": 20, "de": 8, "fr": 8}).select("lang", "doc_id")


@query(f"{M} SELECT doc_id, k <= round(0.2 * n) AS held FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM m)")
def h15_held_out_share(spark: SparkSession, d: str) -> DataFrame:
    m = marked(spark, d)
    k = F.row_number().over(Window.partitionBy("lang").orderBy(sampling.draw(F.col("doc_id")), "doc_id"))
    return m.select("doc_id", (k <= F.round(0.2 * F.count("*").over(Window.partitionBy("lang")))).alias("held"))


@query(f"{M} SELECT doc_id, printf('b-%04d', row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('doc_id')}, doc_id)) AS bench_id, lang FROM m")
def h16_opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("lang").orderBy(sampling.draw(F.col("doc_id")), "doc_id"))
    return marked(spark, d).select("doc_id", F.format_string("b-%04d", k).alias("bench_id"), "lang")


@query(f"""{M}, o AS (SELECT doc_id, lang, row_number() OVER w AS k, lead(doc_id) OVER w AS nxt, first_value(doc_id) OVER w AS fst FROM m WINDOW w AS (PARTITION BY lang ORDER BY {draw_sql('doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, coalesce(nxt, fst) AS swapped FROM o""")
def h17_derangement(spark: SparkSession, d: str) -> DataFrame:
    """A cyclic shift of the drawn order: no row keeps its own (unless it is alone)."""
    w = Window.partitionBy("lang").orderBy(sampling.draw(F.col("doc_id")), "doc_id")
    first = F.first("doc_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return marked(spark, d).select("doc_id", F.coalesce(F.lead("doc_id").over(w), first).alias("swapped"))


def portable_sql(id_: str, seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({id_} AS VARCHAR) || '-' || CAST(rep AS VARCHAR) || '-{seed}'), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0"


def poisson_sql(id_: str, seed: int) -> str:
    return f"len(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in sampling.poisson_steps())}], lambda c: c <= {portable_sql(id_, seed)}))"


def precision_sql(rows: str, by: str, out: str) -> str:
    """CTEs that give `out` (by, ap) from `rows` (by, s, label, w)."""
    return f"""{out}_n AS (SELECT {by}, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS q, CAST(sum(w) FILTER (WHERE label = 1) AS DOUBLE) AS wp, CAST(sum(w) FILTER (WHERE label <> 1) AS DOUBLE) AS wq FROM {rows} GROUP BY {by}),
{out}_a AS (SELECT {by}, s, CAST(coalesce(sum(w) FILTER (WHERE label = 1), 0) AS DOUBLE) AS a, CAST(coalesce(sum(w) FILTER (WHERE label <> 1), 0) AS DOUBLE) AS b FROM {rows} GROUP BY {by}, s),
{out}_t AS (SELECT *, sum(a) OVER (PARTITION BY {by} ORDER BY s DESC) AS ta, sum(b) OVER (PARTITION BY {by} ORDER BY s DESC) AS tb FROM {out}_a),
{out} AS (SELECT {by}, sum(CASE WHEN a > 0 THEN a / wp * (ta * p / wp) / (ta * p / wp + tb * q / wq) ELSE 0 END) AS ap FROM {out}_t JOIN {out}_n USING ({by}) WHERE wp > 0 AND wq > 0 GROUP BY {by})"""


def _interval(reps: DataFrame, value: str) -> DataFrame:
    q = F.percentile(value, [0.025, 0.975]).alias("q")
    return reps.agg(F.avg(value).alias("mean"), q).select(F.round("mean", 9).alias("mean"), F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"))


INTERVAL = "SELECT round(avg({0}), 9) AS mean, round(quantile_cont({0}, 0.025), 9) AS low, round(quantile_cont({0}, 0.975), 9) AS high"


@query(f"{M}, r AS (SELECT rep, prob AS s, label, {poisson_sql('doc_id', 7)} AS w FROM m, generate_series(0, 199) g(rep)), {precision_sql('r', 'rep', 'e')} {INTERVAL.format('ap')} FROM e")
def h9_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """95 % interval of the average precision, positives and negatives resampled apart."""
    return _interval(sampling.bootstrap_precision(marked(spark, d), "doc_id", "prob", "label", draw_of=sampling.portable), "average_precision")


@query(f"""{M}, w AS (SELECT rep, prob, score, label, {poisson_sql('doc_id', 7)} AS w FROM m, generate_series(0, 199) g(rep)), r0 AS (SELECT rep, prob AS s, label, w FROM w), r1 AS (SELECT rep, score AS s, label, w FROM w),
{precision_sql('r0', 'rep', 'e0')}, {precision_sql('r1', 'rep', 'e1')}, x AS (SELECT e0.ap - e1.ap AS difference FROM e0 JOIN e1 USING (rep))
{INTERVAL.format('difference')}, round(avg(CASE WHEN difference <= 0 THEN 1.0 ELSE 0.0 END), 9) AS share_below FROM x""")
def h10_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two scores under the same draws, and the share of draws without gain."""
    reps = sampling.paired_bootstrap(marked(spark, d), "doc_id", ("prob", "score"), "label", draw_of=sampling.portable)
    below = reps.agg(F.round(F.avg((F.col("difference") <= 0).cast("double")), 9).alias("share_below"))
    return _interval(reps, "difference").crossJoin(below)


@query(f"""{M}, u AS (SELECT source, rep, {poisson_sql('source', 5)} AS wr FROM (SELECT DISTINCT source FROM m), generate_series(0, 199) g(rep)), r AS (SELECT source, rep, prob, {poisson_sql('doc_id', 6)} AS w FROM m, generate_series(0, 199) g(rep)),
x AS (SELECT rep, sum(w * wr * prob) / nullif(CAST(sum(w * wr) AS DOUBLE), 0) AS mean FROM r JOIN u USING (source, rep) GROUP BY rep) {INTERVAL.format('mean')} FROM x""")
def h11_two_level_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Sources play the runs: they are resampled first, then their documents."""
    return _interval(sampling.two_level_bootstrap(marked(spark, d), "source", "doc_id", "prob", draw_of=sampling.portable), "mean")


@query(f"""{M}, k AS (SELECT doc_id, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rb FROM m),
v AS (SELECT rep, label, ra, rb, {portable_sql('doc_id', 3)} < 0.5 AS sw FROM k, generate_series(0, 9999) g(rep) UNION ALL SELECT -1, label, ra, rb, false FROM k),
r0 AS (SELECT rep, label, CASE WHEN sw THEN rb ELSE ra END AS s, 1 AS w FROM v), r1 AS (SELECT rep, label, CASE WHEN sw THEN ra ELSE rb END AS s, 1 AS w FROM v), {precision_sql('r0', 'rep', 'e0')}, {precision_sql('r1', 'rep', 'e1')},
x AS (SELECT rep, e0.ap - e1.ap AS d FROM e0 JOIN e1 USING (rep)), o AS (SELECT d AS observed FROM x WHERE rep = -1)
SELECT round(max(observed), 9) AS observed, (count(*) FILTER (WHERE d >= observed - 1e-12) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value FROM x, o WHERE rep >= 0""")
def h12_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    """Does one score rank better than another? 10,000 swaps of the two normalised ranks."""
    out = sampling.rank_permutation(marked(spark, d), "doc_id", "score", "prob", "label", draw_of=sampling.portable)
    return out.select(F.round("observed", 9).alias("observed"), "p_value")


CRITERIA = [
    scoring.Criterion("price", "p_retailprice", "falling", 2.0, (900.0, 1000.0)),
    scoring.Criterion("size", "size_known", "band", 1.0, (5.0, 15.0, 30.0, 45.0)),
    scoring.Criterion("supply", "suppliers", "percentile_rising", 3.0, (0.2, 0.8)),
    scoring.Criterion("returned", "returns", "binary", 1.0),
]
P = """WITH f AS (SELECT p.p_partkey, p_retailprice, CAST(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS DOUBLE) AS size_known, CAST(a.suppliers AS DOUBLE) AS suppliers, CAST(a.returns AS DOUBLE) AS returns
  FROM part p LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_returnflag = 'R') AS returns FROM lineitem GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey),
q AS (SELECT quantile_cont(suppliers, 0.2) AS lo, quantile_cont(suppliers, 0.8) AS hi FROM f),
m AS (SELECT p_partkey, least(1.0, greatest(0.0, (1000 - p_retailprice) / 100)) AS m_price,
  CASE WHEN size_known IS NOT NULL THEN least(least(1.0, greatest(0.0, (size_known - 5) / 10.0)), least(1.0, greatest(0.0, (45 - size_known) / 15.0))) END AS m_size,
  CASE WHEN suppliers IS NOT NULL AND hi <> lo THEN least(1.0, greatest(0.0, (suppliers - lo) / (hi - lo))) END AS m_supply,
  CASE WHEN returns IS NOT NULL THEN CASE WHEN returns > 0 THEN 1.0 ELSE 0.0 END END AS m_returned FROM f, q),
k AS (SELECT *, (2.0 + CASE WHEN m_size IS NULL THEN 0 ELSE 1 END + CASE WHEN m_supply IS NULL THEN 0 ELSE 3 END + CASE WHEN m_returned IS NULL THEN 0 ELSE 1 END) AS known,
  2 * m_price + coalesce(m_size, 0) + 3 * coalesce(m_supply, 0) + coalesce(m_returned, 0) AS met FROM m)"""


def part_features(spark: SparkSession, d: str) -> DataFrame:
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    per = line.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").cast("double").alias("suppliers"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returns"))
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double"))
    return part.select("p_partkey", "p_retailprice", size.alias("size_known")).join(per, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


@query(f"{P} SELECT p_partkey, round(known / 7, 9) AS known_share, CASE WHEN known / 7 >= 0.5 THEN round(met / known, 9) END AS score FROM k")
def e12_criteria_score(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.score(scoring.memberships(part_features(spark, d), CRITERIA), CRITERIA, 0.5)
    return out.select("p_partkey", F.round("known_share", 9).alias("known_share"), F.round("score", 9).alias("score"))


@query(f"{P} SELECT p_partkey, round(m_price, 9) AS m_price, round(m_size, 9) AS m_size, round(m_supply, 9) AS m_supply, m_returned FROM m")
def i33_memberships(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.memberships(part_features(spark, d), CRITERIA)
    return out.select("p_partkey", *(F.round(c, 9).alias(c) for c in ("m_price", "m_size", "m_supply")), "m_returned")


_LONG = "l AS (SELECT p_partkey, known, met, unnest(['price', 'size', 'supply', 'returned']) AS criterion, unnest([2.0, 1.0, 3.0, 1.0]) AS weight, unnest([m_price, m_size, m_supply, m_returned]) AS membership FROM k)"


@query(f"{P}, {_LONG} SELECT p_partkey, criterion, CAST(weight AS DOUBLE) AS weight, round(membership, 9) AS membership, round(weight * membership, 9) AS contribution FROM l")
def e13_contributions(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.contributions(scoring.memberships(part_features(spark, d), CRITERIA), "p_partkey", CRITERIA)
    return out.select("p_partkey", "criterion", "weight", F.round("membership", 9).alias("membership"), F.round("contribution", 9).alias("contribution"))


@query(f"""{P}, {_LONG}, o AS (SELECT *, known - CASE WHEN membership IS NULL THEN 0 ELSE weight END AS ow, met - coalesce(weight * membership, 0) AS os FROM l)
SELECT p_partkey, criterion, round((os + weight) / (ow + weight), 9) AS score_if_met, round(os / (ow + weight), 9) AS score_if_not, round(weight / (ow + weight), 9) AS span FROM o""")
def e14_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    long = scoring.contributions(scoring.memberships(part_features(spark, d), CRITERIA), "p_partkey", CRITERIA)
    out = scoring.sensitivity(long, "p_partkey")
    return out.select("p_partkey", "criterion", *(F.round(c, 9).alias(c) for c in ("score_if_met", "score_if_not", "span")))


@query()
def h20_constrained_pick(spark: SparkSession, d: str) -> DataFrame:
    """Four documents of each language, two of a publisher at most, three of the zone at least; the sequential pick is beyond SQL, tests hold it."""
    docs = table(spark, d, "documents")
    company = F.concat_ws("-", "source", (F.col("doc_id") % 23).cast("string"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("era"), company.alias("company"), (F.col("doc_id") % 41 == 0).alias("zone"), (F.col("n_chars") % 1000).cast("double").alias("score"))
    return picking.greedy_pick(rows, ["de", "en", "es", "fr"], 4, 2, 3)


@query("""WITH r AS (SELECT doc_id AS id, coalesce(lang, 'none') || '-' || (doc_id % 5) AS era, row_number() OVER (PARTITION BY coalesce(lang, 'none') || '-' || (doc_id % 5) ORDER BY n_chars DESC, doc_id) AS rank, doc_id % 6 = 0 AS passes FROM documents),
g AS (SELECT *, count(*) FILTER (WHERE passes) OVER (PARTITION BY era ORDER BY rank) AS good FROM r), l AS (SELECT era, min(rank) AS last FROM g WHERE rank >= 5 AND (rank - 5) % 3 = 0 AND (good >= 3 OR rank >= 20) GROUP BY era)
SELECT id, g.era, CAST(rank AS INTEGER) AS rank, passes, rank > 5 AS extended FROM g LEFT JOIN l USING (era) WHERE rank <= coalesce(last, rank)""")
def s35_reserve_extension(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    era = F.concat(F.coalesce("lang", F.lit("none")), F.lit("-"), (F.col("doc_id") % 5).cast("string"))
    rows = docs.select(F.col("doc_id").alias("id"), era.alias("era"), F.col("n_chars").alias("score"), (F.col("doc_id") % 6 == 0).alias("passes"))
    return picking.extended(rows, 5, 3, 3, 20)
