"""A small pick from a large ranking under several counters, and a reserve that is gone down until enough of it passes.

The pick is greedy: rows in order of rank, each taken if its era and its company have room. It is sequential, but only few rows can matter, and
these are found in parallel: of one company in one era only the first rows up to the company's cap (if these are not taken the era is full, and stays so), and
of an era then only the first rows up to all picks there can be and the era's own (so many rows belong to more companies than can be full). The number that
remains depends on the caps alone, so it may be gone through in one place.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut


def _first(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first `n` rows of each group; Spark keeps no more than these of a group in any task before the shuffle."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def greedy_pick(rows: DataFrame, eras: list[str], per_era: int, cap: int, least_zone: int = 0) -> DataFrame:
    """(id, era, company, zone, place, how) of the rows picked; `how` is ranked or swapped in, place counts within the era by rank.

    Rows are (id, era, company, zone, score): ranked by score, highest first, then id; a null score is last, a null company is one of its own, a null
    zone is outside, other eras are left out. If fewer than `least_zone` picks are in the zone, the best row of the zone that is not picked takes the place
    of the last pick of its era that is not, where its company has room then; each such swap is one search over all rows.
    """
    spark = rows.sparkSession
    ranked = rows.where(F.col("era").isin(eras) & F.col("id").isNotNull()).select(
        "id", "era", F.coalesce("company", F.lit("")).alias("company"), F.coalesce("zone", F.lit(False)).alias("zone"), F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score")
    )
    ranked = cut(ranked, "pick-rows")
    order = [F.desc("score"), F.asc("id")]
    few = _first(_first(ranked, ["era", "company"], order, cap), ["era"], order, per_era * (len(eras) + 1)).orderBy(*order).collect()
    place = lambda r: (-r.score, r.id)
    chosen, in_era, of_company, how = [], Counter(), Counter(), {}
    for r in few:
        if in_era[r.era] < per_era and of_company[r.company] < cap:
            chosen.append(r)
            in_era[r.era] += 1
            of_company[r.company] += 1
            how[r.id] = "ranked"
    after = None
    while sum(c.zone for c in chosen) < least_zone:
        # Whom a row of an era and company would replace: the last pick outside the zone, or the last one of its own company if that one is full.
        # The companies that matter are those of picks; any other has room.
        outside = {e: sorted((c for c in chosen if c.era == e and not c.zone), key=place, reverse=True) for e in eras}
        full = [k for k, n in of_company.items() if n >= cap]
        open_ = [(e, k) for e, victims in outside.items() for k in full if any(v.company == k for v in victims)]
        free = F.col("era").isin([e for e in eras if outside[e]] or [""]) & ~F.col("company").isin(full or ["\0"])
        swap_own = F.lit(False)
        for e, k in open_:
            swap_own = swap_own | ((F.col("era") == e) & (F.col("company") == k))
        next_ = ranked.where("zone").where(~F.col("id").isin([c.id for c in chosen] or [None]) & (free | swap_own))
        if after is not None:
            next_ = next_.where((F.col("score") < after.score) | ((F.col("score") == after.score) & (F.col("id") > after.id)))
        r = next_.agg(F.min_by(F.struct("id", "era", "company", "zone", "score"), F.struct(-F.col("score"), "id")).alias("r")).first().r
        if r is None:
            break
        after = r
        victim = next(v for v in outside[r.era] if of_company[r.company] - (v.company == r.company) < cap)
        chosen.remove(victim)
        chosen.append(r)
        of_company[victim.company] -= 1
        of_company[r.company] += 1
        how[r.id] = f"swapped in for {victim.id}"
    out, count = [], Counter()
    for r in sorted(chosen, key=place):
        count[r.era] += 1
        out.append((r.id, r.era, r.company, r.zone, count[r.era], how[r.id]))
    return spark.createDataFrame(out, f"id {rows.schema['id'].dataType.simpleString()}, era string, company string, zone boolean, place int, how string")


def unmet(picked: DataFrame, eras: list[str], per_era: int, cap: int, least_zone: int) -> DataFrame:
    """(constraint, subject, n): which constraints a pick leaves unmet; no rows if all are met. A pick is as small as its caps."""
    spark = picked.sparkSession
    every = spark.createDataFrame([(e,) for e in eras], "era string").join(picked.groupBy("era").agg(F.count("*").alias("n")), "era", "left").select(F.lit("per_era").alias("constraint"), F.col("era").alias("subject"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    company = picked.groupBy("company").agg(F.count("*").alias("n")).where(F.col("n") > cap).select(F.lit("max_per_company").alias("constraint"), F.col("company").alias("subject"), "n")
    zone = picked.agg(F.count_if("zone").alias("n")).where(F.col("n") < least_zone).select(F.lit("min_zone").alias("constraint"), F.lit("").alias("subject"), "n")
    return every.where(F.col("n") != per_era).unionByName(company).unionByName(zone)


def extended(rows: DataFrame, first: int, step: int, least: int, most: int) -> DataFrame:
    """(id, era, rank, passes, extended): of each era's ranking the first rows, and `step` more at a time until `least` pass, `most` are tried, or none is left.

    Rows are (id, era, score, passes), ranked by score, then id; a null `passes` is a failure. No more than `most` and a step of an era is looked at.
    """
    order = [F.desc_nulls_last("score"), F.asc("id")]
    w = Window.partitionBy("era").orderBy(*order)
    held = _first(rows.where("era IS NOT NULL"), ["era"], order, max(first, most + step))
    held = held.select("id", "era", F.row_number().over(w).alias("rank"), F.coalesce("passes", F.lit(False)).alias("passes"), F.count_if("passes").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__good"))
    # Where the search may stop: after the first rows, and after every step.
    stop = (F.col("rank") >= first) & ((F.col("rank") - first) % step == 0) & ((F.col("__good") >= least) | (F.col("rank") >= most))
    last = held.groupBy("era").agg(F.min(F.when(stop, F.col("rank"))).alias("__last"))
    return held.join(F.broadcast(last), "era").where(F.col("rank") <= F.coalesce("__last", F.col("rank"))).select("id", "era", "rank", "passes", (F.col("rank") > first).alias("extended"))
