"""Rules over drill-hole records: holes, their intervals, grades and printed values. Findings flag and never drop a record.

A rule that looks at one row is a list of tests (`finding`), so that any number of rules takes one pass over the rows (`told`).
Rules that compare rows of a hole are windows or aggregations by hole. A finding is (rule, outcome, scope_id, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerances and factors of the rules.
FEET_A_METRE, FEET_TOLERANCE, FOOT = 1 / 0.3048, 0.12, 0.3048
U_TO_U3O8, NEAR_U, NEAR_U3O8, FAR_U3O8 = 1.17924, 0.03, 0.05, 0.25
EAST, NORTH, LATITUDE, LONGITUDE = (150_000, 850_000), (5_400_000, 6_700_000), (49.0, 60.5), (100.0, 111.0)
PROBE = r"(?i)probe|cps|count|gamma|radiometric|equivalent|\beu"


def finding(rule: str, outcome: str, when: Column, detail: Column | str = "") -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(outcome).alias("outcome"), detail.cast("string").alias("detail")))


def told(df: DataFrame, scope: str, *tests: Column) -> DataFrame:
    """(rule, outcome, scope_id, detail) of every test that holds, in one pass."""
    found = F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull()))
    return df.select(F.col(scope).cast("string").alias("scope_id"), found.alias("t")).select("t.rule", "t.outcome", "scope_id", "t.detail")


def interval_tests() -> list[Column]:
    """Columns from_m, to_m, depth_unit, width (null if not printed)."""
    a, b = F.col("from_m"), F.col("to_m")
    length = b - a
    return [
        finding("V01", "flag", F.col("depth_unit").isNull(), "no depth unit is printed"),
        finding("V05", "fail", a > b, "the start is below the end"),
        finding("V05", "flag", a == b, "zero length"),
        finding("V07", "flag", F.abs(F.col("width") - length) > F.greatest(F.lit(0.05), F.abs(length) * 0.01), "printed width is not to minus from"),
    ]


def grade_tests() -> list[Column]:
    """Columns grade, unit, species, basis, printed (analyte, unit and method as printed), quote."""
    g, unit, species, basis = F.col("grade"), F.col("unit"), F.col("species"), F.col("basis")
    return [
        finding("V02", "flag", unit.isNull(), "no grade unit is printed"),
        finding("V02", "fail", (unit == "%") & (g > 100), "over 100 per cent"),
        finding("V02", "fail", (unit == "ppm") & (g > 1_000_000), "over a million parts per million"),
        finding("V03", "flag", species == "not_printed", "no species is printed"),
        finding("V03", "flag", (species != "not_printed") & F.col("quote").isNull(), "a species without a quote"),
        finding("V04", "fail", (basis == "chemical") & F.col("printed").rlike(PROBE), "a probe reading stored as chemical"),
        finding("V04", "flag", (basis == "probe_equivalent") & species.isin("U", "U3O8"), "a probe reading with a chemical species"),
    ]


def pair_tests() -> list[Column]:
    """Columns ppm_u and pct_u3o8, both printed for one interval: is the percentage that of the element or of the oxide?"""
    as_u = F.col("ppm_u") / 10_000
    oxide, got = as_u * U_TO_U3O8, F.col("pct_u3o8")
    near_u, off = F.abs(got - as_u) / as_u <= NEAR_U, F.abs(got - oxide) / oxide
    known = as_u > 0
    return [
        finding("V02", "fail", known & near_u & (off > NEAR_U3O8), "the element may be stored as the oxide"),
        finding("V02", "flag", known & ~near_u & (off > FAR_U3O8), "the two printed grades disagree"),
    ]


def hole_tests() -> list[Column]:
    """Columns easting, northing, latitude, longitude, datum, datum_located, transformed, dip, azimuth, id_source."""
    e, n, datum = F.col("easting"), F.col("northing"), F.col("datum")
    swapped = n.between(*EAST) & e.between(*NORTH)
    placed = F.coalesce(e, n, F.col("latitude"), F.col("longitude")).isNotNull()
    return [
        finding("V10", "flag", datum.isNotNull() & ~F.col("datum_located"), "the datum's quote is not on the page"),
        finding("V10", "flag", datum.isNull() & placed, "coordinates without a datum"),
        finding("V10", "fail", datum.isNull() & F.col("transformed"), "a datum was applied that is not printed"),
        finding("V12", "fail", swapped, "easting and northing look swapped"),
        finding("V12", "flag", ~swapped & ~(e.between(*EAST) & n.between(*NORTH)), "outside the plausible range"),
        finding("V12", "flag", ~F.col("latitude").between(*LATITUDE), "latitude outside"),
        finding("V12", "flag", ~F.abs("longitude").between(*LONGITUDE), "longitude outside"),
        finding("V18", "flag", ~F.col("dip").between(-90.0 - 1e-6, 90.0 + 1e-6), "dip outside its range"),
        finding("V18", "flag", ~F.col("azimuth").between(0.0, 360.0), "azimuth outside its range"),
        finding("V19", "flag", F.col("id_source").isin("page_header", "carried"), F.concat(F.lit("taken from "), F.col("id_source"))),
    ]


def position_tests() -> list[Column]:
    """Columns placed, inside_sheets, inside_file (any may be null)."""
    sheets = F.col("inside_sheets")
    return [
        finding("V11", "fail", F.col("placed") & ~sheets, "outside the file's sheets"),
        finding("V11", "flag", F.col("placed") & sheets & ~F.col("inside_file"), "over 2 km from the file's holes"),
    ]


def table_tests() -> list[Column]:
    """Columns stored, counted, geometric (null if unknown), truncated: do the three counters of rows agree?"""
    deficits = (F.col("counted") > F.col("stored")).cast("int") + F.coalesce((F.col("geometric") > F.col("stored") + 1).cast("int"), F.lit(0)) + F.col("truncated").cast("int")
    return [finding("V09", "fail", deficits >= 2, "rows are missing"), finding("V09", "flag", deficits == 1, "one counter disagrees")]


def value_tests() -> list[Column]:
    """Columns printed, qualifier, non_numeric, value, read_as (the second reader's text), agreement, located."""
    p, q, v = F.trim("printed"), F.col("qualifier"), F.col("value")
    lost = F.substring(p, 1, 1).isin("<", ">") & q.isNull()
    zero = q.isNotNull() & (v == 0)
    seen = F.col("located").isin("exact", "fuzzy", "row_anchor") & F.col("printed").rlike(r"\d")
    return [
        finding("V16", "flag", seen & (F.col("agreement") == "mismatch"), "two readers disagree"),
        finding("V16", "flag", seen & (F.col("agreement") == "confusable"), "equal but for look-alikes"),
        finding("V17", "fail", lost, "a limit's sign was lost"),
        finding("V17", "fail", ~lost & F.coalesce(zero, F.lit(False)), "below detection stored as zero"),
        finding("V17", "fail", ~lost & ~F.coalesce(zero, F.lit(False)) & F.col("non_numeric") & v.isNotNull(), "not a number but stored as one"),
    ]


def overlaps(intervals: DataFrame) -> DataFrame:
    """V06: an interval that starts above the end of the one before it in its hole and group, unless it is nested in that."""
    w = Window.partitionBy("hole_id", "grp").orderBy("from_m", "to_m", "interval_id")
    rows = intervals.where("from_m is not null and to_m is not null").withColumn("before", F.lag("to_m").over(w))
    return told(rows, "interval_id", finding("V06", "flag", (F.col("from_m") < F.col("before") - 1e-6) & (F.col("to_m") > F.col("before") + 1e-6), "overlaps the interval before it"))


def depths(intervals: DataFrame, holes: DataFrame) -> DataFrame:
    """V01 and V08 by hole: `holes` has printed_depth with depth_unit_printed, and recorded_depth, in metres, of another source."""
    deepest = intervals.groupBy("hole_id").agg(F.max("to_m").alias("deepest"))
    rows = holes.join(deepest, "hole_id").where("deepest is not null")
    printed = F.when(F.col("depth_unit_printed") == "ft", F.col("printed_depth") * FOOT).otherwise(F.col("printed_depth"))
    total = F.coalesce(printed, F.col("recorded_depth"))
    ratio = F.col("deepest") / F.col("recorded_depth")
    return told(
        rows, "hole_id",
        finding("V01", "fail", (F.col("recorded_depth") > 0) & (F.abs(ratio - FEET_A_METRE) <= FEET_TOLERANCE), "feet were read as metres"),
        finding("V08", "fail", (total > 0) & (F.col("deepest") > total * 1.02 + 0.5), F.when(printed.isNotNull(), "printed").otherwise("recorded")),
    )


def conflicts(values: DataFrame) -> DataFrame:
    """V14: (hole_id, field, value) printed with different numbers; equal to three places counts as one."""
    n = values.where("value is not null").groupBy("hole_id", "field").agg(F.count_distinct(F.round("value", 3)).alias("n"))
    return told(n, "hole_id", finding("V14", "flag", F.col("n") > 1, F.concat_ws(" ", "field", F.col("n").cast("string"))))


def repeated(holes: DataFrame) -> DataFrame:
    """V14: a hole that a file has more than once."""
    n = holes.groupBy("file_id", "hole_id").agg(F.count("*").alias("n"))
    return told(n, "hole_id", finding("V14", "flag", F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" times"))))


def quotes(values: DataFrame, common_run: Column | None = None) -> DataFrame:
    """V15: (value_id, printed, quote): the printed value must be in its own quote.

    A quote may leave out its middle (...), if its ends are in the value; or be a shorter run of a long value.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    quote = F.replace(F.col("quote"), F.lit("…"), F.lit("..."))
    want, have, elided = bare(F.col("printed")), bare(F.col("quote")), quote.contains("...")
    at = F.position(F.lit("..."), quote)
    head, tail = bare(F.expr("left(replace(quote, '…', '...'), position('...', replace(quote, '…', '...')) - 1)")), bare(F.expr("substr(replace(quote, '…', '...'), position('...', replace(quote, '…', '...')) + 3)"))
    rows = values.where("printed is not null and quote is not null").select("*", want.alias("want"), have.alias("have"), elided.alias("elided"), F.when(at > 0, F.contains(want, head) & F.contains(want, tail)).otherwise(F.lit(False)).alias("ends"))
    rows = rows.where((F.col("want") != "") & ~F.contains("have", "want"))
    long = (F.length("want") > 60) & (common_run >= 0.8 * F.least(F.length("want"), F.length("have"))) if common_run is not None else F.lit(False)
    kind = F.when(F.col("elided") & F.col("ends"), "elided").when(long, "shorter").otherwise("absent")
    rows = rows.withColumn("kind", kind)
    return told(rows, "value_id", finding("V15", "flag", F.col("kind") != "absent", F.col("kind")), finding("V15", "fail", F.col("kind") == "absent", "not in its quote"))


def overlapping(boxes: DataFrame, words: DataFrame, page: str, share: float, cell: float = 0.1) -> DataFrame:
    """Pairs (box columns, word columns) of a page whose overlap is more than `share` of the word's area.

    Both have x0, y0, x1, y1; they meet in the grid cell that has the corner of the overlap, so a pair is found once.
    """

    def spread(df: DataFrame, tag: str) -> DataFrame:
        over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        named = df.select(*(F.col(c).alias(f"{tag}_{c}" if c in ("x0", "y0", "x1", "y1") else c) for c in df.columns))
        return named.withColumn("gx", over(f"{tag}_x0", f"{tag}_x1")).withColumn("gy", over(f"{tag}_y0", f"{tag}_y1"))

    pairs = spread(boxes, "b").join(spread(words, "w"), [page, "gx", "gy"])
    x, y = F.greatest("b_x0", "w_x0"), F.greatest("b_y0", "w_y0")
    wide, high = F.least("b_x1", "w_x1") - x, F.least("b_y1", "w_y1") - y
    area = F.greatest(F.lit(1e-9), (F.col("w_x1") - F.col("w_x0")) * (F.col("w_y1") - F.col("w_y0")))
    once = (F.floor(x / cell) == F.col("gx")) & (F.floor(y / cell) == F.col("gy"))
    return pairs.where(once & (wide > 0) & (high > 0) & (wide * high / area > share)).drop("gx", "gy")


def text_layer(values: DataFrame, words: DataFrame, page: str) -> DataFrame:
    """V13: digits of (value_id, printed, box) against those of the words over its box, read from left to right."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    both = overlapping(values.where(F.col("printed").rlike(r"\d")), words.where(F.col("word").rlike(r"\d")), page, 0.35)
    got = both.groupBy("value_id", "printed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_x0", "word_id", "word"))), lambda s: digits(s["word"])), "").alias("got"))
    want = digits(F.col("printed"))
    return told(got, "value_id", finding("V13", "flag", ~F.contains("got", want) & ~F.contains(want, F.col("got")), F.col("got")))


def hole_counts(files: DataFrame, read: DataFrame, recorded: DataFrame) -> DataFrame:
    """V20: holes read of a file (file_id, name) against the number told (`expected`) and the holes recorded elsewhere."""
    n = read.groupBy("file_id").agg(F.count("*").alias("n"))
    known = recorded.select("file_id", "name").distinct()
    missing = known.join(read.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti").groupBy("file_id").agg(F.count("*").alias("missing"))
    rows = files.join(n, "file_id", "left").join(missing, "file_id", "left").fillna(0, ["n", "missing"])
    return told(
        rows, "file_id",
        finding("V20", "flag", F.col("expected") > F.col("n"), F.concat_ws(" of ", F.col("n").cast("string"), F.col("expected").cast("string"))),
        finding("V20", "flag", F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" recorded holes are missing"))),
    )
