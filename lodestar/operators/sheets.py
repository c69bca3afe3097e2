"""From the cells of spreadsheets to interval rows: which row is a header, which column plays which role, what the rows say.

Cells are (sheet_id, row, col, value), numbered from 0; empty ones may be absent. A header is a row that names a hole or sample column and
either both depths or an assay column. Roles are read off header rows alone, one small row for each header; cells meet them by sheet and
column, so a long sheet is never one task's work. With several headers each rules the rows down to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a header may say for each role, the form of a hole's name, of a number, of a control sample, and the depth of the search.
ROLES = {
    "hole": r"^(hole|ddh|hole[ _]?(id|no|number|name)|drill[ _]?hole|bhid|dh)$",
    "sample": r"^(sample|sample[ _]?(id|no|number|#)|lab[ _]?tag[ _]?id|tag)$",
    "from": r"^(from|from[ _]?\(?m\)?|depth[ _]?\(?from\)?|start)$",
    "to": r"^(to|to[ _]?\(?m\)?|depth[ _]?\(?to\)?|end)$",
    "interval": r"^(interval|interval[ _]?width|width|length|int)$",
    "sample_type": r"^(sample type|sample_type|type)$",
}
OXIDE, METAL, SHARE, PARTS = r"u3o8|u308", r"^u([ _(]|$)|^u[ _]?ppm|^u_icp|uranium", r"%|perc|pct", r"ppm"
HOLE_NAME = r"^[A-Z]{1,6}[- _]?\d{1,4}[- _]\d{2,4}[A-Z]?$|^[A-Z]{2,6}[- _]?\d{2,4}[A-Z]?$"
NUMBER = r"^[<>]?\s*-?\d+(?:[.,]\d+)?$"
CONTROL = r"standard|blank|duplicate|\brep\b|reference"
SCAN, LOOK, LEAST_CELLS, LEAST_SHARE = 40, 25, 3, 0.8


def cell_text(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed; null and 'nan' are empty."""
    t = F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return F.when(c == "nan", "").otherwise(t)


def header_key(c: Column) -> Column:
    """A header cell's letters, digits, unit signs and single separators."""
    return F.trim(F.regexp_replace(cell_text(c), "[^a-z0-9%()#_ ]", ""))


def roles_of(cells: DataFrame) -> DataFrame:
    """(sheet_id, row, role, col, key): in every row, the first column for each role; an oxide column in per cent goes before one that is not."""
    named = cells.select("sheet_id", "row", "col", header_key(F.col("value")).alias("key")).where("key <> ''")
    base = F.trim(F.replace("key", F.lit("(m)"), F.lit("")))
    plain = F.lit(None).cast("string")
    for role, pattern in reversed(ROLES.items()):
        plain = F.when(base.rlike(pattern), F.lit(role)).otherwise(plain)
    oxide = F.col("key").rlike(OXIDE)
    metal = F.col("key").rlike(METAL) & ~oxide & (F.col("key").rlike(PARTS) | F.contains("key", F.lit("icp")))
    assay = F.when(oxide & ~F.contains("key", F.lit("dot")), "u3o8").when(metal, "u_ppm")
    found = named.select("sheet_id", "row", "col", "key", F.explode(F.filter(F.array(plain, assay), lambda r: r.isNotNull())).alias("role"))
    later = F.when((F.col("role") == "u3o8") & ~F.col("key").rlike(SHARE), 1).otherwise(0)
    return found.groupBy("sheet_id", "row", "role").agg(F.min(F.struct(later.alias("later"), "col", "key")).alias("b")).select("sheet_id", "row", "role", "b.col", "b.key")


def headers(cells: DataFrame, scan: int = SCAN, every: bool = False) -> DataFrame:
    """(sheet_id, row, until, roles): the first header among the first `scan` rows of each sheet, or `every` one wherever it is.

    `roles` maps a role to its column; `until` is the row of the next header, null for the last. Where no column is named for the hole, one whose
    cells look like hole names takes the role: at least three cells among the next 25 rows, 80 % of them, the largest share, then the first column.
    """
    roles = roles_of(cells if every else cells.where(F.col("row") < scan))
    rows = roles.groupBy("sheet_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("role", "col"))).alias("roles"), F.map_from_entries(F.collect_list(F.struct("role", "key"))).alias("keys"))
    has = lambda r: F.map_contains_key("roles", r)
    rows = rows.where((has("hole") | has("sample")) & ((has("from") & has("to")) | has("u3o8") | has("u_ppm")))
    if not every:
        rows = rows.groupBy("sheet_id").agg(F.min_by(F.struct("row", "roles", "keys"), "row").alias("h")).select("sheet_id", "h.*")
    rows = rows.withColumn("until", F.lead("row").over(Window.partitionBy("sheet_id").orderBy("row")))  # header rows only
    open_ = rows.where(~has("hole")).select("sheet_id", F.col("row").alias("__h"), "until", F.map_values("roles").alias("__taken"))
    # Only rows just below a header are looked at; they meet it by sheet and number.
    below = open_.withColumn("row", F.explode(F.sequence(F.col("__h") + 1, F.least(F.col("__h") + LOOK, F.coalesce(F.col("until") - 1, F.col("__h") + LOOK)))))
    looked = cells.join(below.drop("until"), ["sheet_id", "row"]).where((cell_text(F.col("value")) != "") & ~F.array_contains("__taken", F.col("col")))
    share = looked.groupBy("sheet_id", "__h", "col").agg(F.count("*").alias("n"), F.avg(F.upper(F.trim("value")).rlike(HOLE_NAME).cast("double")).alias("share"))
    guess = share.where((F.col("n") >= LEAST_CELLS) & (F.col("share") >= LEAST_SHARE)).groupBy("sheet_id", F.col("__h").alias("row")).agg(F.min_by("col", F.struct(-F.col("share"), "col")).alias("guess"))
    out = rows.join(guess, ["sheet_id", "row"], "left")
    full = F.when(F.col("guess").isNotNull(), F.map_concat("roles", F.create_map(F.lit("hole"), F.col("guess")))).otherwise(F.col("roles"))
    return out.select("sheet_id", "row", "until", full.alias("roles"), "keys")


def number(c: Column) -> Column:
    """The value of a printed number, comma or point; a sign < or > before it is not part of it; null if it is none."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(NUMBER), F.replace(F.regexp_replace(t, r"^[<>]\s*", ""), F.lit(","), F.lit(".")).try_cast("double"))


def intervals(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Interval rows below the headers of headers(): hole, sample, depths, assays as numbers and as printed.

    A row needs a hole or a sample, and a depth or an assay; a header that is repeated further down has neither. An oxide column in parts per million is
    turned to per cent. The interval is as printed, else the depths' difference. A number printed with < is below detection.
    """
    roles = found.select("sheet_id", F.col("row").alias("header_row"), "until", "keys", F.explode("roles").alias("role", "col"))
    at = F.col("row")
    mine = cells.join(roles, ["sheet_id", "col"]).where((at > F.col("header_row")) & (at < F.coalesce(F.col("until"), F.lit(1 << 62))))
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("value")))
    rows = mine.groupBy("sheet_id", "header_row", "row").agg(*(pick(r).alias(f"__{r}") for r in (*ROLES, "u3o8", "u_ppm")), F.first("keys").alias("keys"))
    text = lambda r: F.nullif(cell_text(F.col(f"__{r}")), F.lit(""))
    value = {r: number(F.col(f"__{r}")) for r in ("from", "to", "interval", "u3o8", "u_ppm")}
    key = F.coalesce(F.try_element_at("keys", F.lit("u3o8")), F.lit(""))
    oxide = F.when(key.rlike(PARTS) & ~key.rlike(SHARE), value["u3o8"] / 10_000.0).otherwise(value["u3o8"])
    below = F.lit(False)
    for r in ("u3o8", "u_ppm"):
        below = below | F.coalesce(value[r].isNotNull() & F.trim(F.col(f"__{r}")).startswith("<"), F.lit(False))
    out = rows.select(
        "sheet_id", "row", "header_row", F.upper(text("hole")).alias("hole_id"), text("sample").alias("sample_id"), value["from"].alias("from_m"), value["to"].alias("to_m"),
        F.coalesce(value["interval"], F.round(value["to"] - value["from"], 3)).alias("interval_m"), oxide.alias("u3o8_pct"), F.trim("__u3o8").alias("u3o8_as_printed"),
        value["u_ppm"].alias("u_ppm"), F.trim("__u_ppm").alias("u_ppm_as_printed"), below.alias("below_detection"), text("sample_type").alias("sample_type"),
    )
    kept = out.where("(hole_id IS NOT NULL OR sample_id IS NOT NULL) AND (from_m IS NOT NULL OR to_m IS NOT NULL OR u3o8_pct IS NOT NULL OR u_ppm IS NOT NULL)")
    return kept.withColumn("control", F.coalesce(F.col("sample_type").rlike(CONTROL), F.lit(False)) | F.coalesce(F.col("sample_id").rlike(CONTROL), F.lit(False)))


def summary(cells: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """(sheet_id, status, header_row, n_rows): ingested, empty (a header but no row) or no_header."""
    head = found.groupBy("sheet_id").agg(F.min("row").alias("header_row"))
    n = rows.groupBy("sheet_id").agg(F.count("*").alias("n_rows"))
    out = cells.select("sheet_id").distinct().join(head, "sheet_id", "left").join(n, "sheet_id", "left")
    status = F.when(F.col("header_row").isNull(), "no_header").when(F.col("n_rows").isNull(), "empty").otherwise("ingested")
    return out.select("sheet_id", status.alias("status"), "header_row", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
