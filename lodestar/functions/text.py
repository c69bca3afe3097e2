"""Text, number and name functions as columns. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")

NUMBER = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?"


def plain(c: Column) -> Column:
    """One form of dashes, quotes and white space; lower case; trimmed."""
    c = F.translate(c, "‐‑‒–—−‘’“”", "------''\"\"")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def squash(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(plain(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def look_alikes(c: Column) -> Column:
    """Letters that are read for digits turned into the digits they resemble."""
    return F.translate(c, "OolISBZ", "0011582")


def digit_agreement(printed: Column, read: Column) -> Column:
    """exact, confusable (equal once look-alikes are turned), mismatch, or na where the print has no digit."""
    p = digits_of(printed)
    return F.when(p == "", "na").when(F.contains(digits_of(read), p), "exact").when(F.contains(digits_of(look_alikes(read)), p), "confusable").otherwise("mismatch")


def tokens(c: Column) -> Column:
    """Lower-case words of two letters or digits at least, without stop words; null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9à-ÿ]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def sentences(c: Column) -> Column:
    """Parts that end with a stop, question or exclamation mark before white space."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def snippet(text: Column, terms: Column, before: int = 60, size: int = 160) -> Column:
    """The text around the first of the terms, or its start."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, F.lower(text))), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - before)
    return F.substring(text, start, F.lit(size))


def name_key(c: Column) -> Column:
    """A hole or site name without separators and without leading zeros in its groups of digits."""
    groups = F.regexp_extract_all(F.upper(c), F.lit("[A-Z]+|[0-9]+"), F.lit(0))
    return F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=[0-9])", "")), "")


def parse_number(c: Column) -> Column:
    """struct(value, qualifier, printed): the first number with a sign < or > before it, thousands dropped."""
    found = F.regexp_extract(c, r"([<>]?)\s*(" + NUMBER + ")", 2)
    qualifier = F.regexp_extract(c, r"([<>]?)\s*(" + NUMBER + ")", 1)
    value = F.regexp_replace(found, ",", "").try_cast("double")
    return F.struct(value.alias("value"), F.nullif(qualifier, F.lit("")).alias("qualifier"), F.nullif(found, F.lit("")).alias("printed"))


def decimals(c: Column) -> Column:
    """Digits printed after the point."""
    return F.length(F.regexp_extract(c, r"\.(\d+)", 1))


def plausible_year(c: Column, first: int = 1900, last: int = 2026) -> Column:
    """The first four-digit year in range in a free text."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(first, last)), F.lit(0))


def numbers_in(c: Column) -> Column:
    """Distinct numbers of a text as printed, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\w.])" + NUMBER + r"(?![\w])"), F.lit(0)))


def renderings(value: Column) -> Column:
    """The ways a value may be printed: whole, one or two decimals, with thousands, and as a per cent of one."""
    return F.array_distinct(
        F.filter(
            F.array(
                F.when(value == F.floor(value), F.format_string("%.0f", value)), F.format_string("%.1f", value), F.format_string("%.2f", value),
                F.format_number(value, 0), F.format_number(value, 1), F.when(F.abs(value) <= 1, F.format_string("%.0f", value * 100)), F.when(F.abs(value) <= 1, F.format_string("%.1f", value * 100)),
            ),
            lambda x: x.isNotNull(),
        )
    )


def redact_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<![\w.])" + NUMBER + r"(?![\w])", "[n]")


def file_number(c: Column) -> Column:
    """A file number in its joining form: MAW and five digits at least, or a sheet and four; others without blanks."""
    t = F.upper(F.regexp_replace(F.trim(c), r"\s+", ""))
    maw, old = F.regexp_extract(t, r"^MAW0*(\d+)$", 1), r"^(\d{2}[A-P]\d{2})-?(\d{3,4})$"
    return F.when(maw != "", F.concat(F.lit("MAW"), F.lpad(maw, F.greatest(F.length(maw), F.lit(5)), "0"))).when(t.rlike(old), F.concat(F.regexp_extract(t, old, 1), F.lit("-"), F.lpad(F.regexp_extract(t, old, 2), 4, "0"))).otherwise(t)


def file_numbers_in(c: Column) -> Column:
    """The file numbers that a text mentions, normalised, each once, in order."""
    found = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"\b(MAW\s?\d{3,5}|\d{2}[A-P]\d{2}-\d{3,4})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, file_number))


def sheet_of(c: Column) -> Column:
    """The map sheet at the start of a file number, null if it has none."""
    return F.nullif(F.regexp_extract(file_number(c), r"^(\d{2}[A-P](?:\d{2})?)-", 1), F.lit(""))


# Words of a company's name that do not tell it from others.
COMPANY_FORMS = ("LTD", "LIMITED", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "THE", "OF", "LTEE", "LIMITEE")


def company_key(c: Column) -> Column:
    """The first-named company without its legal form: as many of its first three words as have four letters together."""
    first = F.get(F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\(.*?\)", " "), r"[,;/]| - |-(?=[A-Z])"), F.lit(0))
    words = F.slice(F.filter(F.regexp_extract_all(first, F.lit("[A-Z0-9&]+"), F.lit(0)), lambda w: ~w.isin(*COMPANY_FORMS)), 1, 3)
    size = lambda k: F.length(F.array_join(F.filter(F.slice(words, 1, k), lambda w: w != "&"), ""))
    take = F.when(size(1) >= 4, 1).when(size(2) >= 4, 2).otherwise(3)
    return F.when(F.size(words) == 0, "UNKNOWN").otherwise(F.array_join(F.slice(words, F.lit(1), take), " "))


def era(year: Column) -> Column:
    """struct(era, early): four spans of years; those before 1968 count to the first and are marked."""
    name = F.when(year < 1980, "1970s").when(year < 2000, "1980s-1990s").when(year.isNotNull(), "2000s+")
    return F.struct(name.alias("era"), F.coalesce(year < 1968, F.lit(False)).alias("early"))


def name_range(c: Column, most: int = 400) -> Column:
    """'SB-10 to SB-16', 'KN-01 to -08', 'AE-1 to 5': the names of the range; any other text is itself."""
    form = r"^\s*(\D*?)(\d+)\s+to\s+-?\s*(\D*?)(\d+)\s*$"
    lead, a, again, b = (F.regexp_extract(c, form, k) for k in (1, 2, 3, 4))
    start, stop = a.try_cast("int"), b.try_cast("int")
    fine = c.rlike(form) & ((again == "") | (again == lead)) & (stop >= start) & (stop - start <= most)
    width = F.when(a.startswith("0") | (F.length(a) == F.length(b)), F.length(a)).otherwise(0)
    number = lambda i: F.concat(lead, F.lpad(i.cast("string"), F.greatest(width, F.length(i.cast("string"))), F.lit("0")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(F.sequence(F.coalesce(start, F.lit(0)), F.greatest(F.coalesce(stop, F.lit(0)), F.coalesce(start, F.lit(0)))), number)).otherwise(F.array(F.trim(c)))


def safe_file_name(c: Column, size: int = 80) -> Column:
    return F.left(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit(size))


def year_of_millis(c: Column, first: int = 1900, last: int = 2026) -> Column:
    year = F.year(F.timestamp_millis(c))
    return F.when(year.between(first, last), year)


def species_of(c: Column) -> Column:
    """Species by what is printed: the equivalent oxide before the oxide before the element; nothing printed is not_printed."""
    t = F.coalesce(F.trim(c), F.lit(""))
    return F.when(t == "", "not_printed").when(t.rlike(r"(?i)\beu\s?3\s?o\s?8\b|equivalent\s+u3o8"), "eU3O8").when(t.rlike(r"(?i)u\s?3\s?o\s?8"), "U3O8").when(t.rlike(r"(?i)\bu\b|uranium"), "U").otherwise("other")


def basis_of(c: Column) -> Column:
    t = F.coalesce(F.trim(c), F.lit(""))
    return F.when(t.rlike(r"(?i)\beu\s?3?\s?o?\s?8?\b|equivalent|probe|cps|gamma|radiometric"), "probe_equivalent").when(t.rlike(r"(?i)assay|chemical|fluorimetric|icp"), "chemical").otherwise("not_printed")


def number_format(unit: Column, value: Column) -> Column:
    return F.when(unit.isin("m", "km2", "cps", "ppm"), "m1").when(value == F.floor(value), "int").otherwise("m2")


def same_print(a: Column, b: Column) -> Column:
    """Two printed numbers agree: the same qualifier, and values within half a unit of the coarser last place."""
    x, y = parse_number(a), parse_number(b)
    place = F.least(decimals(a), decimals(b))
    return x["qualifier"].eqNullSafe(y["qualifier"]) & (F.abs(x["value"] - y["value"]) <= 0.5 * F.pow(F.lit(10.0), -place) + 1e-9)


def finite(c: Column) -> Column:
    """A number, or null where it is none or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def json_of(c: Column) -> Column:
    """JSON of a struct of numbers whose NaN and infinity become null."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def point_radius(value: Column, cap: float) -> Column:
    """Radius of a dot by the logarithm of its value, from 3 to 9; 3 for an unknown value."""
    return F.coalesce(3 + 6 * F.log10(1 + F.least(value, F.lit(cap))) / F.log10(F.lit(1 + cap)), F.lit(3.0))


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the smaller box; boxes are x0, y0, x1, y1."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = lambda c: F.greatest((c[2] - c[0]) * (c[3] - c[1]), F.lit(1e-9))
    return F.when((wide > 0) & (high > 0), wide * high / F.least(area(a), area(b))).otherwise(0.0)


def band_overlap(a: list[Column], b: list[Column]) -> Column:
    """Overlap of the heights over the smaller height."""
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return high / F.greatest(F.least(a[3] - a[1], b[3] - b[1]), F.lit(1e-9))


def padded_box(box: list[Column], pad: float) -> list[Column]:
    """The box grown on every side, kept within the page (0 to 1)."""
    return [F.greatest(F.lit(0.0), box[0] - pad), F.greatest(F.lit(0.0), box[1] - pad), F.least(F.lit(1.0), box[2] + pad), F.least(F.lit(1.0), box[3] + pad)]
