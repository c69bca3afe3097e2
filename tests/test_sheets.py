"""Header rows, roles and interval rows on small sheets."""

from __future__ import annotations

import pytest

from lodestar.operators import sheets

SHEETS = {
    # A title, a header with two oxide columns (per cent goes first), a repeated header, a row without numbers, one without a name.
    "plain": [["Assays 2012"], ["Hole ID", " From (m)", "TO", "U3O8 ppm", "U3O8 (%)", "Type"], ["ab-1", "1", "2.5", "900", "0,09", "core"], ["Hole ID", "From", "To", "", "", ""], ["ab-2", "n/a", None, "nan", "x", ""], ["", "1", "2", "", "1", ""], ["ab-3", "<3", "", "", "<0.005", "Lab Duplicate"]],
    # The hole's column has a house name: four of five cells, and three of five, look like holes.
    "house": [["Ref", "Other", "from", "to", "sample"], ["PLS12-001", "HU-268", "1", "2", "s1"], ["ND0703", "HU-269", "2", "3", "s2"], ["PLS12-002", "HU-270", "3", "4", "s3"], ["PLS12-003", "none", "4", "5", "s4"], ["total", "none", "5", "6", "s5"]],
    "weak": [["Ref", "from", "to", "sample"], ["PLS12-001", "1", "2", "s1"], ["PLS12-002", "2", "3", "s2"], ["total", "3", "4", "s3"]],
    # Two tables, one below the other, the second with its columns turned round and in parts per million.
    "two": [["hole", "from", "to"], ["A", "1", "2"], ["B", "2", "3"], ["", "", ""], ["to", "from", "hole", "U3O8 ppm"], ["9", "7", "C", "5000"]],
    "none": [["from", "to", "depth"], ["1", "2", "3"]],
    "empty": [["hole", "from", "to"], ["hole", "x", "y"]],
}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(k, r, c, v) for k, sheet in SHEETS.items() for r, row in enumerate(sheet) for c, v in enumerate(row)]
    return spark.createDataFrame([*rows, ("late", 45, 0, "hole"), ("late", 45, 1, "u ppm"), ("late", 46, 0, "H1"), ("late", 46, 1, "7")], "sheet_id string, row int, col int, value string")


def test_headers_and_roles(cells):
    found = {r.sheet_id: (r.row, r.roles) for r in sheets.headers(cells).collect()}
    assert found["plain"] == (1, {"hole": 0, "from": 1, "to": 2, "u3o8": 4, "sample_type": 5})
    assert found["house"] == (0, {"hole": 0, "from": 2, "to": 3, "sample": 4})  # 80 % at least, and the largest share
    assert found["weak"] == (0, {"from": 1, "to": 2, "sample": 3}) and found["two"] == (0, {"hole": 0, "from": 1, "to": 2})
    assert set(found) == {"plain", "house", "weak", "two", "empty"}
    every = sorted((r.sheet_id, r.row, r.until) for r in sheets.headers(cells, every=True).collect())
    assert [e[1:] for e in every if e[0] == "two"] == [(0, 4), (4, None)] and ("late", 45, None) in every and ("plain", 1, 3) in every


def test_interval_rows(cells):
    found = sheets.headers(cells)
    rows = {(r.sheet_id, r.row): r for r in sheets.intervals(cells, found).collect()}
    assert {k[1] for k in rows if k[0] == "plain"} == {2, 6}
    a, b = rows["plain", 2], rows["plain", 6]
    assert (a.hole_id, a.from_m, a.to_m, a.interval_m, a.u3o8_pct, a.u3o8_as_printed, a.below_detection, a.control) == ("AB-1", 1.0, 2.5, 1.5, 0.09, "0,09", False, False)
    assert (b.from_m, b.to_m, b.interval_m, b.u3o8_pct, b.below_detection, b.sample_type, b.control) == (3.0, None, None, 0.005, True, "lab duplicate", True)
    assert rows["house", 5].hole_id == "TOTAL" and rows["weak", 1].hole_id is None and rows["weak", 1].sample_id == "s1"
    assert rows["two", 5].from_m == 7.0 and rows["two", 5].hole_id == "9"  # the first header rules all
    by = {(r.sheet_id, r.row): r for r in sheets.intervals(cells, sheets.headers(cells, every=True)).collect()}
    assert (by["two", 5].hole_id, by["two", 5].to_m, by["two", 5].u3o8_pct, by["two", 5].header_row) == ("C", 9.0, 0.5, 4) and by["two", 1].hole_id == "A"
    told = {r.sheet_id: (r.status, r.header_row, r.n_rows) for r in sheets.summary(cells, found, sheets.intervals(cells, found)).collect()}
    assert told == {"plain": ("ingested", 1, 2), "house": ("ingested", 0, 5), "weak": ("ingested", 0, 3), "two": ("ingested", 0, 3), "none": ("no_header", None, 0), "empty": ("empty", 0, 0), "late": ("no_header", None, 0)}
    assert sheets.intervals(cells.where("false"), sheets.headers(cells.where("false"))).count() == 0
