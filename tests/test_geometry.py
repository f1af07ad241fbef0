import numpy as np

from paperloom.operators import geometry as R


def page(slope=0.0):
    ink = np.zeros((600, 400), bool)
    x = np.arange(400)
    for y in (60, 90, 120, 420):
        at = y + np.round(x * np.tan(np.radians(slope))).astype(int)
        ink[at, x] = ink[at + 1, x] = True
    for v in (40, 200, 360):
        top = 60 + int(round(v * np.tan(np.radians(slope))))
        ink[top : top + 62, v : v + 2] = True
    return ink


def test_grid_of_a_straight_page():
    grid = R.grid_of(page())
    assert grid == {"separators": [0.1, 0.5, 0.9], "header_top": 60, "header_bottom": 120, "body_top": 140, "body_bottom": 400}
    assert R.grid_of(np.zeros((600, 400), bool)) is None and R.skew_of(page()) == 0.0


def test_skew_is_found_and_undone(spark):
    ink = page(0.9)
    assert abs(R.skew_of(ink) - 0.9) <= 0.1
    rows = [(1, np.where(ink, 0, 255).astype(np.uint8).tobytes(), 400, "x"), (2, None, 400, "x"), (3, b"", 0, "x"), (4, np.full(240_000, 255, np.uint8).tobytes(), 400, "x")]
    out = {r["page"]: r for r in R.survey_pages(spark.createDataFrame(rows, "page long, picture binary, width int, mode string"), ["page"], "picture", "width").collect()}
    assert out[1]["mode"] == "table" and abs(out[1]["skew"] - 0.9) <= 0.1 and len(out[1]["separators"]) == 3
    assert [out[k]["mode"] for k in (2, 3, 4)] == ["text"] * 3
    assert R.survey_pages(spark.createDataFrame([], "page long, picture binary, width int"), ["page"], "picture", "width").count() == 0


def test_lines():
    assert R.lines_at(np.array([0, 5, 5, 0, 5, 0] + [0] * 20 + [9]), 1).tolist() == [2, 26]
