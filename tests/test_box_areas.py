"""Areas by sweep lines against counted cells."""

from __future__ import annotations

import random

from loomlens.operators import localize as L

BOX = "image_id string, x long, y long, w long, h long"


def cells(rows):
    found = {}
    for i, x, y, w, h in rows:
        if None not in (i, x, y, w, h):
            found.setdefault(i, set()).update((a, b) for a in range(x, x + w) for b in range(y, y + h))
    return found


def drawn(r, n, images, side):
    return [(f"i{r.randrange(images)}", r.randrange(-3, side), r.randrange(-3, side), r.randrange(0, 9), r.randrange(0, 9)) for _ in range(n)]


def test_areas_equal_counted_cells(spark):
    r = random.Random(3)
    first, second = drawn(r, 300, 12, 30), drawn(r, 200, 14, 30)
    first += first[:20] + [("only first", 0, 0, 4, 4), ("only first", 4, 0, 4, 4), ("nested", 0, 0, 20, 20), ("nested", 5, 5, 2, 2), ("empty", 1, 1, 0, 5)]
    second += [("only second", 2, 2, 3, 3), ("nested", 6, 0, 1, 40), (None, 0, 0, 2, 2), ("nested", None, 0, 2, 2)]
    found = {x.image_id: (x.area_first, x.area_second, x.area_both) for x in L.overlap_areas(spark.createDataFrame(first, BOX), spark.createDataFrame(second, BOX)).collect()}
    a, b = cells(first), cells(second)
    expected = {i: (len(a.get(i, set())), len(b.get(i, set())), len(a.get(i, set()) & b.get(i, set()))) for i in a.keys() | b.keys()}
    assert found == {i: v for i, v in expected.items() if any(v)}


def test_the_area_of_a_large_box_needs_no_cells(spark):
    big = spark.createDataFrame([("a", 0, 0, 10**6, 10**6), ("a", 10**5, 10**5, 10**6, 10**6)], BOX)
    assert L.overlap_areas(big, big.limit(0)).first() == ("a", 2 * 10**12 - 81 * 10**10, 0, 0)


def test_sides_may_be_fractions_and_keys_several(spark):
    rows = spark.createDataFrame([("m", 1, 0.5, 0.0, 1.5, 2.0), ("m", 2, 0.0, 0.0, 1.0, 1.0)], "method string, image_id int, x double, y double, w double, h double")
    found = L.overlap_areas(rows, rows.where("image_id = 1"), ["method", "image_id"]).collect()
    assert {tuple(x) for x in found} == {("m", 1, 3.0, 3.0, 3.0), ("m", 2, 1.0, 0.0, 0.0)}
