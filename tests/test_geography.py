from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from conftest import rows
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st

from tallyhouse.operators.heat import HeatOptions, Viewport, geo_bounds, heat_grid, heat_intensity
from tallyhouse.operators.proximity import nearby_pair_counts

POINT = "latitude double, longitude double"
SITE = "state string, latitude double, longitude double"


def all_pairs(points, sites, reach=0.5):
    counts = defaultdict(int)
    for state, site_lat, site_lng in sites:
        counts[state] += sum(abs(lat - site_lat) < reach and abs(lng - site_lng) < reach for lat, lng in points)
    return {state: count for state, count in counts.items() if count}


def counted(spark, points, sites):
    frame = nearby_pair_counts(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE), "state", 0.5)
    return dict(rows(frame))


def test_half_a_degree_is_not_near(spark):
    sites = [("A", 10.0, 20.0), ("A", 10.25, 20.0), ("B", -10.0, -20.0)]
    points = [(10.5, 20.0), (10.0, 20.5), (10.25, 20.0), (9.500001, 19.6), (-10.4999, -19.5001)]
    assert counted(spark, points, sites) == all_pairs(points, sites) == {"A": 4, "B": 1}


def test_many_points_and_a_crowded_cell(spark):
    draw = random.Random(3)
    points = [(draw.uniform(-2, 2), draw.uniform(-2, 2)) for _ in range(600)]
    points += [(1.01 + draw.uniform(0, 0.1), 1.01 + draw.uniform(0, 0.1)) for _ in range(300)] + [(0.3, 0.3)] * 100
    sites = [(draw.choice("ABC"), draw.uniform(-2, 2), draw.uniform(-2, 2)) for _ in range(80)]
    sites += [("A", 1.0, 1.0)] * 40
    assert counted(spark, points, sites) == all_pairs(points, sites)


coordinate = st.one_of(
    st.integers(-24, 24).map(lambda n: n / 8), st.floats(-3, 3, allow_subnormal=False), st.integers(-6, 6).map(lambda n: n / 2)
)


@settings(max_examples=15, deadline=None)
@for_all(
    st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=40),
    st.lists(st.tuples(st.sampled_from("AB"), coordinate, coordinate), min_size=1, max_size=10),
)
def test_equals_all_pairs(spark, points, sites):
    assert counted(spark, points, sites) == all_pairs(points, sites)


def heat_by_hand(points, view, options):
    """Running weighted means in point order, as a browser draws them."""
    cells = {}
    world, size, reach = 256 * 2**view.zoom, options.cell_size, options.reach
    scale = 2.0 ** -max(0, min(options.max_zoom - view.zoom, 12))
    for lat, lng, weight in points:
        phi = math.radians(max(min(lat, 85.0511287798), -85.0511287798))
        x = math.floor((lng + 180) / 360 * world + 0.5) - view.origin_x + view.pane_x
        y = math.floor((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * world + 0.5)
        y = y - view.origin_y + view.pane_y
        if not (-reach <= x <= view.width + reach and -reach <= y <= view.height + reach):
            continue
        cell = tuple(
            math.floor((p - math.fmod(pane, size)) / size) + 2 for p, pane in ((x, view.pane_x), (y, view.pane_y))
        )
        k = weight * scale
        old_x, old_y, old_k = cells.get(cell, (0.0, 0.0, 0.0))
        cells[cell] = ((old_x * old_k + x * k) / (old_k + k), (old_y * old_k + y * k) / (old_k + k), old_k + k)
    return {
        cell: (math.floor(x + 0.5), math.floor(y + 0.5), min(k, options.max))
        for cell, (x, y, k) in cells.items()
        if min(cell) >= 0
    }


@pytest.mark.parametrize(
    "view, options",
    [
        (Viewport(), HeatOptions()),
        (Viewport(zoom=9, width=6000, height=5000, origin_x=36_000, origin_y=47_000), HeatOptions(max=0.02, max_zoom=12)),
        (Viewport(zoom=7, width=900, height=700, origin_x=9_500, origin_y=12_300, pane_x=-33, pane_y=47), HeatOptions()),
        (Viewport(zoom=3, width=3000, height=3000, pane_x=-61, pane_y=-61), HeatOptions(radius=20, blur=10, max_zoom=3)),
    ],
)
def test_heat_grid(spark, view, options):
    draw = random.Random(5)
    points = [(draw.uniform(20, 55), draw.uniform(-130, -60), draw.randint(1, 200) / 25) for _ in range(1500)]
    points += [(40.7, -74.0, 3.0)] * 20 + [(89.9, 0.0, 1.0), (-89.9, 0.0, 1.0), (84.0, -180.0, 1.0)]
    frame = spark.createDataFrame(points, POINT + ", weight double").selectExpr(
        "latitude", "longitude", "CAST(weight AS DECIMAL(18,4)) AS weight"
    )
    got = {(row[0], row[1]): row[2:] for row in rows(heat_grid(frame, "weight", view, options))}
    want = heat_by_hand(points, view, options)
    assert got.keys() == want.keys() and len(got) > 5
    for cell, (x, y, value) in want.items():
        # A mean half way between pixels may fall either way in the running form.
        assert abs(got[cell][0] - x) <= 1 and abs(got[cell][1] - y) <= 1
        assert got[cell][2] == pytest.approx(value)


def test_weights_are_kept_when_nothing_is_clipped(spark):
    points = spark.createDataFrame([(40.0, -75.0), (40.01, -75.0), (10.0, 100.0)], POINT)
    cells = rows(heat_grid(points, options=HeatOptions(max=100.0, max_zoom=5)))
    assert sum(row[4] for row in cells) == 3.0


def test_intensity_has_a_floor_and_a_ceiling(spark):
    cells = spark.createDataFrame([(0.001,), (0.5,), (7.0,)], "value double")
    assert [row[1] for row in rows(heat_intensity(cells))] == [0.05, 0.5, 1.0]


def test_bounds(spark):
    points = spark.createDataFrame([(1.0, 5.0), (-2.0, 7.0), (0.0, -3.0)], POINT)
    assert rows(geo_bounds(points)) == [(-2.0, -3.0, 1.0, 7.0)]


def test_two_crowds_half_a_degree_apart(spark):
    """Most points lie on the rim of most sites' reach, on both sides of it and on its very border."""
    import random

    from tallyhouse.operators.proximity import nearby_pair_counts

    draw = random.Random(8)
    spread = [k / 256 for k in range(-24, 25)]
    points = [(10.0 + draw.choice(spread), 20.0 + draw.choice(spread)) for _ in range(400)] + [(10.0, -0.25), (None, 1.0)]
    sites = [("n", 10.5 + draw.choice(spread), 20.0 + draw.choice(spread)) for _ in range(60)]
    sites += [("e", 10.0 + draw.choice(spread), 20.5 + draw.choice(spread)) for _ in range(60)] + [("x", 9.75, -0.5), ("x", None, 0.0)]
    want = {}
    for group, lat, lng in sites:
        near = sum(1 for a, b in points if None not in (a, b, lat, lng) and abs(a - lat) < 0.5 and abs(b - lng) < 0.5)
        want[group] = want.get(group, 0) + near
    got = nearby_pair_counts(
        spark.createDataFrame(points, "latitude double, longitude double"),
        spark.createDataFrame(sites, "state string, latitude double, longitude double"),
        "state",
        0.5,
    )
    assert dict(map(tuple, got.collect())) == want
