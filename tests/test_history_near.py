"""J3 against brute force: many distinct places, both radii, hot places, probes with and without hits."""

import random

import pytest
from pyspark.sql import functions as F

from roadlens.operators import geo

FIELDS = ("date", "location_name", "zone", "headline", "severity", "publisher", "source_url", "vehicle_type")
SCHEMA = "article_id long, latitude double, longitude double, " + ", ".join(f"{c} string" for c in FIELDS)


def accidents(n, rnd):
    rows = []
    for i in range(n):
        # a third stands at one place, a third is dense, the others are spread; some stand on cell borders
        lat, lng = [(13.05, 80.25), (13 + rnd.random() / 10, 80.2 + rnd.random() / 10),
                    (round(12 + 3 * rnd.random(), 2), round(79 + 3 * rnd.random(), 2))][i % 3]
        rows.append((i, lat, lng, f"2023-{rnd.randrange(1, 13):02d}-0{rnd.randrange(1, 10)}", "p", "z", f"h{i}", "s", "u",
                     "l", "v"))
    return rows


def brute(probes, rows, r, limit, widen, min_hits):
    found = {}
    for pid, lat, lng in probes:
        if lat is None or lng is None:
            found[pid] = (0, [])
            continue
        box = lambda half: [x for x in rows if abs(x[1] - lat) < half and abs(x[2] - lng) < half]
        hits = box(r)
        if len(hits) < min_hits:
            hits = box(r * widen)
        hits = sorted(sorted(hits, key=lambda x: x[0]), key=lambda x: x[3], reverse=True)
        found[pid] = (len(hits), [x[6] for x in hits[:limit]])
    return found


def run(spark, probes, rows, **options):
    acc = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pr = spark.createDataFrame(probes, "probe_id long, lat double, lng double").withColumn("half", F.lit("clash"))
    found = {}
    for x in geo.accidents_near(pr, acc, **options).orderBy("probe_id", "rank").collect():
        total, heads = found.setdefault(x.probe_id, (x.matched, []))
        assert total == x.matched and x.total == min(total, options.get("limit", 10))
        if x["rank"] is not None:
            assert x["rank"] == len(heads) + 1
            heads.append(x.headline)
    return found


@pytest.mark.parametrize("limit,min_hits", [(10, 3), (2, 1), (4, 40)])
def test_brute_force(spark, limit, min_hits):
    rnd = random.Random(limit)
    rows = accidents(900, rnd)
    probes = [(i, 12 + 3 * rnd.random(), 79 + 3 * rnd.random()) for i in range(150)]
    probes += [(i, 13 + rnd.random() / 10, 80.2 + rnd.random() / 10) for i in range(150, 200)]
    probes += [(200, 13.05, 80.25), (201, 13.05, 80.25), (202, 13.0, 80.2), (203, -50.0, -120.0), (204, None, 80.0)]
    got = run(spark, probes, rows, limit=limit, min_hits=min_hits)
    assert got == brute(probes, rows, 0.05, limit, 3.0, min_hits)


def test_empty(spark):
    assert run(spark, [(1, 13.0, 80.0)], []) == {1: (0, [])}
    assert run(spark, [], accidents(9, random.Random(1))) == {}


def test_radius_is_chosen_by_counts(spark):
    points = spark.createDataFrame([(13.0, 80.0, 2), (13.049, 80.0, 1), (13.2, 80.0, 5)],
                                   "a_lat double, a_lng double, n_point long")
    locs = spark.createDataFrame([(13.0, 80.0), (12.99, 80.0), (13.2, 80.049), (13.11, 80.0)], "p_lat double, p_lng double")
    half = {r.p_lat: r.half for r in geo.choose_radius(locs, points, 0.05, 3.0, 3).collect()}
    assert half[13.0] == half[13.2] == 0.05 and half[12.99] == half[13.11] == pytest.approx(0.15)
