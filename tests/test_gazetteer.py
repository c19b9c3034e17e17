"""Lookups in place tables given by the caller, against brute force."""

import random

from pyspark.sql import functions as F

from roadlens import dims
from roadlens.operators import gazetteer as gaz
from roadlens.operators import geo
from roadlens.operators import records as rec
from roadlens.plans import build
from roadlens.sources import feeds

SYLLABLES = ["pal", "lam", "nag", "ar", "pet", "tai", "kon", "da", "the", "mari", "vel", "ச்சி"]


def word(rnd, n):
    return "".join(rnd.choice(SYLLABLES) for _ in range(n))


def test_ten_thousand_keys_equal_brute_force(spark):
    rnd = random.Random(5)
    keys = {word(rnd, rnd.randint(2, 6)) for _ in range(14_000)} | {"the", "ar", "marina road"}
    keys = rnd.sample(sorted(keys), min(10_000, len(keys)))
    zones = [(i, k, f"z{i}") for i, k in enumerate(keys)] + [(70_000, None, "n"), (70_001, "", "e"), (70_002, keys[0], "r")]
    texts = [(i, " ".join(word(rnd, rnd.randint(1, 4)).upper() for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    texts += [(1000, None), (1001, ""), (1002, "x" * 255 + keys[1]), (1003, "no place " * 200 + keys[2] + " q" * 300)]
    df = spark.createDataFrame(texts, "id long, t string")
    zt = spark.createDataFrame(zones, "zone_ord int, zone_key string, zone string")
    got = {r.id: (r.zone_ord, r.zone) for r in gaz.first_key(df, "id", F.col("t"), zt).collect()}
    expected = {}
    for i, t in texts:
        hit = next(((o, z) for o, k, z in sorted(zones, key=lambda z: z[0]) if t and k and k in t.lower()), None)
        if hit:
            expected[i] = hit
    assert got == expected and {1002, 1003} <= set(got)


def test_positions_of_texts_are_not_exchanged(spark):
    df = spark.createDataFrame([(1, "anna salai anna salai"), (1, "guindy"), (None, "guindy"), (2, None)], "id long, t string")
    zt = spark.createDataFrame([(0, "guindy"), (1, "anna salai")], "zone_ord int, zone_key string")
    hits = gaz.key_hits(df, "id", "t", zt, "zone_key")
    assert sorted(map(tuple, hits.collect()), key=str) == [(1, "anna salai"), (1, "guindy"), (None, "guindy")]
    out = gaz.first_key(df, "id", F.col("t"), zt)
    assert sorted((r.id, r.t, r.zone_ord) for r in out.collect()) == [(1, "anna salai anna salai", 0), (1, "guindy", 0)]
    for frame in (hits, out):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_part" in x]


def test_empty_place_tables(spark):
    df = spark.createDataFrame([(1, "anna salai", 13.0, 80.0)], "id long, t string, lat double, lng double")
    none = spark.createDataFrame([], "zone_ord int, zone_key string, lat double, lng double")
    assert gaz.first_key(df.select("id", "t"), "id", F.col("t"), none).count() == 0
    row = gaz.nearest_place(df, none).first()
    assert row.zone_ord is None and row.zone_dist is None
    assert gaz.nearest_place(df.where("false"), none).count() == 0


def test_nearest_place_equals_brute_force(spark):
    rnd = random.Random(9)
    places = [(i, rnd.gauss(13, 0.1), rnd.gauss(80, 0.1)) for i in range(300)]
    places += [(400, 50.0, -100.0), (401, 50.0, -100.0), (402, None, 80.0), (403, float("nan"), 1.0), (404, -89.5, 179.5)]
    spots = [(i, rnd.gauss(13, 0.3), rnd.gauss(80, 0.3)) for i in range(200)]
    spots += [(900, 50.0, -100.0), (901, -60.0, 0.0), (902, 89.0, 179.0), (903, -90.0, -180.0), (904, 13.0, 80.0),
              (905, 13.0, 80.0), (906, None, 80.0), (907, float("nan"), 80.0)]
    df = spark.createDataFrame(spots, "id long, lat double, lng double")
    pt = spark.createDataFrame(places, "zone_ord int, lat double, lng double")
    got = {r.id: (r.zone_dist, r.zone_ord) for r in gaz.nearest_place(df, pt).collect()}
    usable = [(o, a, b) for o, a, b in places if a is not None and a == a]
    for i, a, b in spots:
        best = min((((a - x) ** 2 + (b - y) ** 2) ** 0.5, o) for o, x, y in usable) if a is not None and a == a else None
        if best is None:
            assert got[i] == (None, None)
        else:
            assert got[i][1] == best[1] and abs(got[i][0] - best[0]) < 1e-9, i
    assert len(got) == len(spots)


def test_a_custom_zone_table_is_used(spark):
    probes = spark.createDataFrame([(1, 13.0, 80.2), (2, -5.0, 10.0)], "probe_id long, lat double, lng double")
    zone = spark.createDataFrame([(24, "Only", 10.0, 70.0, 5, "Rural")],
                                 "zone_ord int, zone_name string, lat double, lng double, base_risk int, road_type string")
    rows = geo.nearest_zone(probes, zones=zone).collect()
    assert {(r.probe_id, r.zone_ord, r.zone_name, r.base_risk) for r in rows} == {(1, 24, "Only", 5), (2, 24, "Only", 5)}
    fixed = geo.nearest_zone(probes, zones=dims.zones_serving(spark)).select("probe_id", "zone_name").collect()
    assert sorted(fixed) == sorted(geo.nearest_zone(probes).select("probe_id", "zone_name").collect())


def test_highlight_zones_come_from_the_table(spark):
    acc = spark.createDataFrame([("Marina Beach", 1), ("MARINA road", 1), ("Anna Salai", 1), ("Marina", 0), (None, 1)],
                                "location_name string, accident int")
    top = spark.createDataFrame([(0, "Marina Bay", 1.0, 2.0, 3), (1, "Else", 1.0, 2.0, 3)],
                                "top_ord int, name string, lat double, lng double, risk int")
    got = {r.name: r.real_incidents for r in geo.zone_name_incidents(top, acc).collect()}
    assert got == {"Marina Bay": 2, "Else": 0}


PROFILES = [(0, "feed", None, None, False, False), (7, "site", "The Paper", "https://paper.test", True, False),
            (8, "site", "Tamil Daily", "https://tamil.test", False, True)]
PROFILE = "source_rank int, source_kind string, site_publisher string, base string, url_dated boolean, relaxed boolean"


def test_sources_follow_their_profile_rows(spark):
    """Two sites that no constant of the library names: bases, publishers, dated links, relaxed rule, run order."""
    profiles = spark.createDataFrame(PROFILES, PROFILE)
    told = "Two killed in road accident at adyar, Chennai"
    tamil = dims.TAMIL_TITLE_WORDS[0] + " adyar"
    pages = spark.createDataFrame([
        (1, 7, f'<a href="/2023/05/06/x">{told}</a><p><a class="k" href=\'/2023/05/07/y\'>{tamil}</a></p>'),
        (2, 8, f'<a href="/2023/05/08/z">{tamil} 2</a><a href="https://other.test/q">{told}</a>'),
        (3, 9, f'<a href="/no-profile">{told} again</a>'), (4, 8, None)], "page_id long, source_rank int, html string")
    items = feeds.listing_items(pages, profiles).collect()
    assert sorted((r.article_id, r.pos, r.source_url) for r in items) == [
        (1, 0, "https://paper.test/2023/05/06/x"), (1, 1, "https://paper.test/2023/05/07/y"),
        (2, 0, "https://tamil.test/2023/05/08/z"), (2, 1, "https://other.test/q")]
    feed = spark.createDataFrame([(100, 0, None, "Bus crash in Chennai at adyar - Daily", "", "k", "https://f.test/1")],
                                 "article_id long, source_rank int, published_ts timestamp_ntz, title string, "
                                 "summary string, keyword string, source_url string")
    out = build.build_dataset(feed, pages, profiles, dims.zones_train(spark), F.lit("2024-02-01").cast("date"))
    pos = {r.source_url: r for r in out.where("accident = 1").collect()}
    assert sorted(pos) == ["https://f.test/1", "https://paper.test/2023/05/06/x", "https://paper.test/2023/05/07/y",
                           "https://tamil.test/2023/05/08/z"]  # the other paper came first with the same title
    assert pos["https://f.test/1"].publisher == "Daily"
    assert pos["https://paper.test/2023/05/06/x"].publisher == "The Paper"
    assert pos["https://paper.test/2023/05/06/x"].date == "2023-05-06"
    assert pos["https://tamil.test/2023/05/08/z"].publisher == "Tamil Daily"
    assert pos["https://tamil.test/2023/05/08/z"].date != "2023-05-08"  # its links are not dated
    assert out.where("accident = 0").count() == 4


def test_profiles_and_ranks_give_the_same_flags(spark):
    items = spark.createDataFrame([(i, i % 6, f"{dims.TAMIL_TITLE_WORDS[0]} {i}", "") for i in range(12)],
                                  "article_id long, source_rank int, title string, summary string")
    flags = lambda df: sorted((r.article_id, r.is_relevant) for r in rec.with_candidate_columns(df).collect())
    assert flags(items) == flags(rec.tag_sources(items, dims.source_profiles(spark)))
