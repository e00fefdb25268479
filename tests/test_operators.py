"""Operators against plain Python on small and random inputs."""

import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine.functions import media, text, urls
from vitrine.operators import curation, events, layout, ranking, recsys, search, taxonomy, vectors, views
from vitrine.plans.paging import clamp_page


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)), f"k int, {schema}").orderBy("k").select(column).collect()]


@pytest.mark.parametrize("page,size,kind,want", [(0, 0, "feed", (0, 1)), (-1, 61, "feed", (0, 60)), (3, 20, "comments", (40, 20)), (2, 300, "author", (200, 200)), (10**9, 60, "feed", ((10**9 - 1) * 60, 60))])
def test_pages(page, size, kind, want):
    assert tuple(clamp_page(page, size, kind)) == want


def test_clamped_score_is_the_fold(spark):
    rng, log, want = random.Random(3), [], {}
    for image in range(40):
        score = Decimal("0.5")
        for k in range(rng.randint(1, 60)):
            delta = Decimal(rng.choice(["0.08", "1.2", "-1.6", "-2.2", "1.3"]))
            score = max(Decimal(0), score + delta)
            log.append((image, f"2024-01-{1 + k // 7:02d} 00:00:{k % 7:02d}", k, delta))
        want[image] = score
    rng.shuffle(log)
    frame = spark.createDataFrame(log, "image_id long, t string, id long, delta decimal(12,4)").withColumn("ts", F.to_timestamp_ntz("t"))
    assert {r["image_id"]: r["hot_score"] for r in events.clamped_score(frame, "0.5").collect()} == want


def test_toggles_and_follows(spark):
    log = spark.createDataFrame([(k, f"2024-01-01 00:00:0{k}", 1, "LIKE", 5) for k in range(3)] + [(9, "2024-01-01 00:00:00", 2, "LIKE", 5), (10, "2024-01-01 00:00:01", 2, "LIKE", 5)], "id long, t string, user_id long, kind string, image_id long").withColumn("ts", F.to_timestamp_ntz("t"))
    assert {r["user_id"]: r["active"] for r in events.toggle_state(log).collect()} == {1: True, 2: False}
    assert [r["active"] for r in events.toggles(log).filter("user_id = 1").orderBy("id").collect()] == [True, False, True]
    steps = [(1, 1, 2, "follow", "a"), (2, 1, 2, "follow", "b"), (3, 1, 2, "unfollow", ""), (4, 1, 2, "follow", "c"), (5, 1, 2, "follow", "d"), (6, 3, 2, "unfollow", ""), (7, 4, 2, "follow", "e"), (8, 4, 2, "unfollow", "")]
    follows = spark.createDataFrame([(k, f"2024-01-01 00:00:0{k}", *x) for k, *x in steps], "id long, t string, follower long, followee long, action string, scene string").withColumn("ts", F.to_timestamp_ntz("t"))
    assert [tuple(r)[:2] + (r["scene"],) for r in events.follow_state(follows).collect()] == [(1, 2, "c")]


def fold_candidates(rows):
    held = {}
    for seq, key, score, url, detail, fallbacks in rows:
        if key not in held:
            held[key] = [seq, score, url, detail, list(fallbacks)]
            continue
        first, best, old, old_detail, fb = held[key]
        if score > best:
            merged = [x for x in dict.fromkeys([old, *fb, *fallbacks]) if x.strip()]
            held[key] = [first, score, url, detail, merged]
        elif not old_detail and detail:
            held[key][3] = detail
    return {k: (v[0], v[2], v[3], v[4]) for k, v in held.items()}


@pytest.mark.parametrize("places", [curation.PART_PLACES, 7])
def test_merge_candidates_is_the_fold(spark, monkeypatch, places):
    monkeypatch.setattr(curation, "PART_PLACES", places)
    rng, rows = random.Random(5), []
    for seq in range(400):
        rows.append((seq, f"k{rng.choice([0, rng.randint(0, 60)])}", rng.randint(0, 9), f"u{seq}", rng.choice(["", f"d{seq}"]), [f"f{rng.randint(0, 5)}" for _ in range(rng.randint(0, 2))]))
    frame = spark.createDataFrame(rows, "seq long, key string, score long, url string, detail_url string, fallbacks array<string>").repartition(3)
    got = {r["key"]: (r["first_seq"], r["url"], r["detail_url"], r["fallbacks"]) for r in curation.merge_candidates(frame).collect()}
    assert got == fold_candidates(rows)
    assert [r["first_seq"] for r in curation.merge_candidates(frame, 5).collect()] == sorted(v[0] for v in got.values())[:5]


def test_ratio_labels(spark):
    sizes = [(1920, 1080), (8, 256), (50, 6400), (29, 160), (0, 5), (None, 3), (1836311903, 1134903170), (3, 3)]
    got = values(spark, sizes, "s struct<w:long,h:long>", media.ratio_label(F.col("s.w"), F.col("s.h")))
    assert got == ["16:9", "1:32", "0.0078:1", "0.1813:1", None, None, "1.618:1", "1:1"]
    for (w, h), label in zip(sizes, got, strict=True):
        if label and "." not in label:
            assert label == f"{w // math.gcd(w, h)}:{h // math.gcd(w, h)}"


def test_ratio_labels_of_the_longest_divisions(spark):
    fibonacci = [1, 1]
    while fibonacci[-1] < 2**61:
        fibonacci.append(sum(fibonacci[-2:]))
    pairs = list(zip(fibonacci, fibonacci[1:], strict=False))
    sizes = [(16, 26), (178, 288), *pairs, *((b, a) for a, b in pairs)]
    assert values(spark, sizes, "s struct<w:long,h:long>", media.gcd(F.col("s.w"), F.col("s.h"))) == [math.gcd(*s) for s in sizes]
    assert values(spark, [(8, 13), (89, 144), (144, 89)], "s struct<w:long,h:long>", media.ratio_label(F.col("s.w"), F.col("s.h"))) == ["8:13", "0.6181:1", "1.618:1"]


def test_names(spark):
    raw = ["  ##a b ", "#", "", None, "C++", "café", "图"]
    assert values(spark, [(r,) for r in raw], "s struct<v:string>", text.normalize_topic(F.col("s.v"))) == ["ab", "", "", None, "C++", "café", "图"]
    assert values(spark, [(r,) for r in raw], "s struct<v:string>", text.normalize_tag(F.col("s.v")))[:2] == ["a b", ""]
    slugs = values(spark, [(r,) for r in raw], "s struct<v:string>", text.slug(F.col("s.v")))
    assert slugs[0] == "a-b" and slugs[4:6] == ["c", "cafe"] and slugs[6].startswith("key-")
    assert values(spark, [(["b", "a", " ", "b"], ["c", "a"])], "s struct<x:array<string>,y:array<string>>", text.ordered_union(F.col("s.x"), F.col("s.y"))) == [["b", "a", "c"]]
    assert values(spark, [(["#a", "a", "#a", " ", "##b"],)], "s struct<x:array<string>>", text.clean_topics(F.col("s.x"))) == [["a", "a", "b"]]
    assert values(spark, [("3.9",), ("-3.9",), ("x",), (None,), (" 7 ",), ("3000000000.5",), ("1e30",), ("inf",)], "s struct<v:string>", text.tolerant_int(F.col("s.v"))) == [3, -3, None, None, 7, 3_000_000_000, None, None]
    assert values(spark, [(0,), (999,), (1000,), (1250,), (99_999,), (100_000,), (None,), (-4,)], "s struct<v:long>", text.count_text(F.col("s.v"))) == ["0", "999", "1k", "1.3k", "10.0万", "10万", "0", "0"]


def test_urls(spark):
    cases = {"//a.b/c": "https://a.b/c", "'http:\\/\\/a.b\\u002Fc%20d'": "http://a.b/c d", "http://a.b/c;p?q=1#f": "http://a.b/c?q=1", "ftp://a": "", "http://a.b/x.,;]": "http://a.b/x", "http://a.b/?x=1&amp;y=2": "http://a.b/?x=1&y=2", None: ""}
    assert values(spark, [(k,) for k in cases], "s struct<v:string>", urls.normalize_url(F.col("s.v"))) == list(cases.values())
    assert urls.normalized("/x", "https://h/y/z") == "https://h/x"
    originals = {"https://i.h.com/236x/a/b/c.jpg": "https://i.h.com/originals/a/b/c.jpg", "https://i.h.com/control1/236x/a/b/c.jpg?x": "https://i.h.com/originals/a/b/c.jpg", "https://i.h.com/236x/a/c.jpg": "", "https://other/236x/a/b/c.jpg": "", "https://i.h.com/originals/a/b/c.jpg?y": "https://i.h.com/originals/a/b/c.jpg"}
    assert values(spark, [(k,) for k in originals], "s struct<v:string>", urls.original_url(F.col("s.v"), "h.com")) == list(originals.values())
    assert values(spark, [("https://h/236x/a.jpg",), ("https://h/originals/a/b.gif",), ("https://h/x600/75x80/q.webp?z",), ("nothing",)], "s struct<v:string>", urls.quality_score(F.col("s.v"))) == [246, 1_000_000, 690, 0]
    assert values(spark, [("a.jpg 1x,  b.jpg 2x , ,c.jpg",)], "s struct<v:string>", urls.srcset(F.col("s.v"))) == [["a.jpg", "b.jpg", "c.jpg"]]


def test_annotations(spark):
    many = json.dumps({"tags": [{"type": "", "name": "x"}] + [{"type": "t", "name": f"n{k}"} for k in range(30)], "categoryPath": ["#a", " b ", "", "c", "d", "e"]})
    odd = json.dumps({"description": "#d", "categories": "x > y/z", "tags": [{"type": "t", "label": "l", "confidence": c} for c in ("0.9", "NaN", -1, 2, None, "x")]})
    got = values(spark, [(many,), (f"```json\n{odd}\n```",), (f"see {odd} ok",), ("[1]",), ("no",), (None,)], "s struct<v:string>", taxonomy.normalized_annotation(F.col("s.v")))
    assert len(got[0]["tags"]) == 23 and got[0]["path"] == ["a", "b", "c", "d"]
    assert got[1] == got[2] and got[1]["description"] == "d" and got[1]["path"] == ["x", "y", "z"]
    assert [t["confidence"] for t in got[1]["tags"]] == [0.9, 1.0, 0.0, 1.0, 0.8, 0.8]
    assert got[3:] == [None, None, None]


def test_category_tree_with_orphan_and_cycle(spark):
    rows = [(1, "a", None, 2), (2, "b", None, None), (3, "c", 1, 0), (4, "d", 99, 0), (5, "e", 6, 0), (6, "f", 5, 0)]
    tree = views.category_tree(spark.createDataFrame(rows, "id long, name string, parent_id long, sort_no int")).orderBy("sort_path").collect()
    assert [(r["id"], r["depth"]) for r in tree] == [(2, 0), (4, 0), (1, 0), (3, 1)]


def test_rules_at_the_edge(spark):
    path = lambda p: json.dumps({"description": "d", "categoryPath": p, "tags": []})
    paths = values(spark, [path(["#", "a", "b", "c", "d"]), path(" a > #b / c"), path(["", " ", "a", "b", "c", "d", "e"])], "t string", taxonomy.normalized_annotation(F.col("t"))["path"])
    assert paths == [["a", "b", "c"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    assert len(set(values(spark, ["图", "#图", " ##图"], "s string", text.slug(F.col("s"))))) == 1
    hosts = ["http://img.h.com/a.jpg", "http://IMG.h.com:80/a.jpg", "http://notimg.h.com/a.jpg", "http://img.h.com.x/a.jpg"]
    assert values(spark, hosts, "s string", urls.allowed_image(F.col("s"), "img.h.com")) == [True, True, False, False]


def brute_tree(rows):
    """(id, depth, names) depth first, by walking from the roots."""
    ids, below = {r[0] for r in rows}, {}
    for i, name, parent, sort_no in rows:
        below.setdefault(parent if parent in ids else None, []).append((sort_no or 0, i, name))
    out, todo = [], [(c, 0, []) for c in sorted(below.get(None, []), reverse=True)]
    while todo:
        (_, i, name), depth, names = todo.pop()
        out.append((i, depth, " > ".join([*names, name])))
        todo += [(c, depth + 1, [*names, name]) for c in sorted(below.get(i, []), reverse=True)]
    return out


def test_category_tree_by_brute_force(spark):
    rng = random.Random(6)
    for n in (1, 12, 300):
        rows = [(k, f"n{k}", rng.choice([None, rng.randrange(n), max(0, k - 1), 10**6]), rng.choice([None, -7, 0, 3, 10_000_000, 1_500_000])) for k in range(n)]
        tree = views.category_tree(spark.createDataFrame(rows, "id long, name string, parent_id long, sort_no int")).orderBy("sort_path").collect()
        assert [(r["id"], r["depth"], r["path"]) for r in tree] == brute_tree(rows)
    empty = spark.createDataFrame([], "id long, name string, parent_id long, sort_no int")
    assert views.category_tree(empty).count() == 0


def test_category_tree_of_many_levels_and_children(spark):
    chain = spark.range(3000).selectExpr("id", "'c' AS name", "nullif(id - 1, -1) AS parent_id", "-id AS sort_no")
    wide = spark.range(10_000, 210_000).selectExpr("id", "'w' AS name", "5L AS parent_id", "id AS sort_no")
    tree = views.category_tree(chain.unionByName(wide))
    n, depth, total = tree.agg(F.count("id"), F.max("depth"), F.sum("depth")).first()
    assert (n, depth, total) == (203_000, 2999, 2999 * 1500 + 200_000 * 6)


def test_grid():
    assert layout.grid(1000.0) == (4, 242.5) and layout.grid(100.0) == (1, 100.0) and layout.grid(99_999.0)[0] == 12


def test_masonry(spark):
    rng = random.Random(2)
    cards = [(p, k, p * 100 + k, rng.choice([0.3, 1.0, 1.4])) for p in range(3) for k in range(25)]
    got = layout.pack(spark.createDataFrame(cards, "page int, place int, id long, ratio double"), 200.0, [0.0, 50.0, 0.0]).collect()
    want = {}
    for p in range(3):
        heights = [0.0, 50.0, 0.0]
        for _, _, i, ratio in (c for c in cards if c[0] == p):
            c = heights.index(min(heights))
            want[i] = (c, heights[c])
            heights[c] += max(136.0, 200.0 * ratio) + 10.0
    assert {r["id"]: (r["column"], r["y"]) for r in got} == want


def test_search_modes(spark):
    rows = spark.createDataFrame([(1, "Café 100%"), (2, "cafe"), (3, None), (4, "a_b")], "id long, name string")
    ids = lambda f: sorted(r["id"] for r in f.collect())
    assert ids(search.matching(rows, ["name"], "CAFE")) == [1, 2]
    assert ids(search.matching(rows, ["name"], "%")) == [1]
    assert ids(search.matching(rows, ["name"], "%", wildcards=True)) == [1, 2, 4]
    assert ids(search.matching(rows, ["name"], "A_B", wildcards=True)) == [4]


def test_rounds_ids_and_mix(spark):
    rounds = spark.createDataFrame([("p", k, n) for k, n in enumerate([1, 2, 2, 2, 2, 2, 3])] + [("q", k, k) for k in range(1, 9)] + [("z", k, 0) for k in range(5)], "page string, round int, n int")
    assert {r["page"]: r["round"] for r in curation.settled_round(rounds).collect()} == {"p": 5, "z": 3}
    ids = taxonomy.assign_ids(spark.createDataFrame([(7, "b")], "id long, name string"), spark.createDataFrame([("c",), ("a",), ("b",), ("a",), (None,)], "name string"), "name")
    assert sorted(map(tuple, ids.collect())) == [(8, "a"), (9, "c")]
    channel = lambda *x: spark.createDataFrame(list(x), "id long, place int")
    mixed = recsys.mix_channels({"a": channel((1, 1), (2, 2)), "b": channel((2, 1), (3, 2))}, spark.createDataFrame([(3,)], "id long"), 10)
    assert [(r["id"], r["channel"]) for r in mixed.orderBy("slot").collect()] == [(1, "a"), (2, "b")]


def test_nearest_of_each_query_is_nearest_of_one(spark):
    rows = [(k, [float(k % 7 - 3), float(k % 5), float(k % 3 - 1)]) for k in range(1, 60)] + [(60, [0.0, 0.0, 0.0])]  # ties, no id 0
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = vectors.nearest_each(table, table.filter("vec_id % 20 = 0"), 4, tile=8).collect()
    for q in (20, 40, 60):
        want = vectors.nearest_each(table, table.filter(f"vec_id = {q}"), 4).collect()
        assert sorted((-r["cosine"], r["vec_id"]) for r in got if r["query_id"] == q) == sorted((-r["cosine"], r["vec_id"]) for r in want)
    assert len(got) == 12


def test_plans_stay_native(spark, data):
    from vitrine.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("feed_page_n") or "TakeOrdered" in plan("similar_by_id")
    assert "WindowGroupLimit" in plan("author_topk_all")
    in_python = {"vector_topk", "vector_topk_all", "vector_topk_where", "vector_topk_index", "slugify", "slug_collisions", "url_normalize", "url_escapes", "text_clean", "topic_and_tag_slugs", "detail_urls", "srcset_parse", "dom_candidates", "category_paths", "frontier_bfs"}
    for name in set(QUERIES) - in_python:
        assert "Python" not in plan(name) and "Pandas" not in plan(name), name
    assert "EqualTo(o_orderstatus,F)" in plan("feed_total") or "PushedFilters" in plan("feed_total")


def test_an_answer_is_parsed_once(spark, data):
    from vitrine.queries import QUERIES

    plan = QUERIES["annotation_normalize"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(description") == 1 and plan.count("get_json_object") <= 2, plan


def test_numbers_without_gaps(spark):
    """A third of the names with one beginning: numbers are dense and in order, whatever the ranges."""
    rng = random.Random(4)
    names = sorted({f"Same prefix {rng.random()}" if rng.random() < 0.4 else str(rng.random()) for _ in range(500)})
    frame = spark.createDataFrame([(n,) for n in rng.sample(names, len(names))], "name string").repartition(5)
    got = taxonomy.numbered(frame, "name").collect()
    assert {r["name"]: r["n"] for r in got} == {n: k + 1 for k, n in enumerate(names)}


def test_paths_of_categories(spark):
    known = spark.createDataFrame([(5, "a", None), (6, "b", 5), (9, "a", None)], "id long, name string, parent_id long").withColumns({"slug": F.lit("s"), "sort_no": F.lit(0)})
    asked = [["#a", "b", "a", "c"], ["a", "d"], ["x"], [" ", "#"], None, ["x", "b"], ["a", "b"]]
    rows = taxonomy.ensure_paths(known, spark.createDataFrame([(p,) for p in asked], "path array<string>")).collect()
    assert sorted((r["id"], r["name"], r["parent_id"], r["slug"], r["sort_no"]) for r in rows if r["name"] != "x") == [(11, "d", 5, "a-d", 10), (12, "b", 10, "x-b", 10), (13, "c", 6, "a-b-c", 20)]
    assert [(r["id"], r["parent_id"], r["slug"]) for r in rows if r["name"] == "x"] == [(10, None, "x")]
    paths = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b"]), (4, []), (5, ["a", "z", "b"])], "id long, path array<string>")
    assert {r["id"]: r["category_id"] for r in taxonomy.category_of_path(known, paths).collect()} == {1: 6, 2: 5, 3: None, 4: None, 5: None}


def test_hashes_and_slugs(spark):
    assert text.utf16_hash("polygenelubricants") == -(1 << 31) and text.utf16_hash("") == 0 and text.utf16_hash("\U0001f600") == 31 * 0xD83D + 0xDE00
    raw = ["Café au lait!", "图", "polygenelubricants", None, "-"]
    got = values(spark, [(r,) for r in raw], "s struct<v:string>", text.topic_slug(F.col("s.v")))
    assert got == ["cafe-au-lait", f"topic-{ord('图')}", "polygenelubricants", "topic-0", "topic-45"]


def test_detail_grid():
    assert layout.detail_grid(1440.0) == (5, (1378.0 - 40) / 5, 3) and layout.detail_grid(300.0) == (1, 260.0, 1)
    assert layout.detail_grid(9999.0)[::2] == (24, 5) and layout.detail_grid(800.0)[::2] == (3, 2)


def test_lookups(spark):
    rows = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "a", 5)], "id long, name string, parent_id long")
    assert [r["id"] for r in views.lookup(rows, name="a", parent_id=None).collect()] == [1]
    assert [r["id"] for r in views.lookup(rows, name="a", parent_id=5).collect()] == [2] and views.lookup(rows, name="b").count() == 0
    asked = spark.createDataFrame([("a", None, 1), ("a", 6, 2), (None, None, 3)], "name string, parent_id long, k int")
    assert {r["k"]: r["id"] for r in views.lookup_each(asked, rows, ["name", "parent_id"]).collect()} == {1: 1, 2: None, 3: None}


def test_images_of_a_page(spark):
    html = '<a name="n"><a href="/pin/1/"><IMG SRC=/x.jpg alt></a></a><img src="y.jpg"><source srcset="s.jpg"><source><link as=image imagesrcset="z 1x"><a href="/q"><img'
    rows = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(curation.dom_images(F.col("html")).alias("x")).collect()
    assert [tuple(i) for i in rows[0]["x"]] == [("img", "/x.jpg", "", "", None, None, "/pin/1/"), ("img", "y.jpg", "", "", None, None, ""), ("source", "", "s.jpg", "", None, None, ""), ("link", "", "z 1x", "", None, None, "")]
    assert [r["x"] for r in rows[1:]] == [[], []]


def test_resolved_links_are_those_of_the_standard(spark):
    from urllib.parse import urljoin

    base = "https://h.com/a/b/c?x#y"
    hrefs = ["d", "./d", "../d", "../../../d", "/d/./e/../f", "?q=1", "//o.com/p", "HTTP://o.com/", "d?../x", "../", ".", ".."]
    got = values(spark, [(h,) for h in hrefs], "s struct<v:string>", urls.resolved(F.col("s.v"), F.lit(base)))
    assert [g.lower() for g in got] == [urljoin(base, h).lower() for h in hrefs]
    assert values(spark, [("mailto:a",), ("#x",), (None,), ("",)], "s struct<v:string>", urls.resolved(F.col("s.v"), F.lit(base))) == [None] * 4


def test_start_urls(spark):
    cases = {" a.b": "https://a.b/", "//a.b/c": "https://a.b/c", "HTTP://a.b?q#f": "http://a.b/?q", "https://a.b/c;p/d;e?q=1": "https://a.b/c;p/d?q=1", "ftp://a.b": "", "  ": "", "http://": "", None: ""}
    assert values(spark, [(k,) for k in cases], "s struct<v:string>", F.coalesce(urls.start_url(F.col("s.v")), F.lit(""))) == list(cases.values())


def test_channels(spark):
    images = spark.createDataFrame([(k, float(k % 3)) for k in range(1, 8)], "id long, hot_score double")
    tagged = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 2), (4, 9)], "image_id long, tag_id long")
    liked = spark.createDataFrame([(1,)], "id long")
    assert [tuple(r) for r in recsys.same_tags(images, tagged, liked, 5).orderBy("place").collect()] == [(2, 1), (3, 2)]
    log = spark.createDataFrame([(1, 1, 4), (2, 2, 3)], "ts long, id long, image_id long")
    assert [r["id"] for r in recsys.like_the_last(images, log, 3).orderBy("place").collect()] == [2, 4, 5]
    weights = spark.createDataFrame([(1, 2.0), (4, 5.0)], "image_id long, delta double")
    bound = spark.createDataFrame([(1, 7), (2, 7), (4, 8), (5, 8), (5, 7)], "image_id long, topic_id long")
    assert [r["id"] for r in recsys.by_interest(images, bound, weights, 3).orderBy("place").collect()] == [5, 4, 1]


def test_top_per_author(spark):
    rows = spark.createDataFrame([(k, k % 2, f"2024-01-0{1 + k // 2}") for k in range(8)], "id long, author_id long, published_at string")
    assert sorted((r["author_id"], r["id"]) for r in ranking.top_per_author(rows, 2).collect()) == [(0, 4), (0, 6), (1, 5), (1, 7)]


def test_more_urls(spark):
    pages = ["https://WWW.p.com/item/12/", "https://p.com/item/x", "https://q.com/item/12", None]
    assert values(spark, [(p,) for p in pages], "s struct<v:string>", urls.detail_url(F.coalesce(F.col("s.v"), F.lit("")), "p.com", "item")) == ["https://www.p.com/item/12/", "", "", ""]
    assets = ["https://i.h.com/75x75_RS/a.jpg", "https://i.h.com/a/200x40/b.jpg", "https://i.h.com/Avatars/b.png", "https://i.h.com/", "https://i.h.com/x/y/z.gif", "ftp://i.h.com/a.jpg", "https://o.com/a.PNG?x"]
    assert values(spark, [(p,) for p in assets], "s struct<v:string>", urls.small_asset(F.col("s.v"))) == [True, False, True, True, False, False, False]
    assert values(spark, [(p,) for p in assets], "s struct<v:string>", urls.allowed_image(F.col("s.v"), "h.com")) == [False, True, False, False, True, False, False]
    assert values(spark, [(p,) for p in assets], "s struct<v:string>", urls.allowed_image(F.col("s.v")))[-2:] == [False, True]
    assert values(spark, [(None, "", "b"), (None, None, None)], "s struct<a:string,b:string,c:string>", urls.first_address(F.col("s.a"), F.col("s.b"), F.col("s.c"))) == ["b", ""]
    assert values(spark, [(" a &amp;\0 b\n\tc ",), (None,)], "s struct<v:string>", text.clean_text(F.col("s.v"), 7)) == ["a & b c"[:7], ""]


def test_page_images_and_new_keys(spark):
    html = '<img alt="x" src="/a.jpg" srcset="/b.jpg 1x, /a.jpg 2x"><source srcset="/c.webp"><link rel=preload as="image" href="/d.png"><link href="/e.css"><p>'
    got = curation.page_images(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [(r["kind"], r["url"], r["alt"]) for r in got] == [("img", "/a.jpg", "x"), ("img", "/b.jpg", "x"), ("source", "/c.webp", ""), ("link", "/d.png", "")]
    key = lambda *x: spark.createDataFrame([(k,) for k in x], "key string")
    assert curation.new_keys(key("a", "b", "b"), key("a")).first()["added"] == 1


def test_profiles_and_checks(spark):
    changes = spark.createDataFrame([(1, 1, 1, "a", None), (1, 2, 2, None, "x"), (1, 3, 3, "b", None), (2, 1, 4, None, None)], "user_id long, ts long, id long, nickname string, bio string")
    assert {r["user_id"]: (r["nickname"], r["bio"]) for r in events.profiles(changes, ["nickname", "bio"]).collect()} == {1: ("b", "x"), 2: (None, None)}
    rows = spark.createDataFrame([("ok", "t"), (" ", "t"), ("ok", "t" * 6), (None, "t")], "title string, content string")
    assert [r["fault"] for r in events.checked(rows, {"title": 5, "content": 5}).collect()] == [None, "title", "content", "title"]


def test_ranked_and_dealt(spark):
    items = spark.createDataFrame([(1, "2024-01-08 00:00:00", 0.0), (2, "2024-01-01 00:00:00", 1.0), (3, "2024-01-08 00:00:00", None)], "id long, published_at string, quality double")
    got = recsys.ranked(items, {"freshness": 1.0, "quality": 0.4}, "2024-01-08 00:00:00").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.9)]
    cards = spark.createDataFrame([(0, k, k, 1.0) for k in range(4)], "page int, place int, id long, ratio double")
    assert [r["column"] for r in layout.pack(cards, 1.0, [0.0, 0.0], 0.4, 0.0).orderBy("place").collect()] == [0, 1, 0, 1]


def test_media_names(spark):
    names = ["a.JPG", "b.webp", "c", ".hidden", " d.x.png"]
    assert values(spark, [(n,) for n in names], "s struct<v:string>", media.content_type(F.col("s.v"))) == ["image/jpeg", "image/webp", "application/octet-stream", "application/octet-stream", "image/png"]
    assert values(spark, [(n,) for n in names], "s struct<v:string>", media.title_of(F.col("s.v"))) == ["a", "b", "c", ".hidden", "d.x"]
    assert values(spark, [("2024-03-05", "0123456789abcdef0123456789")], "s struct<d:string,h:string>", media.object_key(F.to_date("s.d"), F.col("s.h"), F.lit(".png"))) == ["originals/2024/03/05/0123456789abcdef0123.png"]
