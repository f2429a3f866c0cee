"""Edge cases of the operators on small rows of our own."""

from __future__ import annotations

import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialake.functions import fuzzy, fuzzy_bounds, geometry, shingles, text
from medialake.functions.media import category_from_path, classify_media_type
from medialake.operators import categorize, diff, duplicates, facets, graph, naming, normalize, numbering, providers, sampling, search
from medialake.operators.fuzzy import build_fuzzy_index, fuzzy_candidates, fuzzy_match, scores_computed
from medialake.operators.rank import bm25_rank
from medialake.plans import fixtures, q_search
from medialake.plans.shared import stored
from medialake.sources import files


def values(frame, column=None):
    return [r[column or frame.columns[0]] for r in frame.collect()]


def one(spark, column, **cells):
    frame = spark.createDataFrame([tuple(cells.values())], list(cells)) if cells else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "slug"),
    [("The Cat", "cat"), ("The", "the"), ("", "meme"), ("CON", "con-meme"), ("Ünïcode – dash", "unicode-dash"), ("***", "meme"), ("a " + "word " * 40, "-".join(["word"] * 16))],
)
def test_slugs(spark, given, slug):
    assert one(spark, text.slugify(F.lit(given))) == slug


def test_word_lists_keep_order_and_fall_back(spark):
    words = F.array(*map(F.lit, ["Foo_Bar", "foo bar", " meme ", ""]))
    assert one(spark, text.clean_word_list(words, 10, True)) == ["foo bar"]
    assert one(spark, text.or_default(text.clean_word_list(F.array(F.lit("meme")), 10, True), "uncategorized")) == ["uncategorized"]
    assert one(spark, text.clean_word_list(F.lit(None).cast("array<string>"), 3)) == []


@pytest.mark.parametrize(("given", "name", "error"), [("../x/con.txt", None, "reserved"), ("a<b>.png", "ab.png", None), (" . ", None, "empty"), ("d\\e.gif", "e.gif", None), (None, None, "empty")])
def test_file_names(spark, given, name, error):
    found = one(spark, text.sanitize_filename(F.lit(given).cast("string")))
    assert (found["name"], found["error"]) == (name, error)


def test_media_types_and_path_categories(spark):
    assert one(spark, classify_media_type(F.lit(".WEBP"), F.lit(True))) == "gif"
    assert one(spark, classify_media_type(F.lit(".webp"), F.lit(None).cast("boolean"))) == "image"
    assert one(spark, classify_media_type(F.lit(".MP4"), F.lit(True))) == "video"
    assert one(spark, category_from_path(F.lit("x/07 My Cats/image/03-b.png"))) == "my-cats"
    assert one(spark, category_from_path(F.lit("03-b.png"))) is None


def test_boxes_round_half_to_even_and_never_grow(spark):
    box = one(spark, geometry.fit_within(F.lit(100), F.lit(50), 10**6, 1000))
    assert (box["width"], box["height"]) == (100, 50)
    assert one(spark, geometry.scaled(F.lit(5), F.lit(0.5))) == 2
    assert one(spark, geometry.snap_size(F.lit(240), [160, 320])) == 160


@pytest.mark.parametrize("total", [1, 2, 5, 17])
def test_even_positions_hold_both_ends(spark, total):
    for n in (1, 2, 4, 30):
        found = one(spark, geometry.spread_positions(F.lit(n).cast("long"), F.lit(total).cast("long")))
        wanted = [0] if min(n, total) == 1 else list(dict.fromkeys(round(i * (total - 1) / (min(n, total) - 1)) for i in range(min(n, total))))
        assert found == wanted


SNAPSHOT = "id long, path string, size_bytes long, mtime_ns long, sidecar_mtime_ns long, sha256 string"


@pytest.mark.parametrize(("gone", "new", "moves"), [(2, 3, 2), (1, 1, 1), (2, 1, 1)])
def test_moves_pair_one_to_one(spark, gone, new, moves):
    before = spark.createDataFrame([(k, f"/old{k}", 1, 1, None, "same") for k in range(gone)], SNAPSHOT)
    after = spark.createDataFrame([(100 + k, f"/new{k}", 1, 1, None, "same") for k in range(new)], SNAPSHOT)
    found = diff.diff_snapshot(before, after)
    paired = diff.detect_moves(found)
    assert paired.count() == moves
    following = diff.apply_diff(found, paired)
    ids = values(following.select("id"))
    assert len(set(ids)) == new and set(range(moves)) <= set(ids)


def test_scanning_again_changes_nothing(spark):
    rows = spark.createDataFrame([(k, f"/p{k}", k, 1, None if k % 2 else 5, f"s{k}") for k in range(9)], SNAPSHOT)
    found = diff.diff_snapshot(rows, rows)
    assert set(values(found.select("status"))) == {"unchanged"}
    counts = diff.scan_counts(found, diff.detect_moves(found)).first()
    assert (counts["total"], counts["added"], counts["modified"], counts["removed"], counts["moved"]) == (9, 0, 0, 0, 0)


def test_sidecar_times_compare_nulls(spark):
    before = spark.createDataFrame([(1, "/a", 1, 1, None, "x"), (2, "/b", 1, 1, 4, "y")], SNAPSHOT)
    after = spark.createDataFrame([(1, "/a", 1, 1, 3, "x"), (2, "/b", 1, 1, None, "y")], SNAPSHOT)
    assert set(values(diff.diff_snapshot(before, after).select("status"))) == {"refresh"}


def test_collisions_take_longer_suffixes(spark):
    rows = spark.createDataFrame([("aaaaaabbbbbbcccc", "cat", 1), ("aaaaaabbbbbbdddd", "cat", 2), ("aaaaaaeeeeee", "cat", 3)], "id string, slug string, arrival int")
    held = spark.createDataFrame([("cat", "other")], "stem string, id string")
    stems = dict((r["id"], r["stem"]) for r in naming.resolve_collisions(rows, held).collect())
    assert stems == {"aaaaaabbbbbbcccc": "cat-aaaaaa", "aaaaaabbbbbbdddd": "cat-aaaaaabbbbbb", "aaaaaaeeeeee": "cat-aaaaaaeeeeee"}
    own = spark.createDataFrame([("cat", "aaaaaaeeeeee")], "stem string, id string")
    assert dict((r["id"], r["stem"]) for r in naming.resolve_collisions(rows, own).collect())["aaaaaaeeeeee"] == "cat"


def test_unique_names_pass_over_taken_numbers(spark):
    rows = spark.createDataFrame([(k, "a.png") for k in range(3)], "id int, name string")
    held = spark.createDataFrame([("a.png",), ("a-2.png",)], "name string")
    assert values(naming.unique_names(rows, held).orderBy("id"), "unique_name") == ["a-1.png", "a-3.png", "a-4.png"]


@pytest.mark.parametrize("query", ["x" * 201, " ".join("abcdefghijklm")])
def test_queries_over_the_limits_are_refused(spark, query):
    with pytest.raises(search.QueryTooComplexError):
        search.parse_query(spark, query)


def test_operators_of_a_query_add_to_filters(spark):
    parsed = search.parse_query(spark, "TYPE:GIF,video cat:Src1 is:nsfw is:what kevn a_", search.Filters(type=("image",)))
    assert parsed.filters.type == ("image", "gif", "video") and parsed.filters.category == ("Src1",) and parsed.filters.nsfw == "only"
    assert parsed.long_terms == ("kevn",) and parsed.short_terms == ("a_",)


def test_fuzzy_score_forgives_a_typo():
    assert fuzzy.weighted_ratio("kevn hart", "kevin hart reaction") >= 75
    assert fuzzy.weighted_ratio("", "x") == 0
    assert fuzzy.weighted_ratio("same", "same") == 100
    assert fuzzy.common_length("kitten", "sitting") == 4


def test_bound_of_the_fuzzy_score_loses_nothing():
    draw = random.Random(7)

    def some(most):
        return "".join(draw.choice("abcde  \té\U0001f600") for _ in range(draw.randint(0, most)))

    texts = [some(draw.choice((6, 20, 60))) for _ in range(400)] + ["", "\t", "ab1cd2ef3gh", "a" * 600, "ab" * 300, "a b " * 90]
    cell = fuzzy_bounds.Cell(np.arange(len(texts)), texts, fuzzy_bounds.features(texts), fuzzy_bounds.sizes(texts))
    for query in [some(12) for _ in range(60)] + [some(90) for _ in range(10)] + ["abcdefgh", "", " ", "a" * 500, "ab" * 290]:
        bound, known = cell.bounds(fuzzy_bounds.Query(query))
        score = np.array([fuzzy.weighted_ratio(query, t) for t in texts])
        assert (score <= bound + 1e-9).all() and (score[known] == bound[known]).all()
        for k, cutoff in ((3, 40.0), (10, 75.0), (1000, 0.0)):
            held = []
            assert cell.best(fuzzy_bounds.Query(query), cutoff, k, held) <= len(texts)
            assert sorted((-s, -i) for s, i in held) == sorted((-s, i) for i, s in enumerate(score) if s >= cutoff)[:k]


def test_partial_ratio_skips_no_better_window():
    draw = random.Random(8)
    for _ in range(500):
        a, b = ("".join(draw.choice("abcx") for _ in range(draw.randint(1, n))) for n in (6, 14))
        short, long = sorted((a, b), key=len)
        n = len(short)
        windows = [long[max(0, i) : i + n] for i in range(1 - n, len(long))] + ([] if len(a) != len(b) else [short[max(0, i) : i + n] for i in range(1 - n, n)])
        best = max(max(fuzzy.ratio(x, w) for w in windows) for x in ((short,) if len(a) != len(b) else (short, long)))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(best) or len(a) == len(b) and fuzzy.partial_ratio(a, b) <= best


def test_scores_of_many_texts_are_those_of_each():
    draw = random.Random(10)
    texts = ["".join(draw.choice("abcd  \0é") for _ in range(draw.randint(0, n))) for n in (4, 20, 90) for _ in range(150)]
    for a in texts[::13] + ["ab" * 40]:
        assert fuzzy.partial_ratios(a, texts).tolist() == [fuzzy.partial_ratio(a, b) for b in texts]
        assert fuzzy.weighted_ratios(a, texts).tolist() == pytest.approx([fuzzy.weighted_ratio(a, b) for b in texts], abs=1e-12)
    assert fuzzy.weighted_ratios("a", []).tolist() == []


@pytest.mark.parametrize("cell,block,k,cutoff", [(7, 2, 5, 75.0), (1024, 2048, 1, 60.0), (16, 3, 100, 40.0)])
def test_fuzzy_match_against_all_pairs(spark, monkeypatch, cell, block, k, cutoff):
    monkeypatch.setattr("medialake.operators.fuzzy.CELL", cell)
    monkeypatch.setattr("medialake.operators.fuzzy.QUERIES", block)
    draw = random.Random(9)
    words = ["abcdefgh", "ab1cd2ef3gh", "hart", "kevin", "reaction", "kevn", "harts", "a long title of many words that no query comes near"]
    items = [(i, "-".join(draw.sample(words, 2)), draw.choice([None, "", *words])) for i in range(300)]
    queries = [(0, "kevn hart"), (1, "abcdefgh"), (2, None), (3, "reaktion"), (4, "kevn hart"), (5, "a lnog tilte of words"), (6, "kevin hart")]
    frame = spark.createDataFrame(items, "id long, stem string, title string")
    asked = spark.createDataFrame(queries, "query_id long, q string")
    found = fuzzy_match(frame, asked, cutoff, k).collect()
    wanted = []
    for n, q in queries:
        texts = [(i, f"{stem.replace('-', ' ')} {title}" if title is not None else stem.replace("-", " ")) for i, stem, title in items]
        scored = sorted((-fuzzy.weighted_ratio(q or "", t.strip(" ")), i) for i, t in texts)
        wanted += [(n, r + 1, i, -score) for r, (score, i) in enumerate(x for x in scored[:k] if x[0] <= -cutoff)]
    assert len(wanted) >= 6 and sorted(tuple(r) for r in found) == wanted
    empty = fuzzy_match(frame.limit(0), asked)
    assert empty.count() == 0


def test_few_fuzzy_scores_are_computed(spark):
    """Well below items x queries: lengths, counts and held scores settle the rest."""
    items = fixtures.items(spark, "/root/testdata/sf0.01")
    asked = q_search.typo_log(spark, "/root/testdata/sf0.01")
    cells = stored(build_fuzzy_index(items))
    scored = scores_computed(cells, asked).agg(F.sum("scored")).first()[0]
    assert 0 < scored < 0.15 * items.count() * asked.count()
    first = cells.select(F.explode("ids").alias("id")).groupBy("id").count()
    assert first.count() == items.count() and first.where("count > 1").isEmpty()


def test_common_subsequence_against_a_table():
    draw = random.Random(5)
    for _ in range(200):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 9))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert fuzzy.common_length(a, b) == rows[-1][-1]


def test_pages_of_a_seed_neither_overlap_nor_leave_gaps(spark):
    items = spark.range(50).select("id")
    order = search.sort_order("random", 9)
    pages = [values(search.page(items, order, 20, k).select("id")) for k in (0, 20, 40)]
    assert sorted(sum(pages, [])) == list(range(50)) and pages[0] == values(search.page(items, order, 20, 0).select("id"))
    assert one(spark, search.random_key(F.lit(10**18), 1)) == (10**18 * 2654435761 + 1) % 999999937


def test_ranking_of_no_match_is_empty(spark):
    docs = spark.createDataFrame([(1, "a", "b", "", "", "", "", "")], "id long, name string, title string, description string, ocr_text string, tags string, topics string, category string")
    assert bm25_rank(docs, ("zzz",)).isEmpty()


def test_clusters_are_transitive_and_wider_than_the_limit(spark):
    prints = {"1": "00000000000000ff", "2": "0000000000000fff", "3": "000000000000ffff", "4": "0" * 16, "5": "f" * 16, "6": "00000000000000ff"}
    items = spark.createDataFrame([(int(k), "s1" if k in "16" else f"s{k}", fp) for k, fp in prints.items()], "id long, sha256 string, fp string")
    pairs = duplicates.near_pairs(items, 4)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("00000000000000ff", "0000000000000fff"), ("0000000000000fff", "000000000000ffff")}
    clusters = duplicates.cluster(items, pairs)
    assert sorted(values(clusters.select("id"))) == [1, 2, 3, 6]
    assert duplicates.cluster_diameter(clusters).first()["distance"] == 8
    kinds = sorted(tuple(r) for r in duplicates.duplicate_groups(items, True, 4).collect())
    assert kinds == [("exact", 1, 1, 2, 0), ("exact", 1, 6, 2, 0), *(("near", 1, k, 4, 8) for k in (1, 2, 3, 6))]


def test_crowded_bands_and_clusters_are_met_in_parts(spark, monkeypatch):
    """Small blocks and parts change no pair and no distance."""
    rows = [(k, f"h{k}", f"0123{k * 37 % 256:02x}{k % 11:02x}{k:04x}{k * 7 % 65536:04x}") for k in range(1, 120)]
    items = spark.createDataFrame(rows, "id int, sha256 string, fp string")
    wanted = sorted(map(tuple, duplicates.near_pairs(items, 12).collect()))
    clusters = duplicates.cluster(items, duplicates.near_pairs(items, 12))
    widest = sorted(map(tuple, duplicates.cluster_diameter(clusters).collect()))
    monkeypatch.setattr(duplicates, "BLOCK", 4)
    monkeypatch.setattr(duplicates, "PART", 3)
    monkeypatch.setattr(duplicates, "CROWD", 5)
    monkeypatch.setattr(duplicates, "LEAST_PIECE", 1)
    by_hand = sorted((a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for _, _, a in rows for _, _, b in rows if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 12)
    assert sorted(map(tuple, duplicates.near_pairs(items, 12).collect())) == wanted == by_hand
    assert sorted(map(tuple, duplicates.cluster_diameter(clusters).collect())) == widest


@pytest.mark.parametrize("most", [1, 5, 6, 7])
def test_crowded_bands_lose_no_pair(spark, monkeypatch, most):
    """All four bands crowded, differences anywhere outside them."""
    draw = random.Random(most)
    monkeypatch.setattr(duplicates, "CROWD", 3)
    values = set()
    for _ in range(12):
        base = draw.getrandbits(64)
        band = draw.randrange(4) * 16
        others = [k for k in range(64) if not band <= k < band + 16]
        values |= {base ^ sum(1 << k for k in draw.sample(others, draw.randint(0, 5))) for _ in range(12)}
    prints = sorted(f"{v:016x}" for v in values)
    frame = spark.createDataFrame([(fp,) for fp in prints], "fp string")
    share = lambda a, b: any(a[k : k + 4] == b[k : k + 4] for k in range(0, 16, 4))
    wanted = [(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in prints for b in prints if a < b and share(a, b)]
    assert sorted(map(tuple, duplicates.near_pairs(frame, most).collect())) == [w for w in wanted if w[2] <= most]
    assert sorted(map(tuple, duplicates.band_candidates(frame).collect())) == [w[:2] for w in wanted]


@pytest.mark.parametrize("block", [2048, 5])
def test_diameters_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    monkeypatch.setattr(duplicates, "PART", 2)
    draw = random.Random(block)
    rows, wanted = [], {}
    for spread in (0, 1, 2, 5, 20, 60):
        base = draw.getrandbits(64)
        values = {base ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, spread))) for _ in range(draw.choice([1, 8, 60]))}
        prints = [f"{v:016x}" for v in values]
        rows += [(min(prints), fp) for fp in prints for _ in range(2)]
        wanted[min(prints)] = max((int(a, 16) ^ int(b, 16)).bit_count() for a in prints for b in prints)
    frame = spark.createDataFrame(rows, "cluster string, fp string")
    assert {r["cluster"]: r["distance"] for r in duplicates.cluster_diameter(frame).collect()} == wanted


@pytest.mark.parametrize("bases,share", [(1, 0.0), (3, 0.25)])
def test_few_distances_are_computed_for_a_diameter(spark, bases, share):
    """None where the cluster lies around one point, few where it lies around three."""
    draw = random.Random(6)
    first = draw.getrandbits(64)
    points = [first ^ sum(1 << k for k in draw.sample(range(64), 6 * n)) for n in range(bases)]
    values = list({draw.choice(points) ^ sum(1 << k for k in draw.sample(range(64), draw.choice([1, 2, 2, 3, 3, 3, 8]))) for _ in range(3000)})
    frame = spark.createDataFrame([(f"{min(values):016x}", f"{v:016x}") for v in values], "cluster string, fp string")
    least, doubt = duplicates.diameter_bounds(frame)
    rows = [r.asDict() for r in doubt.collect()]
    found, computed = duplicates.widest(duplicates._columns(rows), duplicates._columns(rows), least.first()["least"])
    bits = np.array(values, np.uint64)
    assert found == max(int(np.bitwise_count(bits[k] ^ bits).max()) for k in range(len(bits)))
    assert computed <= share * len(values) ** 2


def test_text_fingerprints_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "a b c d"), (6, "A  b, C d"), (7, "é ü"), (8, "x " * 9000)]
    found = {r["id"]: r["fp"] for r in duplicates.simhash_text(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    empty = hashlib.md5(b"").hexdigest()[:16]
    assert found[1] == found[2] == found[7] == empty and found[3] == hashlib.md5(b"one").hexdigest()[:16]
    assert found[4] == hashlib.md5(b"one two").hexdigest()[:16] and found[5] == found[6] and found[8] == hashlib.md5(b"x x x").hexdigest()[:16]


@pytest.mark.parametrize("saved,loose", [(20_000, 1000), (7, 2)])
def test_saved_searches_equal_all_pairs(spark, monkeypatch, saved, loose):
    monkeypatch.setattr(facets, "SAVED_BLOCK", saved)
    monkeypatch.setattr(facets, "LOOSE_BLOCK", loose)
    draw = random.Random(12)
    words = ["cat", "at", "dog", "o", "straße", "a.b", "dogcat", "zebra"]
    rows = []
    for k in range(80):
        rows.append((k, f"h{k % 60}", draw.choice(["gif", "image", "video"]), draw.choice(["x", "y", None]), draw.random() < 0.3, draw.choice([None, 1.0, 5.0, 9.0]), f"2024-01-{draw.randint(1, 28):02d} 00:00:00", draw.sample(["t1", "t2", " T3 "], draw.randint(0, 3)), " ".join(draw.choices([*words, "Cat DOG"], k=draw.randint(0, 4)))))
    items = spark.createDataFrame(rows, "id long, sha256 string, media_type string, category_name string, nsfw boolean, duration_s double, created string, tags array<string>, body string").withColumn("created_at", F.col("created").cast("timestamp"))
    docs = items.select("id", F.col("body").alias("name"), *[F.lit("").alias(c) for c in ("title", "description", "ocr_text", "tags", "topics", "category")])
    starred = {f"h{k}" for k in range(0, 60, 4)}
    searches = []
    for k in range(60):
        f = {}
        if draw.random() < 0.4:
            f["type"] = draw.sample(["gif", "image", "no"], draw.randint(0, 2))
        if draw.random() < 0.3:
            f["category"] = draw.choice([["x"], ["x", "y", "x"], []])
        if draw.random() < 0.4:
            f["tag"] = draw.sample(["T1", "t2 ", "t3", "none"], draw.randint(0, 2))
        if draw.random() < 0.3:
            f["favorite"] = draw.random() < 0.7
        if draw.random() < 0.5:
            f["nsfw"] = draw.choice(["only", "include", "exclude", "what"])
        if draw.random() < 0.3:
            f["min_duration"] = 2.0
        if draw.random() < 0.3:
            f["since"] = "2024-01-10 00:00:00"
        searches.append((k, draw.choice([None, "", "CAT", "cat dog", "dog o cat", "a.b", "ZEBRA at", "missing cat", "Straße"]), draw.choice([json.dumps(f), json.dumps(f), None])))
    searches += [(100, *searches[0][1:]), (101, *searches[0][1:])]

    def met(search, item):
        _, query, f = search
        f = json.loads(f or "{}")
        (_, sha, kind, category, nsfw, seconds, since, tags, body) = item
        mode = f.get("nsfw", "exclude")
        own = {t.strip().lower() for t in tags}
        return (
            all(w in body.lower() for w in (query or "").lower().split()) and (not f.get("type") or kind in f["type"]) and (not f.get("category") or category in f["category"])
            and {t.strip().lower() for t in f.get("tag", [])} <= own and (not f.get("favorite") or sha in starred)
            and (nsfw if mode == "only" else mode == "include" or not nsfw) and ("min_duration" not in f or seconds is not None and seconds >= f["min_duration"]) and ("since" not in f or since >= f["since"])
        )

    wanted = sorted((s[0], sum(met(s, i) for i in rows)) for s in searches)
    frame = spark.createDataFrame(searches, "collection_id int, query string, filters_json string")
    found = facets.eval_saved_collections(frame, docs, items, diff.rebuild_item_tags(items), spark.createDataFrame([(s,) for s in starred], "sha256 string"))
    assert sorted(map(tuple, found.collect())) == wanted and sum(n > 0 for _, n in wanted) > 20
    assert facets.eval_saved_collections(frame.limit(0), docs, items, diff.rebuild_item_tags(items), spark.createDataFrame([], "sha256 string")).isEmpty()


def test_providers_in_order(spark):
    """Later providers see what earlier ones gave; one that raises adds nothing."""
    basic = spark.createDataFrame([("a", "t", None), ("b", "u", None)], "path string, title string, tag string")

    def raising(fields):
        raise OSError("no such store")

    chain = [
        providers.Provider("first", lambda fields: fields.where("path = 'a'").select("path", F.lit("x").alias("tag"), F.lit("new").alias("title")), overrides=True),
        providers.Provider("raising", raising),
        providers.Provider("keyless", lambda fields: fields.select("title")),
        providers.Provider("last", lambda fields: fields.select("path", F.concat("title", F.lit("!")).alias("tag"), F.lit(1).alias("seen"))),
    ]
    found = sorted(tuple(r) for r in providers.merge_providers(basic, chain).select("path", "title", "tag", "seen").collect())
    assert found == [("a", "new", "x", 1), ("b", "u", "u!", 1)]


def test_fuzzy_candidates_by_hand(spark):
    """Accented words and copies too: every pair with two common trigrams and at most two edits."""
    left, right = ["étude", "etude", "straße", "thn", "ab"], ["étudé", "etudes", "strasse", "then", "ab", "straßen", "études"]
    grams = lambda w: {w[k : k + 3] for k in range(max(1, len(w) - 2))}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next_row(row, i, x, b)
        return row[-1]

    def _next_row(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    wanted = sorted((a, b, len(grams(a) & grams(b)), edits(a, b)) for a in left for b in right if len(grams(a) & grams(b)) >= 2 and edits(a, b) <= 2)
    frames = [spark.createDataFrame([(w,) for w in words], "word string") for words in (left, right)]
    assert wanted and sorted(tuple(r) for r in fuzzy_candidates(*frames).collect()) == wanted


def test_content_classes_are_rows(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x")], "id long, sha256 string")
    found = {r["id"]: (r["copies"], r["content_class"]) for r in search.item_detail(items, items.where("id < 4")).collect()}
    assert found == {1: (2, 1), 2: (0, 2), 3: (2, 1)}
    assert sorted(map(tuple, search.items_of_content(items, items.where("id = 3")).collect())) == [(1, 1), (1, 3), (1, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r["node"]: r["component"] for r in found.collect()} == {n: root(n) for a, b in edges if a != b for n in (a, b)}


def test_components_without_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def test_numbers_are_consecutive(spark):
    found = numbering.number_rows(spark.range(100).repartition(7), [F.desc("id")])
    assert {r["id"]: r["row_number"] for r in found.collect()} == {k: 99 - k for k in range(100)}


def test_assignment_limits(spark):
    answers = spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.49), (3, 77, 0.9), (4, None, 0.9)], "id long, category_id long, confidence double")
    valid = spark.createDataFrame([(3,), (10,)], "id long")
    found = {r["id"]: (r["category_id"], r["suggested"]) for r in categorize.finalize_assignment(answers, valid, 10).collect()}
    assert found == {1: (3, None), 2: (10, 3), 3: (10, 77), 4: (10, None)}


def test_a_scorer_that_fails_loses_its_batch_only(spark):
    def scorer(rows):
        if (rows["id"] == 5).any():
            raise ValueError("no")
        return rows.assign(score=1.0)

    batched = categorize.make_batches(spark.range(10).select("id"), 4)
    answers, failures = categorize.score_batches(batched, scorer, "id long, score double")
    assert sorted(values(answers.select("id"))) == [0, 1, 2, 3, 8, 9]
    assert [(r["batch"], r["error"]) for r in failures.collect()] == [(1, "ValueError: no")]


def test_unknown_ocr_mode(spark):
    with pytest.raises(ValueError):
        categorize.merge_ocr(spark.range(1), "sometimes")


def test_favourites_keep_the_first_time_after_the_last_clearing(spark):
    log = spark.createDataFrame([("a", True, 1, 1), ("a", True, 2, 2), ("b", True, 1, 3), ("b", False, 2, 4), ("c", False, 1, 5), ("c", True, 2, 6), ("c", True, 3, 7)], "sha256 string, favorite boolean, at int, event_id int")
    assert {r["sha256"]: r["created_at"] for r in facets.favorites_state(log).collect()} == {"a": 1, "c": 2}


def test_clipping_strips_after_the_cut(spark):
    rows = spark.createDataFrame([("abc  def", ["a", "b", "c"])], "title string, tags array<string>")
    done = normalize.clip_to_limits(rows, {"title": 5}, {"tags": 2}).first()
    assert (done["title"], done["tags"]) == ("abc", ["a", "b"])


def test_budget_scales_all_members(spark):
    rows = spark.createDataFrame([(1, 100, 100), (1, 100, 100), (2, 10, 10)], "g int, width long, height long")
    assert sorted((r["g"], r["width"]) for r in sampling.scale_to_budget(rows, "g", 5000).collect()) == [(1, 50), (1, 50), (2, 10)]


def _png(path, pixels):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + bytes(row) for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_files_sidecars_and_images(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "node_modules").mkdir()
    _png(tmp_path / "falling name.PNG", [[255 - 20 * x for x in range(9)] for _ in range(8)])
    _png(tmp_path / ".hidden" / "x.png", [[0]])
    _png(tmp_path / "node_modules" / "y.png", [[0]])
    (tmp_path / "good one.json").write_text('{"schema_version": 2, "id": "abc", "analysis": {"title": "t", "tags": ["x"]}}')
    (tmp_path / "cut.json").write_text('{"schema_version": 2, "id": "ab')
    (tmp_path / "categories.json").write_text('{"categories": [{"id": 1, "name": "cats", "folder": "01-cats"}]}')
    root = str(tmp_path)
    found = files.scan_files(spark, root, (".png",), content=True)
    assert [p.rsplit("/", 1)[1] for p in values(found.select("path"))] == ["falling name.PNG"]
    assert len(files.with_sha256(found).first()["sha256"]) == 64
    good, bad = files.read_sidecars(spark, root)
    assert [(r["id"], r["path"].rsplit("/", 1)[1]) for r in good.collect()] == [("abc", "good one.json")]
    assert [p.rsplit("/", 1)[1] for p in values(bad.select("path"))] == ["cut.json"]
    assert values(files.read_category_registry(spark, f"{root}/categories.json").select("name")) == ["cats"]
    assert files.read_category_registry(spark, f"{root}/absent.json").isEmpty()
    image = spark.read.format("image").load(f"{root}/falling name.PNG")
    assert values(duplicates.dhash_images(image), "fp") == ["f" * 16]


def test_many_sidecars_share_splits_and_an_empty_one_is_unreadable(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"s{k:03d}.json").write_text(f'{{"schema_version": 2, "id": "{k}"}}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "list.json").write_text("[1, 2]")
    (tmp_path / "mark.json").write_bytes(b'\xef\xbb\xbf{"id": "mark"}')
    good, bad = files.read_sidecars(spark, str(tmp_path))
    assert sorted(values(good.select("id"))) == sorted([*map(str, range(200)), "mark"])
    assert sorted((r["path"].rsplit("/", 1)[1], r["text"]) for r in bad.collect()) == [("empty.json", ""), ("list.json", "[1, 2]")]
    assert good.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_fingerprints_of_many_texts_equal_those_by_hand():
    rng = random.Random(3)
    texts = ["", " ", "a", "a b", "a b c a b c", "é", "x" * 55 + " y", "x" * 56, "a\nb\tc_d 9"] + [" ".join(rng.choice(["w" * rng.randint(1, 30), "é,", "_"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]

    def by_hand(text):
        words = re.findall(r"\w+", text, re.ASCII)
        runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        hashes = [int(hashlib.md5(r.encode()).hexdigest()[:16], 16) for r in runs]
        return f"{sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64)):016x}"

    assert [bytes(p).hex() for p in shingles.text_prints(texts)] == [by_hand(t) for t in texts]


def test_batches_are_scored_once_across_parts(spark):
    """Batches that lie over the ends of Arrow parts stay whole, values keep their type beside others', and no batch is scored twice."""
    calls = spark.sparkContext.accumulator(0)
    big = 1 << 60

    def scorer(rows):
        calls.add(1)
        if (rows["id"] == big + 5).any():
            raise ValueError("no")
        assert list(rows.index) == list(range(len(rows)))
        return rows.assign(n=len(rows), score=[None] * len(rows) if rows["id"].min() % 3 else 1)

    batched = categorize.make_batches(spark.range(big, big + 100).select("id"), 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        answers, failures = categorize.score_batches(batched, scorer, "id long, n long, score long", attempts=1)
        found = {r["id"]: (r["n"], r["batch"]) for r in answers.collect()}
        assert [(r["batch"], r["error"]) for r in failures.collect()] == [(0, "ValueError: no")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {big + k: (2 if k >= 98 else 7, k // 7) for k in range(7, 100)}
    assert calls.value == 15


def test_slugs_are_made_of_distinct_hints_only(spark):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        made.add(len(texts))
        return texts

    files_ = spark.range(500).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("Cats "), (F.col("id") % 2).cast("string"), F.lit("/x"))).otherwise("x").alias("rel_path"))
    registry = spark.createDataFrame([(3, "cats 0", "03-cats-0"), (4, "Other", None)], "id long, name string, folder string")
    usual = text.slugify
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(categorize, "slugify", lambda c, most, articles: usual(c, most, articles, counted))
        found = {(r["hint"], r["slug"], r["category_id"]) for r in categorize.resolve_hints(files_, registry).collect()}
    assert found == {("Cats 0", "cats-0", 3), ("Cats 1", "cats-1", None), (None, None, None)}
    assert made.value <= 10


def test_whole_ratio_is_taken_only_where_it_may_be_the_best(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for query in ("abc cab", "a", "bcabca cc abacab", ""):
        assert fuzzy.weighted_ratios(query, texts).tolist() == [fuzzy.weighted_ratio(query, t) for t in texts]
    calls = []
    monkeypatch.setattr(fuzzy, "common_length", lambda a, b: calls.append(b) or 0)
    fuzzy.weighted_ratios("abcd", ["zz abcd " + "y" * 40] * 50)
    assert calls == []
