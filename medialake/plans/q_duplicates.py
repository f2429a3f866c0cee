"""Queries over exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import duplicates as dup
from medialake.operators.growing import Components
from medialake.plans import fixtures as fx
from medialake.plans.registry import registering
from medialake.plans.shared import spread, stored

I = fx.ITEMS_SQL
QUERIES, ORACLES, query = registering()

VECTOR_DISTANCE = 24
VECTORS_SQL = """WITH bits AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: CAST(embedding[i] > embedding[i % 64 + 1] AS INT)) AS b FROM embeddings
), fps AS (SELECT id, array_to_string(list_transform(range(0, 16), lambda k: format('{:x}', b[4 * k + 1] * 8 + b[4 * k + 2] * 4 + b[4 * k + 3] * 2 + b[4 * k + 4])), '') AS fp FROM bits)"""
TEXTS_SQL = """WITH words AS (SELECT doc_id AS id, sha256(text) AS sha256, list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda w: w <> '') AS w FROM documents
), runs AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS run FROM words
), hashes AS (SELECT id, md5(run)[1:16] AS h FROM runs
), sums AS (SELECT id, list(h) AS hs FROM hashes GROUP BY id
), nibbles AS (SELECT id, pos, """ + ", ".join(f"sum(((('0x' || substr(h, pos, 1))::INT >> {3 - k}) & 1) * 2 - 1) > 0 AS b{k}" for k in range(4)) + """ FROM hashes, range(1, 17) r(pos) GROUP BY id, pos
), fps AS (SELECT id, string_agg(format('{:x}', b0::INT * 8 + b1::INT * 4 + b2::INT * 2 + b3::INT), '' ORDER BY pos) AS fp FROM nibbles GROUP BY id
), items AS (SELECT id, sha256, fp FROM fps JOIN words USING (id) WHERE fp NOT IN ('0000000000000000', 'ffffffffffffffff'))"""


def pairs_sql(source: str, most: int) -> str:
    return f""", banded AS (SELECT DISTINCT fp, k, substr(fp, 4 * k + 1, 4) AS v FROM {source}, range(0, 4) r(k) WHERE fp NOT IN ('0000000000000000', 'ffffffffffffffff')
), candidates AS (SELECT DISTINCT x.fp AS a, y.fp AS b FROM banded x JOIN banded y ON x.k = y.k AND x.v = y.v AND x.fp < y.fp
), pairs AS (SELECT a, b, bit_count(xor(('0x' || a)::UBIGINT, ('0x' || b)::UBIGINT))::INT AS distance FROM candidates WHERE bit_count(xor(('0x' || a)::UBIGINT, ('0x' || b)::UBIGINT)) <= {most})"""


CLUSTERS_SQL = TEXTS_SQL.replace("WITH words", "WITH RECURSIVE words") + pairs_sql("items", 6) + """, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT fp, fp FROM items GROUP BY fp HAVING count(DISTINCT sha256) > 1
), reach AS (SELECT a AS node, b AS far FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.far = e.a
), clusters AS (SELECT i.id, i.sha256, i.fp, c.cluster FROM items i JOIN (SELECT node, least(node, min(far)) AS cluster FROM reach GROUP BY node) c ON i.fp = c.node)"""


def _vectors(s, d):
    return dup.dhash_vectors(fx.table(s, d, "embeddings"))


def _texts(s, d):
    docs = spread(fx.table(s, d, "documents").select("doc_id", "text"))
    return stored(dup.simhash_text(docs).join(docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256")), "id"))


@query("f1_exact_groups", I + """ SELECT sha256, "group", id, size, 0 AS distance FROM (SELECT sha256, id, min(id) OVER same AS "group", count(*) OVER same AS size FROM items WINDOW same AS (PARTITION BY sha256)) WHERE size > 1""")
def f1(s, d):
    return dup.exact_groups(fx.items(s, d))


# Each vector as a picture of 16 x 18 grey points: 8 x 9 levels of its components in turn, every one on 2 x 2 points.
@query(
    "f2_dhash_images",
    """WITH levels AS (SELECT vec_id, list_transform(range(0, 72), lambda i: floor((embedding[i % 64 + 1]::DOUBLE + 1) * 127.5)::INT) AS v FROM embeddings
    ), bits AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CAST(v[i + i // 8 + 1] > v[i + i // 8 + 2] AS INT)) AS b FROM levels)
    SELECT 'vec-' || vec_id AS path, array_to_string(list_transform(range(0, 16), lambda k: format('{:x}', b[4 * k + 1] * 8 + b[4 * k + 2] * 4 + b[4 * k + 3] * 2 + b[4 * k + 4])), '') AS fp FROM bits""",
)
def f2(s, d):
    vec = F.col("embedding")
    level = lambda i: F.lpad(F.hex(F.floor((F.get(vec, i % 64).cast("double") + 1) * 127.5)), 2, "0")
    line = lambda r: F.array_join(F.transform(F.sequence(9 * r, 9 * r + 8), lambda i: F.repeat(level(i), F.lit(2))), "")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(line(r), F.lit(2))), ""))
    image = F.struct(F.concat(F.lit("vec-"), "vec_id").alias("origin"), F.lit(16).alias("height"), F.lit(18).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    return dup.dhash_images(fx.table(s, d, "embeddings").select(image.alias("image")))


@query("f3_dhash_vectors", VECTORS_SQL + " SELECT id, fp FROM fps")
def f3(s, d):
    return _vectors(s, d)


@query("f4_simhash_text", TEXTS_SQL + " SELECT id, fp FROM fps")
def f4(s, d):
    return dup.simhash_text(spread(fx.table(s, d, "documents").select("doc_id", "text")))


@query("f5_band_candidates", TEXTS_SQL + pairs_sql("items", 6) + " SELECT a, b FROM candidates")
def f5(s, d):
    return dup.band_candidates(_texts(s, d))


@query("f6_near_pairs_text", TEXTS_SQL + pairs_sql("items", 6) + " SELECT a, b, distance FROM pairs")
def f6(s, d):
    return dup.near_pairs(_texts(s, d))


@query("f6_near_pairs_vectors", VECTORS_SQL + pairs_sql("fps", VECTOR_DISTANCE) + " SELECT a, b, distance FROM pairs")
def f6_vectors(s, d):
    return dup.near_pairs(_vectors(s, d), VECTOR_DISTANCE)


@query("f7_cluster", CLUSTERS_SQL + " SELECT id, cluster FROM clusters")
def f7(s, d):
    texts = _texts(s, d)
    return dup.cluster(texts, dup.near_pairs(texts)).select("id", "cluster")


@query("f7_growing_clusters", CLUSTERS_SQL + " SELECT DISTINCT fp, cluster FROM clusters JOIN (SELECT a AS fp FROM pairs UNION SELECT b FROM pairs) USING (fp)")
def f7_growing(s, d):
    """The pairs arrive in three batches."""
    pairs = stored(dup.near_pairs(_texts(s, d)).select("a", "b"))
    batch = lambda k: pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(3)) == k)
    now = Components.create(batch(0))
    for k in (1, 2):
        now = now.add(batch(k))
    return now.read().select(F.col("node").alias("fp"), F.col("component").alias("cluster"))


@query("f8_cluster_diameter", CLUSTERS_SQL + " SELECT x.cluster, max(bit_count(xor(('0x' || x.fp)::UBIGINT, ('0x' || y.fp)::UBIGINT)))::INT AS distance FROM clusters x JOIN clusters y USING (cluster) GROUP BY 1")
def f8(s, d):
    texts = _texts(s, d)
    return dup.cluster_diameter(dup.cluster(texts, dup.near_pairs(texts)))


@query(
    "f9_duplicate_groups",
    CLUSTERS_SQL + """ SELECT 'exact' AS kind, "group", id, size, 0 AS distance FROM (SELECT id, min(id) OVER same AS "group", count(*) OVER same AS size FROM words WINDOW same AS (PARTITION BY sha256)) WHERE size > 1
    UNION ALL SELECT 'near', n."group", n.id, n.size, w.distance FROM (SELECT cluster, id, min(id) OVER same AS "group", count(*) OVER same AS size FROM clusters WINDOW same AS (PARTITION BY cluster)) n
    JOIN (SELECT x.cluster, max(bit_count(xor(('0x' || x.fp)::UBIGINT, ('0x' || y.fp)::UBIGINT)))::INT AS distance FROM clusters x JOIN clusters y USING (cluster) GROUP BY 1) w USING (cluster) WHERE n.size > 1""",
)
def f9(s, d):
    return dup.duplicate_groups(_texts(s, d))
