"""Duplicate groups: equal content, and near copies by 64-bit fingerprints.

Fingerprints are 16 hexadecimal digits. Work on pairs is done between distinct fingerprints; items that
share one are its members, so copies never become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from medialake.functions.shingles import text_prints
from medialake.operators.graph import connected_components
from medialake.plans.shared import stored

#: Bytes of texts that are fingerprinted at a time; a longer text is taken alone.
TEXT_BYTES = 1 << 20
BANDS = 4
BAND_BITS = 16
MAX_DISTANCE = 6
#: Fingerprints of a band's value up to which they meet as a whole, and bits of the pieces by which more of them meet.
CROWD = 256
LEAST_PIECE = 4
#: Fingerprints of a block when distances within a cluster are taken, and of a key on one side of a part.
BLOCK = 2048
#: Blocks of a cluster on one side of a part.
PART = 8


def exact_groups(items: DataFrame) -> DataFrame:
    """(sha256, group, id, size, distance 0): a row for each item of content that several share; ``group`` is its smallest id."""
    groups = items.groupBy("sha256").agg(F.count("*").alias("size"), F.min("id").alias("group")).where("size > 1")
    return items.select("sha256", "id").join(groups, "sha256").select("sha256", "group", "id", "size", F.lit(0).alias("distance"))


def _hex(bits: Column) -> Column:
    """16 digits of 64 bits, most significant first."""
    return F.lower(F.lpad(F.conv(F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), ""), 2, 16), 16, "0"))


def dhash_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, fp): a bit for each of 64 components, set where it exceeds the next one, the last compared with the first."""
    vec = F.col(vector_col)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(vec, i) > F.get(vec, (i + 1) % 64))
    return vectors.select(F.col(id_col).alias("id"), _hex(bits).alias("fp"))


def dhash_images(images: DataFrame) -> DataFrame:
    """(path, fp) of rows of Spark's image source: 9 x 8 grey cells by area mean, a bit where a cell exceeds its right one."""

    @F.pandas_udf(T.StringType())
    def grey_hash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([image_fingerprint(h, w, c, d) for h, w, c, d in zip(height, width, channels, data)], dtype="object")

    return images.select(F.col("image.origin").alias("path"), grey_hash("image.height", "image.width", "image.nChannels", "image.data").alias("fp"))


def image_fingerprint(height: int, width: int, channels: int, data: bytes) -> str | None:
    if height <= 0 or width <= 0:
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    grey = pixels[..., :3] @ [0.114, 0.587, 0.299] if channels >= 3 else pixels[..., 0]
    rows, columns = _edges(height, 8), _edges(width, 9)
    cells = np.array([[grey[a : max(b, a + 1), c : max(e, c + 1)].mean() for c, e in zip(columns, columns[1:])] for a, b in zip(rows, rows[1:])])
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def _edges(size: int, parts: int) -> list[int]:
    return [min(size - 1, size * k // parts) for k in range(parts)] + [size]


def text_bits(text: str, shingle: int = 3) -> bytes:
    """8 bytes from md5 of the distinct word shingles of a lower-case text; a text of fewer words is one shingle."""
    return text_prints([text], shingle)[0].tobytes()


def simhash_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): 64 bits from md5 of distinct word shingles, a bit set where more hashes have it than lack it.

    One pass over the texts in Arrow batches; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            part = (np.cumsum(sizes) - sizes) // TEXT_BYTES
            for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
                if len(rows):
                    some = batch.slice(rows[0], len(rows))
                    prints = text_prints(some.column(1).to_pylist(), shingle).tobytes().hex()
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([prints[at : at + 16] for at in range(0, len(prints), 16)], pa.string())], names=["id", "fp"])

    return rows.mapInArrow(per_batch, T.StructType([rows.schema["id"], T.StructField("fp", T.StringType())]))


def usable(fingerprints: DataFrame) -> DataFrame:
    """Rows whose fingerprint says something: not null, not all zeros or ones."""
    return fingerprints.where(F.col("fp").isNotNull() & ~F.col("fp").isin("0" * 16, "f" * 16))


_TOP = -(1 << 63)


def as_long(fp: Column) -> Column:
    """64 bits as a long whose order is that of the digits."""
    half = lambda k: F.conv(F.substring(fp, 1 + 8 * k, 8), 16, 10).cast("long")
    return F.shiftleft(half(0), 32).bitwiseOR(half(1)).bitwiseXOR(F.lit(_TOP))


def as_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits.bitwiseXOR(F.lit(_TOP))), 16, "0"))


def hamming(a: str, b: str) -> Column:
    """Differing bits of two fingerprints as longs."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _banded(fingerprints: DataFrame) -> DataFrame:
    """(bits, band, value): each distinct fingerprint once for each of its four bands, the first digits first."""
    distinct = usable(fingerprints).select(as_long(F.col("fp")).alias("bits")).distinct()
    value = lambda k: F.shiftrightunsigned(F.col("bits").bitwiseXOR(F.lit(_TOP)), 64 - BAND_BITS * (k + 1)).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    return distinct.select("bits", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), value(k).alias("value")) for k in range(BANDS)])).alias("x")).select("bits", "x.band", "x.value")


def _met(rows: DataFrame, keys: list[str], max_distance: int | None = None) -> DataFrame:
    """(a, b): fingerprints that share ``keys``, a before b, with ``max_distance`` only those that differ in so many bits at most.

    A key that more than ``BLOCK`` fingerprints share is met in parts: each of its fingerprints is in one part on
    the left and in every part on the right. What is too far apart is dropped inside the join.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    split = rows.join(sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), keys)
    left = split.select(*keys, F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int").alias("part"), F.col("bits").alias("a"))
    right = split.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("bits").alias("b"))
    met = [*keys, "part"]
    close = [F.col("a") < F.col("b"), *([hamming("a", "b") <= max_distance] if max_distance is not None else [])]
    return left.join(right.select(*[F.col(c).alias(f"_{c}") for c in met], "b"), [F.col(c) == F.col(f"_{c}") for c in met] + close).select("a", "b")


def band_candidates(fingerprints: DataFrame) -> DataFrame:
    """(a, b): distinct fingerprints, a before b, that share one of four bands of 16 bits."""
    return _met(_banded(fingerprints), ["band", "value"]).distinct().select(as_digits(F.col("a")).alias("a"), as_digits(F.col("b")).alias("b"))


def near_pairs(fingerprints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b, distance) of band candidates that differ in at most ``max_distance`` bits.

    A band value that more than ``CROWD`` fingerprints share is not met as a whole: as the band is equal, all
    differences lie in the other 48 bits, and of ``max_distance`` + 1 pieces of these one is equal. Its
    fingerprints meet by (band, value, piece) instead, which loses no pair.
    """
    banded = stored(_banded(fingerprints))
    width = 48 // (max_distance + 1)
    if width < LEAST_PIECE:
        near = _met(banded, ["band", "value"], max_distance)
    else:
        sizes = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
        members = stored(banded.join(sizes, ["band", "value"]))
        bits = F.col("bits").bitwiseXOR(F.lit(_TOP))
        behind = F.expr(f"shiftright({(1 << 48) - 1}L, {BAND_BITS} * band)")  # ones where the bits after the band are
        # The three other bands side by side: those before it move down by one band.
        rest = F.shiftrightunsigned(bits, BAND_BITS).bitwiseAND(F.bitwise_not(behind)).bitwiseAND(F.lit((1 << 48) - 1)).bitwiseOR(bits.bitwiseAND(behind))
        pieces = [F.struct(F.lit(k).alias("piece"), F.shiftrightunsigned(rest, k * width).bitwiseAND(F.lit((1 << (width if k < max_distance else 48 - k * width)) - 1)).alias("own")) for k in range(max_distance + 1)]
        cut = members.where(F.col("n") > CROWD).select("bits", "band", "value", F.explode(F.array(*pieces)).alias("x")).select("bits", "band", "value", "x.piece", "x.own")
        few = members.where(F.col("n") <= CROWD).select("bits", "band", "value")
        near = _met(few, ["band", "value"], max_distance).unionByName(_met(cut, ["band", "value", "piece", "own"], max_distance))
    return near.distinct().select(as_digits(F.col("a")).alias("a"), as_digits(F.col("b")).alias("b"), hamming("a", "b").alias("distance"))


def cluster(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, sha256, fp, cluster): items with a near copy of other content; cluster is its smallest fingerprint.

    ``items`` has id, sha256, fp. Items of equal content and no other link are no cluster.
    """
    rows = usable(items.select("id", "sha256", "fp"))
    several = rows.groupBy("fp").agg(F.count_distinct("sha256").alias("n")).where("n > 1").select("fp")
    linked = connected_components(pairs, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("cluster"))
    alone = several.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("cluster"))
    return rows.join(linked.unionByName(alone), "fp").select("id", "sha256", "fp", "cluster")


def _measured(clusters: DataFrame) -> DataFrame:
    """(name, cluster, bits, d0, d1, d2): distances of each distinct fingerprint of a cluster to three points.

    The first point has each bit that most of the cluster have and need not be one of them, the second is the
    fingerprint farthest from it, the third the one farthest from the second.
    """
    now = stored(clusters.select(F.col("cluster").alias("name"), as_long(F.col("cluster")).alias("cluster"), as_long(F.col("fp")).alias("bits")).distinct())
    ones = [F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1))).alias(f"s{k}") for k in range(64)]
    sums = now.groupBy("cluster").agg(F.count("*").alias("n"), *ones)
    centre = F.aggregate(F.array(*[F.when(2 * F.col(f"s{k}") > F.col("n"), F.lit(1 << k if k < 63 else _TOP)).otherwise(F.lit(0)) for k in range(64)]), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    now = now.join(sums.select("cluster", centre.alias("far")), "cluster").withColumn("d0", hamming("far", "bits")).drop("far")
    for k in (1, 2):
        far = now.groupBy("cluster").agg(F.max_by("bits", F.struct(f"d{k - 1}", "bits")).alias("far"))
        now = now.join(far, "cluster").withColumn(f"d{k}", hamming("far", "bits")).drop("far")
    return now


def diameter_bounds(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, cluster, least), (cluster, bits, d0, d1, d2, least): a distance that each cluster has, and the fingerprints that may exceed it.

    By the triangle inequality two fingerprints are no farther apart than their distances to a third one add up to. One whose
    distance and the largest of the cluster do not add up to more than ``least`` is in no wider pair.
    """
    rows = stored(_measured(clusters))
    most = [F.max(f"d{k}").alias(f"m{k}") for k in range(3)]
    sums = rows.groupBy("name", "cluster").agg(*most).withColumn("least", F.greatest("m1", "m2"))
    doubt = F.lit(True)
    for k in range(3):
        doubt = doubt & (F.col(f"d{k}") + F.col(f"m{k}") > F.col("least"))
    return sums.select("name", "cluster", "least"), rows.join(sums.drop("name"), "cluster").where(doubt).select("cluster", "bits", "d0", "d1", "d2", "least")


def cluster_diameter(clusters: DataFrame) -> DataFrame:
    """(cluster, distance): the largest distance of two fingerprints of a cluster, exactly.

    Distances to the centre and to two far fingerprints give a distance that is mostly the largest; only those that
    may be in a wider pair are compared, in blocks of bounded size of which two meet as one row, those of a large
    cluster in parts of ``PART`` blocks. Within two blocks rows are compared from the farthest on, until no sum of
    distances exceeds what has been found.
    """
    least, doubt = diameter_bounds(clusters)
    number = F.row_number().over(Window.partitionBy("cluster", "part").orderBy("bits")) - 1
    parts = doubt.withColumn("part", F.pmod(F.xxhash64("bits"), F.lit(64)))
    rows = F.collect_list(F.struct("bits", "d0", "d1", "d2")).alias("rows")
    blocks = parts.withColumn("block", F.concat_ws("-", "part", F.floor(number / BLOCK).cast("string"))).groupBy("cluster", "block").agg(rows, F.first("least").alias("least"))
    few = blocks.groupBy("cluster").agg(F.sum(F.size("rows")).alias("n"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    small = doubt.join(few.where((F.col("n") <= BLOCK) & (F.col("n") > 1)), "cluster").groupBy("cluster").agg(rows, F.first("least").alias("least")).select("cluster", F.lit("0").alias("block"), "rows", "least", F.lit(1).alias("parts"))
    big = blocks.join(few.where(F.col("n") > BLOCK).select("cluster", "parts"), "cluster")
    every = stored(small.unionByName(big.select("cluster", "block", "rows", "least", "parts")))
    left = every.withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    right = every.select("cluster", F.col("block").alias("block_b"), F.col("rows").alias("rows_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = left.join(right, ["cluster", "part"]).where("block <= block_b").select("cluster", "rows", "rows_b", "least")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [widest(*(_columns(row[c]) for c in ("rows", "rows_b")), row["least"])[0] for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.int32())], names=["cluster", "wide"])

    wider = met.mapInArrow(compare, "cluster long, wide int").groupBy("cluster").agg(F.max("wide").alias("wide"))
    return least.join(wider, "cluster", "left").select(F.col("name").alias("cluster"), F.greatest("least", F.coalesce("wide", F.lit(0))).alias("distance"))


def _columns(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["bits"] for r in rows], np.int64).view(np.uint64), np.array([[r[f"d{k}"] for k in range(3)] for r in rows], np.int64).reshape(-1, 3).T


def widest(left: tuple, right: tuple, least: int) -> tuple[int, int]:
    """The largest distance of a row on the left and one on the right if it exceeds ``least``, else ``least``; and the distances computed.

    Each side is its bits and its distances to the same three others.
    """
    (a, near_a), (b, near_b) = left, right
    if not len(a) or not len(b):
        return least, 0
    order = np.argsort(-near_b[0], kind="stable")
    b, near_b = b[order], near_b[:, order]
    computed = 0
    for i in np.argsort(-near_a[0], kind="stable"):
        if near_a[0, i] + near_b[0, 0] <= least:
            break
        end = np.searchsorted(-near_b[0], near_a[0, i] - least, side="left")
        some = np.flatnonzero((near_a[1, i] + near_b[1, :end] > least) & (near_a[2, i] + near_b[2, :end] > least))
        computed += len(some)
        if len(some):
            least = max(least, int(np.bitwise_count(a[i] ^ b[some]).max()))
    return least, computed


def duplicate_groups(items: DataFrame, near: bool = True, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(kind, group, id, size, distance): a row for each item of the exact groups and then, if asked for, the near ones."""
    columns = ["kind", "group", "id", "size", "distance"]
    exact = exact_groups(items).withColumn("kind", F.lit("exact")).select(*columns)
    if not near:
        return exact
    clusters = stored(cluster(items, near_pairs(items, max_distance)))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("group")).where("size > 1")
    named = clusters.select("id", "cluster").join(sizes.join(cluster_diameter(clusters), "cluster"), "cluster")
    return exact.unionByName(named.withColumn("kind", F.lit("near")).select(*columns))
