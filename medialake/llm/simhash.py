"""SimHash near-duplicates with Golay-code fuzzy hashing (operator 7).

A fingerprint is cut into three segments. Of fingerprints that differ in two bits or fewer, one segment
is equal (pigeonhole) and the next one differs in at most two bits, so both have a common codeword
number when that segment and its one-bit neighbours are decoded with the Golay code. The keys
(segment, its bits, codeword number of the next segment) therefore miss no link. Fingerprints are
distinct before they are joined, so copies cost one row. In a bucket of up to ``bucket`` fingerprints
all pairs are verified. Larger buckets are handled exactly without pairs: each of their fingerprints
stands under itself and its 64 one-bit neighbours, where those that meet differ in two bits at most,
and links to the smallest fingerprint it meets. Links become components in the shared folder.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; texts
of fewer words than a shingle have one shingle of all words; rows that repeat get equal results; a row
with a null doc_id gets the component of its fingerprint (null if no row in it has an id); an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.golay import distinct_in_rows, nearby_codewords
from medialake.operators.graph import connected_components
from medialake.plans.shared import stored

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Fingerprints of a bucket up to which all its pairs are verified.
BUCKET = 16
#: (first bit, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
KEYS = "key long, fp long"


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; of all words where they are fewer; none without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    row = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], stops[:-1] + 1])
    wide = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(row[a:b], seed) for a, b in zip(begins[: len(words) - wide].tolist(), stops[wide:].tolist())), np.uint64, len(words) - wide)


def bits_of(hashes: np.ndarray) -> int:
    """64 bits, each set in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[part : part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return bits_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py() or "", shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch, "doc_id long, fp long")


def golay_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): a key for each segment and each codeword number near the next segment."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for part in range(0, len(fps), 20_000):
                some = fps[part : part + 20_000]
                bits = some.view(np.uint64)
                for k, (at, width) in enumerate(SEGMENTS):
                    to, near = SEGMENTS[(k + 1) % len(SEGMENTS)]
                    exact = ((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    fuzzy = ((bits >> np.uint64(to)) & np.uint64((1 << near) - 1)).astype(np.int64)
                    rows, numbers = distinct_in_rows(nearby_codewords(fuzzy, near))
                    keys = (np.int64(k) << 34) | (exact[rows] << 12) | numbers.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(per_batch, KEYS)


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints of at most two differing bits, enough for exact components."""
    keys = stored(golay_keys(distinct))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keys.join(sizes, "key"))
    small = members.where(F.col("n") <= bucket).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key")
    verified = pairs.where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= DISTANCE)).select("a", "b")
    crowded = members.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(*[F.lit(m) for m in (0, *(1 << k for k in range(63)), -(1 << 63))])
    around = F.transform(flips, lambda flip: F.col("fp").bitwiseXOR(flip))
    met = crowded.select("fp", F.explode(around).alias("middle"))
    least = met.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = met.join(least, "middle").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return verified.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most two bits)."""
    prints = stored(fingerprints(docs, shingle, seed))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = connected_components(links(distinct, bucket), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
