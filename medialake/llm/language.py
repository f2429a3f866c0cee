"""Language identification by Bayesian evidence fusion (operator 5).

Text evidence is a naive Bayes model of byte trigrams, fitted on a bounded sample of rows by the
language they declare, and of one more class for texts of no known language, whose trigrams may mostly
be any and else come from all languages. A text's log likelihood counts as that of at most ``EFFECTIVE`` independent
trigrams. Three more sources of evidence come from grouped aggregation over all rows, weighted by the
text posteriors: how likely each declared markup language and each address suffix is in each language,
and a prior for each host, smoothed towards its domain, which is smoothed towards the whole corpus.
The posterior adds the four; a missing source adds nothing. Only the model tables (one per language,
each of a fixed size) go through the driver.

Defined results: a null or empty text, or one without letters, has no text evidence and is rejected; a
row is rejected too if its best language has a posterior below ``least``; rows that repeat get equal
results; null hosts, suffixes and declarations are missing evidence; a text of no known language has language null
and is rejected; if no row declares a language, every row is; an empty table gives an empty result. Declared
languages are compared by their first subtag of two or three letters, lower case, which bounds their number; those
that ``LEAST_ROWS`` rows declare are languages, at any size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.tokens import batches_of, slices
from medialake.plans.shared import stored

#: Rows of a declared language on which the text model is fitted (the bound of the labelled sample).
SAMPLE_ROWS = 2000
BUCKETS = 1 << 16
EFFECTIVE = 60.0
LEAST_ROWS = 10
#: Part of the trigrams of no known language that may be any.
ANYWHERE = 0.9
#: Rows that a domain's and the corpus' rates weigh in a host's prior; smoothing of declared and suffix rates.
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 50.0
RATE_SMOOTHING = 0.5
LEAST_POSTERIOR = 0.5

#: Letters stay, A-Z become a-z, other ASCII becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, BUCKETS where it has no letter or crosses texts; first byte and letters of each text)."""
    folded = [t.translate(_FOLD) + b"  " for t in pc.cast(pc.utf8_lower(pc.fill_null(texts, "")), pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    data = np.frombuffer(b"".join(folded), np.uint8)
    letters = data != 32
    wide = data.astype(np.uint32)
    mixed = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)
    buckets = np.full(len(data), BUCKETS, np.int32)
    some = letters[:-2] | letters[1:-1]
    buckets[:-2][some] = (mixed >> np.uint32(16))[some]
    starts = np.cumsum(sizes) - sizes
    return buckets, starts, np.add.reduceat(letters, starts, dtype=np.int64)


def _subtag(declared: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(declared.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def fit_text_model(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the buckets in each and, last, in no known language).

    ``rows`` has text, declared and columns that tell rows apart, by which the sample is drawn. Trigrams are
    counted in tasks and summed by a shuffle; a group is a language's buckets.
    """
    sizes = rows.where("declared is not null").groupBy("declared").count()
    known = [(r["declared"], r["count"]) for r in sizes.where(F.col("count") >= LEAST_ROWS).collect()]
    if not known:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    spread = F.pmod(F.xxhash64(*rows.columns, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for name, n in known for x in (name, min(1.0, sample_rows / n))]), F.col("declared"))
    sample = rows.where(F.col("declared").isin([name for name, _ in known])).where(spread < rate).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for name in pc.unique(names).to_pylist():
                texts = batch.column(1).filter(pc.equal(names, name))
                for first, n in slices(texts, 1 << 20):
                    seen = np.bincount(_trigrams(texts.slice(first, n))[0], minlength=BUCKETS + 1)[:BUCKETS]
                    some = np.flatnonzero(seen)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64))], names=["declared", "bucket", "n"])

    def table_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(BUCKETS)
        seen[part["bucket"].to_numpy()] = part["n"].to_numpy()
        return pd.DataFrame({"language": [key[0]], "table": [((seen + 1) / (seen.sum() + BUCKETS)).tobytes()]})

    counted = sample.mapInArrow(count, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    found = {r["language"]: np.frombuffer(r["table"]) for r in counted.groupBy("declared").applyInPandas(table_of, "language string, table binary").collect()}
    names = sorted(found)
    if not names:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    shares = np.stack([found[n] for n in names])
    shares = np.concatenate([shares, (1 - ANYWHERE) * shares.mean(axis=0, keepdims=True) + ANYWHERE / BUCKETS])
    return names, np.concatenate([np.log(shares), np.zeros((len(shares), 1))], axis=1).astype(np.float32)


def text_scores(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` (without text) with n_letters and scores: tempered log likelihood by language and of none."""
    others = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for first, n in slices(texts, 1 << 20):
                buckets, starts, letters = _trigrams(texts.slice(first, n))
                used = np.add.reduceat(buckets != BUCKETS, starts, dtype=np.int64)
                sums = np.stack([np.add.reduceat(model[buckets], starts, dtype=np.float64) for model in shared.value], axis=1) 
                scores = sums * (np.minimum(used, EFFECTIVE) / np.maximum(used, 1))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(shared.value), pa.int32()), pa.array(scores.ravel()))
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(letters), lists], names=[*others, "n_letters", "scores"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return rows.mapInArrow(score, f"{schema}, n_letters long, scores array<double>")


def softmax(scores: Column) -> Column:
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[k]) for k in range(n)])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _smoothed(own: Column, towards: Column, weight: float) -> Column:
    return F.zip_with(own, towards, lambda a, b: (a + weight * b) / (_total(own) + weight))


def identify(rows: DataFrame, least: float = LEAST_POSTERIOR, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rows`` without text, with text_language, language, posterior and accepted.

    ``rows`` has text, declared, host and suffix (all may be null) and any columns that identify a row.
    """
    rows = rows.withColumn("declared", _subtag(F.col("declared"))).withColumn("host", F.lower("host"))
    languages, table = fit_text_model(rows, sample_rows)
    n = len(table)
    others = [c for c in rows.columns if c not in ("text", "declared", "host", "suffix")]
    if not n:
        return rows.select(*others, "declared", F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    with batches_of(rows.sparkSession):
        scored = stored(text_scores(rows, table).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    soft = scored.where("n_letters > 0").select("declared", "suffix", "host", "domain", softmax(F.col("scores")).alias("p"))
    sums = [x or 0.0 for x in soft.agg(_sums("p", n)).first()[0]]
    overall = [(x + 1) / (sum(sums) + n) for x in sums]
    by_domain = soft.where("host is not null").groupBy("domain").agg(_sums("p", n).alias("own")).select("domain", _smoothed(F.col("own"), F.array(*map(F.lit, overall)), DOMAIN_WEIGHT).alias("domain_prior"))
    by_host = (
        soft.where("host is not null").groupBy("host", "domain").agg(_sums("p", n).alias("own")).join(by_domain, "domain")
        .select("host", F.transform(_smoothed(F.col("own"), F.col("domain_prior"), HOST_WEIGHT), lambda x: F.log(x)).alias("host_part"))
    )

    def rates(column: str) -> DataFrame:
        """Log rate of each value of ``column`` in each language."""
        sums = soft.where(F.col(column).isNotNull()).groupBy(column).agg(_sums("p", n).alias("own"))
        row = sums.agg(_sums("own", n), F.count("*")).first()
        totals = F.array(*[F.lit((t or 0.0) + RATE_SMOOTHING * row[1]) for t in row[0]])
        return sums.select(column, F.zip_with("own", totals, lambda a, t: F.log((a + RATE_SMOOTHING) / t)).alias(f"{column}_part"))

    joined = scored.join(by_host, "host", "left").join(rates("declared"), "declared", "left").join(rates("suffix"), "suffix", "left")
    parts = [F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), n)) for c in ("declared_part", "suffix_part")]
    parts.append(F.coalesce(F.col("host_part"), F.array(*[F.lit(float(np.log(x))) for x in overall])))
    added = F.col("scores")
    for part in parts:
        added = F.zip_with(added, part, lambda a, b: a + b)
    names = F.array(*map(F.lit, languages), F.lit(None).cast("string"))
    fused = joined.withColumn("added", added).withColumn("p", softmax(F.col("added")))
    best = F.array_max("p")
    return fused.select(
        *others,
        "declared",
        F.when(F.col("n_letters") > 0, F.get(names, (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))).alias("text_language"),
        F.get(names, (F.array_position("p", best) - 1).cast("int")).alias("language"),
        best.alias("posterior"),
        ((F.col("n_letters") > 0) & (best >= least) & (F.array_position("p", best) <= len(languages))).alias("accepted"),
    )


def document_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """Documents as rows for identify: the language column declares, the source is the host, there is no address."""
    return docs.select(*keys, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_rows(pages: DataFrame, *keys: str) -> DataFrame:
    """Web pages as rows for identify: visible text, declared markup language, host, and suffix of the address.

    The suffix is the host's last label, with a leading two-letter path segment where there is one.
    """
    html, url = F.col("html").cast("string"), F.lower(F.col("url").cast("string"))
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    suffix = F.concat(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("/"), path)
    return pages.select(*keys, visible.alias("text"), F.when(declared != "", declared).alias("declared"), F.when(host != "", host).alias("host"), F.when(host != "", suffix).alias("suffix"))


def accepted_documents(docs: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """``docs`` without the rows that identify rejects.

    Rejected rows, which are few, are taken away by their contents, so texts are moved only if they are many.
    """
    marks = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    rejected = identify(document_rows(docs.select("*", *marks), "_id", "_text", "_lang", "_source"), least).where("not accepted").select("_id", "_text", "_lang", "_source").distinct()
    same = docs["doc_id"].eqNullSafe(rejected["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(rejected["_text"]) & docs["lang"].eqNullSafe(rejected["_lang"]) & docs["source"].eqNullSafe(rejected["_source"])
    return docs.join(rejected, same, "left_anti")
