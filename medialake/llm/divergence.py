"""Which words set a source apart within its language, and which sources differ most (operator 13).

Terms are counted within Arrow batches, then summed by (language, source, term). A language keeps the terms
that stand in at least ``LEAST_DOCS`` of its documents. A term's share p in a group is smoothed and held as
an integer, and two shares p and q differ by floor((p-q)^2 / (p+q)); all sums are of integers.

The terms that rank first are found by a dominance skyband. Where p > q the difference never falls with a
higher count in the group nor with a lower count in the language, so a term that ``RANKS`` others dominate
(group count as high, language count as low, earlier in UTF-8) is not among the first ``RANKS``. Each
partition sorts its terms by group and dominance and drops those; what is left is shuffled and merged in
the same way, first in ``MERGES`` parts of a group and then whole, and only then ranked by the exact value.
A dropped term is dominated by kept ones as well, since dominance is transitive, so the merge loses nothing.

Differences between sources are sums over all kept terms. Terms are dealt into parts of some
``PART_ROWS`` rows and sources into blocks of some ``BLOCK``; each pair of blocks is one small matrix a part, whose sums by
pair of sources are added up. A term that no source of a block pair holds adds the same for all and is counted, not visited. The
part ``pair`` grows with the square of the sources of a language, as its result does.

Defined results: null text, lang and source are ''; rows are documents, whatever their doc_id, and repeated
rows count each; groups without terms have all their pairs; a language without kept terms has pairs of value 0 and no terms; a language
of one source has no pairs; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from medialake.llm.words import byte_table, word_lists
from medialake.plans.shared import stored

LEAST_DOCS = 10
RANKS = 10
SCALE = 1_000_000_000
#: Distinct terms that a task counts before it hands them on.
HELD = 400_000
#: Parts in which the skybands of one group are merged first.
MERGES = 16
#: Sources of a block and rows of a part, about; columns of a matrix that are computed at a time.
BLOCK = 128
PART_ROWS = 100_000
COLUMNS = 2048

#: Of UTF-8 text: ASCII letters, only A-Z in lower case, and all that is not ASCII.
TERMS = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, held_by) in groups.items():
            terms = pa.array([t.decode() for t in n], pa.string())
            same = [pa.array([v] * len(n), pa.string()) for v in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array([held_by[t] for t in n], pa.int64())], names=names)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, held_by = groups[lang, source]
                seen: set[bytes] = set()
                for terms in word_lists(text.as_py().encode(), TERMS):
                    n.update(terms)
                    seen.update(terms)
                held_by.update(seen)
            if sum(len(n) for n, _ in groups.values()) >= HELD:
                yield from rows(groups)
                groups.clear()
        yield from rows(groups)

    counted = docs.select(_plain("lang"), _plain("source"), _plain("text")).mapInArrow(per_batch, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; 1 without terms."""
    return F.expr(f"IF({terms} > 0, 1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) DIV CAST({total} + 2 * {terms} AS DECIMAL(20,0)), 1L)")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def skyband(k: int):
    """A function over batches in dominance order that drops rows which k others of their group dominate.

    Rows come by lang and source, then by n descending, lang_n ascending, term ascending, so all that may
    dominate a row have come before it. Only kept rows of one group are remembered.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = run = None
        like = 0
        terms: list[bytes] = []
        totals = np.zeros(64, np.int64)
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("lang", "source", "term", "n", "lang_n")]
            keep = []
            for row, (lang, source, term, n, lang_n) in enumerate(zip(*columns)):
                if group != (lang, source):
                    group, run, terms = (lang, source), None, []
                like = like + 1 if run == (n, lang_n) else 1
                run = (n, lang_n)
                if like > k:
                    continue
                name = term.encode()
                at, size = bisect.bisect_left(terms, name), len(terms)
                if np.count_nonzero(totals[:at] <= lang_n) >= k:
                    continue
                if size == len(totals):
                    totals = np.concatenate([totals, np.zeros(size, np.int64)])
                totals[at + 1 : size + 1] = totals[at:size].copy()
                totals[at] = lang_n
                terms.insert(at, name)
                keep.append(row)
            yield batch.take(pa.array(keep, pa.int64()))

    return per_batch


def first_terms(shares: DataFrame, k: int = RANKS) -> DataFrame:
    """lang, source, item, value, rank of the k terms that set each group apart from its language.

    ``shares``: lang, source, term, n, lang_n, value of the terms whose share in the group is the larger one.
    """
    order = ["lang", "source", F.col("n").desc(), "lang_n", "term"]
    now = shares.select("lang", "source", "term", "n", "lang_n", "value")
    now = now.sortWithinPartitions(*order).mapInArrow(skyband(k), now.schema)
    for dealt in (["lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGES))], ["lang", "source"]):
        now = now.repartition(*dealt).sortWithinPartitions(*order).mapInArrow(skyband(k), now.schema)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    return now.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _part_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of source blocks and one part of the terms: sums of differences by pair of sources.

    Rows without a term name the sources of both blocks and their share of a term they lack.
    """
    lang, low, high, part = key
    named = rows[rows["term"].isna()].sort_values("source", kind="stable")
    sources, base, blocks, lacked = (named[c].to_numpy() for c in ("source", "p", "block", "terms"))
    held = rows[rows["term"].notna()]
    at = pd.Index(sources).get_indexer(held["source"])
    codes, terms = pd.factorize(held["term"])
    shares = held["p"].to_numpy()
    order = np.argsort(codes, kind="stable")
    at, codes, shares = at[order], codes[order], shares[order]
    firsts = [a for a in range(len(sources)) if blocks[a] == low]
    sums = np.zeros((len(sources), len(sources)), np.int64)

    def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    none = differ(base[:, None], base[None, :])
    for begin in range(0, len(terms), COLUMNS):
        a, b = np.searchsorted(codes, [begin, begin + COLUMNS])
        width = min(COLUMNS, len(terms) - begin)
        matrix = np.repeat(base[:, None], width, axis=1)
        matrix[at[a:b], codes[a:b] - begin] = shares[a:b]
        for s in firsts:
            sums[s] += differ(matrix[s], matrix).sum(axis=1) - width * none[s]
    if part == 0:  # as if no source held any of the terms; the sums above are what they add to that
        sums += lacked[0] * none
    pairs = [(a, b) for a in firsts for b in range(len(sources)) if blocks[b] == high and (low < high or a < b)]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"lang": lang, "a": sources[a], "b": sources[b], "value": sums[a, b]})


def source_pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value, rank.

    ``shares``: lang, source, term, p of the kept terms that a group holds; ``groups``: lang, source, terms
    (kept ones of the language), p0 (share of a term the group lacks), held (kept terms that it holds).
    """
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("held").alias("held"))
    cut = sizes.select("lang", F.ceil(F.col("sources") / BLOCK).alias("blocks"), F.greatest(F.ceil(F.col("held") / PART_ROWS), F.lit(1)).alias("parts"))
    block = F.pmod(F.xxhash64("source"), "blocks").alias("block")
    dealt = stored(groups.join(cut, "lang").select("lang", "source", "terms", "p0", block, "blocks", "parts"))

    def met(rows: DataFrame) -> DataFrame:
        """Each row once for each block that its own block meets."""
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return other.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "part", "source", "term", "p", "block", "terms")

    none = F.lit(None).cast("string").alias("term")
    named = dealt.select("lang", "source", none, F.col("p0").alias("p"), "block", "blocks", "terms", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = shares.join(dealt, ["lang", "source"]).select("lang", "source", "term", "p", "block", "blocks", "terms", F.pmod(F.xxhash64("term"), "parts").alias("part"))
    cells = met(held).unionByName(met(named))
    sums = cells.groupBy("lang", "low", "high", "part").applyInPandas(_part_sums, "lang string, a string, b string, value long")
    total = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = total.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    rows = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return both.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(rows))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = stored(count_terms(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    held = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = held.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    met = docs.select(_plain("lang"), _plain("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "held", "terms", "lang_total")}
    groups = stored(met.withColumns(zero).withColumn("p0", share("0", "total", "terms")))
    shares = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    apart = shares.where("p > q").withColumn("value", difference("p", "q"))
    pairs = source_pairs(shares.select("lang", "source", "term", "p"), groups.select("lang", "source", "terms", "p0", "held"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(first_terms(apart, ranks).withColumn("part", F.lit("term")).select(*columns))
