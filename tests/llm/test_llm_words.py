"""Spelling variants, document fingerprints and divergence of sources, on odd documents and against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.llm import divergence, fingerprint, queries, spelling
from medialake.llm.words import word_lists
from medialake.plans.shared import table

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without an id, letters letters"), (7, "same words " * 3), (7, "same words " * 3), (8, "Straße straße ÉCOLE école ×÷×÷×÷ ǅ" * 3), (9, "x" * 5000)]


def odd(spark, more=()):
    """Documents with the other columns null or clashing with columns of the operators."""
    columns = "doc_id long, text string, lang string, source string, n long, word string, term string, key long, part int, p long, value long, rank int, total long"
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "a", 1, "w", "t", 2, 3, 4, 5, 6, 7) for k, (i, t) in enumerate([*ODD, *more])]
    return spark.createDataFrame(rows, columns)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces_cut_no_word(piece):
    data = "Één word, another--WORD!  x".encode() * 9
    found = [w for some in word_lists(data, divergence.TERMS, piece) for w in some]
    assert found == [lower(w).encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", data.decode())]


# 11: spelling variants


def edits(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes the two equal."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if v != w and edits(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 5 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def variants(docs, **more):
    rows = spelling.spelling_variants(docs, **more).collect()
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in rows)


def spelt(seed: int, alphabet: str = "abcde", words: int = 12, rows: int = 60):
    """Texts of words with random edits, frequencies far apart."""
    draw = random.Random(seed)
    stems = ["".join(draw.choice(alphabet) for _ in range(draw.randint(6, 9))) for _ in range(words)]
    pool = [(w, 400 // (k + 1)) for k, w in enumerate(stems)]
    for w, n in list(pool):
        for _ in range(6):
            k, kind = draw.randrange(len(w)), draw.randrange(3)
            pool.append((w[:k] + ("" if kind == 0 else draw.choice(alphabet)) + w[k + (kind < 2) :], max(5, n // draw.choice([4, 5, 6, 30]))))
    flat = [w if draw.random() < 0.7 else w.upper() for w, n in pool for _ in range(n)]
    draw.shuffle(flat)
    return [(k, " ".join(flat[k::rows])) for k in range(rows)]


@pytest.mark.parametrize("seed,alphabet", [(1, "abcde"), (2, "aß÷ë"), (3, "ab")])
@pytest.mark.parametrize("bucket", [2, 32])
def test_variants_equal_all_pairs(spark, seed, alphabet, bucket):
    docs = spelt(seed, alphabet)
    assert variants(spark.createDataFrame(docs, "doc_id long, text string"), bucket=bucket) == variants_by_hand(docs)


def test_variants_of_odd_documents(spark):
    more = spelt(4)
    assert variants(odd(spark, more)) == variants_by_hand([*ODD, *more])
    assert variants(odd(spark)) == variants_by_hand(ODD)
    assert spelling.spelling_variants(odd(spark).limit(0)).isEmpty()


def test_every_near_pair_shares_a_signature():
    draw = random.Random(5)
    for _ in range(2000):
        word = "".join(draw.choice("abcxyzé") for _ in range(draw.randint(6, 30)))
        k = draw.randrange(len(word))
        other = word[:k] + draw.choice(["", "q", "a"]) + word[k + draw.randint(0, 1) :]
        a, b = spelling.signatures([word.encode("latin-1"), other.encode("latin-1")])
        assert (a == b).any()


def test_spelling_query_equals_its_sql(spark, same_rows):
    same_rows(queries.op11_spelling_variants(spark, DATA), queries.ORACLES["op11_spelling_variants"])


# 12: fingerprints


def shingles(text: str) -> set:
    words = lower(text).encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def dense_by_hand(values, filled):
    order, _ = fingerprint._orders(len(values))
    return [values[k] if filled[k] else next(values[g] for g in order[k] if filled[g]) for k in range(len(values))]


@pytest.mark.parametrize("held", [1, 5, 40, 300, 500, 512])
def test_empty_bins_take_the_first_giver(held):
    draw = np.random.default_rng(held)
    values = draw.integers(0, 1 << 40, 512).astype(np.uint64)
    filled = np.zeros(512, bool)
    filled[draw.permutation(512)[:held]] = True
    wanted = dense_by_hand(values.copy(), filled)
    assert fingerprint.dense(values.copy(), filled).tolist() == wanted


def test_likeness_estimates_jaccard():
    draw, errors = random.Random(3), []
    for n in (40, 300, 3000):
        for share in (0.0, 0.3, 0.8, 0.95, 1.0):
            words = [str(draw.random()) for _ in range(n)]
            cut = int(n * share)
            a, b = " ".join(words), " ".join(words[:cut] + [str(draw.random()) for _ in range(n - cut)])
            errors.append(fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) - jaccard(a, b))
    assert max(map(abs, errors)) < 0.1 and abs(np.mean(errors)) < 0.02
    assert fingerprint.likeness(b"", b"") == 1 and fingerprint.likeness(b"", fingerprint.fingerprint("a")) == 0
    assert fingerprint.fingerprint("A b") == fingerprint.fingerprint(" a\nB") != fingerprint.fingerprint("a b c")


def rows_by_hand(docs):
    """(doc_id, text) in the order of the operator, with the row that each one must get."""
    texts = [t or "" for _, t in docs]
    prints = [fingerprint.fingerprint(t) for t in texts]
    rows = []
    for k, (i, _) in enumerate(docs):
        n, after = len(texts[k]), texts[(k + 1) % len(docs)]
        text = texts[k][: n - n // 2] + after[: n // 2]
        other = fingerprint.fingerprint(text)
        rows.append((i, n, hashlib.sha256(text.encode()).hexdigest(), prints[k], other, fingerprint.likeness(prints[k], other), fingerprint.likeness(prints[k], prints[(k + 1) % len(docs)])))
    return collections.Counter(rows)


def printed(docs):
    return collections.Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in fingerprint.fingerprint_documents(docs).collect())


def test_fingerprints_of_whole_table(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect())
    assert printed(table(spark, DATA, "documents").repartition(5)) == rows_by_hand(docs)
    for r in fingerprint.fingerprint_documents(table(spark, DATA, "documents")).collect():
        k = [i for i, _ in docs].index(r["doc_id"])
        n, after = r["n_chars"], docs[(k + 1) % len(docs)][1]
        assert abs(r["near_edited"] - jaccard(docs[k][1], docs[k][1][: n - n // 2] + after[: n // 2])) < 0.15
        assert abs(r["near_next"] - jaccard(docs[k][1], after)) < 0.15


def test_fingerprints_of_odd_documents(spark):
    frame = odd(spark)
    rows = frame.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    assert printed(frame) == rows_by_hand([tuple(r) for r in rows])
    assert printed(frame.where("doc_id = 9")) == rows_by_hand([(9, "x" * 5000)])
    assert fingerprint.fingerprint_documents(frame.limit(0)).isEmpty()
    query = queries.op12_document_fingerprints(spark, DATA)
    assert query.count() == 200 and query.select("fingerprint").dtypes[0][1] == "string"


# 13: divergence of sources


def divergence_by_hand(docs, least=10, ranks=10):
    """docs: (lang, source, text)."""
    counts, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    rows = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), collections.Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        differ = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            ranked = [("pair", sorted((-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))]
            ranked.append(("term", sorted((-differ(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:ranks]))
            rows += [(lang, s, part, item.decode(), -value, k + 1) for part, of in ranked for k, (value, item) in enumerate(of)]
    return sorted(rows)


def diverging(docs, **more):
    return sorted(tuple(r) for r in divergence.source_divergence(docs, **more).collect())


@pytest.mark.parametrize("block,part_rows,columns", [(128, 100_000, 2048), (2, 40, 8)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, part_rows, columns):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "PART_ROWS", part_rows)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    draw = random.Random(7)
    vocabulary = [f"w{'abcdefghij'[k % 10]}{'äß中xyzqrst'[k // 10]}" for k in range(100)]
    docs = [(k, " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(100)], k=draw.randint(0, 60))), draw.choice(["en", "de", None]), f"s{draw.randint(0, 6) ** 2 % 7}") for k in range(150)]
    docs += [(200, "", "en", "none"), (201, None, "xx", "only"), (202, "few words", "xx", None), (203, "words", "yy", "alone")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert diverging(frame) == divergence_by_hand([(la, s, t) for _, t, la, s in docs])


def test_divergence_of_odd_documents(spark):
    frame = odd(spark)
    by_hand = [(r["lang"], r["source"], r["text"]) for r in frame.collect()]
    assert diverging(frame, least_docs=1) == divergence_by_hand(by_hand, 1)
    assert diverging(frame) == divergence_by_hand(by_hand)
    assert divergence.source_divergence(frame.limit(0)).isEmpty()


def test_skyband_keeps_what_few_dominate(spark):
    draw = random.Random(9)
    rows = sorted({(draw.randint(1, 9), draw.randint(1, 9), f"t{draw.randint(0, 400)}") for _ in range(900)}, key=lambda r: (-r[0], r[1], r[2]))
    rows = list({t: (n, m, t) for n, m, t in rows}.values())
    frame = spark.createDataFrame([("en", "s", t, n, m) for n, m, t in rows], "lang string, source string, term string, n long, lang_n long").coalesce(1)
    kept = frame.sortWithinPartitions(F.col("n").desc(), "lang_n", "term").mapInArrow(divergence.skyband(3), frame.schema).collect()
    wanted = {t for n, m, t in rows if sum(a >= n and b <= m and u < t for a, b, u in rows) < 3}
    assert {r["term"] for r in kept} == wanted and len(wanted) < len(rows)


def test_divergence_query_equals_its_sql(spark, same_rows):
    same_rows(queries.op13_source_divergence(spark, DATA), queries.ORACLES["op13_source_divergence"])


def test_all_pairs_of_parts_are_met():
    assert len(set(itertools.combinations(range(spelling.PARTS), spelling.PARTS - 2))) == 28
