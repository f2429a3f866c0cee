"""The operators on documents with odd cases and against brute-force versions."""

from __future__ import annotations

import collections
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from llm_by_hand import lines_by_hand
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medialake.llm import ann, golay, hamming_search, language, licenses, line_dedup, lm_score, mixing, near_copies, packing, personal_data, simhash
from medialake.llm.tokens import ChunkTokenizer, slices, vocabulary_path
from medialake.plans.shared import shared_dir, table

DATA = "/root/testdata/sf0.001"


def by_id(frame, *columns):
    found = collections.defaultdict(list)
    for r in frame.collect():
        found[r[0]].append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return found


# 1: packing


@pytest.mark.parametrize("alphabet", ["abcABC'éÉßÀñ.,;:!?-% 12\n\t<|>endoftext", "İΣσςＡ́ẞ\x0b\x1c \x85ŉǰa'S t"])
def test_chunks_give_the_tokenizers_ids(alphabet):
    tokenizer, draw = ChunkTokenizer(vocabulary_path("word_bpe_49k.json")), random.Random(5)
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["hello <|endoftext|> world", "<|startoftext|>a<|EndOfText|>b", "x<|endoftext|><|startoftext|>", "<|endoftext", "Ünï<|startoftext|> \n"]
    draw.shuffle(texts)
    plain = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    counts, flat = tokenizer.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts):
        assert plain.encode(text, add_special_tokens=False).ids == flat[at : at + n].tolist()
        at += n


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 100, 3, 0, 50)])
    assert [s for s in slices(texts, 60)] == [(0, 2), (2, 1), (3, 3)]


def check_packing(found: pd.DataFrame, capacity: int):
    found = found.sort_values(["sequence_id", "offset"])
    ends = found["offset"] + found["length"]
    assert ((ends.groupby(found["sequence_id"]).shift(fill_value=0)) == found["offset"]).all() and ends.max() <= capacity


def test_packing_makes_ids_of_few_texts_at_a_time(spark, monkeypatch):
    """What a task holds follows the slices: of 12 MB no more than 2 MB at once, and memory of a slice goes before the next."""
    texts = pa.array([f"some words of document {k} " * 400 for k in range(1200)])
    tokenizer, seen, released, spared = packing.chunk_tokenizer(packing.vocabulary_path(packing.VOCABULARY)), [], [], pa.default_memory_pool()

    class Watched:
        def encode(self, some):
            seen.append(sum(map(len, some.to_pylist())))
            return tokenizer.encode(some)

    class Pool:
        def release_unused(self):
            released.append(len(seen))
            spared.release_unused()

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, cut, schema):
            return cut(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc_id", "text"])]))

    monkeypatch.setattr(packing, "chunk_tokenizer", lambda path: Watched())
    monkeypatch.setattr(packing.pa, "default_memory_pool", Pool)
    found = pa.Table.from_batches(packing.token_pieces(Docs()))
    assert sum(seen) == sum(map(len, texts.to_pylist())) > 12_000_000 and max(seen) <= 2 << 20 and released == list(range(1, len(seen) + 1))
    counts, _ = tokenizer.encode(texts)
    assert found.group_by("doc_id").aggregate([("length", "sum")]).sort_by("doc_id")["length_sum"].to_pylist() == (counts + 1).tolist()


def test_packing_of_odd_documents(spark, documents, no_documents):
    found = packing.pack_documents(documents).toPandas()
    check_packing(found, 2048)
    tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    wanted = collections.Counter()
    for r in documents.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            wanted[(r["doc_id"], k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    rows = packing.pack_documents(documents).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert collections.Counter(map(tuple, rows)) == wanted
    assert packing.pack_documents(no_documents).isEmpty()


def test_sequences_hold_the_pieces_ids(spark):
    docs = table(spark, DATA, "documents").where("doc_id < 30")
    placed = packing.pack_documents(docs)
    sequences = packing.build_sequences(docs, placed).collect()
    lengths = dict(placed.groupBy("sequence_id").agg(F.sum("length")).collect())
    assert {r["sequence_id"]: len(r["ids"]) for r in sequences} == lengths


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_items_and_reaches_the_bound(seed):
    draw = np.random.default_rng(seed)
    parts = []
    for _ in range(12):  # sequences that fill up exactly
        cuts = np.sort(draw.choice(np.arange(1, 100), draw.integers(1, 5), replace=False))
        parts += np.diff(np.r_[0, cuts, 100]).tolist()
    lengths = np.array(draw.permutation(parts))
    bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in bins) and len(bins) <= 13
    single = [[i] for i in range(len(lengths))]
    assert len(packing.local_search(single, lengths, 100)) <= len(lengths) * 2 // 3


def test_exchanges_empty_a_sequence_that_best_fit_leaves():
    lengths = np.array([6, 5, 4, 4, 3, 3, 3, 2])  # best fit: 6 4 | 5 4 | 3 3 3 | 2; two sequences of 10 and one of 10 hold all
    started = [[0, 3], [1, 2], [4, 5, 6], [7]]
    ended = packing.local_search([list(b) for b in started], lengths, 10)
    assert len(ended) == 3 and all(lengths[b].sum() == 10 for b in ended)


def test_local_search_grows_with_its_sequences():
    """Pieces that never fit together cost a look each, not a comparison with all others."""
    draw = np.random.default_rng(1)
    lengths = draw.integers(1030, 2000, 60_000)
    began = time.time()
    assert len(packing.local_search(packing.best_fit(lengths, 2048), lengths, 2048)) == len(lengths)
    assert time.time() - began < 30


# 2: line dedup


def test_a_text_of_very_many_lines(spark):
    """200,000 lines, of which every other one is dropped, in time linear in the lines."""
    lines = [f"line number {k} that is long enough to be counted here" for k in range(200_000)]
    docs = [(k, "\n".join(lines[::2])) for k in range(4)] + [(9, "\n".join(lines)), (10, "\n".join(lines[::2]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    began = time.time()
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    assert found[9]["text"] == "\n".join(lines[1::2]) and found[9]["n_lines"] == 200_000 and found[9]["n_dropped"] == 100_000
    assert found[10]["n_dropped"] == 0 and found[0]["text"] == "" and time.time() - began < 60


def test_line_dedup_of_odd_documents(documents, no_documents):
    found = line_dedup.dedup_lines(documents)
    assert [c for c in documents.columns if c not in found.columns] == [] and len(found.columns) == len(set(found.columns))
    wanted = lines_by_hand([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()) == wanted
    assert sum(n * k[3] for k, n in wanted.items()) == 5
    assert line_dedup.dedup_lines(no_documents).isEmpty()


def test_line_keys_lower_only_ascii(spark):
    lines = ["É" + "a" * 40, "é" + "A" * 40]
    docs = spark.createDataFrame([(k, lines[0]) for k in range(5)] + [(9, lines[1])], "doc_id long, text string")
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 9: 0}


# 3: licenses


def test_licenses_of_odd_documents(documents, no_documents):
    found = by_id(licenses.scan_licenses(documents), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert found[1] == found[2] == found[3] == [(0, 0, None, None, "", "", 0.0)]
    assert found[13][0][1:] == (2, 12, 15, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert found[5][0][0] == 30_000 and len(found[6]) == 2
    assert licenses.scan_licenses(no_documents).isEmpty()


def test_every_base_place_is_found(spark):
    draw = random.Random(4)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "Cc", "BY,", "licensed", "under"]
    docs = [(k, " ".join(draw.choice(vocabulary) for _ in range(60))) for k in range(120)]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, text in docs:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(label, i) for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = sorted(i for _, i in places)
        r = found[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places})))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_notices_need_their_key_phrases(spark):
    docs = [(1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under the apache licence version 2 0"), (3, "This work is licensed under the GNU General Public License, version 3.")]
    found = by_id(licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")), "labels")
    assert found == {1: ["apache-2.0"], 2: [""], 3: ["gpl,gpl-3.0"]}


def test_every_notice_of_a_file_is_found(spark):
    text = " filler words between ".join(" ".join(t.words) for t in licenses.TEMPLATES)
    frame = spark.createDataFrame([(1, text), (2, "copy charge domain forms modify mozilla affero lesser apache permitted unencumbered"), (3, text)], "doc_id long, text string")
    found = by_id(licenses.scan_licenses(frame), "labels")
    assert set(found[1][0].split(",")) == set(found[3][0].split(",")) == {t.label for t in licenses.TEMPLATES} and found[2] == [""]


def test_matches_are_those_of_every_place_by_hand(spark):
    """Notices with up to two fifths of their words changed, against a comparison of every template at every place."""
    draw, docs = random.Random(9), []
    words = sorted({w for t in licenses.TEMPLATES for w in t.words})
    for k, template in enumerate(licenses.TEMPLATES * 3):
        own = list(template.words)
        for at in draw.sample(range(len(own)), int(len(own) * draw.choice([0, 0.1, 0.24, 0.26, 0.4]))):
            own[at] = draw.choice(words)
        around = [draw.choice(words) for _ in range(draw.randint(0, 40))]
        docs.append((k, " ".join(around + own[draw.choice([0, 0, 2]) :] + around[:5])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(table(spark, DATA, "documents").selectExpr("doc_id + 10000", "text").toDF("doc_id", "text"))
    found = {r["doc_id"]: {(m["label"], m["start"], round(m["coverage"], 9)) for m in r["matches"]} for r in licenses.scan_licenses(frame).collect()}
    for row in frame.collect():
        text, wanted = [w.decode() for w in licenses.words_of(row["text"] or "")], set()
        for t in licenses.TEMPLATES:
            n = len(t.words)
            for start in range(-n + 1, len(text)):
                part = [text[k] if 0 <= k < len(text) else "" for k in range(start, start + n)]
                same = sum(a == b for a, b in zip(part, t.words)) / n
                if same >= (1 if t.base else 0.75) and all(any(tuple(part[k : k + len(p)]) == p for k in range(n)) for p in t.phrases):
                    wanted.add((t.label, start, round(same, 9)))
        assert found[row["doc_id"]] == wanted


# 4: mixing


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    draw = random.Random(seed)
    docs = [(k, "w " * draw.randint(0, 60), draw.choice(["a", "b", "c", "d", None] + ["e"] * (seed * 9))) for k in range(3000)]
    found = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), bucket_rows=500).toPandas()
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += len(text.split())
    for source, target in targets_by_hand(dict(sizes)).items():
        rows = found[found["source"].isna()] if source is None else found[found["source"] == source]
        assert math.isclose(rows["target"].iloc[0], target, rel_tol=1e-9) and (rows["source_size"] == sizes[source]).all()
        assert abs(rows["taken"].sum() - target) <= 60 and (rows["taken"] <= 3 * rows["size"]).all()
        kept = rows[(rows["size"] > 0) & (rows["rate"] < 3 - 1e-9)]
        if len(kept) > 2:  # exponentially tilted: the logarithm of the rate is linear in size
            ratio = np.log(kept["rate"]) / kept["size"]
            assert np.allclose(ratio, ratio.iloc[0], rtol=1e-6, atol=1e-12)


def test_mix_of_odd_documents(documents, no_documents):
    first, second = ([tuple(r) for r in mixing.mix_sources(documents).select("doc_id", "size", "taken", "target").collect()] for _ in range(2))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(first, key=key) == sorted(second, key=key) and len(first) == documents.count()
    assert mixing.mix_sources(no_documents).isEmpty()
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns and mixing.mixed_documents(no_documents).isEmpty()
    taken = collections.Counter()
    for r in mixing.mix_sources(documents).collect():
        taken[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +taken


def test_rates_do_not_depend_on_partitions(spark):
    """Sums of the Newton steps are free of order: rates and copies agree to the last bit."""
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 200), draw.choice("aaab")) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted(tuple(r) for r in mixing.mix_sources(frame.repartition(parts)).select("doc_id", "rate", "target", "copies").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0] == found[1]


# 5: language


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    hidden = docs.withColumn("known", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    found = language.identify(language.document_rows(hidden, "doc_id", "known")).where("declared is null").toPandas()
    assert len(found) > 300 and (found["language"] == found["known"]).mean() > 0.98 and found["accepted"].mean() > 0.98


def languages_by_hand(rows, sample_all=True):
    """(language, posterior) of (text, declared, host, suffix) rows by plain loops; every declared row is in the sample."""
    blank = lambda b: not (97 <= b <= 122 or b >= 128)

    def buckets(text):
        data = (text or "").lower().encode() + b"  "
        out = []
        for a, b, c in zip(data, data[1:], data[2:]):
            a, b, c = (32 if blank(x) else x for x in (a, b, c))
            if a != 32 or b != 32:
                out.append(((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16)
        return out, sum(not blank(x) for x in data)

    read = [buckets(t) for t, *_ in rows]
    names = sorted(n for n, k in collections.Counter(r[1] for r in rows if r[1]).items() if k >= 10)
    tables = []
    for name in names:
        seen = np.zeros(1 << 16)
        for (found, _), row in zip(read, rows):
            if row[1] == name:
                np.add.at(seen, found, 1)
        tables.append((seen + 1) / (seen.sum() + (1 << 16)))
    tables.append(0.1 * np.mean(tables, axis=0) + 0.9 / (1 << 16))
    logs = [np.log(t) for t in tables]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    scores = [np.array([t[f].sum() for t in logs]) * min(len(f), 60) / max(len(f), 1) for f, _ in read]
    ps = [soft(x) if letters else None for x, (_, letters) in zip(scores, read)]
    n = len(tables)
    total = lambda pick: sum((p for p, r in zip(ps, rows) if p is not None and pick(r)), np.zeros(n))
    overall = (total(lambda r: True) + 1) / (total(lambda r: True).sum() + n)
    domain = lambda h: (re.search(r"([^.]+\.[^.]+)$", h) or [""])[0]
    smooth = lambda own, to, w: (own + w * to) / (own.sum() + w)
    hosts = {h: total(lambda r, h=h: r[2] == h) for h in {r[2] for r in rows if r[2] is not None}}
    domains = {d: sum((own for h, own in hosts.items() if domain(h) == d), np.zeros(n)) for d in map(domain, hosts)}

    def rates(column):
        own = {v: total(lambda r, v=v: r[column] == v) for v in {r[column] for r in rows if r[column] is not None}}
        own = {v: x for v, x in own.items() if x.sum() > 0}
        every = sum(own.values(), np.zeros(n)) + 0.5 * len(own)
        return {v: np.log((x + 0.5) / every) for v, x in own.items()}

    declared, suffix = rates(1), rates(3)
    result = []
    for score, (_, letters), row in zip(scores, read, rows):
        host = hosts.get(row[2])
        prior = np.log(overall) if host is None or not host.sum() else np.log(smooth(host, smooth(domains[domain(row[2])], overall, 50), 20))
        p = soft(score + prior + declared.get(row[1], 0) + suffix.get(row[3], 0))
        result.append((([*names, None])[p.argmax()], p.max(), bool(letters and p.max() >= 0.5 and p.argmax() < len(names))))
    return result


def test_languages_are_those_of_plain_loops(spark):
    docs = table(spark, DATA, "documents").withColumn("page_id", F.lit(None).cast("long"))
    pages = table(spark, DATA, "pages").withColumn("doc_id", F.lit(None).cast("long"))
    rows = language.document_rows(docs, "doc_id", "page_id").unionByName(language.page_rows(pages, "doc_id", "page_id"))
    rows = rows.unionByName(spark.createDataFrame([(9000, None, "Привет, как дела сегодня у вас дома", "en", "h.example.org", None), (9001, None, "xq zzkw vvqj kkzx qqwv jjxz zqkx vwjq", None, None, None), (None, 9002, None, None, None, None)], rows.schema))
    found = {(r["doc_id"], r["page_id"]): r for r in language.identify(rows).collect()}
    given = rows.withColumns({"declared": language._subtag(F.col("declared")), "host": F.lower("host")}).collect()
    wanted = languages_by_hand([(r["text"], r["declared"], r["host"], r["suffix"]) for r in given])
    for row, (name, posterior, accepted) in zip(given, wanted):
        own = found[row["doc_id"], row["page_id"]]
        assert math.isclose(own["posterior"], posterior, rel_tol=1e-3) and own["accepted"] == accepted
        assert own["language"] == name or posterior < 0.51
    assert found[9000, None]["language"] is None and not found[9000, None]["accepted"] and not found[9001, None]["accepted"]


def test_every_declared_language_is_fitted(spark):
    """Ten rows in two thousand are a language; a text repeated under many ids does not take the sample."""
    rows = [(k, "the same words again and again", "en", None, None) for k in range(2000)] + [(5000 + k, f"ich und der hund {k}", "de", None, None) for k in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    names, table_ = language.fit_text_model(frame, 100)
    assert names == ["de", "en"] and table_.shape == (3, (1 << 16) + 1)


def test_declared_languages_and_hosts_settle_short_texts(spark):
    long_texts = [(k, t, la, f"{la}.example.org") for k, (t, la) in enumerate([("the quick brown fox and the lazy dog", "en"), ("der schnelle braune fuchs und der hund", "de")] * 40)]
    short = [(1000, "ok", "de", "de.example.org"), (1001, "up", None, "en.example.org"), (1002, "12 34", "en", "en.example.org"), (1003, None, "en", None)]
    rows = spark.createDataFrame(long_texts + short, "doc_id long, text string, declared string, host string").withColumn("suffix", F.lit(None).cast("string"))
    found = by_id(language.identify(rows), "language", "accepted")
    assert found[1000] == [("de", True)] and found[1001] == [("en", True)]
    assert not found[1002][0][1] and not found[1003][0][1]


def test_language_of_odd_documents(documents, no_documents):
    found = by_id(language.identify(language.document_rows(documents, "doc_id")), "accepted")
    assert not any(found[1] + found[2] + found[3]) and all(found[6])
    kept = language.accepted_documents(documents)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6, 8}
    assert language.accepted_documents(no_documents).isEmpty()


def test_pages_give_their_evidence(spark):
    html = '<html lang="fr-CA"><script>var the = 1</script><p>bonjour <b>le</b> monde</p></html>'
    row = language.page_rows(spark.createDataFrame([(1, "https://www.site.fr/fr/x?y", html)], "page_id long, url string, html string"), "page_id").first()
    assert (row["declared"], row["host"], row["suffix"]) == ("fr-CA", "www.site.fr", "fr/fr") and row["text"].split() == ["bonjour", "le", "monde"]


# 6: nearest neighbours


def vectors(spark, seed=1, n=700, dims=16):
    draw = np.random.default_rng(seed)
    found = [(k, [float(x) for x in draw.normal(size=dims)]) for k in range(n)]
    found += [(n + k, found[7][1]) for k in range(40)]  # copies
    odd = [(5000, None), (5020, [0.0] * dims), (5040, [float("nan")] * dims), (5060, [float("inf")] + [0.0] * (dims - 1)), (5080, [None] * dims), (5100, [1.0]), (None, [1.0] * dims)]
    return spark.createDataFrame(found + odd, "vec_id long, embedding array<double>"), dict(found)


def test_neighbours_are_the_nearest(spark):
    frame, known = vectors(spark)
    found = by_id(ann.nearest(frame, shard=300), "rank", "vec_id", "score")
    ids = np.array(list(known))
    exact = np.array(list(known.values()))
    hits = 0
    assert set(found) == {i for i in known if i % 20 == 0}
    for query, rows in found.items():
        scores = exact @ exact[query]
        order = [int(i) for i in ids[np.lexsort((ids, -scores))] if i != query][:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert all(math.isclose(r[2], scores[r[1]], rel_tol=1e-12, abs_tol=1e-12) for r in rows)
        hits += len({r[1] for r in rows} & set(order))
    assert hits >= 0.95 * 20 * len(found)


def test_beam_finds_the_nearest_of_queries_from_other_shards():
    """Queries that are no points of the graph, as most are where there are many shards, against brute force."""
    points = np.random.default_rng(4).standard_normal((4296, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    queries, points = points[:200], points[200:]
    layers = ann.build_graph(np.c_[points, np.zeros(len(points))].astype(np.float32))
    wanted = np.argsort(-(queries @ points.T), axis=1, kind="stable")[:, :20]
    found = ann.search_graph(points, layers, queries, ann.BEAM)
    hits = sum(len(np.intersect1d(sorted(f[f >= 0], key=lambda k: -(points[k] @ q))[:20], w)) for f, q, w in zip(found, queries, wanted))
    assert hits >= 0.985 * wanted.size


def clusters(draw, size, sigma, n=8192):
    centres = draw.standard_normal((n // size + 1, 64))
    return (np.repeat(centres, size, axis=0) + sigma * draw.standard_normal((len(centres) * size, 64)))[:n]


def of_lengths(draw, n=8192):
    points = draw.standard_normal((n, 64))
    return points / np.linalg.norm(points, axis=1, keepdims=True) * np.exp(draw.standard_normal((n, 1)))


@pytest.mark.parametrize("make", [lambda d: clusters(d, 300, 0.02), lambda d: clusters(d, 100, 0.1), lambda d: d.standard_normal((8192, 64)), of_lengths], ids=["clusters of 300", "clusters of 100", "normal", "log-normal lengths"])
def test_no_query_of_a_full_shard_is_lost(make):
    """Recall at 20 against brute force over clusters larger than the list of candidates and over spread lengths."""
    draw = np.random.default_rng(11)
    points = draw.permutation(make(draw))
    square = (points**2).sum(axis=1)
    layers = ann.build_graph(np.c_[points, np.sqrt(square.max() - square)].astype(np.float32))
    queries = points[:400]
    wanted = np.argsort(-(queries @ points.T), axis=1, kind="stable")[:, :20]
    found = ann.search_graph(points.astype(np.float32), layers, queries.astype(np.float32), ann.BEAM)
    hits = np.array([len(np.intersect1d(sorted(f[f >= 0], key=lambda k: -(points[k] @ q))[:20], w)) for f, q, w in zip(found, queries, wanted)])
    assert hits.mean() >= 0.98 * 20 and hits.min() >= 10


def test_vectors_of_extreme_lengths(spark):
    """Components near the ends of the double range are neighbours like any other; products beyond it are infinite."""
    frame = spark.createDataFrame([(0, [1e150, 0.0]), (1, [1e150, 1e150]), (2, [1e-150, 0.0]), (20, [0.0, 1e-200])], "vec_id long, embedding array<double>")
    found = {k: [v[1] for v in sorted(rows)] for k, rows in by_id(ann.nearest(frame), "rank", "vec_id").items()}
    assert found[0][:2] == [1, 2] and found[20][0] == 1 and all(len(rows) == 3 for rows in found.values())


def test_shards_grow_with_the_queries_up_to_a_bound():
    sizes = [ann.shard_size(n) for n in (0, 500, 50_000, 5_000_000, 5_000_000_000)]
    assert sizes == sorted(sizes) and sizes[0] == ann.LEAST_SHARD and sizes[-1] == ann.MOST_SHARD


def test_repeated_rows_of_vectors(spark):
    """Queries that repeat a row are one; rows of the query's id other than its own are candidates; clashing columns."""
    draw = np.random.default_rng(3)
    rows = [(k, [float(x) for x in draw.normal(size=8)]) for k in range(120)]
    rows += [rows[0], rows[5], rows[5], (20, [float(x) for x in draw.normal(size=8)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vec", "query", "rank", "shard", "block")})
    found = [tuple(r) for r in ann.nearest(frame, shard=50).collect()]
    wanted = []
    seen = set()
    for at, (i, v) in enumerate(rows):
        if i % 20 == 0 and (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            order = sorted((-float(np.cumsum(np.array(v) * np.array(w))[-1]), j) for b, (j, w) in enumerate(rows) if b != at)[:20]
            wanted += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    assert sorted(found) == sorted(wanted)


def test_few_vectors_give_all_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {k: [v[1] for v in sorted(rows)] for k, rows in by_id(ann.nearest(frame), "rank", "vec_id").items()} == {0: [3, 20], 20: [3, 0]}
    assert ann.nearest(frame.where("vec_id > 90")).isEmpty()


# 7: simhash


def test_near_fingerprints_share_a_golay_number():
    draw = np.random.default_rng(3)
    words = draw.integers(0, 1 << 23, 4000)
    assert np.array_equal(np.bincount(golay.nearest_codeword(), minlength=4096), np.full(4096, 2048))
    for flips in (1, 2):
        other = words.copy()
        for k in range(len(words)):
            for bit in draw.choice(23, flips, replace=False):
                other[k] ^= 1 << bit
        mine, theirs = golay.nearby_codewords(words, 23), golay.nearby_codewords(other, 23)
        assert all(set(a) & set(b) for a, b in zip(mine.tolist(), theirs.tolist()))


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [16, 2])
def test_components_of_fingerprints(spark, documents, no_documents, bucket):
    draw, docs, k = random.Random(bucket), [], 100
    for _ in range(12):
        base = [f"w{draw.randint(0, 999)}" for _ in range(400)]
        for _ in range(25):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(400)] = f"x{draw.randint(0, 999)}"
            docs.append((k, " ".join(words)))
            k += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    rows = [(r["doc_id"], print_by_hand(r["text"])) for r in frame.collect()]
    prints = sorted({fp for _, fp in rows})
    parent = {fp: fp for fp in prints}

    def root(fp):
        while parent[fp] != fp:
            fp = parent[fp]
        return fp

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[root(fp)] = min(i, least.get(root(fp), i))
    found = simhash.near_duplicates(frame, bucket=bucket).collect()
    wanted = collections.Counter((i, fp, least.get(root(fp))) for i, fp in rows)
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == wanted
    assert simhash.near_duplicates(no_documents).isEmpty()


@pytest.mark.parametrize("bucket", [6, 2])
def test_near_copies_leave_one_of_each(spark, documents, no_documents, bucket):
    draw, docs, k = random.Random(8), [], 100
    for size in (3, 10, 60):
        base = [f"w{draw.randint(0, 9999)}" for _ in range(200)]
        for _ in range(size):
            words = list(base)
            words[draw.randrange(200)] = f"x{draw.randint(0, 999)}"
            docs.append((k, " ".join(words), "en", "a", 1))
            k += 1
    docs += [(k + j, " ".join(f"v{draw.randint(0, 9999)}" for _ in range(80)), "en", "a", 1) for j in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in near_copies.keep_one_of_each(frame, bucket=bucket).collect())
    assert kept == [100, 103, 113, *range(173, 223)]
    odd = near_copies.keep_one_of_each(documents, bucket=bucket)
    assert odd.columns == documents.columns
    # 10, 11 and 12 are short texts of similarity 0.75 to 0.86: they may stay or go but for the first.
    assert {r["doc_id"] or 0 for r in odd.collect()} - {11, 12} == {0, 1, 4, 5, 6, 8, 9, 10, 13}
    assert near_copies.keep_one_of_each(no_documents).isEmpty()


def test_near_copies_move_texts_by_outlines_and_leave_none_behind(spark):
    """Pairs that short bitmaps let pass and that are not similar go before their texts meet; stored texts go with their step."""
    words = [f"w{k}" for k in range(3000)]
    texts = [(0, words), (1, [*words[:-1], "end"]), (2, [f"x{k}" if k % 14 == 0 else w for k, w in enumerate(words)])]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc long, text string")
    sets = [near_copies.shingle_set(" ".join(t)) for _, t in texts]
    close = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    short = spark.createDataFrame([(i, len(s), *np.packbits(np.isin(np.arange(512), (s % np.uint64(512)).astype(int))).view(np.int64).tolist()) for i, s in enumerate(sets)], "doc long, n int, " + ", ".join(f"{b} long" for b in near_copies.BITMAP))
    assert near_copies._allowed(close, short, 0.8).count() == 3
    allowed = near_copies._outlines_allow(close, near_copies._outlines(frame), 0.8)
    assert [(r["a"], r["b"]) for r in allowed.collect()] == [(0, 1)]
    assert [(r["a"], r["b"]) for r in near_copies._verified(close, short, frame, 0.8).collect()] == [(0, 1)]
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("medialake-*"))
    assert near_copies.keep_one_of_each(frame.withColumnRenamed("doc", "doc_id")).count() == 2
    made = set(Path(shared_dir(spark).removeprefix("file:")).glob("medialake-*")) - before
    assert made and not any("text" in spark.read.parquet(str(p)).columns for p in made)


def test_mixing_moves_texts_once(spark, documents):
    """Nothing is exchanged between the join of texts with their copies and the window over equal rows."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = mixing.mixed_documents(documents)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "Exchange" not in plan[plan.index("Window") : plan.index("SortMergeJoin")]


@pytest.mark.parametrize("bucket", [6, 2])
def test_near_copies_of_every_edit_are_found(spark, bucket):
    """Passages appended, cut off or scattered edits, similarity just above and below 0.8; a shingle that many share."""
    draw, texts = random.Random(11), []
    for n in (40, 120, 400):
        for _ in range(25):
            base = [f"w{draw.randint(0, 10**7)}" for _ in range(n)]
            more = [f"w{draw.randint(0, 10**7)}" for _ in range(int(n * draw.uniform(0.12, 0.27)))]
            spread = list(base)
            for at in draw.sample(range(n), max(1, int(n * draw.uniform(0.01, 0.025)))):
                spread[at] = f"x{draw.randint(0, 10**7)}"
            cut = base[: int(n * draw.uniform(0.78, 0.9))]
            texts += [" ".join(t) for t in draw.sample([base, draw.choice([base + more, cut, spread])], 2)]
    head = [f"h{j}" for j in range(60)]
    texts += [" ".join(head + [f"w{draw.randint(0, 10**7)}" for _ in range(draw.choice([5, 14, 60]))]) for _ in range(60)]
    texts += [" ".join(head[j:] + head[:j]) for j in range(0, 60, 2)]
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for b in range(len(sets)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_each(frame, bucket=bucket).collect()) == [i for i in range(len(sets)) if root(i) == i]


def test_one_row_of_a_repeated_id_stays(spark):
    """Rows of an id that goes all go, one row of an id that stays; clashing columns are kept."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "x"), (1, text + " more", "y"), (2, text, "x"), (2, text, "x"), (3, "other words entirely", "z"), (3, "other words entirely", "z"), (None, text, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumn("kept", F.lit(1)).withColumn("doc", F.lit(2))
    found = near_copies.keep_one_of_each(frame)
    assert found.columns == frame.columns
    assert sorted((r["doc_id"] or 0) for r in found.collect()) == [0, 1, 3]


# 8: personal data


def base_by_hand(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        found += [("card", *m.span())] * (13 <= len(digits) <= 19 and total % 10 == 0)
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choice("ab@@..+-%01 2345() é\n:/\u0660") for _ in range(draw.randint(0, 40)))
        assert [s for s in personal_data.personal_spans(text) if s[0] in personal_data.BASE_KINDS] == base_by_hand(text)
    assert [s[0] for s in personal_data.personal_spans("4111 1111 1111 1111 and 0" + "1" * 14)] == ["card"]
    assert len(personal_data.personal_spans("9" * 100_000 + "@")) == 0


def test_spans_beyond_the_base():
    text = 'IBAN: DE89 3704 0044 0532 0130 00, token = "0123456789", see https://a.b/c.'
    assert [(k, text[a:b]) for k, a, b in personal_data.personal_spans(text)] == [("iban", "DE89 3704 0044 0532 0130 00"), ("secret", "0123456789"), ("url", "https://a.b/c")]


def test_personal_data_of_odd_documents(documents, no_documents):
    found = by_id(personal_data.find_personal_data(documents), "spans")
    assert found[1] == found[2] == [[]] and [s["kind"] for s in found[13][0]] == ["email", "phone"]
    assert personal_data.find_personal_data(no_documents).isEmpty()
    assert by_id(personal_data.redact(documents.select("doc_id", "text")), "text")[13] == ["mail <email> or call <phone>, all rights reserved, cc by 4.0"]


# 9: language models


@pytest.mark.parametrize("top", [300, 1_000_000])
def test_scores_are_those_of_the_models(spark, top):
    """Every document against counts by hand; thousands of rare words; entries that are broadcast and entries that are looked up."""
    draw = random.Random(5)
    docs = table(spark, DATA, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(10_000 + k, " ".join(f"rare{draw.randint(0, 2500)} and" for _ in range(60))) for k in range(100)], "doc_id long, text string")
    )
    labels = table(spark, DATA, "labels").select("doc_id", (F.col("quality") == 1).alias("target"))
    texts = [(r["doc_id"], lm_score.words_of(r["text"])) for r in docs.collect()]
    wanted = {r["doc_id"] for r in labels.collect() if r["target"]}
    counts = collections.Counter(w for _, ws in texts for w in ws)
    known = {w for w, n in counts.items() if n >= 5}
    assert len(counts) - len(known) > 2000
    chains = [(i, ["<e>", *(w if w in known else "<u>" for w in ws), "<e>"]) for i, ws in texts]
    size, back = len(known) + 2, 2.0
    pairs = [collections.Counter(p for i, c in chains if all_ or i in wanted for p in zip(c, c[1:])) for all_ in (False, True)]
    kept = {p for p, n in pairs[1].items() if n >= 5 and "<u>" not in p}

    def loss(model, a, b, context, single, total):
        share = (single[b] + 1) / (total + size)
        if a == "<u>":
            return -math.log(share)
        return -math.log(((model[a, b] if (a, b) in kept else 0) + back * share) / (context[a] + back))

    tables = []
    for model in pairs:
        context, single = collections.Counter(), collections.Counter()
        for (a, b), n in model.items():
            context[a] += n
            single[b] += n
        tables.append((model, context, single, sum(single.values())))
    found = {r["doc_id"]: r for r in lm_score.score_documents(docs, labels, top=top).collect()}
    assert len(found) == len(chains)
    for i, chain in chains:
        means = [sum(loss(m, a, b, c, s, t) for a, b in zip(chain, chain[1:])) / (len(chain) - 1) for m, c, s, t in tables]
        assert math.isclose(found[i]["target_loss"], means[0], rel_tol=1e-9) and math.isclose(found[i]["score"], means[0] - means[1], abs_tol=1e-9)
        assert found[i]["n_tokens"] == len(chain) - 1


def test_scores_of_odd_documents(spark, documents, no_documents):
    labels = spark.createDataFrame([(6, True), (6, False), (8, None), (None, True)], "doc_id long, target boolean")
    found = by_id(lm_score.score_documents(documents, labels), "n_tokens", "score")
    assert found[1][0][0] == 1 and len(found[6]) == 2 and all(math.isfinite(s) for rows in found.values() for _, s in rows)
    assert lm_score.score_documents(no_documents, labels).isEmpty()
    assert lm_score.score_documents(documents, labels.where("false")).count() == documents.count()


def test_scores_do_not_depend_on_parts_and_hot_words(spark):
    """Many parts, most bigrams dealt by both words, few words broadcast, repeated rows: the same scores as by one way, and again in a rerun."""
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "a b a b"), (-7, None)], "doc_id long, text string"))
    labels = table(spark, DATA, "labels").select("doc_id", (F.col("quality") == 1).alias("target"))
    wanted, *others = ([sorted((r["doc_id"] or -1, *r[1:]) for r in lm_score.score_documents(docs, labels, **how).collect()) for how in ({}, {"top": 20, "part_tokens": 2000}, {"top": 20, "part_tokens": 2000})])
    assert others[0] == others[1] and len(wanted) == docs.count()
    for row, other in zip(wanted, others[0], strict=True):
        assert row[:2] == other[:2] and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(row[2:], other[2:]))


def test_scoring_moves_few_bytes_a_token(spark):
    """Nearly every bigram occurs once: counting and looking up together move no more than packed bigrams take (20 bytes before)."""
    draw = np.random.default_rng(7)
    rows = [(k, " ".join(f"w{x}" for x in draw.integers(0, 20_000, 5000))) for k in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, target boolean")

    def moved() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = moved()
    assert lm_score.score_documents(docs, labels).selectExpr("sum(n_tokens)").first()[0] == 200 * 5001
    assert 1_000_000 < moved() - before < 14 * 200 * 5001


# 10: exact top k


@pytest.mark.parametrize("dims", [9, 16, 64])
def test_top_k_is_exact(spark, dims):
    frame, known = vectors(spark, dims, 500, dims)
    code = {i: sum(1 << k for k, x in enumerate(v) if x >= 0) for i, v in known.items()}
    found = by_id(hamming_search.top_k(frame, 10, 100), "rank", "vec_id", "distance")
    assert set(found) == {i for i in known if i % 100 == 0}
    for query, rows in found.items():
        wanted = sorted(((code[query] ^ c).bit_count(), i) for i, c in code.items() if i != query)[:10]
        assert sorted(rows) == [(k + 1, i, d) for k, (d, i) in enumerate(wanted)]


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in hamming_search.top_k(frame).collect()] == [(0, 1, 1, 1)]
    assert hamming_search.top_k(frame.where("vec_id > 5")).isEmpty()


def test_top_k_of_repeated_rows_and_clashing_columns(spark):
    """A query whose own row stands forty times still has all its neighbours; of two codes of an id the smaller counts."""
    frame, known = vectors(spark, 5, 300, 16)
    again = frame.where("vec_id in (0, 3, 200)").withColumn("times", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("times")
    other = spark.createDataFrame([(9, [1.0] * 16), (100, [-1.0] * 15 + [1.0])], frame.schema)
    named = ["id", "vec", "code", "ids", "query", "distance", "rank", "segment", "value", "mask", "bound", "dims"]
    wide = frame.unionByName(again).unionByName(other).select("*", *[F.lit("x").alias(c) for c in named])
    code = {i: sum(1 << k for k, x in enumerate(v) if x >= 0) for i, v in known.items()}
    code |= {9: min(code[9], (1 << 16) - 1), 100: min(code[100], 1 << 15)}
    found = by_id(hamming_search.top_k(wide, 10, 100), "rank", "vec_id", "distance")
    assert set(found) == {i for i in known if i % 100 == 0}
    for query, rows in found.items():
        wanted = sorted(((code[query] ^ c).bit_count(), i) for i, c in code.items() if i != query)[:10]
        assert sorted(rows) == [(k + 1, i, d) for k, (d, i) in enumerate(wanted)]
