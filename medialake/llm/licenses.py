"""License scans with a positional rare-token index (operator 3).

The templates are public notices, short and whole, identifiers and the base phrases. A first job counts, over all
documents, in how many each template word stands; the words' inverse document frequencies decide which places
of each template are indexed: so many of the rarest that a match, which may differ in a quarter of the words,
agrees in two of them at least. A second job looks up every indexed word of each file, meets the
template postings by relative position (place in the file less place in the template), compares the
whole template at each place where enough of them agree, and verifies its mandatory key phrases there.
Base phrases are templates all of whose words are mandatory and whose rarest word is indexed,
so every place of theirs is found. The driver only gets one count per template word.

Defined results: a null or empty text has no words, no places and score 0; rows that repeat get equal
results; null doc_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A notice, its label and the phrases that must stand in it word by word."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    base: bool = False


def _notice(label: str, text: str, *phrases: str) -> Template:
    return Template(label, tuple(text.split()), tuple(tuple(p.split()) for p in phrases))


def _base(label: str, phrase: str) -> Template:
    return Template(label, tuple(phrase.split()), (tuple(phrase.split()),), True)


#: Base phrases, one-line notices, whole notices and identifiers of public licences, lower case, words only.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
and this permission notice shall be included in all copies or substantial portions of the software"""
_MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages
or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain
a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under
the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
language governing permissions and limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version {} of the license or at your option any later version"""
_MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
you can obtain one at http mozilla org mpl 2 0"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
redistribute it freely subject to the following restrictions"""
_IDENTIFIERS = (
    "agpl-3.0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "cc0-1.0", "epl-2.0", "gpl-2.0", "gpl-3.0",
    "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mpl-2.0", "unlicense", "zlib",
)
TEMPLATES = (
    _base("cc-by", "cc by"),
    _base("gpl", "general public license"),
    _base("reserved", "all rights reserved"),
    _notice("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    _notice("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    _notice("apache-2.0", _APACHE, "apache license", "except in compliance with the license"),
    _notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", "source and binary forms"),
    _notice("bsd", _BSD, "redistribution and use", "redistributions of source code"),
    _notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _notice("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    _notice("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    _notice("gpl-2.0", _GPL.format(2), "general public license", "either version 2 of the license"),
    _notice("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    _notice("gpl-3.0", _GPL.format(3), "general public license", "either version 3 of the license"),
    _notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    _notice("isc", _ISC, "with or without fee", "appear in all copies"),
    _notice("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    _notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted", "free of charge"),
    _notice("mit", _MIT, "permission is hereby granted", "substantial portions of the software"),
    _notice("mit", _MIT_WARRANTY, "without warranty of any kind", "use or other dealings in the software"),
    _notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _notice("mpl-2.0", _MPL, "mozilla public license", "if a copy of the mpl"),
    _notice("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _notice("unlicense", _UNLICENSE, "free and unencumbered software", "anyone is free to copy"),
    _notice("zlib", _ZLIB, "alter it and redistribute it freely"),
    *(_notice(f"spdx:{name}", f"spdx license identifier {' '.join(re.split('[-.]', name))}", f"spdx license identifier {' '.join(re.split('[-.]', name))}") for name in _IDENTIFIERS),
)
#: Least part of a template that must agree, and indexed places that must agree at least.
COVERAGE = 0.75
AGREED = 2

#: A-Z to a-z; every other byte that ends a word to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,coverage:double>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each template word stands; one number per template word comes back."""
    vocabulary = {w.encode() for t in templates for w in t.words}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(vocabulary.intersection(words_of(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


class RareTokenIndex:
    """Postings (template, place) of each template's rarest places."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int]):
        self.templates = [(t.label, [w.encode() for w in t.words], [[w.encode() for w in p] for p in t.phrases], t.base) for t in templates]
        rarity = {w.encode(): (frequency.get(w, 0), w) for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, words, _, base) in enumerate(self.templates):
            # Where COVERAGE of the words agree, AGREED of so many places do.
            places = sorted(range(len(words)), key=lambda k: (rarity[words[k]], k))[: 1 if base else int((1 - COVERAGE) * len(words) + 1e-9) + AGREED]
            for place in sorted(places):
                self.postings[words[place]].append((number, place))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word in the file, part that agrees) of every accepted place."""
        present = self.postings.keys() & set(words)
        if not present:
            return []
        votes: Counter = Counter()
        for at, word in enumerate(words):
            if word in present:
                votes.update((number, at - place) for number, place in self.postings[word])
        found = []
        for (number, start), agreed in votes.items():
            _, wanted, phrases, base = self.templates[number]
            if agreed < (1 if base else AGREED):
                continue
            part = words[max(0, start) : start + len(wanted)] if start >= 0 else [b""] * -start + words[: start + len(wanted)]
            same = sum(a == b for a, b in zip(part, wanted)) / len(wanted)
            if same >= (1 if base else COVERAGE) and all(_holds(part, p) for p in phrases):
                found.append((number, start, same))
        return found


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[k : k + len(phrase)] == phrase for k in range(len(words) - len(phrase) + 1))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Words, base places, labels, score (best agreement) and matches of every document."""
    frequency = word_frequencies(docs, templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(templates, frequency)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                found = index.scan(words)
                base = sorted(start for number, start, _ in found if templates[number].base)
                base_labels = {templates[number].label for number, _, _ in found if templates[number].base}
                rows.append(
                    {
                        "n_words": len(words), "n_base": len(base), "first_word": base[0] if base else None, "last_word": base[-1] if base else None,
                        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted({templates[number].label for number, _, _ in found})),
                        "score": max((same for _, _, same in found), default=0.0),
                        "matches": sorted(({"label": templates[number].label, "start": start, "coverage": same} for number, start, same in found), key=lambda m: (m["start"], m["label"])),
                    }
                )
            made = pa.Table.from_pylist(rows, _SCHEMA).combine_chunks().to_batches() if rows else []
            for part in made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *part.columns], names=["doc_id", *_SCHEMA.names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, RESULT)


_SCHEMA = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())])))]
)
