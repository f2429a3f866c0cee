"""Best-fit packing by swap-based local search (operator 1).

Documents become token pieces of at most ``capacity`` ids. Pieces that fill a sequence need no
packing. The rest are dealt at random into shards of a fixed number of pieces; each shard is packed
by best fit, longest first, and then improved by local search: pieces are moved, exchanged one for
one or two for one (either way) between underfull sequences so that the sum of squared fills rises
until sequences empty. What is left in underfull sequences of a few dozen shards is packed once more
together. No step sees more than a bounded number of pieces.

Defined results: a null text is an empty one and becomes a piece that holds only the end id; rows
that repeat (the same doc_id again) are packed each on their own; a null doc_id is kept as it is; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.tokens import batches_of, chunk_tokenizer, slices, vocabulary_path
from medialake.plans.shared import stored

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
#: Bytes of text that a task makes ids of at a time: chunks, places and ids take some twenty times as much.
SLICE_BYTES = 2 << 20
#: Pieces of a shard, and shards whose underfull sequences are packed again together.
SHARD_PIECES = 8192
SHARDS_TOGETHER = 64
#: Rounds of the local search over all sequences that can still give.
PASSES = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "row long, sequence_id long, offset long, underfull boolean"


def token_pieces(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """A row for each piece of each document: its place in the document, length and checksum.

    ``with_ids`` adds the ids themselves as ``ids array<int>``.
    """
    path = vocabulary_path(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for first, rows in slices(texts, SLICE_BYTES):
                counts, flat = tokenizer.encode(texts.slice(first, rows))
                own, piece, start, length, crc, ids = [], [], [], [], [], []
                at = 0
                for k, n in enumerate(counts.tolist()):
                    doc = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for j, begin in enumerate(range(0, n + 1, capacity)):
                        some = doc[begin : begin + capacity]
                        own.append(first + k)
                        piece.append(j)
                        start.append(begin)
                        length.append(len(some))
                        crc.append(zlib.crc32(some.tobytes()))
                        if with_ids:
                            ids.append(some.astype(np.int32))
                columns = [keys.take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                del counts, flat
                yield pa.RecordBatch.from_arrays(columns, names=names)
                pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, PIECES + (", ids array<int>" if with_ids else "")
    )


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of item numbers: longest first, each into the fullest sequence that takes it."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = open_gaps >> need
        if fitting:
            gap = need + (fitting & -fitting).bit_length() - 1
            chosen = waiting[gap].pop()
            if not waiting[gap]:
                open_gaps ^= 1 << gap
            bins[chosen].append(item)
        else:
            gap, chosen = capacity, len(bins)
            bins.append([item])
        left = gap - need
        if left:
            waiting[left].append(chosen)
            open_gaps |= 1 << left
    return bins


def _amounts(items: list[int], lengths: np.ndarray) -> dict[int, tuple[int, ...]]:
    """What leaves a sequence by giving one or two of its items: amount -> items."""
    found: dict[int, tuple[int, ...]] = {}
    kinds: dict[int, list[int]] = {}
    for i in items:
        kinds.setdefault(int(lengths[i]), []).append(i)
    for n, of in kinds.items():
        found.setdefault(n, (of[0],))
    sizes = sorted(kinds)
    for k, n in enumerate(sizes):
        for m in sizes[k:]:
            if n != m:
                found.setdefault(n + m, (kinds[n][0], kinds[m][0]))
            elif len(kinds[n]) > 1:
                found.setdefault(n + m, (kinds[n][0], kinds[n][1]))
    return found


class _Offers:
    """What underfull sequences could take in, by the room they would then have: room left now and what they give back."""

    def __init__(self, capacity: int):
        self.rooms: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in range(2)]  # giving back at most one item, two items
        self.bits = [0, 0]
        self.version: dict[int, int] = {}

    def put(self, own: int, room: int, amounts: dict[int, tuple[int, ...]]) -> None:
        version = self.version[own] = self.version.get(own, 0) + 1
        for back, items in ((0, ()), *amounts.items()):
            kind, at = int(len(items) == 2), room + back
            heapq.heappush(self.rooms[kind].setdefault(at, []), (back, own, version))
            self.bits[kind] |= 1 << at

    def drop(self, own: int) -> None:
        self.version[own] = self.version.get(own, 0) + 1

    def _least(self, kind: int, at: int, giver: int) -> tuple[int, int] | None:
        """(amount given back, sequence) with the least amount at a room, of another sequence than the giver."""
        heap, aside = self.rooms[kind][at], []
        while heap and (self.version[heap[0][1]] != heap[0][2] or heap[0][1] == giver):
            top = heapq.heappop(heap)
            if self.version[top[1]] == top[2]:
                aside.append(top)
        found = heap[0][:2] if heap else None
        for top in aside:
            heapq.heappush(heap, top)
        if not heap:
            self.bits[kind] &= ~(1 << at)
        return found

    def best(self, giver: int, amount: int, pair: bool, room: int, limit: int) -> tuple[int, int, int] | None:
        """(gap left, sequence, amount given back) of the closest fit for ``amount`` that raises the sum of squares.

        A sequence with room r that gives back b can take the amount if r + b holds it and the amount is more than b;
        the sum rises if it then has less room than the giver's ``room`` now. Only gaps below ``limit`` are wanted.
        """
        found = None
        for kind in (0,) if pair else (0, 1):
            high = amount + min(room, limit if found is None else found[0])
            left = self.bits[kind] >> amount << amount & (1 << high) - 1
            while left:
                at = (left & -left).bit_length() - 1
                left &= left - 1
                least = self._least(kind, at, giver)
                if least and least[0] < amount:
                    found = (at - amount, least[1], least[0])
                    break
        return found


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, passes: int = PASSES) -> list[list[int]]:
    """Moves and exchanges between underfull sequences, each of which raises the sum of squared fills.

    The emptiest sequence that still can gives to another: an item (move), an item for a smaller one, two
    for a smaller one, or one for two smaller ones, by what leaves the least gap. Offers are found by the room that they
    leave, so a step's cost follows the capacity and not the number of sequences. Stops where the bound shows that no
    sequence can be emptied any more, where no sequence can give, or after ``passes`` rounds over all sequences.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in items) for items in bins]
    live = {b for b, n in enumerate(fill) if n < capacity}
    total = sum(fill[b] for b in live)
    amounts = {b: _amounts(bins[b], lengths) for b in live}
    offers = _Offers(capacity)
    for b in live:
        offers.put(b, capacity - fill[b], amounts[b])
    for _ in range(passes):
        queue = [(fill[b], b) for b in live]
        heapq.heapify(queue)
        moved = False
        while queue and len(live) > -(-total // capacity):
            full, giver = heapq.heappop(queue)
            if giver not in live or full != fill[giver]:
                continue
            room, best, given = capacity - full, None, ()
            for amount, items in sorted(amounts[giver].items(), reverse=True):
                found = offers.best(giver, amount, len(items) == 2, room, best[0] if best else capacity)
                if found:
                    best, given = found, items
                    if not best[0]:
                        break
            if best is None:
                continue
            _, taker, back = best
            returned = amounts[taker][back] if back else ()
            bins[giver] = [i for i in bins[giver] if i not in given] + list(returned)
            bins[taker] = [i for i in bins[taker] if i not in returned] + list(given)
            moved = True
            for b in (giver, taker):
                total -= fill[b]
                fill[b] = sum(size[i] for i in bins[b])
                if fill[b] in (0, capacity):
                    live.discard(b)
                    amounts.pop(b)
                    offers.drop(b)
                else:
                    total += fill[b]
                    amounts[b] = _amounts(bins[b], lengths)
                    offers.put(b, capacity - fill[b], amounts[b])
                    heapq.heappush(queue, (fill[b], b))
        if not moved or len(live) <= -(-total // capacity):
            break
    return [items for items in bins if items]


def _pack_frame(rows: np.ndarray, lengths: np.ndarray, base: int, capacity: int) -> pd.DataFrame:
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    order = np.concatenate([np.asarray(b, np.int64) for b in bins])
    sizes = np.fromiter(map(len, bins), np.int64, len(bins))
    number = np.repeat(np.arange(len(bins)), sizes)
    placed = lengths[order]
    ends = np.cumsum(placed)
    firsts = np.cumsum(sizes) - sizes
    offset = ends - placed - (ends - placed)[firsts][number]
    fills = np.add.reduceat(placed, firsts)
    return pd.DataFrame({"row": rows[order], "sequence_id": base + number, "offset": offset, "underfull": (fills < capacity)[number]})


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with sequence_id and offset added."""
    with batches_of(pieces.sparkSession):
        kept = stored(pieces.withColumn("row", F.monotonically_increasing_id()))
    partial = kept.where(F.col("length") < capacity).select("row", "length")
    shards = max(1, -(-partial.count() // shard_pieces))
    wide = max(1, -(-shards // SHARDS_TOGETHER))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _pack_frame(part["row"].to_numpy(), part["length"].to_numpy(), int(key[0]) << 32, capacity)

    def repack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        before = part["sequence_id"].nunique()
        new = _pack_frame(part["row"].to_numpy(), part["length"].to_numpy(), (shards + int(key[0])) << 32, capacity)
        return new if new["sequence_id"].nunique() < before else part[["row", "sequence_id", "offset", "underfull"]]

    dealt = partial.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    first = stored(dealt.groupBy("shard").applyInPandas(pack, PLACES))
    lengths = partial.join(first.where("underfull").select("row", "sequence_id", "offset", "underfull"), "row")
    again = lengths.withColumn("shard", F.pmod(F.shiftright("sequence_id", 32), F.lit(wide))).groupBy("shard").applyInPandas(repack, PLACES)
    places = first.where(~F.col("underfull")).unionByName(again).select("row", "sequence_id", "offset")
    full = kept.where(F.col("length") == capacity).select("*", (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return kept.where(F.col("length") < capacity).join(places, "row").unionByName(full).drop("row")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return assign_sequences(token_pieces(docs, vocabulary, capacity, end_id), capacity, shard_pieces)


def build_sequences(docs: DataFrame, placed: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and doc_ids in order.

    ``placed`` is the result of pack_documents over the same ``docs``, whose doc_id must be unique here.
    """
    ids = token_pieces(docs, vocabulary, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    parts = placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
