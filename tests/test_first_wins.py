"""The first file of each content wins: order, restarts, bounded state."""

from __future__ import annotations

import os
import random
import time

from pyspark.sql import functions as F

from medialake.streaming import first_wins

ROW = "sha256 string, path string, size_bytes long, modified_at timestamp"


def drop(folder, name: str, content: bytes, at: int) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)
    os.utime(folder / name, (at, at))


def arrivals(found) -> dict[str, bool]:
    rows = found.select(F.substring_index("path", "/", -1).alias("name"), "repeat").collect()
    assert len({r["name"] for r in rows}) == len(rows)
    return {r["name"]: r["repeat"] for r in rows}


def test_earliest_of_a_batch_wins_and_restarts_keep_state(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    draw = random.Random(1)
    files = [(f"{c}{i}", c.encode(), 1_700_000_000 + i) for c in "abc" for i in range(5)]
    draw.shuffle(files)
    for file in files:
        drop(inbox, *file)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert arrivals(first_wins.ingest(spark, str(inbox), out, state)) == {name: not name.endswith("0") for name, _, _ in files}
    # A new run from the checkpoint: earlier bytes are known though their file is older.
    drop(inbox, "a9", b"a", 1_600_000_000)
    drop(inbox, "d0", b"d", 1_600_000_001)
    drop(inbox, "d1", b"d", 1_600_000_001)
    again = arrivals(first_wins.ingest(spark, str(inbox), out, state))
    assert again["a9"] and not again["d0"] and again["d1"] and len(again) == 18
    assert arrivals(first_wins.ingest(spark, str(inbox), out, state)) == again
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_each_order_of_arrival_gives_one_winner(spark, tmp_path):
    """Rows in shuffled files, several batches and several Arrow batches a hash; checked against a plain loop."""
    draw = random.Random(7)
    rows = [(f"h{draw.randint(0, 5)}" if draw.random() < 0.95 else None, f"p{i:03d}", i, draw.choice([None, 1, 2, 3])) for i in range(200)]
    source = tmp_path / "rows"
    wanted: dict[str, str] = {}
    for n in range(4):
        part = rows[n * 50 : n * 50 + 50]
        for h in {r[0] for r in part if r[0]} - set(wanted):
            wanted[h] = min((r for r in part if r[0] == h), key=lambda r: (r[3] is None, r[3], r[1]) if r[3] else (True, 0, r[1]))[1]
        frame = spark.createDataFrame(part, "sha256 string, path string, size_bytes long, t int")
        frame.withColumn("modified_at", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{source}/{n}")
        time.sleep(1.1)
    own = first_wins.stateful_session(spark)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    stream = own.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = first_wins.first_wins(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(first_wins.ARRIVALS).parquet(str(tmp_path / "out")).collect()
    assert sorted(r["path"] for r in found) == sorted(r[1] for r in rows if r[0])
    assert {r["sha256"]: r["path"] for r in found if not r["repeat"]} == wanted and sum(not r["repeat"] for r in found) == len(wanted)


def test_state_is_dropped_by_its_timer(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    drop(inbox, "a0", b"a", 1_700_000_000)
    drop(inbox, "b0", b"b", 1_700_000_000)
    first_wins.ingest(spark, str(inbox), out, state, keep_seconds=3600)
    drop(inbox, "a1", b"a", 1_700_000_001)
    assert arrivals(first_wins.ingest(spark, str(inbox), out, state, keep_seconds=3600))["a1"]

    short, kept = str(tmp_path / "short"), str(tmp_path / "short-state")
    first_wins.ingest(spark, str(inbox), short, kept, keep_seconds=0.5)
    time.sleep(1)
    drop(inbox, "a2", b"a", 1_700_000_002)
    found = arrivals(first_wins.ingest(spark, str(inbox), short, kept, keep_seconds=0.5))
    assert found == {"a0": False, "b0": False, "a1": True, "a2": False}
    time.sleep(1)
    for n in range(2):  # the timer of a batch fires at its end, the state is read from the next one's start
        drop(inbox, f"c{n}", b"c%d" % n, 1_700_000_003)
        first_wins.ingest(spark, str(inbox), short, kept, keep_seconds=0.5)
        time.sleep(1)
    left = first_wins.stateful_session(spark).read.format("statestore").option("stateVarName", "taken").load(kept).collect()
    assert len(left) == 1


def test_an_empty_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    assert first_wins.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).isEmpty()
