"""Folds of translation events: batch and stream against the events taken one after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vellumite.plans import translation
from vellumite.streaming import runs
from vellumite.streaming.events import write_updates
from vellumite.streaming.runs import Blocks, Run

SCHEMA = "run long, seq long, ts timestamp_ntz, type string, chunk string, text string, percentage double, state string, message string"
KINDS = ["run_started", "chunk_planned", "hydrate_blocks", "chunk_started", "chunk", "chunk", "chunk", "chunk_completed", "progress", "status", "done", "error", "closed"]


class Store(dict):
    def put(self, chunk, block):
        self[chunk] = block


def events(seed, n_runs=25, length=30):
    rng = random.Random(seed)
    rows = []
    for run in range(n_runs):
        kinds = [k for k in KINDS if rng.random() < 0.7] or KINDS
        for seq in range(rng.randrange(1, length)):
            kind = rng.choice(kinds)
            chunk = rng.choice(["a", "b", "c", "d", None if kind == "chunk" else "a"])
            rows.append((run, seq, None, kind, chunk, rng.choice(["", "x", "täxt", None]), rng.choice([None, 5.0, 50.0]), rng.choice([None, "cached", "completed"]), rng.choice(["Chunking document...", "Translation complete", None])))
    return rows


def sequential(rows):
    """The blocks of each run in order, and the run itself."""
    out = {}
    phases = {"Chunking document...": "chunking", "Translation complete": "completed", None: "preparing"}
    for run in {r[0] for r in rows}:
        fold = Blocks(Run(), Store())
        for _, seq, _, kind, chunk, text, percentage, state, message in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            fold.take(seq, kind, chunk, text or "", percentage, state, phases[message] if kind == "status" else runs.PHASES.get(kind))
        blocks = sorted((b[0], c, b[1], b[2]) for c, b in fold.touched.items() if b)
        r = fold.run
        out[run] = ([b[1:] for b in blocks], (r.n_events, r.n_blocks, r.n_completed, r.n_chars, r.progress, r.phase))
    return out


def folded(blocks, states):
    out = {r.run: ([], (r.n_events, r.n_blocks, r.n_completed, r.n_chars, r.progress, r.phase)) for r in states.collect()}
    for b in sorted(blocks.collect(), key=lambda b: (b.run, b.born)):
        out[b.run][0].append((b.chunk, b.state, b.text))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_folds_as_one_after_the_other(spark, seed, monkeypatch):
    monkeypatch.setattr(runs, "STRETCH", 5)
    rows = events(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert folded(runs.fold_blocks(df), runs.fold_runs(df)) == sequential(rows)


def test_cached_blocks_and_pieces_without_an_id(spark):
    """Five blocks, two of them hydrated; a piece without an id goes to the last block."""
    rows = [(1, 0, "run_started", None, None)] + [(1, 1 + k, "chunk_planned", f"c{k}", None) for k in range(5)] + [(1, 6 + k, "hydrate_blocks", f"c{k}", "abc") for k in range(2)]
    for k in range(2, 5):
        rows += [(1, 10 * k, "chunk_started", f"c{k}", None), (1, 10 * k + 1, "chunk", f"c{k}", "abc"), (1, 10 * k + 2, "chunk_completed", f"c{k}", None)]
    rows += [(2, 0, "run_started", None, None), (2, 1, "chunk", "a", "abc"), (2, 2, "chunk", None, "def"), (3, 0, "chunk", None, "xy"), (3, 1, "chunk", None, "z"), (4, 0, "hydrate_blocks", "p", "1"), (4, 1, "chunk", "p", "2"), (4, 2, "hydrate_blocks", "q", "3"), (4, 3, "chunk", "n", "4"), (4, 4, "hydrate_blocks", "r", "5")]
    df = spark.createDataFrame(rows, "run long, seq long, type string, chunk string, text string").withColumn("percentage", F.lit(None).cast("double"))
    found = {r.run: tuple(r)[2:5] for r in runs.fold_runs(df).collect()}
    assert found == {1: (5, 5, 15), 2: (1, 0, 6), 3: (1, 0, 3), 4: (3, 2, 4)}
    blocks = {(b.run, b.chunk): (b.state, b.text) for b in runs.fold_blocks(df).collect()}
    assert blocks[1, "c0"] == ("cached", "abc") and blocks[2, "a"] == ("streaming", "abcdef") and blocks[3, runs.UNNAMED] == ("streaming", "xyz") and blocks[4, "p"] == ("cached", "12") and (4, "r") not in blocks


def test_no_events(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert runs.fold_blocks(df).count() == 0 and runs.fold_runs(df).count() == 0


def streamed(spark, folder, parts, **how):
    """Each part a file and a micro-batch of its own."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/k={k}")
        time.sleep(0.01)
    stream = spark.readStream.schema(SCHEMA + ", k int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    updates = runs.fold_stream(stream, **how)
    write_updates(updates, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{folder}/out")


def test_stream_folds_as_one_after_the_other(spark, tmp_path):
    rows = events(4, 12)
    cut = streamed(spark, tmp_path, [[r for r in rows if r[1] % 24 // 8 == k or (k == 2 and r[1] >= 24)] if k else [r for r in rows if r[1] < 8] for k in range(3)], stall=None, give_up=None)
    assert folded(runs.latest_blocks(cut), runs.latest_runs(cut)) == sequential(rows)


def test_blocks_come_back(spark, tmp_path):
    """What a resumed translation sends, folded over three micro-batches, is what went in."""
    chunks = [(d, k, f"doc-{d}-{k}", "references" if k == 3 else "text", f"T{k}", "cached" if k < d else "completed", f"text {d} {k} " * k) for d in range(4) for k in range(1 + 2 * d)]
    blocks = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, chunk_id string, kind string, title string, state string, text string")
    told = translation.events(blocks).withColumnRenamed("doc_id", "run").withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("percentage", F.col("percentage").cast("double"))
    want = sorted((c[0], c[2], c[5], c[6]) for c in chunks)
    assert sorted((b.run, b.chunk, b.state, b.text) for b in runs.fold_blocks(told).collect()) == want
    rows = [tuple(r) for r in told.select("run", "seq", "ts", "type", "chunk", "text", "percentage", "state", "message").collect()]
    found = streamed(spark, tmp_path, [[r for r in rows if r[1] < 6], [r for r in rows if 6 <= r[1] < 15], [r for r in rows if r[1] >= 15]], stall=None, give_up=None)
    assert sorted((b.run, b.chunk, b.state, b.text) for b in runs.latest_blocks(found).collect()) == want
    assert {(r.n_blocks, r.n_completed, r.phase, r.progress) for r in runs.latest_runs(found).collect()} == {(1 + 2 * d, 1 + 2 * d, "completed", 100.0) for d in range(4)}


def test_silences_by_the_clock(spark, tmp_path):
    """Two timers of processing time, set anew by every event; a stream that ends without a last word is broken off."""
    at = lambda run, seq, kind: (run, seq, None, kind, "a", "x", None, None, None)
    spark.createDataFrame([at(1, 0, "run_started"), at(1, 1, "chunk"), at(2, 0, "chunk"), at(2, 1, "done"), at(3, 0, "chunk"), at(3, 1, "closed")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/k=0")
    updates = runs.fold_stream(spark.readStream.schema(SCHEMA + ", k int").parquet(f"{tmp_path}/in"), stall=1, give_up=4)
    query = write_updates(updates, f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"processingTime": "500 milliseconds"})
    try:
        for _ in range(60):
            time.sleep(1)
            if (tmp_path / "out").exists():
                rows = spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{tmp_path}/out")
                if {r.notice for r in runs.notices(rows).collect()} == {"slow", "given up", "broken off"}:
                    break
    finally:
        query.stop()
    said = sorted((r.run, r.notice, r.at) for r in runs.notices(rows).collect())
    assert [s[:2] for s in said] == [(1, "given up"), (1, "slow"), (3, "broken off")] and said[0][2] - said[1][2] == 3000
    assert {r.run: r.phase for r in runs.latest_runs(rows).collect()} == {1: "stalled", 2: "completed", 3: "error"}


def test_silences_by_the_events(spark, tmp_path):
    at = lambda run, seq, second, kind="chunk": (run, seq, f"2024-01-01 00:{second // 60:02}:{second % 60:02}", kind, "a", "x", None, None, None)
    parts = [[at(1, 0, 0), at(1, 1, 50), at(2, 0, 10)], [at(1, 2, 90), at(2, 1, 100, "done"), at(3, 0, 100)], [at(3, 1, 110), at(1, 3, 800), at(1, 4, 805), at(1, 5, 810, "run_started"), at(4, 0, 820)]]
    import datetime

    parts = [[(r[0], r[1], datetime.datetime.fromisoformat(r[2]), *r[3:]) for r in p] for p in parts]
    found = streamed(spark, tmp_path, parts, event_time=True)
    start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp())
    said = sorted((r.run, r.notice, r.at // 1000 - start) for r in runs.notices(found).collect())
    assert said == [(1, "given up", 690), (1, "slow", 45), (1, "slow", 135), (2, "slow", 55), (3, "given up", 710), (3, "slow", 155)]
