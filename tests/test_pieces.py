"""Streams in pieces: any cutting gives what the whole gives."""

import random
import time

import pytest

from vellumite.functions import folds as G
from vellumite.streaming import pieces
from vellumite.streaming.events import write_closed, write_updates


def cut(rng, text, most=6):
    places = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(most)))
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]


def test_frames_of_any_cutting():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["data: x", "\n", "\n\n", ": note", "a", "data: "]) for _ in range(rng.randrange(12)))
        *want, rest = text.split("\n\n")
        tail, out = "", []
        for piece in cut(rng, text):
            some, tail = pieces.frames_of(tail, piece)
            out += some
        assert (out, tail) == (want, rest)


FRAGMENTS = [("@@KEEP_MATH_INLINE_0@@", "$f0$", "math-inline"), ("@@KEEP_MATH_INLINE_1@@", "$f1$", "math-inline"), ("@@KEEP_CODE_BLOCK_2@@", "```\nx @@KEEP_MATH_INLINE_0@@\n```", "code-block")]
PARTS = ["a", "b ", "\n", "$", "$x$", "@", "@@", " ", "K", "KEEP", "_", "keep_x", "\n\n", "Z9", *(m for m, _, _ in FRAGMENTS), "@KEEP_MATH_INLINE_1@", "keep_code_block_2", "@@ KEEP_MATH_INLINE_0 @@", "KEEP_MATH_INLINE_0\n@@", "@@KEEP_MATH_INLINE_7@@"]


def test_restoring_of_any_cutting():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        stream = G.StreamUnmasker(FRAGMENTS)
        assert "".join([stream.feed(p) for p in cut(rng, text)] + [stream.feed("", flush=True)]) == G.unmask(text, FRAGMENTS)


def test_restoring_at_every_place():
    text = "the proof: @@KEEP_MATH_INLINE_0@@ and @@KEEP_MATH_INLINE_1@@\nso @@KEEP_CODE_BLOCK_2@@ ends, plain text goes on and on"
    for size in range(1, len(text)):
        stream = G.StreamUnmasker(FRAGMENTS)
        assert "".join(stream.feed(text[k : k + size]) for k in range(0, len(text), size)) + stream.feed("", flush=True) == G.unmask(text, FRAGMENTS)
    stream = G.StreamUnmasker(FRAGMENTS)
    assert stream.feed("a line without signs goes at ") == "a line without signs goes " and stream.feed("once\nKE") == "at "


def test_long_texts_are_held_in_order():
    began, stream = time.time(), G.StreamUnmasker(FRAGMENTS)
    text = "word " * 100_000 + "$" * 100_000 + " " * 100_000 + "@" * 100_000
    assert stream.feed(text) + stream.feed("", flush=True) == G.unmask(text, FRAGMENTS) and time.time() - began < 20


def test_throttle_by_hand():
    t = pieces.Throttle({"shown": 180, "stored": 2000}, {})
    for seq, at, last in [(1, 0, False), (2, 100, False), (3, 179, False), (4, 500, False), (5, 2100, False), (6, 2200, True)]:
        t.take(seq, at, last)
    assert sorted(t.out) == [("shown", 180, 3), ("shown", 680, 4), ("shown", 2200, 6), ("stored", 2000, 4), ("stored", 2200, 6)] and not t.waiting


@pytest.mark.parametrize("seed", range(20))
def test_throttle_is_apart_and_ends_with_the_last(seed):
    rng = random.Random(seed)
    t, at = pieces.Throttle({"s": 50}, {}), 0
    for seq in range(200):
        at += rng.randrange(60)
        t.take(seq, at, False)
    t.due(at + 50)
    times = [o[1] for o in t.out]
    assert all(b - a >= 50 for a, b in zip(times, times[1:], strict=False)) and t.out[-1][2] == 199


def test_pieces_over_micro_batches(spark, tmp_path):
    """Half a frame and half a marker wait in the state for the next file."""
    rng = random.Random(3)
    rows, texts = [[], [], []], {}
    for run in range(6):
        texts[run] = "".join(rng.choice(PARTS) for _ in range(30))
        parts = [texts[run][k : k + 9] for k in range(0, len(texts[run]), 9)] or [""]
        for seq, p in enumerate(parts):
            rows[seq * 3 // len(parts)].append((run, seq, p, seq == len(parts) - 1, [dict(zip(("marker", "content", "kind"), f, strict=True)) for f in FRAGMENTS] if seq == 0 else None))
    schema = "run long, seq long, text string, last boolean, fragments array<struct<marker:string,content:string,kind:string>>"
    for k, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
        time.sleep(0.01)
    stream = spark.readStream.schema(schema + ", k int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = pieces.restored_stream(stream)
    write_closed(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    found = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.run, r.seq)):
        found[r.run] = found.get(r.run, "") + r.text
    assert found == {run: G.unmask(t, FRAGMENTS) for run, t in texts.items()}


def test_sinks_by_the_clock(spark, tmp_path):
    """Timers of processing time show what waits, though nothing more comes."""
    schema = "run long, seq long, ts timestamp, type string"
    spark.createDataFrame([(1, 0, None, "chunk"), (1, 1, None, "chunk"), (2, 5, None, "done")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = pieces.throttled_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = write_updates(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"processingTime": "300 milliseconds"})
    try:
        for _ in range(40):
            time.sleep(1)
            rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            if len(rows) >= 4:
                break
    finally:
        query.stop()
    assert sorted((r.run, r.sink, r.seq) for r in rows) == [(1, "shown", 1), (1, "stored", 1), (2, "shown", 5), (2, "stored", 5)]
    first = {r.sink: r.at for r in rows if r.run == 1}
    assert first["stored"] - first["shown"] == 2000 - 180
