"""The fold of translation events into a run's blocks, in batch and over a stream.

An event is a row ``(run, seq, type, chunk, text, percentage)``, and ``ts``, ``state`` and ``message``
where it has them. A run starts anew with ``run_started``; ``chunk_planned`` adds a block to its
plan, ``hydrate_blocks`` puts a block's earlier text in its place (or adds it while nothing but
hydrated blocks is there), ``chunk`` appends text to its block, to a new one if the id is
unknown, to the last one if there is no id. ``chunk_started`` and ``chunk_completed`` move a block's
state, where cached stays cached until completed. ``closed`` says that the stream ended.

In batch the fold is a few aggregations that combine before the shuffle; no run is gathered in
one task. Over a stream :class:`Blocks` keeps each chunk in an entry of its own, so a micro-batch
reads and writes only the chunks that it names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..session import shared_folder, written

#: Seconds of silence after which a run is said to be slow, and is given up.
STALL, GIVE_UP = 45, 600
#: The block of text that comes before any block is known.
UNNAMED = "streaming-translation"
#: Places in a run that are numbered in one group.
STRETCH = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The phase that each type of event brings; a status brings its message's.
PHASES = {"run_started": "preparing", "chunk_planned": "chunking", "hydrate_blocks": "refining", "chunk_started": "streaming", "chunk": "streaming", "chunk_completed": "streaming", "done": "completed", "error": "error"}
TERMINAL = ("completed", "error", "stalled")


def told(events: DataFrame) -> DataFrame:
    """The events with all columns of the fold: what is missing is null, and ``phase`` is what the event brings."""
    have = lambda name, kind: (F.col(name) if name in events.columns else F.lit(None)).cast(kind).alias(name)
    phase = F.when(F.col("type") == "status", X.translation_phase(F.col("message"))).otherwise(F.element_at(F.create_map(*(F.lit(x) for p in PHASES.items() for x in p)), F.col("type")))
    rows = events.select(have("run", "long"), have("seq", "long"), have("ts", "timestamp"), have("type", "string"), have("chunk", "string"), have("text", "string"), have("percentage", "double"), have("state", "string"), have("message", "string"))
    return rows.withColumn("phase", phase).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("at", F.unix_millis("ts")).drop("message")


# ---- batch --------------------------------------------------------------------------


def _at(kind: str | tuple[str, ...], value: Column | None = None) -> Column:
    kinds = (kind,) if isinstance(kind, str) else kind
    return F.when(F.col("type").isin(*kinds), F.col("seq") if value is None else value)


def _epoch(events: DataFrame) -> DataFrame:
    """The events from the last start of each run on."""
    began = events.where("type = 'run_started'").groupBy("run").agg(F.max("seq").alias("began"))
    return events.join(began, "run", "left").where("began is null or seq >= began").drop("began")


def _births(now: DataFrame) -> DataFrame:
    """``(run, chunk, born, hydrated)``: every block with the event that made it and the last that replaced its text."""
    named = now.where("chunk is not null and type in ('chunk', 'chunk_planned', 'hydrate_blocks')")
    chunks = named.groupBy("run", "chunk").agg(F.min(_at(("chunk", "chunk_planned"))).alias("own"), F.min(_at("hydrate_blocks")).alias("first"), F.max(_at("hydrate_blocks")).alias("last"))
    nameless = now.where("chunk is null and type = 'chunk'").groupBy("run").agg(F.min("seq").alias("nameless"))
    new = F.when(F.coalesce(F.col("own") < F.col("first"), F.lit(True)), F.col("own"))  # not a block that was hydrated before
    runs = chunks.groupBy("run").agg(F.min(new).alias("owned"), F.min("first").alias("hydrated")).join(nameless, "run", "full")
    alone = F.col("nameless") < F.least(F.coalesce("owned", F.lit(1 << 62)), F.coalesce("hydrated", F.lit(1 << 62)))
    runs = runs.select("run", F.when(alone, F.col("nameless")).alias("unnamed"), F.least("owned", F.when(alone, F.col("nameless"))).alias("other"))
    unnamed = runs.where("unnamed is not null").select("run", F.lit(UNNAMED).alias("chunk"), F.col("unnamed").alias("own"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    both = chunks.unionByName(unnamed).groupBy("run", "chunk").agg(F.min("own").alias("own"), F.min("first").alias("first"), F.max("last").alias("last"))
    early = F.when(F.coalesce(F.col("first") < F.col("other"), F.lit(True)), F.col("first"))  # hydrated while no other block was there
    born = both.join(runs.select("run", "other"), "run", "left").withColumn("born", F.least("own", early)).where("born is not null")
    return born.select("run", "chunk", "born", F.when(F.col("last") >= F.col("born"), F.col("last")).alias("hydrated"))


def _pieces(now: DataFrame, births: DataFrame) -> DataFrame:
    """``(run, chunk, seq, text)`` of all pieces; those without an id at the block that was the last one then."""
    named = now.where("chunk is not null and type = 'chunk'").select("run", "chunk", "seq", "text")
    nameless = now.where("chunk is null and type = 'chunk'").select("run", "seq", "text")
    marks = births.join(nameless.select("run").distinct(), "run", "left_semi").select("run", F.col("born").alias("seq"), F.lit(None).cast("string").alias("text"), "chunk")
    both = nameless.withColumn("chunk", F.lit(None).cast("string")).unionByName(marks).withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    here = Window.partitionBy("run", "stretch").orderBy("seq", F.desc_nulls_last("chunk")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("run").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("run", "stretch").agg(F.max_by("chunk", F.when(F.col("chunk").isNotNull(), F.col("seq"))).alias("end"))
    carried = ends.select("run", "stretch", F.last("end", True).over(before).alias("carried"))
    placed = both.withColumn("local", F.last("chunk", True).over(here)).where("text is not null").join(carried, ["run", "stretch"], "left")
    return named.unionByName(placed.select("run", F.coalesce("local", "carried").alias("chunk"), "seq", "text"))


def _states(now: DataFrame, births: DataFrame, pieces: DataFrame) -> DataFrame:
    """The blocks with their last state: what set it last, and whether text came after."""
    moves = now.where("chunk is not null and type in ('chunk_started', 'chunk_completed', 'hydrate_blocks')").select("run", "chunk", "seq", "type", "state")
    facts = moves.unionByName(pieces.select("run", "chunk", "seq", F.lit("chunk").alias("type"), F.lit(None).cast("string").alias("state"))).groupBy("run", "chunk").agg(
        F.max(_at(("chunk", "chunk_started"))).alias("touched"), F.max(_at("chunk_completed")).alias("closed"), F.max_by("state", _at("chunk_completed")).alias("closed_as"), F.max_by("state", _at("hydrate_blocks")).alias("hydrated_as"),
    )
    rows = births.join(facts, ["run", "chunk"], "left")
    closed = F.when(F.col("closed") > F.col("born"), F.col("closed"))
    is_closed = closed.isNotNull() & (F.col("hydrated").isNull() | (closed > F.col("hydrated")))
    set_at = F.when(is_closed, closed).otherwise(F.col("hydrated"))
    # a completion may say cached, everything else is completed; what was hydrated is cached unless it says otherwise
    set_as = F.when(is_closed, F.when(F.col("closed_as") == "cached", "cached").otherwise("completed")).otherwise(F.coalesce("hydrated_as", F.lit("cached")))
    again = F.col("touched") > F.coalesce(set_at, F.col("born") - 1)
    state = F.when(set_at.isNull(), F.when(again, "streaming").otherwise("planned")).when(again & (set_as != "cached"), "streaming").otherwise(set_as)
    return rows.select("run", "chunk", "born", "hydrated", state.alias("state"))


def _folded(every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events, the blocks, and the parts of their texts: ``(run, chunk, seq, text)`` from the last event on that replaced a text."""
    folder = shared_folder(every.sparkSession, "run-fold")
    every = written(every, folder, "events")  # what sends them works once
    now = _epoch(every)
    births = written(_births(now), folder, "births")
    pieces = written(_pieces(now, births), folder, "pieces")
    blocks = written(_states(now, births, pieces), folder, "blocks")
    parts = pieces.unionByName(now.where("type = 'hydrate_blocks' and chunk is not null").select("run", "chunk", "seq", "text"))
    return every, blocks, parts.join(blocks.select("run", "chunk", F.coalesce("hydrated", "born").alias("from")), ["run", "chunk"]).where("seq >= from").drop("from")


def fold_blocks(events: DataFrame) -> DataFrame:
    """``(run, chunk, born, state, text)`` of every block after the last event; ``born`` orders a run's blocks.

    What is grouped at most is the text of one block. Events, blocks and pieces are tables in the shared folder on the way.
    """
    _, blocks, parts = _folded(told(events))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
    texts = parts.groupBy("run", "chunk").agg(text.alias("text"))
    return blocks.join(texts, ["run", "chunk"], "left").select("run", "chunk", "born", "state", F.coalesce("text", F.lit("")).alias("text"))


def fold_runs(events: DataFrame) -> DataFrame:
    """``(run, n_events, n_blocks, n_completed, n_chars, progress, phase)`` of each run of a finished table of events."""
    every, blocks, parts = _folded(told(events).withColumn("text", F.length("text").cast("string")))  # no text is moved for counts
    sizes = parts.groupBy("run").agg(F.sum(F.col("text").cast("long")).alias("n_chars"))
    counts = blocks.groupBy("run").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("state").isin("completed", "cached")).alias("n_completed"))
    percent = F.when(F.col("type") == "done", 100.0).when(F.col("type") == "progress", F.col("percentage"))
    brings = F.when(F.col("phase").isNotNull(), F.col("seq"))
    runs = every.groupBy("run").agg(F.count("*").alias("n_events"), F.max_by(percent, F.when(percent.isNotNull(), F.col("seq"))).alias("progress"), F.max_by("phase", brings).alias("phase"), F.max(brings).alias("said"), F.max(_at("closed")).alias("closed"))
    broken = (F.col("closed") > F.coalesce("said", F.lit(-(1 << 62)))) & ~F.coalesce("phase", F.lit("idle")).isin(*TERMINAL)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return runs.join(counts, "run", "left").join(sizes, "run", "left").select(
        "run", "n_events", zero("n_blocks"), zero("n_completed"), zero("n_chars"), F.coalesce("progress", F.lit(0.0)).alias("progress"), F.when(broken, "error").otherwise(F.coalesce("phase", F.lit("idle"))).alias("phase")
    )


# ---- stream -------------------------------------------------------------------------


@dataclass
class Run:
    """What is kept of a run beside its blocks; times are in milliseconds, ``said`` is the notice of the present silence."""

    epoch: int = 0
    n_events: int = 0
    n_blocks: int = 0
    n_completed: int = 0
    n_chars: int = 0
    progress: float = 0.0
    phase: str = "idle"
    newest: str | None = None
    only_hydrated: bool = True
    heard: int | None = None
    said: str | None = None


RUN = "epoch long, n_events long, n_blocks long, n_completed long, n_chars long, progress double, phase string, newest string, only_hydrated boolean, heard long, said string"
BLOCK = "born long, state string, text string"
UPDATE = "run long, epoch long, chunk string, born long, state string, text string, n_events long, n_blocks long, n_completed long, n_chars long, progress double, phase string, notice string, at long"
_Update = Row(*(c.split()[0] for c in UPDATE.split(", ")))
Block = tuple[int, str, str]


class Blocks:
    """The fold of events, one after the other, over a store of blocks with ``get``, ``put`` and ``clear``."""

    def __init__(self, run: Run, store, stall: int | None = None, give_up: int | None = None):
        self.run, self.store, self.stall, self.give_up = run, store, stall, give_up
        self.touched: dict[str, Block | None] = {}
        self.notices: list[tuple[str, int | None]] = []

    def _get(self, chunk: str) -> Block | None:
        if chunk not in self.touched:
            self.touched[chunk] = self.store.get(chunk)
        return self.touched[chunk]

    def _put(self, chunk: str, new: Block) -> None:
        old, r = self._get(chunk), self.run
        done = lambda b: b is not None and b[1] in ("completed", "cached")
        r.n_blocks += old is None
        r.n_completed += done(new) - done(old)
        r.n_chars += len(new[2]) - (len(old[2]) if old else 0)
        if old is None:
            r.newest = chunk
        self.touched[chunk] = new

    def silence(self, until: int) -> None:
        """Says what a run that is still under way missed up to a time."""
        r = self.run
        if r.heard is None or r.phase in TERMINAL:
            return
        if self.stall is not None and r.said is None and until - r.heard >= self.stall:
            r.said = "slow"
            self.notices.append(("slow", r.heard + self.stall))
        if self.give_up is not None and until - r.heard >= self.give_up:
            r.said, r.phase = "given up", "stalled"
            self.notices.append(("given up", r.heard + self.give_up))

    def take(self, seq: int, kind: str, chunk: str | None, text: str, percentage: float | None, state: str | None, phase: str | None, at: int | None = None) -> None:
        r = self.run
        if at is not None:
            self.silence(at)
        r.n_events += 1
        given_up = r.phase == "stalled"
        if at is not None and not given_up or kind == "run_started":
            r.heard, r.said = at, None
        if given_up and kind != "run_started":
            return  # nobody listens any more
        block = self._get(chunk) if chunk is not None else None
        if kind == "run_started":
            self.store.clear()
            self.touched.clear()
            r.epoch, r.n_blocks, r.n_completed, r.n_chars, r.newest, r.only_hydrated = seq, 0, 0, 0, None, True
        elif kind == "chunk_planned" and chunk is not None and block is None:
            self._put(chunk, (seq, "planned", ""))
            r.only_hydrated = False
        elif kind == "hydrate_blocks" and chunk is not None and (block is not None or r.only_hydrated):
            self._put(chunk, (block[0] if block else seq, state or "cached", text))
        elif kind == "chunk":
            name = chunk if chunk is not None else r.newest or UNNAMED
            old = self._get(name)
            r.only_hydrated = r.only_hydrated and old is not None
            self._put(name, (old[0], "cached" if old[1] == "cached" else "streaming", old[2] + text) if old else (seq, "streaming", text))
        elif kind == "chunk_started" and block is not None:
            self._put(chunk, (block[0], "cached" if block[1] == "cached" else "streaming", block[2]))
        elif kind == "chunk_completed" and block is not None:
            self._put(chunk, (block[0], "cached" if state == "cached" else "completed", block[2]))
        elif kind == "progress" and percentage is not None:
            r.progress = percentage
        elif kind == "done":
            r.progress = 100.0
        elif kind == "closed" and r.phase not in TERMINAL:
            phase = "error"
            self.notices.append(("broken off", at))
        r.phase = phase or r.phase

    def take_all(self, events: Iterable[Row], timed: bool = False) -> None:
        """Events in any order, put in that of ``seq``."""
        for e in sorted(events, key=lambda e: e.seq):
            self.take(e.seq, e.type, e.chunk, e.text, e.percentage, e.state, e.phase, e.at if timed else None)

    def rows(self, run: int) -> Iterator[Row]:
        """The run's row, a row for each notice and one for each touched block; writes these to the store."""
        r = self.run
        head = [r.n_events, r.n_blocks, r.n_completed, r.n_chars, r.progress, r.phase]
        out = [(run, r.epoch, None, None, None, None, *head, None, None)]
        out += [(run, r.epoch, None, None, None, None, *head, notice, at) for notice, at in self.notices]
        for chunk, block in self.touched.items():
            if block is not None:
                self.store.put(chunk, block)
                out.append((run, r.epoch, chunk, *block, *head, None, None))
        return map(_Update, *zip(*out, strict=True))


class _Kept:
    """Blocks in a map state: reading or writing one leaves all others alone."""

    def __init__(self, state, empty: bool):
        self.state, self.empty = state, empty

    def get(self, chunk: str) -> Block | None:
        return tuple(self.state.getValue((chunk,))) if not self.empty and self.state.containsKey((chunk,)) else None

    def put(self, chunk: str, block: Block) -> None:
        self.state.updateValue((chunk,), block)

    def clear(self) -> None:
        if not self.empty:
            self.state.clear()
        self.empty = True  # nothing is put before the rows are told


class RunProcessor(StatefulProcessor):
    """A run over micro-batches: its blocks in a map, its counts in a value, two timers that every event sets anew."""

    def __init__(self, stall: int | None, give_up: int | None, timed: bool):
        self.stall, self.give_up = (None if s is None else round(s * 1000) for s in (stall, give_up))
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "chunk string", BLOCK)
        self.run = handle.getValueState("run", RUN)

    def _fold(self) -> Blocks:
        held = self.run.get()  # none of a new run, which has no blocks to ask for either
        return Blocks(Run(*held) if held else Run(), _Kept(self.blocks, not held), self.stall, self.give_up)

    def _keep(self, run: Run) -> None:
        self.run.update(tuple(asdict(run)[f.name] for f in fields(Run)))
        if self.stall is None and self.give_up is None:
            return  # a stream without timers has no clock to ask
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if run.heard is not None and run.phase not in TERMINAL:
            for after, said in ((self.stall, "slow"), (self.give_up, "given up")):
                if after is not None and not (said == "slow" and run.said):
                    self.handle.registerTimer(run.heard + after)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold = self._fold()
        fold.take_all(rows, self.timed)
        if not self.timed and fold.run.phase != "stalled" and (self.stall, self.give_up) != (None, None):
            fold.run.heard, fold.run.said = timerValues.getCurrentProcessingTimeInMs(), None
        out = fold.rows(key[0])
        self._keep(fold.run)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fold = self._fold()
        now = timerValues.getCurrentWatermarkInMs() if self.timed else timerValues.getCurrentProcessingTimeInMs()
        fold.silence(max(expiredTimerInfo.getExpiryTimeInMs(), now))  # both timers may be due
        out = fold.rows(key[0])
        self._keep(fold.run)
        if fold.notices:
            yield from out

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, stall: float | None = STALL, give_up: float | None = GIVE_UP, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """Updates of the same fold over a stream: ``(run, epoch, chunk, …)``, a row for each block that changed and one for the run.

    Events of a run come in order from one micro-batch to the next. A run that is neither done nor failed
    and hears nothing for ``stall`` seconds has a row with the notice ``slow``, after ``give_up`` seconds one with
    ``given up``, and then takes no event before its next start; every event sets both times anew. They go by the
    clock of processing, or with ``event_time`` by the events' ``ts``, the stream's watermark being the time of
    those that are silent. ``closed`` before ``done`` or ``error`` gives ``broken off`` and the phase ``error``.
    Needs the RocksDB state store, which this sets in the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = told(events)
    rows = rows.withWatermark("ts", late) if event_time else rows
    mode = "eventTime" if event_time and (stall, give_up) != (None, None) else "processingTime" if stall is not None or give_up is not None else "none"
    return rows.groupBy("run").transformWithState(RunProcessor(stall, give_up, event_time), UPDATE, "update", mode)


def latest_blocks(updates: DataFrame) -> DataFrame:
    """``(run, chunk, born, state, text)`` after the last update of each block of each run's last epoch."""
    rows = updates.where("chunk is not null")
    last = updates.groupBy("run").agg(F.max("epoch").alias("epoch"))
    found = rows.join(last, ["run", "epoch"]).groupBy("run", "chunk").agg(F.max_by(F.struct("born", "state", "text"), "n_events").alias("v"))
    return found.select("run", "chunk", "v.*")


def latest_runs(updates: DataFrame) -> DataFrame:
    """The row of each run after its last update; of equally many events, the one that was given up."""
    rows = updates.where("chunk is null")
    kept = ["n_events", "n_blocks", "n_completed", "n_chars", "progress", "phase"]
    return rows.groupBy("run").agg(F.max_by(F.struct(*kept), F.struct("n_events", F.col("phase") == "stalled")).alias("v")).select("run", "v.*")


def notices(updates: DataFrame) -> DataFrame:
    """``(run, notice, at)``: silences and broken streams, in milliseconds of the clock used."""
    return updates.where("notice is not null").select("run", "notice", "at")
