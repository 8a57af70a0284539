"""Queries against their SQL over texts that the given tables hold rarely or not at all."""

import shutil

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellumite import catalog
from vellumite.operators import annotations, glossary, sections, semantics
from vellumite.plans import translation
from vellumite.streaming import pieces, runs

from .compare import duck, rows


def _with(tmp_path, sf_dir: str, **tables: pd.DataFrame) -> str:
    """The given tables with some of them replaced."""
    root = shutil.copytree(sf_dir, tmp_path / "sf")
    root.chmod(0o755)
    for name, frame in tables.items():
        (root / f"{name}.parquet").unlink()
        frame.to_parquet(root / f"{name}.parquet")
    return str(root)


def _same(spark, root: str, name: str) -> None:
    got = catalog.QUERIES[name](spark, root).toPandas()
    assert len(got) and rows(got) == rows(duck(root).execute(catalog.ORACLES[name]).df())


def _docs(texts: list) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "de", "source": "web", "n_chars": [len(t or "") for t in texts]})


def test_capitals_of_terms(spark, sf_dir, tmp_path):
    """A term's capitals are letters of their own: one for one."""
    quotes = pd.DataFrame({"item_id": [1, 2, 3], "text": ["Erßie entech und noch schß.", "ŉ ﬁn ᾳ", "kurz ᾼß"]})
    docs = _docs(["Die Erßie entech ist schß. und", "ŉ ﬁn ᾳ, kurz ᾼß", "nichts"])
    root = _with(tmp_path, sf_dir, benchmark=quotes, documents=docs)
    _same(spark, root, "term_contained")
    _same(spark, root, "term_match")


def test_blocks_of_odd_texts(spark, sf_dir, tmp_path):
    """Missing and empty texts, empty first lines, other line ends, an id twice, and a text longer than JSON readers take as they are set."""
    docs = _docs([None, "", " ", "\nrest", "　\nrest", "x\r- y", "x - y", "one\n- one", "• • x", "-", "twice", "a" * 20_000_001])
    docs = pd.concat([docs, docs[10:11].assign(text="again")])
    _same(spark, _with(tmp_path, sf_dir, documents=docs), "json_blocks")


def test_empty_items(spark):
    """Empty titles and formulas are no blocks but use up an ordinal; null items and pages do not."""
    pages = '[[{"type":"title","content":{"level":2}},null,{"type":"equation_interline","content":{"math_content":" "}}],null,[{"type":"title","content":{"level":2,"title_content":[{"type":"text","content":"T"}]}}]]'
    out = semantics.from_content_list(spark.createDataFrame([(1, pages)], "doc_id long, content_list string"))
    assert [(r.id, r.page, r.ord, r.markdown) for r in out.collect()] == [("cl-2-2", 2, 2, "## T")]


def test_notes_meet_their_own_blocks(spark):
    """The same line in every document: each note meets the lines of its own document, and no text is sent for others' quotes."""
    blocks = spark.range(400).select(F.col("id").alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("block_idx"), F.lit(t).alias("text")) for k, t in enumerate(("other", "a common line", "a common line again")))))).select("doc_id", "col.*")
    notes = spark.range(400).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("note_id"), F.lit(None).cast("string").alias("exact"), F.lit(" common line ").alias("selected"))
    found = annotations.localised(notes.unionByName(notes.limit(1).select("doc_id", F.lit("c").alias("note_id"), F.lit("missing").alias("exact"), "selected")), blocks, ["doc_id"])
    assert found.count() == 800 and {r.block_idx for r in found.collect()} == {1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and all("doc_id" in line for line in plan.splitlines() if "Join Inner" in line)


def test_texts_are_sent_once_for_terms(spark):
    """Few terms go to the texts: words and characters of chunks are not shuffled, the chunks once; translation sends none again."""
    docs = spark.createDataFrame([(1, "# A\nthe bert model is small\n# B\nBERT"), (2, "# A\nnothing")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "bert", "B-Modell", "name"), (1, "small", "klein", None)], "place int, source string, target string, category string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = glossary.chunk_terms(sections.chunks(docs), terms, terms)
        assert {(r.doc_id, r.chunk_idx, len(r.terms)) for r in found.collect()} == {(1, 0, 2), (1, 1, 1)}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        assert sum("BroadcastHashJoin [key" in x for x in plan) == 2
        assert sum("Exchange hashpartitioning(_id" in x and "Reused" not in x for x in plan) == 1
        out = translation.translate(docs, translation.Stub(), "French", found)
        assert {(r.doc_id, r.chunk_idx): r.text.split("\n")[-1] for r in out.collect()} == {(1, 0): "THE B-Modell MODEL IS SMALL".replace("SMALL", "klein"), (1, 1): "B-Modell", (2, 0): "NOTHING"}
        joins = out._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in joins and not any("LeftOuter" in x and "chunk_idx" in x for x in joins.splitlines())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


class _State:
    """A state that counts what is asked of it."""

    def __init__(self):
        self.held, self.asked = None, 0

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def containsKey(self, key):
        self.asked += 1
        return False

    def updateValue(self, key, value):
        self.held = (self.held or {}) | {key: value}


class _Handle:
    def __init__(self):
        self.run, self.blocks = _State(), _State()

    def getValueState(self, name, schema):
        return self.run

    def getMapState(self, name, key, value):
        return self.blocks


def test_new_runs_ask_for_no_blocks():
    """Events come and go as rows; a run that begins has no blocks in the store, so none is looked up."""
    event = Row("run", "seq", "type", "chunk", "text", "percentage", "state", "phase", "at")
    events = [event(1, k, *e, None, None, None, None) for k, e in enumerate([("run_started", None, ""), ("chunk_planned", "a", ""), ("chunk_planned", "b", ""), ("chunk", "a", "x"), ("chunk", "b", "y"), ("chunk", "a", "z")])]
    processor, handle = runs.RunProcessor(None, None, False), _Handle()
    processor.init(handle)
    out = list(processor.handleInputRows((1,), iter(events[::-1]), None))
    assert [(r.chunk, r.text) for r in out if r.chunk] == [("a", "xz"), ("b", "y")] and out[0].n_blocks == 2
    assert handle.blocks.asked == 0 and len(handle.blocks.held) == 2


def test_pieces_come_as_rows():
    piece, handle = Row("run", "seq", "text", "last", "fragments"), _Handle()
    processor = pieces.Restored()
    processor.init(handle)
    rows = [piece(1, 1, "1@@ b", True, None), piece(1, 0, "a @@", False, [{"marker": "@@1@@", "content": "code", "kind": "x"}])]
    out = list(processor.handleInputRows((1,), iter(rows), None))
    assert "".join(r.text for r in sorted(out, key=lambda r: r.seq)) == "a code b" and {r.run for r in out} == {1}
