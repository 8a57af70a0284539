import io
import json
import zipfile

from pyspark.sql import functions as F

from vellumite.functions import text as X
from vellumite.operators import glossary, library, sections, semantics
from vellumite.plans import translation
from vellumite.sources import artifacts
from vellumite.streaming import events as E


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).head().x


def test_golden_text(spark):
    t = F.col("t")
    cases = [
        (X.dehyphenate, "ex-\n ample", "example"), (X.dehyphenate, "a-\nb-\nc", "ab-\nc"), (X.heading_spacing, "#tag", "# tag"), (X.heading_spacing, "# ok", "# ok"), (X.heading_spacing, "##x", "## x"), (X.list_spacing, "-item", "- item"),
        (X.list_spacing, "1.5", "1. 5"), (X.list_spacing, "**b**", "* *b**"), (X.chinese_spacing, "中文 测试", "中文测试"), (X.chinese_spacing, "测试 ，好", "测试，好"), (X.js_trim, "\ufeff\u3000 a \u2028", "a"), (X.squeeze, " a \n\u00a0 b ", "a b"),
        (X.sanitize_output, "x ```markdown\nbody\n``` y", "body"), (X.sanitize_output, "Repaired markdown: z", "z"), (X.block_label, "sec-0-title-0", "标题1"), (X.block_label, "sec-1-image-2", "图2-3"), (X.block_label, "odd", "odd"),
    ]
    for f, given, expected in cases:
        assert one(spark, f(t), t=given) == expected, (f.__name__, given)
    assert one(spark, X.u16_length(t), t="a😀b") == 4


def test_golden_captions_and_ids(spark):
    for given, expected in [("(a) left Figure 2: both", ("(a) left", "Figure 2: both")), ("(a) left", ("(a) left", "")), ("Figure 3", ("", "Figure 3")), ("", ("", ""))]:
        assert tuple(one(spark, F.array(*X.split_caption(F.col("t"))), t=given)) == expected
    for given, expected in [("arXiv:2401.00001v2", ("2401.00001", "v2")), ("https://arxiv.org/pdf/2401.00001v3.pdf", ("2401.00001", "v3")), ("math/0309136", ("math/0309136", None))]:
        assert tuple(one(spark, F.array(*X.arxiv_id(F.col("t"))), t=given)) == expected


def test_sections_and_chunks(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\n### sub\n## B\ny"), (2, "# References\n" + "r\n\n" * 30), (3, "")], "doc_id long, text string")
    rows = [(r.title, r.start) for r in sections.sections(df).where("doc_id = 1").orderBy("section").collect()]
    assert rows == [("Start", 0), ("A", 6), ("B", 20)]
    small = sections.chunks(df, most=20).orderBy("doc_id", "chunk_idx").collect()
    assert [r.kind for r in small if r.doc_id == 2] == ["references"]
    long = spark.createDataFrame([(1, "# T\n" + "\n\n".join(["word " * 3] * 6))], "doc_id long, text string")
    parts = sections.chunks(long, most=40, clean=False).orderBy("chunk_idx").collect()
    assert len(parts) > 1 and {r.title for r in parts} == {"T (cont.)"} and len({r.chunk_id for r in parts}) == len(parts)
    assert "".join(r.content for r in parts).split() == ("# T " + "word " * 18).split()


def test_terms_with_boundaries(spark):
    texts = spark.createDataFrame([(1, "the AI model"), (2, "SAIL"), (3, "C++ and Über uns"), (4, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("AI", "x"), ("C++", "y"), ("über", "z"), ("++", "p")], "source string, target string")
    assert {(r.doc_id, r.source) for r in glossary.match_terms(texts, terms).collect()} == {(1, "AI"), (3, "C++"), (3, "über"), (3, "++")}


CONTENT = [
    [{"type": "title", "bbox": [1, 1, 9, 2], "content": {"title_content": [{"type": "text", "content": "T"}], "level": 9}}, {"type": "page_number", "content": {"x": "1"}}, {"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "E="}, {"type": "equation_inline", "content": " mc^2 "}]}}],
    [{"type": "image", "bbox": [0, 0, 1, 1], "content": {"image_caption": [{"type": "text", "content": "(a) l"}], "image_source": {"path": "a.png"}}}, {"type": "image", "bbox": [2, 2, 3, 3], "content": {"image_caption": [{"type": "text", "content": "(b) r"}]}}, {"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "goes on"}]}}, {"type": "odd", "content": {}}],
]


def test_projection(spark):
    df = spark.createDataFrame([(1, json.dumps(CONTENT), None, None), (2, None, None, "text\n\n# H\n\nmore"), (3, "not json", None, "x")], "doc_id long, content_list string, layout string, text string")
    out = semantics.project(df)
    blocks = out["blocks"].where("doc_id = 1").orderBy("ord").collect()
    assert [(b.kind, b.semantic_id) for b in blocks] == [("heading", "sec-0-title-0"), ("paragraph", "sec-0-text-0"), ("figure", "sec-0-image-0")]
    assert blocks[1].text == "E=$mc^2$ goes on" and blocks[1].source_refs == ["cl-0-2", "cl-1-5"] and blocks[0].level == 6
    assert blocks[2].children == ["cl-1-3", "cl-1-4"] and blocks[2].bbox == [0.0, 0.0, 3.0, 3.0] and blocks[2].group_caption == ""
    ids = [b.semantic_id for b in out["blocks"].where("doc_id = 2").orderBy("ord").collect()]
    assert ids == ["sec-0-text-0", "sec-0-title-0", "sec-0-text-0"]
    assert {(r.doc_id, r.source, r.low_fidelity) for r in out["documents"].collect()} == {(1, "content-list-v2", False), (2, "markdown", True), (3, "content-list-v2", False)}
    assert {(r.page, r.width, r.height) for r in out["page_sizes"].collect()} == {(0, 33.0, 26.0), (1, 27.0, 27.0)}


def test_history(spark):
    files = spark.createDataFrame([(1, "translation-French.md", 5), (2, "translation-French.partial.md", 5), (3, "full.md", 5), (4, "x", 5)], "doc_id long, name string, mtime long")
    meta = spark.createDataFrame([], "doc_id long, file_name string, created_at long")
    got = {r.doc_id: (r.status, r.progress, r.target_lang) for r in library.infer_history(files, meta).collect()}
    assert got == {1: ("completed", 100, "French"), 2: ("parsed", 60, "French"), 3: ("parsed", 60, None), 4: ("parsing", 30, None)}
    assert one(spark, library.percentage(F.col("a"), F.col("b")), a=1, b=3) == 33 and one(spark, library.percentage(F.col("a"), F.col("b")), a=0, b=0) is None
    best = library.best_markdown(spark.createDataFrame([(1, "a/full.md"), (1, "full.md"), (1, "notes.md")], "doc_id long, path string")).head()
    assert best.path == "full.md"


def test_translation_resumes(spark):
    class Counting(translation.Stub):
        def translate(self, text, context, language):
            assert "done before" not in text
            return super().translate(text, context, language)

    df = spark.createDataFrame([(1, "# A\ndone before\n# B\nuse `code` and bert\n# References\nkept as is")], "doc_id long, text string")
    done = spark.createDataFrame([(1, 0, "FERTIG")], "doc_id long, chunk_idx int, text string")
    rows = translation.translate(df, Counting(), "German", [("bert", "B-Modell", "name")], done).orderBy("chunk_idx").collect()
    assert [r.state for r in rows] == ["cached", "completed", "completed"]
    assert [r.text for r in rows] == ["FERTIG", "# B\nUSE `code` AND B-Modell", "# References\nkept as is"]
    assert translation.target_markdown(spark.createDataFrame(rows)).head().text.startswith("FERTIG\n\n# B")


def test_retries():
    class Failing:
        n = 0

        def translate(self, text, context, language):
            self.n += 1
            if self.n < 3:
                raise OSError("busy")
            return "ok"

    waits = []
    assert translation.Retrying(Failing(), sleep=waits.append).translate("x", "", "de") == "ok" and waits == [2.0, 4.0]


def test_frames_of_a_stream(spark):
    pieces = spark.createDataFrame([(1, 0, 'data: {"a":'), (1, 1, "1}\n\nda"), (1, 2, "ta: x\n\n: note\n\ndata: open")], "run long, seq long, text string")
    assert [(r.k, r.payload) for r in E.event_frames(pieces).orderBy("k").collect()] == [(0, '{"a":1}'), (1, "x")]


def test_sources(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("doc/full.md", "# x")
        z.writestr("__MACOSX/y", "no")
    df = spark.createDataFrame([(1, bytearray(raw.getvalue())), (2, bytearray(b"broken"))], "doc_id long, content binary")
    assert [(r.doc_id, r.path, bytes(r.content)) for r in artifacts.archive_members(df).where("error is null").collect()] == [(1, "doc/full.md", b"# x")]
    assert artifacts.archive_members(df, most=1).where("content is null and error is not null").count() >= 1
    (tmp_path / "cs.AI.csv").write_text("AGI , 通用\nno target,\nbert,b,extra\n")
    assert sorted(map(tuple, artifacts.glossaries(spark, str(tmp_path)).collect())) == [("AGI", "通用", "cs.AI"), ("bert", "b", "cs.AI")]
    texts = spark.createDataFrame([(1, 'source,target,category,enabled\n"a,b",c,,false\nd,e,f')], "id long, text string")
    assert [(r.source, r.target, r.category, r.enabled) for r in artifacts.user_glossary(texts).orderBy("line_no").collect()] == [("a,b", "c", None, False), ("d", "e", "f", True)]
    assert artifacts.user_glossary(texts, compat=True).orderBy("line_no").head().source == "a"
    feed = "<feed><entry><id>http://arxiv.org/abs/2401.1v2</id><title>A\n  B</title><summary>s</summary><author><name>X Y</name></author></entry></feed>"
    r = artifacts.arxiv_entries(spark.createDataFrame([(1, feed)], "id long, xml string")).head()
    assert (r.arxiv_id, r.version, r.title, r.authors) == ("2401.1", "v2", "A B", ["X Y"])
    assert artifacts.parser_options({"extra_formats": "HTML, html,docx", "ocr": "Yes"}) == {"model": "vlm", "extra_formats": ["html", "docx"], "ocr": True}


def test_quotes_behind_any_character(spark):
    from vellumite.operators.annotations import quotes_in

    quote, wide = "the model of the measured data set", "été — “quoted” words of the naïve café"
    quotes = [(1, quote), (2, wide), (3, " " + quote), (4, "short"), (5, quote[:23] + "?"), (6, ""), (7, quote[:24])]
    texts = [f"see{c}{quote}{c}{wide}." for c in ("(", '"', "—", "\t", "\r", " ", "x", " ", "\n", "")] + [quote, wide + quote, quote[:-1], "short", "", None, quote[:10], f"({quote}"]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[0])]
    expected = sorted((i is None, i or 0, k, t.index(q)) for i, t in rows for k, q in quotes if t and q and q in t)
    got = quotes_in(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.quote_id, r.start) for r in got.collect()) == expected


def test_runs_are_packed(spark):
    cases = [([10, 10, 10, 30, 5], [False] * 5, [(0, 2), (2, 1), (3, 1), (4, 1)]), ([30, 5], [True, False], [(0, 2)]), ([3, 3], [True, True], []), ([], [], []), ([30, 5, 50], [False, True, True], [(0, 1)])]
    df = spark.createDataFrame([(k, s, b) for k, (s, b, _) in enumerate(cases)], "k int, s array<int>, b array<boolean>")
    got = {r.k: [tuple(x) for x in r.runs] for r in df.select("k", sections.packed(F.col("s"), F.col("b"), 20).alias("runs")).collect()}
    assert got == {k: e for k, (_, _, e) in enumerate(cases)}


def test_sizes_count_utf16_units(spark):
    wide = "# 😀\n" + "😀" * 10 + "\n# B\nx"
    df = spark.createDataFrame([(1, wide)], "doc_id long, text string")
    assert [(r.start, r.length) for r in sections.sections(df).orderBy("section").collect()] == [(0, 25), (26, 5)]
    assert [(r.chunk_id, r.length) for r in sections.chunks(df, most=20, clean=False).orderBy("chunk_idx").collect()] == [("subchunk-0-0", 27), ("chunk-26-1", 5)]
    progress = spark.createDataFrame([(1, 0, 20), (1, 1, 3)], "doc_id long, idx int, length int")
    partial = spark.createDataFrame([(1, "😀" * 10 + "\n\nabc")], "doc_id long, text string")
    assert [(r.start, r.text) for r in library.rebuild_blocks(partial, progress).orderBy("idx").collect()] == [(0, "😀" * 10), (22, "abc")]


def test_terms_of_all_kinds(spark):
    texts = spark.createDataFrame([(1, "die STRASSE und Straße, ΟΔΟΣ οδος"), (2, "a → b; c++ (x)"), (3, "Machine learning is machine-learning"), (4, "deep learn")], "doc_id long, text string")
    terms = spark.createDataFrame([(s, "t") for s in ("straße", "οδος", "→", "c++", "machine learning", "learning", "LEARN", " (x) ", "deep   learn", "")], "source string, target string")
    got = {(r.doc_id, r.source) for r in glossary.match_terms(texts, terms).collect()}
    assert got == {(1, "straße"), (1, "οδος"), (2, "→"), (2, "c++"), (2, " (x) "), (3, "machine learning"), (3, "learning"), (4, "LEARN")}
    inside = {(r.doc_id, r.source) for r in glossary.contained_terms(texts, terms).collect()}
    assert (3, "LEARN") in inside and (2, "→") in inside and (4, "learning") not in inside


def test_quotes_of_all_lengths(spark):
    from vellumite.operators import annotations

    text = "start (quoted text of a certain length) — é, tab\tx" + "y" * 40
    quotes = ["quoted text of a certain length", "certain", "é", "tab\tx", "y" * 30, "absent", "x", ""]
    got = annotations.quotes_in(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string"))
    assert {(r.doc_id, r.quote_id, r.start) for r in got.collect()} == {(1, k, text.index(q)) for k, q in enumerate(quotes) if q and q in text}


def test_lanes_share_the_batch_before(spark):
    seen = []

    class Told:
        def translate(self, text, context, language):
            return f"<{len(context)}>" + text.strip()[:3]

    docs = spark.createDataFrame([(1, "".join(f"# H{k}\nbody {k}\n" for k in range(5)))], "doc_id long, text string")
    for lanes in (1, 2):
        rows = translation.translate(docs, Told(), "French", lanes=lanes).orderBy("chunk_idx").collect()
        seen.append([r.text[: r.text.index(">") + 1] for r in rows])
    assert seen[0] == ["<0>", "<6>", "<6>", "<6>", "<6>"] and seen[1] == ["<0>", "<0>", "<6>", "<6>", "<6>"]
    assert [translation.lanes_of(n, False) for n in (None, 0, 1, 3, 9)] == [2, 2, 1, 3, 4] and translation.lanes_of(4, True) == 1


def test_services():
    from vellumite.sources import services as S

    class Said:
        def __init__(self, status, text="", url="https://h/"):
            self.status, self.text, self.url = status, text, url

    slept, answers = [], [Said(500), Said(429), Said(200)]
    assert S.retried(lambda: answers.pop(0), sleep=slept.append).status == 200 and slept == [1.0, 2.0]
    failing = lambda: (_ for _ in ()).throw(OSError("down"))
    for call, kind in ((failing, OSError),):
        try:
            S.retried(call, sleep=slept.append)
            raise AssertionError
        except kind:
            pass
    assert S.retried(lambda: Said(503), sleep=slept.append).status == 503
    by = {"a": Said(404, "no"), "b": Said(200, "spam", "https://spam/x"), "c": Said(200, "yes")}
    assert S.first_that_answers("abc", by.get, ["https://spam/"]).text == "yes"
    try:
        S.first_that_answers("ab", by.get, ["https://spam/"])
        raise AssertionError
    except S.Failed as e:
        assert e.status == 200
    stub, told = S.StubParser(3), []
    states = S.parsed(stub, {"x.pdf": b"1", "bad.pdf": b"2"}, sleep=slept.append, told=told.append)
    assert [s["state"] for s in states] == ["done", "failed"] and len(told) == 3 and stub.sent == {"put://x.pdf": b"1", "put://bad.pdf": b"2"}


def test_terms_of_each_chunk(spark):
    """Given terms anywhere and first, stored ones at word boundaries; a chunk is translated with its own alone."""
    df = spark.createDataFrame([(1, "# A\nthe bert model is small\n# B\nembeddings of berth and BERT\n# References\nbert")], "doc_id long, text string")
    stored = spark.createDataFrame([(0, "bert", "B-Modell", "name"), (1, "small", "klein", None), (2, "bed", "Bett", None)], "place int, source string, target string, category string")
    given = spark.createDataFrame([(0, "bed", "Einbett", "own"), (1, "Bert", "b-modell", "own"), (2, "xyz", "nie", None)], "place int, source string, target string, category string")
    found = {r.chunk_idx: [(t.source, t.target) for t in r.terms] for r in glossary.chunk_terms(sections.chunks(df), stored, given).collect()}
    assert found == {0: [("Bert", "b-modell"), ("small", "klein")], 1: [("bed", "Einbett"), ("Bert", "b-modell")], 2: [("Bert", "b-modell")]}

    class Seen(translation.Stub):
        def translate(self, text, context, language):
            return text

    only_small = spark.createDataFrame([(1, 0, [("small", "KLEIN", "name")])], "doc_id long, chunk_idx int, terms array<struct<source:string,target:string,category:string>>")
    texts = [r.text for r in translation.translate(df, Seen(), "German", only_small).orderBy("chunk_idx").collect()]
    assert "KLEIN" in texts[0] and texts[1].startswith("# B\nembeddings of berth and BERT")


def test_gate_and_summary(spark):
    from vellumite.operators import polish

    issues = spark.createDataFrame([(1, "b", 5), (1, "a", 2), (2, "c", 1)], "doc_id long, kind string, at int")
    gate = {r.doc_id: (r.use_model, r.reason) for r in polish.model_gate(issues, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert gate == {1: (True, "a"), 2: (False, "no-issue-windows")}
    rows = spark.createDataFrame([(["figure-gap", "figure-gap", "x"], 2), ([], 0)], "issues array<string>, n int")
    assert [r.s for r in rows.select(polish.summary(F.col("issues"), F.col("n")).alias("s")).collect()] == [["Repaired: figure gap", "Repaired: x", "Open structures: 2"], ["Nothing needed repair."]]
