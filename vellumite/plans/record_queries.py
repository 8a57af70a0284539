"""Queries over stored records, payloads of services, and the events of translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import payloads as Y
from ..functions import text as X
from ..operators import annotations, glossary, markup, polish, records, sections, semantics
from ..session import shared_folder, written
from ..sources import archives, artifacts
from ..streaming import events as E
from ..streaming import runs
from . import translation
from .document_queries import _BLOCKS, _PLAN, _TERMS, _TYPED, _line_blocks, _terms
from .library_queries import _RUNS, _run_view
from .text_queries import trim_sql
from .views import MARKUP_SQL, Query, digest, lit, markup_view, paper_view, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(run, sql: str | None = None) -> None:
    QUERIES[run.__name__] = run
    if sql:
        ORACLES[run.__name__] = sql


# ---- caches and progress ----------------------------------------------------------------------------------------------


def _cache(spark, sf_dir):
    """Orders as cache entries, the latest of each customer stored."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("updated_at"), F.col("o_orderpriority").alias("body"), F.when(F.col("o_orderkey") % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"n":'), F.col("o_orderkey").cast("string"), F.lit("}"))).alias("meta"))


def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders stored, open ones put over them, then the entries of one market segment deleted."""
    rows = _cache(spark, sf_dir)
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("updated_at"), "o_orderstatus")
    rows = rows.join(status, "updated_at")
    stored = records.put(rows.where("false").drop("o_orderstatus"), rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), "doc_id")
    both = records.put(stored, rows.where("o_orderstatus <> 'F'").drop("o_orderstatus"), "doc_id")
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id"))
    return records.drop(both, gone, "doc_id").select("doc_id", "updated_at", "body")


_add(cache_put, """SELECT o_custkey AS doc_id, o_orderkey AS updated_at, o_orderpriority AS body FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F') DESC, o_orderkey DESC) = 1""")


def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers have an entry, and its metadata where that is sound."""
    rows = _cache(spark, sf_dir)
    stored = records.put(rows.where("false"), rows, "doc_id")
    return records.cached(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), stored)


_add(cache_read, """SELECT c_custkey AS doc_id, k IS NOT NULL AS has, CASE WHEN k % 5 <> 0 THEN '{"n":' || k::VARCHAR || '}' END AS meta FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")


def layers_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table after the workspace, then the knowledge is cleared."""
    names = {"documents": "documents", "sessions": "orders", "conversations": "conversations", "annotations": "benchmark", "glossary": "part", "profiles": "supplier", "other": "nation"}
    tables = {k: table(spark, sf_dir, v) for k, v in names.items()}
    parts = []
    for layer in records.LAYERS:
        for name, df in records.cleared(tables, layer).items():
            parts.append(df.agg(F.count("*").alias("n")).select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_layer = lambda layer, kept: " UNION ALL ".join(f"SELECT '{layer}' AS layer, '{n}' AS name, {f'(SELECT count(*) FROM {t})' if n in kept else '0'} AS n" for n, t in (("documents", "documents"), ("sessions", "orders"), ("conversations", "conversations"), ("annotations", "benchmark"), ("glossary", "part"), ("profiles", "supplier"), ("other", "nation")))
_add(layers_cleared, f"{_layer('workspace', ('annotations', 'glossary', 'profiles', 'other'))} UNION ALL {_layer('knowledge', ('documents', 'sessions', 'conversations', 'other'))}")


def _run_chunks(spark, sf_dir):
    """Papers' sections as finished chunks: of every third document all, of the others those before the fourth."""
    plan = sections.sections(paper_view(spark, sf_dir)).select("doc_id", F.col("section").alias("idx"), F.col("content").alias("text"))
    return plan, plan.where("doc_id % 3 = 0 or idx < 3").withColumn("language", F.when(F.col("doc_id") % 5 == 0, "fr").otherwise("zh"))


def progress_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May stored progress be used: some sources have changed, some runs have another language."""
    plan, chunks = _run_chunks(spark, sf_dir)
    docs = paper_view(spark, sf_dir)
    now = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    progress = records.started(plan, docs, F.when(F.col("doc_id") % 5 == 0, F.lit("fr")).otherwise("zh"))
    progress = progress.withColumn("source_hash", F.when(F.col("doc_id") % 11 != 0, F.col("source_hash")))
    return records.usable_progress(progress, chunks, now, F.lit("zh"))


def progress_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final texts of runs whose chunks are all there, and how many chunks stay open."""
    plan, chunks = _run_chunks(spark, sf_dir)
    progress = records.started(plan, paper_view(spark, sf_dir), F.when(F.col("doc_id") % 5 == 0, F.lit("fr")).otherwise("zh"))
    done, _, still = records.finished(progress, chunks)
    texts = done.select("doc_id", "language", digest(F.col("text")), F.lit(0).cast("long").alias("n_open"))
    return texts.unionByName(still.groupBy("doc_id", "language").agg(F.count("*").alias("n_open")).select("doc_id", "language", F.lit(None).cast("string").alias("digest"), "n_open"))


from .document_queries import _SECTIONS  # noqa: E402
from .views import PAPER_SQL  # noqa: E402

_TOTALS = f"(SELECT doc_id, count(*) AS total, count(*) FILTER (doc_id % 3 = 0 OR section < 3) AS completed, string_agg(content, chr(10) || chr(10) ORDER BY section) AS text FROM {_SECTIONS} GROUP BY doc_id)"
_add(progress_state, f"SELECT doc_id, (doc_id % 11 = 0 OR doc_id % 7 <> 0) AND doc_id % 5 <> 0 AS valid, completed, total, floor(completed / total * 100)::INT AS percentage FROM {_TOTALS} t JOIN (SELECT doc_id FROM documents) USING (doc_id)")
_add(progress_finished, f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fr' ELSE 'zh' END AS language, CASE WHEN completed >= total THEN md5(text) END AS digest, CASE WHEN completed >= total THEN 0 ELSE completed END AS n_open FROM {_TOTALS}")


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of plans before anything is translated, and whole texts as single blocks."""
    plan = sections.chunks(paper_view(spark, sf_dir), most=600, clean=False)
    every = records.planned_blocks(plan).unionByName(records.whole_block(markup_view(spark, sf_dir)))
    return every.groupBy("doc_id", "state", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


_add(planned, f"SELECT doc_id, 'planned' AS state, kind, count(*) AS n, 0 AS n_chars FROM ({_PLAN}) GROUP BY doc_id, kind UNION ALL SELECT doc_id, 'completed', 'text', 1, length(text) FROM {MARKUP_SQL} WHERE {trim_sql('text')} <> ''")


def sessions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("updated_at"))
    return records.latest_session(o.select("scope", "updated_at", F.col("updated_at").alias("session")))


_add(sessions_latest, "SELECT o_custkey AS scope, max(o_orderkey) AS updated_at, max(o_orderkey) AS session FROM orders GROUP BY o_custkey")


def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs, opened again with what is left of each."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    history = c.select(key.alias("doc_id"), F.lit("parsed").alias("status"), F.col("c_name").alias("file_name"))
    snapshots = c.where("c_nationkey < 10").select(key.alias("doc_id"), F.when(key % 2 == 0, "completed").alias("status"), F.when(key % 3 == 0, "fr").alias("language"), F.concat(F.lit(" "), F.when(key % 5 != 0, F.col("c_name")).otherwise("")).alias("markdown"))
    sessions = c.where("c_nationkey > 5").select(key.alias("doc_id"), F.lit("zh").alias("language"))
    finals = c.where("c_mktsegment = 'BUILDING'").select(key.alias("doc_id"), F.concat(F.lit("final "), "c_name").alias("text"))
    return records.restored(history, snapshots, sessions, finals)


_add(restore, """SELECT c_custkey AS doc_id, status, c_name AS file_name, CASE WHEN c_nationkey < 10 AND c_custkey % 3 = 0 THEN 'fr' WHEN c_nationkey > 5 THEN 'zh' END AS language,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'final ' || c_name WHEN c_nationkey < 10 AND c_custkey % 5 <> 0 THEN ' ' || c_name ELSE '' END AS markdown, CASE status WHEN 'completed' THEN 100 ELSE 60 END AS progress
 FROM (SELECT *, CASE WHEN c_nationkey < 10 AND c_custkey % 2 = 0 THEN 'completed' ELSE 'parsed' END AS status FROM customer)""")


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names made of parts, by provider, in natural order."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Modèle-").otherwise("modele-"), F.col("p_size").cast("string"), F.lit("b-v"), F.col("p_partkey").cast("string"))
    return records.in_natural_order(p.select(F.col("p_brand").alias("provider"), name.alias("name")), "provider", "name")


_add(natural_order, """SELECT provider, name, row_number() OVER (PARTITION BY provider ORDER BY p_size, p_partkey) AS place FROM (SELECT p_brand AS provider, p_size, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Modèle-' ELSE 'modele-' END || p_size::VARCHAR || 'b-v' || p_partkey::VARCHAR AS name FROM part)""")


def small_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of parsing, shares of storage, names of selections."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select("s_suppkey", F.round(Y.parse_progress(key % 101), 6).alias("progress"), F.round(Y.storage_ratio(key % 7, (key % 5) * 10), 6).alias("ratio"), records.selection_identity(F.when(key % 4 != 0, key), F.when(key % 3 != 0, key), key + 5, F.col("s_name")).alias("selection"))


_add(small_numbers, """SELECT s_suppkey, round(30 + (s_suppkey % 101) * 0.4, 6) AS progress, round(nullif(s_suppkey % 7, 0) / nullif((s_suppkey % 5) * 10, 0), 6) AS ratio,
 CASE WHEN s_suppkey % 4 = 0 THEN 'none' ELSE s_suppkey::VARCHAR || '::' || CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::VARCHAR ELSE '' END || '::' || (s_suppkey + 5)::VARCHAR || '::' || s_name END AS selection FROM supplier""")

# ---- payloads -----------------------------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts within the answers of chat and translation services, and read out of them."""
    d = table(spark, sf_dir, "documents")
    t, k = F.col("text"), F.col("doc_id") % 5
    part = lambda kind: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    chat = F.when(k == 0, F.get_json_object(F.to_json(F.struct(t.alias("x"))), "$")).when(k == 1, F.to_json(F.array(part("text"), part("image"), part("text")))).when(k == 2, "5").when(k == 3, "no json").otherwise(F.to_json(F.array(t, F.lit("b"))))
    plain = F.when(k == 0, F.to_json(F.struct(t.alias("data")))).when(k == 1, F.to_json(F.struct(F.lit(" ").alias("data"), t.alias("translation")))).when(k == 2, F.to_json(F.struct(F.lit(7).alias("data"), F.array(F.struct(t.alias("text"))).alias("translations")))).when(k == 3, "[]").otherwise(F.to_json(F.struct(F.array().cast("array<string>").alias("translations"))))
    return d.select("doc_id", digest(Y.message_text(chat), "message"), digest(Y.translation_text(plain), "translation"))


_add(answers, f"""SELECT doc_id, md5(CASE doc_id % 5 WHEN 1 THEN text || text WHEN 4 THEN text || 'b' ELSE '' END) AS message, CASE WHEN doc_id % 5 < 3 AND {trim_sql('text')} <> '' THEN md5(text) END AS translation FROM documents""")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of translation requests and of a parser's entries, profiles and what they lack."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    source, glossary_id = F.when(k % 3 == 0, " English ").otherwise(""), F.when(k % 6 == 0, " g1 ")
    kind = F.when(k % 2 == 0, "deeplx").otherwise("openai")
    caps = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("assist")))
    saved = Y.saved_profile(kind, F.lit(" https://h.example/v1// "), caps)
    return s.select(
        "s_suppkey", Y.translation_request(F.col("s_name"), F.lit("Chinese"), k % 2 == 0, source, glossary_id).alias("body"), Y.parser_entry(F.col("s_name"), F.when(k % 2 == 0, "id"), F.when(k % 3 == 0, F.lit(True)), F.lit(" ")).alias("entry"),
        Y.profile_error(kind, F.when(k % 7 != 0, F.col("s_name")), F.lit("u"), F.lit("m"), source, F.when(k % 4 == 0, "g"), caps).alias("lacks"), F.array_join(saved["capabilities"], ",").alias("capabilities"), saved["url"].alias("url"), Y.streams_in_pieces(kind).alias("in_pieces"),
        Y.template_url(F.lit("https://h.example/{{apiKey}}/x/"), F.col("s_name")).alias("address"), Y.stream_unsupported(F.when(k % 2 == 0, 400).otherwise(500), F.lit("Streaming is not supported")).alias("whole"), Y.heading_gap(F.concat("s_name", F.lit("  ## H"))).alias("piece"),
    )


_add(requests, """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '{"text":["' || s_name || '"],"target_lang":"ZH"' || CASE WHEN s_suppkey % 3 = 0 THEN ',"source_lang":"EN"' ELSE '' END || CASE WHEN s_suppkey % 6 = 0 THEN ',"glossary_id":"g1"' ELSE '' END || '}'
  ELSE '{"text":"' || s_name || '","source_lang":"AUTO","target_lang":"ZH"}' END AS body, '{"name":"' || s_name || '"' || CASE WHEN s_suppkey % 2 = 0 THEN ',"data_id":"id"' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN ',"is_ocr":true' ELSE '' END || '}' AS entry,
  CASE WHEN s_suppkey % 7 = 0 THEN 'required' WHEN s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0 THEN 'source' WHEN s_suppkey % 2 = 1 AND s_suppkey % 5 = 0 THEN 'capabilities' END AS lacks,
  CASE WHEN s_suppkey % 2 = 0 THEN 'translate' WHEN s_suppkey % 5 = 0 THEN '' ELSE 'assist' END AS capabilities, 'https://h.example/v1' AS url, s_suppkey % 2 = 1 AS in_pieces, 'https://h.example/' || replace(s_name, '#', '%23') || '/x' AS address,
  s_suppkey % 2 = 0 AS whole, s_name || chr(10) || chr(10) || '## H' AS piece FROM supplier""")

# ---- annotations --------------------------------------------------------------------------------------------------------


def _notes(spark, sf_dir):
    """A note on each document, quoting a line of its middle."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    quote = F.element_at(lines, F.greatest(F.lit(1), (F.size(lines) / 2).cast("int")))
    return d.select("doc_id", F.concat(F.lit("n"), "doc_id").alias("note_id"), quote.alias("selected"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), quote, F.lit(" "))).alias("exact"), F.col("source").alias("note"), F.array("lang").alias("tags"), F.when(F.col("doc_id") % 3 == 0, "zh").alias("language"), (F.col("doc_id") % 50).alias("start"), (F.col("doc_id") % 70).alias("end"))


_NOTES = "(SELECT doc_id, 'n' || doc_id::VARCHAR AS note_id, l[greatest(1, len(l) // 2)] AS selected, source AS note, lang, CASE WHEN doc_id % 3 = 0 THEN 'zh' END AS language, doc_id % 50 AS start, doc_id % 70 AS \"end\", text FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))"


def note_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.search(_notes(spark, sf_dir), " Transl ").select("doc_id", "note_id")


_add(note_search, f"SELECT doc_id, note_id FROM {_NOTES} WHERE contains(lower(selected || ' ' || note || ' ' || lang || ' ' || CASE WHEN language IS NOT NULL THEN 'translation' ELSE 'source' END), 'transl')")


def note_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by source with a range, from the last to the first."""
    notes = _notes(spark, sf_dir).withColumn("source", F.col("note"))
    return annotations.highlights(notes, ["source"]).select("source", "note_id", "place")


_add(note_highlights, f"""SELECT note AS source, note_id, row_number() OVER (PARTITION BY note ORDER BY start DESC, "end" DESC, note_id) - 1 AS place FROM {_NOTES} WHERE "end" > start""")


def note_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of its document that holds what a note quotes."""
    blocks = sections.lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").alias("block_idx"), F.col("line").alias("text"))
    return annotations.localised(_notes(spark, sf_dir), blocks, ["doc_id"]).withColumn("block_idx", F.col("block_idx").cast("long"))


_q = trim_sql("n.selected")
_add(note_blocks, f"SELECT n.doc_id, n.note_id, min(k) - 1 AS block_idx FROM (SELECT doc_id, k, l[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(k)) b JOIN {_NOTES} n ON n.doc_id = b.doc_id AND {_q} <> '' AND contains(b.line, {_q}) GROUP BY n.doc_id, n.note_id")


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    asked = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("selection"), F.when(F.col("turn") % 3 == 0, "translation").alias("tab"), F.when(F.col("turn") % 5 != 0, F.col("text")).alias("response"))
    out = annotations.conversation_rows(asked, F.lit("zh"))
    return out.select("conv_id", "turn", "scope", "tab", "language", digest(F.col("selection"), "selection"), digest(F.col("response"), "response"))


_add(conversation_records, """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND text IS NOT NULL THEN 'selection' ELSE 'document' END AS scope, CASE WHEN turn % 3 = 0 THEN 'translation' END AS tab, CASE WHEN turn % 3 = 0 THEN 'zh' END AS language,
 md5(CASE WHEN turn % 2 = 0 THEN nullif(text, '') END) AS selection, md5(coalesce(CASE WHEN turn % 5 <> 0 THEN text END, '')) AS response FROM conversations""")


def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of semantic ids where every third block has a box."""
    named = semantics.assign_ids(_line_blocks(spark, sf_dir)).withColumns({"page": F.floor(F.col("ord") / 5), "bbox": F.when(F.col("ord") % 3 == 0, F.array(F.lit(1.0)))})
    return semantics.first_pages(named)


_add(first_pages, f"""SELECT doc_id, semantic_id, coalesce(arg_min(ord // 5, ord) FILTER (ord % 3 = 0), arg_min(ord // 5, ord))::BIGINT AS page FROM (SELECT doc_id, ord, 'sec-' || greatest(raw, 0)::BIGINT::VARCHAR || '-' || stype || '-' ||
  CASE WHEN stype = 'title' THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, raw, stype ORDER BY ord) - 1 END::VARCHAR AS semantic_id FROM {_TYPED}) GROUP BY ALL""")


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", (F.col("l_partkey") % 10).alias("page"))
    return annotations.on_page(rows, 3).groupBy("doc_id").agg(F.count("*").alias("n"))


_add(page_anchors, "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_partkey % 10 = 2 GROUP BY l_orderkey")


def polish_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as items of content lists, every sixth a page number, numbered as polishing does."""
    rows = sections.lines(table(spark, sf_dir, "documents")).select("doc_id", F.floor(F.col("line_no") / 10).alias("page"), F.col("line_no").alias("pos"), F.when(F.col("line_no") % 6 == 5, "page_number").otherwise("paragraph").alias("raw_type"), F.col("line").alias("text"))
    return semantics.polish_ordinals(rows).select("doc_id", F.col("pos").cast("long").alias("pos"), "ord", "id")


_add(polish_ordinals, f"""SELECT doc_id, pos, ord, 'pp-' || (pos // 10)::VARCHAR || '-' || ord::VARCHAR AS id FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM (SELECT doc_id, k - 1 AS pos, l[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(k)) WHERE pos % 6 <> 5 AND {trim_sql('line')} <> '')""")

# ---- terms, polish ------------------------------------------------------------------------------------------------------


def term_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a text contains anywhere, within words too."""
    return glossary.contained_terms(table(spark, sf_dir, "documents"), _terms(spark, sf_dir))


_add(term_contained, f"SELECT d.doc_id, t.source, t.target FROM (SELECT doc_id, lower(text) AS low FROM documents) d JOIN {_TERMS} t ON contains(d.low, lower(t.source))")


def joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polish.joined_blocks(_line_blocks(spark, sf_dir)).select("doc_id", digest(F.col("text")))


_add(joined_blocks, f"SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY ord)) AS digest FROM {_BLOCKS} GROUP BY doc_id")


def repaired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the third line of each text replaced by a model's answers, of which one is fenced and one is blank."""
    d = markup_view(spark, sf_dir)
    lines = sections.lines(d).where("line_no in (0, 2)")
    answer = F.when(F.col("line_no") == 0, F.concat(F.lit("```markdown\n<0>\n```"))).when(F.col("doc_id") % 2 == 0, " ").otherwise("Repaired markdown: <2>")
    repairs = lines.select("doc_id", F.col("line_no").alias("k"), F.col("line").alias("current"), answer.alias("answer"))
    return polish.repaired_windows(d, repairs).select("doc_id", digest(F.col("text")))


_put = lambda t, w, a: f"CASE WHEN {trim_sql(w)} = '' OR strpos({t}, {w}) = 0 THEN {t} ELSE left({t}, strpos({t}, {w}) - 1) || {a} || substr({t}, strpos({t}, {w}) + length({w})) END"
_add(repaired_windows, f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 OR len(l) < 3 THEN a ELSE {_put('a', 'l[3]', lit('<2>'))} END) AS digest FROM (SELECT doc_id, l, {_put('text', 'l[1]', lit('<0>'))} AS a FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {MARKUP_SQL}))")


def polished_on_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = markup_view(spark, sf_dir)
    shown = polish.on_load(F.col("text"), X.collapse_blank_lines(F.col("text")))
    return d.select("doc_id", digest(shown["polished"], "polished"))


_c = trim_sql("regexp_replace(text, '\n{3,}', '\n\n', 'g')")
_add(polished_on_load, f"SELECT doc_id, CASE WHEN {_c} <> text THEN md5({_c}) END AS polished FROM {MARKUP_SQL}")


def polish_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents with files of several depths, some JSON broken, some Markdown given."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    file = lambda path, text, where: s.where(where).select(k.alias("doc_id"), F.lit(path).alias("path"), text.alias("text"))
    files = file("a/b/full.md", F.lit("deep"), "true").unionByName(file("full.md", F.concat(F.lit(" "), "s_name"), "s_nationkey < 12")).unionByName(file("x/layout.json", F.when(k % 2 == 0, "{}").otherwise("{"), "s_nationkey > 5")).unionByName(file("content_list_v2.json", F.lit("[]"), "s_nationkey = 3"))
    return artifacts.polish_sources(s.select(k.alias("doc_id"), F.when(k % 10 == 0, " given ").alias("given")), files)


_add(polish_inputs, """SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 = 0 THEN 'given' WHEN s_nationkey < 12 THEN s_name ELSE 'deep' END AS markdown, CASE WHEN s_nationkey = 3 THEN '[]' END AS content_list,
 CASE WHEN s_nationkey > 5 AND s_suppkey % 2 = 0 THEN '{}' END AS layout, '/api/media/' || s_suppkey::VARCHAR AS prefix FROM supplier""")


def media_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths asked below a root of files: within it, out of it, missing, and by an older name."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    files = s.select(F.concat(k, F.when(F.col("s_suppkey") % 2 == 0, F.lit("/original.pdf")).otherwise("/x_origin.pdf")).alias("path"))
    ways = ["{}/original.pdf", "{}/./a/../original.pdf", "../{}/original.pdf", "{}/full.md"]
    way = F.element_at(F.array(*map(F.lit, ways)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return artifacts.media_paths(s.select(F.replace(way, F.lit("{}"), k).alias("asked")), files)


_add(media_served, """SELECT asked, CASE WHEN status = 200 THEN k || CASE WHEN s_suppkey % 2 = 0 THEN '/original.pdf' ELSE '/x_origin.pdf' END END AS path, status FROM (SELECT *, s_suppkey::VARCHAR AS k, replace(['{}/original.pdf', '{}/./a/../original.pdf', '../{}/original.pdf', '{}/full.md'][s_suppkey % 4 + 1], '{}', s_suppkey::VARCHAR) AS asked,
 CASE s_suppkey % 4 WHEN 2 THEN 403 WHEN 3 THEN 404 ELSE 200 END AS status FROM supplier)""")

# ---- events of translations ---------------------------------------------------------------------------------------------


def _blocks(spark, sf_dir):
    """Chunks of papers through the stub; of every fourth document the first two are cached."""
    rows = sections.chunks(paper_view(spark, sf_dir), most=600, clean=False)
    text = F.when(F.col("kind") == "references", F.col("content")).otherwise(translation.translated_expression(F.col("content"), F.lit("French")))
    state = F.when((F.col("doc_id") % 4 == 0) & (F.col("chunk_idx") < 2), "cached").otherwise("completed")
    return rows.select("doc_id", "chunk_idx", "chunk_id", "kind", "title", state.alias("state"), text.alias("text"))


def _told(events: DataFrame) -> DataFrame:
    return events.select("doc_id", F.col("seq").cast("long").alias("seq"), "type", "chunk", digest(F.col("text"), "text"), "percentage", "state", "message")


def translation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a translation one chunk after the other sends, resumed where chunks are cached."""
    return _told(translation.events(_blocks(spark, sf_dir)))


def translation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with three chunks at once and nothing stored."""
    return _told(translation.events(_blocks(spark, sf_dir), lanes=translation.lanes_of(3, False), keep=False))


def _events_sql(lanes: int, keep: bool) -> str:
    first = "CASE WHEN doc_id % 4 = 0 THEN least(2, count(*)) ELSE 0 END" if keep else "0"
    state = "CASE WHEN doc_id % 4 = 0 AND chunk_idx < 2 THEN 'cached' ELSE 'completed' END"
    each = [
        ("b", "1", "chunk_idx", "0", "'chunk_started'", "chunk_id", "NULL", "NULL", "NULL", "NULL"), ("b", "2", "chunk_idx", "0", "'chunk'", "chunk_id", "md5(o)", "NULL", "NULL", "NULL"),
        ("b", "2", "chunk_idx", "1", "'chunk_completed'", "chunk_id", "NULL", "NULL", state, "NULL"), ("b", "2", "chunk_idx", "2", "'progress'", "NULL", "NULL", "floor((chunk_idx + 1) / total * 100)", "NULL", "NULL"),
    ]
    if lanes == 1:
        skipped = "CASE WHEN kind = 'references' THEN 'Skipping reference section' ELSE 'Translating: ' || title END"
        each += [("b", "1", "chunk_idx", k, "'status'", "NULL", "NULL", "NULL", "NULL", m) for k, m in (("1", "'Refining: ' || title"), ("2", skipped))]
    row = "SELECT doc_id, {}::BIGINT AS p0, {}::BIGINT AS p1, {}::BIGINT AS p2, {}::BIGINT AS p3, {} AS type, {}::VARCHAR AS chunk, {}::VARCHAR AS text, {}::INT AS percentage, {}::VARCHAR AS state, {}::VARCHAR AS message FROM {}"
    nothing = ["NULL"] * 4
    parts = [row.format(*e, "j WHERE chunk_idx >= first") for e in each]
    parts += [row.format("-1", "1", "chunk_idx + 1", "0", "'chunk_planned'", "chunk_id", *nothing, "j"), row.format("-1", "3", "chunk_idx", "0", "'hydrate_blocks'", "chunk_id", "md5(o)", "NULL", "'cached'", "NULL", "j WHERE chunk_idx < first")]
    parts += [row.format("-1", "0", "0", "0", "'status'", *nothing, "'Chunking document...'", "f"), row.format("-1", "1", "0", "0", "'run_started'", *nothing, "CASE WHEN first > 0 THEN 'resume' ELSE 'fresh' END", "f")]
    parts += [row.format("-1", "2", "0", "0", "'status'", *nothing, "'Resuming from chunk ' || first::BIGINT::VARCHAR || '...'", "f WHERE first > 0"), row.format("-1", "4", "0", "0", "'progress'", "NULL", "NULL", "floor(first / total * 100)", "NULL", "NULL", "f")]
    parts += [row.format("1099511627776", "0", "0", "0", "'done'", *nothing, "'Translation complete.'", "f")]
    if lanes > 1:
        said = f"'Parallel batch ' || (b + 1)::VARCHAR || '/' || n::VARCHAR || ' · ' || least({lanes}, total - first - b * {lanes})::BIGINT::VARCHAR || ' agents'"
        parts += [row.format("b", "0", "0", "0", "'status'", *nothing, said, f"(SELECT *, ceil((total - first) / {lanes})::BIGINT AS n FROM f), unnest(range(0, n)) AS u(b)")]
    return f"""WITH {_CHUNKS_SQL}, f AS (SELECT doc_id, count(*) AS total, {first} AS first FROM c GROUP BY doc_id),
 j AS MATERIALIZED (SELECT c.*, total, first, floor((chunk_idx - first) / {lanes}) AS b FROM c JOIN f USING (doc_id)), e AS ({" UNION ALL ".join(parts)})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p0, p1, p2, p3) - 1 AS seq, type, chunk, text, percentage, state, message FROM e"""


#: Every chunk with its translation by the stub.
_CHUNKS_SQL = f"""c AS MATERIALIZED (SELECT *, CASE WHEN kind = 'references' THEN content ELSE translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS o FROM ({_PLAN.replace("md5(content) AS digest", "content")}))"""
_add(translation_events, _events_sql(1, True))
_add(translation_batches, _events_sql(3, False))


def _glossaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of parts as stored terms, the last words of quotes as given ones; their place is the source."""
    shape = lambda df, category: df.where("source <> ''").distinct().select(F.col("source").alias("place"), "source", F.concat(F.lit("to "), "source").alias("target"), F.lit(category).alias("category"))
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("source"))
    heads = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"(\S+)$", 1).alias("source"))
    return shape(words.union(table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^(\S+)", 1))), "part"), shape(heads, "quote")


def chunk_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each chunk, given ones first."""
    found = glossary.chunk_terms(sections.chunks(paper_view(spark, sf_dir), most=600, clean=False), *_glossaries(spark, sf_dir))
    return found.select("doc_id", "chunk_idx", F.posexplode("terms").alias("place", "t")).select("doc_id", "chunk_idx", "place", "t.source", "t.target", "t.category")


_BOUND = r"[\p{L}\p{N}_]"
_add(chunk_glossary, rf"""WITH c AS MATERIALIZED ({_PLAN.replace("md5(content) AS digest", "content")}),
 stored AS (SELECT DISTINCT source FROM (SELECT unnest(string_split(p_name, ' ')) AS source FROM part UNION ALL SELECT regexp_extract(text, '^(\S+)', 1) FROM benchmark) WHERE source <> ''), given AS (SELECT DISTINCT regexp_extract(text, '(\S+)$', 1) AS source FROM benchmark WHERE regexp_extract(text, '(\S+)$', 1) <> ''),
 s AS (SELECT source, lower(source) AS low, regexp_replace(source, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g') AS e, regexp_extract(lower(source), '{_BOUND}+') AS run FROM stored), w AS (SELECT doc_id, chunk_idx, unnest(list_distinct(regexp_extract_all(lower(content), '{_BOUND}+'))) AS run FROM c),
 f AS (SELECT doc_id, chunk_idx, 0 AS rank, source, 'quote' AS category FROM c JOIN given ON contains(lower(content), lower(source)) UNION ALL
  SELECT c.doc_id, c.chunk_idx, 1, s.source, 'part' FROM s JOIN w USING (run) JOIN c USING (doc_id, chunk_idx) WHERE s.low = s.run OR contains(lower(content), s.low) AND regexp_matches(content, '(?i)' || CASE WHEN regexp_matches(s.source, '^{_BOUND}') THEN '(?:^|[^\p{{L}}\p{{N}}_])' ELSE '' END || e || CASE WHEN regexp_matches(s.source, '{_BOUND}$') THEN '(?:[^\p{{L}}\p{{N}}_]|$)' ELSE '' END)),
 d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx, lower(source) ORDER BY rank, source) AS again FROM f)
SELECT doc_id, chunk_idx, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY rank, source) - 1 AS place, source, 'to ' || source AS target, category FROM d WHERE again = 1""")


def translate_with_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers through the stub with the terms of each chunk: what each chunk's translation says."""
    docs = paper_view(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # once, for both readings
    terms = glossary.chunk_terms(sections.chunks(docs), *_glossaries(spark, sf_dir))
    out = translation.translate(docs, translation.Stub(), "French", terms)
    return out.select("doc_id", "chunk_idx", "state", digest(F.col("text")))


_add(translate_with_terms)


def _folded(blocks: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("run").orderBy("born")) - 1
    return blocks.select(F.col("run").alias("doc_id"), place.alias("chunk_idx"), F.col("chunk").alias("chunk_id"), "state", digest(F.col("text"), "text"))


def resumed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of resumed translations, folded: the blocks that went in, hydrated ones too."""
    return _folded(runs.fold_blocks(translation.events(_blocks(spark, sf_dir)).withColumnRenamed("doc_id", "run")))


def resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over the events, which takes up each run where the micro-batch before left it."""
    root = shared_folder(spark, "resumed-stream")
    told = translation.events(_blocks(spark, sf_dir)).withColumnRenamed("doc_id", "run")
    for half in (0, 1):  # the events of a run come in order, a file after the other
        told.where((F.col("seq") >= 9) == bool(half)).write.mode("append").parquet(f"{root}/events/part={half}")
    stream = spark.readStream.schema(told.schema.add("part", "integer")).option("maxFilesPerTrigger", 64).parquet(f"{root}/events")
    updates = runs.fold_stream(stream, stall=None, give_up=None)
    E.write_updates(updates, f"{root}/updates", f"{root}/checkpoint").awaitTermination()
    return _folded(runs.latest_blocks(spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{root}/updates")))


_RESUMED = f"WITH {_CHUNKS_SQL} SELECT doc_id, chunk_idx, chunk_id, CASE WHEN doc_id % 4 = 0 AND chunk_idx < 2 THEN 'cached' ELSE 'completed' END AS state, md5(o) AS text FROM c"
_add(resumed_blocks, _RESUMED)
_add(resumed_stream, _RESUMED)


def translation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the chunks of papers, each with the end of the translation before it."""
    blocks = _blocks(spark, sf_dir)
    rows = translation.previous_tail(blocks.select("doc_id", "chunk_idx", "text"))
    return rows.select("doc_id", "chunk_idx", digest(translation.prompt(F.col("text"), F.lit(""), F.col("context"), F.lit("French"))))


_add(translation_prompts, f"""WITH c AS (SELECT doc_id, chunk_idx, CASE WHEN kind = 'references' THEN content ELSE translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS o FROM ({_PLAN.replace("md5(content) AS digest", "content")})),
 p AS (SELECT *, coalesce(right(lag(o) OVER (PARTITION BY doc_id ORDER BY chunk_idx), 500), '') AS t FROM c)
SELECT doc_id, chunk_idx, md5('Translate the academic text into French. Keep Markdown, HTML and every marker between @@ as they are. Return the translation alone.' || CASE WHEN t <> '' THEN chr(10) || chr(10) || '<context>' || chr(10) || t || chr(10) || '</context>' ELSE '' END
 || CASE WHEN o <> '' THEN chr(10) || chr(10) || '<source_text>' || chr(10) || o || chr(10) || '</source_text>' ELSE '' END) AS digest FROM p""")


def event_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each run in any slot of ten minutes."""
    return E.throttled(_run_view(table(spark, sf_dir, "events")), ["run"], 600_000).select("run", F.col("slot").cast("long").alias("slot"), "seq", "type")


_add(event_throttle, f"SELECT run, floor(epoch_us(ts) / 600000000)::BIGINT AS slot, arg_max(seq, (ts, seq)) AS seq, arg_max(type, (ts, seq)) AS type FROM {_RUNS} GROUP BY run, slot")


def win_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream with a watermark of ten minutes: the windows that are closed when the input ends."""
    root = shared_folder(spark, "win-closed")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    closed = E.closed_windows(stream, "1 hour", "10 minutes", ["event_type"])
    E.write_closed(closed, f"{root}/windows", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{root}/windows")


_add(win_closed, "SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")


# ---- archives of parsed documents ----------------------------------------------------------------------------------------


def _zipped(root: str):
    """Writes a parser's result of each document as an archive of its own below ``root``; some lack Markdown, some are cut off."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            paths = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    if doc_id % 5:
                        z.writestr("doc/full.md" if doc_id % 2 else "full.md", f"![a figure](images/{doc_id}.png)\n\n{text or ''}")
                    z.writestr("doc/notes/readme.txt", "no Markdown")
                    z.writestr("__MACOSX/full.md", "of the system")
                    z.writestr("doc/layout.json" if doc_id % 3 else "doc/auto/layout.json", "{}")
                content = raw.getvalue()
                path = f"{folder}/{doc_id}.zip"
                with store.open_output_stream(path) as out:
                    out.write(content[: len(content) // 2] if doc_id % 7 == 0 else content)
                paths.append(f"{root}/{doc_id}.zip")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(paths, pa.string())], names=["doc_id", "archive"])

    return run


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From archives to cache entries: each document as a parser's result, unpacked, its images addressed, its primary Markdown read."""
    root = shared_folder(spark, "parsed")
    made = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_zipped(f"{root}/zip"), "doc_id long, archive string")
    out = archives.entries(written(made, root, "archives"))
    return out.select("doc_id", "state", "error", "path", F.when(~F.col("markdown").rlike(r"[\\$]"), F.md5("markdown")).alias("digest"), "layout")


_add(archive_entries, r"""WITH d AS (SELECT doc_id, doc_id % 7 = 0 AS cut, doc_id % 5 = 0 AS bare, CASE WHEN doc_id % 2 = 1 THEN 'doc/' ELSE '' END AS folder, coalesce(text, '') AS text FROM documents),
 m AS (SELECT *, '![a figure](/api/media/' || doc_id || '/' || folder || 'images/' || doc_id || '.png)' || chr(10) || chr(10) || text AS md FROM d)
SELECT doc_id, CASE WHEN cut OR bare THEN 'failed' ELSE 'done' END AS state, CASE WHEN cut THEN 'Result processing failed' WHEN bare THEN 'No markdown file found in ZIP' END AS error, CASE WHEN NOT cut AND NOT bare THEN folder || 'full.md' END AS path,
 CASE WHEN NOT cut AND NOT bare AND NOT regexp_matches(md, '[\\$]') THEN md5(md) END AS digest, CASE WHEN NOT cut THEN '/api/media/' || doc_id || CASE WHEN doc_id % 3 <> 0 THEN '/doc/layout.json' ELSE '/doc/auto/layout.json' END END AS layout FROM m""")


# ---- structure from layouts alone, and what a polish run reports -----------------------------------------------------------


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a layout tree: a node for each line, titles and captions among them, one in three a level deeper, some no JSON."""
    span = lambda c: F.struct(c.alias("content"))
    kind = lambda k: F.element_at(F.array(*map(F.lit, ("title", "text", "image_caption", "table_caption", "footer"))), (k % 5 + 1).cast("int"))
    leaf = lambda line, k: F.struct(kind(k).alias("type"), F.array(span(line), span(F.lit("  end "))).alias("spans"))
    node = lambda line, k: F.struct(F.lit("group").alias("type"), F.struct(F.array(leaf(line, k)).alias("blocks")).alias("deeper"), F.when(k % 3 == 0, F.array(leaf(F.lit("first"), k + 1))).alias("blocks"))
    pages = F.to_json(F.struct(F.array(F.struct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), node).alias("para_blocks"))).alias("pdf_info")))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "{broken").otherwise(pages).alias("layout"))


def layout_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of layout trees, in the order of their nodes."""
    out = markup.layout_structure(_layouts(spark, sf_dir), "doc_id", "layout")
    return out.select("doc_id", "ordinal", "block_id", "kind", "raw_type", digest(F.col("markdown")), "heading_level", digest(F.col("caption"), "caption"))


_add(layout_structure, f"""WITH n AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents WHERE doc_id % 11 <> 0),
 l AS (SELECT doc_id, k, 0 AS inner_, 'first' AS line, k + 1 AS t FROM n WHERE k % 3 = 0 UNION ALL SELECT doc_id, k, 1, line, k FROM n),
 s AS (SELECT *, ['title', 'text', 'image_caption', 'table_caption', 'footer'][t % 5 + 1] AS raw_type, {trim_sql(f"regexp_replace(line || '   end ', {lit(f'{P.S}{{2,}}')}, ' ', 'g')")} AS text FROM l),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, inner_) - 1 AS ordinal FROM s WHERE raw_type <> 'footer' AND text <> '')
SELECT doc_id, ordinal, 'pp-0-' || ordinal AS block_id, CASE raw_type WHEN 'title' THEN 'heading' WHEN 'text' THEN 'paragraph' WHEN 'image_caption' THEN 'image' ELSE 'table' END AS kind, raw_type, md5(CASE WHEN raw_type = 'title' THEN '## ' || text ELSE text END) AS digest,
 CASE WHEN raw_type = 'title' THEN 2 END AS heading_level, CASE WHEN raw_type LIKE '%caption' THEN md5(text) END AS caption FROM o""")


def usable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as profiles of services that can analyse; every fifth is a plain translation service."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "deeplx").otherwise("openai").alias("kind"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("translate"))).otherwise(F.array(F.lit("translate"), F.lit("analyse"))).alias("capabilities"))
    each = [translation.usable_profiles(s, c).select("s_suppkey", F.lit(c).alias("capability")) for c in ("translate", "analyse")]
    return each[0].unionByName(each[1])


_add(usable_profiles, "SELECT s_suppkey, 'translate' AS capability FROM supplier UNION ALL SELECT s_suppkey, 'analyse' FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0")


def event_frames_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as frames for a browser, null members left out."""
    rows = _run_view(table(spark, sf_dir, "events")).select("run", "seq", "type", "chunk", "state")
    return E.sse(rows, ["run", "seq"])


_add(event_frames_out, f"""SELECT run, seq, 'data: {{"type":"' || type || '"' || CASE WHEN chunk IS NULL THEN '' ELSE ',"chunk":"' || chunk || '"' END || CASE WHEN state IS NULL THEN '' ELSE ',"state":"' || state || '"' END || '}}' || chr(10) || chr(10) AS frame FROM {_RUNS}""")


def _saved(root: str):
    """Writes each page as a file of its own below ``root``."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for page_id, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
                with store.open_output_stream(f"{folder}/{page_id:012d}.pdf") as out:
                    out.write((html or "").encode())
            yield pa.RecordBatch.from_arrays([batch["page_id"]], names=["page_id"])

    return run


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page uploaded as a file: named by its bytes, copies once, and whether it waits for the parser; the first half of the names is parsed."""
    root = shared_folder(spark, "uploads")
    written(table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(_saved(f"{root}/files"), "page_id long"), root, "saved")
    found = artifacts.uploads(spark, f"{root}/files").select("doc_id", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.octet_length("content").cast("long").alias("n_bytes"))
    waits = artifacts.unparsed(found, found.where("doc_id < '8'")).select("doc_id", F.lit(True).alias("waits"))
    return found.join(waits, "doc_id", "left").select("doc_id", "name", "n_bytes", F.coalesce("waits", F.lit(False)).alias("waits"))


_add(uploads, "SELECT h AS doc_id, min(name) AS name, min(n) AS n_bytes, h >= '8' AS waits FROM (SELECT sha256(coalesce(html, '')) AS h, lpad(page_id::VARCHAR, 12, '0') || '.pdf' AS name, octet_length(encode(coalesce(html, ''))) AS n FROM pages) GROUP BY h")


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection in every text with what stands around it."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    start = (F.col("doc_id") * 37 % F.greatest(F.lit(1), F.length("text"))).cast("int")
    s = annotations.snapshot(F.col("text"), start, F.least(F.length("text"), start + 60), 40, 300)
    return d.select("doc_id", s.alias("s")).select("doc_id", *(digest(F.col(f"s.{c}"), c) for c in ("exact", "prefix", "suffix", "context")))


_add(selections, """SELECT doc_id, md5(substr(text, a + 1, z - a)) AS exact, md5(substr(text, greatest(0, a - 40) + 1, least(a, 40))) AS prefix, md5(substr(text, z + 1, 40)) AS suffix, md5(substr(text, greatest(0, a - 300) + 1, least(n, z + 300) - greatest(0, a - 300))) AS context
 FROM (SELECT *, least(n, a + 60) AS z FROM (SELECT doc_id, text, length(text) AS n, (doc_id * 37 % greatest(1, length(text)))::INT AS a FROM documents WHERE text IS NOT NULL))""")


def polish_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a model would help, by the issues that their line blocks leave open; a third has no window left."""
    blocks = _line_blocks(spark, sf_dir)
    issues = polish.residual_issues(blocks)
    windows = polish.issue_windows(blocks, issues)
    return polish.model_gate(issues, windows.where("doc_id % 3 <> 0"))


_add(polish_gates)


def polish_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deep run changed in each text, as its messages say."""
    polished = markup_view(spark, sf_dir).select("doc_id", markup.polish_deep(F.col("text")).alias("p"))
    said = polish.summary(F.col("p.issues"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(0))
    return polished.select("doc_id", digest(F.col("p.text")), F.array_join(said, "; ").alias("summary"))


_add(polish_reports)
