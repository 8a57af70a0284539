"""Queries over jobs, conversations, events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import annotations, library, sections
from ..session import shared_folder
from ..streaming import events as E
from ..streaming import runs
from . import translation
from .views import Query, digest, lit, paper_view, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(run, sql: str | None = None) -> None:
    QUERIES[run.__name__] = run
    if sql:
        ORACLES[run.__name__] = sql




def _server(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "parsed").otherwise("error")
    last = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max(F.struct("o_orderdate", "o_orderkey", status.alias("status"))).alias("m"))
    return last.select("doc_id", "m.status", F.unix_seconds(F.col("m.o_orderdate").cast("timestamp")).alias("updated_at"))


def _customers(spark, sf_dir):
    """A state of each customer's own."""
    c = table(spark, sf_dir, "customer")
    status = F.element_at(F.array(*map(F.lit, ["uploading", "parsing", "translating", "parsed", "completed"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("doc_id"), status.alias("status"), (F.lit(700_000_000) + F.col("c_custkey") * 100_000).alias("updated_at"))


def _local(spark, sf_dir):
    """The states that this side knows: of all customers but those of one nation, which only the server has."""
    known = table(spark, sf_dir, "customer").where("c_nationkey <> 7").select(F.col("c_custkey").alias("doc_id"))
    return _customers(spark, sf_dir).join(known, "doc_id", "left_semi")


_SERVER = "(SELECT o_custkey AS doc_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'parsed' ELSE 'error' END, (o_orderdate, o_orderkey)) AS status, epoch(max(o_orderdate))::BIGINT AS updated_at FROM orders GROUP BY o_custkey)"
_LOCAL = "(SELECT c_custkey AS doc_id, ['uploading', 'parsing', 'translating', 'parsed', 'completed'][c_custkey % 5 + 1] AS status, 700000000 + c_custkey * 100000 AS updated_at FROM customer WHERE c_nationkey <> 7)"
_CUSTOMERS = _LOCAL.replace(" WHERE c_nationkey <> 7", "")
_MERGED = f"""(SELECT coalesce(s.doc_id, l.doc_id) AS doc_id,
  CASE WHEN s.doc_id IS NULL THEN CASE WHEN l.status = 'translating' THEN 'parsed' ELSE l.status END WHEN l.doc_id IS NOT NULL AND (l.status IN ('uploading', 'parsing') OR (l.updated_at > s.updated_at AND l.status <> 'translating')) THEN l.status ELSE s.status END AS status,
  CASE WHEN s.doc_id IS NULL THEN l.updated_at WHEN l.doc_id IS NOT NULL AND (l.status IN ('uploading', 'parsing') OR (l.updated_at > s.updated_at AND l.status <> 'translating')) THEN l.updated_at ELSE s.updated_at END AS updated_at
  FROM {_SERVER} s FULL JOIN {_LOCAL} l ON s.doc_id = l.doc_id)"""


def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.merge_history(_server(spark, sf_dir), _local(spark, sf_dir))


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest jobs, a report of a fixed length."""
    return library.latest(history_merge(spark, sf_dir))


_add(history_merge, f"SELECT * FROM {_MERGED}")
_add(history_latest, f"SELECT * FROM {_MERGED} ORDER BY updated_at DESC, doc_id LIMIT 20")


def history_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states from file names made of orders."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("translation-"), "o_orderpriority", F.lit(".md"))).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("translation-"), "o_orderpriority", F.lit(".partial.md"))).when(F.col("o_orderkey") % 3 == 0, "full.md").otherwise("notes.txt")
    files = o.select(F.col("o_custkey").alias("doc_id"), name.alias("name"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    meta = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("file_name"), (F.col("c_custkey") * 1000).alias("created_at"))
    return library.infer_history(files, meta)


_add(history_infer, """SELECT f.doc_id, CASE WHEN done IS NOT NULL THEN 'completed' WHEN part IS NOT NULL OR parsed THEN 'parsed' ELSE 'parsing' END AS status, CASE WHEN done IS NOT NULL THEN 100 WHEN part IS NOT NULL OR parsed THEN 60 ELSE 30 END AS progress,
  coalesce(done, part) AS target_lang, coalesce(c.c_name, 'Unknown.pdf') AS file_name, coalesce(c.c_custkey * 1000, mtime) AS updated_at FROM (
  SELECT o_custkey AS doc_id, min(CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority END) AS done, min(CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN o_orderpriority END) AS part, bool_or(o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0) AS parsed, epoch(max(o_orderdate))::BIGINT AS mtime
  FROM orders GROUP BY o_custkey) f LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = f.doc_id""")


def recovered_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir).join(_server(spark, sf_dir).select("doc_id", F.col("status").alias("h")), "doc_id", "left")
    source, target = F.col("doc_id") % 2 == 0, F.col("doc_id") % 7 == 0
    status = library.recovered_status(F.col("status"), F.col("h"), source, target)
    state = library.control_state(source, F.col("status"), target, F.col("doc_id") % 11 == 0)
    return rows.select("doc_id", status.alias("recovered"), library.interrupted_message(F.col("status")).alias("message"), state.alias("control"), X.status_label(F.col("status")).alias("label"))


_t = "CASE WHEN l.doc_id % 7 = 0 THEN 'completed' WHEN l.doc_id % 2 = 0 THEN 'parsed' ELSE '{}' END"
_labels = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in P.STATUS_LABELS.items())
_add(recovered_status, f"""SELECT l.doc_id, CASE WHEN l.status NOT IN ('uploading', 'parsing', 'translating') THEN l.status WHEN s.status = 'completed' THEN 'completed' WHEN s.status = 'error' THEN {_t.format('error')} ELSE {_t.format('idle')} END AS recovered,
  CASE l.status WHEN 'translating' THEN '上次翻译已中断，已切换为可恢复状态。' WHEN 'parsing' THEN '上次解析未正常结束，请重新发起解析。' WHEN 'uploading' THEN '上次上传未完成，请重新上传文件。' END AS message,
  CASE WHEN l.doc_id % 2 <> 0 THEN 'unparsed' WHEN l.status = 'translating' THEN 'active' WHEN l.doc_id % 7 = 0 THEN 'completed' WHEN l.doc_id % 11 = 0 THEN 'resumable' ELSE 'untranslated' END AS control, CASE l.status {_labels} ELSE l.status END AS label
  FROM {_CUSTOMERS} l LEFT JOIN {_SERVER} s ON s.doc_id = l.doc_id""")


def resume_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May the translation of a document go on: by its text's hash and its finished lines."""
    rows = table(spark, sf_dir, "documents").withColumn("total", F.size(F.split("text", "\n")))
    done = F.col("doc_id") % (F.col("total") + 1)
    valid = F.md5("text") == F.when(F.col("doc_id") % 6 == 0, F.md5(F.concat("text", F.lit(" ")))).otherwise(F.md5("text"))
    total = F.when(F.col("doc_id") % 10 != 1, F.col("total"))
    d = library.resume_decision(F.col("doc_id") % 4 == 0, F.col("doc_id") % 5 != 0, valid, done, total)
    return rows.select("doc_id", d["reason"].alias("reason"), d["can_resume"].alias("can_resume"), d["percentage"].alias("percentage"))


_add(resume_decision, """SELECT doc_id, reason, reason = 'resumable' AS can_resume, CASE WHEN reason = 'resumable' THEN floor((doc_id % (total + 1)) / total * 100)::INT END AS percentage FROM (SELECT doc_id, len(string_split(text, chr(10))) AS total,
  CASE WHEN doc_id % 4 = 0 THEN 'complete' WHEN doc_id % 5 = 0 THEN 'no_progress' WHEN doc_id % 6 = 0 THEN 'invalid' WHEN doc_id % 10 = 1 THEN 'corrupted' ELSE 'resumable' END AS reason FROM documents)""")


def best_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    path = F.concat(F.element_at(F.array(F.lit(""), F.lit("a/"), F.lit("a/b/"), F.lit("Docs/")), (F.col("l_partkey") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ["full.md", "notes.md", "translation-x.md", "content_list.md", "Full_text.md"])), (F.col("l_linenumber") % 5 + 1).cast("int")))
    return library.best_markdown(li.select(F.col("l_orderkey").alias("doc_id"), path.alias("path")).distinct()).select("doc_id", "path")


_add(best_markdown, """SELECT doc_id, path FROM (SELECT *, len(string_split(path, '/')) AS depth, lower(path) AS p, lower(string_split(path, '/')[-1]) AS b FROM (SELECT DISTINCT l_orderkey AS doc_id, ['', 'a/', 'a/b/', 'Docs/'][l_partkey % 4 + 1] || ['full.md', 'notes.md', 'translation-x.md', 'content_list.md', 'Full_text.md'][l_linenumber % 5 + 1] AS path FROM lineitem))
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (p = 'full.md')::INT * 1000 + (b = 'full.md')::INT * 900 + contains(b, 'full')::INT * 180 + contains(b, 'translation')::INT * 140 + contains(b, 'content')::INT * 80 - depth * 10 - length(path) / 100 DESC, depth, length(path), path) = 1""")


def preferred_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.repeat(F.lit("d/"), (F.col("o_orderkey") % 3).cast("int")), F.when(F.col("o_orderkey") % 2 == 0, "layout.json").otherwise(F.concat("o_orderstatus", F.lit("_layout.pdf"))))
    files = o.select(F.col("o_custkey").alias("doc_id"), path.alias("path")).distinct()
    return library.preferred_path(files, F.col("path").endswith("layout.json"))


_add(preferred_layout, """SELECT doc_id, path FROM (SELECT DISTINCT o_custkey AS doc_id, repeat('d/', (o_orderkey % 3)::INT) || CASE WHEN o_orderkey % 2 = 0 THEN 'layout.json' ELSE o_orderstatus || '_layout.pdf' END AS path FROM orders)
  WHERE path LIKE '%layout.json' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(string_split(path, '/')), length(path), path) = 1""")


def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored snapshots overlaid with what an update brings; missing fields keep their values."""
    old = _server(spark, sf_dir).select("doc_id", F.col("status").alias("s0"), F.col("updated_at").alias("u0"))
    new = _local(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("status")).alias("s1"), F.col("updated_at").alias("u1"))
    return old.join(new, "doc_id", "full_outer").select("doc_id", library.merged_snapshot(F.col("s0"), F.col("s1")).alias("status"), library.merged_snapshot(F.col("u0"), F.col("u1")).alias("updated_at"))


_add(snapshot_merge, f"SELECT coalesce(s.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN l.doc_id % 2 = 0 THEN l.status END, s.status) AS status, coalesce(l.updated_at, s.updated_at) AS updated_at FROM {_SERVER} s FULL JOIN {_LOCAL} l ON s.doc_id = l.doc_id")

# ---- conversations ----------------------------------------------------------------


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.when(F.col("conv_id") % 10 != 0, F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("session"), (F.col("conv_id") * 100 + F.col("turn")).alias("at"), "role", "text")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.sessions(_turns(spark, sf_dir))


_add(sessions, "SELECT CASE WHEN conv_id % 10 <> 0 THEN 's' || conv_id::VARCHAR ELSE 'legacy-session' END AS session, count(*) AS n, max(conv_id * 100 + turn) AS latest FROM conversations GROUP BY 1")


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.md5(F.min_by("text", "turn")).alias("first_prompt"), F.md5(F.max_by("text", "turn")).alias("last_response"), F.max("turn").alias("last_turn"))


_add(session_summary, "SELECT conv_id, md5(arg_min(text, turn)) AS first_prompt, md5(arg_max(text, turn)) AS last_response, max(turn) AS last_turn FROM conversations GROUP BY conv_id")


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six turns of each conversation, as an assistant's history has."""
    return annotations.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", digest(F.col("text")))


_add(last_turns, "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")


def assist_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = annotations.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    history = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"), F.max_by("text", "turn").alias("question"))
    action = F.element_at(F.array(*map(F.lit, ["qa", "explain", "summarize", "rewrite", "extract"])), (F.col("conv_id") % 5 + 1).cast("int"))
    prompt = annotations.assist_prompt(action, F.lit(""), F.lit("A document."), F.col("history"), F.col("question"), F.lit(None).cast("string"))
    return history.select("conv_id", digest(prompt), F.md5(X.prompt_label(action, F.col("question"))).alias("label"))


_act = ", ".join(lit(annotations.ACTIONS[a]) for a in ("qa", "explain", "summarize", "rewrite", "extract"))
_trim_q = f"regexp_replace(q, {lit(rf'^{P.S}+|{P.S}+$')}, '', 'g')"
_add(assist_prompts, f"""SELECT conv_id, md5([{_act}][conv_id % 5 + 1] || chr(10) || chr(10) || '## Document' || chr(10) || 'A document.' || CASE WHEN h <> '' THEN chr(10) || chr(10) || '## History' || chr(10) || h ELSE '' END || CASE WHEN {_trim_q} <> '' THEN chr(10) || chr(10) || '## Question' || chr(10) || q ELSE '' END) AS digest,
  md5(CASE conv_id % 5 WHEN 0 THEN CASE WHEN {_trim_q} <> '' THEN '问答: ' || {_trim_q} ELSE '问答' END WHEN 1 THEN '解释术语' WHEN 2 THEN '总结内容' WHEN 3 THEN '风格改写' ELSE '提取关键信息' END) AS label FROM (
  SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS h, arg_max(text, turn) AS q FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id)""")


def notes_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    notes = c.select("conv_id", F.col("turn").alias("ord"), F.lit("2024-01-01").alias("date"), F.substring("text", 1, 30).alias("selected"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(" ").alias("note"), annotations.split_tags(F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit(" , ,b"))).otherwise("")).alias("tags"))
    md = annotations.notes_markdown(notes, ["conv_id"])
    out = annotations.export_sections(F.element_at(F.array(*map(F.lit, ["translation", "notes", "bilingual", "all"])), (F.col("conv_id") % 4 + 1).cast("int")), F.lit("src"), F.lit(" "), F.col("markdown"))
    return md.select("conv_id", digest(out))


_note = f"regexp_replace(text, {lit(rf'^{P.S}+|{P.S}+$')}, '', 'g')"
_add(notes_md, f"""SELECT conv_id, md5(CASE conv_id % 4 WHEN 0 THEN '_No translation_' WHEN 1 THEN regexp_replace(md, {lit(rf'^{P.S}+|{P.S}+$')}, '', 'g') ELSE '# Source' || chr(10) || chr(10) || 'src' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Translation' || chr(10) || chr(10) || '_No translation_'
  || CASE WHEN conv_id % 4 = 3 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Notes' || chr(10) || chr(10) || regexp_replace(md, {lit(rf'^{P.S}+|{P.S}+$')}, '', 'g') ELSE '' END END) AS digest FROM (SELECT conv_id, string_agg('### 2024-01-01' || chr(10) || chr(10) || '> ' || substr(text, 1, 30) || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 AND {_note} <> '' THEN {_note} ELSE '_Empty note_' END
  || CASE WHEN turn % 3 = 0 THEN chr(10) || chr(10) || 'Tags: ' || role || ', b' ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id)""")

# ---- small tables -----------------------------------------------------------------


def models_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    remote = p.select(F.col("p_brand").alias("provider"), F.col("p_type").alias("model"))
    defaults = p.select(F.col("p_brand").alias("provider"), F.lit("default-model").alias("model"))
    return translation.model_catalog(remote, defaults)


_add(models_union, "SELECT p_brand AS provider, p_type AS model FROM part UNION SELECT p_brand, 'default-model' FROM part")


def scalar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, keys and addresses from suppliers and parts."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", (F.abs("s_acctbal") * 1000000).cast("long").alias("n"))
    kinds = F.element_at(F.array(*map(F.lit, [*P.BLOCK_LABELS, "other"])), (F.col("s_suppkey") % 8 + 1).cast("int"))
    block = F.concat_ws("-", F.lit("sec"), F.col("s_nationkey").cast("string"), kinds, (F.col("s_suppkey") % 4).cast("string"))
    lang = F.element_at(F.array(*map(F.lit, [*P.LANGUAGE_CODES, " klingon "])), (F.col("s_suppkey") % 10 + 1).cast("int"))
    url = F.concat(F.lit("https://h.example/"), F.element_at(F.array(*map(F.lit, ["", "translate", "v2/translate/", "api", "x/Translate"])), (F.col("s_suppkey") % 5 + 1).cast("int")))
    asset = F.element_at(F.array(*map(F.lit, ["./a\\b.png", "/abs.png", "http://x/y", " ", "//cdn/z", "c.png"])), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return s.select(
        "s_suppkey", X.block_label(block).alias("block"), X.language_code(lang).alias("lang"), X.translate_endpoint(url, F.col("s_suppkey") % 2 == 0).alias("endpoint"), X.asset_path(asset, F.lit("p/q/")).alias("asset"),
        X.document_key(F.col("s_name"), F.lit("zh"), F.when(F.col("s_suppkey") % 2 == 0, "translation").otherwise("source")).alias("doc_key"), X.format_bytes(F.when(F.col("s_suppkey") % 9 != 0, F.col("n"))).alias("size"),
    )


_kinds = ", ".join(map(lit, [*P.BLOCK_LABELS, "other"]))
_names = ", ".join(map(lit, [*P.BLOCK_LABELS.values(), "片段"]))
_codes = ", ".join(map(lit, [*P.LANGUAGE_CODES.values(), "KLINGON"]))
_add(scalar_labels, f"""SELECT s_suppkey, CASE WHEN s_suppkey % 8 = 0 THEN '标题' || (s_nationkey + 1)::VARCHAR ELSE [{_names}][s_suppkey % 8 + 1] || (s_nationkey + 1)::VARCHAR || '-' || (s_suppkey % 4 + 1)::VARCHAR END AS block, [{_codes}][s_suppkey % 10 + 1] AS lang,
  'https://h.example' || CASE WHEN s_suppkey % 2 = 0 THEN ['/v2/translate', '/v2/translate', '/v2/translate', '/api/v2/translate', '/x/v2/translate'][s_suppkey % 5 + 1] ELSE ['/translate', '/translate', '/translate', '/api/translate', '/x/Translate'][s_suppkey % 5 + 1] END AS endpoint,
  ['p/q/a/b.png', '/abs.png', 'http://x/y', '', '//cdn/z', 'p/q/c.png'][s_suppkey % 6 + 1] AS asset, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '::translation::zh' ELSE '::source' END AS doc_key,
  CASE WHEN s_suppkey % 9 = 0 THEN '不可用' ELSE printf(CASE WHEN v >= 100 THEN '%.0f' ELSE '%.1f' END, v) || ' ' || u END AS size FROM (SELECT *, CASE WHEN n < 1024 THEN 'B' WHEN n < 1048576 THEN 'KB' WHEN n < 1073741824 THEN 'MB' ELSE 'GB' END AS u,
   CASE WHEN n < 1024 THEN n::DOUBLE WHEN n < 1048576 THEN n / 1024.0::DOUBLE WHEN n < 1073741824 THEN n / 1048576.0::DOUBLE ELSE n / 1073741824.0::DOUBLE END AS v FROM (SELECT *, trunc(abs(s_acctbal) * 1000000)::BIGINT AS n FROM supplier))""")


def status_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = ["Chunking document...", "Refining: A", "Translating: B", "Parallel batch 1: 3 agents", "Loading from Cache", "Resuming from chunk 4", "Skipping reference section", "Completed", "", "other"]
    s = table(spark, sf_dir, "supplier")
    m = F.element_at(F.array(*map(F.lit, messages)), (F.col("s_suppkey") % 10 + 1).cast("int"))
    return s.select("s_suppkey", X.translation_phase(m).alias("phase"), X.localized_status(m, F.col("s_nationkey") % 3).alias("status"))


_add(status_phases, """SELECT s_suppkey, ['chunking', 'refining', 'streaming', 'streaming', 'finalizing', 'preparing', 'streaming', 'completed', 'preparing', 'preparing'][s_suppkey % 10 + 1] AS phase,
  CASE s_suppkey % 10 WHEN 0 THEN '正在拆分文档...' WHEN 1 THEN '正在整理上下文 · A' WHEN 2 THEN CASE WHEN s_nationkey % 3 > 1 THEN '并发 2 路翻译 · B' ELSE '正在翻译 · B' END WHEN 3 THEN '并发批次 1: 3 路 worker' WHEN 4 THEN '正在载入缓存译文...' WHEN 5 THEN '正在从分块继续恢复 4'
    WHEN 6 THEN '检测到参考文献区，跳过翻译' WHEN 7 THEN '翻译已完成' WHEN 8 THEN '准备中...' ELSE 'other' END AS status FROM supplier""")


def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    base = F.concat(F.format_string("24%02d.", F.col("p_size")), F.format_string("%05d", F.col("p_partkey")))
    text = F.concat(F.element_at(F.array(*map(F.lit, ["arXiv:", "https://arxiv.org/abs/", "https://arxiv.org/pdf/", "  "])), (F.col("p_partkey") % 4 + 1).cast("int")), base, F.when(F.col("p_partkey") % 3 == 0, "v2").otherwise(""), F.when(F.col("p_partkey") % 4 == 2, ".pdf").otherwise(""))
    ident, version = X.arxiv_id(text)
    return p.select("p_partkey", ident.alias("arxiv_id"), version.alias("version"), X.safe_file_name(F.concat("p_name", F.lit(': a/b? "c"')), ident).alias("file"))


_add(arxiv_ids, """SELECT p_partkey, printf('24%02d.', p_size) || printf('%05d', p_partkey) AS arxiv_id, CASE WHEN p_partkey % 3 = 0 THEN 'v2' END AS version, left(p_name || ' a b c', 80) || '.pdf' AS file FROM part""")


def enabled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a good label and without a toxic one: a semi and an anti join."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab.where("quality = 1"), "doc_id", "left_semi").join(lab.where("toxic = 1"), "doc_id", "left_anti").select("doc_id", "source", X.u16_length(F.col("text")).alias("units"))


_add(enabled_labels, "SELECT doc_id, source, length(text)::INT AS units FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"))
    return library.frames(li.agg(F.sum(F.floor("l_quantity")).alias("height")))


def visible_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.visible(frames(spark, sf_dir), 560, 20)


_FRAMES = """(SELECT *, top + height AS bottom FROM (SELECT *, coalesce(sum(height + 24) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM (
  SELECT l_orderkey AS doc_id, l_linenumber AS idx, sum(floor(l_quantity)::BIGINT) AS height FROM lineitem GROUP BY ALL)))"""
_add(frames, f"SELECT * FROM {_FRAMES}")
_add(visible_frames, f"SELECT * FROM {_FRAMES} WHERE bottom >= 80 AND top <= 1060")

# ---- events -----------------------------------------------------------------------


def _run_view(events: DataFrame) -> DataFrame:
    """User events as translation events of all types: the user is the run, the property the chunk; some pieces have no id."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("chunk_started", "chunk", "chunk_completed", "progress", "chunk"))), (n % 5 + 1).cast("int"))
    for step, put in reversed(((97, "run_started"), (101, "done"), (103, "error"), (79, "chunk_planned"), (83, "hydrate_blocks"), (89, "status"), (107, "closed"))):
        kind = F.when(n % step == 0, put).otherwise(kind)
    chunk = F.when((kind != "chunk") | (n % 11 != 0), F.concat(F.lit("chunk-"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string")))
    state = F.when(n % 7 == 0, "cached").when(n % 3 == 0, "completed")
    message = F.when(n % 2 == 0, "Chunking document...").otherwise("Refining: the rest")
    return events.select(F.col("user_id").alias("run"), n.alias("seq"), "ts", kind.alias("type"), chunk.alias("chunk"), n.cast("string").alias("text"), F.round("value", 3).alias("percentage"), state.alias("state"), message.alias("message"))


_RUNS = """(SELECT run, seq, ts, type, CASE WHEN type <> 'chunk' OR seq % 11 <> 0 THEN 'chunk-' || k::VARCHAR END AS chunk, seq::VARCHAR AS text, percentage, CASE WHEN seq % 7 = 0 THEN 'cached' WHEN seq % 3 = 0 THEN 'completed' END AS state FROM (
  SELECT user_id AS run, event_id AS seq, ts, CASE WHEN event_id % 97 = 0 THEN 'run_started' WHEN event_id % 101 = 0 THEN 'done' WHEN event_id % 103 = 0 THEN 'error' WHEN event_id % 79 = 0 THEN 'chunk_planned' WHEN event_id % 83 = 0 THEN 'hydrate_blocks' WHEN event_id % 89 = 0 THEN 'status'
    WHEN event_id % 107 = 0 THEN 'closed' ELSE ['chunk_started', 'chunk', 'chunk_completed', 'progress', 'chunk'][event_id % 5 + 1] END AS type, json_extract_string(props, '$.k')::INT % 7 AS k, round(value, 3) AS percentage FROM events))"""


def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.fold_runs(_run_view(table(spark, sf_dir, "events")))


#: The events of each run taken one after the other, in SQL: a step of the recursion is an event of every run.
_STEPS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM {_RUNS}),
  f(run, i, blocks, hyd, progress, phase) AS (SELECT run, 0::BIGINT, []::STRUCT(id VARCHAR, n BIGINT, state VARCHAR)[], true, 0.0::DOUBLE, 'idle' FROM (SELECT DISTINCT run FROM e)
   UNION ALL SELECT run, i, CASE WHEN type = 'run_started' THEN []
     WHEN type = 'chunk_planned' AND NOT known THEN list_append(blocks, {{'id': chunk, 'n': 0, 'state': 'planned'}})
     WHEN type = 'hydrate_blocks' AND NOT known AND hyd THEN list_append(blocks, {{'id': chunk, 'n': n, 'state': coalesce(said, 'cached')}})
     WHEN type = 'hydrate_blocks' THEN list_transform(blocks, lambda b: CASE WHEN b.id = chunk THEN {{'id': b.id, 'n': n, 'state': coalesce(said, 'cached')}} ELSE b END)
     WHEN type = 'chunk_started' THEN list_transform(blocks, lambda b: CASE WHEN b.id = chunk AND b.state <> 'cached' THEN {{'id': b.id, 'n': b.n, 'state': 'streaming'}} ELSE b END)
     WHEN type = 'chunk_completed' THEN list_transform(blocks, lambda b: CASE WHEN b.id = chunk THEN {{'id': b.id, 'n': b.n, 'state': CASE WHEN said = 'cached' THEN 'cached' ELSE 'completed' END}} ELSE b END)
     WHEN type = 'chunk' AND NOT known THEN list_append(blocks, {{'id': target, 'n': n, 'state': 'streaming'}})
     WHEN type = 'chunk' THEN list_transform(blocks, lambda b: CASE WHEN b.id = target THEN {{'id': b.id, 'n': b.n + n, 'state': CASE WHEN b.state = 'cached' THEN 'cached' ELSE 'streaming' END}} ELSE b END) ELSE blocks END,
    CASE WHEN type = 'run_started' THEN true WHEN type IN ('chunk', 'chunk_planned') AND NOT known THEN false ELSE hyd END,
    CASE WHEN type = 'done' THEN 100 WHEN type = 'progress' THEN coalesce(percentage, progress) ELSE progress END,
    CASE type WHEN 'run_started' THEN 'preparing' WHEN 'chunk_planned' THEN 'chunking' WHEN 'hydrate_blocks' THEN 'refining' WHEN 'status' THEN CASE WHEN seq % 2 = 0 THEN 'chunking' ELSE 'refining' END WHEN 'done' THEN 'completed' WHEN 'error' THEN 'error'
      WHEN 'closed' THEN CASE WHEN phase IN ('completed', 'error') THEN phase ELSE 'error' END WHEN 'progress' THEN phase ELSE 'streaming' END
    FROM (SELECT *, len(list_filter(blocks, lambda b: b.id = target)) > 0 AS known FROM (SELECT e.run, e.i, e.seq, e.type, e.chunk, length(e.text) AS n, e.state AS said, e.percentage, f.blocks, f.hyd, f.progress, f.phase,
      CASE WHEN e.chunk IS NULL THEN coalesce(f.blocks[-1].id, 'streaming-translation') ELSE e.chunk END AS target FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1)))"""
_FOLD = f"""{_STEPS} SELECT run, i AS n_events, len(blocks) AS n_blocks, len(list_filter(blocks, lambda b: b.state IN ('completed', 'cached'))) AS n_completed, coalesce(list_sum(list_transform(blocks, lambda b: b.n)), 0)::BIGINT AS n_chars, progress, phase
  FROM f WHERE i = (SELECT max(i) FROM e WHERE e.run = f.run)"""
_add(event_fold, _FOLD)


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each run in order, with their state and text."""
    blocks = runs.fold_blocks(_run_view(table(spark, sf_dir, "events")))
    place = F.row_number().over(Window.partitionBy("run").orderBy("born"))
    return blocks.select("run", place.alias("place"), "chunk", "state", F.length("text").cast("long").alias("n_chars"))


_add(event_blocks, f"{_STEPS} SELECT run, unnest(range(1, len(blocks) + 1)) AS place, unnest(blocks).id AS chunk, unnest(blocks).state AS state, unnest(blocks).n AS n_chars FROM f WHERE i = (SELECT max(i) FROM e WHERE e.run = f.run)")


def _streamed(spark: SparkSession, sf_dir: str, name: str, **how) -> DataFrame:
    """The updates that a stream over the events' file writes."""
    root = shared_folder(spark, name)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    updates = runs.fold_stream(_run_view(stream), **how)
    E.write_updates(updates, f"{root}/updates", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{root}/updates")


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states out of a stream that keeps each chunk of a run in an entry of its own."""
    return runs.latest_runs(_streamed(spark, sf_dir, "stream-fold", stall=None, give_up=None))


_add(stream_fold, _FOLD)


def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that fall silent for an hour, are given up after a day or break off, by two timers on the events' own time."""
    return runs.notices(_streamed(spark, sf_dir, "stream-silences", stall=3600, give_up=86400, event_time=True))


_add(stream_silences, f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY run ORDER BY seq) AS i, coalesce(lead(epoch_us(ts) // 1000) OVER (PARTITION BY run ORDER BY seq), max(epoch_us(ts) // 1000) OVER ()) AS next_ms, lead(type) OVER (PARTITION BY run ORDER BY seq) AS coming FROM {_RUNS}),
  f(run, i, phase) AS (SELECT run, 0::BIGINT, 'idle' FROM (SELECT DISTINCT run FROM e) UNION ALL SELECT e.run, e.i, CASE WHEN p = 'given up' THEN p WHEN e.next_ms - e.ms >= 86400000 AND p NOT IN ('completed', 'error') THEN 'given up' ELSE p END
    FROM (SELECT e.*, CASE WHEN f.phase = 'given up' AND type <> 'run_started' THEN 'given up' ELSE CASE type WHEN 'done' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'closed' THEN CASE WHEN f.phase IN ('completed', 'error') THEN f.phase ELSE 'error' END WHEN 'progress' THEN f.phase ELSE 'going' END END AS p FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1) e),
  g AS (SELECT e.*, f.phase, coalesce(lag(f.phase) OVER (PARTITION BY e.run ORDER BY e.i), 'idle') AS before FROM f JOIN e USING (run, i)),
  h AS (SELECT *, before = 'given up' AND type <> 'run_started' AS deaf FROM g)
 SELECT run, 'slow' AS notice, ms + 3600000 AS at FROM h WHERE NOT deaf AND phase NOT IN ('completed', 'error') AND next_ms - ms >= 3600000
 UNION ALL SELECT run, 'given up', ms + 86400000 FROM h WHERE NOT deaf AND phase = 'given up'
 UNION ALL SELECT run, 'broken off', ms FROM h WHERE NOT deaf AND type = 'closed' AND before NOT IN ('completed', 'error')""")


def stall_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stalls(_run_view(table(spark, sf_dir, "events")), 600).select("run", "seq", F.round(F.col("gap") * 1e6).cast("long").alias("gap_us"))


_add(stall_gaps, f"SELECT * FROM (SELECT run, seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run ORDER BY ts, seq) AS gap_us FROM {_RUNS}) WHERE gap_us > 600000000")


def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_fold(spark, sf_dir)
    return rows.select("run", library.percentage(F.col("n_completed"), F.col("n_blocks")).alias("percentage"))


_add(progress_pct, f"SELECT run, floor(n_completed / nullif(n_blocks, 0) * 100)::INT AS percentage FROM ({_FOLD})")


def win_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


def win_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding(table(spark, sf_dir, "events"), "2 hours", "1 hour", ["event_type"])


def win_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.session_windows(table(spark, sf_dir, "events"), "30 minutes", ["user_id"])


_add(win_tumbling, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
_add(win_sliding, "SELECT start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) GROUP BY ALL")
_add(win_session, """SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")

# ---- translation ------------------------------------------------------------------


def translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of papers through the stub: references stay, the rest is translated, then put together."""
    rows = sections.sections(paper_view(spark, sf_dir))
    text = F.when(F.col("is_reference"), F.col("content")).otherwise(translation.translated_expression(F.col("content"), F.lit("French")))
    done = rows.select("doc_id", F.col("section").alias("chunk_idx"), text.alias("text"))
    return translation.target_markdown(done).select("doc_id", digest(F.col("text")))


from .document_queries import _REF, _SECTIONS  # noqa: E402

_add(translate_stub, f"SELECT doc_id, md5(string_agg(o, chr(10) || chr(10) ORDER BY section)) AS digest FROM (SELECT doc_id, section, CASE WHEN {_REF} THEN content ELSE translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS o FROM {_SECTIONS}) WHERE regexp_replace(o, {lit(rf'^{P.S}+|{P.S}+$')}, '', 'g') <> '' GROUP BY doc_id")


def translate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan with masking, terms and context, the stub as the service."""
    out = translation.translate(paper_view(spark, sf_dir), translation.Stub(), "French", [("the", "THE-TERM", None)])
    return out.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


_add(translate_chunks)
