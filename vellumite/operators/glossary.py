"""Terms: reading, matching, precedence and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

RUN = r"[\p{L}\p{N}_]+"


#: Rows and characters up to which a table of terms is sent whole to every executor; larger ones are joined by shuffles.
SMALL_ROWS, SMALL_CHARS = 1 << 16, 1 << 22


def _small(terms: DataFrame) -> DataFrame:
    """The same terms, sent to the texts where they are few, so that the words of texts stay where they are."""
    size = terms.agg(F.count("*").alias("rows"), F.sum(F.length("source") + F.length("target")).alias("chars")).head()
    return F.broadcast(terms) if size.rows <= SMALL_ROWS and (size.chars or 0) <= SMALL_CHARS else terms


def boundary_pattern(source: Column) -> Column:
    """A pattern for a term that no word character touches where the term itself begins or ends with one."""
    t = X.js_trim(source)
    before = F.when(t.rlike(r"^[\p{L}\p{N}_]"), F.lit(r"(?<![\p{L}\p{N}_])")).otherwise("")
    after = F.when(t.rlike(r"[\p{L}\p{N}_]$"), F.lit(r"(?![\p{L}\p{N}_])")).otherwise("")
    return F.concat(F.lit("(?iu)"), before, X.escape_pattern(t), after)


def _folded(text: Column) -> Column:
    return F.lower(F.upper(text))


def match_terms(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, source, target)`` for each term that occurs in a text at word boundaries, in any case.

    A match contains every word of the term as a whole word, so the distinct words of texts and terms are
    joined by equality on the word of the term that the fewest terms share, its rarest. A term that is one word of
    ASCII letters needs no more. The others of a text are gathered, meet it in one join and are tested by
    containment, then by the pattern. Words with other letters are folded twice, for their cases differ
    in more ways; terms without a word go by their first character. No text meets all terms. Ids of texts
    must be unique.
    """
    terms = terms.where(X.js_trim(F.col("source")) != "").select("source", "target").distinct()
    terms = terms.withColumn("wide", ~F.col("source").rlike(r"^[\x00-\x7F]*$")).withColumn("term", X.js_trim(F.col("source")))
    runs = F.regexp_extract_all(F.when(F.col("wide"), _folded("term")).otherwise(F.lower("term")), F.lit(f"({RUN})"), 1)
    worded = terms.withColumn("words", F.array_distinct(runs))
    shared = worded.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = worded.where(F.size("words") > 0).select("source", "target", "term", "wide", F.explode("words").alias("word")).join(shared, "word")
    rarest = ranked.groupBy("source", "target", "term", "wide").agg(F.min(F.struct("n", -F.length("word"), "word")).alias("k"))
    # marks keep folded words and characters apart from plain words
    own, folded = F.col("k.word"), F.concat(F.lit("~"), _folded(F.col("k.word")))
    ascii_ = r"^[\x00-\x7F]*$"
    key = F.when(own.rlike(ascii_), F.array(own)).otherwise(F.array(folded, F.when(_folded(own).rlike(ascii_), _folded(own)).otherwise(folded)))
    keyed = rarest.select("source", "target", F.explode(F.array_distinct(key)).alias("key"), (~F.col("wide") & (F.lower("term") == own)).alias("sure"))
    signs = worded.where(F.size("words") == 0).select("source", "target", F.concat(F.lit("="), F.lower(F.substring("term", 1, 1))).alias("key"), F.lit(False).alias("sure"))
    term = F.struct("source", "target", F.lower(X.js_trim(F.col("source"))).alias("low"), boundary_pattern(F.col("source")).alias("pattern"))
    keyed = _small(keyed.unionByName(signs)).select("key", "sure", term.alias("term"))
    low = F.lower(text_col)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(f"({RUN})"), 1))
    wide = F.transform(F.filter("words", lambda w: F.octet_length(w) != F.length(w)), lambda w: F.concat(F.lit("~"), _folded(w)))
    marks = F.transform(F.array_distinct(F.split(F.regexp_replace(low, r"[\p{L}\p{N}_\s]", ""), "")), lambda c: F.concat(F.lit("="), c))
    kinds = {r.kind for r in keyed.select(F.substring("key", 1, 1).alias("kind")).where("kind in ('~', '=')").distinct().collect()}  # two rows at most
    held = [F.col("words"), *([wide] if "~" in kinds else []), *([marks] if "=" in kinds else [])]
    rows = X.staged(texts, [id_col, text_col] if "=" in kinds else [id_col], words=words)
    found = rows.select(id_col, F.explode(F.concat(*held) if len(held) > 1 else held[0]).alias("key")).join(keyed, "key")
    of_text = found.groupBy(id_col).agg(F.collect_set(F.when(F.col("sure"), F.col("term"))).alias("sure"), F.collect_set(F.when(~F.col("sure"), F.col("term"))).alias("open"))
    met = X.staged(of_text.join(texts.select(id_col, text_col), id_col), [id_col, text_col, "sure", "open"], low=F.when(F.size("open") > 0, F.lower(text_col)))  # lower case once a text
    tested = F.filter(F.filter("open", lambda t: F.col("low").contains(t["low"])), lambda t: F.regexp_like(F.col(text_col), t["pattern"]))
    return met.select(id_col, F.explode(F.array_union("sure", tested)).alias("t")).select(id_col, "t.source", "t.target")


def contained_terms(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, source, target)`` for each term that a text contains anywhere, in any case and also within words.

    Texts and terms are joined on three characters in a row, of each term those that the fewest terms have;
    shorter terms go by their first character. Containment decides among those pairs.
    """
    terms = terms.where("source <> ''").select("source", "target").distinct().withColumn("term", F.lower("source"))
    grams = lambda c: F.regexp_extract_all(c, F.lit("(?s)(?=(.{3}))"), 1)
    parts = F.when(F.length("term") >= 3, grams(F.col("term"))).otherwise(F.array(F.concat(F.lit("="), F.substring("term", 1, 1))))
    spread = terms.select("source", "target", "term", F.explode(F.array_distinct(parts)).alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n"))
    keyed = spread.join(shared, "key").groupBy("source", "target", "term").agg(F.min(F.struct("n", "key")).alias("k")).select("source", "target", F.col("k.key").alias("key"))
    keyed = _small(keyed)
    low = F.lower(text_col)
    short = F.transform(F.array_distinct(F.split(low, "")), lambda c: F.concat(F.lit("="), c))
    held = F.when(F.length(low) >= 3, F.concat(F.array_distinct(grams(low)), short)).otherwise(short)
    pairs = texts.select(id_col, F.explode(held).alias("key")).join(keyed, "key").groupBy(id_col).agg(F.collect_set(F.struct("source", "target")).alias("open"))
    met = X.staged(pairs.join(texts.select(id_col, text_col), id_col), [id_col, "open"], low=F.lower(text_col))
    tested = met.select(id_col, F.explode(F.filter("open", lambda t: F.col("low").contains(F.lower(t["source"])))).alias("t"))
    return tested.select(id_col, "t.source", "t.target")


def chunk_terms(chunks: DataFrame, stored: DataFrame, given: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_idx"), text_col: str = "content") -> DataFrame:
    """``(keys, terms)`` of each chunk that has any: ``array<struct<source, target, category>>`` in the order of precedence.

    Given terms count wherever a chunk contains them and come first, stored ones at word boundaries; of a (source, target)
    in any case the first stays. Both tables are ``(place, source, target, category)``, in the order of ``place``. What is
    gathered are the terms of one chunk.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = chunks.select(F.struct(*keys).alias("_id"), F.col(text_col).alias("_text")).repartition(n, "_id")  # sent once: what follows is by chunk
    found = None
    for rank, (terms, match) in enumerate(((given, contained_terms), (stored, match_terms))):
        once = terms.groupBy("source", "target").agg(F.min("place").alias("place"), F.min_by("category", "place").alias("category"))
        met = match(texts, once, "_id", "_text").join(_small(once), ["source", "target"])
        met = met.select("_id", F.struct(F.lit(rank).alias("rank"), F.col("place").cast("string").alias("place"), "source", "target", "category").alias("t"))
        found = met if found is None else found.unionByName(met)
    firsts = found.groupBy("_id", F.lower("t.source").alias("_s"), F.lower("t.target").alias("_t")).agg(F.min("t").alias("t"))
    term = lambda t: F.struct(t["source"].alias("source"), t["target"].alias("target"), t["category"].alias("category"))
    held = firsts.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list("t")), term).alias("terms"))
    return held.select("_id.*", "terms")


def first_wins(terms: DataFrame, order: list[Column]) -> DataFrame:
    """One row of each (source, target) in any case, the first by ``order``."""
    key = F.concat_ws("::", F.lower("source"), F.lower("target"))
    ranked = terms.withColumn("_key", key).withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    return ranked.where("_rank = 1").drop("_key", "_rank")


def last_wins(terms: DataFrame, order: str) -> DataFrame:
    """Of each (source in any case, target) the last row, at the place of the first."""
    rest = [c for c in terms.columns if c != order]
    grouped = terms.groupBy(F.lower("source").alias("_s"), F.col("target").alias("_t")).agg(F.max_by(F.struct(*rest), order).alias("v"), F.min(order).alias(order))
    return grouped.select(order, "v.*")


def upsert(stored: DataFrame, given: DataFrame, key: str, updated: str) -> DataFrame:
    """The latest row of each key; of equal times the given one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(given.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    ranked = both.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(updated), F.desc("_new"))))
    return ranked.where("_rank = 1").drop("_new", "_rank")


def search(terms: DataFrame, keyword: str) -> DataFrame:
    """Terms whose source, target or category has the keyword in any case; a blank one keeps all."""
    word = keyword.strip().lower()
    text = F.lower(F.concat_ws(" ", "source", "target", F.coalesce("category", F.lit(""))))
    return terms.where(text.contains(word)) if word else terms


def csv_lines(terms: DataFrame) -> DataFrame:
    """``(line)``: a row of CSV for each term, texts quoted."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return terms.select(F.concat_ws(",", *(quote(F.col(c)) for c in ("source", "target", "category")), F.col("enabled").cast("string")).alias("line"))


def term_table(terms: DataFrame, keys: list[str]) -> DataFrame:
    """A Markdown table of the terms of each key, for a prompt."""
    held = F.array_sort(F.collect_set(F.struct("source", "target")))
    rows = F.transform(held, lambda t: F.concat(F.lit("| "), t["source"], F.lit(" | "), t["target"], F.lit(" |")))
    return terms.groupBy(*keys).agg(F.concat(F.lit("| Source | Target |\n| --- | --- |\n"), F.array_join(rows, "\n")).alias("term_table"))
