"""Secrets in texts, judged by who holds them across the corpus. DataFrame functions only.

A text is scanned once for each pattern: the matches of a pattern and the pieces between them
give all places by a running sum of lengths, so a text with very many matches costs no more for
each. A value leaves the scan as its SHA-256, its length and what its characters look like,
never in clear.

Hashes are counted over the whole corpus, first by value, owner and repository, then by value
and owner, then by value, each time combined before the shuffle, so an example that a third of all
texts copy is no hot key. A value of ``WIDE`` owners or more is a copied example; a value of
fewer that looks live is a credential of its owner's. Long bare strings, which no pattern of
the base takes, are spans only by that verdict: owner-specific, and either random-looking or
known as a value of the base elsewhere.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, only

#: Owners from which on a value is a widely copied example.
WIDE = 3
#: The patterns of the base, in their order, with the least length of what they must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_.=-]{20,}+"
KINDS = ("assign", "access", "hex", "owned")
ASSIGNED = 6
#: Words of values that stand for a secret without being one.
EXAMPLES = "(?i)example|sample|dummy|placeholder|changeme|your|test|xxxx"
#: Characters of a live-looking value at most; different ones at least.
LONGEST, DIFFERENT = 512, 6
#: Of a bare string: digits, small and capital letters at least, and changes between them by the hundred characters.
EACH, CHANGES = 2, 35
_CHANGE = "[0-9](?![0-9])|[a-z](?![a-z])|[A-Z](?![A-Z])"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _live(value: Column) -> Column:
    """Whether a value may be a credential rather than a word for one."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return F.when(F.length(value) <= LONGEST, (different >= DIFFERENT) & ~value.rlike(EXAMPLES)).otherwise(False)


def _random(value: Column) -> Column:
    """Whether a bare string is as mixed as random ones are."""
    mixed = F.lit(True)
    for letters in ("[0-9]", "[a-z]", "[A-Z]"):
        mixed = mixed & (F.regexp_count(value, F.lit(letters)) >= EACH)
    return F.when(F.length(value) <= LONGEST, mixed & (100 * (F.regexp_count(value, F.lit(_CHANGE)) - 1) >= CHANGES * F.length(value))).otherwise(False)


def _matches(text: Column, kind: int, pattern: str, guard: Column, value, wanted, live) -> Column:
    """``(kind, k, gap, size, own, value, live)`` of each match: the characters before and in it; ``value`` is null if it fails."""

    def one(m: Column) -> Column:
        v = value(m)
        digest = F.when(wanted(v), F.unhex(F.sha2(v, 256)))
        return F.struct(F.length(m).alias("size"), F.length(v).alias("own"), digest.alias("value"), F.when(digest.isNotNull(), live(v)).alias("live"))

    pairs = F.zip_with(F.transform(F.split(text, pattern), F.length), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    rows = F.transform(pairs, lambda p, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), p["gap"].alias("gap"), p["m"]["size"].alias("size"), p["m"]["own"].alias("own"), p["m"]["value"].alias("value"), p["m"]["live"].alias("live")))
    rows = F.filter(rows, lambda r: r["size"].isNotNull())  # behind the last match there is a gap alone
    return F.when(guard, rows).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,own:int,value:binary,live:boolean>>"))


def _scan(text: Column) -> Column:
    """All matches of all patterns of a text."""
    same = lambda m: m
    always = lambda v: F.lit(True)
    bare = lambda v: (F.length(v) >= 20) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.concat(
        _matches(text, 0, ASSIGN, text.rlike(ASSIGN), lambda m: F.regexp_extract(m, ASSIGN, 2), lambda v: F.length(v) >= ASSIGNED, _live),
        _matches(text, 1, ACCESS, text.contains("AKIA"), same, always, _live),
        _matches(text, 2, HEX, text.rlike("[0-9a-f]{24}"), same, always, _live),
        _matches(text, 3, BARE, text.rlike("[A-Za-z0-9+/_.=-]{20}"), lambda m: F.rtrim(m, F.lit(".")), bare, lambda v: _live(v) & _random(v)),
    )


def _placed(found: DataFrame) -> DataFrame:
    """``(row, repo, owner, kind, start, end, value, live)``: the matches that hold; bare ones only apart from the base."""
    rows = found.select("row", "repo", "owner", F.inline("found")).repartition("row")
    until = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("k"))
    rows = rows.withColumn("start", until - F.col("size")).withColumn("end", F.col("start") + F.when(F.col("kind") == 3, F.col("own")).otherwise(F.col("size"))).where("value is not null")
    base, before = F.col("kind") < 3, (Window.unboundedPreceding, -1)
    reached = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", "kind").rowsBetween(*before))
    coming = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(*before))
    rows = rows.withColumn("reached", F.coalesce(reached, F.lit(-1))).withColumn("coming", coming)
    free = (F.col("reached") <= F.col("start")) & (F.col("coming").isNull() | (F.col("coming") >= F.col("end")))
    return rows.where(base | free).select("row", "repo", "owner", "kind", "start", "end", "value", "live")


def ownership(found: DataFrame) -> DataFrame:
    """``(value, n_repos, n_owners, known)`` of each hash of ``(value, repo, owner, kind)``: over how many different ones it is spread."""
    each = found.groupBy("value", "owner", "repo").agg(F.max(F.col("kind") < 3).alias("known"))
    owners = each.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.max("known").alias("known"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.max("known").alias("known"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", wide: int = WIDE) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied)``: a row for each row.

    Base spans are the leftmost non-overlapping matches of each pattern, places in code points, ends
    exclusive: an assignment of 6 characters or more to a name like ``token``, an access key id of 20 or
    more, small hexadecimal digits of 24 or more. ``base_sha256`` is the SHA-256 of ``kind:start:end``
    by start, then kind, joined by commas; ``spans`` lists them so with the added spans of kind
    ``owned``: strings of 20 characters or more of ``[A-Za-z0-9+/_.=-]`` (dots at the end aside) that no base
    span touches, held by fewer than ``wide`` owners, and that look random (at most 512 characters, digits, small
    and capital letters at least twice, 35 changes between them by the hundred) or are the value of a base span
    somewhere. ``n_owned`` counts the spans of live-looking values of fewer than ``wide`` owners,
    ``n_copied`` those of values that more have.

    Repositories and owners are values of any columns; a null counts as one of them. A null text is
    empty. Repeated rows are rows of their own and count once for their owner. An empty table gives none.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    src = only(docs, id=id_col, text=text_col, repo=repo_col, owner=owner_col)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scanned = ws.table(src.select("id", F.col("repo").cast("string").alias("repo"), F.col("owner").cast("string").alias("owner"), _scan(text).alias("found")).withColumn("row", F.monotonically_increasing_id()), "scanned")
    some = scanned.where(F.size("found") > 0)
    placed = ws.table(_placed(some), "placed")
    owners = ws.table(ownership(placed), "owners")

    base, own = F.col("kind") < 3, F.col("n_owners") < wide
    judged = placed.join(owners.select("value", "n_owners", "known"), "value").where(base | own & (F.col("live") | F.col("known")))
    span = F.struct("start", "kind", "end")
    name = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)]
    of_row = judged.groupBy("row").agg(*counts, F.array_sort(F.collect_list(span)).alias("all"), F.count_if(own & F.col("live")).alias("owned"), F.count_if(~own).alias("n_copied"))
    of_row = of_row.select("row", *(f"n_{k}" for k in KINDS[:3]), F.sha2(listed(F.filter("all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed("all").alias("spans"), F.col("owned").alias("n_owned"), "n_copied")
    numbers, strings = ["n_assign", "n_access", "n_hex", "n_owned", "n_copied"], {"base_sha256": _NOTHING, "spans": ""}
    with_some = some.select("row", "id").join(of_row, "row", "left").select("id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in strings.items()))
    without = scanned.where(F.size("found") == 0).select("id", *(F.lit(0).cast("long").alias(c) for c in numbers), *(F.lit(v).alias(c) for c, v in strings.items()))
    out = without.unionByName(with_some)
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_copied")
