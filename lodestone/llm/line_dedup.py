"""Cross-site line dedup: a HyperLogLog sketch of the sites of every line.

1. One pass over the texts leaves (document, site, line hashes), a few bytes a
   line, in the checkpoint folder; every count runs over that table.
2. Sketches per line hash merge by aggregation.  A line whose estimate is clear of
   the threshold is decided by it; lines within the sketch's error of the threshold
   get an exact count of distinct sites.
3. A boilerplate line stays where it occurs first (smallest doc_id, then position)
   and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed, fresh

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 3
#: log2 of the registers of a sketch: standard error 1.04 / sqrt(2**LG_K).
LG_K = 9
#: A removal list of up to so many bytes is broadcast; a longer one is joined by shuffle.
BROADCAST_BYTES = 32_000_000


def band(min_sites: int, lg_k: int = LG_K) -> tuple[float, float]:
    """Estimates from which to which the count is made exactly: four standard errors, half a site at least."""
    d = max(0.5, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    return min_sites - d, min_sites + d


def line_hashes(text: Column) -> Column:
    """Two 64-bit hashes of each line, lower-cased and trimmed; null for a blank line."""
    lines = F.split(F.lower(text), "\n", -1)
    return F.transform(lines, lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(F.trim(x)).alias("a"), F.hash(F.trim(x)).alias("b"))))


def _hashed(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"), F.xxhash64(text).alias("t"), line_hashes(F.col(text)).alias("h")).filter("h is not null")


def _lines(hashed: DataFrame) -> DataFrame:
    flat = hashed.select("doc_id", "site", "t", F.posexplode("h").alias("pos", "h"))
    return flat.filter("h is not null").select("doc_id", "site", "t", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(a, b, keep): the hash of each line on at least ``min_sites`` sites and where it stays."""
    low, high = band(min_sites, lg_k)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "pos")).alias("keep")
    # a line that occurs less often than min_sites can't be on so many sites: no sketch for it
    often = lines.groupBy("a", "b").agg(F.count("*").alias("n"), first, F.hll_sketch_agg("site", lg_k).alias("sketch")).filter(F.col("n") >= min_sites)
    often = checkpointed(often.select("a", "b", "keep", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= low))
    sure = often.filter(F.col("sites") > high)
    near = often.filter(F.col("sites") <= high)
    exact = lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("k")).filter(F.col("k") >= min_sites)
    return sure.select("a", "b", "keep").unionByName(near.join(exact.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "keep"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(doc_id, t, gone): the positions of lines to remove from the rows with this doc_id and xxhash64 of the text."""
    lines = _lines(checkpointed(_hashed(docs, doc_id, text, site)))
    found = boilerplate(lines, min_sites, lg_k)
    at = lines.join(found, ["a", "b"]).filter(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("pos") == F.col("keep.pos"))))
    return at.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone"))


def strip_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, doc_id: str = "doc_id", text: str = "text", site: str = "source", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Columns n_lines, n_removed and the text that stays, beside doc_id, for every row.

    Lines are split at line feeds and compared lower-cased and trimmed of blanks;
    blank lines are never boilerplate.  A null text stays null with no lines; a null
    doc_id comes after all others when the line to keep is chosen; a null site is no
    site; repeated rows are treated alike, so that a line which stays in one stays
    in its repeats; of a line that occurs first in several rows with one doc_id the
    least place stays; an empty table gives an empty one; very long texts are taken
    whole.  Other columns are ignored.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(site).alias("source"))
    joined, gone, stays = _with_removals(given, min_sites, lg_k, "doc_id", "text", "source", broadcast_bytes)
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        stays.alias("text"),
    )


def _with_removals(docs: DataFrame, min_sites: int, lg_k: int, doc_id: str, text: str, site: str, broadcast_bytes: int) -> tuple[DataFrame, Column, Column]:
    """``docs`` joined with its removals, the positions to remove from each row, and the text that stays."""
    names = fresh(docs.columns, "gone_id", "gone_t", "gone")
    right = checkpointed(removals(docs, min_sites, lg_k, doc_id, text, site).toDF(*names))
    rows, places = right.agg(F.count("*"), F.coalesce(F.sum(F.size(names[2])), F.lit(0))).first()
    small = 64 * rows + 4 * places <= broadcast_bytes
    same = (F.xxhash64(docs[text]) == right[names[1]]) & docs[doc_id].eqNullSafe(right[names[0]])
    joined = docs.join(F.broadcast(right) if small else right, same, "left")
    gone = right[names[2]]
    stays = F.array_join(F.filter(F.split(docs[text], "\n", -1), lambda x, k: ~F.array_contains(gone, k)), "\n")
    return joined, gone, F.when(gone.isNull(), docs[text]).otherwise(stays)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, doc_id: str = "doc_id", text: str = "text", site: str = "source", n_chars: str = "n_chars", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs``, all columns kept, with the text that ``strip_lines`` leaves, and the number
    of characters brought up to date where there is such a column.

    A row that had nothing but boilerplate which stays elsewhere is left out; rows
    that lose no line, empty and null texts among them, are unchanged.  Null ids and
    sites, repeated rows, ties, empty tables and very long texts are as in ``strip_lines``;
    names of the table's own columns may be any.
    """
    joined, gone, stays = _with_removals(docs, min_sites, lg_k, doc_id, text, site, broadcast_bytes)
    kept = joined.filter(gone.isNull() | (F.trim(F.translate(stays, "\n\r\t", "   ")) != ""))
    count = {n_chars: F.when(gone.isNull(), docs[n_chars]).otherwise(F.length(stays).cast(docs.schema[n_chars].dataType))} if n_chars in docs.columns else {}
    return kept.select(*[stays.alias(c) if c == text else count.get(c, docs[c]).alias(c) for c in docs.columns])


def sql(min_sites: int = MIN_SITES) -> str:
    """The same in DuckDB SQL over ``documents`` with distinct doc_ids."""
    return f"""
    with l as (select doc_id, source, unnest(range(0, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from documents where text is not null),
    n as (select doc_id, source, pos, line, trim(lower(line)) as k from l),
    g as (select k, min((doc_id, pos)) as keep from n where k <> '' group by k having count(distinct source) >= {min_sites}),
    m as (select n.*, g.k is not null and (n.doc_id, n.pos) <> g.keep as gone from n left join g on n.k = g.k),
    d as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from m group by doc_id)
    select documents.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, d.text
    from documents left join d on documents.doc_id = d.doc_id"""
