"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A window is a run of a document's non-blank lines with `min_words` words or more, and no shorter than that needs: the
shortest that begins at a given line, or the shortest that ends there. Of each window the line of least hash is its
fingerprint (ties: the last), so every repeated passage of `min_words` words or more shares at least one fingerprint, at
the same place in it, with each of its copies. Fingerprints that lie at one position only are dropped. From the others a
match is extended both ways: the lines around the two positions are compared as the windows that reach forward and back
over the fingerprint. A window whose content began earlier, in the order (id, line), is a later copy, and the lines that
it covers are deleted. Each line of a repeated run lies in a window that begins in the run or in one that ends in it, so
the windows together delete the whole run, short last lines included; the first occurrence of a passage stays. Where
copies overlap in one document, the lines of the later one go.

Runs of fewer words stay, however often they occur. Blank lines (no word) are never compared, and go only within a
deleted window. Null texts stay null, and empty texts empty; a text all of whose lines go becomes empty. Rows that agree
in id and text are one document and get the same result. A null id comes first. An empty table stays empty. Other columns
pass through, whatever their names; n_lines and n_removed replace columns of these names. Counts per hash are summed
before they are shuffled, so a line that most documents share doesn't gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

MIN_WORDS = 50
_KEY = ("id", "text_hash")


def lines(df: DataFrame) -> DataFrame:
    """(id, text_hash, line, hash, words) of non-blank lines of (id, text); `start` and `end` count the words before and up
    to the line."""
    each = df.where(F.col("text").isNotNull()).select(
        "id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "content"),
    ).select(*_KEY, "line", F.xxhash64("content").alias("hash"), F.regexp_count("content", F.lit(WORD)).alias("words"))
    kept = each.where("words > 0").repartition(*_KEY).dropDuplicates([*_KEY, "line"])
    up_to = W.partitionBy(*_KEY).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return kept.withColumn("end", F.sum("words").over(up_to)).withColumn("start", F.col("end") - F.col("words"))


def windows(all_lines: DataFrame, min_words: int) -> DataFrame:
    """(id, text_hash, line, last, print, print_line, content, content2): each full window once, by its first and last line."""
    own = W.partitionBy(*_KEY)
    ahead, back = own.orderBy("start").rangeBetween(0, min_words - 1), own.orderBy("end").rangeBetween(1 - min_words, 0)

    def over(frame) -> Column:
        return F.struct(
            F.sum("words").over(frame).alias("words"), F.min("line").over(frame).alias("line"), F.max("line").over(frame).alias("last"),
            F.min(F.struct("hash", (-F.col("line")).alias("back"))).over(frame).alias("least"), F.collect_list("hash").over(frame).alias("hashes"),
        )

    both = all_lines.select(*_KEY, over(ahead).alias("ahead"), over(back).alias("back"))
    # The window ahead of a line often is the one back of it, too.
    found = both.select(*_KEY, F.explode(F.when(F.col("ahead.line").eqNullSafe(F.col("back.line")) & (F.col("ahead.last") == F.col("back.last")), F.array("ahead")).otherwise(F.array("ahead", "back"))).alias("w")).where(F.col("w.words") >= min_words)
    return found.select(*_KEY, "w.line", "w.last", F.col("w.least.hash").alias("print"), (-F.col("w.least.back")).alias("print_line"), F.xxhash64("w.hashes").alias("content"), F.hash("w.hashes").alias("content2")).dropDuplicates([*_KEY, "line", "last"])


def _first(*at: str) -> Column:
    return F.min(F.struct(*_KEY, *at))


def repeated(found: DataFrame) -> DataFrame:
    """The windows that are later copies."""
    prints = found.groupBy("print").agg(_first("print_line").alias("a"), F.max(F.struct(*_KEY, "print_line")).alias("b")).where("a != b").select("print")
    joined = found.join(prints, "print")
    firsts = joined.groupBy("content", "content2").agg(_first("line").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return joined.join(firsts, ["content", "content2"]).where(F.struct(*_KEY, "line") > F.col("first")).select(*_KEY, "line", "last")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with later repeated runs deleted from the text; adds n_lines and n_removed (non-blank and blank lines alike)."""
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = stored(windows(lines(rows.select("id", "text")), min_words))
    runs = repeated(found).groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("line", "last")))).alias("gone"))
    keyed = rows.select("doc", F.col("id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    joined = keyed.join(runs, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")), "left")
    text = F.col(f"doc.`{text_col}`")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda line, i: ~F.array_contains("gone", i))
    return joined.select(
        *(F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in names),
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: The same by comparing all windows, without fingerprints.
ORACLE_SQL = r"""
with l0 as (
  select doc_id, text, unnest(string_split(text, chr(10))) as ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null
), l as (
  select doc_id, pos, ln, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) as w from l0
), c as (
  select *, sum(w) over (partition by doc_id order by pos)::bigint as upto from l where w > 0
), f as (
  select doc_id, pos, list(ln) over ahead as content, sum(w) over ahead as words, max(pos) over ahead as last
  from (select *, upto - w as start from c) window ahead as (partition by doc_id order by start range between current row and 49 following)
  union
  select doc_id, min(pos) over back, list(ln) over back, sum(w) over back, pos
  from c window back as (partition by doc_id order by upto range between 49 preceding and current row)
), d as (
  select doc_id, pos, last, row_number() over (partition by content order by doc_id, pos) as k from f where words >= 50
), gone as (
  select distinct doc_id, unnest(range(pos, last + 1)) as pos from d where k > 1
), per as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed, coalesce(string_agg(l.ln, chr(10) order by l.pos) filter (where g.pos is null), '') as kept
  from l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id
)
select d.doc_id, coalesce(p.n_lines, 0)::bigint as n_lines, coalesce(p.n_removed, 0)::bigint as n_removed, sha256(coalesce(p.kept, '')) as kept_sha256
from documents d left join per p on p.doc_id = d.doc_id
"""
