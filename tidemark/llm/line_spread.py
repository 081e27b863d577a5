"""Line dedup by distinct-site spread: lines that many sites share are boilerplate.

One HyperLogLog sketch of the sites is kept for each line hash and merged by
aggregation. Lines whose estimate lies near the threshold get an exact distinct
count; the rest are decided by the estimate. A boilerplate line stays where it
stands first (smallest doc_id, then line number) and goes everywhere else, so no
content leaves the corpus. Lines are compared after trimming blanks, tabs and
carriage returns; blank lines are never boilerplate.

Everything is DataFrame operations. A common line meets partial aggregation before
each shuffle, and joins on line hashes are plain equi-joins that adaptive execution
may split.

Defined results: null text stays null (0 lines); a null source is no site; null
doc_ids sort last when the first place of a line is chosen; documents that agree in
doc_id and text are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Sites that make a line boilerplate, and the sketch's log2 of buckets.
MIN_SITES, LG_K = 10, 10
#: Places of one line that a task takes; a line on more is dealt over as many tasks as that needs.
PLACES = 50_000
TRIMMED = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: document key, site, place, line hashes."""
    line = F.trim(F.col("line"), F.lit(TRIMMED))
    return (
        docs.select(
            F.col("doc_id").alias("d"),
            F.xxhash64("text").alias("th"),
            F.col("source").alias("site"),
            F.posexplode(F.split("text", "\n")).alias("pos", "line"),
        )
        .select("d", "th", "site", "pos", line.alias("line"))
        .where(F.col("line") != "")
        .select("d", "th", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))
    )


def boilerplate_places(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, places: int = PLACES) -> DataFrame:
    """d, th (document key) and drop, the sorted line numbers that go from it."""
    lines = _lines(docs)
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    spread = F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k))
    sketched = lines.groupBy("k1", "k2").agg(spread.alias("sites"), F.count(F.lit(1)).alias("places"))
    near = common.materialize(
        sketched.where(F.col("sites") >= F.floor(F.lit(min_sites * (1 - error)))).select(
            "k1", "k2", (F.col("sites") > F.ceil(F.lit(min_sites * (1 + error)))).alias("sure"), F.ceil(F.col("places") / places).alias("salts")
        ),
        "lines-near",
    )
    hits = common.materialize(lines.join(near, ["k1", "k2"]), "lines-hit")
    place = F.struct(F.col("d").isNull().alias("no_id"), "d", "pos", "th")
    decided = (
        hits.groupBy("k1", "k2")
        .agg(
            F.count_distinct(F.when(~F.col("sure"), F.col("site"))).alias("exact"),
            F.bool_or("sure").alias("sure"),
            F.max("salts").alias("salts"),
            F.min(place).alias("first"),
        )
        .where(F.col("sure") | (F.col("exact") >= min_sites))
        .select("k1", "k2", "salts", F.col("first.d").alias("d1"), F.col("first.pos").alias("pos1"), F.col("first.th").alias("th1"))
    )
    stays = F.col("d").eqNullSafe(F.col("d1")) & (F.col("pos") == F.col("pos1")) & (F.col("th") == F.col("th1"))
    # A line may stand in a third of all documents: its places are dealt over as many tasks as they need, and its decision to each.
    dealt = hits.withColumn("salt", F.pmod(F.xxhash64("th", "pos"), F.col("salts"))).drop("salts")
    decided = decided.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return dealt.join(decided, ["k1", "k2", "salt"]).where(~stays).groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def _marks(drop: Column) -> Column:
    """A byte for each line up to the last that goes: '1' where the line goes, else '0'."""
    gap = lambda p, i: p - F.when(i == 0, F.lit(-1)).otherwise(F.get(drop, i - 1)) - 1
    return F.array_join(F.transform(drop, lambda p, i: F.concat(F.repeat(F.lit("0"), gap(p, i)), F.lit("1"))), "").cast("binary")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, places: int = PLACES) -> DataFrame:
    """docs with text cleaned, plus n_lines and n_removed (long)."""
    own = docs.columns
    dropped = common.materialize(boilerplate_places(docs, min_sites, lg_k, places), "lines-drop")
    # The marks are made below the join, so the filter's lambda above it reads a column and computes nothing again.
    dropped = common.private(dropped.select("d", "th", _marks(F.col("drop")).alias("marks"), F.size("drop").alias("gone")))
    joined = docs.join(dropped, common.same_document("_tidemark_d", "_tidemark_th"), "left")
    stays = lambda x, i: F.coalesce(F.substring("_tidemark_marks", i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True))
    cleaned = F.when(F.col("_tidemark_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    )
    return joined.select(
        *[cleaned.alias("text") if c == "text" else F.col(c) for c in own],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_tidemark_gone", F.lit(0)).cast("long").alias("n_removed"),
    )


#: The same rows in DuckDB, from exact distinct counts.
ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, u.pos - 1 AS pos, u.line AS raw, trim(u.line, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), common AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first
  FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.*, c.line IS NOT NULL AND NOT (c.first.d = l.doc_id AND c.first.p = l.pos) AS gone
  FROM lines l LEFT JOIN common c ON l.line = c.line
), built AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text) AS kept_chars, md5(text) AS kept_md5 FROM built
UNION ALL
SELECT doc_id, 0, 0, 0, md5('') FROM documents WHERE text IS NULL
"""
