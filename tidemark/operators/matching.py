"""Joins by name: lookups, registers with fuzzy keys, tracked employers, moved vacancies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.url import vacancy_of


def company_order(companies: DataFrame) -> DataFrame:
    """Employers in their table's order: best fit first, then most permits, then by name."""
    return companies.orderBy(F.col("fit_rank").desc_nulls_last(), F.col("permits").desc_nulls_last(), "name")


def top_permits(companies: DataFrame, top: int = 12) -> DataFrame:
    """name and permits of the employers with the most."""
    return companies.where(F.col("permits") > 0).select("name", "permits").orderBy(F.col("permits").desc(), "name").limit(top)


def without_names(companies: DataFrame, names: DataFrame) -> DataFrame:
    """The employers that a list (name) does not ask to delete, whatever its case and outer blanks."""
    gone = names.select(F.lower(F.trim("name")).alias("_gone")).distinct()
    return companies.join(gone, F.lower(F.trim("name")) == F.col("_gone"), "left_anti")


def company_lookup(postings: DataFrame, companies: DataFrame, any_case: bool = False) -> DataFrame:
    """postings left-joined to their employer by name, in any case if asked; of equal names the last ordinal stands."""
    own = [c for c in companies.columns if c not in ("name", "ordinal")]
    if any_case:
        last = companies.groupBy(F.lower("name").alias("_low")).agg(F.max_by(F.struct(*own), "ordinal").alias("_row")).select("_low", "_row.*")
        return postings.withColumn("_low", F.lower("company")).join(last, "_low", "left").drop("_low")
    last = companies.groupBy("name").agg(F.max_by(F.struct(*own), "ordinal").alias("_row")).select(F.col("name").alias("company"), "_row.*")
    return postings.join(last, "company", "left")


GRAM = 6


def grams(key: Column) -> Column:
    """The distinct runs of GRAM characters of a key; a shorter key as a whole."""
    n = F.length(key)
    return F.when(n <= GRAM, F.array(key)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(GRAM))))
    )


def _runs(key: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(n)))


def fuzzy_permits(companies: DataFrame, register: DataFrame) -> DataFrame:
    """companies with permits and matched, the register key they were matched to.

    companies: name, key; register: key, permits, ordinal. Equal keys match first; else,
    for keys of at least six characters, the first register row whose key holds or lies in
    the employer's. All runs of the shorter key stand in the longer, so its rarest run finds
    every match by an equi-join: common runs are met by the keys that have none rarer only.
    Register keys under six characters are a run of their own, and meet the employers' runs of
    their length. The runs of both sides are one table, counted once and joined to itself.
    """
    listed = register.groupBy("key").agg(F.min("ordinal").alias("ordinal"), F.sum(F.greatest("permits", F.lit(1))).cast("long").alias("permits")).where(F.col("key") != "")
    named = companies.select("name", "key").join(listed, "key", "left")
    keys = named.where(F.col("permits").isNull() & (F.length("key") >= GRAM)).select("key").distinct()
    short = F.array_distinct(F.flatten(F.array(*[_runs(F.col("key"), n) for n in range(1, GRAM)])))
    none = F.lit(None).cast("long")
    run = lambda side, g, n, ordinal, permits: [F.lit(side).alias("side"), F.col("key"), F.explode(g).alias("g"), n.alias("of"), ordinal.alias("ordinal"), permits.alias("permits")]
    # of: how many of a side's runs must all be known; an employer's short ones need not.
    runs = (
        keys.select(*run("employer", grams(F.col("key")), F.size(grams(F.col("key"))), none, none))
        .unionByName(keys.select(*run("employer", short, F.lit(0), none, none)))
        .unionByName(listed.select(*run("register", grams(F.col("key")), F.size(grams(F.col("key"))), F.col("ordinal").cast("long"), F.col("permits"))))
    )
    counts = runs.groupBy("g").agg(F.count_if(F.col("side") == "employer").alias("n_employer"), F.count_if(F.col("side") == "register").alias("n_register"))
    known = runs.join(counts.where((F.col("n_employer") > 0) & (F.col("n_register") > 0)), "g")
    rarity = F.struct(F.when(F.col("side") == "employer", F.col("n_register")).otherwise(F.col("n_employer")).alias("n"), "g")
    rare = known.where(F.col("of") > 0).groupBy("side", "key", "of").agg(F.min(rarity).alias("least"), F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("ordinal"), F.min("permits").alias("permits"))
    rare = rare.where(F.col("n") == F.col("of")).select("side", "key", F.col("least.g").alias("g"), "ordinal", "permits")
    other = known.select(F.col("side").alias("other_side"), F.col("key").alias("other"), "g", F.col("ordinal").alias("other_ordinal"), F.col("permits").alias("other_permits"))
    met = rare.join(other, "g").where((F.col("side") != F.col("other_side")) & F.contains("other", "key"))
    mine = F.col("side") == "employer"  # the shorter key is the employer's
    pick = lambda a, b: F.when(mine, F.col(a)).otherwise(F.col(b))
    pairs = met.select(pick("key", "other").alias("key"), pick("other", "key").alias("r"), pick("other_ordinal", "ordinal").alias("o"), pick("other_permits", "permits").alias("p"))
    first = pairs.groupBy("key").agg(F.min_by(F.struct("p", "r"), "o").alias("m"))
    joined = named.join(first, "key", "left").where(F.col("permits").isNotNull() | F.col("m").isNotNull())
    equal = F.col("permits").isNotNull()
    return joined.select("name", "key", F.coalesce("permits", "m.p").alias("permits"), F.when(equal, F.col("key")).otherwise(F.col("m.r")).alias("matched"))


def already_tracked(candidates: DataFrame, tracked: DataFrame) -> DataFrame:
    """name and the first tracked name whose words hold all of the candidate's, and at most twice as many.

    candidates: name, words; tracked: name, words, ordinal. All of a candidate's words occur in a match,
    so the one that the fewest tracked names hold finds every match by an equi-join.
    """
    held = tracked.select(F.col("name").alias("tracked"), F.col("words").alias("have"), "ordinal", F.explode("words").alias("g"))
    counts = tracked.select(F.explode("words").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # A name with other words is another candidate; the hash tells them apart within a name, and words go along as values.
    asked = candidates.where(F.size("words") > 0).select("name", "words", F.xxhash64("words").alias("h"), F.explode("words").alias("g"))
    counted = asked.join(counts, "g", "left").groupBy("name", "h").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("least"), F.first("words").alias("words"))
    rare = counted.where(F.col("least.n") > 0).select("name", "words", F.col("least.g").alias("g"))
    pairs = rare.join(held, "g").where((F.size(F.array_except("words", "have")) == 0) & (F.size("words") * 2 >= F.size("have")))
    return pairs.groupBy("name").agg(F.min_by("tracked", "ordinal").alias("tracked"))


def follow_moved(state: DataFrame, board: DataFrame) -> DataFrame:
    """job_id of marks on postings that left, and moved_to, the open posting of the same vacancy.

    state: job_id, company, url; board: id, company, url, closed. Postings already marked are no target.
    """
    gone = state.join(board.select(F.col("id").alias("job_id")), "job_id", "left_anti").withColumn("v", vacancy_of(F.col("company"), F.col("url")))
    open_ = (
        board.where(~F.coalesce("closed", F.lit(False)))
        .join(state.select(F.col("job_id").alias("id")), "id", "left_anti")
        .groupBy(vacancy_of(F.col("company"), F.col("url")).alias("v"))
        .agg(F.min("id").alias("moved_to"))
    )
    return gone.join(open_, "v").select("job_id", "moved_to")
