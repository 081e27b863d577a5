"""Finding where an employer publishes: platforms named on a page, job links, verdicts, upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import text
from tidemark.functions.url import host, path, same_site

#: How the addresses of hosted boards name the platform and its token (group 1).
PLATFORMS = (
    ("greenhouse", r"(?i)boards(?:-api)?(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=|v1/boards/)?([a-z0-9_-]+)"),
    ("lever", r"(?i)(?:jobs|api)\.(?:eu\.)?lever\.co/(?:v0/postings/)?([a-z0-9_.-]+)"),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([a-z0-9_.%-]+)"),
    ("workable", r"(?i)apply\.workable\.com/([a-z0-9_-]+)"),
    ("smartrecruiters", r"(?i)(?:careers|jobs)\.smartrecruiters\.com/([a-z0-9_-]+)"),
    ("recruitee", r"(?i)([a-z0-9-]+)\.recruitee\.com"),
    ("personio", r"(?i)([a-z0-9-]+)\.jobs\.personio\.(?:de|com)"),
    ("workday", r"(?i)([a-z0-9-]+)\.wd(\d{1,3})\.myworkdayjobs\.com/(?:[a-z]{2}-[a-z]{2}/)?([a-z0-9_-]+)"),
    ("icims", r"(?i)([a-z0-9-]+)\.icims\.com"),
    ("taleo", r"(?i)([a-z0-9-]+)\.taleo\.net"),
    ("teamtailor", r"(?i)([a-z0-9-]+)\.teamtailor\.com"),
    ("bamboohr", r"(?i)([a-z0-9-]+)\.bamboohr\.com"),
    ("pinpoint", r"(?i)([a-z0-9-]+)\.pinpointhq\.com"),
    ("rippling", r"(?i)ats\.rippling\.com/(?:[a-z]{2}-[a-z]{2}/)?([a-z0-9_-]+)"),
    ("jobvite", r"(?i)jobs\.jobvite\.com/([a-z0-9_-]+)"),
    ("hirehive", r"(?i)([a-z0-9-]+)\.hirehive\.(?:com|io)"),
    ("eightfold", r"(?i)([a-z0-9-]+)\.eightfold\.ai"),
)
#: A path that names a vacancy and nothing that is none; read in one go.
JOB_PATH = r"(?i)^(?!.*(?:privacy|cookie|login|sign-?in|about|contact|blog|news|faq|terms)).*/(?:jobs?|careers?|vacanc(?:y|ies)|positions?|opportunit(?:y|ies)|roles?|openings?)(?:/|-|\b)"


def token_of(address: Column, name: str, pattern: str) -> Column:
    """The token as its platform's reader takes it: for Workday tenant, number and site, which keeps its case."""
    parts = [F.regexp_extract(address, pattern, i) for i in range(1, 4 if name == "workday" else 2)]
    return F.concat_ws("|", F.lower(parts[0]), *parts[1:])


def detect(pages: DataFrame) -> DataFrame:
    """url, ats, token, rank: platforms that a page's address, then its markup name, in the order of the table.

    pages: url, html.
    """
    found = F.array_compact(
        F.array(
            *[
                F.when(c.rlike(p), F.struct(F.lit(place * 100 + i).alias("rank"), F.lit(name).alias("ats"), token_of(c, name, p).alias("token")))
                for place, c in enumerate((text(F.col("url")), text(F.col("html"))))
                for i, (name, p) in enumerate(PLATFORMS)
            ]
        )
    )
    rows = pages.select("url", F.explode(found).alias("f")).select("url", "f.*")
    return rows.groupBy("url", "ats", "token").agg(F.min("rank").alias("rank"))


def anchors(pages: DataFrame) -> DataFrame:
    """url, pos and href of every link; hrefs beginning with a slash get the page's host."""
    found = F.regexp_extract_all(text(F.col("html")), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'#][^\"']*)[\"']"), F.lit(1))
    rows = pages.select("url", F.posexplode(found).alias("pos", "href"))
    absolute = F.when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), "href")).when(
        F.startswith("href", F.lit("/")), F.concat(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*", 0), "href")
    ).otherwise(F.col("href"))
    return rows.select("url", "pos", absolute.alias("href"))


def link_candidates(pages: DataFrame, most: int = 45) -> DataFrame:
    """Links that could be vacancies: of the page's own site or a known platform, with a path that says so. First occurrence, first `most` of a page."""
    platform = F.lit(False)
    for _, pattern in PLATFORMS:
        platform = platform | F.col("href").rlike(pattern)
    # The cheap test of the path leaves few links, of which each is read once for its site.
    likely = anchors(pages).where(F.col("href").rlike("^https?://") & path(F.col("href")).rlike(JOB_PATH))
    links = likely.where(same_site(F.col("url"), F.col("href")) | platform)
    first = links.groupBy("url", "href").agg(F.min("pos").alias("pos"))
    # A page's links are bounded by the page, and so is the array.
    kept = first.groupBy("url").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "href"))), F.lit(1), F.lit(most)).alias("links"))
    return kept.select("url", F.posexplode("links").alias("rank", "link")).select("url", F.col("rank").cast("int"), F.col("link.href").alias("href"))


def slug_variants(name: Column) -> Column:
    """At most four tokens under which a board of an employer may be found."""
    plain = F.trim(F.regexp_replace(F.lower(text(name)), "[^a-z0-9]+", " "))
    words = F.filter(F.split(plain, " "), lambda w: ~w.isin("ltd", "limited", "plc", "inc", "group", "company", "ireland", ""))
    forms = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(words, "_"), F.coalesce(F.get(words, 0), F.lit("")))
    return F.slice(F.array_distinct(F.filter(forms, lambda f: F.length(f) >= 2)), F.lit(1), F.lit(4))


def page_title(html: Column) -> Column:
    """The first h1, else the title element, without markup."""
    clean = lambda pattern: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(text(html), pattern, 1), "<[^>]+>", " "), r"\s+", " "))
    h1 = clean(r"(?is)<h1[^>]*>(.*?)</h1>")
    return F.when(h1 != "", h1).otherwise(clean(r"(?is)<title[^>]*>(.*?)</title>"))


def verdict(ok: Column, jobs: Column, home_jobs: Column) -> Column:
    """What a probe of a feed comes to."""
    return F.when(~ok, "unreachable").when(jobs == 0, "empty").when(home_jobs == 0, "none here").when(home_jobs < 3, "few").otherwise("good")


def upgrades(current: DataFrame, probes: DataFrame, least: int = 1) -> DataFrame:
    """name and the feed to adopt: that of the most jobs here, if it beats the present one's.

    current: name, home_jobs; probes: name, ats, token, ordinal, home_jobs.
    """
    best = probes.where(F.col("home_jobs") >= least).groupBy("name").agg(
        F.min_by(F.struct("ats", "token", "home_jobs"), F.struct((-F.col("home_jobs")).alias("n"), "ordinal")).alias("b")
    )
    joined = best.join(current.withColumnRenamed("home_jobs", "_now"), "name", "left")
    return joined.where(F.col("b.home_jobs") > F.coalesce("_now", F.lit(0))).select("name", "b.ats", "b.token", "b.home_jobs")


def sheet_columns(rows: DataFrame) -> DataFrame:
    """name_col, count_col, header_row of a register sheet, from its first rows.

    rows: row int, cells array<string>. The header is the first row that names both columns.
    """
    named = rows.select(
        "row",
        F.array_position(F.transform("cells", lambda c: F.lower(text(c)).rlike(r"\b(employer|company|name)\b")), True).alias("name_col"),
        F.array_position(F.transform("cells", lambda c: F.lower(text(c)).rlike(r"\b(permits?|total|issued|count)\b")), True).alias("count_col"),
    ).where((F.col("name_col") > 0) & (F.col("count_col") > 0))
    return named.orderBy("row").limit(1).select(F.col("row").alias("header_row"), "name_col", "count_col")


def read_register(rows: DataFrame) -> DataFrame:
    """name, permits and ordinal of a register sheet below its inferred header; totals are left out."""
    header = F.broadcast(sheet_columns(rows))  # one row
    below = rows.join(header, rows["row"] > header["header_row"])
    name = F.trim(F.try_element_at("cells", F.col("name_col").cast("int")))
    permits = F.regexp_replace(F.try_element_at("cells", F.col("count_col").cast("int")), "[, ]", "").try_cast("int")
    return below.select(name.alias("name"), permits.alias("permits"), F.col("row").alias("ordinal")).where(
        (F.length("name") > 1) & F.col("permits").isNotNull() & ~F.lower("name").rlike("^(grand )?total")
    )


def unknown_hosts(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """Pages of no known employer's host."""
    known = companies.select(host(F.col("website")).alias("_h")).where(F.col("_h") != "").distinct()
    return pages.join(known, host(F.col("url")) == F.col("_h"), "left_anti")


def prospects(register: DataFrame, tracked: DataFrame, broken: DataFrame, top: int) -> DataFrame:
    """The register's employers to look into next: not tracked, or tracked with a broken feed; the likeliest first.

    register: name, sponsor_confidence, fit_rank.
    """
    confidence = F.when(F.col("sponsor_confidence") == "documented", 3).when(F.col("sponsor_confidence") == "likely", 2).when(F.col("sponsor_confidence") == "unverified", 1).otherwise(0)
    skip = tracked.select("name").join(broken.select("name"), "name", "left_anti").distinct()
    ranked = register.join(skip, "name", "left_anti").withColumn("priority", confidence * 12 + F.coalesce("fit_rank", F.lit(0)))
    return ranked.orderBy(F.col("priority").desc(), "name").limit(top)
