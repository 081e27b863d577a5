"""The registered queries: what each computes, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CORPUS, DEFAULT
from tidemark.functions.text import company_key, hits, posting_id, safe_url
from tidemark.functions.url import job_address, slug_words
from tidemark.operators import dedupe, discovery, eligibility, feedback, gates, lifecycle, matching, routes, scoring, view
from tidemark.plans import score_sql
from tidemark.sources import tables
from tidemark.sources.tables import CUT, NOW, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
SCORED = score_sql.scored(
    f"SELECT doc_id, lower({TITLE}) AS title, lower(lang) AS place, lower(source) AS sector, 0 AS permits, "
    f"lower({TITLE} || ' ' || coalesce(text, '') || '  ') AS txt FROM documents",
    CORPUS,
)
SENIOR = r"(?i)\b(senior|sr\.?|head of|director|principal|chief|vice president|vp|lead|manager)\b"
GRADUATE = r"(?i)\b(graduate|trainee|intern|internship|apprentice|junior|entry[\s-]level|early careers?)\b"
GATED = f"""SELECT doc_id, CASE WHEN {TITLE} = '' THEN 'incomplete record' WHEN lang = 'es' THEN 'elsewhere'
  WHEN contains(lower({TITLE} || '  ' || left(text, 2000)), '!!') OR contains(lower({TITLE} || '  ' || left(text, 2000)), '$$$') THEN 'engagement not wanted'
  WHEN regexp_matches({TITLE}, '{SENIOR}') AND NOT regexp_matches({TITLE}, '{GRADUATE}') THEN 'senior role' END AS drop_reason FROM documents"""


@query(f"SELECT drop_reason, count(*) AS n FROM ({GATED}) WHERE drop_reason IS NOT NULL GROUP BY 1")
def gate_reasons(spark, sf_dir):
    """Ordered gates, counted by the first that fails."""
    return gates.apply_gates(tables.postings(spark, sf_dir), CORPUS)[1]


@query(f"SELECT doc_id FROM ({GATED}) WHERE drop_reason IS NULL")
def gate_kept(spark, sf_dir):
    """What passes every gate."""
    return gates.apply_gates(tables.postings(spark, sf_dir), CORPUS)[0].select("doc_id")


@query(
    "SELECT term, count(*) AS n FROM (SELECT unnest(['password', 'token', 'licensed under', 'idiot']) AS term), documents "
    "WHERE CASE WHEN contains(term, ' ') THEN contains(lower(text), term) ELSE regexp_matches(lower(text), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') END GROUP BY 1"
)
def term_hits(spark, sf_dir):
    """Terms by the number of documents that hold them."""
    found = hits(F.lower(F.coalesce("text", F.lit(""))), ("password", "token", "licensed under", "idiot"))
    return read(spark, sf_dir, "documents").select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark, sf_dir):
    return scoring.score_postings(tables.spread(tables.postings(spark, sf_dir)), CORPUS)


@query(f"SELECT doc_id, score, band FROM ({SCORED})")
def score_board(spark, sf_dir):
    """Score and band of every posting."""
    return _scored(spark, sf_dir).select("doc_id", "score", "band")


@query(f"SELECT band, count(*) AS n, sum(score)::BIGINT AS total FROM ({SCORED}) GROUP BY 1")
def band_counts(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query(f"SELECT doc_id, u.pos - 1 AS pos, u.r.label AS label, u.r.points AS points FROM ({SCORED}), LATERAL (SELECT unnest(rows) AS r, generate_subscripts(rows, 1) AS pos) u")
def breakdown_explode(spark, sf_dir):
    """Every row of every breakdown, in order."""
    # No breakdown is empty. The outer form keeps the optimizer from pushing a test of emptiness, with all of the scoring in it, below.
    rows = _scored(spark, sf_dir).select("doc_id", F.posexplode_outer("breakdown").alias("pos", "r"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "r.label", "r.points")


SQUASHED = f"trim(regexp_replace(lower({TITLE}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT source AS company, {SQUASHED} AS title_key, lang AS place, min_by(doc_id, struct_pack(s := -n_chars, o := doc_id)) AS doc_id FROM documents GROUP BY 1, 2, 3")
def best_per_key(spark, sf_dir):
    """Of equal employer, title and place the longest posting, then the first."""
    scored = tables.postings(spark, sf_dir).withColumn("score", F.col("n_chars"))
    keyed = scored.withColumn("k", dedupe.dedupe_key())
    best = dedupe.best_posting(keyed, keep=("doc_id", "k"))
    return best.select(F.col("k.company").alias("company"), F.col("k.title").alias("title_key"), F.col("k.place").alias("place"), "doc_id")


@query(f"SELECT substr(sha1(lower(source) || '|' || lower({TITLE}) || '|' || 'https://' || source || '.example/jobs/' || doc_id), 1, 16) AS id, source AS company, lang AS location FROM documents")
def read_boards(spark, sf_dir):
    """Every document as a board's recorded JSON, parsed and mapped like any platform's."""
    from tidemark.sources.normalise import postings

    p = tables.postings(spark, sf_dir)
    job = F.struct("title", F.col("url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"), F.col("description").alias("content"))
    boards = p.select(F.lit("greenhouse").alias("ats"), "company", F.col("company").alias("token"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("raw"), "ordinal")
    return postings(boards, ["greenhouse"]).select("id", "company", "location")


HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
PATH = "rtrim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"
KEPT = (
    "array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: contains(p, '=') AND split_part(p, '=', 1) <> '' "
    "AND right(p, 1) <> '=' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_\\w+|lang|hslang|locale|domain|source|src|ref|trk)$')), '&')"
)
ADDRESS = f"(CASE WHEN {HOST} <> '' THEN '//' ELSE '' END || {HOST} || {PATH} || CASE WHEN {KEPT} <> '' THEN '?' || {KEPT} ELSE '' END)"


def _copied_pages(spark, sf_dir):
    """pages and a copy of them under another scheme, with a tracking parameter, seen earlier."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    swapped = F.when(F.startswith("url", F.lit("http://")), F.concat(F.lit("https://"), F.substring("url", F.lit(8), F.length("url")))).otherwise(
        F.concat(F.lit("http://"), F.substring("url", F.lit(9), F.length("url")))
    )
    base = F.split_part(swapped, F.lit("#"), F.lit(1))
    tracked = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("utm_source=copy"))
    seen = lambda s: F.lit(s).cast("timestamp")
    copy = pages.select((F.col("page_id") + 1_000_000).alias("page_id"), tracked.alias("url"), F.when(F.col("page_id") % 2 == 0, seen("2024-01-02 00:00:00")).otherwise(seen("2024-01-01 00:00:00")).alias("last_seen"))
    return pages.select("*", seen("2024-01-01 12:00:00").alias("last_seen")).unionByName(copy)


COPIED = """SELECT page_id, url, TIMESTAMP '2024-01-01 12:00:00' AS last_seen FROM pages UNION ALL
  SELECT page_id + 1000000, b || CASE WHEN contains(b, '?') THEN '&' ELSE '?' END || 'utm_source=copy', CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END
  FROM (SELECT page_id, split_part(CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE 'http://' || substr(url, 9) END, '#', 1) AS b FROM pages)"""


@query(f"SELECT {ADDRESS} AS address, min_by(page_id, struct_pack(s := -epoch_us(last_seen), o := page_id)) AS page_id FROM ({COPIED}) GROUP BY 1")
def best_per_address(spark, sf_dir):
    """Of equal addresses the row seen last."""
    rows = _copied_pages(spark, sf_dir).select("*", F.col("page_id").alias("id"), F.lit(0).alias("score"), F.col("page_id").alias("ordinal"))
    return dedupe.best_address(rows).select(job_address(F.col("url")).alias("address"), "page_id")


@query(f"SELECT page_id, {ADDRESS} AS address FROM pages")
def url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", job_address(F.col("url")).alias("address"))


@query(f"SELECT doc_id, substr(sha1(lower(source) || '|' || lower({TITLE}) || '|' || 'https://' || source || '.example/jobs/' || doc_id), 1, 16) AS id FROM documents")
def posting_ids(spark, sf_dir):
    return tables.postings(spark, sf_dir).select("doc_id", posting_id(F.col("company"), F.col("title"), F.col("url")).alias("id"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    """The heading of each page (all of these have one)."""
    return read(spark, sf_dir, "pages").select("page_id", discovery.page_title(F.col("html")).alias("title"))


@query()
def html_text(spark, sf_dir):
    """Readable text of each page."""
    from tidemark.functions.text import readable_text

    return read(spark, sf_dir, "pages").select("page_id", readable_text(F.col("html")).alias("text"))


@query("SELECT url, count(*) AS n FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"''#][^\"'']*)[\"'']', 1)) AS href FROM pages) GROUP BY 1")
def anchor_counts(spark, sf_dir):
    """Links of each page."""
    return discovery.anchors(read(spark, sf_dir, "pages")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query()
def link_candidates(spark, sf_dir):
    return discovery.link_candidates(read(spark, sf_dir, "pages").select("url", F.replace("html", F.lit('href="/'), F.lit('href="/jobs/')).alias("html")))


@query(
    "SELECT page_id, regexp_replace(coalesce(list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '' AND NOT regexp_matches(p, '^\\d+$'))[-1], ''), '[-_+.]+', ' ', 'g') AS words, "
    "CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN trim(url) ELSE '' END AS safe FROM pages"
)
def slug_and_safe_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", slug_words(F.col("url")).alias("words"), safe_url(F.col("url")).alias("safe"))


SCANS = f"""ev AS (SELECT user_id || '|' || event_type AS id, (user_id % 10)::VARCHAR AS company, ts, value FROM events),
old AS (SELECT id, company, min(ts) AS first_seen, max(ts) AS last_seen, length(id) % 4 = 0 AS closed FROM ev WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1, 2),
seen AS (SELECT DISTINCT id, company FROM ev WHERE ts >= TIMESTAMP '{CUT}' AND value < 20),
answered AS (SELECT DISTINCT company FROM seen WHERE company <> '3'),
merged AS (SELECT coalesce(o.id, s.id) AS id, coalesce(s.company, o.company) AS company, coalesce(o.first_seen, TIMESTAMP '{NOW}') AS first_seen,
  CASE WHEN s.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE o.last_seen END AS last_seen,
  s.id IS NULL AND (coalesce(o.closed, false) OR o.company IN (SELECT company FROM answered)) AS closed,
  CASE WHEN s.id IS NULL AND NOT coalesce(o.closed, false) AND o.company IN (SELECT company FROM answered) THEN TIMESTAMP '{NOW}' END AS closed_at,
  o.id IS NULL AS is_new, coalesce(o.closed, false) AND s.id IS NOT NULL AS reopened FROM old o FULL JOIN seen s ON o.id = s.id)"""


def _merged(spark, sf_dir):
    board, scan = tables.scans(spark, sf_dir)
    answered = scan.select("company").where("company <> '3'").distinct()
    return lifecycle.merge_scan(board, scan, answered, F.lit(NOW).cast("timestamp"))


@query(f"WITH {SCANS} SELECT id, company, first_seen, last_seen, closed, closed_at, is_new FROM merged")
def merge_board(spark, sf_dir):
    """The board after a scan of all employers but one."""
    return _merged(spark, sf_dir)


@query(f"WITH {SCANS} SELECT id FROM merged WHERE closed_at IS NOT NULL")
def closed_jobs(spark, sf_dir):
    """What this scan closed."""
    return _merged(spark, sf_dir).where(F.col("closed_at").isNotNull()).select("id")


@query(f"WITH {SCANS} SELECT id FROM merged WHERE reopened")
def reopened(spark, sf_dir):
    """What was closed and is seen again."""
    board = tables.scans(spark, sf_dir)[0].where("closed").select("id")
    return _merged(spark, sf_dir).where(~F.col("closed")).join(board, "id", "left_semi").select("id")


@query(f"WITH {SCANS} SELECT id, first_seen >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND first_seen > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS is_new FROM merged WHERE last_seen >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY")
def ttl_expire(spark, sf_dir):
    """What was seen in the last twenty days."""
    return lifecycle.age_out(_merged(spark, sf_dir), F.lit(NOW).cast("timestamp"), max_days=20).select("id", "is_new")


@query(
    "WITH e AS (SELECT user_id::VARCHAR AS name, ts, event_type <> 'error' AS ok, props FROM events), l AS (SELECT name, max(ts) FILTER (ok) AS last_ok FROM e GROUP BY 1), "
    "f AS (SELECT e.name, count(*) AS fails FROM e JOIN l USING (name) WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok) GROUP BY 1) "
    "SELECT name, coalesce(fails, 0) AS fails, last_ok, coalesce(fails, 0) >= 3 AND 7 % 4 <> 0 AS resting FROM l LEFT JOIN f USING (name)"
)
def feed_quarantine(spark, sf_dir):
    """Failures since the last success, and who rests in slot 7 after three of them."""
    events = read(spark, sf_dir, "events")
    health = lifecycle.failure_streaks(
        events.select(F.col("user_id").cast("string").alias("name"), "ts", (F.col("event_type") != "error").alias("ok"), F.col("props").alias("error"))
    )
    return health.select("name", "fails", "last_ok", lifecycle.quarantined(F.col("fails"), F.lit(7), after=3).alias("resting"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier WHERE s_acctbal <= 9000) WHERE r % 8 = 5")
def shard_pick(spark, sf_dir):
    """Priority suppliers and the fifth of eight shards of the rest."""
    boards = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 9000).alias("priority"), F.col("s_suppkey").alias("ordinal"))
    return lifecycle.pick_shard(boards, 13).select("s_suppkey")


@query(
    "SELECT n_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
)
def company_lookup(spark, sf_dir):
    """Orders with their customer and nation, which stay if unknown."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    dim = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").cast("string").alias("name"), "n_name", F.lit(0).alias("ordinal"))
    rows = matching.company_lookup(orders.select(F.col("o_custkey").cast("string").alias("company"), "o_totalprice"), dim)
    return rows.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("company").alias("customers"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total")
    )


@query("SELECT o_custkey, count(*) AS permits, CASE WHEN count(*) >= 25 THEN 3 WHEN count(*) >= 5 THEN 2 WHEN count(*) >= 1 THEN 1 ELSE 0 END AS tier FROM orders GROUP BY 1")
def permit_tiers(spark, sf_dir):
    counted = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("permits"))
    return counted.withColumn("tier", scoring.sponsor_tier(F.col("permits")))


@query(
    """WITH names AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part),
reg AS (SELECT key, min(ordinal) AS ordinal, count(*) AS permits FROM (SELECT lower(p_type) AS key, p_partkey AS ordinal FROM part) GROUP BY 1),
pairs AS (SELECT n.name, n.key, r.key AS matched, r.permits, CASE WHEN n.key = r.key THEN -1 ELSE r.ordinal END AS o FROM names n JOIN reg r ON n.key = r.key OR (length(n.key) >= 6 AND (contains(n.key, r.key) OR contains(r.key, n.key))))
SELECT name, key, min_by(permits, o) AS permits, min_by(matched, o) AS matched FROM pairs GROUP BY 1, 2"""
)
def fuzzy_permits(spark, sf_dir):
    """Part names against part types, as employers against a register."""
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "").alias("key")).distinct()
    register = part.select(F.lower("p_type").alias("key"), F.lit(1).alias("permits"), F.col("p_partkey").alias("ordinal"))
    return matching.fuzzy_permits(names, register)


@query(
    """WITH want AS (SELECT DISTINCT p_type AS name, list_distinct(string_split(lower(p_type), ' ')) AS words FROM part),
have AS (SELECT p_name AS tracked, min(p_partkey) AS ordinal, list_distinct(string_split(lower(p_name), ' ')) AS words FROM part GROUP BY 1)
SELECT w.name, min_by(h.tracked, h.ordinal) AS tracked FROM want w JOIN have h ON list_has_all(h.words, w.words) AND len(w.words) * 2 >= len(h.words) GROUP BY 1"""
)
def tracked_names(spark, sf_dir):
    """Part types whose words all stand in a part name."""
    part = read(spark, sf_dir, "part")
    asked = part.select(F.col("p_type").alias("name"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("words")).distinct()
    held = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ordinal")).withColumn("words", F.array_distinct(F.split(F.lower("name"), " ")))
    return matching.already_tracked(asked, held)


LOG = f"log AS (SELECT CASE WHEN toxic = 1 THEN 'hidden' ELSE 'applied' END AS kind, source AS company, {TITLE} AS title FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR (quality = 1 AND toxic = 0))"
STOPPED = ", ".join(f"'{w}'" for w in feedback.STOP)
WORDS = f"words AS (SELECT DISTINCT kind, rid, word FROM (SELECT kind, rid, unnest(regexp_extract_all(lower(title), '[a-z]{{4,}}')) AS word FROM (SELECT *, row_number() OVER () AS rid FROM log)) WHERE word NOT IN ({STOPPED}))"
COUNTED = f"WITH {LOG}, {WORDS}, counted AS (SELECT word, count(*) AS n FROM words WHERE kind = 'hidden' AND word NOT IN (SELECT word FROM words WHERE kind = 'applied') GROUP BY 1)"


@query(f"{COUNTED} SELECT word, n FROM counted WHERE n >= 3")
def learned_words(spark, sf_dir):
    """Title words rejected three times and never applied to."""
    return feedback.learned_words(tables.feedback(spark, sf_dir))


@query(f"{COUNTED} SELECT word, n FROM counted WHERE n >= 2 ORDER BY n DESC, word LIMIT 30")
def word_suggestions(spark, sf_dir):
    """The thirty most rejected words."""
    return feedback.suggestions(tables.feedback(spark, sf_dir))


@query(f"WITH {LOG} SELECT DISTINCT lower(company) AS company, lower(title) AS title FROM log WHERE kind = 'hidden' EXCEPT SELECT lower(company), lower(title) FROM log WHERE kind = 'applied'")
def rejected_pairs(spark, sf_dir):
    return feedback.rejected_pairs(tables.feedback(spark, sf_dir))


BOARD = f"""b AS (SELECT doc_id AS id, {TITLE} AS title, source AS company, lang AS location, (n_chars % 101)::INT AS score,
  TIMESTAMP '{NOW}' - to_days((doc_id % 30)::INT) - to_hours((doc_id % 24)::INT) AS first_seen, doc_id % 17 = 0 AS closed, doc_id % 13 = 0 AS blocked,
  coalesce(toxic = 1, false) AS hidden, coalesce(quality = 0, false) AS applied FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT *, score - least(epoch(TIMESTAMP '{NOW}' - first_seen) / 86400.0 * 3, 24.0) AS urgency FROM b WHERE NOT blocked AND NOT hidden AND NOT applied AND NOT closed)"""


def _view(spark, sf_dir, params: view.ViewParams) -> DataFrame:
    return view.board_view(tables.board(spark, sf_dir), tables.marks(spark, sf_dir), params, F.lit(NOW).cast("timestamp"))


@query(f"WITH {BOARD} SELECT id, company, score FROM v WHERE score >= 20 ORDER BY round(urgency, 6) DESC, id LIMIT 20")
def view_fresh(spark, sf_dir):
    """The first page by urgency."""
    return _view(spark, sf_dir, view.ViewParams(min_score=20)).select("id", "company", "score")


@query(
    f"WITH {BOARD} SELECT id, company, score FROM v WHERE contains(lower(title) || ' · ' || lower(company), 'the') ORDER BY CASE WHEN starts_with(lower(title), 'the') THEN 0 WHEN contains(lower(title), 'the') THEN 1 WHEN contains(lower(company), 'the') THEN 2 ELSE 3 END, score DESC, id LIMIT 20"
)
def view_search(spark, sf_dir):
    """A search, title hits before employer hits, by score."""
    return _view(spark, sf_dir, view.ViewParams(q="the", sort="score")).select("id", "company", "score")


@query(f"WITH {BOARD} SELECT id, company, score FROM v WHERE location = 'en' AND first_seen >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY ORDER BY company, score DESC, id LIMIT 20 OFFSET 40")
def view_page(spark, sf_dir):
    """The third page of one place's postings of two weeks, by employer."""
    return _view(spark, sf_dir, view.ViewParams(location="en", age_days=14, sort="company", page=3)).select("id", "company", "score")


@query(f"WITH {BOARD} SELECT count(*) FILTER (NOT applied AND NOT hidden AND NOT closed AND NOT blocked) AS jobs, count(*) FILTER (applied) AS applied, count(*) FILTER (hidden) AS hidden FROM b")
def tab_counts(spark, sf_dir):
    return view.tab_counts(tables.board(spark, sf_dir), tables.marks(spark, sf_dir))


@query("SELECT s_name AS name, floor(s_acctbal / 100)::INT AS permits FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY 2 DESC, 1 LIMIT (SELECT greatest(0, 60 - count(*)) FROM supplier WHERE s_suppkey % 3 = 0)")
def growth_cap(spark, sf_dir):
    """Suppliers admitted by balance until sixty are tracked."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.floor(F.col("s_acctbal") / 100).cast("int").alias("permits"))
    return lifecycle.growth_cap(rows.where("s_suppkey % 3 <> 0").select("name", "permits"), rows.where("s_suppkey % 3 = 0"), cap=60)


@query(
    "SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '\\b(limited|ltd|plc|llc|llp|inc|corp|corporation|gmbh|bv|sa|company|group|holdings?|international|services|solutions|technology|technologies|global|europe|the)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM supplier"
)
def company_keys(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", company_key(F.col("s_name")).alias("key"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def events_hourly(spark, sf_dir):
    """Tumbling windows of an hour (an extra: the engine's own windows)."""
    e = read(spark, sf_dir, "events")
    counted = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return counted.select(F.col("w.start").alias("hour"), "event_type", "n", "users")


@query(
    "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true)::INT AS opens FROM events), "
    "s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, sid"
)
def events_sessions(spark, sf_dir):
    """Session windows with a gap of six hours (an extra)."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("began"), F.count(F.lit(1)).alias("n")).select("user_id", "began", "n")


@query("SELECT user_id || '|' || event_type AS id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def stream_lifecycle(spark, sf_dir):
    """First and last seen of every posting, kept by a stream over the events."""
    from tidemark.streaming.lifecycle import run_over

    return run_over(spark, f"{sf_dir}/events.parquet")


@query(
    """WITH e AS (SELECT (user_id % 10)::VARCHAR AS company, user_id || '|' || event_type AS id, date_trunc('day', ts)::TIMESTAMP AS day_ FROM events),
p AS (SELECT id, company, min(day_) AS first_seen, max(day_) AS last_seen FROM e GROUP BY 1, 2),
c AS (SELECT p.id, min(s.day_) AS closed_at FROM p JOIN (SELECT DISTINCT company, day_ FROM e) s ON s.company = p.company AND s.day_ > p.last_seen GROUP BY 1)
SELECT p.id, company, first_seen, last_seen, closed_at IS NOT NULL AS closed, closed_at FROM p LEFT JOIN c ON c.id = p.id"""
)
def stream_board(spark, sf_dir):
    """The board of a stream of daily scans: what a day's scan of an employer does not show closes, and opens when it shows again."""
    from tidemark.streaming import lifecycle as stream

    path, checkpoint = f"{sf_dir}/events.parquet", stream.scratch(spark, "board")
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    scans = events.select(
        (F.col("user_id") % 10).cast("string").alias("company"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("id"),
        F.date_trunc("day", "ts").cast("timestamp").alias("scanned_at"),
    )
    stream.run_boards(scans, checkpoint)
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen", "closed_at")]
    return stream.board_table(spark, checkpoint).select("id", "company", "closed", *plain)


@query()
def eligibility_status(spark, sf_dir):
    """Clause-reading rules, routes and final status over every document."""
    scored = scoring.score_postings(tables.spread(tables.postings(spark, sf_dir)), DEFAULT)
    judged = eligibility.with_eligibility(routes.with_routes(scored))
    log = tables.feedback(spark, sf_dir)
    final = routes.final_status(judged, feedback.rejected_pairs(log), feedback.learned_words(log))
    return final.select("doc_id", "score", "band", "sponsorship", "permit_route", "eligibility", F.size("eligibility_reasons").alias("reasons"), "bpo")


@query(
    "SELECT n_name, count(*) AS n, count(DISTINCT left(c_name, 12)) AS names, max(c_acctbal) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) >= 2"
)
def having_counts(spark, sf_dir):
    """Counts, distinct counts and maxima by group, of groups of at least two."""
    rows = read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.left("c_name", F.lit(12))).alias("names"), F.max("c_acctbal").alias("top")
    ).where(F.col("n") >= 2)
