"""Scoring, life cycle, matching, views, discovery, sources and streams on small tables."""

import json

from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.operators import discovery, lifecycle, matching, scoring, view
from tidemark.sources import normalise, parse
from tidemark.sources.boards import BoardSource

POSTING = "title string, location string, description string, department string, employment_type string, permits int, sponsor_confidence string, sector string, entry_routes string"


def _score(spark, *rows):
    return scoring.score_postings(spark.createDataFrame(list(rows), POSTING), DEFAULT).collect()


def test_score_is_the_clamped_sum(spark):
    rows = _score(
        spark,
        ("Graduate Programme - Operations", "Dublin", "Excel and Power BI, KPI", "", "", 30, None, "insurance", "graduate programme"),
        ("Senior Java Developer", "Cork", "java developer, 6 years of experience", "", "", 0, "likely", None, None),
        ("Window Dresser", "Dublin, Ireland", "Excel power bi python sql tableau insurance insurance insurance full training hindi shift kpi sla quality deadline", "", "", 30, None, "banking", None),
        (None, None, None, None, None, None, None, None, None),
    )
    for r in rows:
        assert r["score"] == max(0, min(100, sum(b["points"] for b in r["breakdown"])))
    assert rows[0]["band"] == "excellent" and rows[1]["score"] == 0 and rows[1]["band"] == "weak"
    assert rows[2]["score"] == 48 and rows[2]["breakdown"][-1]["label"] == "Capped" and rows[3]["score"] == 0
    by = {b["label"]: b["points"] for b in rows[0]["breakdown"]}
    assert (by["Role fit"], by["Early careers"], by["Tools"], by["Sponsorship"], by["Industry"], by["Entry route"]) == (34, 20, 10, 10, 8, 6)


def test_early_career_family_is_halved(spark):
    plain, graduate = _score(
        spark, ("Treasury Clerk", "", "", "", "", None, None, None, None), ("Treasury Clerk", "", "graduate", "", "", None, None, None, None)
    )
    assert [r["breakdown"][0]["points"] for r in (plain, graduate)] == [15, 30]


def test_merge_close_reopen_and_age(spark):
    old = spark.createDataFrame(
        [("a", "x", "2024-01-01", "2024-01-05", False), ("b", "x", "2024-01-01", "2024-01-05", False), ("c", "y", "2024-01-01", "2024-01-05", False), ("d", "x", "2024-01-01", "2023-11-01", True)],
        "id string, company string, f string, l string, closed boolean",
    ).select("id", "company", F.to_timestamp("f").alias("first_seen"), F.to_timestamp("l").alias("last_seen"), "closed", F.lit(None).cast("timestamp").alias("closed_at"), F.lit(False).alias("is_new"))
    scan = spark.createDataFrame([("a", "x"), ("d", "x"), ("e", "x"), ("e", "x")], "id string, company string")
    now = F.lit("2024-01-10").cast("timestamp")
    merged = lifecycle.merge_scan(old, scan, scan.select("company"), now)
    rows = {r["id"]: r for r in merged.collect()}
    assert {k: v["closed"] for k, v in rows.items()} == {"a": False, "b": True, "c": False, "d": False, "e": False}
    assert rows["e"]["is_new"] and rows["b"]["closed_at"] is not None and rows["d"]["closed_at"] is None
    assert lifecycle.merge_scan(merged, scan.limit(0), scan.limit(0), now).where("closed").count() == 1
    aged = lifecycle.age_out(merged, F.lit("2024-02-22").cast("timestamp"))
    assert {r["id"] for r in aged.collect()} == {"a", "d", "e"}


def test_streaks_shards_and_caps(spark):
    scans = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 1, False), ("c", 2, True)], "name string, t int, ok boolean")
    rows = {r["name"]: r["fails"] for r in lifecycle.failure_streaks(scans.select("name", F.timestamp_seconds("t").alias("ts"), "ok", F.lit("e").alias("error"))).collect()}
    assert rows == {"a": 2, "b": 1, "c": 0}
    companies = spark.createDataFrame([(i, i == 3) for i in range(20)], "ordinal int, priority boolean")
    picked = [sorted(r["ordinal"] for r in lifecycle.pick_shard(companies, s).where("not priority").collect()) for s in range(8)]
    assert sorted(sum(picked, [])) == [i for i in range(20) if i != 3]
    new = spark.createDataFrame([("n1", 5), ("n2", 9), ("t", 99)], "name string, permits int")
    assert [r["name"] for r in lifecycle.growth_cap(new, spark.createDataFrame([("t",)], "name string"), 2).collect()] == ["n2"]
    assert lifecycle.growth_cap(new, new, 1).count() == 0


def _brute_fuzzy(companies, register):
    out = {}
    for k in companies:
        exact = [r for r in register if r[0] == k]
        near = [r for r in register if len(k) >= 6 and (r[0] in k or k in r[0])]
        if exact or near:
            out[k] = (exact or near)[0][0]
    return out


def test_fuzzy_permits_equals_all_pairs(spark):
    import random

    random.seed(3)
    word = lambda n: "".join(random.choice("ab") for _ in range(n))
    names = sorted({word(random.randint(3, 12)) for _ in range(150)})
    keys = list(dict.fromkeys(word(random.randint(2, 14)) for _ in range(150)))
    companies = spark.createDataFrame([(n, n) for n in names], "name string, key string")
    register = spark.createDataFrame([(k, 1, i) for i, k in enumerate(keys)], "key string, permits int, ordinal int")
    got = {r["name"]: r["matched"] for r in matching.fuzzy_permits(companies, register).collect()}
    assert got == _brute_fuzzy(names, [(k,) for k in keys])


def test_tracked_names(spark):
    make = lambda rows, extra="": spark.createDataFrame(rows, "name string, words array<string>" + extra)
    tracked = make([("Citi Ireland", ["citi", "bank"], 0), ("Bank of Ireland", ["bank", "boi"], 1), ("Brown Brothers Harriman", ["brown", "brothers", "harriman"], 2)], ", ordinal int")
    got = {r["name"]: r["tracked"] for r in matching.already_tracked(make([("Citi", ["citi"]), ("Brown & Brown", ["brown"]), ("None", []), ("Bank America", ["bank", "america"])]), tracked).collect()}
    assert got == {"Citi": "Citi Ireland"}


def test_lookup_takes_the_last_name_and_moves_are_followed(spark):
    postings = spark.createDataFrame([("a",), ("z",)], "company string")
    dim = spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "name string, permits int, ordinal int")
    assert {r["company"]: r["permits"] for r in matching.company_lookup(postings, dim).collect()} == {"a": 2, "z": None}
    state = spark.createDataFrame([("old", "A", "https://x.com/j/1?ref=q")], "job_id string, company string, url string")
    board = spark.createDataFrame([("new", "a", "https://y.com/j/1/", False), ("shut", "a", "https://x.com/j/1", True)], "id string, company string, url string, closed boolean")
    assert [tuple(r) for r in matching.follow_moved(state, board).collect()] == [("old", "new")]


def test_view(spark):
    board = spark.createDataFrame(
        [(1, "Davy analyst", "X", 60, 1, "eligible", False), (2, "Clerk", "Davy", 90, 20, "eligible", False), (3, "Clerk", "X", 95, 1, "blocked", False), (4, "Clerk", "X", 40, 0, "eligible", True), (5, "A davy", "X", 10, 0, "eligible", False), (6, "Applied", "X", 99, 0, "eligible", False)],
        "id int, title string, company string, score int, age int, eligibility string, closed boolean",
    ).select("*", F.expr("timestamp'2024-02-01' - make_interval(0, 0, 0, age)").alias("first_seen"), F.lit("Dublin").alias("location"), F.lit(False).alias("is_new"), F.lit(2).alias("sponsor_tier"))
    state = spark.createDataFrame([(6, "applied", False), (9, "saved", False)], "job_id int, status string, hidden boolean")
    now = F.lit("2024-02-01").cast("timestamp")
    ids = lambda **p: [r["id"] for r in view.board_view(board, state, view.ViewParams(**p), now).collect()]
    assert ids(sort="score") == [2, 1, 5] and ids() == [2, 1, 5] and ids(sort="new") == [5, 1, 2]
    assert ids(q="davy", sort="score") == [1, 5, 2] and ids(min_score=50, age_days=7) == [1] and ids(quick=("blocked",)) == [3]
    assert ids(tab="applied") == [6] and ids(page=2, page_size=2, sort="score") == [5] and ids(page=9) == ids(page=1)
    assert tuple(view.tab_counts(board, state).first()) == (3, 1, 0)
    tagged = board.where("id = 3").withColumn("tags", view.tags(now)).first()["tags"]
    assert tagged == ["blocked", "sponsor tier 2"]


def test_discovery(spark):
    pages = spark.createDataFrame(
        [("https://acme.com/careers", '<a href="https://boards.greenhouse.io/acme/jobs/1">x</a> <a href="/jobs/analyst-1">A</a><a href="/jobs/analyst-1">A</a><a href="/privacy/jobs/">p</a> https://apply.workable.com/acme2/'), ("https://jobs.lever.co/beta", None)],
        "url string, html string",
    )
    got = {(r["url"], r["ats"], r["token"]) for r in discovery.detect(pages).collect()}
    assert got == {("https://acme.com/careers", "greenhouse", "acme"), ("https://acme.com/careers", "workable", "acme2"), ("https://jobs.lever.co/beta", "lever", "beta")}
    links = [r["href"] for r in discovery.link_candidates(pages).orderBy("rank").collect()]
    assert links == ["https://boards.greenhouse.io/acme/jobs/1", "https://acme.com/jobs/analyst-1"]
    sheet = spark.createDataFrame([(0, ["Register 2024", ""]), (1, ["Employer Name", "Permits Issued"]), (2, ["Foo", "1,200"]), (3, ["Total", "9"]), (4, ["Bar", "x"])], "row int, cells array<string>")
    assert [tuple(r) for r in discovery.read_register(sheet).collect()] == [("Foo", 1200, 2)]
    current = spark.createDataFrame([("a", 3), ("b", 0)], "name string, home_jobs int")
    probes = spark.createDataFrame([("a", "lever", "x", 0, 3), ("b", "ashby", "y", 0, 2), ("b", "lever", "z", 1, 2)], "name string, ats string, token string, ordinal int, home_jobs int")
    assert [tuple(r) for r in discovery.upgrades(current, probes).collect()] == [("b", "ashby", "y", 2)]
    named = spark.createDataFrame([("Foo Bar Ltd",)], "n string").select(discovery.slug_variants(F.col("n"))).first()[0]
    assert named == ["foobar", "foo-bar", "foo_bar", "foo"]


PAGE = '<html><body><h1>Role</h1><script type="application/ld+json">%s</script></body></html>'
LD = {"@graph": [{"@type": "JobPosting", "title": "Analyst", "url": "https://c.com/1", "hiringOrganization": {"name": "Cee"}, "jobLocation": {"address": {"addressLocality": "Cork", "addressCountry": "IE"}}, "datePosted": "2024-01-02", "baseSalary": {"currency": "EUR", "value": {"minValue": 30000, "maxValue": 40000, "unitText": "YEAR"}}, "employmentType": ["FULL_TIME", "OTHER"]}]}
FLAT_JSON = {
    "taleo": {"requisitionList": [{"column": ["Analyst", "Cork"], "contestNo": "9", "postedDate": "2024-01-02"}]},
    "cornerstone": {"data": {"requisitions": [{"displayJobTitle": "Analyst", "locations": [{"city": "Cork"}], "requisitionId": 9}]}},
    "occupop": [{"job_title": "Analyst", "city": "Cork", "apply_url": "https://o.com/1"}],
    "hirehive": {"jobs": [{"title": "Analyst", "location": {"name": "Cork"}, "url": "https://h.com/1"}]},
    "eightfold": {"positions": [{"name": "Analyst", "location": "Cork", "canonicalPositionUrl": "https://e.com/1", "t_create": 1700000000}]},
    "jobvite": {"jobs": [{"title": "Analyst", "location": "Cork", "applyUrl": "https://j.com/1"}]},
    "bamboohr": {"result": [{"jobOpeningName": "Analyst", "location": {"city": "Cork"}, "id": 9}]},
    "rippling": [{"name": "Analyst", "workLocation": {"label": "Cork"}, "uuid": "u"}],
    "jibe": {"jobs": [{"data": {"title": "Analyst", "full_location": "Cork", "apply_url": "https://b.com/1"}}]},
    "amazonjobs": {"jobs": [{"title": "Analyst", "location": "Cork", "job_path": "/en/jobs/1", "posted_date": "January 2, 2024"}]},
    "sociablekit": {"jobs": [{"title": "Analyst", "location": "Cork", "url": "https://s.com/1"}]},
    "phenom": {"refineSearch": {"data": {"jobs": [{"title": "Analyst", "city": "Cork", "jobId": "9", "description": "long text", "descriptionTeaser": "x"}]}}},
}
RECORDED = {
    "greenhouse": ("acme", {"jobs": [{"title": "Job Title: Analyst", "absolute_url": "https://g.com/1", "location": {"name": "Cork"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": "2024-01-02T00:00:00Z", "departments": [{"name": "Ops"}]}]}),
    "lever": ("acme", [{"text": "Analyst", "hostedUrl": "https://l.com/1", "categories": {"location": "Cork", "team": "Ops"}, "createdAt": 1700000000000, "descriptionPlain": "Hi", "lists": [{"text": "Do", "content": "<li>x</li>"}]}]),
    "ashby": ("acme", {"jobs": [{"title": "Analyst", "jobUrl": "https://a.com/1", "location": "Cork", "descriptionHtml": "<p>Hi</p>"}]}),
    "workable": ("acme", {"jobs": [{"title": "Analyst", "url": "https://w.com/1", "city": "Cork", "country": "Ireland"}]}),
    "smartrecruiters": ("acme", {"content": [{"name": "Analyst", "id": "9", "location": {"city": "Cork", "country": "ie"}, "jobAd": {"sections": {"jobDescription": {"text": "<p>Hi</p>"}}}}]}),
    "recruitee": ("acme", {"offers": [{"title": "Analyst", "careers_url": "https://r.com/1", "city": "Cork"}]}),
    "workday": ("acme|5|jobs", {"jobPostings": [{"title": "Analyst", "externalPath": "/job/1", "locationsText": "Cork", "bulletFields": ["R1", "x"]}]}),
    "oraclecloud": ("o.com|CX", {"items": [{"requisitionList": [{"Title": "Analyst", "Id": "9", "PrimaryLocation": "Cork", "secondaryLocations": [{"Name": "Dublin"}]}]}]}),
    "pinpoint": ("acme", {"data": [{"attributes": {"title": "Analyst", "url": "https://p.com/1", "location": {"name": "Cork"}}}]}),
    "personio": ("acme", "<jobs><position><id>9</id><name>Analyst</name><office>Cork</office><jobDescriptions><jobDescription><name>A</name><value>&lt;p&gt;Hi&lt;/p&gt;</value></jobDescription></jobDescriptions></position></jobs>"),
    "rssfeed": ("https://f.com", '<?xml version="1.0"?><rss xmlns:a="u"><channel><item><title>Analyst</title><link>https://f.com/1</link><a:location>Cork</a:location><description>Hi</description></item></channel></rss>'),
    "successfactors": ("https://sf.com", "<rss><channel><item><title>Analyst</title><link>https://sf.com/1</link><location>Cork</location></item></channel></rss>"),
    "jsonld": ("https://c.com", PAGE % json.dumps(LD)), "joblinks": ("https://c.com/jobs/analyst-cork", PAGE % json.dumps(LD)),
    "sitemap": ("https://c.com/jobs/fund-analyst-cork", "<html><body><h1>Analyst</h1><p>Hi</p></body></html>"), "candidatemanager": ("https://c.com/x", PAGE % json.dumps(LD["@graph"][0])),
    "apiprobe": ("https://c.com", {"x": {"rows": [{"jobTitle": "Analyst", "applyUrl": "https://c.com/1", "city": "Cork"}, {"jobTitle": "Clerk", "applyUrl": "https://c.com/2"}]}}),
    "icims": ("https://i.com", '<a class="x" href="https://i.com/jobs/12/analyst/job">Analyst</a><a href="https://i.com/jobs/12/analyst/job">again</a>'),
    "avature": ("https://v.com", '<a href="/careers/JobDetail/1">Analyst</a>'), "teamtailor": ("https://t.com", '<a href="https://t.com/jobs/1-analyst"><b>Analyst</b></a>'),
    "talentbrew": ("https://b.com", '<li><a href="/job/cork/1">Analyst</a></li>'), **{ats: ("acme", body) for ats, body in FLAT_JSON.items()},
}


def test_every_platform_reads_and_maps(spark):
    rows = [(ats, token, "Acme", body if isinstance(body, str) else json.dumps(body), i) for i, (ats, (token, body)) in enumerate(RECORDED.items())]
    assert set(RECORDED) == set(parse.PARSERS) == set(normalise.MAPPERS) and len(RECORDED) == 33
    rows += [("lever", "broken", "B", "{not json", 90), ("lever", "down", "D", None, 91)]
    boards = spark.createDataFrame(rows, "ats string, token string, company string, raw string, ordinal long")
    got = {}
    for r in sorted(normalise.postings(boards).collect(), key=lambda r: r["ordinal"]):
        got.setdefault(r["ats"], []).append(r)
    assert set(got) == set(RECORDED)
    for ats, found in got.items():
        assert found[0]["title"] == "Analyst" and found[0]["url"].startswith("https://"), ats
        assert len(found) == (2 if ats == "apiprobe" else 1), ats
    assert got["greenhouse"][0]["posted_at"] == "2024-01-02T00:00:00+00:00" and got["jsonld"][0]["company"] == "Cee"
    assert got["jsonld"][0]["salary"] == "€30,000–€40,000/yr" and got["jsonld"][0]["employment_type"] == "FULL_TIME, OTHER"
    assert got["workday"][0]["url"] == "https://acme.wd5.myworkdayjobs.com/en-US/jobs/job/1" and got["phenom"][0]["description"] == "long text"
    assert got["oraclecloud"][0]["location"] == "Cork, Dublin" and got["personio"][0]["description"].endswith("Hi")


def test_board_source(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"jobs": [{"title": "A"}]}))
    spark.dataSource.register(BoardSource)
    boards = [{"ats": "ashby", "token": "t", "company": "C", "url": f"file://{tmp_path}/b.json"}, {"ats": "ashby", "token": "u", "company": "D", "url": f"file://{tmp_path}/none.json"}]
    rows = spark.read.format("boards").option("boards", json.dumps(boards)).option("pause_s", "0").load().orderBy("ordinal").collect()
    assert rows[0]["error"] is None and json.loads(rows[0]["raw"])["jobs"] and rows[1]["raw"] is None and "FetchError" in rows[1]["error"]


def test_large_responses_stay_whole_and_broken_ones_are_errors(spark, tmp_path):
    (tmp_path / "large.json").write_text(json.dumps({"jobs": [{"title": f"A{i}", "description": "x" * 70_000} for i in range(100)]}))
    (tmp_path / "cut.json").write_text('{"jobs": [{"title": "A"')
    (tmp_path / "cut.xml").write_text("<workzag-jobs><position><name>A</name></position>")
    spark.dataSource.register(BoardSource)
    boards = [{"ats": a, "token": f, "company": f, "url": f"file://{tmp_path}/{f}"} for a, f in (("ashby", "large.json"), ("ashby", "cut.json"), ("personio", "cut.xml"))]
    rows = spark.read.format("boards").option("boards", json.dumps(boards)).option("pause_s", "0").load().orderBy("ordinal").collect()
    assert rows[0]["error"] is None and len(json.loads(rows[0]["raw"])["jobs"]) == 100
    assert all(r["raw"] is None and "does not parse" in r["error"] for r in rows[1:])


def test_an_employer_with_a_lost_page_is_not_scanned(spark):
    from tidemark.plans.scan_run import answered

    boards = spark.createDataFrame([("A", None), ("A", "FetchError"), ("B", None), ("B", None), ("C", "FetchError")], "company string, error string")
    assert [r["company"] for r in answered(boards).collect()] == ["B"]


def test_listing_helpers(spark):
    sitemap = spark.createDataFrame([("t", "<urlset>" + "".join(f"<url><loc>https://x.com/jobs/{i}</loc></url>" for i in range(60)) + "<loc>https://x.com/about</loc></urlset>")], "token string, raw string")
    urls = parse.sitemap_urls(sitemap).orderBy("rank").collect()
    assert len(urls) == 45 and urls[-1]["url"].endswith("/59")
    searches = spark.createDataFrame([("t", "a", 0, '{"p":"1"}'), ("t", "b", 1, '{"p":"1"}'), ("t", "", 2, '{"p":"2"}'), ("u", "", 3, '{"p":"3"}')], "token string, search string, ordinal int, j string").withColumn("raw", F.parse_json("j"))
    assert sorted((r["token"], r["key"]) for r in parse.keyword_union(searches, "$.p").collect()) == [("t", "1"), ("u", "3")]
    listed = spark.createDataFrame([("t", str(i), i, "teaser") for i in range(3)], "token string, id string, ordinal int, description string")
    details = spark.createDataFrame([("t", "0", "full"), ("t", "2", "full")], "token string, id string, description string")
    assert {r["id"]: r["description"] for r in parse.with_details(listed, details, most=2).collect()} == {"0": "full", "1": "teaser", "2": "teaser"}


def test_sights_over_restarts_and_expiry(spark, tmp_path):
    """State goes on where the last run ended, expires after 45 days, and late sights count not."""
    from tidemark.streaming import lifecycle as stream

    day = 86_400

    def arrive(name, *rows):
        frame = spark.createDataFrame([(i, t) for i, t in rows], "id string, t long").select("id", F.timestamp_seconds("t").alias("ts"))
        frame.coalesce(1).write.parquet(str(tmp_path / "events" / name))

    def run():
        events = spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / "events/*"))
        stream.run_seen(events, str(tmp_path / "state"))
        rows = stream.seen_table(spark, str(tmp_path / "state")).select("id", F.unix_seconds("first_seen"), F.unix_seconds("last_seen"), "n").collect()
        return {r[0]: tuple(r)[1:] for r in rows}

    arrive("a", *[("hot", k) for k in range(500)], ("old", 10), ("none", None), (None, 5))
    assert run() == {"hot": (0, 499, 500), "old": (10, 10, 1)}
    arrive("b", ("hot", 40 * day), ("new", 30 * day), ("old", 5))
    assert run() == {"hot": (0, 40 * day, 501), "old": (5, 10, 2), "new": (30 * day, 30 * day, 1)}
    arrive("c", ("hot", 46 * day))
    assert run() == {"hot": (0, 46 * day, 502), "new": (30 * day, 30 * day, 1)}  # old is gone
    arrive("d", ("old", 15), ("new", 29 * day))
    assert run() == {"hot": (0, 46 * day, 502), "new": (29 * day, 30 * day, 2)}  # too late for old


def test_boards_close_open_and_age(spark, tmp_path):
    """Scans one after another against the batch operator's rules; one employer over several slices."""
    from tidemark.streaming import lifecycle as stream

    day, many = 86_400, [f"p{k}" for k in range(40)]
    scans = [
        (1 * day, {"x": many, "y": ["q"]}), (2 * day, {"x": many[:30]}), (3 * day, {"x": many[20:] + ["new"], "y": []}),
        (20 * day, {"z": ["alone"]}), (49 * day, {"x": ["new"]}),
    ]
    board: dict = {}

    def expected(at, shown):
        for company, ids in shown.items():
            for i in ids:
                board[i] = (company, board[i][1] if i in board else at, at, False, None)
            for i, (c, first, last, closed, _) in list(board.items()):
                if c == company and i not in ids and not closed:
                    board[i] = (c, first, last, True, at)
            for i in [i for i, v in board.items() if v[0] == company and at - v[2] > 45 * day]:
                del board[i]

    for k, (at, shown) in enumerate(scans):
        rows = [(i, c, at) for c, ids in shown.items() for i in (ids or [None])]
        frame = spark.createDataFrame(rows, "id string, company string, t long").select("id", "company", F.timestamp_seconds("t").alias("scanned_at"))
        frame.coalesce(1).write.parquet(str(tmp_path / "scans" / f"s{k}"))
        expected(at, shown)
        if k != 1:  # two scans arrive at once
            source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "scans/*"))
            stream.run_boards(source, str(tmp_path / "state"), slices=4)
            got = stream.board_table(spark, str(tmp_path / "state")).collect()
            seconds = lambda t: None if t is None else int(t.timestamp())
            assert {r["id"]: (r["company"], seconds(r["first_seen"]), seconds(r["last_seen"]), r["closed"], seconds(r["closed_at"])) for r in got} == board
    assert set(board) == {"q", "alone", "new"} and board["q"][3]


def test_window_counts(spark):
    from tidemark.streaming import lifecycle as stream

    events = spark.range(20).select(F.lit("v").alias("event_type"), F.timestamp_seconds("id").alias("ts"))
    assert stream.watched_counts(events).count() == 1


def test_sinks(spark, tmp_path):
    from tidemark.sources import sinks

    key = sinks.derive_key("phrase", b"salt", 10)
    row = spark.createDataFrame([("secret é",), (None,)], "t string").withColumn("s", sinks.seal(F.col("t"), key, b"MG01"))
    opened = row.select(sinks.unseal(F.col("s"), key, b"MG01").alias("a"), sinks.unseal(F.col("s"), b"x" * 32, b"MG01").alias("b"), sinks.unseal(F.col("s"), key, b"MG02").alias("c")).collect()
    assert [tuple(r) for r in opened] == [("secret é", None, None), ("", None, None)]
    board = spark.createDataFrame([("1", "T", "weak", True, False), ("2", "U", "strong", False, None)], "id string, title string, band string, is_new boolean, closed boolean")
    drops = spark.createDataFrame([("senior role", 3)], "drop_reason string, n long")
    health = spark.createDataFrame([("a", 2, "e"), ("b", 0, None)], "name string, fails long, last_error string")
    stats = sinks.run_stats(board, drops, health)
    got = stats.first()
    assert (got["postings"], got["new"], got["closed"], got["by_band"], got["by_reason"]) == (2, 1, 0, {"weak": 1, "strong": 1}, {"senior role": 3})
    assert got["errors"][0]["name"] == "a" and "2 postings" in sinks.summary(stats).first()["text"]
    sinks.write_board(board, str(tmp_path / "board"))
    assert spark.read.json(str(tmp_path / "board/json")).count() == 2
    state = spark.createDataFrame([("1", "applied", "2024-01-01", None, ("old", "X")), ("9", "applied", "2024-01-02", "n", ("gone", "Y"))], "job_id string, status string, applied_at string, note string, snapshot struct<title: string, company: string>")
    listed = sinks.applications(state, board).collect()
    assert [(r["job_id"], r["title"], r["company"]) for r in listed] == [("9", "gone", "Y"), ("1", "T", "X")] and len(listed[0]) == 22
    sinks.write_applications(state, board, str(tmp_path / "list"))
    assert spark.read.option("header", True).csv(str(tmp_path / "list")).count() == 2


def test_queries_equal_their_sql(spark, sf_dir):
    """Every query with SQL against DuckDB, on the smallest tables."""
    import duckdb

    from tidemark.plans import catalogue

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in ("nation", "customer", "supplier", "part", "orders", "events", "documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")

    def plain(v):
        return f"{v:.4f}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)

    for name, sql in catalogue.ORACLES.items():
        made = catalogue.QUERIES[name](spark, sf_dir)
        columns = sorted(made.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == columns, name
        a = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
        b = sorted(tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
        assert a == b, name


def test_scan_run(spark, tmp_path):
    """Two scans of two boards: what comes, closes, opens again, is dropped and is blocked."""
    from tidemark.plans.scan_run import KEPT, LIFE, in_order, scan_run

    def board(company, jobs, error=None):
        rows = [{"title": t, "absolute_url": f"https://{company}.com/jobs/{i}", "location": {"name": place}, "content": text} for i, t, place, text in jobs]
        return ("greenhouse", company, company, None if error else json.dumps({"jobs": rows}), error)

    first = [
        board("acme", [(1, "Claims Handler", "Dublin", "Excel"), (2, "Senior Claims Handler", "Dublin", ""), (3, "Claims Analyst - Slovak", "Cork", ""), (4, "Claims Handler", "Dublin", "again"), (5, "Clerk", "Paris", "")]),
        board("beta", [(1, "Operations Analyst", "Cork", "Minimum 4 years of experience required.")]),
    ]
    second = [board("acme", [(1, "Claims Handler", "Dublin", "Excel, KPI")]), board("beta", [], "timeout")]
    third = [board("acme", []), board("beta", [(1, "Operations Analyst", "Cork", "")])]
    companies = spark.createDataFrame([("acme", 0, 30, None, "insurance", None, 5, None)], "name string, ordinal int, permits int, sponsor_confidence string, sector string, entry_routes string, fit_rank int, website string")
    log = spark.createDataFrame([], "kind string, id string, title string, company string, reason string")
    stored = spark.createDataFrame([], "id string, title string, company string, location string, url string, description string, posted_at string, source string, department string, employment_type string, closes_at string, salary string, ordinal long, first_seen timestamp, last_seen timestamp, closed boolean, closed_at timestamp, is_new boolean")
    seen = []
    for day, scan in enumerate((first, second, third), 1):
        boards = spark.createDataFrame(scan, "ats string, token string, company string, raw string, error string").withColumn("ordinal", F.monotonically_increasing_id())

        def cut(df, day=day, n=[0]):
            n[0] += 1
            df.write.mode("overwrite").parquet(str(tmp_path / f"{day}-{n[0]}"))
            return spark.read.parquet(str(tmp_path / f"{day}-{n[0]}"))

        result = scan_run(boards, companies, stored, log, DEFAULT, F.lit(f"2024-01-0{day}").cast("timestamp"), only=["greenhouse"], cut=cut)
        out = cut(in_order(result.board))
        stored = out.withColumn("closes_at", F.col("closes_at").cast("string")).select(*KEPT, *LIFE)
        seen.append({(r["company"], r["title"]): r for r in out.collect()})
        drops = {r["drop_reason"]: r["n"] for r in result.drops.collect()}
        if day == 1:
            assert drops == {"senior role": 1, "elsewhere": 1}
    one, two, three = seen
    key, other = ("acme", "Claims Handler"), ("beta", "Operations Analyst")
    assert set(one) == {key, other} and one[key]["is_new"] and one[key]["sponsor_tier"] == 3 and one[key]["crack_it"]["family"] == "claims"
    assert one[other]["eligibility"] == "blocked" and one[other]["years"] == 4
    assert not two[key]["closed"] and not two[other]["closed"] and two[key]["score"] > one[key]["score"] and two[key]["first_seen"] == one[key]["first_seen"]
    assert three[key]["closed"] and not three[other]["closed"] and three[other]["eligibility"] != "blocked"


def test_today_marks_and_prospects(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    at = lambda c: F.to_timestamp(c)
    board = spark.createDataFrame([(80, "2024-01-24", False), (80, "2024-01-31", False), (80, "2024-01-24", True), (10, "2024-01-24", False)], "score int, f string, closed boolean").withColumn("first_seen", at("f"))
    state = spark.createDataFrame([("a", "applied", "2024-01-01", None, None), ("b", "applied", "2024-01-31", None, None), ("c", None, None, True, "2024-01-01"), ("d", None, None, True, "2024-01-31")], "job_id string, status string, a string, hidden boolean, h string").withColumns({"applied_at": at("a"), "hidden_at": at("h")})
    assert tuple(view.today(board, state, now).first()) == (1, 1)
    assert sorted(r["job_id"] for r in view.live_marks(state, now).collect()) == ["a", "b", "d"]
    register = spark.createDataFrame([("a", "likely", 9), ("b", "documented", None), ("c", None, 1), ("d", "documented", 99)], "name string, sponsor_confidence string, fit_rank int")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r["name"] for r in discovery.prospects(register, names("d", "c"), names("c"), 2).collect()] == ["b", "a"]


# --- pages ------------------------------------------------------------------


class _Boards:
    """A local server of boards: pages by address; what it was asked is written down."""

    def __init__(self, answer):
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from urllib.parse import parse_qs, urlsplit

        asked = self.asked = []

        class Handler(BaseHTTPRequestHandler):
            def _tell(self, body):
                at = urlsplit(self.path)
                asked.append((self.path, body))
                said = answer(at.path, {k: v[0] for k, v in parse_qs(at.query).items()}, body)
                self.send_response(200 if said is not None else 404)
                self.end_headers()
                self.wfile.write((said or "").encode())

            def do_GET(self):
                self._tell(None)

            def do_POST(self):
                self._tell(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.root = f"http://127.0.0.1:{self.server.server_address[1]}"


def _answer(path, query, body):
    """Listings of all kinds of ends."""
    many = lambda n, at, size, row: [row(k) for k in range(at, min(n, at + size))]
    if "/companies/acme/" in path:
        return json.dumps({"content": many(230, int(query["offset"]), 100, lambda k: {"id": str(k), "name": f"Clerk {k}"})})
    if "/companies/broken/" in path:
        return json.dumps({"content": [{"id": str(k)} for k in range(100)]}) if query["offset"] == "0" else '{"content": [{"id"'
    if "/wday/" in path:
        held = {"Ireland": range(25), "Dublin": range(20, 50), "": range(100)} if "/Site" in path else {"": range(41)}
        rows = [{"externalPath": f"/job/{k}", "title": f"T{k}"} for k in held.get(body["searchText"], ())]
        return json.dumps({"total": 0, "jobPostings": rows[body["offset"] : body["offset"] + body["limit"]]})
    if "recruitingCE" in path:
        at = int(query["finder"].split("offset=")[1].split(",")[0])
        return json.dumps({"items": [{"TotalJobsCount": 400, "requisitionList": many(400, at, 200, lambda k: {"Id": k, "Title": f"R{k}"})}]})
    if path == "/jobs/search":
        return "".join(f'<a class="x" href="/jobs/{k}/clerk">Clerk {k}</a>' for k in range(int(query["pr"]) * 10, min(14, int(query["pr"]) * 10 + 10)))
    if path == "/api/jobs":
        page = int(query["page"])  # the last page comes again and again
        return json.dumps({"jobs": [{"data": {"slug": f"s{k}", "title": "J"}} for k in range(min(page, 3) * 5, min(page, 3) * 5 + 5)]})
    if path == "/en/search.json":
        n = {"IRL": 150, "GBR": 100}[query["country"]]
        return json.dumps({"hits": n, "jobs": many(n, int(query["offset"]), 100, lambda k: {"id_icims": str(k), "title": "A"})})
    if path.startswith("/widgets") and query["domain"] == "careers.firm.com":
        at = int(query["start"])  # pages of seven, whatever was asked for
        return json.dumps({"jobs": many(18, at, 7, lambda k: {"jobId": str(k), "title": "P"})})
    return json.dumps({"jobs": []}) if path.startswith("/api/apply") and "sortBy" not in query else None


BOARDS = [
    ("smartrecruiters", "acme"), ("smartrecruiters", "broken"), ("workday", "t|wd3|Site"), ("workday", "t|3|Other"), ("oraclecloud", "h.example|CX"), ("icims", "x.icims.com"),
    ("jibe", "jobs.example|Ireland"), ("amazonjobs", "IRL"), ("amazonjobs", "GBR"), ("phenom", "careers.firm.com"), ("workday", "no parts"),
]


def test_pages_are_read_whole(spark):
    """Every page of every kind of listing, and none beyond its end; recorded ones are followed alike."""
    from tidemark.sources import paging

    served = _Boards(_answer)
    spark.dataSource.register(BoardSource)
    boards = [{"ats": a, "token": t, "company": f"{a}-{t}", "root": served.root} for a, t in BOARDS]
    read = spark.read.format("boards").option("boards", json.dumps(boards)).option("pause_s", "0").option("tasks", "3").load().cache()
    rows = read.orderBy("ordinal").collect()
    got = {}
    for r in rows:
        got.setdefault((r["ats"], r["token"]), []).append((r["search"], r["page"], None if r["raw"] is None else len(paging.rows_of(r["ats"], r["raw"]))))
    assert got["smartrecruiters", "acme"] == [("", 0, 100), ("", 1, 100), ("", 2, 30)]
    assert got["smartrecruiters", "broken"] == [("", 0, 100), ("", 1, None)]
    assert got["workday", "t|wd3|Site"] == [("Ireland", 0, 20), ("Ireland", 1, 5), ("Dublin", 0, 20), ("Dublin", 1, 10), ("Cork", 0, 0), ("Galway", 0, 0), ("Limerick", 0, 0)]
    assert got["workday", "t|3|Other"][-3:] == [("", 0, 20), ("", 1, 20), ("", 2, 1)]
    assert got["oraclecloud", "h.example|CX"] == [("", 0, 200), ("", 1, 200)] and got["icims", "x.icims.com"] == [("", 0, 10), ("", 1, 4)]
    assert got["jibe", "jobs.example|Ireland"] == [("", k, 5) for k in range(4)]
    assert got["amazonjobs", "IRL"] == [("", 0, 100), ("", 1, 50)] and got["amazonjobs", "GBR"] == [("", 0, 100)]
    assert got["phenom", "careers.firm.com"] == [("", 0, 7), ("", 1, 7), ("", 2, 4), ("", 3, 0)]
    assert got["workday", "no parts"] == [("", 0, None)] and len({r["ordinal"] for r in rows}) == len(rows)
    found = normalise.postings(paging.united(read), ["workday", "smartrecruiters", "jibe", "amazonjobs"])
    counted = {(r["ats"], r["token"]): r["count"] for r in found.groupBy("ats", "token").count().collect()}
    assert counted["workday", "t|wd3|Site"] == 50 and counted["workday", "t|3|Other"] == 41 and counted["jibe", "jobs.example|Ireland"] == 15 and counted["smartrecruiters", "acme"] == 230
    # Recorded beyond the ends, and with a gap: the same pages count.
    more = read.where("raw is not null").withColumn("page", F.col("page") + 5).unionByName(read)
    for ats in {a for a, _ in BOARDS}:
        own = sorted((r["token"], r["search"], r["page"]) for r in read.where(F.col("ats") == ats).collect())
        again = sorted((r["token"], r["search"], r["page"]) for r in paging.followed(more, ats).collect())
        if ats == "workday":  # words that find nothing were asked; the search without one is asked for only then
            own = [x for x in own if x[0] != "no parts"] + [x for x in own if x[0] == "no parts"]
        assert sorted(again) == sorted(own), ats
    read.unpersist()


def test_filters_keep_boards_from_being_asked(spark):
    from tidemark.sources.boards import read as read_boards

    served = _Boards(_answer)
    boards = [{"ats": "amazonjobs", "token": c, "company": "A", "root": served.root} for c in ("IRL", "GBR")]
    boards += [{"ats": "ashby", "token": f"t{k}", "company": f"C{k}", "url": f"http://h{k}.invalid/"} for k in range(50)]
    read = read_boards(spark, boards, pause_s="0", tasks="1000")
    assert read.rdd.getNumPartitions() == 51
    home = read.where("ats = 'amazonjobs' and country = 'IRL' and page >= 0")
    assert home.rdd.getNumPartitions() == 1 and home.count() == 2 and {p.split("country=")[1][:3] for p, _ in served.asked} == {"IRL"}
    assert read.where(F.col("company").isin("C1", "C7")).rdd.getNumPartitions() == 2 and read.where("ats = 'lever'").count() == 0


def _as_its_sql(query, spark, folder, table):
    """A query's rows over a folder of one table, and those of its SQL, both in order."""
    import duckdb

    from tidemark.plans import built, catalogue

    assert built
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.QUERIES[query](spark, str(folder)).collect())), sorted(con.sql(catalogue.ORACLES[query]).fetchall())


def _searched_beyond(spark, folder):
    """A board of which two searches find more than the 3,000 postings that they are asked for."""
    spark.range(10_500).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey")).write.parquet(f"{folder}/orders.parquet")


def test_details_of_searches_beyond_their_last_page(spark, tmp_path):
    _searched_beyond(spark, tmp_path)
    got, want = _as_its_sql("scan_details", spark, tmp_path, "orders")
    assert got == want and sum(r[0] == "workday" for r in got) == 6000


def test_pages_of_searches_beyond_their_last_page(spark, tmp_path):
    _searched_beyond(spark, tmp_path)
    got, want = _as_its_sql("scan_paged", spark, tmp_path, "orders")
    assert got == want and len({r[2] for r in got if r[0] == "workday"}) == 6000


def test_a_board_whose_words_find_nothing_lists_nothing(spark, tmp_path):
    """The search without a word is not asked in the place of words that should have found something; keys of any sign."""
    keys = [(3 * k + 2, 2) for k in range(90)] + [(-k - 1, -6) for k in range(90)] + [(3 * k + 1, 1) for k in range(90)] + [(3 * k, 4) for k in range(90)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = _as_its_sql("scan_paged", spark, tmp_path, "orders")
    assert got == want and {r[1] for r in got if r[0] == "workday"} == {f"t{n}|3|S" for n in (-6, 1, 4)}


def test_a_known_sight_costs_a_read_and_a_write():
    """No timer is listed, dropped or set for a posting that has one; the timer goes on when it is due."""
    from tidemark.streaming import lifecycle as stream

    class Store:
        def __init__(self):
            self.value, self.timers, self.calls = None, [], []

        def getValueState(self, name, schema):
            return self

        def __getattr__(self, name):
            def call(*given):
                self.calls.append(name)
                if name in ("update", "clear"):
                    self.value = given[0] if given else None
                if name == "registerTimer":
                    self.timers.append(given[0])
                return self.value if name == "get" else None

            return call

    class Clock:
        getCurrentWatermarkInMs = staticmethod(lambda: 5)

    store, sights = Store(), stream.Sights()
    sights.init(store)
    see = lambda us: [tuple(r) for r in sights.handleInputRows(("a",), iter([{"first_us": us, "last_us": us, "n": 1}]), None)]
    assert see(4000) == [("a", 4000, 4000, 1)] and store.timers == [5]
    store.calls.clear()
    assert see(9000) == [("a", 4000, 9000, 2)] and store.calls == ["get", "update"]
    list(sights.handleExpiredTimer(("a",), Clock, None))
    assert store.timers == [5, 10] and store.value == (4000, 9000, 2)
    Clock.getCurrentWatermarkInMs = staticmethod(lambda: 10)
    list(sights.handleExpiredTimer(("a",), Clock, None))
    assert store.value is None
