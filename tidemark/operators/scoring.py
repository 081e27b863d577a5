"""Scoring with an auditable breakdown, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import BANDS, CONFIDENCE_POINTS, PERMIT_STEPS, Profile
from tidemark.functions.text import hits, occurrences, text, words_of

YEARS = r"(\d{1,2})\s*(?:\+|plus)?\s*years?'?\s*(?:of\s+)?(?:\w+\s+){0,3}experience"
INTAKE_YEAR = r"(^|[^0-9])20(2[5-9]|3[0-5])([^0-9]|$)"


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", *[text(F.col(c)) for c in ("title", "description", "department", "employment_type")]))


def _row(label: str, points: Column, note: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), points.cast("int").alias("points"), note.alias("note"))


def _first(found: Column) -> Column:
    return F.coalesce(F.get(found, 0), F.lit(""))


def score_postings(postings: DataFrame, profile: Profile) -> DataFrame:
    """postings with score int, band string and breakdown array<struct<label, points, note>>.

    postings: title, location, description, department, employment_type; and of the
    employer permits, sponsor_confidence, sector, entry_routes, all of which may be null.
    The hits of each vocabulary are computed once in a step of their own.
    """
    own = postings.columns
    title, place = F.lower(text(F.col("title"))), F.lower(text(F.col("location")))
    vocabularies = {
        "graduate": (profile.graduate_terms, "_text"), "core": (profile.tools_core, "_text"), "taught": (profile.tools_taught, "_text"),
        "certified": (profile.tools_certified, "_text"), "work": (profile.work_terms, "_text"), "training": (profile.training_terms, "_text"),
        "domain_title": (profile.domain_terms, "_title"), "domain_sector": (profile.domain_terms, "_sector"), "domain_text": (profile.domain_terms, "_text"),
        "language": (profile.language_terms, "_text"), "shift": (profile.shift_terms, "_text"), "hard": (profile.hard_skills, "_text"),
        "soft": (profile.soft_skills, "_text"), "senior": (profile.senior_terms, "_title"),
    }
    base = postings.select(
        *own, title.alias("_title"), place.alias("_place"), haystack().alias("_text"), F.lower(text(F.col("sector"))).alias("_sector")
    )
    # Each text is cut into words once, of which only the profile's own go on.
    known = sorted({t.lower() for terms, _ in vocabularies.values() for t in terms} | {t.lower() for f in profile.families for t in f.terms})
    base = base.select("*", *[words_of(F.col(c), known).alias(f"{c}_words") for c in ("_title", "_text", "_sector")])
    years = F.array_max(F.transform(F.regexp_extract_all(F.lower(text(F.col("description"))), F.lit(YEARS), F.lit(1)), lambda y: y.cast("int")))
    years = F.when(F.contains(F.col("_text"), F.lit("experience")), years)
    family_hits = [hits(F.col("_title"), f.terms, F.col("_title_words")).alias(f"_family{i}") for i, f in enumerate(profile.families)]
    wide = base.select(
        "*", years.alias("_years"), *family_hits, *[hits(F.col(c), terms, F.col(f"{c}_words")).alias(f"_{name}") for name, (terms, c) in vocabularies.items()]
    )
    n = lambda name: F.size(F.col(f"_{name}"))
    weight = [
        F.when(
            F.size(f"_family{i}") > 0,
            F.when(n("graduate") == 0, F.lit(f.weight // 2)).otherwise(F.lit(f.weight)) if f.early_career else F.lit(f.weight),
        ).otherwise(F.lit(0))
        for i, f in enumerate(profile.families)
    ]
    # Of equal weights the first family stands; a family needs hits.
    best = F.greatest(F.lit(0), F.lit(0), *weight)
    which = F.coalesce(*[F.when((w == best) & (w > 0), F.lit(i)) for i, w in enumerate(weight)])
    wide = wide.select("*", best.alias("_weight"), which.alias("_which"))
    family = F.coalesce(*[F.when(F.col("_which") == i, F.lit(f.name)) for i, f in enumerate(profile.families)], F.lit(""))
    family_note = F.coalesce(*[F.when(F.col("_which") == i, F.get(f"_family{i}", 0)) for i in range(len(profile.families))], F.lit(""))
    has_family, senior = F.col("_which").isNotNull(), n("senior") > 0
    strong = F.arrays_overlap(F.col("_graduate"), F.array(*map(F.lit, profile.strong_graduate_terms)))
    intake = F.col("_title").rlike(INTAKE_YEAR) & ~senior
    entry = (strong | F.col("_title").rlike(INTAKE_YEAR)) & ~senior
    tools = F.least(F.lit(18), n("core") * 5 + n("taught") * 3 + n("certified"))
    repeated = F.coalesce(*[F.when(F.array_contains("_domain_text", t.lower()) & (occurrences(F.col("_text"), t.lower()) >= 3), F.lit(t)) for t in profile.domain_terms], F.lit(None).cast("string"))
    points_of_place = [F.when(F.contains(F.col("_place"), F.lit(k)) | F.contains(F.col("_text"), F.lit(k)), F.lit(v)).otherwise(0) for k, v in profile.locations]
    location = F.greatest(F.lit(0), F.lit(0), *points_of_place)
    permits = F.coalesce(F.col("permits"), F.lit(0))
    sponsor = F.lit(None).cast("int")
    for least, points, _ in reversed(PERMIT_STEPS):
        sponsor = F.when(permits >= least, F.lit(points)).otherwise(sponsor)
    confidence = F.lit(0)
    for said, points in CONFIDENCE_POINTS.items():
        confidence = F.when(text(F.col("sponsor_confidence")) == said, F.lit(points)).otherwise(confidence)
    routes = F.filter(
        F.transform(F.split(F.lower(text(F.col("entry_routes"))), "[,;/]"), lambda t: F.trim(t)), lambda t: F.length(t).between(4, 39)
    )
    wide = wide.select("*", routes.alias("_routes"))
    route = F.filter(F.col("_routes"), lambda t: F.contains(F.col("_text"), t))
    foreign = F.lit(False)
    for language in profile.foreign_languages:
        foreign = foreign | F.contains(F.col("_text"), F.lit(language)) & F.col("_text").rlike(rf"(fluent|fluency|native|proficient)\W+(\w+\W+){{0,3}}{language}\b|\b{language}[\s-]+(speaking|speaker|language)")
    y = F.col("_years")
    p0, p2, p3, p4, p5 = profile.years_penalties
    years_penalty = F.when(y <= 1, p0).when(y == 2, p2).when(y == 3, p3).when(y == 4, p4).when(y >= 5, p5).otherwise(0)

    rows = [
        _row("Role fit", F.col("_weight"), F.when(has_family, F.concat(family, F.lit(": "), family_note)).otherwise("no family in the title")),
        F.when(n("graduate") > 0, _row("Early careers", F.when(strong, 20).otherwise(12), _first(F.col("_graduate"))))
        .when(intake, _row("Early careers", F.lit(16), F.lit("intake year")))
        .when(has_family & ~senior, _row("Early careers", F.lit(9), F.lit("no senior marker")))
        .otherwise(_row("Early careers", F.lit(0), F.lit(""))),
        _row("Tools", tools, F.array_join(F.concat("_core", "_taught", "_certified"), ", ")),
        F.when(n("work") > 0, _row("Ways of working", F.least(F.lit(profile.work_cap), n("work")), F.array_join("_work", ", "))),
        F.when(n("training") > 0, _row("Training", F.lit(profile.training_bonus), _first(F.col("_training")))),
        F.when(n("domain_title") > 0, _row("Industry", F.lit(profile.domain_bonus), _first(F.col("_domain_title"))))
        .when(n("domain_sector") > 0, _row("Industry", F.lit(profile.domain_bonus - 2), _first(F.col("_domain_sector"))))
        .when(repeated.isNotNull(), _row("Industry", F.lit(4), repeated))
        .otherwise(_row("Industry", F.lit(0), F.lit(""))),
        _row("Location", location, F.lit("")),
        _row("Sponsorship", F.coalesce(sponsor, confidence), permits.cast("string")),
        F.when(F.size(route) > 0, _row("Entry route", F.lit(6), _first(route))),
        F.when(n("language") > 0, _row("Language edge", F.lit(profile.language_bonus), _first(F.col("_language")))),
        F.when(n("shift") > 0, _row("Shift work", F.lit(profile.shift_bonus), F.lit(""))),
        F.when(n("hard") > 0, _row("Missing skill", F.lit(-20), _first(F.col("_hard")))),
        F.when(n("soft") > 0, _row("Technical gap", F.when(n("soft") == 1, -8).otherwise(-15), F.array_join("_soft", ", "))),
        F.when(foreign, _row("Foreign language", F.lit(-profile.foreign_penalty), F.lit(""))),
        F.when(senior, _row("Too senior", F.lit(-profile.senior_penalty), F.trim(_first(F.col("_senior"))))),
        F.when(years_penalty > 0, _row("Experience", -years_penalty, y.cast("string"))),
    ]
    wide = wide.select("*", F.array_compact(F.array(*rows)).alias("_rows"), (has_family | entry).alias("_uncapped"))
    wide = wide.select("*", F.aggregate("_rows", F.lit(0), lambda s, r: s + r["points"]).alias("_points"))
    ceiling = F.lit(profile.no_title_ceiling)
    capped = ~F.col("_uncapped") & (F.col("_points") > ceiling)
    final = F.greatest(F.lit(0), F.least(F.lit(100), F.when(capped, ceiling).otherwise(F.col("_points")))).cast("int")
    breakdown = F.when(capped, F.array_append("_rows", _row("Capped", ceiling - F.col("_points"), F.lit("")))).otherwise(F.col("_rows"))
    scored = wide.select(*own, final.alias("score"), breakdown.alias("breakdown"))
    return scored.select(*own, "score", band_of(F.col("score")).alias("band"), "breakdown")


def band_of(score: Column) -> Column:
    band = F.lit("weak")
    for least, name in reversed(BANDS):
        band = F.when(score >= least, F.lit(name)).otherwise(band)
    return band


def sponsor_tier(permits: Column) -> Column:
    tier = F.lit(0)
    for least, _, value in reversed(PERMIT_STEPS):
        tier = F.when(permits >= least, F.lit(value)).otherwise(tier)
    return tier
