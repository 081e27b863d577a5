"""Classifications from ordered rules: sponsorship wording, permit route, occupation list, open office jobs, outsourcers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CRITICAL_SALARY, GENERAL_SALARY, OCCUPATION_FLOOR
from tidemark.functions.text import holds_any, salary_eur, text
from tidemark.operators.gates import GRADUATE_TITLE, SENIOR_TITLE

REFUSES = r"(?i)\b(not|un)( be)?( able|able)? to (offer|provide|sponsor|support)\b[^.•]{0,60}(visa|permit|sponsor)|\b(can|do|does|will|would)( ?not|n['’]t)\b[^.•]{0,30}\bsponsor|\b(no|without) (visa |permit )?sponsorship\b"
OFFERS = r"(?i)(visa|permit) sponsorship (is )?(available|offered|provided)|(will|can|happy to) (sponsor|support) .{0,30}(visa|permit)|employment permit (support|assistance)"


#: What neither of the two says without.
SPONSORS = ("visa", "permit", "sponsor")


def sponsorship(description: Column) -> Column:
    """"refuses" before "offers"; null if the advert says neither."""
    d = text(description)
    return F.when(holds_any(F.lower(d), SPONSORS), F.when(d.rlike(REFUSES), "refuses").when(d.rlike(OFFERS), "offers"))


def permit_route(salary: Column) -> Column:
    """By the stated salary; null without one."""
    return F.when(salary >= CRITICAL_SALARY, "critical_skills").when(salary >= GENERAL_SALARY, "general").when(salary.isNotNull(), "below_threshold")


def with_routes(postings: DataFrame) -> DataFrame:
    """postings with sponsorship, salary_eur and permit_route."""
    priced = postings.withColumns({"sponsorship": sponsorship(F.col("description")), "salary_eur": salary_eur(F.col("description"))})
    return priced.withColumn("permit_route", permit_route(F.col("salary_eur")))


@dataclass(frozen=True)
class Occupation:
    code: str
    title: str
    evidence: str
    line: str


OCCUPATIONS = (
    Occupation("2136", r"(?i)\b(software|web) (engineer|developer)", r"(?i)\b(java|python|typescript|kubernetes|react)\b", "ICT professionals"),
    Occupation("2135", r"(?i)\b(business|systems) analyst", r"(?i)\b(data model\w*|process mapping|sql|uml)\b", "Business and systems analysts"),
    Occupation("2425", r"(?i)\b(actuar\w+|statistician|data scientist)", r"(?i)\b(statistics|modelling|pricing|machine learning)\b", "Actuaries and statisticians"),
    Occupation("2421", r"(?i)\b(tax|audit|accountant)\b", r"(?i)\b(aca|acca|cpa|ifrs)\b", "Chartered accountants"),
    Occupation("2462", r"(?i)\b(quality|regulatory) (engineer|specialist|affairs)", r"(?i)\b(gmp|validation|iso 9001)\b", "Quality assurance professionals"),
)


def occupation(title: Column, description: Column, salary: Column, rules: tuple[Occupation, ...] = OCCUPATIONS) -> Column:
    """The first rule whose title and evidence both match; null if none does, or if it is under the salary floor."""
    t, d = text(title), text(description)
    found = F.lit(None)
    for rule in reversed(rules):
        evidence = F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(d, F.lit(rule.evidence), F.lit(0)), F.lower))), F.lit(1), F.lit(4))
        row = F.struct(
            F.lit(rule.code).alias("soc4"), F.regexp_extract(t, rule.title, 0).alias("matched_title"), evidence.alias("evidence"),
            F.lit(rule.line).alias("line"), salary.cast("int").alias("salary_eur"), F.lit(OCCUPATION_FLOOR).alias("floor"),
        )
        found = F.when(t.rlike(rule.title) & d.rlike(rule.evidence), row).otherwise(found)
    return F.when(salary.isNull() | (salary == 0) | (salary >= OCCUPATION_FLOOR), found)


#: Open office jobs: families in order, and what keeps a title out.
OFFICE_FAMILIES = (
    ("claims", r"(?i)\bclaims? (handler|assistant|administrator|associate)"), ("pensions", r"(?i)\bpensions? (administrator|assistant|associate)"),
    ("customer service", r"(?i)\bcustomer (service|care|support|success)"), ("operations", r"(?i)\boperations (assistant|associate|administrator|analyst)"),
    ("fund services", r"(?i)\bfund (accountant|accounting|administrator|services)"), ("payroll", r"(?i)\bpayroll\b"),
    ("banking", r"(?i)\bbank(ing)? (officer|assistant|associate|advisor)"), ("administration", r"(?i)\b(office|business|sales)? ?(administrator|administration|support executive)"),
    ("reporting", r"(?i)\b(reporting|data|business) analyst"), ("compliance", r"(?i)\b(kyc|aml|compliance) (analyst|associate|officer)"),
)
NOT_OFFICE = r"(?i)\b(driver|chef|nurse|warehouse|retail|cleaner|technician|engineer|field|store|barista|electrician)\b"
STUDENT_TITLE = r"(?i)\b(intern(ship)?|placement|student|co-?op|work experience)\b"
OPEN_TO_GRADUATES = r"(?i)\b(recent )?graduates? (are )?(welcome|may apply|can apply)|open to (recent )?graduates|recent graduates?\b"
NOT_A_JOB = r"(?i)^(early careers?|graduates?|internships?|students?|careers?|apprenticeships?)( (at|in) .*)?$|\b(careers? fair|open (evening|day)|webinar|insight event)\b"
#: Languages of a market or a speaker that a posting may name.
LANGUAGES = (
    "(arabic|bulgarian|cantonese|catalan|chinese|croatian|czech|danish|dutch|estonian|farsi|finnish|flemish|french|german|greek|hebrew|hungarian|icelandic|"
    "irish|italian|japanese|korean|latvian|lithuanian|mandarin|norwegian|persian|polish|portuguese|romanian|russian|serbian|slovak|slovenian|spanish|swedish|"
    "thai|turkish|ukrainian|urdu|vietnamese)"
)
TITLE_LANGUAGE = r"(?i)\b" + LANGUAGES.replace("irish|", "") + r"\b|\b(nordics?|scandinavian)\b"
MAX_OFFICE_YEARS = 1


def open_office(title: Column, description: Column, status: Column, years: Column) -> Column:
    """struct<family, years> of a posting anyone could walk into; null otherwise."""
    t, d = F.trim(F.regexp_replace(text(title), r"\s+", " ")), text(description)
    family = F.coalesce(*[F.when(t.rlike(p), F.lit(name)) for name, p in OFFICE_FAMILIES])
    out = (
        (status == "blocked") | (t == "") | t.rlike(SENIOR_TITLE) | t.rlike(NOT_OFFICE) | t.rlike(TITLE_LANGUAGE) | t.rlike(NOT_A_JOB)
        | (t.rlike(STUDENT_TITLE) & ~d.rlike(OPEN_TO_GRADUATES)) | (F.coalesce(years > MAX_OFFICE_YEARS, F.lit(False)) & ~t.rlike(GRADUATE_TITLE))
    )
    return F.when(~out & family.isNotNull(), F.struct(family.alias("family"), years.cast("int").alias("years")))


#: Outsourcing employers by whole words.
OUTSOURCERS = r"(?i)(^|[^a-z0-9])(tcs|covalen|infosys bpm|hcl\s?tech|version 1|telus digital|concentrix|teleperformance|genpact|wipro|cognizant|accenture operations)($|[^a-z0-9])"


def outsourcer(company: Column) -> Column:
    return text(company).rlike(OUTSOURCERS)


def final_status(postings: DataFrame, rejected: DataFrame, learned: DataFrame) -> DataFrame:
    """eligibility and eligibility_reasons after feedback and fit, then crack_it and bpo.

    postings: company, title, description, band, eligibility, eligibility_reasons, years.
    A pair that was rejected, else a learned word, blocks; then a weak fit, unless the
    posting is listed apart. Learned words meet the words of the distinct titles, and the
    first hit of a title comes back to its postings; all by equi-joins.
    """
    from tidemark.operators.feedback import words

    own = postings.columns
    titles = postings.select(F.lower(text(F.col("title"))).alias("_t")).distinct()
    hits = titles.select("_t", F.explode(words(F.col("_t"))).alias("word")).join(learned.select("word"), "word").groupBy("_t").agg(F.min("word").alias("_hit"))
    marked = (
        postings.withColumns({"_c": F.lower(text(F.col("company"))), "_t": F.lower(text(F.col("title")))})
        .join(rejected.select(F.col("company").alias("_c"), F.col("title").alias("_t"), F.lit(True).alias("_rejected")), ["_c", "_t"], "left")
        .join(hits, "_t", "left")
    )
    hit = F.col("_hit")
    why = F.when(F.coalesce("_rejected", F.lit(False)), "rejected before").when(hit.isNotNull(), F.concat(F.lit("rejected word: "), hit))
    note = lambda code, detail: F.array(F.struct(F.lit(code).alias("code"), detail.alias("detail"), text(F.col("title")).alias("quote")))
    one = marked.withColumn("_why", F.when(F.col("eligibility") != "blocked", why))
    one = one.withColumns(
        {
            "eligibility": F.when(F.col("_why").isNotNull(), "blocked").otherwise(F.col("eligibility")),
            "eligibility_reasons": F.when(F.col("_why").isNotNull(), F.concat("eligibility_reasons", note("feedback", F.col("_why")))).otherwise(F.col("eligibility_reasons")),
            "bpo": outsourcer(F.col("company")),
        }
    )
    office = lambda: open_office(F.col("title"), F.col("description"), F.col("eligibility"), F.col("years"))
    two = one.withColumn("_weak", (F.col("band") == "weak") & (F.col("eligibility") != "blocked") & office().isNull() & ~F.col("bpo"))
    two = two.withColumns(
        {
            "eligibility": F.when(F.col("_weak"), "blocked").otherwise(F.col("eligibility")),
            "eligibility_reasons": F.when(F.col("_weak"), F.concat("eligibility_reasons", note("fit", F.lit("weak fit")))).otherwise(F.col("eligibility_reasons")),
        }
    )
    kept = [c for c in own if c not in ("bpo", "crack_it")]
    return two.select(*kept, "bpo", office().alias("crack_it"))
