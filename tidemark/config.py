"""The profile that postings are scored and classified against.

A profile is plain configuration. DEFAULT is a neutral one for job adverts; CORPUS
fits the driver's synthetic tables, whose words are invented.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Family:
    name: str
    terms: tuple[str, ...]
    weight: int
    early_career: bool = False


@dataclass(frozen=True)
class Profile:
    families: tuple[Family, ...]
    graduate_terms: tuple[str, ...]
    strong_graduate_terms: tuple[str, ...]
    tools_core: tuple[str, ...] = ()
    tools_taught: tuple[str, ...] = ()
    tools_certified: tuple[str, ...] = ()
    work_terms: tuple[str, ...] = ()
    work_cap: int = 4
    training_terms: tuple[str, ...] = ()
    training_bonus: int = 5
    domain_terms: tuple[str, ...] = ()
    domain_bonus: int = 10
    locations: tuple[tuple[str, int], ...] = ()
    language_terms: tuple[str, ...] = ()
    language_bonus: int = 6
    shift_terms: tuple[str, ...] = ()
    shift_bonus: int = 3
    hard_skills: tuple[str, ...] = ()
    soft_skills: tuple[str, ...] = ()
    foreign_languages: tuple[str, ...] = ()
    foreign_penalty: int = 60
    senior_terms: tuple[str, ...] = ()
    senior_penalty: int = 30
    #: Penalty by the number of years asked: 0-1, 2, 3, 4, 5 and more.
    years_penalties: tuple[int, int, int, int, int] = (0, 4, 10, 18, 30)
    no_title_ceiling: int = 48
    excluded_terms: tuple[str, ...] = ()
    home_places: tuple[str, ...] = ()
    abroad_places: tuple[str, ...] = ()
    remote_terms: tuple[str, ...] = field(default=("remote",))


#: Bounds of the score bands, sponsor steps, and days or hours of the board's life cycle.
BANDS = ((70, "excellent"), (58, "strong"), (45, "decent"), (32, "stretch"))
PERMIT_STEPS = ((25, 10, 3), (5, 8, 2), (1, 6, 1))
CONFIDENCE_POINTS = {"documented": 7, "likely": 4, "unverified": 1}
MIN_SCORE, MAX_AGE_DAYS, NEW_HOURS, SHARDS, SLOT_SECONDS = 10, 45, 24, 8, 900
QUARANTINE_AFTER, QUARANTINE_RETRY = 6, 4
CRITICAL_SALARY, GENERAL_SALARY, OCCUPATION_FLOOR = 40904, 36605, 36848

DEFAULT = Profile(
    families=(
        Family("operations", ("operations", "process associate", "service delivery", "case handler"), 34),
        Family("claims", ("claims", "policy administrator", "underwriting"), 32),
        Family("customer", ("customer service", "customer support", "contact centre"), 26),
        Family("finance", ("finance analyst", "fund accounting", "accounts assistant", "treasury"), 30, True),
        Family("data", ("data analyst", "reporting analyst", "business analyst"), 28),
    ),
    graduate_terms=("graduate programme", "graduate scheme", "graduate", "internship", "intern", "entry level", "junior", "trainee"),
    strong_graduate_terms=("graduate programme", "graduate scheme", "internship", "intern", "entry level", "junior"),
    tools_core=("excel", "power bi"), tools_taught=("python", "sql"), tools_certified=("tableau",),
    work_terms=("kpi", "sla", "reconciliation", "quality", "deadline"),
    training_terms=("no experience needed", "full training"),
    domain_terms=("insurance", "pensions", "banking"),
    locations=(("dublin", 10), ("cork", 8), ("remote", 6), ("ireland", 5)),
    language_terms=("hindi",), shift_terms=("shift", "night shift"),
    hard_skills=("java developer", "registered nurse"), soft_skills=("sap", "salesforce"),
    foreign_languages=("german", "french", "italian", "spanish", "dutch", "polish", "slovak", "portuguese"),
    senior_terms=("senior", "head of", "director", "principal", "manager"),
    excluded_terms=("freelance", "day rate", "umbrella company"),
    home_places=("ireland", "dublin", "cork", "galway", "limerick", "waterford", "clare", "donegal", "kerry", "tralee", "ennis"),
    abroad_places=("london", "tunisia", "lisbon", "mexico city", "belfast", "northern ireland", "paris", "berlin"),
)

CORPUS = Profile(
    families=(
        Family("english", ("the", "thing", "tion", "er"), 34),
        Family("german", ("der", "und", "die", "ein"), 32),
        Family("french", ("le", "de la", "une", "que"), 26),
        Family("spanish", ("los", "que", "para", "por"), 30, True),
    ),
    graduate_terms=("licensed", "of the", "en la", "in der"), strong_graduate_terms=("licensed", "of the"),
    tools_core=("password", "token"), tools_taught=("from", "mit", "pour"), tools_certified=("was", "von"),
    work_terms=("and", "for", "que", "sich"), training_terms=("all rights",), domain_terms=("the", "der", "las"),
    locations=(("src1", 10), ("src2", 8), ("en", 5)), language_terms=("idiot",), shift_terms=("not", "nicht"),
    hard_skills=("secret",), soft_skills=("key", "as", "auf"), foreign_languages=(),
    senior_terms=("an", "el"), excluded_terms=("!!", "$$$"),
    home_places=("en", "fr", "de"), abroad_places=("es",), remote_terms=(),
)
