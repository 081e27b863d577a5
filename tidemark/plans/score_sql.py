"""The scoring of ``operators.scoring`` as SQL, made from the same profile, to check it in another engine."""

from __future__ import annotations

import re

from tidemark.config import BANDS, Profile


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(c: str, term: str) -> str:
    term = term.lower()
    if re.search(r"[ /-]", term):
        return f"contains({c}, {quote(term)})"
    return f"regexp_matches({c}, {quote('(^|[^a-z0-9])' + re.escape(term) + '([^a-z0-9]|$)')})"


def count(c: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join([f"{matches(c, t)}::INT" for t in terms] or ["0"]) + ")"


def scored(source: str, p: Profile) -> str:
    """A query of doc_id, rows (list of label and points), points, score and band; source: title, text, place, sector by doc_id."""
    families = [f"CASE WHEN {count('title', f.terms)} = 0 THEN 0 WHEN {'graduate = 0' if f.early_career else 'false'} THEN {f.weight // 2} ELSE {f.weight} END" for f in p.families]
    strong = "(" + " OR ".join(matches("txt", t) for t in p.graduate_terms if t in p.strong_graduate_terms) + ")"
    repeated = " OR ".join(f"({matches('txt', t)} AND (length(txt) - length(replace(txt, {quote(t)}, ''))) // {len(t)} >= 3)" for t in p.domain_terms)
    places = ", ".join(["0", *[f"CASE WHEN contains(place, {quote(k)}) OR contains(txt, {quote(k)}) THEN {v} ELSE 0 END" for k, v in p.locations]])
    bands = " ".join(f"WHEN score >= {least} THEN {quote(name)}" for least, name in BANDS)
    row = lambda label, points: f"struct_pack(label := '{label}', points := ({points})::INT)"
    some = lambda condition, label, points: f"CASE WHEN {condition} THEN {row(label, points)} END"
    rows = ",\n    ".join(
        [
            row("Role fit", "weight"),
            row("Early careers", f"CASE WHEN graduate > 0 THEN (CASE WHEN {strong} THEN 20 ELSE 12 END) WHEN intake AND senior = 0 THEN 16 WHEN weight > 0 AND senior = 0 THEN 9 ELSE 0 END"),
            row("Tools", "least(18, core * 5 + taught * 3 + certified)"),
            some("work > 0", "Ways of working", f"least({p.work_cap}, work)"),
            some("training > 0", "Training", str(p.training_bonus)),
            row("Industry", f"CASE WHEN dom_title > 0 THEN {p.domain_bonus} WHEN dom_sector > 0 THEN {p.domain_bonus - 2} WHEN {repeated} THEN 4 ELSE 0 END"),
            row("Location", f"greatest({places})"),
            row("Sponsorship", "CASE WHEN permits >= 25 THEN 10 WHEN permits >= 5 THEN 8 WHEN permits >= 1 THEN 6 ELSE 0 END"),
            some("lang_hits > 0", "Language edge", str(p.language_bonus)),
            some("shift > 0", "Shift work", str(p.shift_bonus)),
            some("hard > 0", "Missing skill", "-20"),
            some("soft > 0", "Technical gap", "CASE WHEN soft = 1 THEN -8 ELSE -15 END"),
            some("senior > 0", "Too senior", str(-p.senior_penalty)),
        ]
    )
    vocabulary = {
        "graduate": ("txt", p.graduate_terms), "core": ("txt", p.tools_core), "taught": ("txt", p.tools_taught), "certified": ("txt", p.tools_certified),
        "work": ("txt", p.work_terms), "training": ("txt", p.training_terms), "dom_title": ("title", p.domain_terms), "dom_sector": ("sector", p.domain_terms),
        "lang_hits": ("txt", p.language_terms), "shift": ("txt", p.shift_terms), "hard": ("txt", p.hard_skills), "soft": ("txt", p.soft_skills), "senior": ("title", p.senior_terms),
    }
    counts = ", ".join(f"{count(c, terms)} AS {name}" for name, (c, terms) in vocabulary.items())
    entry = f"(weight > 0 OR (({strong} OR intake) AND senior = 0))"
    return f"""
WITH src AS ({source}),
hit AS (SELECT *, {counts}, regexp_matches(title, '(^|[^0-9])20(2[5-9]|3[0-5])([^0-9]|$)') AS intake FROM src),
weighed AS (SELECT *, greatest(0, {', '.join(families)}) AS weight FROM hit),
listed AS (SELECT doc_id, {entry} AS free, list_filter([
    {rows}], lambda r: r IS NOT NULL) AS rows FROM weighed),
summed AS (SELECT *, list_sum(list_transform(rows, lambda r: r.points))::INT AS points FROM listed),
capped AS (SELECT *, NOT free AND points > {p.no_title_ceiling} AS over FROM summed),
final AS (SELECT doc_id, greatest(0, least(100, CASE WHEN over THEN {p.no_title_ceiling} ELSE points END))::INT AS score,
  CASE WHEN over THEN list_append(rows, struct_pack(label := 'Capped', points := ({p.no_title_ceiling} - points)::INT)) ELSE rows END AS rows FROM capped)
SELECT doc_id, score, CASE {bands} ELSE 'weak' END AS band, rows FROM final"""
