"""Row types of the posting engine."""

from __future__ import annotations

#: A posting as every source's mapper returns it.
POSTING = (
    "id string, title string, company string, location string, url string, description string, posted_at string, "
    "source string, department string, employment_type string, closes_at string, salary string"
)
POSTING_COLUMNS = tuple(part.split()[0] for part in POSTING.split(", "))

#: A recorded response of one board, as the board source returns it: one page of one of its searches.
RAW_BOARD = (
    "ats string, token string, company string, raw string, ordinal long, fetched_at timestamp, error string, "
    "search string, page int, country string"
)

#: What is known of an employer.
COMPANY = (
    "name string, ats string, token string, website string, permits int, sponsor_tier int, sponsor_confidence string, "
    "priority boolean, fit_rank int, sector string, entry_routes string"
)
NOTE = "array<struct<code: string, detail: string, quote: string>>"
