"""The eight paged listings as data.

Each spec names the table, the query-string filters (kind, column) and the sort
safelist. Kinds: ``text`` = full-text (NULL text counts as empty), ``ci`` =
case-insensitive equality, ``id`` = exact match of the id rendered as text.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ListSpec:
    name: str
    table: str
    filters: tuple[tuple[str, str, str], ...]  # (argument, kind, column)
    sort_keys: tuple[str, ...]                  # sortable columns; "-" prefix = descending
    default_sort: str
    tiebreak: str = "id"

    @property
    def safelist(self) -> tuple[str, ...]:
        return self.sort_keys + tuple("-" + k for k in self.sort_keys)


@dataclass(frozen=True)
class PageArgs:
    page: int = 1
    page_size: int = 20
    sort: str | None = None                 # None = the spec's default
    filters: dict = field(default_factory=dict)


# fixed values: argument names, sort safelists and default sorts per listing
LIST_SPECS: dict[str, ListSpec] = {s.name: s for s in (
    ListSpec("officers", "officers",
             (("first_name", "text", "first_name"), ("last_name", "text", "last_name"),
              ("rank_code", "ci", "rank_code")),
             ("id", "first_name", "last_name", "rank_code"), "id"),
    ListSpec("courses", "courses",
             (("title", "text", "title"), ("category", "ci", "category")),
             ("id", "title", "category", "default_credit_hours"), "id"),
    ListSpec("sessions", "sessions",
             (("location", "text", "location_text"), ("course_id", "id", "course_id")),
             ("id", "start_datetime", "end_datetime", "location_text"), "start_datetime"),
    ListSpec("facilitators", "facilitators",
             (("first_name", "text", "first_name"), ("last_name", "text", "last_name")),
             ("id", "first_name", "last_name"), "id"),
    ListSpec("attendance", "attendance",
             (("officer_id", "id", "officer_id"), ("session_id", "id", "session_id")),
             ("id", "created_at", "status"), "created_at"),
    ListSpec("session_feedback", "session_feedback",
             (("session_id", "id", "session_id"), ("officer_id", "id", "officer_id"),
              ("facilitator_id", "id", "facilitator_id")),
             ("id", "created_at", "rating"), "created_at"),
    ListSpec("session_facilitators", "session_facilitators",
             (("session_id", "id", "session_id"), ("facilitator_id", "id", "facilitator_id")),
             ("id", "session_id", "facilitator_id"), "id"),
    ListSpec("import_jobs", "import_jobs",
             (("type", "ci", "type"), ("status", "ci", "status")),
             ("id", "type", "status", "created_at"), "created_at"),
)}

# fixed values: page argument limits
MAX_PAGE = 10_000
MAX_PAGE_SIZE = 100
DEFAULT_PAGE_SIZE = 20
