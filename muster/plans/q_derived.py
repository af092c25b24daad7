"""Registered queries: documented column meanings."""

from __future__ import annotations

from muster.operators import derived as D
from muster.plans.catalog import query
from muster.plans.oracle_sql import with_tables


@query("effective_hours", with_tables("sessions", "courses") + """
    SELECT s.id AS session_id, s.course_id, s.credit_hours_override, c.default_credit_hours,
           coalesce(s.credit_hours_override, c.default_credit_hours) AS effective_hours
    FROM sessions s LEFT JOIN courses c ON s.course_id = c.id""")
def effective_hours(t):
    """Session override, else the course default."""
    return D.effective_hours(t.sessions, t.courses)


@query("facilitator_identity", with_tables("facilitators", "officers") + """
    SELECT f.id, f.officer_id, CASE WHEN o.id IS NOT NULL THEN 'officer' ELSE 'external' END AS kind,
           CASE WHEN o.id IS NOT NULL THEN o.first_name ELSE f.first_name END AS first_name,
           CASE WHEN o.id IS NOT NULL THEN o.last_name ELSE f.last_name END AS last_name,
           coalesce(o.rank_code, f.rank_code) AS rank_code
    FROM facilitators f LEFT JOIN officers o ON f.officer_id = o.id""")
def facilitator_identity(t):
    """Linked officer's names, else the facilitator's own."""
    return D.facilitator_identity(t.facilitators, t.officers)


@query("officer_directory", with_tables("officers", "ranks", "regions", "formations",
                                        "postings") + """
    SELECT o.id, o.first_name, o.last_name, o.rank_code, r.name AS rank_name, o.region_id,
           g.name AS region_name, o.formation_id, f.name AS formation_name, o.posting_id,
           p.name AS posting_name
    FROM officers o LEFT JOIN ranks r ON o.rank_code = r.code
    LEFT JOIN regions g ON o.region_id = g.id LEFT JOIN formations f ON o.formation_id = f.id
    LEFT JOIN postings p ON o.posting_id = p.id""")
def officer_directory(t):
    """D3: officers with rank, region, formation and posting names."""
    return D.officer_directory(t.officers, t.ranks, t.regions, t.formations, t.postings)
