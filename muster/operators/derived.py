"""Column meanings the schema documents declare (D1-D3): joins and coalesces.

Lookup tables (ranks, regions, formations, postings) get no broadcast hint: AQE
broadcasts them at runtime from their measured size, and falls back to a shuffle
join if they are ever large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_hours(sessions: DataFrame, courses: DataFrame) -> DataFrame:
    """A session's credit hours = its override, else its course's default."""
    c = courses.select(F.col("id").alias("_cid"), "default_credit_hours")
    j = sessions.join(c, sessions["course_id"] == c["_cid"], "left")
    return j.select(F.col("id").alias("session_id"), "course_id", "credit_hours_override",
                    "default_credit_hours",
                    F.coalesce("credit_hours_override", "default_credit_hours")
                    .alias("effective_hours"))


def facilitator_identity(facilitators: DataFrame, officers: DataFrame) -> DataFrame:
    """A facilitator is an officer (linked) or an external person (own free text)."""
    o = officers.select(F.col("id").alias("_oid"), F.col("first_name").alias("_ofn"),
                        F.col("last_name").alias("_oln"), F.col("rank_code").alias("_ork"))
    j = facilitators.join(o, facilitators["officer_id"] == o["_oid"], "left")
    linked = F.col("_oid").isNotNull()
    return j.select(
        "id", "officer_id", F.when(linked, "officer").otherwise("external").alias("kind"),
        F.when(linked, F.col("_ofn")).otherwise(F.col("first_name")).alias("first_name"),
        F.when(linked, F.col("_oln")).otherwise(F.col("last_name")).alias("last_name"),
        F.coalesce(F.col("_ork"), F.col("rank_code")).alias("rank_code"))


def officer_directory(officers: DataFrame, ranks: DataFrame, regions: DataFrame,
                      formations: DataFrame, postings: DataFrame) -> DataFrame:
    """D3: officers with the names of their rank, region, formation and posting."""
    def names(df, key, alias):
        return df.select(F.col(key).alias(f"_{alias}_key"), F.col("name").alias(alias))
    out = officers
    for df, key, col, alias in ((ranks, "code", "rank_code", "rank_name"),
                                (regions, "id", "region_id", "region_name"),
                                (formations, "id", "formation_id", "formation_name"),
                                (postings, "id", "posting_id", "posting_name")):
        n = names(df, key, alias)
        out = out.join(n, out[col] == n[f"_{alias}_key"], "left").drop(f"_{alias}_key")
    return out.select("id", "first_name", "last_name", "rank_code", "rank_name", "region_id",
                      "region_name", "formation_id", "formation_name", "posting_id",
                      "posting_name")
