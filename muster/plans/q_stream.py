"""Registered queries: token-bucket admission, batch and streaming.

The driver's events are sparse (median gap of hours), so the checked configuration
is one token per 30 minutes with a burst of 2; with the reference's 2/s nothing
would ever be denied and the check would be vacuous. The constants of the
reference (2 per second, burst 4) are the operators' defaults.
"""

from __future__ import annotations

from muster.operators.ratelimit import costs, token_bucket
from muster.plans.catalog import query
from muster.sources.tables import load_table
from muster.streaming.token_bucket import run_to_table, token_bucket_stream

CHECK_RATE = 1 / 1800
CHECK_BURST = 2
_COST, _CAP = costs(CHECK_RATE, CHECK_BURST)

_ORACLE = f"""
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
r(user_id, rn, event_id, t, level, admitted) AS (
  SELECT user_id, rn, event_id, t, CAST({_CAP - _COST} AS BIGINT), TRUE FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.t,
         CASE WHEN least({_CAP}, r.level + (e.t - r.t)) >= {_COST}
              THEN least({_CAP}, r.level + (e.t - r.t)) - {_COST}
              ELSE least({_CAP}, r.level + (e.t - r.t)) END,
         least({_CAP}, r.level + (e.t - r.t)) >= {_COST}
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, admitted, level AS level_us FROM r"""


@query("token_bucket", _ORACLE)
def token_bucket_batch(t):
    """T1 batch: admission of every event per user (segmented at refill gaps)."""
    return token_bucket(t.raw("events"), "user_id", "ts", "event_id", CHECK_RATE, CHECK_BURST)


@query("token_bucket_stream", _ORACLE)
def token_bucket_streaming(t):
    """T1 + T2 on Structured Streaming: the events file as a stream source, stateful
    per-user buckets with idle eviction, Parquet sink read back."""
    schema = load_table(t.spark, t.root, "events").schema
    # a glob that matches the table alone: a plain path would have to be a folder, and it may be a file
    return run_to_table(
        t.spark, f"{t.root}/events.parque[t]", schema,
        lambda s: token_bucket_stream(s, "user_id", "ts", "event_id", CHECK_RATE, CHECK_BURST))


def _ingest_stream(t):
    """S2 on Structured Streaming: the officer request bodies (derived from customer) land
    as a Parquet file; the stream decodes them into a Parquet sink that is read back."""
    import uuid

    from muster.plans.q_ingest import officer_lines
    from muster.session import checkpoint_dir
    from muster.sources.ndjson import INPUTS, ingest_ndjson

    landing = f"{checkpoint_dir(t.spark).rstrip('/')}/bodies-{uuid.uuid4().hex}"
    lines = officer_lines(t)
    lines.write.parquet(landing)
    return run_to_table(t.spark, landing, lines.schema,
                        lambda s: ingest_ndjson(s, INPUTS["officers"]))


def _register_ingest_stream() -> None:
    from muster.plans.q_ingest import _OFFICER_EXPECTED
    query("ndjson_ingest_stream", _OFFICER_EXPECTED)(_ingest_stream)


_register_ingest_stream()
