"""All queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from gridstone.plans import bulletin, control, dossier, entry, forecast, formats, ingest, insight, matrix, news, predictions, racing, ratings, records, serving, weekend, wire
from gridstone.sources.tables import table
from gridstone.streaming.incremental import first_seen, hourly_counts

QUERIES: dict = {
    **news.QUERIES,
    **racing.QUERIES,
    **insight.QUERIES,
    **weekend.QUERIES,
    **ingest.QUERIES,
    **entry.QUERIES,
    **forecast.QUERIES,
    **bulletin.QUERIES,
    **control.QUERIES,
    **serving.QUERIES,
    **ratings.QUERIES,
    **wire.QUERIES,
    **formats.QUERIES,
    **predictions.QUERIES,
    **matrix.QUERIES,
    **records.QUERIES,
    **dossier.QUERIES,
    "hourly_counts": lambda s, d: hourly_counts(table(s, d, "events")),
    "first_seen": lambda s, d: first_seen(table(s, d, "events")).select("event_id", "user_id", "event_type"),
}
ORACLE_SQL: dict[str, str] = {
    **news.ORACLE_SQL,
    **racing.ORACLE_SQL,
    **insight.ORACLE_SQL,
    **weekend.ORACLE_SQL,
    **ingest.ORACLE_SQL,
    **entry.ORACLE_SQL,
    **forecast.ORACLE_SQL,
    **bulletin.ORACLE_SQL,
    **control.ORACLE_SQL,
    **serving.ORACLE_SQL,
    **ratings.ORACLE_SQL,
    **wire.ORACLE_SQL,
    **formats.ORACLE_SQL,
    **predictions.ORACLE_SQL,
    **matrix.ORACLE_SQL,
    **records.ORACLE_SQL,
    **dossier.ORACLE_SQL,
    "hourly_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2",
    "first_seen": "select distinct on (event_id) event_id, user_id, event_type from events",
}
