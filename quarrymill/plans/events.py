"""Queries over the event log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.retrieval import top
from ..sources.tables import sequenced, table
from ..streaming.events import once, windowed_counts


KINDS = ("click", "error", "purchase", "signup", "view")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events of each day by kind, those of any other kind, and all."""
    kinds = [F.count_if(F.col("event_type") == t).alias(t) for t in KINDS]
    return _events(spark, d).groupBy("day").agg(*kinds, F.count_if(~F.coalesce(F.col("event_type").isin(*KINDS), F.lit(False))).alias("other"), F.count("*").alias("n"))


ACTIVITY_SQL = "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in KINDS) + f", count(*) FILTER (NOT coalesce(event_type IN {KINDS}, false)) AS other, count(*) AS n FROM events GROUP BY 1"


def focus_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score of each user's events, from 0 to 100."""
    weight = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "signup", 0.8).when(F.col("event_type") == "click", 0.5).when(F.col("event_type") == "view", 0.3).otherwise(0.0)
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.sum(weight) / F.count("*"))), 4).alias("focus"))


FOCUS_SQL = """SELECT user_id, count(*) AS n, round(greatest(0.0, least(100.0, 100 * sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.8 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.3 ELSE 0.0 END) / count(*))), 4)::DOUBLE AS focus FROM events GROUP BY user_id"""


def risk_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Days on a dense spine with their errors and spending, and what they raise."""
    days = _events(spark, d)
    sums = days.groupBy("day").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("spent"), F.count("*").alias("n"))
    full = E.day_spine(days, "day").join(sums, "day", "left").na.fill(0)
    alerts = F.array_compact(F.array(F.when(F.col("errors") * 5 > F.col("n"), "errors"), F.when(F.col("n") == 0, "silent"), F.when(F.col("spent") > 0, "spending")))
    return full.select("day", "errors", F.round("spent", 4).alias("spent"), "n", F.array_join(alerts, ",").alias("alerts"))


RISK_SQL = """
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events),
s AS (SELECT day, count(*) FILTER (event_type = 'error') AS errors, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS spent, count(*) AS n FROM e GROUP BY day),
f AS (SELECT CAST(d AS DATE) AS day FROM generate_series((SELECT min(day) FROM e)::TIMESTAMP, (SELECT max(day) FROM e)::TIMESTAMP, INTERVAL 1 DAY) AS t(d)),
j AS (SELECT f.day, coalesce(errors, 0) AS errors, coalesce(spent, 0.0) AS spent, coalesce(n, 0) AS n FROM f LEFT JOIN s USING (day))
SELECT day, errors, round(spent, 4) AS spent, n, concat_ws(',', CASE WHEN errors * 5 > n THEN 'errors' END, CASE WHEN n = 0 THEN 'silent' END, CASE WHEN spent > 0 THEN 'spending' END) AS alerts FROM j
"""


def inactive_streak(spark: SparkSession, d: str) -> DataFrame:
    """Each event type's longest run of days without a purchase-size value: days on the spine where it is absent."""
    days = _events(spark, d)
    spine = E.day_spine(days, "day")
    kinds = days.select("event_type").distinct()
    seen = days.where(F.col("value") > 50).select("event_type", "day").distinct().withColumn("seen", F.lit(1))
    grid = kinds.crossJoin(F.broadcast(spine)).join(seen, ["event_type", "day"], "left")  # a row for each kind and day
    return E.streaks(grid, ["event_type"], "day", F.col("seen").isNull())


STREAK_SQL = """
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events),
f AS (SELECT CAST(d AS DATE) AS day FROM generate_series((SELECT min(day) FROM e)::TIMESTAMP, (SELECT max(day) FROM e)::TIMESTAMP, INTERVAL 1 DAY) AS t(d)),
g AS (SELECT k.event_type, f.day, (k.event_type, f.day) NOT IN (SELECT (event_type, day) FROM e WHERE value > 50) AS off FROM (SELECT DISTINCT event_type FROM e) k, f),
r AS (SELECT event_type, off, sum(CAST(NOT off AS INT)) OVER (PARTITION BY event_type ORDER BY day) AS grp FROM g)
SELECT event_type, CAST(max(run) AS BIGINT) AS longest FROM (SELECT event_type, grp, sum(CAST(off AS INT)) AS run FROM r GROUP BY ALL) GROUP BY event_type
"""


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    marked = E.sessions(_events(spark, d), "user_id", "ts", "event_id", 6 * 3600)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))


SESSIONS_SQL = """
WITH p AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(CASE WHEN pause IS NULL OR pause > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM p)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM s GROUP BY ALL
"""


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(_events(spark, d), "ts", "event_type", "value", "1 day")


TUMBLING_SQL = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(_events(spark, d), "ts", "event_type", "value", "2 days", "1 day")


SLIDING_SQL = "SELECT date_trunc('day', ts)::TIMESTAMP - INTERVAL (k) DAY AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) AS r(k) GROUP BY ALL"


def snapshot_at(spark: SparkSession, d: str) -> DataFrame:
    """Each user's state in the middle of the log; an error removes a user until the next event."""
    events = _events(spark, d)
    return E.snapshot_at(events, "user_id", "ts", "event_id", "2024-01-15 12:00:00", F.col("event_type") == "error").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


SNAPSHOT_SQL = """SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'"""


def entity_history(spark: SparkSession, d: str) -> DataFrame:
    """Numbered events of every user, with the ones before and after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = sequenced(_events(spark, d), "user_id", "ts", "event_id")
    return numbered.select("user_id", "event_id", "seq", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))


HISTORY_SQL = "SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS seq, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    """Customers that the log never names."""
    users = _events(spark, d).select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").join(users, "c_custkey", "left_anti").select("c_custkey", "c_name")


ORPHANS_SQL = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"


def metric_trend(spark: SparkSession, d: str) -> DataFrame:
    series = _events(spark, d).groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return E.trend(series, ["event_type"], "day", "n").select("event_type", "latest", "previous", "delta", "direction", "least", "most")


TREND_SQL = """
WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS p FROM s),
t AS (SELECT event_type, arg_max(n, day) AS latest, arg_max(p, day) AS previous, min(n) AS least, max(n) AS most FROM l GROUP BY event_type)
SELECT event_type, latest, previous, latest - previous AS delta, CASE WHEN latest > previous THEN 'up' WHEN latest < previous THEN 'down' ELSE 'flat' END AS direction, least, most FROM t
"""


def latest_per_day(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each day."""
    return top(_events(spark, d), ["day"], [F.desc("ts"), F.desc("event_id")], 1).select("day", "event_id", "event_type")


LATEST_SQL = "SELECT CAST(ts AS DATE) AS day, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"


def idempotent_runs(spark: SparkSession, d: str) -> DataFrame:
    """Which runs of a user's request (the k of its props) are fresh: views start, purchases complete, errors fail."""
    status = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    runs = _events(spark, d).withColumn("k", F.get_json_object("props", "$.k")).withColumn("status", status)
    return E.fresh_runs(runs, ["user_id", "k"], ["ts", "event_id"], "status").select("event_id", "fresh")


IDEMPOTENT_SQL = """
WITH r AS (SELECT event_id, ts, user_id, json_extract_string(props, '$.k') AS k, CAST(event_type IN ('view', 'purchase') AS INT) AS blocks FROM events)
SELECT event_id, coalesce(max(blocks) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS fresh FROM r
"""


def last_events(spark: SparkSession, d: str) -> DataFrame:
    """The last 100 distinct events in a time range."""
    kept = once(_events(spark, d).where("ts >= '2024-01-05' AND ts < '2024-01-25'"), "event_id", "ts")
    return kept.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


LAST_SQL = "SELECT event_id, ts FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 100"

QUERIES = {
    "daily_activity": (daily_activity, ACTIVITY_SQL),
    "focus_score": (focus_score, FOCUS_SQL),
    "risk_alerts": (risk_alerts, RISK_SQL),
    "inactive_streak": (inactive_streak, STREAK_SQL),
    "event_sessions": (event_sessions, SESSIONS_SQL),
    "tumbling_counts": (tumbling_counts, TUMBLING_SQL),
    "sliding_counts": (sliding_counts, SLIDING_SQL),
    "snapshot_at": (snapshot_at, SNAPSHOT_SQL),
    "entity_history": (entity_history, HISTORY_SQL),
    "orphan_entities": (orphan_entities, ORPHANS_SQL),
    "metric_trend": (metric_trend, TREND_SQL),
    "latest_per_day": (latest_per_day, LATEST_SQL),
    "idempotent_runs": (idempotent_runs, IDEMPOTENT_SQL),
    "last_events": (last_events, LAST_SQL),
}
