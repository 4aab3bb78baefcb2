"""Queries that bring the given tables into stored tables, in waves and by streams, and read what is there afterwards.

The facts are those of records.py. Waves that were sent before are sent again, which must change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage.manifest import shared_dir
from ..streaming import live
from . import activity as act
from . import records, schemas
from .records import _sql, fact
from .stores import Stores, increments

WAVES = 3


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def stored_counters(spark, d):
    """Counters of users, site and days after three waves of facts and one that came again."""
    s = Stores(spark, _root(spark, "counters"))
    for wave in (0, 1, 1, 2, 0):
        part = lambda name, wave=wave: fact(spark, d, name).where(F.col("event_id") % WAVES == wave)
        s.count(increments(part("conversions"), part("comparisons"), part("uploads")), "waves", wave)
    return s.counters.read().where("n <> 0").select("name", "scope", "counter", "n")


def stored_records(spark, d):
    """Valid records of five collections, stored twice; how many each keeps, and their ids."""
    s, out = Stores(spark, _root(spark, "records")), None
    for name, collection in records._COLLECTION.items():
        for _ in range(2):
            s.record(fact(spark, d, name), collection)
        rows = s.records(collection).read()
        part = rows.agg(F.lit(collection).alias("collection"), F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


def stored_profiles(spark, d):
    """Profiles after the orders of three spans of time each set their customer's tier, and the counters of tiers."""
    s = Stores(spark, _root(spark, "profiles"))
    o = spark.read.parquet(f"{d}/orders.parquet")
    tier = F.when(F.col("o_orderstatus") == "F", "easy").when(F.col("o_orderstatus") == "O", "medium").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "expert").otherwise("gold"))
    writes = o.select(F.col("o_custkey").cast("string").alias("uid"), F.concat(F.col("o_orderkey").cast("string"), F.lit("@example.org")).alias("email"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("displayName"), tier.alias("tier"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.col("o_orderkey").alias("seq"))
    for wave, (low, high) in enumerate((("0", "1994-01-01"), ("1994-01-01", "1996-06-01"), ("1994-01-01", "1996-06-01"), ("1996-06-01", "9"))):
        s.set_tiers(writes.where((F.col("at") >= low) & (F.col("at") < high)), "orders", wave - (wave > 1))
    counts = s.counters.read().where("n <> 0").select(F.lit("counter").alias("section"), F.concat_ws(" ", "counter", "name").alias("key"), F.col("n").cast("string").alias("value"))
    rows = s.users.read().select(F.lit("profile").alias("section"), F.col("uid").alias("key"), F.concat_ws("|", "tier", "createdAt", "displayName", "email").alias("value"))
    return rows.unionByName(counts)


def _admin(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    tier = lambda k: F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("expert")), (k % 3 + 1).cast("int"))
    k, n = F.col("k"), F.col("n")
    rows = c.crossJoin(F.broadcast(spark.range(4).select(F.col("id").alias("n"))))  # four changes of each user
    changes = rows.select(
        F.when(k % 50 == 0, k.cast("string")).otherwise("admin").alias("actor"), k.cast("string").alias("uid"), F.when((k + n) % 2 == 0, tier(k + n)).alias("tier"), F.when((k + 2 * n) % 5 == 0, n % 2 == 0).alias("disabled"),
        ((k + n) % 4 == 1).alias("sent_override"), F.when((k + n) % 8 == 1, k * 10 + n - 40).alias("override"), F.concat(F.lit("2024-01-0"), (n + 1).cast("string")).alias("at"), n.alias("seq"),
    )
    return changes, c.select(k.cast("string").alias("uid"), F.concat("name", F.lit("@example.org")).alias("email"), F.col("name").alias("displayName"))


def stored_admin(spark, d):
    """Users, states, limits, counters and audits after four changes of each customer in two batches, the first sent twice."""
    s = Stores(spark, _root(spark, "admin"))
    changes, names = _admin(spark, d)
    refused = None
    for wave in (0, 0, 1):
        out = s.change_users(changes.where(F.col("seq").between(2 * wave, 2 * wave + 1)), names, "admin", wave)
        refused = out if wave == 0 else refused.unionByName(out)
    part = lambda rows, section, key, value: rows.select(F.lit(section).alias("section"), F.col(key).alias("key") if isinstance(key, str) else key.alias("key"), value.cast("string").alias("value"))
    out = part(s.users.read(), "user", "uid", F.concat_ws("|", "tier", "createdAt", "email"))
    out = out.unionByName(part(s.accounts.read(), "account", "uid", F.col("disabled")))
    out = out.unionByName(part(s.overrides.read(), "override", "uid", F.concat_ws("|", F.col("maxNonWhitespaceChars").cast("string"), "updatedAt", "updatedBy")))
    out = out.unionByName(part(s.counters.read().where("n <> 0"), "counter", F.concat_ws(" ", "counter", "name"), F.col("n")))
    out = out.unionByName(part(s.audit.read(), "audit", F.concat_ws(" ", "actorUid", "action", "target", "createdAt"), F.col("metadata")))
    return out.unionByName(part(refused, "refused", F.concat_ws(" ", "uid", "at"), F.col("message")))


def stored_feedback(spark, d):
    """Feedback after two rounds of triage, the second sent twice, with its audits."""
    s = Stores(spark, _root(spark, "feedback"))
    f = fact(spark, d, "feedback").withColumn("id", F.col("event_id").cast("string"))
    s.feedback.upsert(f.select(*[F.col(x.name).alias(x.name) for x in s.feedback.columns]))
    k = F.col("event_id")
    for wave in (0, 1, 1):
        note = F.when((k + wave) % 4 == 0, F.repeat(F.lit(f"note {wave} "), 200))
        patches = f.where((k + wave) % 3 != 0).select(F.lit("admin").alias("actor"), "id", F.when((k + wave) % 5 == 0, "resolved").alias("status"), ((k + wave) % 2 == 0).alias("sent_note"), note.alias("adminNote"), F.lit(f"2024-02-0{wave + 1}").alias("at"), k.alias("seq"))
        s.triage(patches, "triage", wave)
    rows = s.feedback.read().select(F.lit("entry").alias("section"), F.col("id").alias("key"), F.concat_ws("|", "status", F.coalesce(F.concat(F.length("adminNote").cast("string"), F.lit(":"), F.substring("adminNote", 1, 8)), F.lit("-")), F.when(F.col("updatedAt").startswith("2024-02-0"), F.col("updatedAt")).otherwise("as made")).alias("value"))
    return rows.unionByName(s.audit.read().select(F.lit("audit").alias("section"), F.concat_ws(" ", "target", "createdAt").alias("key"), F.col("metadata").alias("value")))


def _streamed(rows: DataFrame, at: str, run) -> None:
    """Sends rows in WAVES spans of time through a stream that is stopped and started again between them."""
    spark = rows.sparkSession
    source, checkpoint = _root(spark, "arrivals"), _root(spark, "progress")
    when = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(when, F.array(*[F.lit(k / WAVES) for k in range(1, WAVES)]))).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(when > low)
        (part if high is None else part.where(when <= high)).write.mode("append").parquet(source)
        query = run(spark.readStream.schema(rows.schema).parquet(source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def live_issue_log(spark, d):
    """issue_log, kept by a stream over three spans of time."""
    events, root = records._log_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), _root(spark, "logs")
    _streamed(events, "ts", lambda rows: live.log_stream(rows, root, records.CAP))
    return live.logs_table(spark, root).read().select("log", "position", "issue_key", "occurrences", "first_id", "last_id")


def live_first_issues(spark, d):
    """The first failure of each kind of issue, stored by a stream over three spans of time."""
    key = act.issue_key("kind", "source", "code", "encodingId", "fileName", "message", "sampled")
    root = _root(spark, "reports")
    rows = fact(spark, d, "failures").select(key.alias("made"), F.col("created_at").cast("timestamp").alias("created_at"), "event_id")
    _streamed(rows, "created_at", lambda stream: live.report_stream(stream, root, F.col("made")))
    from ..storage.tables import StoredTable

    return StoredTable(spark, root, "issue_key string, event_id long", ("issue_key",)).read().select("issue_key", "event_id")


def live_counters(spark, d):
    """Counters kept by a stream of events over three spans of time."""
    root = _root(spark, "counted")
    events = spark.read.parquet(f"{d}/events.parquet")

    def facts(batch: DataFrame) -> dict[str, DataFrame]:
        made = {}
        for name in ("conversions", "comparisons", "uploads"):
            _, condition, columns = records.FACTS[name]
            made[name] = batch.where(condition).select(*[F.expr(e).alias(c) for c, e in columns.items()])
        return made

    _streamed(events, "ts", lambda rows: live.counter_stream(rows, root, facts))
    return Stores(spark, root).counters.read().where("n <> 0").select("name", "scope", "counter", "n")


ALL = (stored_counters, stored_records, stored_profiles, stored_admin, stored_feedback, live_issue_log, live_first_issues, live_counters)
QUERIES = {f.__name__: f for f in ALL}


def _counted(name: str, cells: list[tuple[str, str, str]]) -> str:
    """SQL of the cells (scope, counter, n) of a fact; a scope is a column of names, all, or day."""
    names = {"user": "userId", "all": "'all'", "day": "substr(createdAt, 1, 10)"}
    scopes = {"user": "user", "all": "site", "day": "day"}
    return " UNION ALL ".join(f"SELECT {names.get(s, s)} AS name, '{scopes.get(s, 'site')}' AS scope, '{c}' AS counter, {n} AS n FROM ({_sql(name)})" for s, c, n in cells)


_COUNTERS = "SELECT name, scope, counter, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join((
    _counted("conversions", [*((s, c, n) for s in ("user", "all") for c, n in (("totalConversions", "1"), ("totalCharsProcessed", "charCount"))), ("status", "conversionsByStatus", "1"), ("encodingId", "conversionsByEncoding", "1"), ("day", "conversions", "1"), ("day", "charsProcessed", "charCount"), ("day", "conversionErrors", "(status = 'error')::BIGINT")]),
    _counted("comparisons", [("user", "totalComparisons", "1"), ("all", "totalComparisons", "1"), ("mode", "comparisonsByMode", "1"), ("day", "comparisons", "1")]),
    _counted("uploads", [("user", "totalDocuments", "1"), ("all", "totalDocuments", "1"), ("extractionStatus", "documentsByStatus", "1"), ("fileType", "documentsByFormat", "1"), ("day", "documents", "1"), ("day", "documentErrors", "(extractionStatus = 'error')::BIGINT")]),
)) + ") GROUP BY ALL HAVING sum(n) <> 0"
_RECORDS = " UNION ALL ".join(
    f"SELECT '{c}' AS collection, count(*) AS rows, count(*) AS ids FROM (SELECT DISTINCT {', '.join(x.name for x in schemas.COLLECTIONS[c])} FROM ({_sql(n)}) WHERE {records._VALID[n]})" for n, c in records._COLLECTION.items()
)
_PROFILES = """
WITH w AS (SELECT o_custkey::VARCHAR AS uid, o_orderkey || '@example.org' AS email, 'order ' || o_orderkey AS displayName, strftime(o_orderdate, '%Y-%m-%d') AS tm, o_orderkey AS seq,
    CASE o_orderstatus WHEN 'F' THEN 'easy' WHEN 'O' THEN 'medium' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'expert' ELSE 'gold' END END AS tier FROM orders),
g AS (SELECT *, CASE WHEN tm < '1994-01-01' THEN 0 WHEN tm < '1996-06-01' THEN 1 ELSE 2 END AS wave FROM w WHERE tier <> 'gold'),
p AS (SELECT uid, max_by(tier, row(tm, seq)) AS tier, min(tm) AS createdAt, max_by(email, row(tm, seq)) AS email FROM g GROUP BY uid),
f AS (SELECT uid, max_by(displayName, row(tm, seq)) AS displayName FROM g JOIN (SELECT uid, min(wave) AS wave FROM g GROUP BY uid) USING (uid, wave) GROUP BY uid)
SELECT 'profile' AS section, uid AS key, tier || '|' || createdAt || '|' || displayName || '|' || email AS value FROM p JOIN f USING (uid)
UNION ALL SELECT 'counter', 'usersByTier ' || tier, count(*)::VARCHAR FROM p GROUP BY tier
UNION ALL SELECT 'counter', 'totalUsers all', count(*)::VARCHAR FROM p
"""
_ADMIN = """
WITH c AS (SELECT c_custkey AS k, c_name AS name, n FROM customer, range(4) r(n)),
a AS (SELECT k::VARCHAR AS uid, name, n, CASE WHEN k % 50 = 0 THEN k::VARCHAR ELSE 'admin' END AS actor, '2024-01-0' || (n + 1) AS tm,
    CASE WHEN (k + n) % 2 = 0 THEN (['easy', 'medium', 'expert'])[(k + n) % 3 + 1] END AS tier, CASE WHEN (k + 2 * n) % 5 = 0 THEN n % 2 = 0 END AS disabled,
    (k + n) % 4 = 1 AS sent, CASE WHEN (k + n) % 8 = 1 THEN k * 10 + n - 40 END AS lim FROM c),
m AS (SELECT *, CASE WHEN sent AND lim <= 0 THEN 'Invalid user update.' WHEN tier IS NULL AND disabled IS NULL AND NOT sent THEN 'Nothing to update.'
    WHEN disabled AND actor = uid THEN 'You cannot disable your own account.' END AS message FROM a),
g AS (SELECT *, coalesce(last_value(tier IGNORE NULLS) OVER (PARTITION BY uid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'easy') AS old FROM m WHERE message IS NULL),
u AS (SELECT uid, max_by(tier, n) AS tier, min(tm) AS made, any_value(name) AS name FROM g WHERE tier IS NOT NULL GROUP BY uid),
o AS (SELECT uid, max_by({'l': lim, 'a': tm, 'b': actor}, n) AS w FROM g WHERE sent GROUP BY uid),
t AS (SELECT tier, count(*) AS n FROM u GROUP BY tier)
SELECT 'user' AS section, uid AS key, tier || '|' || made || '|' || name || '@example.org' AS value FROM u
UNION ALL SELECT 'account', uid, max_by(disabled, n)::VARCHAR FROM g WHERE disabled IS NOT NULL GROUP BY uid
UNION ALL SELECT 'override', uid, w.l || '|' || w.a || '|' || w.b FROM o WHERE w.l IS NOT NULL
UNION ALL SELECT 'counter', 'usersByTier ' || x.tier, x.n::VARCHAR FROM (SELECT tier, n FROM t WHERE tier <> 'easy' UNION ALL SELECT 'easy', -sum(n) FROM t WHERE tier <> 'easy') x WHERE x.n <> 0
UNION ALL SELECT 'audit', actor || ' user.tier.set users/' || uid || ' ' || tm, '{"oldTier":"' || old || '","newTier":"' || tier || '"}' FROM g WHERE tier IS NOT NULL
UNION ALL SELECT 'audit', actor || CASE WHEN disabled THEN ' user.disable' ELSE ' user.enable' END || ' auth/' || uid || ' ' || tm, '{}' FROM g WHERE disabled IS NOT NULL
UNION ALL SELECT 'audit', actor || CASE WHEN lim IS NULL THEN ' user.usageOverride.clear' ELSE ' user.usageOverride.set' END || ' usageOverrides/' || uid || ' ' || tm, CASE WHEN lim IS NULL THEN '{}' ELSE '{"maxNonWhitespaceChars":' || lim || '}' END FROM g WHERE sent
UNION ALL SELECT 'refused', uid || ' ' || tm, message FROM m WHERE message IS NOT NULL
"""
_FEEDBACK = f"""
WITH f AS (SELECT *, {records._VALID['feedback']} AS ok FROM ({_sql('feedback')})),
p AS (SELECT event_id, w, '2024-02-0' || (w + 1) AS tm, CASE WHEN (event_id + w) % 5 = 0 THEN 'resolved' END AS s, (event_id + w) % 2 = 0 AS sent,
    CASE WHEN (event_id + w) % 4 = 0 THEN substr(repeat('note ' || w || ' ', 200), 1, 1000) END AS note FROM f, range(2) r(w) WHERE ok AND (event_id + w) % 3 <> 0),
l AS (SELECT event_id, max_by(s, w) FILTER (s IS NOT NULL) AS s, max_by({{'n': note}}, w) FILTER (sent) AS n, max(tm) AS tm FROM p GROUP BY event_id),
z AS (SELECT f.event_id, coalesce(l.s, f.status) AS status, CASE WHEN l.n IS NOT NULL THEN l.n.n ELSE f.adminNote END AS note, l.tm FROM f LEFT JOIN l USING (event_id))
SELECT 'entry' AS section, event_id::VARCHAR AS key, status || '|' || coalesce(length(note) || ':' || substr(note, 1, 8), '-') || '|' || coalesce(tm, 'as made') AS value FROM z
UNION ALL SELECT 'audit', 'feedback/' || event_id || ' ' || tm, '{{"status":' || coalesce('"' || s || '"', 'null') || ',"noteChanged":' || sent || '}}' FROM p
"""
ORACLE_SQL = {
    "stored_counters": _COUNTERS, "live_counters": _COUNTERS, "stored_records": _RECORDS, "stored_profiles": _PROFILES, "stored_admin": _ADMIN, "stored_feedback": _FEEDBACK, "live_issue_log": records.ORACLE_SQL["issue_log"],
    "live_first_issues": f"SELECT {records._KEY} AS issue_key, min_by(event_id, row(created_at, event_id)) AS event_id FROM ({_sql('failures')}) GROUP BY 1",
}
