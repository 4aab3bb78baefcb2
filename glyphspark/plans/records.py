"""Queries over records of activity, and their DuckDB SQL.

The records are read from the given tables by expressions that Spark and DuckDB share: purchases and errors are
conversions, views comparisons, clicks uploads, errors and views failures, signups feedback; customers are users.
Some rows break their schema, as stored rows do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..encodings import registry
from . import activity as act
from . import bodies, schemas

_TIER = "CASE {} % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'expert' END"
_EVENT = {"event_id": "event_id", "created_at": "ts", "userId": "CAST(user_id AS STRING)", "createdAt": "CAST(ts AS STRING)"}
#: name: (table, condition, columns)
FACTS: dict[str, tuple[str, str, dict[str, str]]] = {
    "conversions": ("events", "event_type IN ('purchase', 'error')", _EVENT | {
        "tier": _TIER.format("user_id"), "encodingId": "CASE event_id % 5 WHEN 0 THEN 'bijoy' WHEN 1 THEN 'sutonny' WHEN 2 THEN 'alpha-ansi' WHEN 3 THEN 'bijoy' ELSE '' END",
        "inputType": "CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'file' END", "charCount": "CAST(floor(value * 10) AS BIGINT) - 20", "wordCount": "CAST(floor(value) AS BIGINT)",
        "fileFormat": "CASE event_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'docx' WHEN 3 THEN 'txt' WHEN 4 THEN 'odt' END", "durationMs": "value - 1",
        "status": "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END", "error": "CASE WHEN event_type = 'error' THEN 'failed' END",
    }),
    "comparisons": ("events", "event_type = 'view'", _EVENT | {
        "mode": "CASE WHEN event_id % 3 = 0 THEN 'paragraph' ELSE 'word' END", "similarity": "value / 100", "sourceWordCount": "CAST(floor(value) AS BIGINT)",
        "targetWordCount": "event_id % 50", "changedWordCount": "CAST(floor(value) AS BIGINT) - 3",
    }),
    "uploads": ("events", "event_type = 'click'", _EVENT | {
        "fileName": "CASE WHEN event_id % 19 = 0 THEN '' ELSE 'file' || CAST(event_id AS STRING) || '.txt' END", "storagePath": "'x'", "sizeBytes": "CAST(floor(value * 100) AS BIGINT)",
        "fileType": "CASE event_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'docx' WHEN 3 THEN 'txt' ELSE 'csv' END", "extractionStatus": "CASE WHEN event_id % 6 = 0 THEN 'error' ELSE 'success' END",
    }),
    "failures": ("events", "event_type IN ('error', 'view')", _EVENT | {
        "source": "CASE event_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'file' WHEN 2 THEN 'comparison' ELSE 'api' END",
        "kind": "CASE event_id % 6 WHEN 0 THEN 'unmapped_character' WHEN 1 THEN 'conversion_failed' WHEN 2 THEN 'file_extraction_failed' WHEN 3 THEN 'validation_warning' WHEN 4 THEN 'limit_exceeded' ELSE 'bogus' END",
        "severity": "CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END", "code": "'CODE_' || CAST(event_id % 3 AS STRING)",
        "message": "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN 'a|b' ELSE 'message ' || CAST(event_id % 4 AS STRING) END",
        "encodingId": "CASE WHEN event_id % 2 = 0 THEN 'bijoy' END", "fileName": "CAST(NULL AS STRING)", "fileType": "CAST(NULL AS STRING)", "route": "CAST(NULL AS STRING)",
        "sampled": "CASE WHEN event_id % 10 = 0 THEN '' ELSE 's' || CAST(event_id % 17 AS STRING) || ',t' || CAST(event_id % 5 AS STRING) END", "occurrences": "event_id % 4 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END",
    }),
    "feedback": ("events", "event_type = 'signup'", _EVENT | {
        "email": "CAST(NULL AS STRING)", "category": "CASE event_id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'praise' ELSE 'other' END", "rating": "event_id % 6", "message": "'m'", "page": "CAST(NULL AS STRING)",
        "encodingId": "CAST(NULL AS STRING)", "sampleInput": "CAST(NULL AS STRING)", "sampleOutput": "CAST(NULL AS STRING)", "status": "CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'new' WHEN 2 THEN 'reviewed' ELSE 'resolved' END",
        "adminNote": "CASE WHEN event_id % 2 = 0 THEN 'old note' END", "updatedAt": "CAST(ts AS STRING)",
    }),
    "users": ("customer", "c_custkey % 5 <> 0", {"uid": "c_custkey", "email": "CAST(NULL AS STRING)", "displayName": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'profile ' || c_name END", "tier": "CASE c_mktsegment WHEN 'BUILDING' THEN 'expert' WHEN 'MACHINERY' THEN 'medium' WHEN 'FURNITURE' THEN 'easy' ELSE 'gold' END", "createdAt": "'x'"}),
    "overrides": ("supplier", "true", {"uid": "s_suppkey * 3", "maxNonWhitespaceChars": "s_suppkey * 10 - 200", "updatedAt": "'x'", "updatedBy": "'admin'"}),
}


def fact(spark: SparkSession, d: str, name: str) -> DataFrame:
    table, condition, columns = FACTS[name]
    rows = spark.read.parquet(f"{d}/{table}.parquet").where(condition).select(*[F.expr(e).alias(c) for c, e in columns.items()])
    return rows.withColumn("samples", F.filter(F.split("sampled", ","), lambda x: x != "")) if name == "failures" else rows


def _sql(name: str) -> str:
    table, condition, columns = FACTS[name]
    more = ", list_filter(string_split({}, ','), lambda x: x <> '') AS samples".format(columns["sampled"]) if name == "failures" else ""
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())}{more} FROM {table} WHERE {condition}"


def _issues_sql(collection: str) -> str:
    """Issues by the rules of a collection, each rule as one CASE."""
    out = []
    for f in schemas.COLLECTIONS[collection]:
        cases = []
        if f.options:
            said = f"Invalid option: expected one of {'|'.join(chr(34) + o + chr(34) for o in f.options)}"
            cases.append((f"{f.name} NOT IN ({', '.join(chr(39) + o + chr(39) for o in f.options)})" + ("" if f.nullable else f" OR {f.name} IS NULL"), said))
        else:
            if not f.nullable:
                cases.append((f"{f.name} IS NULL", f"Invalid input: expected {f.kind}, received null"))
            if f.least is not None and f.kind == "string":
                cases.append((f"length({f.name}) < {f.least}", f"Too small: expected string to have >={f.least} characters"))
            elif f.least is not None:
                cases.append((f"{f.name} < {f.least}", f"Too small: expected number to be >={f.least}"))
            if f.above is not None:
                cases.append((f"{f.name} <= {f.above}", f"Too small: expected number to be >{f.above}"))
            if f.most is not None:
                cases.append((f"{f.name} > {f.most}", f"Too big: expected number to be <={f.most}"))
        if cases:
            out.append("CASE " + " ".join(f"WHEN {c} THEN '{f.name}: {said}'" for c, said in cases) + " END")
    return f"concat_ws('; ', {', '.join(out)})"


_COLLECTION = {"conversions": "conversions", "comparisons": "comparisons", "uploads": "documents", "failures": "errorLogs", "feedback": "feedback"}


def schema_issues(spark, d):
    """Rows of five collections that break their schema, with all that is wrong."""
    out = None
    for name, collection in _COLLECTION.items():
        part = fact(spark, d, name).select(F.lit(collection).alias("collection"), "event_id", F.array_join(schemas.issues(collection), "; ").alias("issues")).where("issues <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def recent_valid(spark, d):
    """Of each user's newest 20 conversions those that are valid."""
    return schemas.valid(act.newest(fact(spark, d, "conversions"), 20, "userId"), "conversions").select("userId", "event_id", F.col("rn").cast("long").alias("rn"))


def account_history(spark, d):
    return act.history(20, conversions=fact(spark, d, "conversions"), comparisons=fact(spark, d, "comparisons"), documents=fact(spark, d, "uploads"))


def user_counters(spark, d):
    """Conversions, comparisons, uploads and characters of each user."""
    zero = F.lit(0).cast("long")
    rows = None
    for name, chars in (("conversions", F.col("charCount")), ("comparisons", zero), ("uploads", zero)):
        part = fact(spark, d, name).select("userId", F.lit(name).alias("kind"), chars.alias("chars"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("userId").agg(F.count_if(F.col("kind") == "conversions").alias("totalConversions"), F.count_if(F.col("kind") == "comparisons").alias("totalComparisons"), F.count_if(F.col("kind") == "uploads").alias("totalDocuments"), F.sum("chars").alias("totalCharsProcessed"))


def site_totals(spark, d):
    users = schemas.valid(fact(spark, d, "users"), "users")
    return act.site_totals(fact(spark, d, "conversions"), fact(spark, d, "comparisons"), fact(spark, d, "uploads"), users, [e.id for e in registry.listed()])


def tier_transfers(spark, d):
    """Users whose tier follows their orders from now on."""
    spent = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("uid")).agg(F.count("*").alias("n"))
    new = F.when(F.coalesce("n", F.lit(0)) > 15, "expert").when(F.coalesce("n", F.lit(0)) > 8, "medium").otherwise("easy")
    users = fact(spark, d, "users").join(spent, "uid", "left")
    return act.tier_transfers(users.select(act.tier_of(F.col("tier")).alias("old"), new.alias("new")))


def _daily(spark, d):
    return act.daily(*[fact(spark, d, n) for n in ("conversions", "comparisons", "uploads")])


def daily_rollup(spark, d):
    return _daily(spark, d)


def overview_30(spark, d):
    return act.last_days(_daily(spark, d))


def error_listing(spark, d):
    """The newest 200 failures of one kind; the filter on an unknown severity does not count."""
    filters = {"kind": act.known_filter("conversion_failed", schemas.KINDS), "severity": act.known_filter("fatal", ("error", "warning"))}
    return schemas.valid(act.listing(fact(spark, d, "failures"), 200, **filters), "errorLogs").select("event_id", "kind", "severity", "occurrences")


def error_summary(spark, d):
    """What the listing of the newest 200 failures adds up to."""
    return act.error_summary(schemas.valid(act.listing(fact(spark, d, "failures"), 200), "errorLogs"))


def error_clamps(spark, d):
    """The stored form of failures with long messages and samples: texts of conversations."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    kept = act.clamp_error(F.col("text"), F.split("text", " "), F.when(F.col("turn") % 2 == 0, F.col("turn") + 2))
    return rows.select("conv_id", "turn", *kept).select("conv_id", "turn", F.length("message").cast("long").alias("message_chars"), F.size("samples").cast("long").alias("n_samples"), F.array_join("samples", " ").alias("samples"), "occurrences")


def _log_events(spark, d):
    key = act.issue_key("kind", "source", "code", "encodingId", "fileName", "message", "sampled")
    return fact(spark, d, "failures").select(F.col("userId").alias("log"), key.alias("issue_key"), F.col("created_at").alias("ts"), "event_id", "kind", "severity", "samples")


CAP = 10


def issue_log(spark, d):
    """Each user's log of failures, newest first, of at most CAP rows."""
    return act.issue_log(_log_events(spark, d), CAP).select("log", "position", "issue_key", "occurrences", "first_id", "last_id")


def log_summary(spark, d):
    return act.log_summary(act.issue_log(_log_events(spark, d), CAP)).select("log", "errors", "warnings", F.array_join("samples", ",").alias("samples"))


def feedback_listing(spark, d):
    """The newest 100 new feedback entries, valid ones of them."""
    return schemas.valid(act.listing(fact(spark, d, "feedback"), 100, status=act.known_filter("new", ("new", "reviewed", "resolved"))), "feedback").select("event_id", "status", "rating")


def feedback_triage(spark, d):
    """Feedback after a round of triage: every third entry gets a status, every second one a note or none."""
    rows = schemas.valid(fact(spark, d, "feedback"), "feedback").withColumnRenamed("event_id", "id").select("id", "status", "adminNote")
    patches = rows.select("id", F.when(F.col("id") % 3 == 0, "resolved").alias("status"), (F.col("id") % 2 == 0).alias("sent_note"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("note "), 300)).alias("adminNote")).where("id % 5 <> 0")
    return act.patch_feedback(rows, patches).select("id", "status", F.substring("adminNote", 1, 20).alias("note"), F.length("adminNote").cast("long").alias("note_chars"))


def users_listing(spark, d):
    """Users with profile and override, where these are valid."""
    records = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("uid"), F.lower(F.concat("c_name", F.lit("@example.org"))).alias("email"), F.col("c_name").alias("displayName"))
    return act.users_rows(records, fact(spark, d, "users"), fact(spark, d, "overrides"))


def users_page(spark, d):
    """The page of 50 users behind token 100."""
    return act.page(users_listing(spark, d), "uid", 100)


def users_by_email(spark, d):
    return users_listing(spark, d).where(F.col("email") == "customer#000000007@example.org")


def _config_patches(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("k", F.col("s_suppkey"))
    return s.where("k % 3 <> 0").select("k", (F.col("k") % 2 == 0).alias("sent_easy"), F.when(F.col("k") % 4 == 0, F.col("k")).alias("easy"), F.lit(None).cast("boolean").alias("sent_medium"), F.lit(1).cast("long").alias("medium"), F.lit(True).alias("sent_documentsEnabled"), F.lit(True).alias("documentsEnabled"))


def config_merge(spark, d):
    """Settings of each supplier after a patch that sends some fields, one of them to clear."""
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("k", F.col("s_suppkey"))
    current = s.select("k", (F.col("k") * 100).alias("easy"), F.lit(6000).cast("long").alias("medium"), (F.col("k") % 2 == 0).alias("documentsEnabled"))
    return act.merge_config(current, _config_patches(spark, d), "k", ["easy", "medium", "documentsEnabled"])


def config_audits(spark, d):
    """Audit entries of the patches of config_merge, each by an admin of its own."""
    patches = _config_patches(spark, d).withColumn("actor", F.concat(F.lit("admin "), F.col("k").cast("string")))
    return act.config_audits(patches, ["easy", "medium", "documentsEnabled"])


def _changes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("uid"))
    tier = lambda k: F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("expert")), (k % 3 + 1).cast("int"))
    return c.select(F.lit("admin").alias("actor"), "uid", tier(F.col("uid")).alias("old_tier"), F.when(F.col("uid") % 4 == 0, tier(F.col("uid") + 1)).alias("tier"), F.when(F.col("uid") % 5 == 0, F.col("uid") % 2 == 0).alias("disabled"), (F.col("uid") % 6 == 0).alias("sent_override"), F.when(F.col("uid") % 12 == 0, F.col("uid") * 10).alias("override"))


def audit_events(spark, d):
    return act.audit_events(_changes(spark, d))


def overrides_left(spark, d):
    """Overrides after those of every third customer are cleared."""
    keys = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("uid"))
    return schemas.delete_by_key(fact(spark, d, "overrides"), keys, "uid").select("uid", "maxNonWhitespaceChars")


def profile_upsert(spark, d):
    """Profiles from a log of writes: an order sets its customer's tier."""
    writes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("uid"), F.when(F.col("o_orderstatus") == "F", "easy").when(F.col("o_orderstatus") == "O", "medium").otherwise("expert").alias("tier"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("event_id"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return act.upsert_profiles(writes).select("uid", "tier", day("createdAt"), day("updatedAt"), "writes")


def client_keys(spark, d):
    """Rate-limit keys of requests for pages, from made headers."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    forwarded = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit(" , 10.1.1.1")))
    real = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("10.2.0."), (F.col("page_id") % 7).cast("string")))
    return p.select("page_id", act.client_key("extract", F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("u"), F.col("page_id").cast("string"))), forwarded, real).alias("key"))


def storage_paths(spark, d):
    f = fact(spark, d, "uploads")
    return f.select("event_id", schemas.storage_path(F.col("userId"), F.col("event_id"), F.col("fileName")).alias("path"))


def json_bodies(spark, d):
    """Bodies of events checked against a schema; each eleventh is cut short."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 11 == 0, F.left("props", F.lit(4))).otherwise(F.col("props")).alias("body"))
    rows = schemas.parse_bodies(e, "body", "k long", (schemas.Field("k", "number", least=10, most=90),))
    return rows.select("event_id", "k", F.array_join("issues", "; ").alias("issues"), F.when(F.col("k").isNotNull(), F.to_json(F.struct("k"))).alias("again"))


#: Bodies of events: some cut short, some that lack or mistake a field.
_BODY = """CASE event_id % 11 WHEN 0 THEN left(props, 4) WHEN 1 THEN '{}' WHEN 2 THEN '{"k":null}' WHEN 3 THEN '{"k":"' || CAST(event_id AS STRING) || '"}'
  WHEN 4 THEN '{"k":50,"meta":{"tags":["a",' || CAST(event_id AS STRING) || ',null]}}' WHEN 5 THEN '{"k":50,"meta":{"tags":"a","on":1}}' WHEN 6 THEN '{"k":50,"meta":[]}'
  WHEN 7 THEN '{"k":' || CAST(event_id AS STRING) || '.5,"meta":{"on":true,"tags":[]}}' WHEN 8 THEN '[' || props || ']' ELSE props END"""
_PATHS = (bodies.Path("k", "number", least=10, most=90), bodies.Path("meta", "object", optional=True), bodies.Path("meta.on", "boolean", optional=True), bodies.Path("meta.tags", "array", optional=True), bodies.Path("meta.tags[]", "string"))


def body_issues(spark, d):
    """Bodies of events against nested fields: what is malformed, missing, null, of another type or out of bounds."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(_BODY).alias("body"))
    return bodies.parsed(rows, "body", {"k": ("k", "double")}, _PATHS).select("event_id", "k", F.array_join("issues", "; ").alias("issues"))


ALL = (
    body_issues, schema_issues, recent_valid, account_history, user_counters, site_totals, tier_transfers, daily_rollup, overview_30, error_listing, error_summary, error_clamps, issue_log, log_summary, feedback_listing, feedback_triage,
    users_listing, users_page, users_by_email, config_merge, config_audits, audit_events, overrides_left, profile_upsert, client_keys, storage_paths, json_bodies,
)
QUERIES = {f.__name__: f for f in ALL}

_NEW = "ORDER BY created_at DESC, event_id DESC"
_DAY = f"""
WITH f AS (
  SELECT strftime(created_at, '%Y-%m-%d') AS day, 1 AS a, 0 AS b, 0 AS c, charCount AS d, (status = 'error')::BIGINT AS e, 0 AS f FROM ({_sql('conversions')})
  UNION ALL SELECT strftime(created_at, '%Y-%m-%d'), 0, 1, 0, 0, 0, 0 FROM ({_sql('comparisons')})
  UNION ALL SELECT strftime(created_at, '%Y-%m-%d'), 0, 0, 1, 0, 0, (extractionStatus = 'error')::BIGINT FROM ({_sql('uploads')})),
days AS (SELECT day, sum(a)::BIGINT AS conversions, sum(b)::BIGINT AS comparisons, sum(c)::BIGINT AS documents, sum(d)::BIGINT AS charsProcessed, sum(e)::BIGINT AS conversionErrors, sum(f)::BIGINT AS documentErrors FROM f GROUP BY day)
"""
_KEY = "concat_ws('|', " + ", ".join(rf"coalesce(regexp_replace({c}, '([\\|])', '\\\1', 'g'), '')" for c in ("kind", "source", "code", "encodingId", "fileName", "message", "sampled")) + ")"
_LOG = f"""
WITH f AS ({_sql('failures')}),
e AS (SELECT userId AS log, {_KEY} AS k, event_id, kind, severity, samples, row_number() OVER (PARTITION BY userId ORDER BY created_at, event_id) AS n FROM f),
p AS (SELECT *, lag(n) OVER (PARTITION BY log, k ORDER BY n) AS prev FROM e),
b AS (SELECT p.log, p.k, p.n, count(DISTINCT q.k) AS others FROM p JOIN e q ON q.log = p.log AND q.n > p.prev AND q.n < p.n GROUP BY ALL),
h AS (SELECT p.*, CASE WHEN prev IS NOT NULL AND coalesce(others, 0) < {CAP} THEN 0 ELSE 1 END AS fresh FROM p LEFT JOIN b USING (log, k, n)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY log, k ORDER BY n) AS run FROM h),
g AS (SELECT log, k, run, count(*) AS occurrences, min_by(event_id, n) AS first_id, max_by(event_id, n) AS last_id, min_by(kind, n) AS kind, min_by(severity, n) AS severity, min_by(samples, n) AS samples, max(n) AS last FROM r GROUP BY log, k, run),
z AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY log, k ORDER BY run DESC) = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY last DESC) - 1 AS position FROM z QUALIFY position < {CAP})
"""
_USERS = f"""
WITH rec AS (SELECT c_custkey AS uid, lower(c_name || '@example.org') AS email, c_name AS displayName FROM customer),
p AS (SELECT * FROM ({_sql('users')}) WHERE tier IN ('easy', 'medium', 'expert')),
o AS (SELECT * FROM ({_sql('overrides')}) WHERE maxNonWhitespaceChars > 0),
listed AS (SELECT rec.uid, rec.email, CASE WHEN p.uid IS NOT NULL THEN p.displayName ELSE rec.displayName END AS displayName, coalesce(p.tier, 'easy') AS tier, o.maxNonWhitespaceChars AS usageOverrideMaxChars FROM rec LEFT JOIN p USING (uid) LEFT JOIN o USING (uid))
"""
_CELLS = [
    ("totalConversions", "'all'", "1", "conversions"), ("totalCharsProcessed", "'all'", "charCount", "conversions"), ("conversionsByStatus", "status", "1", "conversions"), ("conversionsByEncoding", "encodingId", "1", "conversions"),
    ("totalComparisons", "'all'", "1", "comparisons"), ("comparisonsByMode", "mode", "1", "comparisons"), ("totalDocuments", "'all'", "1", "uploads"), ("documentsByStatus", "extractionStatus", "1", "uploads"),
    ("documentsByFormat", "fileType", "1", "uploads"), ("totalUsers", "'all'", "1", "users"), ("usersByTier", "tier", "1", "users"),
]
_VALID = {name: f"{_issues_sql(c)} = ''" for name, c in _COLLECTION.items()}
_KIND = "CASE coalesce({0}, 'undefined') WHEN 'undefined' THEN 'undefined' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"


def _body_sql() -> str:
    said = lambda path, kind, given: f"'{path}: Invalid input: expected {kind}, received ' || {given}"
    other = lambda path, kind: f"CASE WHEN {path.replace('.', '_')} NOT IN ('undefined', '{kind}') THEN {said(path, kind, path.replace('.', '_'))} END"
    item = f"CASE WHEN json_type(x) <> 'VARCHAR' THEN 'meta.tags.' || (i - 1) || ': Invalid input: expected string, received ' || {_KIND.format('json_type(x)')} END"
    return f"""
WITH e AS (SELECT event_id, {_BODY} AS body FROM events),
p AS (SELECT event_id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM e),
t AS (SELECT *, {', '.join(f"{_KIND.format(f'json_type(b, {chr(39)}{path}{chr(39)})')} AS {name}" for name, path in (('body', '$'), ('k', '$.k'), ('meta', '$.meta'), ('meta_on', '$.meta.on'), ('meta_tags', '$.meta.tags')))},
  TRY_CAST(json_extract_string(b, '$.k') AS DOUBLE) AS n FROM p)
SELECT event_id, n AS k, CASE WHEN NOT ok THEN 'body: Malformed JSON' WHEN body <> 'object' THEN {said('body', 'object', 'body')} ELSE concat_ws('; ',
  CASE WHEN t.k <> 'number' THEN {said('k', 'number', 't.k')} WHEN n < 10 THEN 'k: Too small: expected number to be >=10' WHEN n > 90 THEN 'k: Too big: expected number to be <=90' END,
  {other('meta', 'object')}, CASE WHEN meta = 'object' THEN {other('meta.on', 'boolean')} END, CASE WHEN meta = 'object' THEN {other('meta.tags', 'array')} END,
  CASE WHEN meta_tags = 'array' THEN nullif(array_to_string(list_filter(list_transform(json_extract(b, '$.meta.tags[*]'), lambda x, i: {item}), lambda y: y IS NOT NULL), '; '), '') END) END AS issues FROM t
"""


ORACLE_SQL = {
    "body_issues": _body_sql(),
    "schema_issues": " UNION ALL ".join(f"SELECT '{c}' AS collection, event_id, {_issues_sql(c)} AS issues FROM ({_sql(n)}) WHERE {_issues_sql(c)} <> ''" for n, c in _COLLECTION.items()),
    "recent_valid": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY userId {_NEW}) AS rn FROM ({_sql('conversions')})) SELECT userId, event_id, rn FROM r WHERE rn <= 20 AND {_VALID['conversions']}",
    "account_history": " UNION ALL ".join(f"(SELECT '{c}' AS list, userId, event_id, row_number() OVER (PARTITION BY userId {_NEW}) AS rn FROM ({_sql(n)}) QUALIFY rn <= 20)" for n, c in (("conversions", "conversions"), ("comparisons", "comparisons"), ("uploads", "documents"))),
    "user_counters": f"SELECT userId, sum(a)::BIGINT AS totalConversions, sum(b)::BIGINT AS totalComparisons, sum(c)::BIGINT AS totalDocuments, sum(d)::BIGINT AS totalCharsProcessed FROM (SELECT userId, 1 AS a, 0 AS b, 0 AS c, charCount AS d FROM ({_sql('conversions')}) UNION ALL SELECT userId, 0, 1, 0, 0 FROM ({_sql('comparisons')}) UNION ALL SELECT userId, 0, 0, 1, 0 FROM ({_sql('uploads')})) GROUP BY userId",
    "site_totals": "SELECT dimension, value, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {v} AS value, {n} AS n FROM ({_sql(t)})" + (" WHERE tier IN ('easy', 'medium', 'expert')" if t == "users" else "") for d, v, n, t in _CELLS) + ") GROUP BY ALL",
    "tier_transfers": f"WITH s AS (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT CASE WHEN tier IN ('easy', 'medium', 'expert') THEN tier ELSE 'easy' END AS old, CASE WHEN coalesce(n, 0) > 15 THEN 'expert' WHEN coalesce(n, 0) > 8 THEN 'medium' ELSE 'easy' END AS new FROM ({_sql('users')}) LEFT JOIN s USING (uid)) SELECT tier, sum(d)::BIGINT AS delta FROM (SELECT old AS tier, -1 AS d FROM t WHERE old <> new UNION ALL SELECT new, 1 FROM t WHERE old <> new) GROUP BY tier",
    "daily_rollup": _DAY + "SELECT * FROM days",
    "overview_30": _DAY + ", newest AS (SELECT * FROM days ORDER BY day DESC LIMIT 30) SELECT *, row_number() OVER (ORDER BY day) AS position FROM newest",
    "error_listing": f"WITH w AS (SELECT * FROM ({_sql('failures')}) WHERE kind = 'conversion_failed' {_NEW} LIMIT 200) SELECT event_id, kind, severity, occurrences FROM w WHERE {_VALID['failures']}",
    "error_summary": f"WITH w AS (SELECT * FROM ({_sql('failures')}) {_NEW} LIMIT 200), v AS (SELECT *, row_number() OVER ({_NEW}) AS r FROM w WHERE {_VALID['failures']}), s AS (SELECT occurrences, r, unnest(samples) AS name, generate_subscripts(samples, 1) AS i FROM v), t AS (SELECT name, sum(occurrences)::BIGINT AS n, min(r * 1000 + i) AS f FROM s GROUP BY name) SELECT 'total' AS section, 'all' AS name, sum(occurrences)::BIGINT AS n, NULL::BIGINT AS rank FROM v UNION ALL SELECT 'byKind', kind, sum(occurrences)::BIGINT, NULL FROM v GROUP BY kind UNION ALL SELECT 'bySeverity', severity, sum(occurrences)::BIGINT, NULL FROM v GROUP BY severity UNION ALL (SELECT 'topSamples', name, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM t QUALIFY rank <= 12)",
    "error_clamps": "WITH c AS (SELECT conv_id, turn, least(length(text), 500)::BIGINT AS message_chars, list_transform(string_split(text, ' ')[1:20], lambda x: substr(x, 1, 60)) AS s, (CASE WHEN turn % 2 = 0 THEN turn + 2 ELSE 1 END)::BIGINT AS occurrences FROM conversations) SELECT conv_id, turn, message_chars, len(s)::BIGINT AS n_samples, array_to_string(s, ' ') AS samples, occurrences FROM c",
    "issue_log": _LOG + "SELECT log, position, k AS issue_key, occurrences, first_id, last_id FROM kept",
    "log_summary": _LOG + ", u AS (SELECT log, position, unnest(samples) AS s, generate_subscripts(samples, 1) AS i FROM kept WHERE kind = 'unmapped_character'), m AS (SELECT log, s, min(position * 1000 + i) AS place FROM u GROUP BY ALL), j AS (SELECT log, string_agg(s, ',' ORDER BY place) AS samples FROM m GROUP BY log) SELECT log, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity <> 'error') AS warnings, coalesce(any_value(j.samples), '') AS samples FROM kept LEFT JOIN j USING (log) GROUP BY log",
    "feedback_listing": f"WITH w AS (SELECT * FROM ({_sql('feedback')}) WHERE status = 'new' {_NEW} LIMIT 100) SELECT event_id, status, rating FROM w WHERE {_VALID['feedback']}",
    "feedback_triage": f"WITH f AS (SELECT event_id AS id, status, adminNote FROM ({_sql('feedback')}) WHERE {_VALID['feedback']}), g AS (SELECT id, CASE WHEN id % 5 <> 0 AND id % 3 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN id % 5 <> 0 AND id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN substr(repeat('note ', 300), 1, 1000) END ELSE adminNote END AS note FROM f) SELECT id, status, substr(note, 1, 20) AS note, length(note)::BIGINT AS note_chars FROM g",
    "users_listing": _USERS + "SELECT * FROM listed",
    "users_page": _USERS + "SELECT * FROM listed WHERE uid > 100 ORDER BY uid LIMIT 50",
    "users_by_email": _USERS + "SELECT * FROM listed WHERE email = 'customer#000000007@example.org'",
    "config_audits": """SELECT 'admin ' || s_suppkey AS actor, 'config.update' AS action, 'systemConfig/limits' AS target,
      '{' || concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN '"easy":' || CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey::VARCHAR ELSE 'null' END END, '"documentsEnabled":true') || '}' AS metadata FROM supplier WHERE s_suppkey % 3 <> 0""",
    "config_merge": "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END ELSE s_suppkey * 100 END AS easy, 6000::BIGINT AS medium, s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0 AS documentsEnabled FROM supplier",
    "audit_events": f"WITH c AS (SELECT c_custkey AS uid, {_TIER.format('c_custkey')} AS old, {_TIER.format('(c_custkey + 1)')} AS new FROM customer) SELECT 'admin' AS actor, 'user.tier.set' AS action, 'users/' || uid AS target, '{{\"oldTier\":\"' || old || '\",\"newTier\":\"' || new || '\"}}' AS metadata FROM c WHERE uid % 4 = 0 UNION ALL SELECT 'admin', CASE WHEN uid % 2 = 0 THEN 'user.disable' ELSE 'user.enable' END, 'auth/' || uid, '{{}}' FROM c WHERE uid % 5 = 0 UNION ALL SELECT 'admin', CASE WHEN uid % 12 = 0 THEN 'user.usageOverride.set' ELSE 'user.usageOverride.clear' END, 'usageOverrides/' || uid, CASE WHEN uid % 12 = 0 THEN '{{\"maxNonWhitespaceChars\":' || uid * 10 || '}}' ELSE '{{}}' END FROM c WHERE uid % 6 = 0",
    "overrides_left": f"SELECT uid, maxNonWhitespaceChars FROM ({_sql('overrides')}) WHERE uid NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0)",
    "profile_upsert": "SELECT o_custkey AS uid, max_by(CASE o_orderstatus WHEN 'F' THEN 'easy' WHEN 'O' THEN 'medium' ELSE 'expert' END, row(o_orderdate, o_orderkey)) AS tier, strftime(min(o_orderdate), '%Y-%m-%d') AS createdAt, strftime(max(o_orderdate), '%Y-%m-%d') AS updatedAt, count(*) AS writes FROM orders GROUP BY o_custkey",
    "client_keys": "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'extract:uid:u' || page_id WHEN page_id % 3 = 0 THEN 'extract:ip:10.0.0.' || (page_id % 250) WHEN page_id % 2 = 0 THEN 'extract:ip:10.2.0.' || (page_id % 7) ELSE 'extract:ip:unknown' END AS key FROM pages",
    "storage_paths": f"SELECT event_id, 'users/' || userId || '/documents/' || event_id || '/' || fileName AS path FROM ({_sql('uploads')})",
    "json_bodies": "WITH b AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events) SELECT event_id, k, CASE WHEN k IS NULL THEN 'k: Invalid input: expected number, received null' WHEN k < 10 THEN 'k: Too small: expected number to be >=10' WHEN k > 90 THEN 'k: Too big: expected number to be <=90' ELSE '' END AS issues, CASE WHEN k IS NOT NULL THEN '{\"k\":' || k || '}' END AS again FROM b",
}
