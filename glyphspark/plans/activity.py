"""Usage limits and activity analytics over fact tables, in built-in operators.

Facts have user_id, created_at and their own columns. Everything groups or ranks by key, so Spark's partial aggregation
and range of keys carry it; listings over all rows are top-n plans, never full sorts.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schemas

#: Characters allowed by tier; anything else counts as easy.
TIERS = {"easy": 3000, "medium": 6000, "expert": 25000}
#: HTTP status by error code.
STATUS: dict[str, int] = {
    "VALIDATION_ERROR": 400, "FILE_PROCESSING_ERROR": 422, "CONVERSION_ERROR": 422, "LIMIT_EXCEEDED_ERROR": 413, "AUTHENTICATION_ERROR": 401,
    "AUTHORIZATION_ERROR": 403, "RATE_LIMIT_ERROR": 429, "STORAGE_ERROR": 500, "DATABASE_ERROR": 500, "UNKNOWN_ERROR": 500,
}


DAILY = ("conversions", "comparisons", "documents", "charsProcessed", "conversionErrors", "documentErrors")


def tier_of(tier: Column) -> Column:
    return F.when(tier.isin(*TIERS), tier).otherwise("easy")


def tier_limit(tier: Column, override: Column) -> Column:
    limit = F.lit(TIERS["easy"])
    for name, n in TIERS.items():
        limit = F.when(tier == name, n).otherwise(limit)
    return F.coalesce(override, limit).cast("long")


def check_usage(used: Column, limit: Column, tier: Column) -> Column:
    """struct<used, max, remaining, within_limit, message, band>"""
    # The words of the message.
    message = F.concat(F.lit("This input has "), F.format_number(used, 0), F.lit(" characters, which exceeds the "), tier, F.lit(" tier limit of "), F.format_number(limit, 0), F.lit(". Reduce the input or use a higher tier."))
    band = F.when(used > limit, "danger").when(used / limit > 0.85, "warning").otherwise("ok")
    return F.struct(used.alias("used"), limit.alias("max"), F.greatest(limit - used, F.lit(0)).cast("long").alias("remaining"), (used <= limit).alias("within_limit"), F.when(used > limit, message).alias("message"), band.alias("band"))


def resolve_limits(callers: DataFrame, users: DataFrame, overrides: DataFrame, tier_overrides: DataFrame) -> DataFrame:
    """(caller_id, uid, tier, max): a user's override, else the tier's override, else the tier's limit. Callers without uid
    are easy and get no override at all."""
    df = callers.join(users.select("uid", "tier"), "uid", "left").join(overrides.select("uid", F.col("max").alias("own")), "uid", "left")
    df = df.withColumn("tier", tier_of(F.col("tier"))).join(tier_overrides.select("tier", F.col("max").alias("wide")), "tier", "left")
    known = F.when(F.col("uid").isNotNull(), F.coalesce("own", "wide"))
    return df.select("caller_id", "uid", "tier", tier_limit(F.col("tier"), known).alias("max"))


def newest(facts: DataFrame, n: int, key: str | None = None, tie: str = "event_id") -> DataFrame:
    """The newest n rows, of each key where one is given."""
    if key is None:
        return facts.orderBy(F.desc("created_at"), F.desc(tie)).limit(n)
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc(tie))
    return facts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def daily(conversions: DataFrame, comparisons: DataFrame, uploads: DataFrame) -> DataFrame:
    """Six counters by UTC day, 0 where a day has none: conversions, comparisons, documents, charsProcessed,
    conversionErrors, documentErrors. Facts have created_at, conversions charCount and status, uploads extractionStatus."""
    zero = F.lit(0).cast("long")

    def part(facts: DataFrame, **given: Column) -> DataFrame:
        return facts.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), *[given.get(c, zero).cast("long").alias(c) for c in DAILY])

    one = F.lit(1)
    rows = part(conversions, conversions=one, charsProcessed=F.col("charCount"), conversionErrors=F.col("status") == "error")
    rows = rows.unionByName(part(comparisons, comparisons=one)).unionByName(part(uploads, documents=one, documentErrors=F.col("extractionStatus") == "error"))
    return rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in DAILY])


def last_days(rollup: DataFrame, n: int = 30, strict: bool = False) -> DataFrame:
    """The newest n days that exist, with their position from the oldest on. strict drops, after that, days without any of
    one counter, as stores that write only what they count do."""
    rows = rollup.orderBy(F.desc("day")).limit(n)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy("day")).cast("long"))  # n rows
    return rows.where(" and ".join(f"{c} > 0" for c in DAILY)) if strict else rows


def breakdown(facts: DataFrame, columns: list[str], total: Column) -> DataFrame:
    """(dimension, value, n, total) for each column by itself, in one pass with grouping sets."""
    df = facts.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), total.alias("total"))
    flag = lambda i: F.col("g") == ((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - i))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        name, value = F.when(flag(i), F.lit(c)).otherwise(name), F.when(flag(i), F.col(c).cast("string")).otherwise(value)
    return df.select(name.alias("dimension"), value.alias("value"), "n", "total")


def site_totals(conversions: DataFrame, comparisons: DataFrame, uploads: DataFrame, users: DataFrame, encodings: list[str]) -> DataFrame:
    """(dimension, value, n): totals (value all), and conversions by status and encoding, comparisons by mode, uploads by
    status and format, users by tier. Known values without rows have 0."""
    # each fact becomes a few counted cells, which partial aggregation takes in ahead of the shuffle
    def cells(facts: DataFrame, total: str, **by: str) -> DataFrame:
        made = [F.struct(F.lit(total).alias("dimension"), F.lit("all").alias("value"), F.lit(1).cast("long").alias("n"))]
        made += [F.struct(F.lit(name).alias("dimension"), F.col(c).alias("value"), F.lit(1).cast("long").alias("n")) for name, c in by.items()]
        if "charCount" in facts.columns:
            made.append(F.struct(F.lit("totalCharsProcessed").alias("dimension"), F.lit("all").alias("value"), F.col("charCount").alias("n")))
        return facts.select(F.explode(F.array(*made)).alias("c")).select("c.*")

    rows = cells(conversions, "totalConversions", conversionsByStatus="status", conversionsByEncoding="encodingId").unionByName(cells(comparisons, "totalComparisons", comparisonsByMode="mode"))
    rows = rows.unionByName(cells(uploads, "totalDocuments", documentsByStatus="extractionStatus", documentsByFormat="fileType")).unionByName(cells(users, "totalUsers", usersByTier="tier"))
    both = ["success", "error"]
    known = {"totalConversions": ["all"], "totalComparisons": ["all"], "totalDocuments": ["all"], "totalUsers": ["all"], "totalCharsProcessed": ["all"], "conversionsByStatus": both, "documentsByStatus": both, "comparisonsByMode": ["word", "paragraph"], "documentsByFormat": ["pdf", "docx", "doc", "txt"], "conversionsByEncoding": encodings, "usersByTier": [*TIERS]}
    zeros = conversions.sparkSession.createDataFrame([(d, v, 0) for d, values in known.items() for v in values], "dimension string, value string, n long")
    return rows.unionByName(zeros).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def tier_transfers(changes: DataFrame) -> DataFrame:
    """(tier, delta) of changes (old, new): one less, one more, nothing where they are equal."""
    moves = changes.where("old <> new").select(F.explode(F.array(F.struct(F.col("old").alias("tier"), F.lit(-1).alias("d")), F.struct(F.col("new").alias("tier"), F.lit(1).alias("d")))).alias("m"))
    return moves.groupBy("m.tier").agg(F.sum("m.d").alias("delta"))


def known_filter(value: str | None, allowed: tuple[str, ...]) -> str | None:
    """A filter's value, or no filter where the value is not known."""
    return value if value in allowed else None


def listing(rows: DataFrame, n: int, **filters: str | None) -> DataFrame:
    """The newest n rows that equal all given filters."""
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return newest(rows, n)


def error_summary(window: DataFrame, top: int = 12) -> DataFrame:
    """(section, name, n, rank) of the failures of one listed window (kind, severity, samples, occurrences, created_at,
    event_id): occurrences in all, by kind, by severity, and of the top samples, ties in the order of the listing."""
    n = F.sum("occurrences").alias("n")
    none = F.lit(None).cast("long").alias("rank")
    out = window.agg(F.coalesce(n, F.lit(0)).alias("n")).select(F.lit("total").alias("section"), F.lit("all").alias("name"), "n", none)
    for section, column in (("byKind", "kind"), ("bySeverity", "severity")):
        out = out.unionByName(window.groupBy(F.col(column).alias("name")).agg(n).select(F.lit(section).alias("section"), "name", "n", none))
    row = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("event_id")))  # the window is a bounded listing
    each = window.withColumn("row", row).select("row", "occurrences", F.posexplode("samples").alias("pos", "name"))
    each = each.groupBy("name").agg(n, F.min(F.struct("row", "pos")).alias("first"))
    ranked = each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long")).where(F.col("rank") <= top)
    return out.unionByName(ranked.select(F.lit("topSamples").alias("section"), "name", "n", "rank"))


def issue_key(*columns: str) -> Column:
    """Parts joined by |, nulls as empty; a | or backslash inside a part gets a backslash, so no two keys read alike.
    An array's values are joined by U+0001."""
    plain = lambda c: F.regexp_replace(c, r"([\\|])", r"\\$1")
    return F.concat_ws("|", *[F.coalesce(plain(F.col(c).cast("string")), F.lit("")) for c in columns])


def log_event(rows: OrderedDict, key: str, event: int, what: tuple, cap: int) -> None:
    """Puts an event into a log, oldest first: an issue that comes again counts up and goes last, a new one is put last, and
    beyond cap the first one is dropped."""
    if key in rows:
        n, first, _, *was = rows[key]
        rows[key] = (n + 1, first, event, *was)
        rows.move_to_end(key)
    else:
        rows[key] = (1, event, event, *what)
        if len(rows) > cap:
            rows.popitem(last=False)


def log_rows(log: str, rows: OrderedDict) -> list[tuple]:
    """Rows of LOG of a log, newest first."""
    return [(log, i, k, *r) for i, (k, r) in enumerate(reversed(rows.items()))]


LOG = "log string, position long, issue_key string, occurrences long, first_id long, last_id long, kind string, severity string, samples array<string>"


def issue_log(events: DataFrame, cap: int = 200) -> DataFrame:
    """Each log (log, issue_key, ts, event_id, kind, severity, samples) as its reader sees it at the end: an issue that comes
    again counts up and moves to the front, a new one is put at the front, and beyond cap the last one is dropped. Events
    without a log are left out.

    Events of a log stream through one task in order; it holds cap rows."""

    def run(batches):
        log, rows = None, OrderedDict()
        for b in batches:
            out = []
            for name, key, event, *what in zip(b["log"], b["issue_key"], b["event_id"], b["kind"], b["severity"], b["samples"], strict=True):
                if name != log:
                    out += log_rows(log, rows)
                    log, rows = name, OrderedDict()
                log_event(rows, key, event, tuple(what), cap)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])
        yield pd.DataFrame(log_rows(log, rows), columns=[c.split()[0] for c in LOG.split(", ")])

    rows = events.select(F.col("log").cast("string"), "issue_key", "ts", F.col("event_id").cast("long"), "kind", "severity", "samples")
    return rows.where("log is not null").repartition(F.xxhash64("log")).sortWithinPartitions("log", "ts", "event_id").mapInPandas(run, LOG)


def log_summary(rows: DataFrame) -> DataFrame:
    """(log, errors, warnings, samples) of the rows of logs: rows, not occurrences, and distinct unmapped samples from the
    front on. A log has a bounded number of rows."""
    unmapped = F.when(F.col("kind") == "unmapped_character", F.struct("position", "samples"))
    samples = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(unmapped)), lambda x: x["samples"])))
    return rows.groupBy("log").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"), samples.alias("samples"))


def users_rows(records: DataFrame, profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """(uid, email, displayName, tier, usageOverrideMaxChars) of records (uid, email, displayName): a valid profile's name
    and tier, else the record's name and easy; a valid override's limit, else null. A null name of a profile stays null."""
    p = schemas.valid(profiles, "users").select("uid", "tier", F.col("displayName").alias("own"), F.lit(True).alias("found"))
    o = schemas.valid(overrides, "usageOverrides").select("uid", F.col("maxNonWhitespaceChars").alias("usageOverrideMaxChars"))
    rows = records.join(p, "uid", "left").join(o, "uid", "left")
    name = F.when(F.col("found"), F.col("own")).otherwise(F.col("displayName"))
    return rows.select("uid", "email", name.alias("displayName"), F.coalesce("tier", F.lit("easy")).alias("tier"), "usageOverrideMaxChars")


def page(rows: DataFrame, key: str, after=None, size: int = 50) -> DataFrame:
    """The next size rows behind key after: what a page token stands for."""
    rows = rows if after is None else rows.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def merge_config(current: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with patches (key, and for a field it sends: sent_<field> and the value, null to clear)."""
    sent = patches.select(key, *[F.coalesce(f"sent_{f}", F.lit(False)).alias(f"__sent_{f}") for f in fields], *[F.col(f).alias(f"__new_{f}") for f in fields])
    rows = current.join(sent, key, "left")
    return rows.select(key, *[F.when(F.col(f"__sent_{f}"), F.col(f"__new_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def audit_events(changes: DataFrame, *more: str) -> DataFrame:
    """(actor, action, target, metadata) of admin changes (actor, uid, old_tier, tier, disabled, sent_override, override):
    null tier or disabled: not sent; a sent null override clears it. metadata is JSON. Columns in more are passed on."""
    uid = F.col("uid").cast("string")

    def event(when: Column, action: Column, target: str, metadata: Column) -> Column:
        return F.when(when, F.struct(action.alias("action"), F.concat(F.lit(target), uid).alias("target"), metadata.alias("metadata")))

    sent, cleared = F.coalesce("sent_override", F.lit(False)), F.col("override").isNull()
    made = F.array_compact(F.array(
        event(F.col("tier").isNotNull(), F.lit("user.tier.set"), "users/", F.to_json(F.struct(F.col("old_tier").alias("oldTier"), F.col("tier").alias("newTier")))),
        event(F.col("disabled").isNotNull(), F.when(F.col("disabled"), "user.disable").otherwise("user.enable"), "auth/", F.lit("{}")),
        event(sent, F.when(cleared, "user.usageOverride.clear").otherwise("user.usageOverride.set"), "usageOverrides/", F.when(cleared, F.lit("{}")).otherwise(F.to_json(F.struct(F.col("override").alias("maxNonWhitespaceChars"))))),
    ))
    return changes.select("actor", *more, F.explode(made).alias("e")).select("actor", *more, "e.*")


def config_audits(patches: DataFrame, fields: list[str]) -> DataFrame:
    """(actor, action, target, metadata) of patches of the settings (actor, and for a field sent_<field> and the value): the
    fields that were sent, as JSON, a cleared one as null."""
    value = lambda f: F.regexp_replace(F.to_json(F.struct(f), {"ignoreNullFields": "false"}), r"^\{|\}$", "")
    shown = [F.when(F.coalesce(f"sent_{f}", F.lit(False)), value(f)) for f in fields]
    metadata = F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}"))
    return patches.select("actor", F.lit("config.update").alias("action"), F.lit("systemConfig/limits").alias("target"), metadata.alias("metadata"))


def feedback_audits(patches: DataFrame) -> DataFrame:
    """(actor, at, seq, action, target, metadata) of patches of feedback (actor, id, status, sent_note, at, seq)."""
    metadata = F.to_json(F.struct("status", F.coalesce("sent_note", F.lit(False)).alias("noteChanged")), {"ignoreNullFields": "false"})
    return patches.select("actor", "at", "seq", F.lit("feedback.update").alias("action"), F.concat(F.lit("feedback/"), F.col("id").cast("string")).alias("target"), metadata.alias("metadata"))


def patch_feedback(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Valid feedback rows with patches (id, status, sent_note, adminNote): a null status keeps, an unsent note keeps, a sent
    null clears, any other note is cut to 1000 characters. Unpatched rows stay as they are."""
    p = patches.select("id", F.col("status").alias("__status"), F.coalesce("sent_note", F.lit(False)).alias("__sent"), F.substring("adminNote", 1, 1000).alias("__note"))
    joined = rows.join(p, "id", "left")
    return joined.select(*[c for c in rows.columns if c not in ("status", "adminNote")], F.coalesce("__status", "status").alias("status"), F.when(F.col("__sent"), F.col("__note")).otherwise(F.col("adminNote")).alias("adminNote"))


def upsert_profiles(writes: DataFrame) -> DataFrame:
    """(uid, tier, createdAt, updatedAt, writes) of a log of profile writes (uid, tier, created_at, event_id): the last write
    wins, the first one's time stays."""
    order = F.struct("created_at", "event_id")
    return writes.groupBy("uid").agg(F.max_by("tier", order).alias("tier"), F.min("created_at").alias("createdAt"), F.max("created_at").alias("updatedAt"), F.count("*").alias("writes"))


def history(n: int, **lists: DataFrame) -> DataFrame:
    """The newest n of each user's lists (userId, created_at, event_id), tagged by list."""
    out = None
    for name, rows in lists.items():
        part = newest(rows, n, "userId").select(F.lit(name).alias("list"), "userId", "event_id", F.col("rn").cast("long").alias("rn"))
        out = part if out is None else out.unionByName(part)
    return out


def client_key(route: str, uid: Column, forwarded: Column, real: Column) -> Column:
    """Rate-limit key of a request: the user's, else that of the first forwarded address, the real one, or unknown."""
    ip = F.when(F.length(forwarded) > 0, F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).when(F.length(real) > 0, F.trim(real)).otherwise("unknown")
    return F.when(uid.isNotNull(), F.concat(F.lit(f"{route}:uid:"), uid)).otherwise(F.concat(F.lit(f"{route}:ip:"), ip))


def merge_issues(events: DataFrame, key: Column) -> DataFrame:
    """One row for each key: occurrences, first and last time."""
    return events.groupBy(key.alias("issue_key")).agg(F.count("*").alias("occurrences"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def first_occurrences(events: DataFrame, key: Column, tie: str = "event_id") -> DataFrame:
    w = Window.partitionBy("issue_key").orderBy("created_at", tie)
    return events.withColumn("issue_key", key).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def clamp_error(message: Column, samples: Column, occurrences: Column) -> list[Column]:
    """Stored form of a failure: 500 characters, 20 samples of 60, one occurrence unless told otherwise."""
    return [F.substring(message, 1, 500).alias("message"), F.transform(F.slice(samples, 1, 20), lambda x: F.substring(x, 1, 60)).alias("samples"), F.coalesce(occurrences, F.lit(1)).cast("long").alias("occurrences")]


def http_status(code: Column) -> Column:
    out = F.lit(500)
    for c, n in STATUS.items():
        out = F.when(code == c, n).otherwise(out)
    return out
