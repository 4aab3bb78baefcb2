"""The collections as stored tables: records under ids of their content, profiles, limits, feedback, audits, counters.

Every function takes a frame of requests and applies it as one batch. With a writer's name and a batch number a batch that
is sent again after a failure changes nothing: each table keeps the last number of each writer, and counters and audits,
which follow from what is stored before a change, are committed ahead of the tables that they describe. One writer at a
time changes profiles; tables as such stand concurrent writers. Requests are ordered by (at, seq); at is an ISO time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage.tables import StoredTable
from . import activity as act
from . import schemas

#: What a request is refused with.
NOTHING, OWN_ACCOUNT, BAD_CHANGE, GONE = "Nothing to update.", "You cannot disable your own account.", "Invalid user update.", "That feedback entry no longer exists."
UNREADABLE = "Your account profile could not be read."


def content_id(fields: list[str]) -> Column:
    """Names a record by its fields: equal records have equal ids, nulls told apart from absent text."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def increments(conversions: DataFrame | None = None, comparisons: DataFrame | None = None, uploads: DataFrame | None = None) -> DataFrame:
    """(name, scope, counter, n) of facts: four counters of each user, the site's totals and breakdowns, six of each UTC day.
    Facts have userId and createdAt; conversions charCount, status and encodingId; comparisons mode; uploads
    extractionStatus and fileType."""
    one = F.lit(1).cast("long")

    def cells(facts: DataFrame | None, user: dict, site: dict, day: dict) -> list[DataFrame]:
        if facts is None:
            return []
        at = F.substring("createdAt", 1, 10)
        made = [(F.col("userId"), "user", c, n) for c, n in user.items()] + [(F.lit("all"), "site", c, n) for c, n in user.items()]
        made += [(F.col(column), "site", c, one) for c, column in site.items()] + [(at, "day", c, n) for c, n in day.items()]
        rows = [F.struct(name.cast("string").alias("name"), F.lit(scope).alias("scope"), F.lit(c).alias("counter"), n.cast("long").alias("n")) for name, scope, c, n in made]
        return [facts.select(F.explode(F.array(*rows)).alias("c")).select("c.*").where("n <> 0")]

    failed = lambda c: (F.col(c) == "error").cast("long")
    chars = F.col("charCount") if conversions is not None else None
    parts = cells(conversions, {"totalConversions": one, "totalCharsProcessed": chars}, {"conversionsByStatus": "status", "conversionsByEncoding": "encodingId"}, {"conversions": one, "charsProcessed": chars, "conversionErrors": conversions is not None and failed("status")})
    parts += cells(comparisons, {"totalComparisons": one}, {"comparisonsByMode": "mode"}, {"comparisons": one})
    parts += cells(uploads, {"totalDocuments": one}, {"documentsByStatus": "extractionStatus", "documentsByFormat": "fileType"}, {"documents": one, "documentErrors": uploads is not None and failed("extractionStatus")})
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Stores:
    """Tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.users = self._table("users", "uid string, email string, displayName string, tier string, createdAt string", "uid")
        self.accounts = self._table("accounts", "uid string, disabled boolean", "uid")
        self.overrides = self._table("usageOverrides", "uid string, maxNonWhitespaceChars long, updatedAt string, updatedBy string", "uid")
        self.audit = self._table("auditLogs", "id string, actorUid string, action string, target string, metadata string, createdAt string", "id")
        self.counters = self._table("counters", "name string, scope string, counter string, n long", "name", "scope", "counter")
        self.feedback = self._table("feedback", "id string, userId string, email string, category string, rating long, message string, page string, encodingId string, sampleInput string, sampleOutput string, status string, adminNote string, createdAt string, updatedAt string", "id")

    def _table(self, name: str, columns, *keys: str) -> StoredTable:
        return StoredTable(self.spark, f"{self.root}/{name}", columns, keys)

    # --- records

    def record(self, rows: DataFrame, collection: str, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Stores the valid rows, equal ones once, under ids of their content, so that a rerun stores nothing twice; returns
        the others with their issues."""
        fields = [f.name for f in schemas.COLLECTIONS[collection]]
        made = schemas.valid(rows, collection).select(content_id(fields).alias("id"), *fields)
        self.records(collection, made.schema).insert(made, writer, batch)
        return rows.withColumn("issues", schemas.issues(collection)).where(F.size("issues") > 0)

    def records(self, collection: str, columns="id string, userId string") -> StoredTable:
        """The table of a collection of records, those of a user together, newest first; columns matter before its first
        commit only."""
        owned = any(f.name == "userId" for f in schemas.COLLECTIONS[collection])
        table = self._table(f"records/{collection}", columns, *(("userId", "id") if owned else ("id",)))
        table.order = (F.desc("createdAt"),) if owned else ()
        return table

    def history(self, collection: str, uid: str, n: int = 20) -> DataFrame:
        """The newest n records of a user, the valid ones of them: read from the files, and the row groups of those, whose
        range holds the user."""
        newest = self.records(collection).lookup(uid).orderBy(F.desc("createdAt"), F.desc("id")).limit(n)
        return schemas.valid(newest, collection)

    def count(self, facts: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Adds increments to the counters."""
        return self.counters.add(facts, ("n",), writer, batch)

    def totals(self) -> DataFrame:
        """(dimension, value, n): the site's counters."""
        return self.counters.read().where("scope = 'site'").select(F.col("counter").alias("dimension"), F.col("name").alias("value"), "n")

    def days(self) -> DataFrame:
        """Six counters by day, 0 where a day has none."""
        rows = self.counters.read().where("scope = 'day'")
        return rows.groupBy(F.col("name").alias("day")).agg(*[F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in act.DAILY])

    def of_user(self, uid: str) -> DataFrame:
        """(counter, n) of one user, from the files whose range holds it."""
        return self.counters.lookup(uid).where("scope = 'user'").select("counter", "n")

    # --- profiles

    def profiles(self, uids: DataFrame) -> DataFrame:
        """(uid, email, displayName, tier, createdAt, error) of uids (uid): easy and nulls without a profile, an error code
        where the stored one is invalid."""
        stored = self.users.read().withColumns({"__there": F.lit(True), "__ok": F.size(schemas.issues("users")) == 0})
        rows = uids.select("uid").distinct().join(stored, "uid", "left")
        ok = F.coalesce("__ok", F.lit(False))
        tier = F.when(ok, F.col("tier")).when(F.col("__there").isNull(), "easy")
        return rows.select("uid", *[F.when(ok, F.col(c)).alias(c) for c in ("email", "displayName")], tier.alias("tier"), F.when(ok, F.col("createdAt")).alias("createdAt"), F.when(~F.col("__ok"), "DATABASE_ERROR").alias("error"))

    def _transfers(self, moves: DataFrame) -> DataFrame:
        """Increments of moves (old, tier); a null old is a new user."""
        cell = lambda name, counter, n: F.struct(name.alias("name"), F.lit("site").alias("scope"), F.lit(counter).alias("counter"), F.lit(n).cast("long").alias("n"))
        old, new = F.col("old"), F.col("tier")
        made = F.array_compact(F.array(F.when(old.isNull(), cell(F.lit("all"), "totalUsers", 1)), F.when(~old.eqNullSafe(new), cell(new, "usersByTier", 1)), F.when(old != new, cell(old, "usersByTier", -1))))
        return moves.select(F.explode(made).alias("c")).select("c.*")

    def _stored(self) -> DataFrame:
        return schemas.valid(self.users.read(), "users")

    def set_tiers(self, writes: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Users set their own tier: writes (uid, email, displayName, tier, at, seq). The last write of a user counts; a
        valid profile keeps its name and its createdAt, another gets the write's. Returns writes of no known tier."""
        order = F.struct("at", "seq")
        good = writes.where(F.col("tier").isin(*act.TIERS))
        last = good.groupBy("uid").agg(F.max_by(F.struct("email", "displayName", "tier"), order).alias("w"), F.min("at").alias("first"))
        was = self._stored().select("uid", F.struct("displayName", "tier", "createdAt").alias("was"))
        rows = last.join(was, "uid", "left")
        self.count(self._transfers(rows.select(F.col("was.tier").alias("old"), F.col("w.tier").alias("tier"))), writer, batch)
        name = F.when(F.col("was").isNull(), F.col("w.displayName")).otherwise(F.col("was.displayName"))
        made = rows.select("uid", F.col("w.email").alias("email"), name.alias("displayName"), F.col("w.tier").alias("tier"), F.coalesce("was.createdAt", "first").alias("createdAt"))
        self.users.upsert(made, writer=writer, batch=batch)
        return writes.where(~F.coalesce(F.col("tier").isin(*act.TIERS), F.lit(False)))

    def change_users(self, changes: DataFrame, records: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Admins change users: changes (actor, uid, tier, disabled, sent_override, override, at, seq); null tier or
        disabled: not sent; a sent null override clears it. Tier, state and limit change each on its own, with an audit
        entry each and counters of tiers. records (uid, email, displayName) name users without a valid profile. Returns the
        refused changes with a message."""
        sent = F.coalesce("sent_override", F.lit(False))
        message = F.when(F.coalesce(~F.col("tier").isin(*act.TIERS), F.lit(False)) | (sent & F.coalesce(F.col("override") <= 0, F.lit(False))), BAD_CHANGE)
        message = message.when(F.col("tier").isNull() & F.col("disabled").isNull() & ~sent, NOTHING).when(F.coalesce(F.col("disabled"), F.lit(False)) & (F.col("actor") == F.col("uid")), OWN_ACCOUNT)
        marked = changes.withColumn("message", message)
        good = marked.where("message is null").drop("message")
        was = self._stored().select("uid", F.struct("email", "displayName", "tier", "createdAt").alias("was"))
        each = Window.partitionBy("uid").orderBy("at", "seq")
        before = F.last("tier", ignorenulls=True).over(each.rowsBetween(Window.unboundedPreceding, -1))
        events = good.join(was, "uid", "left").withColumn("old_tier", F.coalesce(before, "was.tier", F.lit("easy")))
        self._audit(act.audit_events(events.withColumn("uid", F.col("uid").cast("string")), "at", "seq"), writer, batch)
        tiers = good.where("tier is not null").groupBy("uid").agg(F.max_by("tier", F.struct("at", "seq")).alias("tier"), F.min("at").alias("first")).join(was, "uid", "left")
        self.count(self._transfers(tiers.select(F.coalesce("was.tier", F.lit("easy")).alias("old"), "tier")), writer, batch)
        named = tiers.join(records.select("uid", F.struct("email", "displayName").alias("record")), "uid", "left")
        own = lambda c: F.when(F.col("was").isNull(), F.col(f"record.{c}")).otherwise(F.col(f"was.{c}")).alias(c)
        self.users.upsert(named.select("uid", own("email"), own("displayName"), "tier", F.coalesce("was.createdAt", "first").alias("createdAt")), writer=writer, batch=batch)
        state = good.where("disabled is not null").groupBy("uid").agg(F.max_by("disabled", F.struct("at", "seq")).alias("disabled"))
        self.accounts.upsert(state, writer=writer, batch=batch)
        limit = good.where(sent).groupBy("uid").agg(F.max_by(F.struct(F.col("override").cast("long").alias("maxNonWhitespaceChars"), F.col("at").alias("updatedAt"), F.col("actor").alias("updatedBy")), F.struct("at", "seq")).alias("w"))
        self.overrides.merge(limit.select("uid", "w.*"), lambda old, new: new.where("maxNonWhitespaceChars is not null"), writer, batch)
        return marked.where("message is not null")

    def _audit(self, events: DataFrame, writer: str | None, batch: int | None) -> None:
        fields = ["actorUid", "action", "target", "metadata", "createdAt"]
        rows = events.select(F.col("actor").cast("string").alias("actorUid"), "action", "target", "metadata", F.col("at").alias("createdAt"), "seq")
        self.audit.insert(rows.select(content_id([*fields, "seq"]).alias("id"), *fields), writer, batch)

    # --- feedback and settings

    def triage(self, patches: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Patches feedback: (actor, id, status, sent_note, adminNote, at, seq), of several for an entry each in order; null
        status and an unsent note keep, a sent null clears. Returns the patches of entries that are gone or invalid."""
        there = schemas.valid(self.feedback.read(), "feedback").select("id")
        good = patches.join(there, "id", "left_semi")
        noted = F.when(F.coalesce("sent_note", F.lit(False)), F.struct("adminNote"))
        order = F.struct("at", "seq")
        last = good.groupBy("id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("status"), F.max_by(noted, F.when(noted.isNotNull(), order)).alias("noted"), F.max("at").alias("at"))
        last = last.select("id", "status", F.col("noted").isNotNull().alias("sent_note"), "noted.adminNote", F.col("at").alias("updatedAt"))
        self._audit(act.feedback_audits(good), writer, batch)

        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            return act.patch_feedback(old.drop("updatedAt"), new).join(new.select("id", "updatedAt"), "id")

        gone = patches.join(there, "id", "left_anti")
        self.feedback.merge(last, rule, writer, batch)
        return gone.withColumn("message", F.lit(GONE))


def read_or_empty(read, columns: str, spark: SparkSession) -> DataFrame:
    """read(), or no rows of the given columns where its table cannot be found or understood: one list that fails leaves the
    others as they are."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], columns)
