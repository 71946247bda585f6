"""Work queue and watch list as relations: states, bulk changes, retention, due watches, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.rules import STATUSES
from litmill.operators.ordering import numbered

TERMINAL = ("completed", "failed", "cancelled")


def recovered(tasks: DataFrame) -> DataFrame:
    """After a restart: what was running is pending again."""
    return tasks.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def summary(tasks: DataFrame) -> DataFrame:
    """(status, n) of all five statuses, zeros included; others are left out."""
    dim = tasks.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return dim.join(tasks.groupBy("status").agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


def listed(tasks: DataFrame, limit: int = 200) -> DataFrame:
    """The newest tasks first."""
    return tasks.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, limit))


def next_pending(tasks: DataFrame) -> DataFrame:
    """The oldest pending task that nobody asked to cancel, now running."""
    return tasks.where((F.col("status") == "pending") & ~F.col("cancel_requested")).orderBy("created_at", "id").limit(1).withColumn("status", F.lit("running"))


def cancel_all_pending(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status") == "pending", "cancelled").otherwise(F.col("status")))


def request_cancel(tasks: DataFrame, which: Column) -> DataFrame:
    """Pending tasks are cancelled at once, running ones flagged."""
    return tasks.withColumns({
        "cancel_requested": F.col("cancel_requested") | (which & (F.col("status") == "running")),
        "status": F.when(which & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")),
    })


def retry_failed(tasks: DataFrame, include_cancelled: bool = False) -> DataFrame:
    """New pending tasks for the failed ones, one retry more."""
    take = F.col("status") == "failed"
    if include_cancelled:
        take |= F.col("status") == "cancelled"
    t = tasks.where(take)
    return t.select(F.concat(F.lit("retry-"), F.col("id").cast("string")).alias("id"), F.lit("pending").alias("status"), (F.coalesce("retries", F.lit(0)) + 1).alias("retries"), F.concat(F.lit("Bulk retry from task "), F.substring(F.col("id").cast("string"), 1, 8), F.lit(".")).alias("message"))


def prune_terminal(tasks: DataFrame, keep: int = 200) -> DataFrame:
    """All open tasks and the newest terminal ones, at least ten of them."""
    done = F.col("status").isin(*TERMINAL)
    newest = tasks.where(done).orderBy(F.desc("updated_at"), F.desc("id")).limit(max(10, keep))
    return tasks.where(~done).unionByName(newest)


def history_ring(events: DataFrame, n: int = 100) -> DataFrame:
    """The last n entries, in order."""
    return events.orderBy(F.desc("seq")).limit(n)


def normalize_watch(watches: DataFrame) -> DataFrame:
    """Unknown kinds become the defaults; an author watch at arXiv asks for the author field."""
    c = lambda col, words, default: F.when(F.col(col).isin(*words), F.col(col)).otherwise(F.lit(default))
    w = watches.withColumns({"watch_type": c("watch_type", ("keyword", "author"), "keyword"), "source": c("source", ("arxiv", "semanticscholar", "nber", "ssrn", "google_scholar"), "arxiv"), "frequency": c("frequency", ("daily", "weekly"), "daily")})
    return w.withColumn("search", F.when((F.col("watch_type") == "author") & (F.col("source") == "arxiv"), F.concat(F.lit('au:"'), F.col("query"), F.lit('"'))).otherwise(F.col("query")))


def due(watches: DataFrame, now: Column) -> DataFrame:
    """Enabled watches whose time has come (an empty time is now), with their next time."""
    w = watches.where(F.col("enabled") & (F.coalesce("next_run", now) <= now))
    return w.withColumn("next_run", F.when(F.col("frequency") == "weekly", now + F.expr("INTERVAL 7 DAYS")).otherwise(now + F.expr("INTERVAL 1 DAY")))


def digest(due_: DataFrame, found: DataFrame) -> DataFrame:
    """(id, line_no, line): the digest of each due watch from its new results (id, ord, title), ord being unique within id.

    Line 0 is the heading with the number of results; the results follow in the order of ord. A
    watch may have any number of them: lines are numbered across tasks and never gathered.
    """
    mine = found.join(due_.select("id"), "id", "left_semi")
    count = mine.groupBy("id").agg(F.count("*").alias("n"))
    title = F.concat(F.lit("## "), F.col("query"), F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" new)"))
    heads = due_.join(count, "id", "left").select("id", F.lit(0).alias("line_no"), title.alias("line"))
    lines = numbered(mine, "id", "ord", "line_no").select("id", "line_no", F.concat(F.lit("- "), F.coalesce("title", F.lit("Unknown"))).alias("line"))
    return heads.unionByName(lines)


def last_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The latest event of each task: the batch form of its state machine."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("s")).select(key, "s.*")
