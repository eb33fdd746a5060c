"""Service queries over users, submissions and reports: history, quota, status, report detail, deletion, validation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Filters, page size, submissions a day, bytes of a file, length of an error.
RISKS, MODES, PAGE_SIZE, DAILY_LIMIT, MAX_BYTES, MAX_ERROR = ("LOW", "MEDIUM", "HIGH"), ("text", "code"), 8, 5, 10 * 1024 * 1024, 1024
#: File kinds by mode.
TEXT_FILES, CODE_FILES = (".txt", ".pdf", ".docx"), (".py", ".java", ".cpp", ".c", ".js", ".ts", ".cs", ".go", ".rb")


def history(submissions: DataFrame, reports: DataFrame, user_id: int | None = None, mode: str | None = None, risk: str | None = None) -> DataFrame:
    """Submissions with their report's scores, null where there is none; unknown filter values are ignored."""
    conditions = [F.lit(True)]
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if mode in MODES:
        conditions.append(F.col("mode") == mode)
    rep = reports.select(F.col("submission_id").alias("id"), "final_similarity", "risk_level", "language")
    if risk in RISKS:  # only then submissions without a report drop out
        rep, how = rep.filter(F.col("risk_level") == risk), "inner"
    else:
        how = "left"
    return submissions.filter(reduce(and_, conditions)).join(rep, "id", how)


def page(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE, newest_first: bool = True) -> DataFrame:
    """One page by creation time; ties go to the smaller id."""
    if number < 1 or not 1 <= size <= 50:
        raise ValueError("page from 1, size from 1 to 50")
    order = F.desc("created_at") if newest_first else F.asc("created_at")
    return rows.orderBy(order, "id").offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int = PAGE_SIZE) -> Column:
    return F.greatest(F.ceil(total / size), F.lit(1))


def page_span(total: Column, number: Column, size: int = PAGE_SIZE) -> Column:
    """(page, from, to): a page number within the pages there are, and its rows' numbers from 1; 0 to 0 if there are none."""
    page = F.least(F.greatest(number, F.lit(1)), page_count(total, size))
    first = F.when(total == 0, 0).otherwise((page - 1) * size + 1)
    return F.struct(page.cast("long").alias("page"), first.cast("long").alias("from"), F.least(page * size, total).cast("long").alias("to"))


def submission(submissions: DataFrame, submission_id: int, user_id: int) -> DataFrame:
    """The submission of that id, if it is the user's."""
    return submissions.filter((F.col("id") == submission_id) & (F.col("user_id") == user_id))


def history_count(submissions: DataFrame, reports: DataFrame, **filters) -> DataFrame:
    """(total, pages) of a history."""
    return history(submissions, reports, **filters).agg(F.count("*").alias("total")).withColumn("pages", page_count(F.col("total")))


def daily_quota(submissions: DataFrame, users: DataFrame | None = None, limit: int = DAILY_LIMIT) -> DataFrame:
    """(user_id, day, n, blocked): submissions a user and UTC day; users of the plan pro are never blocked."""
    out = submissions.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    blocked = F.col("n") >= limit
    if users is not None:
        out = out.join(users.select(F.col("id").alias("user_id"), "plan"), "user_id", "left")
        blocked = blocked & (F.coalesce("plan", F.lit("free")) != "pro")
    return out.select("user_id", "day", "n", blocked.alias("blocked"))


def latest_status(events: DataFrame) -> DataFrame:
    """The newest status event of each submission (submission_id, status, ts, error_message), with a message."""
    last = events.groupBy("submission_id").agg(F.max_by(F.struct("status", "error_message", "ts"), F.struct("ts", "status")).alias("e")).select("submission_id", "e.*")
    return last.withColumn("message", status_message(F.col("status"), F.col("error_message")))


def status_message(status: Column, error: Column) -> Column:
    #: What users read.
    pending, processing, completed = "Your submission is queued for analysis.", "Analysis is in progress. This may take a moment.", "Analysis complete. Your report is ready."
    failed = F.concat(F.lit("Analysis failed: "), F.coalesce(F.nullif(error, F.lit("")), F.lit("Unknown error")))
    return F.when(status == "pending", pending).when(status == "processing", processing).when(status == "completed", completed).when(status == "failed", failed)


#: The states that may follow each state; a submission begins as pending.
NEXT = {"pending": ("processing",), "processing": ("completed", "failed"), "completed": (), "failed": ()}


def status_events(changes: DataFrame, current: DataFrame) -> DataFrame:
    """changes (submission_id, status, error_message, ts) that may follow the current (submission_id, status), as rows to append.

    Errors are cut to MAX_ERROR characters and kept for failures only. Changes out of turn, and of unknown submissions
    except to pending, are left out.
    """
    now = current.select(F.col("submission_id"), F.col("status").alias("now"))
    both = changes.join(now, "submission_id", "left")
    allowed = F.col("now").isNull() & (F.col("status") == "pending")
    for state, following in NEXT.items():
        allowed = allowed | (F.col("now") == state) & F.col("status").isin(*following)
    error = F.when(F.col("status") == "failed", F.substring("error_message", 1, MAX_ERROR))
    return both.filter(allowed).select("submission_id", "status", error.alias("error_message"), "ts")


def checked_uploads(uploads: DataFrame, submissions: DataFrame, users: DataFrame, limit: int = DAILY_LIMIT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """uploads (id, user_id, mode, name1, size1, name2, size2, created_at) with code and error; both are null if accepted.

    In this order: 422 for an unknown mode, 429 from the user's submission number limit + 1 of the day on (those of
    submissions and earlier ones of the batch count; not for the plan pro), 422 for a file of another kind, 413 for one
    that is too large.
    """
    day = F.to_date("created_at")
    before = submissions.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("before"))
    valid = F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    turn = F.sum(valid.cast("int")).over(Window.partitionBy("user_id", day).orderBy("created_at", "id"))
    rows = uploads.withColumn("turn", turn).withColumn("day", day).join(before, ["user_id", "day"], "left")
    rows = rows.join(users.select(F.col("id").alias("user_id"), "plan"), "user_id", "left")
    full = (F.coalesce("plan", F.lit("free")) != "pro") & (F.coalesce("before", F.lit(0)) + F.col("turn") > limit)
    kind = accepted(F.col("name1"), F.col("mode")) & accepted(F.col("name2"), F.col("mode"))
    large = F.greatest("size1", "size2") > max_bytes
    refused = lambda code, why: F.struct(F.lit(code).alias("code"), F.lit(why).alias("error"))
    error = F.when(~valid, refused(422, "unknown mode")).when(full, refused(429, "daily limit reached")).when(~kind, refused(422, "file type not allowed")).when(large, refused(413, "file too large"))
    return rows.withColumn("e", error).select(*uploads.columns, F.col("e.code").alias("code"), F.col("e.error").alias("error"))


def report_detail(submissions: DataFrame, reports: DataFrame, submission_id: int | None = None) -> DataFrame:
    """Each submission with its report as nested scores, whatever its status."""
    rows = submissions if submission_id is None else submissions.filter(F.col("id") == submission_id)
    scores = F.struct(*[F.col(f"{s}_score").alias(s) for s in ("jaccard", "cosine", "lcs", "winnowing", "ast")]).alias("scores")
    return rows.join(reports.select(F.col("submission_id").alias("id"), "language", scores, "final_similarity", "risk_level"), "id", "left")


def users_with_submissions(users: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each user with the number and the first and last times of their submissions."""
    each = submissions.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_submissions"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return users.join(each, "id", "left").fillna(0, ["n_submissions"])


def without_submissions(submissions: DataFrame, reports: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids in gone(id): deletion with its cascade, as a rewrite."""
    return submissions.join(gone, "id", "left_anti"), reports.join(gone.select(F.col("id").alias("submission_id")), "submission_id", "left_anti")


def extension(path: Column) -> Column:
    """From the last dot of the file's name on; dots that a name begins with begin no extension."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*?(\.[^./]*)$", 1))


def accepted(path: Column, mode: Column) -> Column:
    ext = extension(path)
    return F.when(mode == "text", ext.isin(*TEXT_FILES)).when(mode == "code", ext.isin(*CODE_FILES)).otherwise(False)


def password_ok(p: Column) -> Column:
    return F.length(p).between(8, 128) & p.rlike("[A-Z]") & p.rlike("[0-9]")


def name_ok(n: Column) -> Column:
    return F.length(F.trim(n)).between(2, 100)


def percent_label(score: Column) -> Column:
    return F.format_number(score * 100, 1)


def bar_colour(score: Column) -> Column:
    """By whole percent, so it may differ from the risk level just under its limits."""
    whole = F.floor(score * 100 + 0.5)
    return F.when(whole >= 50, "red").when(whole >= 30, "yellow").otherwise("green")


def rate_windows(events: DataFrame, limit: int = 20, width: str = "1 minute", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, n, over): events in tumbling windows."""
    out = events.groupBy(F.col(key), F.window(F.col(ts), width).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))
