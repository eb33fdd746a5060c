"""Uploads as a batch: checked, stored, entered as submissions and queued for analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.service import checked_uploads
from ..storage import stored
from .files import object_keys, write_objects


def ingest(uploads: DataFrame, submissions: DataFrame, users: DataFrame, root: str) -> DataFrame:
    """uploads (id, user_id, mode, name1, content1, name2, content2, created_at): (id, user_id, code, error) of each.

    Accepted ones have their files in root/objects, a row in root/submissions and the state pending in root/status, all
    appended. submissions and users are what checked_uploads asks for. The batch is written once before, so a lost executor
    repeats no part of it; a batch that fails as a whole can leave files behind, but no submission without its files.
    """
    sized = uploads.withColumns({f"size{i}": F.octet_length(f"content{i}").cast("long") for i in (1, 2)})
    checked = stored(checked_uploads(sized, submissions, users))
    accepted = checked.filter("code is null")
    sides = [accepted.select("user_id", F.col(f"name{i}").alias("name"), F.col(f"content{i}").alias("content")) for i in (1, 2)]
    write_objects(sides[0].unionByName(sides[1]), f"{root}/objects")
    paths = {f"file{i}_path": object_keys(F.col("user_id"), F.col(f"name{i}"), F.col(f"content{i}")) for i in (1, 2)}
    rows = accepted.withColumns(paths).select("id", "user_id", "mode", F.col("name1").alias("file1_name"), F.col("name2").alias("file2_name"), "file1_path", "file2_path", "created_at")
    rows.write.mode("append").parquet(f"{root}/submissions")
    states = accepted.select(F.col("id").alias("submission_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("created_at").alias("ts"))
    states.write.mode("append").parquet(f"{root}/status")
    return checked.select("id", "user_id", "code", "error")
