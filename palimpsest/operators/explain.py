"""Explanations of changes, checked before anyone reads them: replies, references, coverage. No model is called here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPLY = "array<struct<change_id: bigint, statement: string, refs: array<bigint>>>"


def statements(replies: DataFrame, changes: DataFrame) -> DataFrame:
    """(batch, problem, place, change_id, statement, refs): the statements of replies (batch, reply), one row each.

    A reply that is no JSON list, or that names a change its batch doesn't have, is refused whole: one row with problem unreadable or
    unknown_change and no statement. changes: (batch, change_id).
    """
    read = replies.select("batch", F.from_json("reply", REPLY).alias("items"))
    refused = read.where("items is null").select("batch", F.lit("unreadable").alias("problem"))
    one = read.select("batch", F.posexplode("items").alias("place", "item")).select("batch", "place", "item.*")
    known = changes.select("batch", "change_id").distinct()
    wrong = one.join(known, ["batch", "change_id"], "left_anti").select("batch", F.lit("unknown_change").alias("problem")).distinct()
    good = one.join(wrong, "batch", "left_anti").withColumn("problem", F.lit(None).cast("string"))
    return good.unionByName(refused.unionByName(wrong), allowMissingColumns=True).select("batch", "problem", "place", "change_id", "statement", "refs")


def references(said: DataFrame, evidence: DataFrame) -> DataFrame:
    """said (change_id, place, statement, refs) with problem: no_reference, foreign_reference (evidence of another change, or none), duplicate (the
    statement was made before for its change), or null. evidence: (ref, change_id), a ref being of one change."""
    ref = said.select("change_id", "place", F.explode(F.array_distinct("refs")).alias("ref"))
    foreign = ref.join(evidence.select("ref", "change_id"), ["ref", "change_id"], "left_anti").select("change_id", "place", F.lit(True).alias("_foreign")).distinct()
    again = F.row_number().over(Window.partitionBy("change_id", F.lower(F.trim("statement"))).orderBy("place")) > 1
    problem = F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "no_reference").when(F.col("_foreign"), "foreign_reference").when(F.col("_again"), "duplicate")
    return said.withColumn("_again", again).join(foreign, ["change_id", "place"], "left").withColumn("problem", problem).drop("_again", "_foreign")


def coverage(changes: DataFrame, explained: DataFrame, by: str) -> DataFrame:
    """(by, n_changes, n_explained, status): complete, partial, none or nothing_to_explain. changes: (by, change_id, noise); noise needs no words."""
    told = explained.select("change_id").distinct().withColumn("_told", F.lit(1))
    need = (~F.coalesce("noise", F.lit(False))).cast("int")
    n = changes.join(told, "change_id", "left").groupBy(by).agg(F.sum(need).alias("n_changes"), F.sum(need * F.coalesce("_told", F.lit(0))).alias("n_explained"))
    status = F.when(F.col("n_changes") == 0, "nothing_to_explain").when(F.col("n_explained") == 0, "none").when(F.col("n_explained") < F.col("n_changes"), "partial").otherwise("complete")
    return n.withColumn("status", status)


def since_baseline(captures: DataFrame, by: str, at: list[str], value: str) -> DataFrame:
    """captures with state: first, unchanged or changed against the capture before it of the same page, and before, its value."""
    w = Window.partitionBy(by).orderBy(*at)
    rank = F.row_number().over(w)
    before = F.lag(value).over(w)
    return captures.withColumns({"before": before, "state": F.when(rank == 1, "first").when(before.eqNullSafe(F.col(value)), "unchanged").otherwise("changed")})
