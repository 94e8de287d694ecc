"""Review actions on fixes: what each action did, and the state left behind.

The rules form a small state machine per error id. It is expressed by running values and aggregates, so that the
actions of one busy error need not sit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .blocked import carry_forward
from .shared import settle

KEY = ["error_id"]


def review_outcomes(actions: DataFrame, records: DataFrame) -> DataFrame:
    """Per action its `outcome` and, for approved and edited, the fix text that was saved.

    `actions(error_id, seq, kind 'button'|'reply', action, user_id, channel_id, thread_ts, text)`,
    `records(error_id, error, fix, channel_id, message_ts)`.
    """
    button, act = F.col("kind") == "button", F.col("action")
    known = records.select("error_id", F.col("error").alias("_error"), F.col("fix").alias("_fix"),
                           F.col("message_ts").alias("_thread"), F.col("channel_id").alias("_channel"))
    removed = actions.filter(button & (act == "discard")).groupBy("error_id").agg(F.min("seq").alias("_removed"))
    joined = actions.join(known, KEY, "left").join(removed, KEY, "left")
    present = (F.length("_error") > 0) & (F.col("_removed").isNull() | (F.col("seq") <= F.col("_removed")))
    joined = joined.withColumn("_present", F.coalesce(present, F.lit(False)))
    opened = button & (act == "edit") & F.col("_present")
    joined = settle(joined, "actions")
    edited = carry_forward(
        joined, KEY, "seq", last={"_edit": F.when(opened, F.struct("seq", "user_id", "channel_id"))}
    )
    mine = (F.col("_edit.user_id") == F.col("user_id")) & (F.col("_edit.channel_id") == F.col("channel_id"))
    in_thread = (F.col("thread_ts") == F.col("_thread")) & (F.col("channel_id") == F.col("_channel"))
    saves = ~button & mine & in_thread & F.col("_present")
    closing = (
        edited.filter(saves).groupBy("error_id", F.col("_edit.seq").alias("_edit_seq")).agg(F.min("seq").alias("_closed"))
    )
    outcome = (
        F.when(button & ~F.col("_present"), "missing_error")
        .when(button & (act == "approve"), "approved")
        .when(button & (act == "edit"), "edit_opened")
        .when(button & (act == "discard"), "discarded")
        .when(button, "unknown_action")
        .when(~F.coalesce(mine, F.lit(False)) | (F.col("seq") > F.col("_closed")), "ignored")
        .when(F.col("thread_ts").isNull(), "must_reply_in_thread")
        .when(~F.coalesce(in_thread, F.lit(False)), "wrong_thread")
        .when(~F.col("_present"), "missing_error")
        .otherwise("edited")
    )
    judged = (
        edited.withColumn("_edit_seq", F.col("_edit.seq")).join(closing, ["error_id", "_edit_seq"], "left")
        .withColumn("outcome", outcome)
    )
    judged = settle(judged.select(*actions.columns, "outcome", "_fix"), "judged")
    texts = carry_forward(judged, KEY, "seq", last={"_last_text": F.when(F.col("outcome") == "edited", strip(F.coalesce("text", F.lit(""))))})
    saved = F.when(F.col("outcome").isin("approved", "edited"), F.coalesce("_last_text", "_fix"))
    return texts.select(*actions.columns, "outcome", saved.alias("saved_fix"))


def review_state(outcomes: DataFrame, records: DataFrame, edited_to_sme: bool = False) -> DataFrame:
    """Per record: its source ('approved', 'edited', 'removed' or unchanged), fix, approver and expert cache text."""
    saved = F.col("outcome").isin("approved", "edited")
    to_sme = F.col("outcome").isin("approved", "edited") if edited_to_sme else F.col("outcome") == "approved"
    last = outcomes.groupBy("error_id").agg(
        F.max_by(F.struct("outcome", "saved_fix", "user_id"), F.when(saved, F.col("seq"))).alias("_s"),
        F.max_by("saved_fix", F.when(to_sme, F.col("seq"))).alias("sme_fix"),
        F.coalesce(F.max(F.col("outcome") == "discarded"), F.lit(False)).alias("_gone"),
        F.count_if(saved).alias("saves"),
    )
    joined = records.join(last, KEY, "left")
    return joined.select(
        "error_id",
        F.when(F.col("_gone"), "removed").when(F.col("_s").isNotNull(), F.col("_s.outcome")).otherwise("unchanged").alias("source"),
        F.when(~F.coalesce("_gone", F.lit(False)), F.coalesce("_s.saved_fix", "fix")).alias("fix"),
        F.col("_s.user_id").alias("approved_by"), "sme_fix", F.coalesce("saves", F.lit(0)).alias("saves"),
    )
