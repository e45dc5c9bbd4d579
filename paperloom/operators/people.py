"""Registration: one current state per person out of contacts, requests and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = {"approve": "approved", "reject": "rejected"}


def student_table(events: DataFrame) -> DataFrame:
    """The students table as the events leave it.

    *events* holds (telegram_id, ts, seq, kind, name, username, admin_id), kind being contact, request, approve
    or reject. A contact refreshes the display name and the user name only. A request sets the full name, makes the person
    pending again and clears the decision; ``created_at`` stays. A decision counts only for somebody who
    applied, so the later of last request and last decision says the status. Every column is a minimum
    or a maximum: the work combines before the shuffle, and the same function serves a stream.
    """
    place = F.struct("ts", "seq")
    is_known = F.col("kind").isin("contact", "request")
    is_request = F.col("kind") == "request"
    decides = F.col("kind").isin("request", *DECISIONS)
    folded = events.groupBy("telegram_id").agg(
        F.min(F.when(is_known, F.col("ts"))).alias("created_at"),
        F.max(F.when(is_known, F.struct("ts", "seq", "name"))).getField("name").alias("telegram_name"),
        F.max(F.when(is_known, F.struct("ts", "seq", "username"))).getField("username").alias("telegram_username"),
        F.max(F.when(is_request, F.struct("ts", "seq", "name"))).getField("name").alias("full_name"),
        F.max(F.when(decides, F.struct(place.alias("at"), "kind", "ts", "admin_id"))).alias("_last"),
        F.max(is_request).alias("_applied"),
    )
    decided = F.col("_applied") & (F.col("_last.kind") != "request")
    status = F.when(decided & (F.col("_last.kind") == "approve"), "approved").when(decided, "rejected").otherwise("pending")
    return folded.filter("created_at IS NOT NULL").select(
        "telegram_id", "telegram_name", "telegram_username", "full_name", status.alias("status"), "created_at",
        F.when(decided, F.col("_last.ts")).alias("handled_at"), F.when(decided, F.col("_last.admin_id")).alias("handled_by"),
    )


def refused_decisions(events: DataFrame) -> DataFrame:
    """Decisions that could not be recorded: about nobody known, or about somebody who never applied."""
    place = F.struct("ts", "seq")
    firsts = events.groupBy("telegram_id").agg(
        F.min(F.when(F.col("kind") == "request", place)).alias("_request"),
        F.min(F.when(F.col("kind").isin("contact", "request"), place)).alias("_known"),
    )
    decisions = events.filter(F.col("kind").isin(*DECISIONS)).join(firsts, "telegram_id")
    unknown = F.col("_known").isNull() | (F.col("_known") > place)
    unasked = F.col("_request").isNull() | (F.col("_request") > place)
    return decisions.filter(unasked).select(
        "telegram_id", "seq", "kind", F.when(unknown, "unknown person").otherwise("no application").alias("reason")
    )


def registration_gate(people: DataFrame, students: DataFrame) -> DataFrame:
    """What /start does for each person: register anew, wait (since when), or go on."""
    joined = people.join(students.select("telegram_id", "status", "created_at"), "telegram_id", "left")
    gate = F.when(F.col("status").isNull() | (F.col("status") == "rejected"), "new").otherwise(F.col("status"))
    return joined.select(
        "telegram_id", gate.alias("gate"), F.when(gate == "pending", F.col("created_at")).alias("requested_at")
    )


def authorised(people: DataFrame, students: DataFrame, admin_id: int) -> DataFrame:
    """People who may take tests: approved students, and always the admin."""
    approved = students.filter("status = 'approved'").select("telegram_id")
    admin = people.filter(F.col("telegram_id") == admin_id)
    return people.filter(F.col("telegram_id") != admin_id).join(approved, "telegram_id", "left_semi").unionByName(admin)
