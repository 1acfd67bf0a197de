"""Mail detectors over message tables.

Columns: message_id, folder, subject, sender_email, recipients (array of display and email),
attachments (array of filename and size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import endpoint as fx, text as ft
from emberlog.operators.common import with_totals

OUTBOUND = ["sent items", "outbox", "drafts", "deleted items"]


def _mismatch(r: Column) -> Column:
    """A recipient shown as an address of another domain."""
    shown, real = fn.mail_domain(r["display"]), fn.mail_domain(r["email"])
    return (fn.display_is_email(r["display"]) & (F.lower(r["email"]) != F.lower(r["display"]))
            & (shown != "") & (real != "") & (shown != real))


def recipient_mismatches(messages: DataFrame) -> DataFrame:
    """One row per recipient whose display name is an address of another domain."""
    return messages.select("message_id", "folder", "subject", F.explode("recipients").alias("r")
                           ).filter(_mismatch(F.col("r"))).select(
        "message_id", "folder", "subject", F.col("r.display").alias("display"),
        F.col("r.email").alias("email"))


def reply_precursors(messages: DataFrame) -> DataFrame:
    """Inbound messages answered by a sent reply that went to a mismatched recipient.

    Replies are reduced to their distinct subject stems before the join.
    """
    stems = messages.filter((F.lower("folder") == "sent items") & F.exists(
        "recipients", _mismatch)).select(fn.reply_stem(F.col("subject")).alias("stem")).filter(
        F.col("stem") != "").distinct()
    inbound = messages.filter(~F.lower(F.coalesce("folder", F.lit(""))).isin(OUTBOUND)).withColumn(
        "stem", fn.subject_stem(F.col("subject"))).filter(F.col("stem") != "")
    return inbound.join(stems, "stem", "left_semi").dropDuplicates(["message_id"])


def sender_mismatches(messages: DataFrame) -> DataFrame:
    """Inbound messages whose sender is shown as an address of another domain."""
    sender = F.struct(F.col("sender_name").alias("display"), F.col("sender_email").alias("email"))
    return messages.filter(~F.lower(F.coalesce("folder", F.lit(""))).isin(OUTBOUND)
                           & _mismatch(sender))


def local_domains(messages: DataFrame) -> DataFrame:
    """Domains mail is sent from: those with at least a third of the busiest one's messages."""
    counts = messages.select(fn.mail_domain(F.col("sender_email")).alias("domain")).filter(
        F.col("domain") != "").groupBy("domain").agg(F.count("*").alias("n"))
    out = with_totals(counts, counts.agg(F.max("n").alias("top")))
    return out.filter(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("top") / 3))).select(
        "domain", "n")


def attachment_exfil(messages: DataFrame, bulk_bytes: int = 100 * 1024) -> DataFrame:
    """Messages that carry keyword-named, else large, office files to external recipients.

    Recipients are joined with the local domains after being cut down to distinct (message, domain)
    pairs; the domain table is one row per domain.
    """
    name = lambda a: F.lower(a["filename"])

    def office(a):
        return name(a).rlike("(" + "|".join(x.replace(".", r"\.") for x in fx.OFFICE_EXTENSIONS)
                             + ")$")
    sensitive = F.filter("attachments", lambda a: office(a) & fn.any_contains(
        name(a), fx.SENSITIVE_WORDS))
    bulk = F.filter("attachments", lambda a: office(a) & (a["size"] >= bulk_bytes))
    sent = messages.withColumn("_s", F.size(sensitive)).withColumn("_b", F.size(bulk)).filter(
        (F.col("_s") > 0) | (F.col("_b") > 0))
    to = sent.select("message_id", "_s", "_b", F.explode(F.array_distinct(F.transform(
        "recipients", lambda r: fn.mail_domain(r["email"])))).alias("domain")).filter(
        F.col("domain") != "")
    outside = to.join(local_domains(messages).select("domain"), "domain", "left_anti")
    return outside.groupBy("message_id").agg(
        F.max("_s").alias("sensitive_files"), F.max("_b").alias("bulk_files"),
        F.count("*").alias("external_domains"),
        F.bool_or(F.col("domain").isin(ft.WEBMAIL_DOMAINS)).alias("webmail")).withColumn(
        "kind", F.when(F.col("sensitive_files") > 0, "sensitive").otherwise("bulk")).withColumn(
        "confidence", F.when((F.col("kind") == "sensitive") & F.col("webmail"), "high").when(
            F.col("kind") == "sensitive", "medium").otherwise("low"))


def top_correspondents(messages: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent senders, with messages received from and sent to each."""
    sent = F.lower("folder") == "sent items"
    peers = messages.filter(~sent).select(F.lower("sender_email").alias("peer"), F.lit(
        "in").alias("way")).unionByName(messages.filter(sent).select(
            F.explode(F.transform("recipients", lambda r: F.lower(r["email"]))).alias("peer"),
            F.lit("out").alias("way")))
    return peers.groupBy("peer").agg(
        F.count("*").alias("messages"), F.count_if(F.col("way") == "in").alias("received"),
        F.count_if(F.col("way") == "out").alias("sent")).orderBy(
        F.desc("messages"), "peer").limit(n)


def search(messages: DataFrame, needle: str, columns=("subject", "text")) -> DataFrame:
    """Messages that hold a text, in any of the columns, without regard to case."""
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower())
    return messages.filter(test)
