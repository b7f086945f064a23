"""People under two keys (uid and uin): who is mentioned, and which topics that reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Placeholders that stand for no person.
PLACEHOLDERS = ("", "unknown", "system")


def usable(identity: Column) -> Column:
    return F.coalesce(~identity.isin(*PLACEHOLDERS), F.lit(False))


def identity_keys(people: DataFrame) -> DataFrame:
    """chat, key, person for people (chat, person, uid, uin): each usable key names its person; one key may name several."""
    keys = people.select("chat", "person", F.explode(F.array("person", "uid", "uin")).alias("key"))
    return keys.where(usable(F.col("key"))).select("chat", "key", "person").distinct()


def mentioned_people(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """chat, message_id, person: mentions (chat, message_id, kind, uid, uin) of kind user, by either key, each person once a message.

    A key that no people row knows stands for itself, as a sender is known by one key before others are told.
    """
    asked = mentions.where("kind = 'user'").select("chat", "message_id", F.explode(F.array("uid", "uin")).alias("key")).where(usable(F.col("key")))
    found = asked.join(identity_keys(people), ["chat", "key"], "left")
    return found.select("chat", "message_id", F.coalesce("person", "key").alias("person")).distinct()


def first_posts(msg: DataFrame, people: DataFrame) -> DataFrame:
    """chat, person, topic, c (struct of ms and ordinal): a person's first visible message in each topic; placeholders are out."""
    senders = identity_keys(people).withColumnRenamed("key", "sender")
    rows = msg.where("not recalled").where(usable(F.col("sender"))).select("chat", "sender", "topic", F.struct("ms", "ordinal").alias("c"))
    first = rows.groupBy("chat", "sender", "topic").agg(F.min("c").alias("c"))  # before the join: a row a sender and topic
    both = first.join(senders, ["chat", "sender"], "left").withColumn("person", F.coalesce("person", "sender"))
    return both.groupBy("chat", "person", "topic").agg(F.min("c").alias("c"))


def mention_reach(rows: DataFrame, mentions: DataFrame, msg: DataFrame, people: DataFrame) -> DataFrame:
    """chat, burst, message_id, topic: a visible message of the burst mentions a person, by any key, who wrote in topic before the burst."""
    asking = rows.where("not recalled").select("chat", "burst", "message_id", "at_ms", "at_ordinal").join(mentioned_people(mentions, people), ["chat", "message_id"])
    e = asking.join(first_posts(msg, people), ["chat", "person"]).where(F.col("c") < F.struct(F.col("at_ms").alias("ms"), F.col("at_ordinal").alias("ordinal")))
    return e.select("chat", "burst", "message_id", "topic").distinct()
