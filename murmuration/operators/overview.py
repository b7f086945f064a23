"""Overview of a message window: hot topics, counts, links, mentions, unread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import links, meaningful_text
from .segment import running_sums


def hot_topics(msg: DataFrame, until_ms) -> DataFrame:
    """chat, topic, messages, meaningful, participants, score, last_ms of topics with a meaningful message.

    Of a sender's messages to a topic in ten minutes the first three different texts count, each e^(-age / 6 h); every
    participant adds 2. until_ms: a number, or a column of msg.
    """
    until = F.col(until_ms) if isinstance(until_ms, str) else F.lit(until_ms)
    rows = msg.where("not recalled and not is_system").withColumns({"said": meaningful_text(F.col("text")), "slot": F.floor(F.col("ms") / 600_000), "until": until})
    own = Window.partitionBy("chat", "topic", "sender", "slot")
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("chat", "topic", "sender", "slot", "said").orderBy("ms", "ordinal")))
    fresh = F.when(F.col("said").isNotNull() & (F.col("again") == 1), 1)
    rows = rows.withColumn("place", F.when(fresh.isNotNull(), F.count(fresh).over(own.orderBy("ms", "ordinal").rowsBetween(Window.unboundedPreceding, 0))))
    counts = F.col("said").isNotNull()
    each = rows.groupBy("chat", "topic").agg(
        F.count("*").alias("messages"),
        F.count("said").alias("meaningful"),
        F.countDistinct(F.when(counts, F.col("sender"))).alias("participants"),
        F.coalesce(F.sum(F.when(F.col("place") <= 3, F.exp((F.col("ms") - F.col("until")) / 21_600_000.0))), F.lit(0.0)).alias("heat"),
        F.max(F.when(counts, F.col("ms"))).alias("last_ms"),
    )
    each = each.where("last_ms is not null")
    return each.select("chat", "topic", "messages", "meaningful", "participants", F.round(F.col("heat") + 2.0 * F.col("participants"), 6).alias("score"), "last_ms")


def overview_header(msg: DataFrame) -> DataFrame:
    shown = ~F.col("recalled") & ~F.col("is_system")
    return msg.groupBy("chat").agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if(shown).alias("messages"), F.count_if(shown & meaningful_text(F.col("text")).isNotNull()).alias("meaningful"),
        F.countDistinct(F.when(shown, F.col("sender"))).alias("participants"),
    )


def resources(msg: DataFrame) -> DataFrame:
    """chat, link, first message that shows it, times seen."""
    rows = msg.where("not recalled").select("chat", "ms", "ordinal", "message_id", F.explode(links(F.col("text"))).alias("link"))
    return rows.groupBy("chat", "link").agg(F.min_by("message_id", F.struct("ms", "ordinal")).alias("message_id"), F.count("*").alias("seen"))


def mention_me(msg: DataFrame, me: str) -> DataFrame:
    """Visible messages that mention everyone or me, with the reason."""
    reason = F.when(F.col("mention") == "all", "@全体成员").when(F.col("mention") == me, "直接 @我")
    return msg.where("not recalled").withColumn("reason", reason).where("reason is not null").select("chat", "message_id", "reason")


def messages_range(msg: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    return msg.where((F.col("ms") >= since_ms) & (F.col("ms") < until_ms)).select("chat", "message_id", "ms", "topic")


def suffix_within(msg: DataFrame, limit: int, extra: int = 256) -> DataFrame:
    """The longest run of newest messages per chat whose lengths plus extra sum to limit at most."""
    newest = Window.partitionBy("chat").orderBy(F.desc("ms"), F.desc("ordinal"))
    # limit / extra messages can be within it at most; Spark keeps no more of a chat before it shuffles.
    rows = msg.select("chat", "message_id", "ms", "ordinal", F.length("text").alias("n")).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= limit // extra)
    used = F.sum(F.col("n") + extra).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= limit).select("chat", "message_id", "used")


def batches(msg: DataFrame, size: int = 40) -> DataFrame:
    rows = running_sums(msg.select("chat", "pos", "ms"), ["chat"], "pos", ["pos"], {"place": F.lit(1)})
    return rows.withColumn("batch", F.floor((F.col("place") - 1) / size)).groupBy("chat", "batch").agg(F.count("*").alias("messages"), F.min("ms").alias("from_ms"))


def chat_summary(msg: DataFrame, cursors: DataFrame, insights: DataFrame) -> DataFrame:
    """chat, unread, p0: messages after the reader's cursor (chat, ms, ordinal; none: all), open verified insights of the first priority.

    insights: chat, priority, status, lifecycle.
    """
    seen = cursors.select("chat", F.struct("ms", "ordinal").alias("seen"))
    new = F.coalesce(F.struct("ms", "ordinal") > F.col("seen"), F.lit(True))
    count = msg.select("chat", "ms", "ordinal").join(seen, "chat", "left").groupBy("chat").agg(F.count_if(new).alias("unread"))
    p0 = insights.where("priority = 'P0' AND status = 'verified' AND lifecycle = 'open'").groupBy("chat").agg(F.count("*").alias("p0"))
    return count.join(p0, "chat", "left").select("chat", "unread", F.coalesce("p0", F.lit(0)).alias("p0"))
