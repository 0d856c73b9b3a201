"""Message archives: decoding, reactions, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.functions import text as T

TRANSCRIPT_CHARS = 8000


def thread_names(archive: dict[str, DataFrame]) -> DataFrame:
    """chat_id, thread_name: the display name, else the participants' names in order, comma-joined."""
    people = archive["chat_handle_join"].join(archive["handle"].select(F.col("ROWID").alias("handle_id"), "id"), "handle_id")
    people = people.groupBy("chat_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("people"))
    chats = archive["chat"].select(F.col("ROWID").alias("chat_id"), F.col("guid").alias("thread_id"), "display_name")
    name = F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.nullif("people", F.lit("")), "thread_id")
    return chats.join(people, "chat_id", "left").select("chat_id", "thread_id", name.alias("thread_name"))


def decode_messages(archive: dict[str, DataFrame], contacts: DataFrame | None = None, owner: str = "Me") -> DataFrame:
    """guid, thread_id, thread_name, sender_handle, sender_name, is_from_me, ts, text of plain messages with a body, each
    once (in its chat of the lowest id)."""
    plain = archive["message"].where("coalesce(associated_message_type, 0) = 0 and trim(coalesce(text, '')) <> ''")
    joined = plain.join(archive["chat_message_join"].withColumnRenamed("message_id", "ROWID"), "ROWID")
    once = joined.withColumn("nth", F.row_number().over(W.partitionBy("guid").orderBy("date", "ROWID", "chat_id"))).where("nth = 1")
    full = once.join(thread_names(archive), "chat_id", "left").join(archive["handle"].select(F.col("ROWID").alias("handle_id"), F.col("id").alias("sender_handle")), "handle_id", "left")
    name = F.col("sender_handle")
    if contacts is not None:
        full = full.join(contacts.select(F.col("handle").alias("sender_handle"), F.col("name").alias("contact")), "sender_handle", "left")
        name = F.coalesce("contact", "sender_handle")
    mine = F.col("is_from_me") == 1
    return full.select("guid", "thread_id", "thread_name", F.when(~mine, F.col("sender_handle")).alias("sender_handle"), F.when(mine, F.lit(owner)).otherwise(F.coalesce(name, F.lit("unknown"))).alias("sender_name"), mine.alias("is_from_me"),
                       T.apple_timestamp(F.col("date")).alias("ts"), "text")


def fold_tapbacks(reactions: DataFrame, messages: DataFrame) -> DataFrame:
    """messages with tapbacks: reactions (target, sender_name, code) added more often than taken back, by kind and sender."""
    net = reactions.withColumn("kind", T.reaction_kind(F.col("code"))).where("kind is not null").groupBy(T.reaction_target(F.col("target")).alias("guid"), "sender_name", "kind").agg(F.sum(T.reaction_sign(F.col("code"))).alias("net")).where("net > 0")
    nested = net.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("kind", "sender_name"))).alias("tapbacks"))
    return messages.join(nested, "guid", "left").withColumn("tapbacks", F.coalesce("tapbacks", F.array().cast("array<struct<kind:string,sender_name:string>>")))


def load_messages(archive: dict[str, DataFrame], contacts: DataFrame | None = None, owner: str = "Me", ordered: bool = True) -> DataFrame:
    """All messages of an archive with their reactions, by time and guid unless the order does not matter."""
    senders = archive["handle"].select(F.col("ROWID").alias("handle_id"), F.col("id").alias("sender"))
    reactions = archive["message"].where("associated_message_type between 2000 and 3005").join(senders, "handle_id", "left").select(
        F.col("associated_message_guid").alias("target"), F.when(F.col("is_from_me") == 1, owner).otherwise(F.coalesce("sender", F.lit("unknown"))).alias("sender_name"), F.col("associated_message_type").alias("code"))
    out = fold_tapbacks(reactions, decode_messages(archive, contacts, owner))
    return out.orderBy("ts", "guid") if ordered else out


def merge_batches(batches: list[DataFrame], ordered: bool = True) -> DataFrame:
    """The union of overlapping batches: a guid's row from the first batch that has it, by time and guid unless the order
    does not matter."""
    every = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    df = every[0]
    for b in every[1:]:
        df = df.unionByName(b)
    first = df.withColumn("_nth", F.row_number().over(W.partitionBy("guid").orderBy("_batch", "ts"))).where("_nth = 1")
    out = first.drop("_batch", "_nth")
    return out.orderBy("ts", "guid") if ordered else out


def parse_summary(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("messages"), F.count_distinct("thread_id").alias("threads"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def bound(messages: DataFrame, limit: int | None, since: str | None = None) -> DataFrame:
    """The newest limit messages on or after the day since."""
    df = messages if since is None else messages.where(F.to_date("ts") >= F.to_date(F.lit(since)))
    return df if limit is None else df.orderBy(F.desc("ts"), F.desc("guid")).limit(limit)


def render_lines() -> Column:
    """A message's transcript line, with its reactions indented below."""
    head = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("sender_name"), F.lit(": "), F.col("text"))
    below = F.transform(F.array_sort("tapbacks"), lambda t: F.concat(F.lit("  ["), t["kind"], F.lit(" by "), t["sender_name"], F.lit("]")))
    return F.array_join(F.concat(F.array(head), below), "\n")


def thread_transcripts(messages: DataFrame, most: int = TRANSCRIPT_CHARS) -> DataFrame:
    """doc_key, thread_id, thread_name, span, text, message_guids, content_sha256: a thread's whole days, packed in order
    until the next would exceed most characters; a longer day stands alone.

    Days are folded by size alone (one small array a thread); lines are gathered by document afterwards.
    """
    lines = messages.withColumn("line", render_lines()).withColumn("day", F.to_date("ts"))
    days = lines.groupBy("thread_id", "day").agg((F.sum(F.length("line") + 1) + 0).alias("size"))
    zero = F.struct(F.array().cast("array<struct<day:date,nth:int>>").alias("out"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("nth"))

    def step(state: Column, d: Column) -> Column:
        fresh = (state["held"] > 0) & (state["held"] + d["size"] > most)
        nth = F.when(fresh, state["nth"] + 1).otherwise(state["nth"])
        return F.struct(F.concat(state["out"], F.array(F.struct(d["day"].alias("day"), nth.alias("nth")))).alias("out"), F.when(fresh, d["size"]).otherwise(state["held"] + d["size"]).alias("held"), nth.alias("nth"))

    folded = days.groupBy("thread_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("day", "size"))), zero, step)["out"].alias("x"))
    placed = folded.select("thread_id", F.explode("x").alias("x")).select("thread_id", "x.day", "x.nth")
    docs = lines.join(placed, ["thread_id", "day"]).groupBy("thread_id", "nth").agg(
        F.max_by("thread_name", F.struct("ts", "guid")).alias("thread_name"), F.min("day").alias("first"), F.max("day").alias("last"), F.array_join(F.array_sort(F.collect_set("sender_name")), ", ").alias("people"),
        F.array_sort(F.collect_list(F.struct("ts", "guid", "line"))).alias("m"))
    span = T.span(F.col("first"), F.col("last"))
    text = F.concat(F.lit("# "), T.transcript_label(F.col("thread_name"), span), F.lit("\nParticipants: "), "people", F.lit("\n\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n"))
    return docs.select(T.doc_key(F.col("thread_id"), F.col("first"), F.col("last")).alias("doc_key"), "thread_id", "thread_name", span.alias("span"), text.alias("text"), F.transform("m", lambda x: x["guid"]).alias("message_guids"), F.sha2(text, 256).alias("content_sha256"))
