"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrag.llm.names import unused
from sparkrag.session import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, ceiling: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target: weights by the order of source (code points, null last), repeating; a target stops
    at ceiling times its source's size, and the excess goes to the others by weight until none is above.

    With sources by rising ceiling size / weight, those before some place stop and the others share what is left; the
    first place at which that holds is found with running sums over one row a source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy("room", "nth")
    upto, rest = by_room.rowsBetween(W.unboundedPreceding, -1), by_room.rowsBetween(0, W.unboundedFollowing)
    nth = F.row_number().over(by_name) - 1
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("nth", nth)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(1))) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("fits", F.col("room") >= F.col("level"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct("room", "nth", "level"))).over(W.partitionBy(F.lit(1)))["level"])
        .select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("final"), F.col("most"))).alias("target"))
    )


def sainte_lague(votes: DataFrame, group: list[str], key: str, vote: str, seats: str) -> DataFrame:
    """votes with a column quota: the group's seats dealt to its rows by highest quotients vote / (2 k + 1).

    Rounding with a divisor a little too large gives each row seats it gets in any case; only the quotients between
    that and a divisor a little too small, two a row on average, are ranked for the seats that are left. Ties go to the
    smaller key (null last). Rows without votes get none.
    """
    one = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    total, rows = F.sum(vote).over(one), F.count("*").over(one)

    def rounded(shift: Column) -> Column:
        fair = F.col(seats) + shift
        return F.when((F.col(seats) <= 0) | (F.col("_votes") <= 0), 0).when(fair <= 0, F.lit(0)).otherwise(F.floor(F.col(vote) / F.col("_votes") * fair + F.lit(0.5))).cast("long")

    base = votes.withColumn("_votes", total).withColumn("_rows", rows)
    base = base.withColumn("_low", rounded(-F.col("_rows") / 2 - 1)).withColumn("_high", rounded(F.col("_rows") / 2 + 1))
    base = base.withColumn("_open", F.col(seats) - F.sum("_low").over(one))
    quotient = F.explode(F.sequence(F.col("_low"), F.col("_high") - 1))
    ranked = (
        base.where((F.col("_high") > F.col("_low")) & (F.col(seats) > 0)).select(*group, key, vote, "_open", quotient.alias("_k"))
        .withColumn("_nth", F.row_number().over((W.partitionBy(*group) if group else W.partitionBy(F.lit(1))).orderBy((F.col(vote) / (2 * F.col("_k") + 1)).desc(), F.col(key).asc_nulls_last(), "_k")))
        .where(F.col("_nth") <= F.col("_open"))
    )
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"m.{c}")) for c in dict.fromkeys([*group, key])]
    more = ranked.groupBy(*dict.fromkeys([*group, key])).agg(F.count("*").alias("_more"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = base.alias("b").join(more.alias("m"), on, "left")
    return out.select(*[F.col(f"b.{c}") for c in votes.columns], (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("quota"))


def with_plan(own: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of own with the columns of plan, one row of which stands for each source (null is a source).

    Sources with a thousandth of all rows or more are a thousand at most, whatever the input: theirs is broadcast, and
    their rows stay where they lie. All other sources are too small to weigh on a task and meet by a shuffle.
    """
    plan = plan.withColumn("_hot", F.col("rows") * 1000 >= F.sum("rows").over(W.partitionBy(F.lit(1))))
    plan = saved(plan.withColumnRenamed("source", "_source"), "plan")
    hot = F.broadcast(plan.where("_hot"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    rest = own.join(hot.select("_source"), same, "left_anti").join(plan.where("NOT _hot"), same)
    return own.join(hot, same).unionByName(rest).drop("_source", "_hot", "rows")


def mix(docs: DataFrame, share: float = 1.5, ceiling: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = 32, shard_rows: int = 2048, seed: int = 0) -> DataFrame:
    """How many words of each document a mix takes, so that sources come to their targets.

    docs needs doc_id, text and source; other columns are ignored, whatever their names. Each source's documents are
    dealt by a seeded hash into shards of about shard_rows rows, in which they are laid end to end in seeded order and
    cut into blocks of block words. Sources get integer numbers of blocks by Sainte-Lague, and so do a source's shards
    of those; a shard takes its first blocks, going round again from its first word after the last, ceiling times at
    most. Returns a row for each input row: doc_id, text_key, copy (tells repeated rows apart), size, source,
    source_size, target, taken.

    Null and empty texts have size 0 and nothing is taken of them. Null source is a source of its own, the last one;
    sources without words get a target of 0. Ties in the seeded order go to the smaller doc_id; repeated rows are told
    apart by a number. No rows, no result rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size"))
    own = saved(own, "sizes")
    targets = source_targets(own, share, ceiling, weights)
    counts = own.groupBy("source").agg(F.count("*").alias("rows"))
    plan = targets.alias("t").join(counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.source", "source_size", "target", "rows", F.ceil(F.col("rows") / shard_rows).alias("shards"))
    plan = plan.withColumn("seats", F.round(F.sum("target").over(W.partitionBy(F.lit(1))) / block).cast("long"))
    plan = sainte_lague(plan, [], "source", "target", "seats").withColumnRenamed("quota", "source_blocks")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_key"))
    dealt = with_plan(own, plan).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "source_blocks", order.alias("seeded"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text_key")), F.col("shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    quotas = sainte_lague(shards, ["source"], "shard", "shard_size", "source_blocks").select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "quota")
    joined = dealt.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    line = W.partitionBy("source", "shard").orderBy("seeded", "doc_id", "text_key")
    words = F.least(F.col("quota") * block, (F.col("shard_size") * F.lit(float(ceiling))).cast("long"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    part = F.col("words") - F.col("rounds") * F.col("shard_size")
    copy = F.row_number().over(W.partitionBy("source", "shard", "doc_id", "text_key").orderBy("seeded"))
    return (
        joined.withColumn("words", words).withColumn("rounds", rounds)
        .withColumn("before", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("taken", (F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("before")))).cast("long"))
        .withColumn("copy", copy)
        .select("doc_id", "text_key", "copy", "size", "source", "source_size", "target", "taken")
    )


def mixed(docs: DataFrame, **options: int) -> DataFrame:
    """docs as the mix takes them: each row as often as its words are taken whole, and once more with its first words,
    joined by one space, where a part is left; n_chars, where there is one, counted anew. Rows of which nothing is taken
    go. Columns are those of docs. See mix for the rest."""
    row, times, part, nth = unused(docs.columns, "row", "times", "part", "nth")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    keyed = saved(keyed, "to-mix", compression="zstd")
    plan = mix(keyed.select(F.col(row).alias("doc_id"), "text", "source"), **options).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias(row), F.floor(F.col("taken") / F.col("size")).cast("int").alias(times), (F.col("taken") % F.col("size")).cast("int").alias(part))
    copies = F.sequence(F.lit(1), F.col(times) + F.when(F.col(part) > 0, 1).otherwise(0))
    taken = keyed.join(plan, row).withColumn(nth, F.explode(copies))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = taken.withColumn("text", F.when(F.col(nth) <= F.col(times), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.greatest(part, F.lit(1))), " ")))
    out = out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
