"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, as many as hold the corpus in blocks of `block` words. The k-th van der Corput point (base 2) falls
into one source's stretch of the cumulative targets, which gives the slot's source: every prefix of the
schedule holds each source in its share up to O(log M / M). A source whose stretch no point meets gets one slot after
the others. Within a source documents lie in hashed order and their words form one stream; the slots of a source, ranked
in schedule order, share its target in equal parts (whole words, about a block each), take the stream in turn and start
over after its end, three times at most. So each source yields its target to the word, however small beside a block.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of all
documents; none gets more than `most` times its own words, the excess is shared again by weight (water
filling, closed form over the sources sorted by 3 * size / weight).

Scale: one light row (id, source, size, hash) of each document is shuffled, texts are not. Positions in the
stream are prefix sums in two levels (hash ranges, then within a range), so a source with a third of all rows
is spread over all ranges. Documents meet slots by an equi-join on (source, cell), a cell being a slot's share of words.

Cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, placed last;
repeated rows are mixed as documents of their own; an empty table gives an empty result. Order depends on hashes
of id and text alone, so reruns agree; identical rows may swap places, which changes no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

WEIGHTS = (5, 2, 1)
MOST = 3
#: Slots in the schedule and hash ranges of a source's stream.
SLOT_BITS = 18
RANGES = 4096


def van_der_corput(k: Column, bits: int = SLOT_BITS) -> Column:
    """The base-2 radical inverse of k < 2**bits, as a double in [0, 1)."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("double") / float(1 << bits)


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds weight, target, and the target's stretch [low, high) of the total."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    w = sizes.withColumn("weight", F.get(pick, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    w = w.withColumn("cap", most * F.col("source_size").cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # If exactly the sources before this one are capped, the others stand at this level; the first whose own cap is above it sets it.
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    mass = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / mass)
    w = w.withColumn("water", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    w = w.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("target").over(run)
    return w.select("source", "source_size", "weight", "target", "total", (high - F.col("target")).alias("low"), high.alias("high"))


def block_words(goals: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """One row: the words of a block, such that at most 2**bits slots hold the corpus, and the number of slots."""
    block = F.greatest(F.lit(1), F.ceil(F.max("total") / (1 << bits))).cast("long")
    return goals.groupBy().agg(block.alias("block"), F.ceil(F.max("total") / block).alias("n_slots"))


def schedule(goals: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """(slot, source, rank, of): the source of each slot, the slot's rank among those of its source, from 0, and their number.

    The stretches of the sources come as one array (a row for each source), searched for each point.
    """
    spark = goals.sparkSession
    stretch = goals.groupBy().agg(F.array_sort(F.collect_list(F.struct("low", "high", "source"))).alias("all"), F.max("high").alias("whole"))
    slots = spark.range(1 << bits).withColumnRenamed("id", "slot").withColumn("point", van_der_corput(F.col("slot"), bits))
    length = block_words(goals, bits)
    placed = slots.crossJoin(F.broadcast(stretch)).crossJoin(F.broadcast(length))  # one row each
    placed = placed.where("whole > 0 and slot < n_slots")
    # Equal slices of [0, whole) by slot fraction: an inner range join on a handful of sources.
    found = placed.select("slot", F.get(F.filter("all", lambda s: (s["low"] <= F.col("point") * F.col("whole")) & (F.col("point") * F.col("whole") < s["high"])), 0)["source"].alias("source"))
    # One slot more for each source, kept where no point met the source.
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    spare = goals.where(quota() > 0).crossJoin(F.broadcast(length)).select((F.col("n_slots") + nth).alias("slot"), "source", F.lit(True).alias("spare"))
    both = found.withColumn("spare", F.lit(False)).unionByName(spare)
    same = Window.partitionBy("source")
    ranked = both.withColumn("rank", F.row_number().over(same.orderBy("slot")) - 1).withColumn("of", F.greatest(F.lit(1), F.count_if(~F.col("spare")).over(same)))
    return ranked.where(~F.col("spare") | (F.col("rank") == 0)).drop("spare")


def quota() -> Column:
    """The target in whole words."""
    return F.floor(F.col("target") + 0.5).cast("long")


def slot_cells(goals: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """(key, quota, cell, c, stretches): for each cell of `cell` words of a source's stream, the [from, to) its slots take in it."""
    wanted = goals.select(source_key().alias("key"), "source_size", quota().alias("quota")).where("quota > 0")
    slots = schedule(goals, bits).select(source_key().alias("key"), "rank", "of").join(wanted, "key")
    slots = slots.select("key", "quota", "source_size", F.expr("(quota + of - 1) div of").alias("cell"), F.expr("rank * quota div of").alias("begin"), F.expr("(rank + 1) * quota div of").alias("end"))
    turns = slots.where("end > begin").withColumn("turn", F.explode(F.expr("sequence(begin div source_size, (end - 1) div source_size)")))
    at = F.col("turn") * F.col("source_size")
    turns = turns.select("key", "quota", "cell", F.greatest(F.col("begin") - at, F.lit(0)).alias("from"), F.least(F.col("end") - at, "source_size").alias("to"))
    pieces = turns.withColumn("c", F.explode(F.expr("sequence(from div cell, (to - 1) div cell)")))
    cut = F.struct(F.greatest("from", F.col("c") * F.col("cell")).alias("from"), F.least("to", (F.col("c") + 1) * F.col("cell")).alias("to"))
    return pieces.groupBy("key", "quota", "cell", "c").agg(F.collect_list(cut).alias("stretches"))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def row_hash() -> Column:
    """Places a row in its source's stream; equal for rows of equal id and text."""
    return F.xxhash64(F.lit(17), "doc_id", F.coalesce(F.col("text"), F.lit("")))


def mix(docs: DataFrame, most: int = MOST, bits: int = SLOT_BITS) -> DataFrame:
    """(rid, h, doc_id, source, size, source_size, target, taken) for each row of docs, which needs doc_id, source and text."""
    light = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash().alias("h"))
    light = materialise(light.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    goals = materialise(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), most), "mix-targets")
    cells = materialise(slot_cells(goals, bits), "mix-cells")
    # Positions in each source's stream: sums of hash ranges, then sums inside a range.
    ranged = light.withColumn("key", source_key()).withColumn("range", F.shiftrightunsigned("h", 52).cast("int"))
    sums = ranged.groupBy("key", "range").agg(F.sum("size").alias("s"))
    ahead = sums.select("key", "range", (F.sum("s").over(Window.partitionBy("key").orderBy("range")) - F.col("s")).alias("base"))
    inside = Window.partitionBy("key", "range").orderBy("h", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    at = ranged.withColumn("upto", F.sum("size").over(inside)).join(ahead, ["key", "range"])
    at = at.select("rid", "key", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start")).where("size > 0")
    # Words after the quota of a source larger than its target are taken by no slot.
    at = at.join(cells.select("key", "quota", "cell").distinct(), "key").where("start < quota")
    piece = at.withColumn("c", F.explode(F.expr("sequence(start div cell, (start + size - 1) div cell)")))
    end = F.col("start") + F.col("size")
    words = F.aggregate("stretches", F.lit(0).cast("long"), lambda n, s: n + F.greatest(F.least(end, s["to"]) - F.greatest("start", s["from"]), F.lit(0).cast("long")))
    taken = piece.join(cells.drop("quota", "cell"), ["key", "c"]).withColumn("words", words).groupBy("rid").agg(F.sum("words").alias("taken"))
    same = F.col("l.source").eqNullSafe(F.col("g.source"))
    out = light.alias("l").join(goals.alias("g"), same).select("l.rid", "l.h", "l.doc_id", "l.source", "l.size", "g.source_size", "g.target")
    return out.join(taken, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, most: int = MOST, bits: int = SLOT_BITS) -> DataFrame:
    """The documents of the mix with the columns of docs, repeated as often as the mix takes them (parts round to the nearest)."""
    share = mix(docs, most, bits).groupBy("h").agg((F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))).alias("share"))
    copies = share.select("h", F.floor(F.col("share") + 0.5).cast("int").alias("copies")).where("copies > 0")
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("row"), row_hash().alias("h")).join(copies, "h")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
