"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt into blocks by a hash of their id, and the blocks stand in a
pseudo-random order. How many blocks the mix draws of a source follows from its target. A tree halves
these quotas among the output shards: at each node the left half of the draws is a multivariate
hypergeometric sample of the node's quotas, so every shard has exact, random counts that add up to
the quotas. A shard then takes the next blocks of each source's order, disjoint from all others, and
its documents are shuffled by hash. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, materialise, parallelism

#: Blocks of each source, and levels of the tree: 2**LEVELS output shards.
BLOCKS, LEVELS = 1024, 4


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of sources: (source, source_size) -> with weight and target.

    Sources in code point order, null last, have the weights in turn. The budget is ``share`` times all
    sizes; each gets its weight's part, at most ``most`` times its size, and what is over is shared again
    by weight. That is filling to a level: with sources ordered by size to weight, the level is the
    first at which the budget less the full sources, over the weights of the rest, fills no other.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * most).cast("double")
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(filled), F.lit(0.0))) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    ranked = (
        sizes.withColumn("place", place)
        .withColumn("weight", turn)
        .withColumn("limit", limit)
        .withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("level", level)
    )
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "place", "level"))).over(everything)
    leveled = ranked.withColumn("final", fits["level"])
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("final") * F.col("weight")))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _chance(seed: int, level: int):
    """The random number of the source at place i, for the nodes of a level."""
    return lambda i: _uniform(F.lit(seed), F.lit(level), F.col("shard"), i)


def _log_factorial(n: str) -> str:
    """SQL: ln(n!), exact to 20 and by Stirling's series beyond, where its error is below 1e-12."""
    x = f"cast({n} as double)"
    return f"if({n} <= 20, ln(factorial(cast({n} as int))), {x} * ln({x}) - {x} + 0.5D * ln(2D * pi() * {x}) + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5)))"


def _hypergeometric(good: str, total: str, draws: str, chance: str) -> str:
    """SQL: how many of ``draws`` from ``total`` fall among ``good``, by inversion of the distribution.

    Log probabilities neither overflow nor vanish for quotas of thousands.
    """
    low, high = f"greatest(0L, {draws} - ({total} - {good}))", f"least({draws}, {good})"
    log_choose = lambda n, k: f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"
    chance_of = f"exp({log_choose(good, 'x')} + {log_choose(f'({total} - {good})', f'({draws} - x)')} - {log_choose(total, draws)})"
    return f"aggregate(sequence({low}, {high}), struct(0D as below, {low} as at), (h, x) -> if(h.below <= {chance}, struct(h.below + {chance_of} as below, x as at), h), h -> h.at)"


def shard_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Splits (source, quota) down a binary tree: (source, shard, draws), with exact sums.

    A node is one row with the quotas of all sources in source order; each level is one projection
    and one explode.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("no"), F.col("source").alias("source"), F.col("quota").alias("q"))))
    node = quotas.agg(ordered.alias("s")).where("size(s) > 0")
    tree = materialise(node.select(F.col("s.source").alias("sources"), F.expr("transform(s, e -> cast(e.q as bigint))").alias("q"), F.lit(0).alias("shard")), "quota-root")
    whole = "aggregate(q, 0L, (s, x) -> s + x)"
    pick = _hypergeometric("q[i]", "a.rest", "a.draws", "u[i]")
    step = f"""aggregate(sequence(0, size(q) - 1), named_struct('rest', {whole}, 'draws', {whole} div 2, 'got', cast(array() as array<bigint>)),
        (a, i) -> named_struct('rest', a.rest - q[i], 'draws', a.draws - {pick}, 'got', array_append(a.got, {pick})), a -> a.got)"""
    for level in range(levels):
        chance = F.transform(F.sequence(F.lit(0), F.size("q") - 1), _chance(seed, level))
        left = tree.withColumn("u", chance).withColumn("left", F.expr(step))
        halves = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("q")), F.struct(F.lit(1).alias("side"), F.expr("zip_with(q, left, (x, y) -> x - y)").alias("q")))
        split = left.select("sources", "shard", F.explode(halves).alias("h"))
        tree = materialise(split.select("sources", (F.col("shard") * 2 + F.col("h.side")).alias("shard"), F.col("h.q").alias("q")), f"quota-level-{level}")
    return tree.select("shard", F.explode(F.arrays_zip("sources", "q")).alias("e")).select(F.col("e.sources").alias("source"), "shard", F.col("e.q").alias("draws"))


def _block(seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(blocks)).cast("int")


def _key(seed: int) -> Column:
    """The order of documents within a block; rows share it only if they repeat an id and its text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text"))


def _resolve_splits(drawn: DataFrame, sized: DataFrame) -> DataFrame:
    """The drawn blocks with ``upto``: the last key that is drawn of a split block, null of whole ones.

    A block is split where a source's target is met within it, once a source at most. Its documents are
    drawn whole in the order of keys, up to the one at which their sum is nearest to the words that are
    needed; where no document at all is as near, the block is not drawn.
    """
    split = drawn.where("split").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "need")
    inside = sized.join(split, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).groupBy("_s", "_b", "need", "key").agg(F.sum("size").alias("size"))
    off = F.abs(F.sum("size").over(Window.partitionBy("_s", "_b").orderBy("key")) - F.col("need"))
    nearest = inside.withColumn("off", off).where("off < need").groupBy("_s").agg(F.min(F.struct("off", "key"))["key"].alias("upto"))
    return drawn.join(nearest, F.col("split") & F.col("source").eqNullSafe(F.col("_s")), "left").where("NOT split OR upto IS NOT NULL").select("source", "block", "pass", "draw", "upto")


def draw_plan(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, blocks: int, levels: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all rows, targets of sources, and the plan: (source, block) -> passes, shards and last keys.

    Texts are read once; the table of ids and sizes that remains is aggregated to blocks with partial
    sums, so that a source with most of the rows is spread over its blocks.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), _key(seed).alias("key")).withColumn("block", _block(seed, blocks))
    sized = materialise(sized, "sizes")
    per_block = materialise(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    targets = materialise(source_targets(per_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")

    # Passes over a source: whole ones, then a part whose last block is split.
    place = F.xxhash64(F.lit(seed), "source", "pass", "block")
    order = Window.partitionBy("source", "pass").orderBy(place, "block")
    known = per_block.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    drawn = (
        known.withColumn("pass", F.explode(F.expr("if(source_size > 0, sequence(0, cast(ceil(target / source_size) as int)), array())")))
        .withColumn("quota", F.least(F.col("source_size").cast("double"), F.col("target") - F.col("pass") * F.col("source_size")))
        .where("quota > 0")
        .withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where("words > 0 AND before < quota")
        .withColumn("need", F.col("quota") - F.col("before"))
        .withColumn("split", F.col("need") < F.col("words"))
        .withColumn("draw", F.row_number().over(Window.partitionBy("source").orderBy("pass", place, "block")))
    )
    drawn = materialise(drawn.select("source", "block", "pass", "draw", "need", "split"), "drawn-blocks")
    # A split block has its source's last draw, so that the draws that stay are numbered without a gap.
    drawn = materialise(_resolve_splits(drawn, sized), "resolved-blocks")
    shards = shard_quotas(drawn.groupBy("source").agg(F.count("*").alias("quota")), levels, seed)
    until = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = shards.withColumn("last", F.sum("draws").over(until)).select(F.col("source").alias("_s"), "shard", (F.col("last") - F.col("draws")).alias("first"), "last")
    placed = drawn.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("draw") > F.col("first")) & (F.col("draw") <= F.col("last"))).drop("_s", "first", "last")
    plan = placed.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "upto"))).alias("plan"))
    return sized, targets, materialise(plan, "draw-plan")


def _draws(seed: int) -> Column:
    """The draws of a row with doc_id, size, key and plan that take words: all of the text's."""
    drawn = F.filter(F.coalesce("plan", F.array().cast("array<struct<pass:int,shard:int,upto:bigint>>")), lambda p: (F.col("size") > 0) & (p["upto"].isNull() | (F.col("key") <= p["upto"])))
    return F.transform(drawn, lambda p: F.struct(p["pass"].alias("pass"), p["shard"].alias("shard"), F.xxhash64(F.lit(seed), p["pass"], F.col("doc_id")).alias("place"), F.col("size").alias("words")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, blocks: int = BLOCKS, levels: int = LEVELS, seed: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken and draws.

    ``draws`` lists the document's places in the mix: the pass, the shard, the order within the shard
    and the words taken, always all of the text. Of the block in which a source's target is met as many
    documents are drawn as come nearest to it, so that a source misses its target by at most half the
    longest document of that block. ``taken`` is the sum of the words, at most ``ceil(most)`` times the
    size. Reruns agree.

    A null or empty text has size 0 and no words to take; a null source is a source of its own, the
    last; null and repeated ids are dealt by their hash like others, and rows that repeat an id and its
    text are drawn together, as one document; a table without words gets targets
    of 0; an empty table gives an empty one; texts are measured whole; other columns are not read.
    """
    sized, targets, plan = draw_plan(docs, weights, share, most, blocks, levels, seed)
    totals = targets.select(F.col("source").alias("_t"), "source_size", "target")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").join(totals, F.col("source").eqNullSafe(F.col("_t")))
    out = rows.select("doc_id", "source", "size", "source_size", "target", _draws(seed).alias("draws"))
    return out.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, blocks: int = BLOCKS, seed: int = 8) -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw, with all columns, shard by shard in shuffled order.

    Documents are drawn whole, their rows unchanged. There are as many shards as partitions, rounded up
    to a power of two, each with its exact quota of every source's blocks, so that they are of nearly
    one size.
    """
    levels = max(0, (parallelism(docs.sparkSession) - 1).bit_length())
    _, _, plan = draw_plan(docs, weights, share, most, blocks, levels, seed)
    names = docs.columns
    rows = docs.select(*docs.columns, F.col("source").cast("string").alias("_source"), _block(seed, blocks).alias("_block"), words(F.col("text")).alias("_size"), _key(seed).alias("_key"))
    # Names of the plan that a document's column may clash with.
    held = F.struct(*[F.col(c) for c in names]).alias("_row")
    rows = rows.select(held, F.col("doc_id").cast("long").alias("doc_id"), "_source", "_block", F.col("_size").alias("size"), F.col("_key").alias("key"))
    drawn = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).select("_row", F.explode(_draws(seed)).alias("_draw"))
    dealt = drawn.repartitionById(1 << levels, F.col("_draw.shard")).sortWithinPartitions("_draw.place", "_draw.pass")
    return dealt.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
