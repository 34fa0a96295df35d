"""Sources mixed to target weights: a low-discrepancy schedule of equal blocks of words. DataFrame operations only.

1. A source's share of the mix is its weight times one level, or ``most`` times its size if that is less; the level that spends the whole
   budget follows from running sums over the sources ordered by size over weight.
2. A source takes its shuffled documents, end to end and then once more from the start, up to its target, cut into blocks of ``block_words``
   words (the last one may be shorter). Positions come from running sums over a range-partitioned table.
3. Cumulative weights: each source owns as many whole numbers x as it has blocks, one source after the other. The slot of x is x with its bits
   reversed, so slot i takes the source that owns the van der Corput point of i; any stretch of slots has each source's share to within a
   few blocks, and over all slots exactly. The rank of a slot among its source's is counted by arithmetic on the bits, as how many
   earlier slots' points lie below a bound has a closed form; rank r takes the source's block r.
4. Slots and blocks of documents meet by (source, block) in a shuffled join, as both grow with the input: every key has one slot and the documents of ``block_words`` words, so a source of any size is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import BLANKS, join_skewed
from peerscope.operators.ranking import running_sum
from peerscope.session import materialize, spread

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
#: Slots of a source that are listed by one row at most.
LISTED = 1 << 10


def source_key(source: Column) -> Column:
    """A key that is never null and keeps the order by code points, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(">"))


def reversed_bits(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a number in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long") if bits else x


def steps_below(bound: Column, bits: int) -> Column:
    """For each set bit of a bound, (first, apart): the points that agree with the bound up to this bit and have a zero here are every ``apart``-th slot from ``first`` on."""
    steps = []
    for p in range(1, bits + 1):
        first = reversed_bits(F.shiftright(bound, bits - p + 1).bitwiseAND((1 << (p - 1)) - 1), p - 1)
        here = (bound < 1 << bits) & (F.shiftright(bound, bits - p).bitwiseAND(1) == 1)
        steps.append(F.when(here, F.struct(first.alias("first"), F.lit(1 << p).cast("long").alias("apart"))))
    every = F.when(bound >= 1 << bits, F.struct(F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("apart")))
    return F.array_compact(F.array(every, *steps))


def points_below(slots: Column, steps: Column) -> Column:
    """How many of the first ``slots`` slots have a point below the bound of the steps."""
    those = lambda step: F.call_function("div", F.greatest(slots - step["first"] + step["apart"] - 1, F.lit(0).cast("long")), step["apart"])
    return F.aggregate(steps, F.lit(0).cast("long"), lambda found, step: found + those(step))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size): the budget ``share`` times all sizes by weight, capped at ``most`` times a size.

    ``source`` is a key of ``source_key``; weights repeat in its order. The capped sources are those whose cap lies below their share of
    what the sources before them, by cap over weight, leave; all others get weight times one level. Sources without words get 0.
    """
    ordered = running_sum(sources.select("source", "source_size", F.lit(1).cast("long").alias("one")), [], ["source"], "one", "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = materialize(ordered.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    by_level = weighted.filter("source_size > 0").withColumn("level", F.col("cap") / F.col("weight"))
    caps = running_sum(by_level, [], ["level", "source"], "cap", "caps_to")
    both = materialize(running_sum(caps, [], ["level", "source"], "weight", "weights_to"))
    sums = both.agg(F.sum("weight").alias("all_weights"), (F.sum("source_size") * F.lit(float(share))).alias("budget"))
    capped = (F.col("caps_to") + F.col("level") * (F.col("all_weights") - F.col("weights_to"))) <= F.col("budget")
    split = both.join(F.broadcast(sums), F.lit(True)).withColumn("capped", capped)  # one row
    level = split.agg(
        (F.max("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0))).alias("left"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weights")
    ).select(F.try_divide("left", "weights").alias("level"))
    found = F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("cap")), F.col("cap"))
    return weighted.join(F.broadcast(level), F.lit(True)).select("source", "source_size", "weight", found.alias("target"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, block) of (source, words): every block of every source once, in slots that keep the shares along the way."""
    sized = sources.select("source", F.ceil(F.col("words") / block_words).cast("long").alias("blocks")).filter("blocks > 0")
    owned = materialize(running_sum(sized, [], ["source"], "blocks", "to"))
    count = owned.agg(F.max("to")).first()[0] or 0
    bits = max(int(count) - 1, 0).bit_length()
    begin = F.col("to") - F.col("blocks")
    bounded = owned.select("source", "blocks", begin.alias("from"), "to", steps_below(begin, bits).alias("below_from"), steps_below(F.col("to"), bits).alias("below_to"))
    parts = spread(bounded.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / LISTED)))), "source", "part")
    low = F.col("from") + F.col("part") * LISTED
    slots = parts.select("source", "below_from", "below_to", F.explode(F.sequence(low, F.least(low + (LISTED - 1), F.col("to") - 1))).alias("x"))
    slots = slots.withColumn("slot", reversed_bits(F.col("x"), bits))
    return slots.select("slot", "source", (points_below(F.col("slot"), F.col("below_to")) - points_below(F.col("slot"), F.col("below_from"))).alias("block"))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def _placed(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their place in their source, sources with targets)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), words_in(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("row"))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(rows.withColumn("key", shuffled))
    placed = materialize(running_sum(rows, ["source"], ["key", "size", "row"], "size", "to").drop("key"))
    sizes = materialize(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")))
    sources = targets(sizes, weights, share, most)
    return placed, materialize(sources.join(sizes.select("source", "documents"), "source").withColumn("words", F.round("target").cast("long")))


def _taken(placed: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """The rows with their source's figures, in parts of (pass, block, from_word, n_words); a row without a part has a block below 0."""
    dealt = F.pmod(F.col("row"), F.lit(1 << 12))  # rows that the mix does not take meet no slot; they are dealt out
    rows = join_skewed(placed, sources, "source", "documents")

    def listed_in(k: int) -> Column:
        low = F.col("to") - F.col("size") + k * F.col("source_size")
        high = F.least(low + F.col("size"), F.col("words"))
        blocks = F.sequence(F.floor(low / block_words), F.floor((high - 1) / block_words))
        return F.when(high > low, F.transform(blocks, lambda b: F.struct(F.lit(k).alias("pass"), low.alias("low"), high.alias("high"), b.alias("block"))))

    empty = "array<struct<pass:int,low:bigint,high:bigint,block:bigint>>"
    none = F.array(F.struct(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), (-1 - dealt).alias("block"))).cast(empty)
    listed = F.concat(*[F.coalesce(listed_in(k).cast(empty), F.array().cast(empty)) for k in (0, 1)])
    cut = rows.withColumn("part", F.explode(F.when(F.size(listed) > 0, listed).otherwise(none))).select("*", "part.*").drop("part")
    start = F.greatest("low", F.col("block") * block_words)
    words = F.least("high", (F.col("block") + 1) * block_words) - start
    return cut.withColumn("from_word", start - F.col("low")).withColumn("n_words", F.when(F.col("block") < 0, 0).otherwise(words).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix, in parts of documents: slot, block, pass, doc_id, source, from_word, n_words, place (in the block, from 0).

    Ordered by slot and place it is the training order. A size is the number of words of the whole text (null: 0). Documents of a source are
    shuffled by the hash of seed and id, so reruns agree; rows that repeat an id are documents of their own, next to each other
    if they share their source; null ids hash as the seed alone. Sources are ordered by code points, null last. ``most`` is at most 2, and no
    document is taken more often. Documents without words, and an empty table, give no rows; further columns are ignored.
    """
    placed, sources = _placed(docs, weights, share, most, seed, doc_id, text, source)
    parts = _taken(placed, sources, block_words).filter("block >= 0")
    met = parts.join(schedule(sources, block_words).hint("merge"), ["source", "block"])
    name = F.when(F.col("source") != ">", F.substring("source", 2, 1 << 30)).alias("source")
    place = F.col("low") + F.col("from_word") - F.col("block") * block_words
    return met.select("slot", "block", "pass", "doc_id", name, "from_word", "n_words", place.alias("place"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (its words in the mix, repeats counted); rules as in ``mix``."""
    placed, sources = _placed(docs, weights, share, most, seed, doc_id, text, source)
    met = _taken(placed, sources, block_words).join(schedule(sources, block_words).hint("merge"), ["source", "block"], "left")
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(0)).alias("taken")
    same = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return met.groupBy("row").agg(*same, taken).drop("row")
