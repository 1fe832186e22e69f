"""Operator 11, mixing sources to target weights (DataFrame functions only).

The words of a source, its documents in a shuffled order one after the other, are
cut into blocks of equally many words. The mix is a sequence of slots, each of
which takes one block. Which source has a slot says a van der Corput point: the
slot's number with its bits reversed falls into one of the sources' intervals, as
wide as the source has slots in all. So at any place of the mix each source has
had its share, to a few blocks, and over all slots it has it exactly. The slots of
a source are ranked by counting the points in its interval before a slot, which
the bits of the interval's ends give; the slot of rank r takes block r, after the
last block the first again.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .prefix import running

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_REPEAT = 2
BLOCK = 1024
SEED = 42
#: Slots in a cell; points meet the intervals that lie in their cell.
CELL = 1024
#: Sources, of some hundred bytes each, up to which their table is broadcast.
BROADCAST_SOURCES = 100_000


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient of whole numbers that are not negative."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII's blanks; of null: 0."""
    runs = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")).cast("bigint")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(key, source, size, shuffled, mark): a row a document, shuffled and mark give its place among its source's."""
    name = F.col(key).alias("key")
    shuffled = F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    return docs.select(name, F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), shuffled.alias("shuffled"), F.xxhash64(F.col(text).cast("string")).alias("mark"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, place, begin, source_size, weight, target, words): a row a source, in the sources' order, null last.

    Sources share share times all words by weight; none gets more than max_repeat
    times its size, and what is above goes to the others by weight. With sources
    in the order of size a weight, those before the first that stays below its
    bound are the ones that reach it, so prefix sums give the level of all others.
    words is target rounded down, begin what the sources before have in all.
    """
    exact = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(38,0)")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-sizes")
    placed = running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1), "begin": F.col("source_size")}, "mixing-places")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    placed = materialize(placed.withColumn("weight", weight), "mixing-weights")
    total, all_weights = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    each = math.lcm(*weights)
    ratio = exact("source_size") * div(F.lit(each), F.col("weight"))
    before = running(placed, [ratio, F.col("place")], {"bounds": max_repeat * F.col("source_size"), "lighter": F.col("weight")}, "mixing-levels")
    left = exact(share.numerator * total) - share.denominator * exact("bounds")
    over = share.denominator * (exact(all_weights) - exact("lighter"))
    before = materialize(before.select(*placed.columns, left.cast("decimal(38,0)").alias("left"), over.cast("decimal(38,0)").alias("over"), "lighter"), "mixing-levels")
    full = F.col("left") * F.col("weight") > F.col("over") * max_repeat * F.col("source_size")
    level = before.where(~full).agg(F.min(F.struct("lighter", "left", "over"))).first()[0]
    if level is None:
        target, words = (max_repeat * F.col("source_size")).cast("double"), max_repeat * F.col("source_size")
    else:
        mine = F.lit(int(level.left)).cast("decimal(38,0)") * F.col("weight")
        target = F.when(full, (max_repeat * F.col("source_size")).cast("double")).otherwise(mine.cast("double") / F.lit(float(level.over)))
        words = F.when(full, max_repeat * F.col("source_size")).otherwise(div(mine, F.lit(int(level.over)).cast("decimal(38,0)")))
    return before.select("source", "place", "begin", "source_size", "weight", target.alias("target"), words.cast("bigint").alias("words"))


def reversed_bits(x: Column, bits: Column | int) -> Column:
    """The lowest bits of x, of which it has no others, in the opposite order."""
    width = F.lit(bits) if isinstance(bits, int) else bits
    return F.conv(F.reverse(F.lpad(F.bin(x), width, F.lit("0"))), 2, 10).cast("bigint")


def _terms(x: Column, bits: int) -> Column:
    """array<struct l, r>: what counted needs of x, from 0 to 2 ** bits.

    The points below x are those that agree with x in the first bits, up to a one
    where they have zero; such points' numbers are the r of modulus 2 ** l.
    """
    digits = F.lpad(F.bin(x), bits, "0")
    at = F.filter(F.sequence(F.lit(1), F.lit(bits)), lambda k: F.substring(digits, k, F.lit(1)) == "1")
    each = F.transform(at, lambda k: F.struct(k.alias("l"), F.conv(F.reverse(F.concat(F.substring(digits, F.lit(1), k - 1), F.lit("0"))), 2, 10).cast("bigint").alias("r")))
    return F.when(x == 2**bits, F.array(F.struct(F.lit(0).alias("l"), F.lit(0).cast("bigint").alias("r")))).otherwise(each)


def _counted(i: Column, terms: Column) -> Column:
    """How many numbers below i have their point below the x of terms."""
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda n, t: n + F.call_function("shiftright", i - t["r"] + ones(t["l"]), t["l"]))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, place, rank, block, begin, stop): a row a slot; it takes the words begin to stop of its source.

    The slot's point lies in its source's interval of cumulative weights, which
    are numbers of slots. Slots whose point is in none, fewer than half, are left
    out. Of each source the last slot alone can be cut.
    """
    spark = sources.sparkSession
    size, words = F.col("source_size"), F.col("words")
    blocks, times = div(size + (block - 1), block), div(words, size)
    slots = times * blocks + div(words - times * size + (block - 1), block)
    counted = sources.where("words > 0").select("place", "source_size", "words", blocks.alias("blocks"), slots.alias("slots"))
    intervals = materialize(running(materialize(counted, "mixing-slots"), [F.col("place")], {"low": F.col("slots")}, "mixing-intervals"), "mixing-intervals")
    n = intervals.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, (n - 1).bit_length()) if n else 1
    high = F.col("low") + F.col("slots")
    ends = intervals.withColumns({"high": high, "below_low": _terms(F.col("low"), bits), "below_high": _terms(high, bits)})
    cells = ends.withColumn("cell", F.explode(F.sequence(div(F.col("low"), CELL), div(F.col("high") - 1, CELL))))
    points = spark.range(2**bits if n else 0).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point")).withColumn("cell", div(F.col("point"), CELL))
    met = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    ranked = met.withColumn("rank", _counted(F.col("slot"), F.col("below_high")) - _counted(F.col("slot"), F.col("below_low")))
    taken = ranked.withColumns({"block": F.col("rank") % F.col("blocks"), "round": div(F.col("rank"), F.col("blocks"))})
    stop = F.least((F.col("block") + 1) * block, "source_size", F.col("words") - F.col("round") * F.col("source_size"))
    return taken.select("slot", "place", "rank", "block", (F.col("block") * block).alias("begin"), stop.alias("stop"))


def placed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_repeat: int = MAX_REPEAT, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's place and target and the words that stand before them in it (at); and the sources."""
    rows = materialize(sized(docs, key, text, source, seed), "mixing-rows")
    sources = materialize(targets(rows, weights, share, max_repeat), "mixing-targets")
    order = [F.col("source").asc_nulls_last(), F.col("shuffled").asc(), F.col("key").asc_nulls_last(), F.col("mark").asc(), F.col("size").asc()]
    placed = running(rows, order, {"all_before": F.col("size")}, "mixing-order")
    known = sources.select(F.col("source").alias("own"), "place", "begin", "source_size", "target")
    known = F.broadcast(known) if sources.count() <= BROADCAST_SOURCES else known
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("own")))
    return placed.select("key", "source", "place", "source_size", "target", "size", (F.col("all_before") - F.col("begin")).alias("at")), sources


def _taken(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """placed, its rows with words, met with the slots that take some of them: first and last word of the source."""
    blocks = F.sequence(div(F.col("at"), block), div(F.col("at") + F.col("size") - 1, block))
    pieces = placed.where("size > 0").withColumn("block", F.explode(blocks))
    met = pieces.join(slots.select("slot", "place", "block", "begin", "stop"), ["place", "block"], "left")
    taken = F.col("slot").isNotNull()  # the block is in the mix
    return met.withColumns({"first": F.when(taken, F.greatest("at", "begin")), "last": F.when(taken, F.least(F.col("at") + F.col("size"), F.col("stop")))})


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_repeat: int = MAX_REPEAT, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself, (slot, offset, key, source, start, length): words start to start + length of a document stand in a slot, offset words after its begin.

    Cases as in mixed; documents without words are in no slot.
    """
    placed, sources = placed_documents(docs, weights, share, max_repeat, key, text, source, seed)
    met = _taken(placed, schedule(sources, block), block).where("last > first")
    return met.select("slot", (F.col("first") - F.col("begin")).alias("offset"), F.col("key").alias(key), F.col("source").alias(source), (F.col("first") - F.col("at")).alias("start"), (F.col("last") - F.col("first")).alias("length"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_repeat: int = MAX_REPEAT, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, taken) of every row: taken is how many of its words the mix takes, repeats counted.

    A source's taken words are its target rounded down, and no document is taken
    more than max_repeat times. A rerun takes the same words: documents are
    shuffled by the hash of their keys, ties by the hash of their texts.

    Null and empty texts have size 0 and nothing is taken from them; null sources
    are a source, the last one; null keys are kept. Repeated rows each have a
    place and words of their own. A very long text lies over many blocks, which
    are met by themselves, and a source of any size is cut like all others. An
    empty table gives an empty result; other columns are not read.
    """
    placed, sources = placed_documents(docs, weights, share, max_repeat, key, text, source, seed)
    placed = materialize(placed, "mixing-placed")
    met = _taken(placed, schedule(sources, block), block)
    one = [F.first(c).alias(c) for c in ("key", "size", "source_size", "target")]
    taken = F.sum(F.greatest(F.lit(0), F.coalesce(F.col("last") - F.col("first"), F.lit(0)))).cast("bigint").alias("taken")
    out = met.groupBy("place", "at").agg(*one, taken)  # a row with words has its place and at for itself
    columns = ["key", "size", "source_size", "target", "taken"]
    out = out.select(*columns).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")).select(*columns))
    return out.withColumnRenamed("key", key)
