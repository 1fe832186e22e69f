"""Operator 3, benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A seed is a fixed mask over token positions, 1 for a position that is hashed and
0 for one that is ignored, so a substituted token under a 0 does no harm. Hashes
of all masks at all positions of the documents are joined with those of the
benchmark; each hit names an alignment (document, item, offset), and around it
the two token sequences are compared position by position.

No alignment of the least similarity is without a hit. That is tested, mask by
mask, for each length of items that the benchmark has; items of a length for
which the masks fail (short ones) are hashed by runs of so many tokens as always
stand between substitutions, those that allow none whole.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: For 15 tokens and any 3 substitutions (similarity 0.8), at least one of these still hits; so for 7 to 9, 12 to 14 and 16 to 24 tokens.
MASKS = ("11011", "1110011")
MIN_SIMILARITY = 0.8
#: An alignment is judged on its best stretch of so many tokens (the whole item, if shorter).
STRETCH = 24
#: Entries of a few bytes up to which the benchmark's hashes, its tokens and the hit documents' hashes are broadcast.
BROADCAST_ENTRIES = 500_000
#: Beyond that, each hash is dealt to so many tasks.
SALT = 16


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; an empty string may stand at either end."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def seeds(words: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """array<array<bigint>>: for each mask its hashes at all positions of the array of words."""

    def of(h: Column, mask: str) -> Column:
        last = F.size(h) - len(mask)
        at = [p for p, c in enumerate(mask) if c == "1"]
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + p) for p in at]))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # a lambda's variable, so that the hashed words are computed once
    return F.transform(F.array(hashed), lambda h: F.array(*[of(h, m) for m in masks])).getItem(0)


@lru_cache(maxsize=256)
def masks_for(width: int, masks: tuple[str, ...] = MASKS, min_similarity: float = MIN_SIMILARITY) -> tuple[str, ...]:
    """The masks, if one of them hits in width tokens whichever are substituted; else a run that always stands between substitutions."""
    wrong = width - math.ceil(min_similarity * width - 1e-9)
    if math.comb(width, wrong) <= 50_000:  # more places are not tried out
        placed = [{start + p for p, c in enumerate(m) if c == "1"} for m in masks for start in range(width - len(m) + 1)]
        if all(any(not seed & set(gone) for seed in placed) for gone in combinations(range(width), wrong)):
            return masks
    return ("1" * math.ceil((width - wrong) / (wrong + 1)),)


def _bounded(df: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(df) if entries <= BROADCAST_ENTRIES else df


def _best(words: Column, own: Column, shift: Column, width: Column) -> Column:
    """struct n, doc, own: the most equal tokens in width neighbours of one alignment, and the negated places where they start; null if the overlap is shorter."""
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size(own), F.size(words) - shift)
    same = F.transform(F.sequence(low, high - 1), lambda j: F.when(F.get(words, j + shift) == F.get(own, j), 1).otherwise(0))

    def over(equal: Column) -> Column:
        def step(seen: Column, k: Column) -> Column:
            n = seen["n"] + F.get(equal, k) - F.when(k >= width, F.get(equal, k - width)).otherwise(0)
            more = (k >= width - 1) & (n > seen["most"])
            return F.struct(n.alias("n"), F.when(more, n).otherwise(seen["most"]).alias("most"), F.when(more, k - width + 1).otherwise(seen["at"]).alias("at"))

        def named(seen: Column) -> Column:
            return F.struct(seen["most"].alias("n"), (-(low + seen["at"] + shift)).alias("doc"), (-(low + seen["at"])).alias("own"))

        # a window that slides by one token, so that a stretch costs a step and not its length
        return F.aggregate(F.sequence(F.lit(0), F.size(equal) - 1), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("most"), F.lit(0).alias("at")), step, named)

    # a lambda's variable, so that the comparison is made once
    return F.when(high - low >= width, F.transform(F.array(same), over).getItem(0))


def _runs(places: Column) -> Column:
    """array<struct first, last, step>: sorted distinct places as runs of equal steps; a place alone has step 0."""

    def gap(i: Column) -> Column:
        return F.get(places, i) - F.get(places, i - 1)

    starts = F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda i: (i == 0) | ((i > 1) & (gap(i) != gap(i - 1))))

    def of(begun: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(begun, k + 1), F.size(places)) - 1
            return F.struct(F.get(places, start).alias("first"), F.get(places, end).alias("last"), F.when(end > start, gap(start + 1)).otherwise(0).alias("step"))

        return F.transform(begun, run)

    return F.transform(F.array(starts), of).getItem(0)


def _differences(places: Column, others: Column) -> Column:
    """All distinct differences of two sorted lists of places; of two runs of one step they are a run, however long both are."""

    def pair(x: Column, y: Column) -> Column:
        step = F.greatest(x["step"], y["step"])
        alike = (x["step"] == y["step"]) | (x["step"] == 0) | (y["step"] == 0)
        run = F.sequence(x["first"] - y["last"], x["last"] - y["first"], F.greatest(step, F.lit(1)))
        each = F.transform(F.sequence(y["first"], y["last"], F.greatest(y["step"], F.lit(1))), lambda a: F.transform(F.sequence(x["first"], x["last"], F.greatest(x["step"], F.lit(1))), lambda p: p - a))
        return F.when(alike, run).otherwise(F.flatten(each))

    def all_pairs(mine: Column, own: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(mine, lambda x: F.flatten(F.transform(own, lambda y: pair(x, y))))))

    # lambdas' variables, so that the runs are made once
    runs = F.transform(F.array(F.struct(places.alias("mine"), others.alias("own"))), lambda p: F.struct(_runs(p["mine"]).alias("mine"), _runs(p["own"]).alias("own")))
    return F.transform(runs, lambda r: all_pairs(r["mine"], r["own"])).getItem(0)


def _seeded_items(items: DataFrame, masks: tuple[str, ...], min_similarity: float, stretch: int) -> tuple[DataFrame, tuple[str, ...]]:
    """(item, hash, ats): all places of each seed of an item, under the masks for its length; and the masks in use."""
    lengths = sorted(r[0] for r in items.select(F.least(F.lit(stretch), F.size("own"))).distinct().collect())  # stretch rows at most
    used: dict[str, list[int]] = {}
    for n in lengths:
        for mask in masks_for(n, masks, min_similarity):
            used.setdefault(mask, []).append(n)
    made = None
    for mask, of in used.items():
        own = items.where(F.least(F.lit(stretch), F.size("own")).isin(of)).select("item", F.posexplode(seeds(F.col("own"), (mask,)).getItem(0)).alias("at", "hash"))
        made = own if made is None else made.unionByName(own)
    if made is None:
        made = items.select("item", F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("hash")).where(F.lit(False))
    return made.groupBy("item", "hash").agg(F.sort_array(F.collect_set("at")).alias("ats")), tuple(used)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, min_similarity: float = MIN_SIMILARITY, stretch: int = STRETCH) -> DataFrame:
    """(key, item, doc_start, item_start, matched, compared, similarity): a row for each document and benchmark item that it holds.

    matched of compared aligned tokens are equal in the best stretch, and at
    least min_similarity of them are. Of several alignments of a pair the best
    is returned, ties by position. Items of every length are looked for, those of
    one word too; an item of fewer than five tokens must stand there word for
    word. Texts that share an item id are all looked for, under that id.

    Null or empty texts match nothing. Rows with a null key or item take part
    and keep the null. Repeated rows give one result a pair; very long texts are
    read whole; an empty table gives an empty result; other columns are not read.
    """
    # documents go by the hash of their text, so that copies and rows without a key need no group of their own
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("doc", F.xxhash64("text"))
    items = materialize(benchmark.select(F.col(item).alias("item"), F.array_remove(tokens(F.col(item_text)), "").alias("own")).distinct().where(F.size("own") > 0), "decontaminate-items")
    n_tokens = items.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
    tests, used = _seeded_items(items, masks, min_similarity, stretch)
    tests = materialize(tests, "decontaminate-seeds")
    seeded = rows.select("doc", F.explode(seeds(tokens(F.col("text")), used) if used else F.array(F.array().cast("array<bigint>"))).alias("hashes")).select("doc", F.posexplode("hashes").alias("pos", "hash"))
    if (n_tests := tests.count()) <= BROADCAST_ENTRIES and n_tokens <= BROADCAST_ENTRIES:
        met = seeded.join(F.broadcast(tests), "hash")
    else:  # a hash that very many documents have is dealt to several tasks
        salted = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = seeded.withColumn("salt", F.pmod("doc", F.lit(SALT)).cast("int")).join(salted, ["hash", "salt"])
    # A seed at one place of the item gives one shift a hit. One that the item repeats is kept apart: its places in the
    # document are met with those in the item run by run, so that texts of one repeated phrase don't give the product of both.
    first = F.get("ats", F.lit(0))
    met = met.select("doc", "item", F.when(F.size("ats") > 1, F.col("hash")).alias("seed"), (F.col("pos") - first).alias("shift"), F.when(F.size("ats") > 1, F.transform("ats", lambda a: a - first)).alias("ats"))
    met = met.groupBy("doc", "item", "seed").agg(F.collect_set("shift").alias("shifts"), F.first("ats").alias("ats"))
    met = met.select("doc", "item", F.when(F.col("ats").isNull(), F.col("shifts")).otherwise(_differences(F.sort_array("shifts"), F.col("ats"))).alias("shifts"))
    # a document has no more alignments with an item than both have tokens, so one row holds them
    hits = met.groupBy("doc", "item").agg(F.array_distinct(F.flatten(F.collect_list("shifts"))).alias("shifts"))
    hits = materialize(hits.withColumnRenamed("item", "hit_item"), "decontaminate-hits")
    found = materialize(hits.select("doc").distinct(), "decontaminate-docs")
    texts = rows.join(_bounded(found, found.count()), "doc", "left_semi").select("doc", "key", tokens(F.col("text")).alias("words"))
    pairs = texts.join(hits, "doc").join(_bounded(items, n_tokens), F.col("hit_item").eqNullSafe(F.col("item")))
    width = F.least(F.lit(stretch), F.size("own"))
    best = F.array_max(F.transform("shifts", lambda shift: _best(F.col("words"), F.col("own"), shift, width)))
    found = pairs.select("key", "item", width.alias("width"), best.alias("b"), (F.get("words", F.lit(0)) == "").cast("int").alias("blank"))
    found = found.where(F.col("b.n") >= F.lit(min_similarity) * F.col("width") - F.lit(1e-9))
    best = F.struct((F.col("b.n") / F.col("width")).alias("similarity"), F.col("b.n").alias("matched"), (F.col("b.doc") + F.col("blank")).alias("doc"), F.col("b.own").alias("own"), F.col("width").alias("compared"))
    found = found.select("key", "item", best.alias("b")).groupBy("key", "item").agg(F.max("b").alias("b"))
    return found.select(
        F.col("key").alias(key), F.col("item").alias(item), (-F.col("b.doc")).cast("bigint").alias("doc_start"), (-F.col("b.own")).cast("bigint").alias("item_start"),
        F.col("b.matched").cast("bigint").alias("matched"), F.col("b.compared").cast("bigint").alias("compared"), F.col("b.similarity").alias("similarity"),
    )
