"""A stored keyword index: posting blocks with bounds, and BM25 search that leaves out blocks which cannot reach the first k.

Documents are gathered in groups of so many at most, neighbours of similar length,
the same groups for all words. A block is one word's postings in one group: sorted keys, whole
numbers as differences from the first, with counts and lengths; and beside them the
largest share of a score that any of them can have.

The rarest words of a query give scores that its k-th best document reaches at
least. In each group the words of the lowest bounds, as far as these do not add up
to that score, cannot bring a document among the first k by themselves; only blocks
of the others are opened, and the rest just where documents are left in a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship
from . import stem
from .fulltext import B, K1, LEAST_IDF, bounded, query_terms, top_k
from .kept import kept

#: Documents in a group at most.
GROUP = 1024
#: Postings of a query's rarest words that are opened first, about, so that the k-th best score is known from below.
SEEDS = 1000
#: Postings of all queries' words up to which all are opened, as sums of bounds cost more then than they spare.
FEW = 1_000_000_000
#: Scores are compared with bounds up to this, as sums of doubles in another order differ.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """blocks: term, group, n, bound, tfs, lens, first and gaps or keys; documents in all and their mean length."""

    blocks: DataFrame
    key: str
    n: int
    mean: float
    stemmed: bool = False

    @property
    def whole(self) -> bool:
        return "gaps" in self.blocks.columns


def saturation(tf: Column, length: Column, mean: float) -> Column:
    """BM25's part of one word in one document, without its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def build(docs: DataFrame, key: str, text: str, terms=T.tokens, stemmed: bool = False, group: int = GROUP) -> Index:
    """The index of all documents, written.

    A first pass finds the mean length. In the second the documents of an Arrow
    batch are sorted by length and put in groups, and their words are counted and
    gathered to blocks there, so nothing is shuffled. All blocks of a group are in
    one file, each batch's by word; a search reads words, counts and bounds of all
    blocks, and opens those that it needs.
    stemmed: words without accents and endings, each distinct one stemmed once.
    Null texts count as documents, but have no length. Keys should be unique: what
    rows of one key bring adds up.
    """
    ship(docs.sparkSession)
    cut = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("words"))
    if stemmed:
        stems = kept(stem.stems(cut.select(F.explode("words").alias("word")).distinct(), "word"), "index-stems")
        each = cut.withColumn("row", F.monotonically_increasing_id())
        each = kept(each.select("key", "row", F.posexplode_outer("words").alias("pos", "word")), "index-words").join(bounded(stems), "word", "left")
        cut = each.groupBy("row", "key").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("stem").isNotNull(), F.struct("pos", "stem")))), lambda w: w["stem"]).alias("words")).drop("row")
    n, mean = cut.agg(F.count("*"), F.avg(F.size("words"))).first()
    mean = mean or 1.0
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    packed = f"tfs array<int>, lens array<int>, {'first bigint, gaps array<bigint>' if whole else f'keys array<{dict(docs.dtypes)[key]}>'}"

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = TaskContext.get().partitionId() << 32
        for batch in batches:
            lens = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.empty(len(lens), dtype=np.int64)
            rank[np.argsort(lens, kind="stable")] = np.arange(len(lens))
            order = pc.sort_indices(batch.column(0)).to_numpy()
            place = np.empty(len(lens), dtype=np.int64)  # by key
            place[order] = np.arange(len(lens))
            words = batch.column(1).flatten().dictionary_encode()
            if not len(words):
                continue
            doc, size = np.repeat(np.arange(len(lens)), lens), len(words.dictionary)
            own, tf = np.unique(words.indices.to_numpy().astype(np.int64) + size * place[doc], return_counts=True)
            code, doc = own % size, order[own // size]
            groups = rank[doc] // group
            by = np.lexsort((place[doc], groups, code))
            code, doc, groups, tf = code[by], doc[by], groups[by], tf[by]
            begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (groups[1:] != groups[:-1])]))
            offsets = pa.array(np.append(begin, len(code)), pa.int32())
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc] / mean))
            keys = batch.column(0).take(pa.array(doc))
            columns = [words.dictionary.take(pa.array(code[begin])), pa.array(known + groups[begin]), pa.array(np.diff(np.append(begin, len(code))), pa.int32()), pa.array(np.maximum.reduceat(part, begin))]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (tf, lens[doc])]
            if whole:
                found = keys.to_numpy(zero_copy_only=False).astype(np.int64)
                gaps = found - np.repeat(found[begin], np.diff(np.append(begin, len(code))))
                columns += [pa.array(found[begin]), pa.ListArray.from_arrays(offsets, pa.array(gaps))]
            else:
                columns.append(pa.ListArray.from_arrays(offsets, keys))
            known += int(groups.max()) + 1
            yield pa.RecordBatch.from_arrays(columns, names=["term", "group", "n", "bound", "tfs", "lens", *(("first", "gaps") if whole else ("keys",))])

    rows = cut.where(F.size("words") > 0)
    if whole:
        rows = rows.where("key IS NOT NULL")
    blocks = rows.mapInArrow(gathered, f"term string, group bigint, n int, bound double, {packed}")
    return Index(kept(blocks, "index-blocks"), key, n, mean, stemmed)


def opened(index: Index, blocks: DataFrame) -> DataFrame:
    """blocks with a row a posting: key, tf, len in place of the packed columns."""
    packed = ["first", "gaps", "tfs", "lens"] if index.whole else ["keys", "tfs", "lens"]
    keys = F.transform("gaps", lambda g: F.col("first") + g) if index.whole else F.col("keys")
    rest = [c for c in blocks.columns if c not in packed]
    return blocks.select(*rest, F.explode(F.arrays_zip(keys.alias("key"), F.col("tfs").alias("tf"), F.col("lens").alias("len"))).alias("p")).select(*rest, "p.*")


def weights(index: Index, asked: DataFrame) -> DataFrame:
    """(term, idf, df) of the words asked for; from the blocks' sizes alone."""
    df = index.blocks.select("term", "n").join(bounded(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    return df.select("term", F.greatest(F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF)).alias("idf"), "df")


def asked_terms(index: Index, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(query_key, term, times) of a table of queries; a stemmed index takes the stems of the words' parts."""
    asked = query_terms(queries, query_key, query_text)
    if not index.stemmed:
        return asked
    parts = asked.select(query_key, "times", F.explode(T.tokens(F.col("term"))).alias("word"))
    stems = stem.stems(parts.select("word").distinct(), "word")
    return parts.join(stems, "word").groupBy(query_key, F.col("stem").alias("term")).agg(F.sum("times").alias("times"))


def heads(index: Index, weighed: DataFrame, query_key: str) -> DataFrame:
    """(query_key, group, term, weight, most): a row for each block of a query's words, with the bound of its share; no posting is opened."""
    blocks = index.blocks.select("term", "group", "bound").join(bounded(weighed), "term")
    return blocks.select(query_key, "group", "term", "weight", (F.col("weight") * F.col("bound")).alias("most"))


def shares(index: Index, chosen: DataFrame, query_key: str) -> DataFrame:
    """(query_key, group, key, share): a row for each document in chosen blocks (query_key, group, term, weight): its words' shares of the score."""
    rows = opened(index, index.blocks.drop("n", "bound").join(chosen.select(query_key, "group", "term", "weight"), ["term", "group"]))
    share = F.sum(F.col("weight") * saturation(F.col("tf"), F.col("len"), index.mean)).alias("share")
    return rows.groupBy(query_key, "group", "key").agg(share)


def least_scores(index: Index, weighed: DataFrame, known: DataFrame, query_key: str, k: int, seeds: int = SEEDS) -> DataFrame:
    """(query_key, least): a score that the k-th best document has at least, from the rarest words; queries without k documents there have none."""
    rarest = Window.partitionBy(query_key).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = weighed.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("before") < seeds)
    found = shares(index, known.join(rare.select(query_key, "term"), [query_key, "term"]), query_key)
    best = top_k(found, query_key, [F.desc("share")], k).groupBy(query_key).agg(F.min("share").alias("least"), F.count("*").alias("n"))
    return best.where(F.col("n") == k).select(query_key, "least")


def split_blocks(known: DataFrame, least: DataFrame, query_key: str, slack: float) -> DataFrame:
    """known blocks with needed, and rest: what the words that are not needed can bring in their group.

    Words of the lowest bounds are not needed as long as these add up to less than
    the least score.
    """
    rising = Window.partitionBy(query_key, "group").orderBy("most", "term")
    out = known.join(bounded(least), query_key, "left").withColumn("upto", F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("needed", F.col("least").isNull() | (F.col("upto") >= F.col("least") - slack))
    whole = Window.partitionBy(query_key, "group")
    return out.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))).over(whole), F.lit(0.0))).drop("upto")


def fitting(index: Index, weighed: DataFrame, query_key: str, k: int, slack: float, blocks: list | None = None) -> DataFrame:
    """(query_key, key, share): a row for each document that may be among a query's first k, and what its words bring; the sum of a document's rows is its score."""
    known = kept(heads(index, weighed, query_key), "index-heads")
    least = kept(least_scores(index, weighed, known, query_key, k), "index-least")
    split = kept(split_blocks(known, least, query_key, slack), "index-split")
    group = [query_key, "group"]
    bounds = split.where("needed").groupBy(*group).agg(F.first("rest").alias("rest"), F.first("least").alias("least"))
    first = shares(index, split.where("needed"), query_key).join(bounds, group)
    left = kept(first.where(F.col("least").isNull() | (F.col("share") + F.col("rest") >= F.col("least") - slack)), "index-left")
    others = split.where("NOT needed").join(left.select(*group).distinct(), group, "left_semi")
    more = shares(index, others, query_key).join(left.select(query_key, "key"), [query_key, "key"], "left_semi")
    if blocks is not None:
        blocks += [split.count(), split.where("needed").count() + others.count(), left.count()]
    return left.select(query_key, "key", "share").unionByName(more.select(query_key, "key", "share"))


def search(index: Index, queries: DataFrame, query_key: str, query_text: str, k: int, digits: int | None = None, few: int = FEW, blocks: list | None = None) -> DataFrame:
    """(query_key, key, score, rank): the first k documents of each query by BM25, exact, ties by key.

    digits rounds scores before they are ranked. blocks, if given, gets the numbers
    of blocks of the queries' words, of those opened and of documents left, where
    more than few postings are concerned. Queries without known words have no rows.
    """
    asked = asked_terms(index, queries, query_key, query_text)
    weighed = kept(asked.join(bounded(weights(index, asked)), "term").select(query_key, "term", "df", (F.col("idf") * F.col("times")).alias("weight")), "index-asked")
    if (weighed.agg(F.sum("df")).first()[0] or 0) <= few:
        rows = opened(index, index.blocks.drop("group", "n", "bound").join(bounded(weighed.drop("df")), "term"))
        parts = rows.select(query_key, "key", (F.col("weight") * saturation(F.col("tf"), F.col("len"), index.mean)).alias("share"))
    else:
        parts = fitting(index, weighed, query_key, k, SLACK if digits is None else 10.0**-digits, blocks)
    scored = parts.groupBy(query_key, "key").agg(F.sum("share").alias("score")).withColumnRenamed("key", index.key)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return top_k(scored, query_key, [F.desc("score"), F.asc(index.key)], k)


def documents_of(index: Index, terms: DataFrame) -> DataFrame:
    """terms (term and whatever else) with the key of each document that has the word."""
    packed = index.blocks.select("term", *[c for c in index.blocks.columns if c in ("first", "gaps", "keys", "tfs", "lens")])
    out = opened(index, packed.join(bounded(terms), "term"))
    return out.select(*terms.columns, F.col("key").alias(index.key))
