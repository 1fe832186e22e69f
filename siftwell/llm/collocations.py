"""Operator 12, mining of collocations.

Three passes over the texts. The first counts words, and how often words and
phrases fall into the buckets of tables of hashes. A phrase can be frequent only if
its bucket is, and so are the buckets of all words and phrases in it; the second
pass gathers those that occur, with their numbers in each task, and those whose
numbers reach least together are the candidates. So however full the tables are,
no more are counted than there are frequent phrases. The third counts them: double-array tries of the
candidates are broadcast, numpy advances the states of all text positions together,
a word a level, and counts accepting states; the tasks' counts are summed in
shards. More candidates than a trie may hold go into several tries, and more than a few
tries into several passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, materialize
from .trie import Trie

LEAST = 100
LONGEST = 5
FIRST = 2000
#: Phrases of 1 to so many words have tables of hash buckets, each of BUCKETS bytes in a task; longer ones go by the phrases in them.
HASHED = 5
BUCKETS = 1 << 24
#: Buckets or states in a shard of counts.
SHARD = 1 << 16
#: Words or phrases that a task holds before it hands them on.
HELD = 250_000
#: Words that numpy works on together.
BATCH_WORDS = 250_000
#: Candidates travel in so many shards, a row a shard and task, and each shard is gathered in one task.
GATHERED = 4096
#: Candidates in a trie, and tries in a pass.
CANDIDATES, TRIES = 1_000_000, 3
#: Long texts are read in parts of so many bytes, cut between words.
PART_BYTES = 1_000_000

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Lower-cases A-Z; what ends a piece becomes a line feed, a tab a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _SEPARATORS else 32 if c == 9 else c for c in range(256))
END = b"\n"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """The words in order, END between pieces."""
    return list(filter(None, text.translate(TABLE).replace(END, b" \n ").split(b" ")))


def parts(text: bytes, longest: int = LONGEST, part_bytes: int = PART_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """A text's words in parts, each with the next part's first words, and how many of them are its own."""
    if len(text) <= part_bytes:
        yield (found := words(text)), len(found)
        return
    text, at, held = text.translate(TABLE), 0, []
    while at < len(text):
        stop = text.find(b" ", at + part_bytes)
        stop = len(text) if stop < 0 else stop
        own = words(text[at:stop])
        if held and len(own) < longest and stop < len(text):
            held, at = held + own, stop
            continue
        if held:
            yield held + own[: longest - 1], len(held)
        held, at = own, stop
    if held:
        yield held, len(held)


class _Batch:
    """The words of many texts one after the other, END after each text."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.texts: list[tuple[str, int, int]] = []  # language, words with END, words of its own

    def add(self, lang: str, found: list[bytes], own: int) -> None:
        self.words += found
        self.words.append(END)
        self.texts.append((lang, len(found) + 1, own))

    def each(self, of: dict[str, int]) -> np.ndarray:
        """A number a language, repeated for its words; 0 for languages that of doesn't have."""
        return np.repeat(np.array([of.get(lang, 0) for lang, _, _ in self.texts], dtype=np.int64), [n for _, n, _ in self.texts])

    def own(self) -> np.ndarray:
        """Which words are a text's own, no copies of the next part's."""
        n, own = (np.array(x, dtype=np.int64) for x in zip(*[(n, own) for _, n, own in self.texts]))
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) < np.repeat(own, n)


def _batches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Batch]:
    """Columns lang and text, gathered to about BATCH_WORDS words."""
    held = _Batch()
    for batch in batches:
        for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            for found, own in parts(x.as_py() or b"", longest):
                held.add(lang, found, own)
                if len(held.words) > BATCH_WORDS:
                    yield held
                    held = _Batch()
    if held.words:
        yield held


def _mixed(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(20)) + np.uint64(1)


def _hashes(batch: _Batch, longest: int) -> Iterator[np.ndarray]:
    """For each length from 1 on: hashes of the phrases from each word on, with the language; 0 where a piece or the batch ends before."""
    seeds = {lang: crc32(lang.encode()) for lang, _, _ in batch.texts}
    one = np.fromiter(map(crc32, batch.words), dtype=np.uint64, count=len(batch.words))
    inside = np.fromiter((w != END for w in batch.words), dtype=bool, count=len(batch.words))
    now, alive = one ^ (batch.each(seeds).astype(np.uint64) << np.uint64(32)), inside
    yield np.where(alive, _mixed(now), np.uint64(0))
    for k in range(1, longest):
        now, alive = (now[:-1] * _MIX) ^ one[k:], alive[:-1] & inside[k:]
        yield np.where(alive, _mixed(now), np.uint64(0))


def _add(table: np.ndarray, hashes: np.ndarray) -> None:
    """Counts hashes in their buckets, up to the largest byte."""
    at, n = np.unique((hashes % np.uint64(len(table))).astype(np.uint32), return_counts=True)
    table[at] = np.minimum(table[at] + np.minimum(n, 255), 255)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text")).where(F.length("text") > 0)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, buckets: int = BUCKETS) -> DataFrame:
    """First pass: rows (lang, phrase, f) of words, and (level, shard, counts) of buckets, both by task.

    A bucket's count is a byte a task: more than least need not be told apart, as
    sums of counts cut there reach least when the counts do.
    """
    ship(docs.sparkSession)
    levels, cut = min(HASHED, longest), min(least, 255)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "f", "level", "shard", "counts"]
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        tables = [np.zeros(buckets, dtype=np.uint8) for _ in range(levels)]
        found: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, own in found.items():
                own.pop(END, None)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own.keys()), pa.binary()), pa.array(list(own.values()), pa.int64()), *(pa.nulls(len(own), k) for k in kinds[3:])], names=names)
            found.clear()

        for batch in _batches(batches, longest):
            at = 0
            for name, n, own in batch.texts:
                found.setdefault(name, Counter()).update(batch.words[at : at + own])
                at += n
            own = batch.own()
            for table, h in zip(tables, _hashes(batch, levels)):
                _add(table, h[(h > 0) & own[: len(h)]])
            if sum(map(len, found.values())) > HELD:
                yield from told()
        yield from told()
        for level, table in enumerate(tables):
            for shard in range(0, buckets, SHARD):
                part = table[shard : shard + SHARD]
                if part.any():
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:3]), pa.array([level], pa.int32()), pa.array([shard // SHARD], pa.int32()), pa.array([compress(np.minimum(part, cut).tobytes(), 1)], pa.binary())], names=names)

    return _rows(docs, text, lang).mapInArrow(counted, "lang string, phrase binary, f bigint, level int, shard int, counts binary")


def frequent_buckets(counted: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS) -> list[np.ndarray]:
    """Of each level a table of booleans: the buckets whose counts, over all tasks, reach least."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for level, shard, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own, key = np.frombuffer(decompress(counts.as_buffer()), dtype=np.uint8), (level, shard)
                total[key] = total[key] + own if key in total else own.astype(np.int64)
        for (level, shard), own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([shard], pa.int32()), pa.array([np.packbits(own >= min(least, 255)).tobytes()], pa.binary())], names=["level", "shard", "bits"])

    sums = counted.where("counts IS NOT NULL").select("level", "shard", "counts").repartition("level", "shard").mapInArrow(summed, "level int, shard int, bits binary")
    out = [np.zeros(buckets, dtype=bool) for _ in range(min(HASHED, longest))]
    for r in sums.toLocalIterator():  # a bit a bucket in all
        own = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8)).astype(bool)
        part = out[r.level][r.shard * SHARD : (r.shard + 1) * SHARD]
        part[:] = own[: len(part)]
    return out


def candidates(docs: DataFrame, tables: list[np.ndarray], text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Second pass: (lang, phrase), distinct: phrases whose bucket and phrases within may be frequent, and that all tasks together gather least times."""
    bits = docs.sparkSession.sparkContext.broadcast([np.packbits(t) for t in tables])
    buckets = len(tables[0])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = bits.value, {}

        def frequent(table: np.ndarray, h: np.ndarray) -> np.ndarray:
            at = (h % np.uint64(buckets)).astype(np.int64)
            return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

        def told() -> Iterator[pa.RecordBatch]:
            shards: dict[int, tuple[list[bytes], list[int]]] = {}
            for name, own in held.items():
                before = name.encode() + END
                for phrase, n in own.items():
                    phrases, times = shards.setdefault(crc32(phrase) % GATHERED, ([], []))
                    phrases.append(before + phrase)
                    times.append(n)
            phrases, times = zip(*shards.values()) if shards else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(shards.keys()), pa.int32()), pa.array(phrases, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names=["shard", "phrases", "times"])
            held.clear()

        for batch in _batches(batches, longest):
            names = sorted({name for name, _, _ in batch.texts})
            own, langs, fit = batch.own(), batch.each({name: i for i, name in enumerate(names)}), None
            counters = [held.setdefault(name, Counter()) for name in names]
            for k, h in enumerate(_hashes(batch, longest)):
                now = h > 0
                if k < len(tables):
                    now &= frequent(tables[k], h)
                if fit is not None:  # all words but the last, and all but the first, are as frequent at least
                    now &= fit[:-1] & fit[1:]
                fit = now
                if not k:  # words are counted already
                    continue
                at = np.flatnonzero(now & own[: len(now)])
                at = at[np.argsort(langs[at], kind="stable")]
                for some in np.split(at, np.flatnonzero(np.diff(langs[at])) + 1):
                    if len(some):
                        counters[langs[some[0]]].update([b" ".join(batch.words[i : i + k + 1]) for i in some.tolist()])
            if sum(map(len, held.values())) > HELD:
                yield from told()
        yield from told()

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = -1, {}

        def told() -> Iterator[pa.RecordBatch]:
            parts = [x.rsplit(END, 1) for x, n in found.items() if n >= least]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x, _ in parts], pa.string()), pa.array([x for _, x in parts], pa.binary())], names=["lang", "phrase"])

        for batch in batches:
            for shard, phrases, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if shard != now:
                    yield from told()
                    now, found = shard, {}
                for phrase, n in zip(phrases.values.to_pylist(), times.values.to_pylist()):
                    found[phrase] = found.get(phrase, 0) + n
        yield from told()

    shards = _rows(docs, text, lang).mapInArrow(gathered, "shard int, phrases array<binary>, times array<bigint>")
    return shards.repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(united, "lang string, phrase binary")


def counts(docs: DataFrame, wanted: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, limit: int = CANDIDATES, tries: int = TRIES) -> DataFrame:
    """Third pass: (lang, phrase, f) of those wanted that occur least times or more; a trie for each limit of them, a pass for so many tries."""
    parts = max(1, -(-wanted.count() // limit))
    # by hash, a few more than limit may meet in one trie
    dealt = wanted.withColumn("nth", F.pmod(F.xxhash64("lang", "phrase"), F.lit(parts)))
    each = [dealt.where(F.col("nth") == nth).select("lang", "phrase") for nth in range(parts)]
    out = None
    for first in range(0, parts, tries):
        found = materialize(_counted(docs, each[first : first + tries], text, lang, longest, least), "collocation-counts")
        out = found if out is None else out.unionByName(found)
    return out


def _coded(own: pa.Table, code: dict[bytes, int], roots: dict[str, int], longest: int) -> np.ndarray:
    """Codes of languages and words of phrases, a row each; new ones get the next codes."""
    after = len(code) + len(roots) + 1
    names, split = (c.combine_chunks() for c in (own.column(0), pc.split_pattern(own.column(1).cast(pa.string()), " ")))
    names, words, lens = names.dictionary_encode(), split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy().astype(np.int64)
    for known, new in ((roots, names.dictionary.to_pylist()), (code, words.dictionary.cast(pa.binary()).to_pylist())):
        for x in new:
            if known.setdefault(x, after) == after:
                after += 1
    sequences = np.zeros((len(lens), longest + 1), dtype=np.int32)
    sequences[:, 0] = np.array([roots[x] for x in names.dictionary.to_pylist()], dtype=np.int32)[names.indices.to_numpy()]
    row = np.repeat(np.arange(len(lens)), lens)
    sequences[row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens) + 1] = np.array([code[x] for x in words.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int32)[words.indices.to_numpy()]
    return sequences


def _counted(docs: DataFrame, each: list[DataFrame], text: str, lang: str, longest: int, least: int) -> DataFrame:
    spark = docs.sparkSession
    code, roots, tries, names, begins = {}, {}, [], None, [0]
    for some in each:
        own = some.toArrow()
        trie = Trie(_coded(own, code, roots, longest)) if len(own) else Trie(np.zeros((0, longest + 1), dtype=np.int32))
        named = pa.table({"name": own.column(0), "words": own.column(1), "its": pa.array(trie.nodes + begins[-1], pa.int64())})
        named = materialize(spark.createDataFrame(named), "collocation-names")
        names = named if names is None else names.unionByName(named)
        tries.append(trie)
        begins.append(-(-(begins[-1] + trie.size) // SHARD) * SHARD)  # each trie begins a shard
    sent = spark.sparkContext.broadcast((code, roots, tries))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, roots, tries = sent.value
        totals, held = [np.zeros(t.size, dtype=np.int64) for t in tries], [[] for _ in tries]
        known = code.get

        def add(nth: int) -> None:
            if held[nth]:
                totals[nth] += np.bincount(np.concatenate(held[nth]), minlength=len(totals[nth]))
                held[nth].clear()

        for batch in _batches(batches, longest):
            all_codes = np.fromiter((known(w, 0) for w in batch.words), dtype=np.int64, count=len(batch.words))
            all_begin, mine = batch.each(roots), batch.own()
            for nth, trie in enumerate(tries):
                codes, begin = (np.where(c <= trie.codes, c, 0) for c in (all_codes, all_begin))
                at = np.flatnonzero((codes > 0) & (begin > 0) & mine)
                there, states = trie.step(np.full(len(at), trie.root), begin[at])
                at = at[there]
                for k in range(longest):
                    inside = at + k < len(codes)
                    at, states = at[inside], states[inside]
                    there, states = trie.step(states, codes[at + k])
                    at = at[there]
                    if not len(at):
                        break
                    held[nth].append(states.astype(np.int32))
                if sum(map(len, held[nth])) > trie.size:  # so that counting costs no more than the states
                    add(nth)
        for nth, (total, begin) in enumerate(zip(totals, begins)):
            add(nth)
            for shard in range(0, len(total), SHARD):
                part = total[shard : shard + SHARD]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([(begin + shard) // SHARD], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["shard", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(part.as_buffer(), dtype="<i8")
                total[shard] = total[shard] + part if shard in total else part
        for shard, part in total.items():
            enough = np.flatnonzero(part >= least)
            yield pa.RecordBatch.from_arrays([pa.array(enough + shard * SHARD), pa.array(part[enough])], names=["node", "f"])

    shards = _rows(docs, text, lang).mapInArrow(counted, "shard int, counts binary")
    sums = shards.repartition(F.col("shard")).mapInArrow(summed, "node bigint, f bigint")
    return sums.join(names, F.col("node") == F.col("its")).select(F.col("name").alias("lang"), F.col("words").alias("phrase"), "f")


def scored(frequent: DataFrame, totals: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates, each by its lowest-scoring cut; frequent: (lang, phrase, f) with the words, totals: (lang, n)."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    split = F.split(F.col("phrase"), " ")
    cuts = frequent.where(F.size(split) > 1).select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.size(split) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.lit(longest)), " ").alias("right"))
    first, rest = (frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r")))
    cuts = cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).join(totals, "lang")
    score = F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(38,0)"), wide("l") * wide("r"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, limit: int = CANDIDATES, buckets: int = BUCKETS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first collocations.

    Phrases are 2 to longest words in one piece, with least occurrences or more.
    A phrase inside a longer one of the same count goes. It is enough to look one
    word further, as all between have that count too.

    Null and empty texts have no words; a null language is the language "und",
    together with one of that name. Repeated rows count as often as they occur.
    Very long texts are read in parts that share their last words. Ties of the
    score go by count, then by the phrase's bytes. Without frequent phrases, as
    in an empty table, the result is empty; other columns are not read.
    """
    counted = materialize(word_counts(docs, text, lang, longest, least, buckets), "collocation-words")
    alone = counted.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    totals = materialize(counted.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("f").alias("n")), "collocation-totals")
    alone = materialize(alone.where(F.col("f") >= least), "collocation-frequent-words")
    wanted = materialize(candidates(docs, frequent_buckets(counted, least, longest, buckets), text, lang, longest, least), "collocation-candidates")
    discard(counted)
    phrases = counts(docs, wanted, text, lang, longest, least, limit)
    frequent = materialize(alone.unionByName(phrases).select("lang", F.col("phrase").cast("string").alias("phrase"), "f"), "collocation-frequent")
    all_scored = scored(frequent, totals, longest)
    split = F.split(F.col("phrase"), " ")
    longer = frequent.where(F.size(split) > 2).select("lang", "f", split.alias("w"))
    inner = F.explode(F.array(*[F.array_join(F.slice("w", F.lit(1 + k), F.size("w") - 1), " ") for k in (0, 1)]))
    inside = longer.select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    left = all_scored.join(inside, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer") < F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()))
    return left.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
