import zlib

import numpy as np
import pytest
from siftwell.llm import language_id, toxicity
from siftwell.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs

SF = "/root/testdata/sf0.1"


def fold(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op4_language_id"](spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.99


def brute_distance(text, profile, top):
    """Out-of-place distance, n-gram by n-gram."""
    words = bytes(c if chr(c).islower() and c < 128 or c >= 128 else 32 for c in text.lower().encode()).split()
    raw = b" " + b" ".join(words) + b" "
    counts = {}
    for n in range(1, 5):
        for k in range(len(raw) - n + 1):
            counts[raw[k : k + n]] = counts.get(raw[k : k + n], 0) + 1
    ranked = sorted(counts, key=lambda g: (-counts[g], int.from_bytes(g, "big")))[:top]
    place = {int(c): k for k, c in enumerate(profile)}
    return sum(abs(place[code] - k) if (code := int.from_bytes(g, "big")) in place else top for k, g in enumerate(ranked))


def test_language_distance_against_brute_force():
    texts = {"en": "the cat and the dog are here with them", "de": "der hund und die katze sind hier mit ihnen"}
    known = {k: language_id.ranking(*language_id.grams(t), 50) for k, t in texts.items()}
    ranker = language_id.Ranker(known, 50)
    for text in ("the dog is with the cat", "die katze ist hier", "Ünder thé hat"):
        d = {k: brute_distance(text, v, 50) for k, v in known.items()}
        name, score, distance, n = ranker.predict(text)
        best, rest = sorted(d.values())
        assert distance == pytest.approx(best / (50 * n)) and d[name] == best and score == pytest.approx((rest - best) / rest)


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = "some words of a text that is cut into chunks " * 40
    want = dict(zip(*map(np.ndarray.tolist, language_id.grams(text))))
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert dict(zip(*map(np.ndarray.tolist, language_id.grams(text)))) == want


def test_language_edges(spark):
    rows = edge_docs(spark)
    known = language_id.profiles(rows)
    got = language_id.identify(rows, known).collect()
    assert len(got) == rows.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {2, 3, 6, None} >= und >= {2, 3, 6}
    assert all(r.lang_pred == "und" for r in language_id.identify(rows, {}).collect())
    assert language_id.profiles(empty_docs(spark)) == {} and language_id.identify(empty_docs(spark), known).count() == 0
    kept = language_id.identify(rows, known, keep=True).select("row.*")
    assert kept.columns == rows.columns and kept.count() == rows.count()


def test_toxicity_held_out_ranking(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op5_toxicity"](spark, SF).collect()
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.9
    assert np.mean([p for _, y, p in held if not y]) < 0.01


def test_toxicity_edges(spark):
    rows = edge_docs(spark)
    words = "you are an idiot and a moron said the man near the river".split()
    more = spark.createDataFrame([(k, " ".join([*words, str(k), "x" * (k % 7)]) if k % 2 else f"a fine day number {k} in the town by the sea", 1 if k % 2 else 0) for k in range(100, 400)], "doc_id bigint, text string, toxic int")
    labels = more.select("doc_id", "toxic").unionByName(spark.createDataFrame([(1, None), (None, 1), (100, 0)], "doc_id bigint, toxic int"))
    model = toxicity.fit(more.drop("toxic"), labels)
    assert "idiot" in model.terms and "river" in model.terms and "town" not in model.terms
    got = toxicity.score(rows, model).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got) and all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 3, 5))
    assert toxicity.score(more, model).where("predicted <> doc_id % 2").count() == 0
    assert toxicity.score(empty_docs(spark), model).count() == 0
    none = toxicity.fit(rows, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(rows, none).collect()} == {0.0}
    assert toxicity.score(rows, none, keep=True).select("row.*").columns == rows.columns


def brute_vector(text, terms):
    """The features by their names, word by word."""
    import math
    import re

    if not text:
        return [0.0] * len(toxicity.FEATURES)
    words = re.findall(r"[^\W\d_]+", text.lower())
    n, letters = max(1, len(words)), sum(map(len, words))
    exact, stems = {t for t in terms if "*" not in t}, {t[:-1] for t in terms if "*" in t}
    hit = [k for k, w in enumerate(words) if w in exact]
    second = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    stem = [w for w in words if any(len(w) >= k and w[:k] in stems for k in toxicity.STEMS)]
    hidden = [w for w in re.findall(r"\S+", text) if len(w) <= toxicity.MASKED_CHARS and any(c.isalpha() and any(a.isalpha() for a in w[:k]) and w[k - 1] in "0123456789@$!|*._-" for k, c in enumerate(w))]
    plain = ["".join(re.findall(r"[^\W\d_]+", w.lower().translate(toxicity.LOOKALIKE))) for w in hidden]
    upper = re.findall("[" + "".join(sorted({c for c in text if c.isupper()})) + "]+", text) if any(map(str.isupper, text)) else []
    return [
        len(hit), 100 * len(hit) / n, len({words[k] for k in hit}), max((terms[words[k]] for k in hit), default=0), len(stem), 100 * len(stem) / n, 100 * len(second) / n,
        max((1 / (1 + abs(a - b)) for a in hit for b in second), default=0), sum(map(len, upper)) / max(1, letters), sum(len(u) > 1 for u in upper) / n,
        max(0, len(text) - letters - text.count(" ") - text.count("\n")) / len(text), text.count("!") / len(text), 100 * len(hidden) / n, sum(p in exact for p in plain), math.log1p(len(words)), letters / n,
    ]


def test_features_against_their_definitions(spark, sf):
    terms = {"idiot": 2.5, "moron": 3.0, "the": 1.0, "idio*": 1.0, "stup*": 1.5, "moro*": 1.0}
    kinds = toxicity.Kinds(terms)
    odd = ["", "YOU IDIOT!! you stup1d m0ron, i.d.i.o.t and id1ot", "You are stupidly kind. The end", "UPPER lower ÉTÉ", "!!!", "12 34", "x" * 30 + "1a", "a1b2 you the", "no-one co-op"]
    for text in odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]:
        assert toxicity.vector(text, kinds) == pytest.approx(brute_vector(text, terms)), text[:80]


def test_lexicon_against_a_count_of_all_terms(spark):
    import math
    import random

    rnd, rows = random.Random(2), []
    for k in range(400):
        label = int(k % 4 == 0)
        words = rnd.choices(["town", "river", "sea", "house", "walk", "stone"], k=8) + (rnd.choices(["vile", "nasty", "rotten"], k=2) if label or k % 40 == 1 else [])
        rows.append((" ".join([*words, f"n{k}"]), label))
    got = toxicity.lexicon(spark.createDataFrame(rows + rows[:20], "text string, label int"))
    seen = [({t for w in set(text.split()) for t in (w, *(w[:n] + "*" for n in toxicity.STEMS if len(w) >= n))}, label) for text, label in rows]
    seen = [({t for t in terms if not any(map(str.isdigit, t))} | {"n"}, label) for terms, label in seen]
    toxic, clean = sum(y for _, y in seen), sum(1 - y for _, y in seen)
    want = {}
    for term in set().union(*(t for t, _ in seen)):
        a, b = sum(term in t and y for t, y in seen), sum(term in t and not y for t, y in seen)
        lift = (a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))
        cells = ((a, toxic, a + b), (toxic - a, toxic, toxic + clean - a - b), (b, clean, a + b), (clean - b, clean, toxic + clean - a - b))
        g2 = sum(2 * k * math.log(k * (toxic + clean) / (size * total)) for k, size, total in cells if k)
        if a >= max(toxicity.MIN_TOXIC, math.ceil(toxicity.MIN_SHARE * toxic)) and lift >= toxicity.MIN_LIFT and g2 >= toxicity.MIN_G2:
            want[term] = math.log(lift)
    assert want and got == pytest.approx(want)


def test_curve_is_the_least_squares_rising_one(spark):
    """Pooled adjacent violators over the calibration fold's rows against the fitted curve."""
    rows = []
    for k in range(3_000):
        words = "you are an idiot and a moron" if k % 3 == 0 else "a fine day by the sea"
        rows.append((k, f"{words} {'idiot ' * (k % 4)}number {k} {'x' * (k % 9)}", int(k % 3 == 0 and k % 7 > 0 or k % 50 == 1)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    own = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 4)
    raw = model.trees.transform(toxicity.featured(own, model.terms).select("toxic", array_to_vector("features").alias("features"))).select("toxic", vector_to_array("probability")[1].alias("raw")).collect()
    pools = []
    for score in sorted({r.raw for r in raw}):
        pools.append([sum(r.toxic for r in raw if r.raw == score), sum(r.raw == score for r in raw), [score]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, n, at = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, pools[-1][2] + at]
    want = {score: a / n for a, n, at in pools for score in at}
    got = model.curve.transform(spark.createDataFrame([(s,) for s in want], "raw double")).collect()
    assert {r.raw: r.calibrated for r in got} == pytest.approx(want, abs=1e-6)


def test_repeated_texts_count_once_whatever_their_order(spark):
    words = "you are an idiot and a moron said the man".split()
    rows = [(k, " ".join([*words, str(k % 150)]) if k % 2 else f"a fine day number {k % 150} in the town", int(k % 2 or k % 90 == 0)) for k in range(600)]
    scores = []
    for parts, order in ((1, rows), (7, rows[::-1])):
        df = spark.createDataFrame(order, "doc_id bigint, text string, toxic int").repartition(parts)
        model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
        scores.append({r.doc_id: r.score for r in toxicity.score(df, model).collect()})
    assert scores[0] == pytest.approx(scores[1])


def brute_profile(texts, top):
    counts = {}
    for text in texts:
        words = bytes(c if chr(c).islower() and c < 128 or c >= 128 else 32 for c in text.lower().encode()).split()
        raw = b" " + b" ".join(words) + b" " if words else b""
        for n in range(1, 5):
            for k in range(len(raw) - n + 1):
                counts[raw[k : k + n]] = counts.get(raw[k : k + n], 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], int.from_bytes(g, "big")))[:top]


def test_whole_language_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    by = {}
    for r in docs:
        if fold(r.doc_id) and r.lang is not None and r.text is not None:
            by.setdefault(r.lang, []).append(r.text)
    known = {k: {g: p for p, g in enumerate(brute_profile(v, 400))} for k, v in by.items()}
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, sf).collect()}
    for d in docs:
        own = brute_profile([d.text or ""], 400)
        r = got[d.doc_id]
        if not own or not any(map(str.isalpha, d.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        apart = sorted((sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)), name) for name, p in known.items())
        assert r.lang_pred == apart[0][1] and r.distance == pytest.approx(apart[0][0] / (400 * len(own))) and r.score == pytest.approx((apart[1][0] - apart[0][0]) / apart[1][0])


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 2)
    rows = [(k, "the dog and the cat", "en") for k in range(30)] + [(k, "der hund und die katze", "de") for k in range(30, 50)] + [(k, f"junk {k}", f"j{k}") for k in range(50, 90)]
    assert set(language_id.profiles(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))) == {"en", "de"}
