import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from siftwell.functions import text as T
from siftwell.functions import urls as U
from siftwell.operators import classify, context, fusion, graph, metrics, quality, vector_index, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("url, want", [("https://x/w/Stone", True), ("https://x/w/Stone?a=1", True), ("https://x/w/Category:A", False), ("https://x/api.php?a", False), ("https://x/w/A?action=edit", False), ("https://x/w/special:X", False), ("https://x/w/A?oldid=1", False)])
def test_allowed(spark, url, want):
    assert one(spark, U.allowed(F.col("u")), u=url) is want


@pytest.mark.parametrize("href, want", [("/w/Iron_Ore#x", "Iron Ore"), ("/w/A%27s?x", "A's"), ("/w/C%2B+", "C++"), ("/w/File:A", None), ("/x/A", None), ("/w/", None), ("/w/User_guide", "User guide"), ("/w/100%", "100%")])
def test_href_to_title(spark, href, want):
    assert one(spark, U.href_to_title(F.col("u")), u=href) == want


@pytest.mark.parametrize("url, want", [("https://s/images/Water_A-a1.png", "Water_A-a1.webp"), ("https://s/images/thumb/W.png/300px-W.png", "W.webp"), ("https://s/images/W_%28a%29.png?1", "W_(a).webp"), ("https://s/images/a/b/N.x.gif", "N.x.webp"), ("https://s/w/N.png", None)])
def test_image_filename(spark, url, want):
    assert one(spark, U.image_filename(F.col("u")), u=url) == want


def test_original_url(spark):
    assert one(spark, U.original_url(F.col("u")), u="https://s/images/thumb/a/N.png/30px-N.png") == "https://s/images/a/N.png"


@pytest.mark.parametrize("text, want", [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 2}\n``` y', '{"a": 2}'), ('so {"a": {"b": 3}} end', '{"a": {"b": 3}}'), ("none {here", None)])
def test_json_object(spark, text, want):
    assert one(spark, T.json_object(F.col("t")), t=text) == want


def test_codes_to_spans(spark):
    assert one(spark, T.format_spans(F.col("t")), t="a§aG§lB§rx§") == 'a<span style="color: #55FF55">G</span><span style="color: #55FF55; font-weight: bold">B</span>x'
    assert one(spark, T.format_spans(F.col("t")), t="plain") == "plain"
    assert one(spark, T.expand_tags(F.col("t")), t="[tip]a\nb[/tip] [term]c[/note]") == "§aa\nb§r [term]c[/note]"


def test_citations_and_thinking(spark):
    assert one(spark, T.citation_numbers(F.col("t")), t="a [1] b [Source 12] [x] [3]") == [1, 12, 3]
    assert one(spark, T.strip_thinking(F.col("t")), t="<THINK>a\nb</think> c <think>d</think>") == "c"


def test_faithfulness_is_null_without_a_right_source(spark):
    rows = spark.createDataFrame([("see [2]", ["A", "The Page"], "page"), ("see [1]", ["A", "The Page"], "page"), ("see [1]", ["A"], "page"), ("x", ["a"] * 5 + ["page"], "page")], "a string, t array<string>, s string")
    assert [r[0] for r in rows.select(metrics.citation_faithfulness(F.col("a"), F.col("t"), F.col("s"))).collect()] == [1.0, 0.0, None, None]


def test_lcs_equals_the_table():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.choice("abcdef"[: rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert metrics.lcs_length(a, b) == row[-1] == metrics.lcs_length(b, a)
    a, b = ([f"w{rnd.randint(0, 3000)}" for _ in range(20_000)] for _ in range(2))
    began = time.process_time()
    metrics.lcs_length(a, b)
    assert time.process_time() - began < 1


def test_lcs():
    assert metrics.lcs_length("a b c d".split(), "b x d".split()) == 2 and metrics.lcs_length([], ["a"]) == 0


def test_image_recall(spark):
    rows = spark.createDataFrame([(["u/a.webp", "u/b.webp"], ["a.webp", "", "c.webp"]), (["u"], [])], "f array<string>, w array<string>")
    assert [round(r[0], 4) for r in rows.select(metrics.image_recall(F.col("f"), F.col("w"))).collect()] == [0.3333, 0.0]


def test_exact_neighbours_equal_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((300, 16)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(999, None)], "vec_id bigint, embedding array<float>")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {}
    for r in vectors.neighbours(df, asked, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    for q in range(0, 300, 50):
        order = sorted(range(300), key=lambda k: (-round(float(unit[k] @ unit[q]), 6), k))[:5]
        assert [k for _, k in sorted(got[q])] == order
    assert vectors.neighbours(df, asked.limit(0), 5).count() == 0


def test_neighbours_of_rows_with_text_keys_and_ties(spark):
    rnd = np.random.default_rng(6)
    rows = [(f"k{k}", [float(x) for x in rnd.integers(-1, 2, 3)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = {}
    for r in vectors.neighbours(df, df.where("vec_id < 'k13'").selectExpr("vec_id AS query_id", "embedding AS query_vector"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / n), 6) if n else 0.0

    for q, found in got.items():
        own = dict(rows)[q]
        want = sorted(((k, cosine(own, v)) for k, v in rows), key=lambda x: (-x[1], x[0]))[:7]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=2e-6) and [k for k, _ in found] == [k for k, _ in want]


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((40, 4)))], "vec_id bigint, embedding array<float>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = sorted(map(tuple, vectors.neighbours(df, asked, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(map(tuple, vectors.neighbours(df, asked, 3).collect())) == want


def test_fusion_is_symmetric_at_one_half(spark):
    a = spark.createDataFrame([(1, k, r, 0.5) for r, k in enumerate([5, 3, 9], 1)], "q bigint, d bigint, rank int, score double")
    b = spark.createDataFrame([(1, k, r, 9.5) for r, k in enumerate([3, 7], 1)], "q bigint, d bigint, rank int, score double")
    x, y = fusion.fused(a, b, "q", "d", 0.5), fusion.fused(b, a, "q", "d", 0.5)
    assert {(r.d, r.rrf_score) for r in x.collect()} == {(r.d, r.rrf_score) for r in y.collect()}
    assert x.orderBy("rank").first().d == 3 and [r.d for r in fusion.fused(a, b, "q", "d", 0.8).orderBy("rank").collect()] == [3, 5, 9, 7]


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(1, 1, 1000), (1, 2, 1900), (1, 3, 200), (1, 4, 50), (2, 1, 4000)], "q bigint, rank int, tokens bigint")
    assert [tuple(r) for r in context.within_budget(rows, "q").select("q", "rank").orderBy("rank").collect()] == [(1, 1), (1, 2)]


def test_images_first_place_last_value(spark):
    image = "struct<url string, caption string>"
    rows = spark.createDataFrame([(1, 1, [("u", "a"), ("", "x"), ("v", "b")]), (1, 2, [("u", "a"), ("u", "c")])], f"q bigint, rank int, images array<{image}>")
    found = context.gathered_images(rows, "q")
    assert [(r.position, r.image.url, r.image.caption) for r in found.orderBy("position").collect()] == [(1, "u", "a"), (2, "v", "b"), (3, "u", "c")]
    assert sorted((r.position, r.url, r.image.caption) for r in context.images_by_url(found, "q").collect()) == [(1, "u", "c"), (2, "v", "b")]
    answers = spark.createDataFrame([(1, "see image:2 and image:9")], "q bigint, answer string")
    assert [r.image.url for r in context.inline_images(answers, found, "q").collect()] == ["v"]


def test_page_text_and_reasoning(spark):
    rows = spark.createDataFrame([(1, 1, "B", 3, "tb"), (1, 0, "A", 1, "ta")], "p bigint, ordinal int, heading string, level int, text string")
    assert context.page_text(rows, "p").first().page_text == "# A\nta\n\n### B\ntb"
    assert one(spark, context.with_reasoning(F.col("a"), F.col("r")), a="x", r="why") == "<think>why</think>\n\nx"


def test_a_round_of_pagerank_moves_no_edge(spark):
    import re

    e = spark.createDataFrame([(f"p{k % 50}", f"p{k * 7 % 61}") for k in range(600)] + [("hub", f"p{k}") for k in range(61)], "src string, dst string")
    adjacent, nodes = graph.adjacent(e, edges_a_part=10)
    hub = adjacent.where("s = 'hub'").select("part").distinct().count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = graph.rank_round(adjacent, nodes.withColumn("rank", F.lit(0.1)), 62, edges_a_part=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert hub > 3 and "SortMergeJoin" in plan
    moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    # shares to the edges' buckets, sums to their targets; no exchange of edges (s, part) or of ranks (node alone)
    assert sorted(re.sub(r"#\d+L?", "", m) for m in moved) == ["d", "node, of"], plan
    whole = {r.node: r.rank for r in graph.pagerank(e, rounds=8, tolerance=None).collect()}
    dealt = {r.node: r.rank for r in graph.pagerank(e, rounds=8, tolerance=None, edges_a_part=10).collect()}
    assert whole.keys() == dealt.keys() and all(abs(whole[k] - dealt[k]) < 1e-12 for k in whole)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siftwell_ranks")]


def test_pagerank_sums_to_one_and_matches_power_iteration(spark):
    e = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "z")]
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(e, "src string, dst string"), tolerance=1e-9, rounds=100).collect()}
    nodes = sorted({x for p in e for x in p})
    r = {n: 1 / len(nodes) for n in nodes}
    out = {n: [d for s, d in e if s == n] for n in nodes}
    for _ in range(200):
        loose = sum(r[n] for n in nodes if not out[n])
        r = {n: 0.15 / len(nodes) + 0.85 * (loose / len(nodes) + sum(r[s] / len(out[s]) for s in nodes for d in out[s] if d == n)) for n in nodes}
    assert sum(got.values()) == pytest.approx(1) and all(got[n] == pytest.approx(r[n], abs=1e-6) for n in nodes)
    assert graph.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_page_score(spark):
    got = one(spark, graph.page_score(F.lit(0.001), F.col("w"), F.lit(True), F.lit(80), F.lit("Java Edition")), w=100)
    assert got == pytest.approx(math.log10(1001) * 2 * 2.0 * 0.3)


def test_categories(spark):
    rows = spark.createDataFrame([([" Blocks ", "stub", "Pages with x", "Items", "Blocks", ""],), (["Biomes"],), ([],)], "c array<string>")
    got = classify.classified(rows, "c").collect()
    assert got[0].semantic_categories == ["Blocks", "Items"] and [r.page_type for r in got] == ["block", "biome", "other"]
    assert len({n for n, _ in classify.TYPE_RULES}) == 16


def test_similar_pairs_equal_all_pairs(spark):
    import random

    rnd = random.Random(4)
    base = [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(12)) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t + " zz") for k, t in enumerate(base)] + [(200, base[0]), (201, None), (202, "123")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    w = {}
    for r in quality.weights(df.where("id <> 200 AND text IS NOT NULL"), "id", "text").collect():
        w.setdefault(r.id, {})[r.term] = r.w
    want = {(a, b) for a in w for b in w if a < b and round(sum(v * w[b].get(t, 0) for t, v in w[a].items()), 6) >= 0.82}
    got = {(r.a, r.b) for r in quality.similar_pairs(df, "id", "text").collect()}
    assert got == want and len(want) >= 20


def test_embedder_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "")], "id bigint, t string")
    got = {r.id: r.embedding for r in vectors.embedded(df, "id", "t").collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-6) and set(got[3]) == {0.0}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_index_recall(spark, folder):
    """Recall at 20 over all queries against the exact search, from codes of an eighth of the vectors' bytes."""
    from siftwell.plans.registry import QUERIES

    sf = f"/root/testdata/{folder}"
    exact, found = ({(r.query_id, r.vec_id): r.score for r in QUERIES[name](spark, sf).collect()} for name in ("knn_cosine_topk", "knn_indexed"))
    assert len(found) == len(exact) and len(set(exact) & set(found)) >= 0.95 * len(exact)
    assert all(abs(exact[pair] - found[pair]) < 2e-6 for pair in set(exact) & set(found))
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    codes = vector_index.coded(v, vector_index.fit(v))
    n, size = codes.agg(F.sum(F.size("keys")), F.sum(F.length("codes"))).first()
    assert n == v.count() and 5 * size <= n * 4 * len(v.first().embedding)


def test_index_of_odd_vectors_and_text_keys(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(300, 6))
    rows = [(f"v{i}", [float(x) for x in v]) for i, v in enumerate(base)] + [("nan", [float("nan")] * 6), ("short", [1.0, 2.0]), ("none", None), ("null", [None] + [1.0] * 5), ("zero", [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    asked = df.where("vec_id LIKE 'v%0'").selectExpr("vec_id AS query_id", "embedding AS query_vector").union(df.where("vec_id IN ('nan', 'short', 'none')"))
    for block in (16_384, 7):
        monkeypatch.setattr(vector_index, "QUERIES", block)
        centroids = vector_index.fit(df)
        got = {(r.query_id, r.vec_id) for r in vector_index.search(vector_index.coded(df, centroids), centroids, df, asked, 5, second_look=60).collect()}
        want = {(r.query_id, r.vec_id) for r in vectors.neighbours(df, asked, 5).where("query_id LIKE 'v%'").collect()}
        assert len(want) == 150 and len(got & want) >= 148 and len(got) == 150
    empty = df.where("false")
    assert vector_index.search(vector_index.coded(empty, vector_index.fit(empty)), vector_index.fit(empty), empty, asked, 5).collect() == []



def test_candidates_of_similar_pairs_grow_with_the_result(spark):
    rnd = random.Random(11)
    words = [f"v{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(900)]
    weights = [1 / (i + 5) for i in range(900)]
    texts = [rnd.choices(words, weights, k=80) for _ in range(500)]
    texts += [[w if rnd.random() > 0.06 else rnd.choice(words) for w in texts[i]] for i in range(0, 500, 5)]
    found = {}
    for n in (300, 600):
        df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts[:n] if n == 600 else texts[:250] + texts[500:550])], "id bigint, text string")
        w = quality.class_weights(df, "id", "text").cache()
        found[n] = quality.candidate_pairs(w, "id").count(), quality.similar_pairs(df, "id", "text").count()
    assert found[300][1] >= 25 and found[600][1] >= 60
    assert all(c <= 2 * n for c, n in found.values()), found


def test_odd_vectors_have_no_neighbours(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, nan]), (3, [0.0, 1.0]), (4, [1.0, None]), (5, [1.0, 0.0, 0.0]), (6, []), (7, None), (8, [inf, 0.0]), (9, [0.0, 0.0]), (10, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.selectExpr("vec_id AS query_id", "embedding AS query_vector")
    want = {1: [(1, 1.0), (10, 0.707107), (3, 0.0)], 3: [(3, 1.0), (10, 0.707107), (1, 0.0)], 5: [(5, 1.0)], 9: [(1, 0.0), (3, 0.0), (9, 0.0)], 10: [(10, 1.0), (1, 0.707107), (3, 0.707107)]}
    for block in (2048, 2):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {}
        for r in sorted(vectors.neighbours(df, asked, 3).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
