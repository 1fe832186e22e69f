import hashlib
import random
from datetime import datetime, timedelta, timezone
import gzip
import json

import pytest
from pyspark.sql import functions as F
from siftwell.operators import chunking, context, fusion, metrics
from siftwell.plans import stages
from siftwell.settings import DEFAULTS, Settings
from siftwell.sources import tables
from siftwell.streaming import incremental


def test_sitemaps(spark, tmp_path):
    index = tmp_path / "index.xml"
    index.write_text("<sitemapindex><sitemap><loc>https://x/sitemap-NS_0-1.xml.gz</loc></sitemap><sitemap><loc>https://x/sitemap-NS_6.xml</loc></sitemap></sitemapindex>")
    assert [r.url for r in tables.sitemap_index(spark, str(index)).collect()] == ["https://x/sitemap-NS_0-1.xml.gz"]
    page = tmp_path / "map.xml.gz"
    with gzip.open(page, "wt") as f:
        f.write("<urlset>" + "".join(f"<url><loc> https://x/w/{u}</loc></url>" for u in ("A", "File:B", "C")) + "</urlset>")
    assert sorted(r.url for r in tables.sitemap(spark, str(page)).collect()) == ["https://x/w/A", "https://x/w/C"]


def test_questions_as_list_or_items(spark, tmp_path):
    rows = [{"question": f"q{k}", "difficulty": "easy", "relevant_links": ["l"]} for k in range(3)]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(rows), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"items": rows}))
    for name in ("a.json", "b.json"):
        got = tables.questions(spark, str(tmp_path / name), 2).collect()
        assert [r.question for r in got] == ["q0", "q1"] and got[0].relevant_links == ["l"] and got[0].answer is None


def test_files_vectors_and_reports(spark, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text("<p>\nx</p>")
    (tmp_path / "html" / "b.txt").write_text("no")
    assert [tuple(r) for r in tables.html_files(spark, str(tmp_path / "html")).collect()] == [("a.html", "<p>\nx</p>")]
    v = spark.createDataFrame([("c", [1.0], "m", "s")], "chunk_id string, embedding array<float>, model string, chunker string")
    assert not tables.populated(spark, str(tmp_path / "v"))
    tables.write_vectors(v, str(tmp_path / "v"))
    assert tables.populated(spark, str(tmp_path / "v")) and not tables.populated(spark, str(tmp_path / "v"), 2)
    assert spark.read.parquet(str(tmp_path / "v")).where("model = 'm'").count() == 1
    assert tables.markdown_report(spark.createDataFrame([("x", 0.12345, None)], "a string, b double, c int"), ["a", "b", "c"]) == "| a | b | c |\n|---|---|---|\n| x | 0.123 |  |"
    images = spark.createDataFrame([("f", "u/icon.png", 200, 200), ("g", "u/g.png", 200, 100), ("h", "u/h.png", 150, 150)], "local_filename string, original_url string, width int, height int")
    assert [r.local_filename for r in tables.wanted_images(images).collect()] == ["h"]


def test_incremental_sets(spark):
    done = spark.createDataFrame([("a", 5), ("b", 0)], "k string, word_count int")
    source = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted(r.k for r in incremental.new_rows(source, incremental.retried(done), "k").collect()) == ["b", "c"]


def test_stream_dedupes_and_counts(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint"
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_040).alias("ts"), (F.col("id") % 2).alias("user_id"))
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    stream = incremental.stream_dedupe(incremental.stream_tables(spark, str(tmp_path / "in"), schema, 1), "event_id", "ts")
    incremental.run_available(stream, lambda df, n: out.extend(r.event_id for r in df.collect()), str(tmp_path / "c1"))
    assert sorted(out) == list(range(100))
    counts = {}
    windows = incremental.stream_windows(incremental.stream_tables(spark, str(tmp_path / "in"), schema), "ts", "user_id")
    incremental.run_available(windows, lambda df, n: counts.update({(r.window_start, r.user_id): r.n for r in df.collect()}), str(tmp_path / "c2"), "complete")
    assert sum(counts.values()) == 200 and counts == {(r.window_start, r.user_id): r.n for r in incremental.request_windows(rows.union(rows), "ts", "user_id").collect()}


def test_stages_run_in_order_and_alone(spark, tmp_path):
    page = '<div id="mw-content-text"><div class="mw-parser-output"><div class="infobox"><tr><th>Size of it</th><td>one two three four five six seven eight nine</td></tr></div><p>{}</p><p><a href="/w/B">b</a><a href="/w/Nowhere">n</a></p></div></div><a href="/w/Category:Blocks">Blocks</a>'
    rows = [(f"u/{t}", t, page.format("many words stand here and there and here again " * 3 + t)) for t in "AB"]
    spark.createDataFrame(rows, "url string, title string, html string").write.parquet(str(tmp_path / "raw"))
    folder = str(tmp_path)
    assert stages.run(spark, folder) == list(stages.STAGES)
    chunks = spark.read.parquet(f"{folder}/chunks").collect()
    assert {r.page_type for r in chunks} == {"block"} and {r.heading for r in chunks} == {"Infobox", "Introduction"}
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/links").select("title", "target").orderBy("title").collect()] == [("A", "B"), ("B", "B")]
    assert stages.run(spark, folder, skip_populated=True) == [] and stages.run(spark, folder, only="links") == ["links"] and stages.run(spark, folder, start="embed") == ["embed", "index"]
    with pytest.raises(ValueError):
        stages.run(spark, folder, only="nothing")


def test_small_sections_are_merged_in_the_stage_with_their_images(spark, tmp_path):
    words = lambda n, w: " ".join([w] * n)
    page = f'<div id="mw-content-text"><div class="mw-parser-output"><div class="infobox"><img src="/images/box.png"><tr><th>Size</th><td>{words(12, "big")}</td></tr><tr><th>Gone</th><td></td></tr></div><p>{words(12, "one")}</p><h2>Use</h2><p>{words(13, "two")}</p><figure><img src="/images/use.png"></figure><h2>History</h2><p>{words(70, "three")}</p></div></div>'
    spark.createDataFrame([("u/A", "A", page)], "url string, title string, html string").write.parquet(str(tmp_path / "raw"))
    stages.run(spark, str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/chunks").orderBy("ordinal").collect()
    assert [(r.ordinal, r.chunk_type, r.heading, r.section_type, [i.url.rsplit("/", 1)[1] for i in r.images]) for r in got] == [
        (0, "infobox", "Infobox", "content", ["box.png"]), (1, "section", "Introduction + Use", "content", ["box.png", "use.png"]), (2, "section", "History", "history", []),
    ]
    assert "Gone" not in got[0].text and got[1].text == words(12, "one") + "\n\n" + words(13, "two") and got[1].token_count == 25
    assert got[1].chunk_id == hashlib.md5(b"A|Introduction + Use|1").hexdigest()[:16] and spark.read.parquet(f"{tmp_path}/vectors").count() == 3


def test_stages_are_skipped_by_content(spark, tmp_path):
    page = '<div id="mw-content-text"><div class="mw-parser-output"><p>{}</p></div></div>'
    folder, schema = str(tmp_path), "url string, title string, html string"

    def write(*words):
        spark.createDataFrame([(f"u/{i}", f"T{i}", page.format(f"{w} " * 40)) for i, w in enumerate(words)], schema).write.mode("overwrite").parquet(f"{folder}/raw")

    write("a", "b")
    assert stages.run(spark, folder, skip_unchanged=True) == list(stages.STAGES)
    assert stages.run(spark, folder, skip_unchanged=True) == []
    write("b", "a")
    assert stages.run(spark, folder, skip_unchanged=True)[:2] == ["clean", "classify"]  # other rows, as many
    write("b", "c")
    assert stages.run(spark, folder, skip_unchanged=True) == list(stages.STAGES)
    assert stages.run(spark, folder, skip_unchanged=True) == []
    assert stages.run(spark, folder, only="embed", skip_unchanged=True, settings=Settings(dimension=8)) == ["embed"]
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string"), spark.createDataFrame([(2, "y"), (1, "x"), (2, "y")], "a int, b string")
    assert stages.rows_hash(a) == stages.rows_hash(b) != stages.rows_hash(a.distinct()) and stages.rows_hash(a) != stages.rows_hash(a.withColumnRenamed("b", "c"))


def test_vectors_of_several_models_stand_side_by_side(spark, tmp_path):
    path = str(tmp_path / "v")
    for model, n in (("a", 3), ("b", 4), ("a", 2)):
        tables.write_vectors(spark.range(n).selectExpr("id", "array(1.0, 2.0) AS embedding", f"'{model}' AS model", "'c' AS chunker"), path)
    found = spark.read.parquet(path)
    assert {r.model: r["count"] for r in found.groupBy("model").count().collect()} == {"a": 2, "b": 4}
    plan = found.where("model = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and len(found.where("model = 'b'").inputFiles()) <= len(found.inputFiles())


def test_reports_of_too_many_rows_are_refused(spark):
    with pytest.raises(ValueError):
        tables.markdown_report(spark.range(5), ["id"], most=4)
    assert tables.markdown_report(spark.range(4), ["id"], most=4).count("\n") == 5


def test_stages_under_other_settings(spark, tmp_path):
    page = '<div id="mw-content-text"><div class="mw-parser-output"><p>{}</p></div></div>'
    spark.createDataFrame([("u/A", "A", page.format("some words of a sentence that goes on. " * 30))], "url string, title string, html string").write.parquet(str(tmp_path / "raw"))
    small = Settings(max_tokens=40, overlap=0, dimension=16)
    stages.run(spark, str(tmp_path), settings=small)
    chunks = spark.read.parquet(f"{tmp_path}/chunks").collect()
    assert len(chunks) > 1 and all(r.token_count <= 40 for r in chunks)
    assert {len(r.embedding) for r in spark.read.parquet(f"{tmp_path}/vectors").collect()} == {16}
    for wrong in (Settings(chunker="none"), Settings(embedder="none")):
        with pytest.raises(ValueError):
            stages.run(spark, str(tmp_path), settings=wrong)


def test_defaults_reach_the_operators():
    assert (chunking.MAX_TOKENS, fusion.ALPHA, context.BUDGET) == (DEFAULTS.max_tokens, DEFAULTS.alpha, DEFAULTS.context_tokens)


def test_counts_resets_reports_and_stamps(spark, tmp_path):
    path = str(tmp_path / "store")
    assert tables.row_count(spark, path) == 0
    spark.range(7).write.parquet(path)
    assert tables.row_count(spark, path) == 7
    tables.reset(spark, path, "id bigint")
    assert tables.row_count(spark, path) == 0 and spark.read.parquet(path).columns == ["id"]
    tables.write_json(spark.range(50).repartition(5), str(tmp_path / "report"), files=1)
    tables.write_json(spark.range(3), str(tmp_path / "report"), files=1)
    assert len(list((tmp_path / "report").glob("*.json"))) == 1
    assert [r.id for r in tables.lines(spark, str(tmp_path / "report"), "id bigint").orderBy("id").collect()] == [0, 1, 2]
    (tmp_path / "one.json").write_text('{\n "id": 5,\n "more": 1\n}')
    assert [r.id for r in tables.documents_json(spark, str(tmp_path / "one.json"), "id bigint").collect()] == [5]
    stamps = {r.scraped_at for r in tables.stamped(spark.range(4)).collect()}
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    assert len(stamps) == 1 and abs((datetime.strptime(stamps.pop(), "%Y-%m-%dT%H:%M:%SZ") - now).total_seconds()) < 300


def test_latency_and_longest_common_subsequence(spark):
    got = metrics.latency(spark, {"a": lambda: spark.range(10), "b": lambda: spark.range(20)}, 4).collect()
    assert [r.config for r in got] == ["a", "b"] and all(r.seconds > 0 and abs(r.seconds_a_question * 4 - r.seconds) < 1e-9 for r in got)
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choices("ab c dd".split(), k=rnd.randint(0, 9))), " ".join(rnd.choices("AB c dd e".split(), k=rnd.randint(0, 9)))) for k in range(60)]

    def longest(a, b):
        best = 0
        for mask in range(1 << len(a)):
            own, at = [x for k, x in enumerate(a) if mask >> k & 1], 0
            for y in b:
                at += at < len(own) and own[at] == y
            best = max(best, at if at == len(own) else 0)
        return best

    found = {r.k: r.rouge_l for r in metrics.rouge_l(spark.createDataFrame(rows, "k bigint, a string, b string"), ["k"], "a", "b").collect()}
    for k, a, b in rows:
        x, y = a.lower().split(), b.lower().split()
        assert found[k] == pytest.approx(2 * longest(x, y) / (len(x) + len(y)) if x and y else 0)


def test_requests_over_a_minutes_limit_are_refused_in_a_stream(spark, tmp_path):
    rnd = random.Random(9)
    schema = "event_id bigint, user_id string, ts timestamp"
    base = datetime(2024, 1, 1)

    def batch(name, rows):
        spark.createDataFrame([(i, u, base + timedelta(seconds=s)) for i, u, s in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        found = []
        stream = incremental.stream_admission(incremental.stream_tables(spark, str(tmp_path / "in"), schema, 1), "ts", "user_id", "event_id", 5, 60, "2 minutes")
        incremental.run_available(stream, lambda df, n: found.extend((r.event_id, r.admitted) for r in df.collect()), str(tmp_path / "state"))
        return dict(found)

    first = [(i, rnd.choice("ab"), rnd.randint(0, 200)) for i in range(60)]
    batch("1", first)
    got = run()
    df = spark.createDataFrame([(i, u, base + timedelta(seconds=s)) for i, u, s in first], schema)
    assert got == {r.event_id: r.admitted for r in incremental.admitted(df, "ts", "user_id", "event_id", 5).collect()} and 10 < sum(got.values()) < 50
    batch("2", [(100 + i, "a", 241 + i) for i in range(4)])
    assert run() == {100 + i: True for i in range(4)}
    batch("3", [(200 + i, "a", 250 + i) for i in range(4)] + [(300, "b", 250)])  # after a restart the minute's count goes on
    assert run() == {200: True, 201: False, 202: False, 203: False, 300: True}
    batch("4", [(400, "c", 2000)])
    assert run() == {400: True}
    batch("5", [(500, "a", 255), (501, "c", 2001)])  # behind the watermark
    assert run() == {501: True}
