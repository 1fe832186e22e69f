import corpus_pipeline as p
from siftwell.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs
from .test_similar import brute_groups
from .test_tokens_and_packing import check_pieces


def test_stages_on_a_whole_table(spark, tmp_path):
    """Each stage against a brute-force decision on what the stage before kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, sf).where("predicted = 1").collect()}
    assert set(rows[0]) - set(rows[1]) == toxic
    assert all(any(c.isalpha() for c in r.text) for r in rows[2].values()) and len(rows[1]) - len(rows[2]) == sum(not any(c.isalpha() for c in r.text) for r in rows[1].values())
    assert set(rows[3]) == set(brute_groups({k: r.text for k, r in rows[2].items()}).values())
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {k for k, r in rows[3].items() if any(i.lower() in r.text.lower() for i in items)}
    assert set(rows[3]) - set(rows[4]) == leaks
    pieces = p.pack(spark, kept[-1], sf).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_pieces(pieces, {k: [*bpe.encode(r.text, add_special_tokens=False).ids, 0] for k, r in rows[4].items()})
    assert p.run(spark, sf).count() == len(pieces)


def test_texts_of_no_known_language_go(spark, sf):
    import random

    docs, rnd = spark.read.parquet(f"{sf}/documents.parquet"), random.Random(1)
    rows = [(10_001, "Съешь ещё этих мягких французских булок, да выпей чаю. " * 8), (10_002, " ".join("".join(rnd.choices("zqxvkjw", k=6)) for _ in range(200))), (10_003, "kurz"), (10_004, "?!"), (10_005, None)]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(k, t, None, "x", 0) for k, t in rows], docs.schema))
    kept = {r.doc_id for r in p.drop_unidentified(spark, more, sf).collect()}
    assert {r.doc_id for r in docs.collect()} <= kept and kept & {k for k, _ in rows} == {10_003}


def test_stages_on_edges(spark, sf):
    rows = edge_docs(spark)
    for name, stage in p.STAGES:
        out = stage(spark, rows, sf)
        assert out.count() > 0
        none = stage(spark, empty_docs(spark), sf)
        assert none.count() == 0
        if stage is not p.pack:
            assert out.columns == rows.columns and none.columns == empty_docs(spark).columns
    ids = [r.doc_id for r in p.drop_near_duplicates(spark, rows, sf).collect()]
    assert ids.count(1) == 1 and 5 not in ids and 3 not in ids and ids.count(None) == 2


def test_contaminated_texts_go_and_others_of_their_id_stay(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean, other = "nothing of that kind is written here at all " * 4, "some wholly different words about towns and rivers " * 4
    rows = [(1, f"before it {item} and after it", "x"), (1, clean, "x"), (None, item, None), (None, other, "y"), (2, clean, "z"), (2, None, "z"), (3, item.upper(), "w"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found_name string").withColumnRenamed("found_name", "copy")
    kept = p.drop_contaminated(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [r for r in rows if r[1] in (clean, other, None)]))


def test_stages_run_over_the_whole_pipeline_with_clashing_ids(spark, sf, tmp_path):
    """Every clean text keeps its tokens, whatever its id; copies keep one row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [f"a plain text number {k} about the house by the river and the road to the town" for k in range(6)]
    rows = [(None if k % 2 else 0, t, None, None, None) for k, t in enumerate(texts)]
    more = docs.unionByName(spark.createDataFrame(rows + rows[:2], docs.schema))
    for name, stage in p.STAGES[:-1]:
        more = stage(spark, more, sf)
    left = [r.text for r in more.collect() if r.text in texts]
    assert sorted(left) == sorted(texts)
