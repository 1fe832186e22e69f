import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from siftwell.llm.bpe import Encoder, safe_parts
from siftwell.llm.packing import packed
from siftwell.llm.queries import QUERIES
from siftwell.llm.token_counts import token_counts
from tokenizers import Tokenizer

from .helpers import edge_docs, empty_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library_on_odd_texts(library):
    rnd, pieces = random.Random(1), [" ", "  ", "\n", "\t", "a", "b", "The", "é", "1", "²", "'s", "'", ".", "!!", "\x85", "\xa0", "　", "日本", "😀", "<|endoftext|>", "\x1c", "word", " x", "thaterndingha"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(5_000)] + [None, ""]
    code = Encoder(PATH, part_chars=7)
    assert code.fast is not None
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert code.batch(texts) == want


def test_safe_parts_add_up(library):
    text = "It's  a test, 'tis 12 words\nlong.  End " * 30
    parts = safe_parts(text, 11)
    assert "".join(parts) == text and len(parts) > 5
    assert sum(len(library.encode(p, add_special_tokens=False).ids) for p in parts) == len(library.encode(text, add_special_tokens=False).ids)


def test_whole_table_counts(spark, sf, library):
    got = {r.doc_id: r for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d, e in zip(docs, library.encode_batch([d.text for d in docs], add_special_tokens=False)):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), len(e.ids), len(e.ids) > 512)


def test_counts_edges(spark, library):
    rows = edge_docs(spark)
    got = token_counts(rows).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect()]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(repr, want))
    assert token_counts(empty_docs(spark)).count() == 0


def check_pieces(pieces, want):
    """want: ids of each document by key; pieces tile documents and sequences."""
    sequences, docs = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append(p)
    for number, spans in sequences.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    for key, ids in want.items():
        at = 0
        for p in sorted(docs[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_packing_round_trip(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: [*e.ids, 0] for d, e in zip(docs, library.encode_batch([d.text for d in docs], add_special_tokens=False))}
    check_pieces(QUERIES["op9_packing"](spark, sf).collect(), want)


def test_packing_edges(spark, library):
    rows = edge_docs(spark)
    pieces = packed(rows).collect()
    total = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows.collect())
    assert sum(p.length for p in pieces) == total
    assert [(p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == 2] == [(0, 1, 1)]
    assert packed(empty_docs(spark)).count() == 0
