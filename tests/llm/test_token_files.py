import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passages.llm import pair_grammar, token_files
from tests_llm_samples import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a  b", "　x  y", "é é", "  lead", "trail  ", "a\n\nb", "中文 字", "<|endoftext|> x<|endoftext|>", "a\x1c b",
    "it's  ok 'll", "日 本  x", "😀 😀", " ", "\t\t\n", "x\x7f y", "a\xa0 b  c　 d", "x" * 3_000, "1 2  3\x0b4",
]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def encoded(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows):
    out, start = {}, 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(encoded(text), "<u4")
        out[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def report(spark, docs):
    path = token_files.write_tokens(docs, PATH)
    return token_files.token_report(token_files.read_shards(spark, path))


def test_ids_equal_those_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 700)
    rows = documents(120) + [(1_000 + k, t, None, None, 0) for k, t in enumerate(ODD)]
    random.Random(3).shuffle(rows)
    found = report(spark, frame(spark, rows).repartition(5))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found.collect()} == expected(rows)


def test_documents_come_back_whole_and_alone(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 500)
    rows = documents(80)
    shards = token_files.read_shards(spark, token_files.write_tokens(frame(spark, rows), PATH))
    assert shards.where("documents > 1").count() and shards.where("n_tokens > 500").count()
    want = {doc_id: encoded(text) for doc_id, text, *_ in rows}
    assert {r.doc_id: r.ids for r in token_files.read_documents(shards).collect()} == want
    some = spark.createDataFrame([(3,), (7,), (7,), (89,), (99_999,)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_files.lookup(shards, some).collect()} == {k: want[k] for k in (3, 7, 89) if k in want}


def test_pieces_are_forgotten_and_learnt_again(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "PIECES", 5)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 40)
    encoder = token_files.Encoder(open(PATH).read())
    texts = [t for _, t, *_ in documents(30)] + ODD
    got = []
    for _, ids, counts in encoder.of(pa.array(texts, pa.string())):
        got += [i.tolist() + [2] for i in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [encoded(t) for t in texts]


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = documents(20)
    shards = token_files.read_shards(spark, token_files.write_tokens(frame(spark, rows), path))
    whole = Tokenizer.from_file(path)
    want = {d: whole.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in rows}
    assert {r.doc_id: r.ids for r in token_files.read_documents(shards).collect()} == want


def test_odd_tables(spark):
    assert report(spark, frame(spark, [])).count() == 0
    rows = [(5, "same", None, None, 0)] * 3 + [(None, "none", None, None, 0), (None, None, None, None, 0), (1, "one", None, None, 0)]
    docs = frame(spark, rows).withColumn("part", F.lit("x")).withColumn("number", F.lit(0)).withColumn("h", F.lit(0))
    found = report(spark, docs).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, 1, 5, 5, 5]
    assert sum(r.n_tokens for r in found) == sum(len(encoded(t)) for _, t, *_ in rows)
    assert [b.start - a.start for a, b in zip(found, found[1:])] == [r.n_tokens for r in found[:-1]]


@pytest.mark.parametrize("seed", range(6))
def test_grammars_give_back_every_range(seed):
    rng = np.random.default_rng(seed)
    base = rng.zipf(1.3, 4_000) % 900 if seed % 2 else np.zeros(4_000, int)
    ids = np.concatenate([base, base[500:2_000], base[500:2_000], rng.integers(0, 70_000, 50)])
    grammar, end = pair_grammar.from_bytes(data := pair_grammar.to_bytes(pair_grammar.compress(ids, 70_000, 4)))
    assert end == len(data) and len(grammar.left) and len(grammar.sequence) < len(ids)
    assert (grammar.ids() == ids).all() and (grammar.opened(grammar.sequence) == ids).all()
    assert (grammar.length == [len(grammar.opened(np.array([70_000 + k], np.uint32))) for k in range(len(grammar.left))]).all()
    for _ in range(40):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (grammar.ids(a, b) == ids[a:b]).all()


def test_short_sequences():
    for ids in ([], [7], [7, 7], list(range(20))):
        grammar, _ = pair_grammar.from_bytes(pair_grammar.to_bytes(pair_grammar.compress(np.array(ids, np.uint32), 50)))
        assert grammar.ids().tolist() == ids and not len(grammar.left)


def test_nothing_frequent_is_left():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.5, 20_000) % 300
    grammar = pair_grammar.compress(ids, 300, 8)
    _, counts = np.unique(np.stack([grammar.sequence[:-1], grammar.sequence[1:]]), axis=1, return_counts=True)
    assert len(grammar.sequence) < 0.8 * len(ids) and counts.max() < 100
