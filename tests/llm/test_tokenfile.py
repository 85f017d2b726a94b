import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import tokenfile
from tallyframe.llm.common import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=600))
def test_elias_fano_round_trip(sizes):
    ends = np.cumsum(sizes, dtype=np.int64)
    code = tokenfile.EliasFano.encode(ends, int(ends[-1]) if len(ends) else 0)
    assert code.all().tolist() == ends.tolist()
    for i in range(0, len(ends), 37):
        assert code.get(i) == ends[i]


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(20_000, 900))
    code = tokenfile.EliasFano.encode(ends, int(ends[-1]))
    assert 8 * (len(code.low) + len(code.high)) / len(ends) < 2 + np.log2(900) + 1


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB1.,'!- \n\té́İΣs<|endoftext|>ﬁ½²한\U0001f600"), max_size=60))
def test_chunks_equal_whole_texts(text):
    coder = tokenfile.encoder(PATH, 2)
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert np.frombuffer(coder.encode([text])[0], coder.kind).tolist() == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizer_encodes_whole_texts(name):
    coder = tokenfile.Encoder(public_tokenizers.path(name), 2)
    text = "Hello,  world!\n\nTwo lines"
    assert np.frombuffer(coder.encode([text])[0], coder.kind).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def check(spark, docs, **options):
    folder = scratch_path(spark, "ids")
    manifest = tokenfile.write_token_files(spark, docs, folder, PATH, **options)
    got = [tuple(r) for r in tokenfile.read_token_files(manifest).orderBy("start").collect()]
    tokenizer = Tokenizer.from_file(PATH)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in rows]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    at = 0
    for i, start, n, crc in got:
        coded = {t: tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts[i]}
        mine = [t for t, ids in coded.items() if len(ids) == n and zlib.crc32(np.array(ids, "<u4").tobytes()) == crc]
        assert mine and start == at, i
        texts[i].remove(mine[0])
        at += n
    return manifest


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    manifest = check(spark, docs, shard_chars=60_000)
    assert manifest.count() > 4
    first = manifest.orderBy("base").first()
    with open(first["path"].removeprefix("file://"), "rb") as f:
        shard = tokenfile.Shard(f.read())
    ends = shard.ends.all()
    assert [len(shard.doc(i)) for i in range(5)] == np.diff(np.concatenate([[0], ends[:5]])).tolist()


def test_edges(spark, odd_docs, no_docs):
    check(spark, odd_docs)
    check(spark, odd_docs, shard_chars=50)
    folder = scratch_path(spark, "none")
    assert tokenfile.read_token_files(tokenfile.write_token_files(spark, no_docs, folder, PATH)).count() == 0
    with pytest.raises(ValueError):
        tokenfile.Shard(b"something else")
