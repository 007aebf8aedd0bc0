"""Range-coded blocks, files of ids, and what is read back, against the tokenizer on whole texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import range_coder as rc, token_files as tf
from shelfcast.llm.queries import QUERIES, tokenizer_file, word_tokenizer


@pytest.mark.parametrize("largest", [0, 1, 15, 16, 49407, (1 << 24) - 1])
def test_blocks_round_trip(largest):
    rng = np.random.default_rng(largest)
    sizes = [0, 1, 2, rc.BLOCK_IDS, *rng.integers(0, 300, 30)]
    blocks = [rng.integers(0, largest + 1, n).astype(np.uint32) for n in sizes]
    blocks += [np.tile(b[:7], 20) for b in blocks[4:9]]
    coded = rc.encode_blocks(blocks)
    for got, wanted in zip(rc.decode_blocks(coded), blocks):
        assert got.tolist() == wanted.tolist()
    alone = [rc.decode_blocks([c])[0].tolist() for c in coded]  # each block can be read by itself
    assert alone == [b.tolist() for b in blocks]


def test_blocks_are_smaller_than_plain_ids():
    rng = random.Random(1)
    words = [[rng.randrange(49_000) for _ in range(rng.choice([1, 2, 3]))] for _ in range(300)]
    ids = np.array([i for _ in range(4000) for i in words[min(int(rng.expovariate(0.05)), 299)]], np.uint32)
    blocks = [ids[i : i + rc.BLOCK_IDS] for i in range(0, len(ids), rc.BLOCK_IDS)]
    assert sum(map(len, rc.encode_blocks(blocks))) < 1.2 * len(ids)


def test_damage_is_seen():
    ids = np.arange(500, dtype=np.uint32) % 37
    coded = rc.encode_blocks([ids])[0]
    for at in (4, 8, 12, 20, len(coded) // 2):
        broken = coded[:at] + bytes([coded[at] ^ 16]) + coded[at + 1 :]
        with pytest.raises(ValueError):
            rc.decode_blocks([broken])
    for cut in (b"", coded[:5], coded[:14], b"\x07" + coded[1:]):
        with pytest.raises(ValueError):
            rc.decode_blocks([cut])
    with pytest.raises(ValueError):
        rc.encode_blocks([np.array([1 << 24], np.uint32)])
    with pytest.raises(ValueError):
        rc.encode_blocks([np.zeros(rc.BLOCK_IDS + 1, np.uint32)])


def test_crc_of_pieces():
    data = random.Random(2).randbytes(5000)
    for cuts in ([0, 5000], [0, 1, 5000], [0, 700, 701, 4096, 5000], [0, 0, 5000, 5000]):
        total = 0
        for lo, hi in zip(cuts, cuts[1:]):
            total ^= tf.moved_crc(zlib.crc32(data[lo:hi]), 5000 - hi)
        assert total == zlib.crc32(data)


PARTS = ["a", "The", "ZÉ", "é", " ", "  ", "\n", "\t", "\r\n", " ", "　", "日本語", "'s", "don't", "12", "!?",
         "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "Σας", "ΣΑΣ", " word", "word ", "😀", "\x00", "#", "ﬁ", "́x"]


def some_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.choice([1, 2, 5, 20, 80]))) for _ in range(n)]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_chain_to_whole_texts(whole, monkeypatch):
    texts = some_texts(2000, seed=11)
    for kept in (tf.KEPT_WORDS, 3):
        monkeypatch.setattr(tf, "KEPT_WORDS", kept)
        encoder = tf.TextEncoder(word_tokenizer())
        for start in range(0, len(texts), 250):
            part = texts[start : start + 250]
            ids, sizes = encoder.encode([t.encode() for t in part])
            got = np.split(ids, np.cumsum(sizes)[:-1])
            assert [g.tolist() for g in got] == [whole(t)[:-1] for t in part]


def brute(docs, whole):
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = whole(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def summed(spark, docs, path):
    tf.write_tokens(docs, word_tokenizer, 2, path)
    out = tf.read_sums(spark, path)
    return sorted((tuple(r) for r in out.select("doc", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_files_equal_whole_texts(spark, make_docs, whole, tmp_path, many_parts):
    texts = some_texts(400, seed=5) + ["long " * 30_000 + "end"]
    docs = [(i * 7 % 401 - 30, t) for i, t in enumerate(texts)]
    path = str(tmp_path / "files")
    assert summed(spark, make_docs(docs).repartition(6), path) == brute(docs, whole)
    by_doc = dict(docs)
    starts = {d: s for d, s, *_ in brute(docs, whole)}
    for r in tf.read_documents(spark, path).collect():
        assert r["ids"] == whole(by_doc[r["doc"]]) and r["start"] == starts[r["doc"]]
    blocks = spark.read.parquet(path)
    assert blocks.where(F.col("n_ids") > rc.BLOCK_IDS).count() == 0 and blocks.select("part").distinct().count() > 1


def test_odd_input(spark, make_docs, whole, tmp_path):
    docs = [(None, "no id"), (3, None), (3, ""), (4, " \n "), (5, "twice"), (5, "twice"), (6, "# hash mark is id 2 #")]
    frame = make_docs(docs).withColumns({c: F.lit(1) for c in ("doc", "part", "ids", "start", "mix")})
    got = summed(spark, frame, str(tmp_path / "files"))
    assert got == brute(docs, whole)


def test_hot_document_id_is_split(spark, make_docs, whole, tmp_path, many_parts):
    """Rows with one id, some alike, lie in several parts and still follow each other."""
    docs = [(7, f"text {i % 40}") for i in range(3000)] + [(i, "other") for i in (1, 2, 90)]
    path = str(tmp_path / "files")
    got = summed(spark, make_docs(docs).repartition(4), path)
    assert [r[0] for r in got] == sorted(d for d, _ in docs)
    ends = [r[1] + r[2] for r in got]
    assert [r[1] for r in got] == [0, *ends[:-1]]
    assert sorted(r[3] for r in got) == sorted(zlib.crc32(np.array(whole(t), "<u4").tobytes()) for _, t in docs)
    assert spark.read.parquet(path).select("part").distinct().count() > 2


def test_empty_table(spark, make_docs, tmp_path):
    assert summed(spark, make_docs([]), str(tmp_path / "files")) == []


def test_query(spark, sf_dir, whole):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op13_token_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == brute([tuple(d) for d in docs], whole)


def test_words_with_the_sign_between_words(whole):
    """Words are told apart by a sign that they may hold themselves; no special token is searched for."""
    tokenizer = word_tokenizer()
    assert tokenizer.between == tf.BETWEEN
    words = ["a", "\x01", "x\x01", "\x01\x01y", "é", "", "<|endoftext|>", "b"] * 3
    assert [w.tolist() for w in tokenizer.words(words)] == [whole(w)[:-1] for w in words]
    tokenizer.mark = whole("b")[0]  # were the sign's id that of a word as well, words would be encoded alone
    assert [w.tolist() for w in tokenizer.words(["a", "b", "c"])] == [whole(w)[:-1] for w in ("a", "b", "c")]


def test_a_worker_keeps_its_words():
    encoder = tf.encoder_of(word_tokenizer)
    encoder.encode([b"some words some"])
    assert tf.encoder_of(word_tokenizer) is encoder and "words" in encoder.known
    tf.forget_words()
    assert not tf.encoder_of(word_tokenizer).known
