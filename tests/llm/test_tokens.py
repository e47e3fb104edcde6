"""Tokenizers and packing: exact round trips and brute force."""

import array
import hashlib
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.helpers import no_docs, odd_docs
from tidemark.llm import byte_bpe as bb
from tidemark.llm import packing as pk
from tidemark.llm import token_counts as tc
from tidemark.llm.common import stored, table

BPE = bb.load(bb.default_vocab(), bb.default_pattern())
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
WORD = Tokenizer.from_file(pk.default_tokenizer())
FRESH = pk.WordBpe(pk.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encode_is_exact(text):
    assert BPE.encode(text) == TRUE.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 20000, "ab" * 9000, " " * 3000 + "x", "'s" * 50, "\n \n\n  a\x1c \x85b"])
def test_encode_long_pieces(text):
    assert BPE.encode(text) == TRUE.encode_ordinary(text)


def test_op9_on_data(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    got = bb.op9_byte_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = TRUE.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op9_odd(spark):
    got = bb.byte_bpe_digest(odd_docs(spark)).collect()
    assert len(got) == 10 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert bb.byte_bpe_digest(no_docs(spark)).count() == 0
    back = bb.byte_bpe_decode(bb.byte_bpe(odd_docs(spark).filter("doc_id = 9"))).first()
    assert bytes(back["bytes"]).decode() == "émigré 漢字 \U0001f600 straße"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("abcDeéßñ中 \n\t\x0b\x1c\x85　'st01!?Σσİ") + ["<|endoftext|>", " <|ENDOFTEXT|>"]), max_size=40).map("".join))
def test_word_ids_by_runs(text):
    got = array.array("I", pk.load(pk.default_tokenizer()).encode([text.encode()])[0]).tolist()
    assert got == WORD.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "I\u0307", "A\u030a", *"HTWYJaé \n\u0308\u0331\u0323"]), max_size=20).map("".join))
@example("J\u030ca H\u0331 T\u0308 W\u030a Y\u030a J\u030c")
def test_word_ids_of_capitals_with_combining_marks(text):
    got = array.array("I", pk.load(pk.default_tokenizer()).encode([text.encode()])[0]).tolist()
    assert got == WORD.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*map(chr, range(33, 127)), *"éÉßÿĀőŐİıǅȺ×÷ªσΣЖ中", "'s", "'ll", "don't", "\x1c", "\x00", "\u0331"]), max_size=14).map("".join), max_size=30))
def test_word_ids_of_runs_encoded_together(runs):
    text = " ".join(runs)
    got = array.array("I", pk.WordBpe.encode(FRESH, [text.encode()])[0]).tolist()
    FRESH.memo.clear()
    assert got == WORD.encode(text, add_special_tokens=False).ids


def packed_well(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("make", [lambda r: r.randint(1, 400), lambda r: r.randint(1, 12), lambda r: 137, lambda r: r.choice([133, 134, 200, 199, 60, 7, 1, 400])])
def test_sweeps_are_near_best_fit_decreasing(spark, make):
    rng = random.Random(5)
    lengths = [make(rng) for _ in range(900)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = pk.best_fit_pack(pieces, 400).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert packed_well(rows, 400) <= 1 + 1.01 * best_fit_decreasing(lengths, 400)


def test_one_sweep_gives_every_gap_the_largest_piece_that_waits(spark):
    rng = random.Random(6)
    lengths, gaps = [rng.randint(1, 30) for _ in range(120)], [rng.randint(1, 34) for _ in range(70)]
    left = spark.createDataFrame([(n, i) for i, n in enumerate(lengths)], "length long, _id long")
    rows = pk.sweep(left, spark.createDataFrame([(i, g) for i, g in enumerate(gaps)], "sequence_id long, _gap long"), max(lengths), 1).collect()
    waiting, want = sorted(lengths), []
    for g in sorted(gaps):
        fit = [n for n in waiting if n <= g]
        if fit:
            waiting.remove(fit[-1])
            want.append((g, fit[-1]))
    assert sorted((r["_gap"], r["_taken"]) for r in rows if r["_taken"]) == sorted(want)
    assert sorted((gaps[r["sequence_id"]], r["length"]) for r in rows if r["length"] and r["sequence_id"] is not None) == sorted(want)


def test_op5_on_data(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    rows = pk.op5_best_fit_packing(spark, data).collect()
    packed_well(rows, 2048)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], {})[r["piece"]] = r
    assert set(by) == set(texts)
    for doc_id, pieces in by.items():
        ids = WORD.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        assert sorted(pieces) == list(range(-(-len(ids) // 2048)))
        for k, r in pieces.items():
            own = ids[2048 * k : 2048 * (k + 1)]
            assert (r["start"], r["length"]) == (2048 * k, len(own)) and r["ids_crc32"] == zlib.crc32(array.array("I", own).tobytes())


def test_op5_odd(spark):
    rows = pk.pack_documents(odd_docs(spark)).collect()
    packed_well(rows, 2048)
    assert sum(r["doc_id"] == 8 for r in rows) == 2 and next(r["length"] for r in rows if r["doc_id"] == 2) == 1
    assert pk.pack_documents(no_docs(spark)).count() == 0
    hot = stored(spark.range(3000).selectExpr("id as doc_id", "0 as piece", "700L as length"), "hot")
    assert packed_well(pk.best_fit_pack(hot).collect(), 2048) == 1500
    with pytest.raises(ValueError):
        pk.best_fit_pack(hot.selectExpr("doc_id", "piece", "5000L as length"))


def unigram(vocabulary, unknown, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, unknown, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t, tc.UnigramCounter(vocabulary, unknown)


VOCABULARY, UNKNOWN = tc.read_vocabulary(tc.default_model())
PAIRS = [unigram(VOCABULARY, UNKNOWN, True), unigram([x for x in VOCABULARY if not x[0].startswith("<0x")], UNKNOWN, False), unigram([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0)], 0, False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abcthe éß中 \n\t▁<>s/0xA😀") + ["aa", "  "]), max_size=40).map("".join))
def test_unigram_counts_are_exact(text):
    for true, own in PAIRS:
        assert own.count(text) == len(true.encode(text, add_special_tokens=False).ids)


def test_op3_on_data(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in tc.op3_token_counts(spark, data).collect()}
    assert got == {i: len(PAIRS[0][0].encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_op3_odd(spark):
    got = tc.token_counts(odd_docs(spark)).collect()
    assert len(got) == 10 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0} and tc.token_counts(no_docs(spark)).count() == 0
