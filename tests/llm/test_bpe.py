"""Byte-level BPE against plain merging and against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestrata.llm import bpe, common, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(common.tokenizer_file(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def automaton(ranks):
    return bpe.Automaton(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(automaton, text):
    return [i for piece in bpe.splitter(public_tokenizers.PATTERN)(text) for i in automaton.encode(piece.encode())]


def test_pieces_equal_plain_merging(automaton, ranks):
    rng = random.Random(5)
    tokens = list(ranks)
    for n in range(3000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5))) if n % 2 else bytes(rng.choice(b"aeinst \n0\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        whole = [ranks[piece]] if piece in ranks else bpe.merged(piece, ranks)
        assert automaton.encode(piece) == whole


def test_small_vocabularies_with_many_overlaps():
    rng = random.Random(9)
    for _ in range(60):
        made = [bytes([b]) for b in range(256)]
        for _ in range(rng.randrange(1, 40)):  # merges of tokens over two letters, in order
            token = rng.choice([t for t in made if t in (b"a", b"b") or len(t) > 1]) + rng.choice([t for t in made if t in (b"a", b"b") or len(t) > 1])
            if token not in made and len(token) < 12:
                made.append(token)
        ranks = {t: r for r, t in enumerate(made)}
        try:
            automaton = bpe.Automaton(ranks)
        except ValueError:  # not in the order of merges: told, not guessed
            continue
        for _ in range(60):
            piece = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60)))
            assert automaton.encode(piece) == ([ranks[piece]] if piece in ranks else bpe.merged(piece, ranks))


def test_texts_equal_the_library(automaton, library):
    rng = random.Random(3)
    odd = "aab  \n\t'sé中😀　\xa0١x,.!?\x1c\x85՘꟎ ՘ᇞ0"
    for n in range(3000):
        if n % 2:
            text = "".join(rng.choice(odd) for _ in range(rng.randrange(40)))
        else:
            text = "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(20)))
        assert ids(automaton, text) == library.encode_ordinary(text)


def test_every_letter_and_number_is_the_librarys(library):
    """Each code point after a letter and after a digit, where a class of another Unicode version would cut differently."""
    cut = bpe.splitter(public_tokenizers.PATTERN)
    probe = tiktoken.Encoding("p", pat_str=r"\p{L}|\p{N}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0x10000, 0x13000)]:
        letter_or_number = len(cut(f"a{chr(c)}")) == 1 or len(cut(f"1{chr(c)}")) == 1
        assert letter_or_number == bool(probe.encode_ordinary(chr(c))), hex(c)


def test_long_pieces_take_linear_time(automaton):
    for unit in (b"ab", b" ", b"aaaaaab"):
        out = automaton.encode(unit * 100_000)
        assert b"".join(automaton.tokens[i] for i in out) == unit * 100_000


def test_query_against_the_library(spark, library):
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = np.array(library.encode_ordinary(d.text or ""), dtype="<u4").tobytes()
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_odd_rows(spark, library):
    long = "word \n " * 400_000 + "end"
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "a b", None), (3, "<|endoftext|> é", "z"), (4, long, "w"), (5, "퟿\x00'S'll", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("__text", F.lit(1)).withColumn("c 0", F.lit(2))
    told = bpe.decode(bpe.encode(docs, ["doc_id", "c 0", "text"]), ["doc_id", "c 0", "text", "n_tokens"]).collect()
    assert len(told) == len(rows)
    for r in told:
        want = library.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode() and r["c 0"] == 2
    assert bpe.encode(docs.limit(0), ["doc_id"]).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"a\xff b"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text")
    assert bytes(bpe.decode(bpe.encode(bad, []), []).first().decoded).decode() == "a� b"
    none = spark.createDataFrame([(None,), (bytearray(),)], "ids binary")
    assert [r.decoded for r in bpe.decode(none, []).collect()] == [None, b""]


def test_slices_begin_where_pieces_begin(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    rng = random.Random(2)
    cut = bpe.splitter(public_tokenizers.PATTERN)
    for _ in range(500):
        text = "".join(rng.choice("ab1. \n\t　é") for _ in range(rng.randrange(80)))
        assert [p for part in bpe.text_slices(text.encode()) for p in cut(part.decode())] == cut(text)


def test_vocabularies_that_merging_cant_use():
    full = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        bpe.Automaton({b"a": 0})
    with pytest.raises(ValueError):
        bpe.Automaton(full | {b"abc": 300, b"ab": 400})
    unreached = bpe.Automaton(full | {b"abc": 300})
    assert unreached.encode(b"abc") == [300] and unreached.encode(b"abcd") == [97, 98, 99, 100]
