"""The registered queries without SQL, over whole tables, against the tokenizers' libraries and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessavec.llm import ngram_join
from tessavec.llm.queries import QUERIES
from tests.llm.test_operators import tiktoken_library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def ids_by(name, table):
    every = sorted(table)
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([table[i] for i in every], add_special_tokens=False)
    return {i: e.ids for i, e in zip(every, found, strict=True)}


def crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows(spark, name, *columns):
    return sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect()))


def test_packing_query(spark, table):
    whole = {i: [*ids, 2] for i, ids in ids_by("byte_bpe_50k.json", table).items()}
    got = QUERIES["op2_best_fit_packing"](spark, SF).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(whole)
    for i, found in pieces.items():
        ids, at = whole[i], 0
        for k, (piece, start, length, crc) in enumerate(sorted(found)):
            assert (piece, start) == (k, at) and crc == crc32(ids[at : at + length])
            assert length == 1024 or k == 0
            at += length
        assert at == len(ids) and len(found) == -(-len(ids) // 1024)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(map(len, whole.values())) // 1024) + 2


def test_token_file_query(spark, table):
    at, want = 0, []
    for i, ids in sorted(ids_by("word_bpe_49k.json", table).items()):
        want.append((i, at, len(ids) + 1, crc32([*ids, 1])))
        at += len(ids) + 1
    assert rows(spark, "op4_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_byte_bpe_query(spark, table):
    library, want = tiktoken_library(), []
    for i, text in sorted(table.items()):
        ids = library.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows(spark, "op5_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_ngram_query(spark, table):
    want = sorted((i, n, c) for i, (n, c) in ngram_join.brute_force(list(table.items())).items())
    assert rows(spark, "op6_ngram_join", "doc_id", "n_shingles", "component_id") == want


def test_token_count_query(spark, table):
    want = sorted((i, len(table[i].encode()), len(ids), len(ids) > 2048) for i, ids in ids_by("word_bpe_49k.json", table).items())
    assert rows(spark, "op9_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == want
