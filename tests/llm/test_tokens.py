from __future__ import annotations

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from aerokpi.llm import bpe, packing  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = list("abcABHIKT 'stdlvmre09.,!?*#<|>=\n\t\r\x0b\x0c\x1c\x1d\x85\xa0  　éñßΣσ日本中̸̱́̇😀²½ǅʼ​٣")


def odd_texts(n):
    rng = random.Random(n)
    some = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(n)]
    return some + ["a<|endoftext|> b", "<|startoftext|>", "A<|ENDOFTEXT|>.", " \n<|endoftext|>\n ", "they'LL don't'S", "a" * 9000, " " * 3000, "é" * 999, "-=" * 500]


@pytest.fixture(scope="module")
def rows(awkward):
    return awkward + [(1000 + i, t) for i, t in enumerate(odd_texts(1500))]


def test_bpe_equals_the_library(docs_of, rows):
    tokenizer = Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in
                 bpe.encoded(docs_of(rows), BYTE, with_ids=True, with_text=True).collect())
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert decoded == (text or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids), decoded))
    assert got == sorted(want)


def test_greedy_proposals_fail_and_are_repaired():
    coder, _ = bpe.encoder(BYTE)
    tokenizer = Tokenizer.from_file(BYTE)
    words = [" unbelievably", " thtionst", " onanthe", "thereinghe", " erblend"]
    coder.encode_words(words)
    for w in words:
        assert coder.known[w] == tokenizer.encode(w, add_special_tokens=False).ids


def test_pairs_and_words_side_by_side_equal_merging_one_by_one():
    coder, _ = bpe.encoder(BYTE)
    rng = np.random.default_rng(5)
    assert coder.regular
    usual = np.array([i for _, _, ids in coder.by_length for i in ids.tolist()])
    left, right = rng.choice(usual, 4000), rng.choice(usual[:2000], 4000)
    left[:200] = right[:200]  # the same token twice
    got = coder.stands(left, right, np.full(len(left), bpe.NO_MERGE))
    want = [coder.merge(coder.tokens[a] + coder.tokens[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    words = [t.encode() for t in odd_texts(800)] + [b"", b"aaaa", b"a" * 63, b"a" * 64, b"a" * 65, b" " * 64]
    assert coder.merge_all(words) == [coder.merge(w) for w in words]
    assert coder.merge_all([]) == [] and coder.merge_all([b""]) == [[]]


def test_vocabulary_with_two_merges_of_a_token_is_merged_exactly(tmp_path):
    alphabet = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    vocab = alphabet | {x: 256 + i for i, x in enumerate(["ab", "bc", "abc"])}
    merges = [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    coder = bpe.SpeculativeBPE(str(path))
    assert not coder.regular
    coder.encode_words(["abc", "bcab", "aabcc"])
    assert all(coder.known[w] == coder.merge(w.encode()) for w in ("abc", "bcab", "aabcc"))


def pieces_are_right(out, texts):
    tokenizer = Tokenizer.from_file(WORD)
    by_doc, sequences = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing_holds_every_id_once(docs_of, rows):
    texts = {i: t for i, t in rows if rows.count((i, t)) == 1 and i is not None}
    out = packing.pack_documents(docs_of(list(texts.items())), WORD).collect()
    n = pieces_are_right(out, texts)
    total = sum(r.length for r in out)
    assert n <= total / 2048 * 1.02 + 3 * 2  # little padding, but for the last windows of each task


def test_packing_awkward_rows_and_empty_table(docs_of, awkward):
    out = packing.pack_documents(docs_of(awkward), WORD).collect()
    assert {r.doc_id for r in out} == {i for i, _ in awkward}
    assert [(r.length, r.ids_crc32) for r in out if r.doc_id == 1] == [(1, zlib.crc32(b"\x01\0\0\0"))]
    assert sum(r.length == r.doc_tokens for r in out if r.doc_id == 5) in (0, 2)  # the repeated row is packed twice
    assert packing.pack_documents(docs_of([]), WORD).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_differencing_balances_and_fits(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 513, 600)
    at, windows = packing.pack(lengths, 2048)
    sums = np.bincount(at, lengths, windows)
    assert sums.max() <= 2048 and windows <= -(-lengths.sum() // 2048) + 1
    assert sums.max() - sums.min() <= 100


def test_more_windows_when_capacity_is_exceeded():
    at, windows = packing.pack(np.array([1500, 1500, 1500]), 2048)
    assert windows == 3 and sorted(at) == [0, 1, 2]
    assert packing.pack(np.array([], dtype=np.int64), 2048)[1] == 1
    assert packing.pack(np.array([2048]), 2048)[1] == 1
