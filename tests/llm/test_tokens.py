import hashlib
import random

import numpy as np
import pytest

from apiquarry.llm import bpe, token_counts
from apiquarry.llm.tokenizer_files import byte_bpe

from . import cases

tokenizers = pytest.importorskip("tokenizers")
EOS = 50256


@pytest.fixture(scope="module")
def own():
    return bpe.load(byte_bpe())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(byte_bpe())


def texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéèçß漢字한글 \n\t.,-_=0123456789'’"
    fixed = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "   x", "a" * 5000, " " * 3000, "-" * 900 + "=" * 900, "x\x85y\x1c z", "ÃÂ" * 900, "é" * 999 + "b", "\x00\x01", "I'LL 're don't", "١٢٣ ½² Ⅷ", "😀" * 50]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(200)] + ["".join(rng.choice("thern") for _ in range(4000))]


def test_ids_and_text_agree_with_the_library(own, library):
    cache = bpe.PieceCache(own)
    for text in texts():
        ids = own.encode(text, cache)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_decoder_replaces_broken_characters(own, library):
    ids = [random.Random(5).randrange(EOS + 1) for _ in range(20000)]
    assert own.decode(np.array(ids, dtype=np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_lookahead_is_sufficient_and_windows_change_nothing(own):
    """Whatever follows a window, the tokens that end ``lookahead`` before its end stay."""
    rng = random.Random(6)
    seen = [b for b in own.bytes_of.values() if b.isalpha() and len(b) > 1]
    for _ in range(150):
        data = b"".join(rng.choice(seen) for _ in range(120))
        whole, cut = own.merged(data), rng.randrange(own.lookahead + 10, len(data))
        ends = np.cumsum([len(own.bytes_of[t]) for t in own.merged(data[:cut])])
        stable = ends[ends <= cut - own.lookahead]
        assert set(stable) <= set(np.cumsum([len(own.bytes_of[t]) for t in whole]))
        assert [*own.transduce(data, own.lookahead + own.longest)] == whole


def test_lookahead_of_small_lists():
    length = {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    # (b, c) comes before (a, b): whether a and b merge depends on the byte behind b
    assert bpe.lookahead({(1, 2): (0, 3), (0, 1): (1, 4)}, length) == 2
    assert bpe.lookahead({(0, 1): (0, 4)}, length) == 1


def test_digests(spark, library):
    rows = bpe.token_digests(cases.odd(spark), byte_bpe()).collect()
    want = []
    for r in cases.ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.token_digests(cases.empty(spark), byte_bpe()).count() == 0


def test_documents_keep_their_columns(spark):
    docs = cases.odd(spark)
    coded = bpe.encode_documents(docs, byte_bpe())
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    assert sorted(map(repr, coded.select(*[f"`{c}`" for c in docs.columns]).collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(ValueError):
        bpe.encode_documents(coded, byte_bpe())


def brute(tokens, separator):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == separator:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("width", [2, 4])
def test_boundaries_across_blocks_and_groups(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    rng, want = random.Random(8), {}
    for name, p in (("dense", 0.5), ("sparse", 0.01), ("none", 0.0), ("only", 1.0)):
        tokens = np.where(np.array([rng.random() for _ in range(500)]) < p, EOS, 7)
        if name == "dense":
            tokens[-1] = EOS
        tokens.astype(token_counts.WIDTHS[width]).tofile(tmp_path / name)
        want[name] = brute(tokens.tolist(), EOS)
    (tmp_path / "void").touch()
    blocks = token_counts.read_flat_files(spark, str(tmp_path), width, block=16)
    got = {}
    for r in token_counts.document_lengths(blocks, EOS, width).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.ordinal, r.first_token, r.n_tokens, r.closed))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_counts_of_documents(spark, library, tmp_path):
    library.encode_special_tokens = True
    docs = cases.odd(spark).unionByName(spark.createDataFrame([cases.row(20, "a<|endoftext|>b")], cases.SCHEMA))
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, str(tmp_path / "t"), byte_bpe(), EOS).collect()), key=repr)
    want = sorted(((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in [*cases.ROWS, cases.row(20, "a<|endoftext|>b")]), key=repr)
    library.encode_special_tokens = False
    assert got == want
    assert token_counts.token_counts(cases.empty(spark), str(tmp_path / "e"), byte_bpe(), EOS).count() == 0
    with pytest.raises(ValueError):
        token_counts.write_token_files(docs, str(tmp_path / "f"), byte_bpe(), 70000)
