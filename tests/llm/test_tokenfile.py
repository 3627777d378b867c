import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import tokenfile as P
from verdant.llm.shared import new_path

LIBRARY = Tokenizer.from_file(P.WORD_BPE)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 63, 4096):
        ids = rng.integers(0, [2, 50_000, 2**32, 7, 1000, 5][seed], n).astype(np.uint32)
        if seed in (3, 4):
            ids[:: 1 + n // 5] = 2**32 - 1
        data = P.pack(ids)
        assert (P.unpack(data) == ids).all()
        with pytest.raises(ValueError):
            P.unpack(data + b"x")
    assert P.HEAD.unpack_from(P.pack(np.full(100, 9, np.uint32)))[3] == 0


def test_files_are_read_by_index_and_checked():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 49_000, n).astype(np.uint32) for n in (0, 3, 5000, 1, 0, 9000, 4096)]
    out = io.BytesIO()
    writer = P.Writer(out)
    for k, ids in enumerate(texts):
        writer.add(None if k == 1 else k, ids)
    writer.close()
    reader = P.Reader(out)
    every = np.concatenate(texts)
    for start, n in ((0, 0), (0, 1), (4095, 2), (5000, 8000), (len(every) - 1, 1)):
        assert (reader.ids(start, n) == every[start : start + n]).all()
    assert [(k, s, i.tolist()) for k, s, i in reader.each(1)] == [(None if k == 1 else k, sum(map(len, texts[:k])), t.tolist()) for k, t in enumerate(texts)]
    for broken in (out.getvalue()[:-1], out.getvalue()[:10], b"x" + out.getvalue()[1:]):
        with pytest.raises(ValueError):
            P.Reader(io.BytesIO(broken))
    with pytest.raises(ValueError):
        reader.ids(len(every), 1)


def test_words_are_encoded_as_by_the_library():
    encode = P.Encoder()
    rng = random.Random(1)
    alphabet = "abcXYZéÀßñ'’“”¼²³ \t\n\r\x0b\x1c\x85\xa0-.,!?0123456789µªº×÷ÿŸIİ€́漢🙂<|>"
    texts = ["", "It's they've I'LL 'S 'd''s", "<|startoftext|> x <|endoftext|>", "a" * 300, "naïve café ́", "x\x1cy\x85z", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)), prose(rng, 400)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text), repr(text)
    encode.MOST_HELD = 5
    for text in texts[-50:]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text)


def test_documents_in_order(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(i, prose(rng, rng.randint(0, 60))) for i in rng.sample(range(50, 900), 200)]
    df = with_clashing_columns(documents(spark, rows)).repartition(5)
    got = [tuple(r) for r in P.read_tokens(spark, P.write_tokens(df, new_path(spark, "t"))).collect()]
    counts = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(((d, n, c) for d, _, n, c in got), key=repr) == sorted(((d, *counts([*library(t), 1])) for d, t in rows), key=repr)
    start = 0
    for d, s, n, _ in sorted(got, key=lambda r: r[1]):
        assert s == start
        start += n
    assert [d for d, *_ in sorted(got, key=lambda r: r[1])] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)


def test_empty_table(spark):
    assert P.read_tokens(spark, P.write_tokens(documents(spark, []), new_path(spark, "t"))).count() == 0
