import hashlib
import random

import public_tokenizers
import pytest

from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import bytebpe as B

ENC = B.encoding(B.RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("chunk,overlap", [(20, 5), (50, 10), (64, 64), (200, 3)])
def test_chunks_stitch_to_the_whole(chunk, overlap):
    rng = random.Random(chunk)
    alphabet = ["a", "b ", " ", "  ", "\n", "\t\n ", "1", "23 ", "'s", "'ll", "!", "?? ", "é", "漢", "🙂", "\xa0", "word", " another"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
        if rng.random() < 0.2:
            text += rng.choice(["x", " ", "\n", "7"]) * rng.randint(1, 300) + "end"
        assert B.encode(text, ENC, public_tokenizers.PATTERN, chunk, overlap) == ENC.encode_ordinary(text)
        assert "".join(B.pieces(text, public_tokenizers.PATTERN, chunk, overlap)) == text


def test_pieces_are_about_a_chunk():
    text = prose(random.Random(1), 3000)
    pieces = B.pieces(text, public_tokenizers.PATTERN, 500, 50)
    assert len(pieces) > 20 and max(map(len, pieces)) < 1100


def test_decoding_joins_bytes():
    ids = ENC.encode_ordinary("a🙂漢é" * 50)
    assert b"".join(B.decode(ids, ENC, 3)) == ("a🙂漢é" * 50).encode()


def test_rows(spark):
    rows = odd_rows()
    got = sorted((tuple(r) for r in B.digests(with_clashing_columns(documents(spark, rows))).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i := ENC.encode_ordinary(t or "")), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for d, t in rows]
    assert got == sorted(want, key=repr)
    assert {(r["doc_id"], tuple(r["ids"])) for r in B.encoded(documents(spark, rows)).collect()} == {(d, tuple(ENC.encode_ordinary(t or ""))) for d, t in rows}
    assert B.digests(documents(spark, [])).count() == 0
