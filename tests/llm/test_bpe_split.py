import base64
import os
import random

import numpy as np
import pytest

from strandline.llm.bpe import PATTERN, VOCABULARIES, VOCABULARY, encode_column, encoder
from strandline.llm.split import SparseTable, Splitter, split_oversized

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(VOCABULARIES, VOCABULARY)), reason="no vocabulary")
PARTS = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "ł", "日", "本", "🙂", "\u200b", "1", "23", "'s", "'", "-", "=", "===", "x", "aaaa", "\r\n", "ß", "Я", "<|endoftext|>", "\u00a0", "\x00"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(os.path.join(VOCABULARIES, VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_random_texts(reference):
    r, own = random.Random(0), encoder()
    for _ in range(3000):
        text = "".join(r.choices(PARTS, k=r.randint(0, 40)))
        assert list(own.tokens(text)) == reference(text), text


def test_long_pretokens(reference):
    own = encoder()
    for text in ("a" * 30_000, "日本" * 5_000, " " * 9_000, "=-" * 6_000, "ab\n \n" * 4_000):
        assert list(own.tokens(text)) == reference(text)


def test_column_edges(spark, reference):
    """Null and empty texts give empty arrays; null keys, repeated rows and clashing names stay."""
    rows = [(1, "hello <|endoftext|>", "x"), (2, None, "x"), (3, "", None), (1, "hello <|endoftext|>", "y"), (None, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.ids) for r in encode_column(df, key="doc_id", text="text").collect()), key=str)
    assert got == sorted([(1, reference("hello <|endoftext|>")), (1, reference("hello <|endoftext|>")), (2, []), (3, []), (None, reference(" "))], key=str)
    assert encode_column(df.limit(0), key="doc_id", text="text").count() == 0


def test_sparse_table():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        v = r.integers(-1, 4, n)
        t = SparseTable(v)
        for _ in range(60):
            lo, hi = sorted(r.integers(0, n, 2).tolist())
            part = v[lo : hi + 1]
            assert t.argmax(lo, hi) == lo + max(np.flatnonzero(part == part.max()))


@pytest.mark.parametrize("text", ["word " * 3000, "One two three. Four five!\n\nSix " * 400, "a" * 20_000, " " * 9_000, "日本語" * 3_000, "ab \n" * 4_000, "🙂" * 3_000, "\n" * 5_000 + "x" * 3_000, "x1\r\n\r\n" * 2_000])
def test_pieces(reference, text):
    pieces = Splitter(VOCABULARIES, VOCABULARY, 256, 32).pieces(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, n in pieces:
        assert len(reference(text[a:b])) == n <= 256
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b <= d
        assert len(reference(text[c:b])) <= 64
    if text.startswith("One"):
        assert all(text[:b].endswith("\n\n") for _, b, _ in pieces[:-1])


def test_split_edges(spark, reference):
    rows = [(1, "word " * 1024, "k"), (2, "word " * 1000, "k"), (3, None, "k"), (4, "", "k"), (5, "é" * 1023, None), (1, "word " * 1024, "k")]
    df = spark.createDataFrame(rows, "id long, text string, key string")
    over = {i for i, t, _ in rows if t and len(reference(t)) > 1024}
    got = split_oversized(df, key="id", text="text").collect()
    assert {r.id for r in got} == over
    texts = {i: t for i, t, _ in rows}
    assert all(r.piece == texts[r.id][r.begin : r.end] and r.n_tokens <= 1024 for r in got)
    assert split_oversized(df.limit(0), key="id", text="text", with_text=False).columns == ["id", "piece_no", "begin", "end", "n_tokens"]
    with pytest.raises(ValueError):
        Splitter(VOCABULARIES, VOCABULARY, 64, 32)


def test_no_piece_is_over_the_limit():
    """Pretokens that can't be cut at a boundary, white space of every kind, characters of several tokens."""
    import random

    from strandline.llm.bpe import VOCABULARIES, VOCABULARY
    from strandline.llm.split import Splitter

    r = random.Random(1)
    parts = ["word ", "  \n" * 7, " " * 40, "😀" * 9, "𓀀𓁐" * 8, "x" * 200, "\t\n \r\n", "Ünï. ", "　" * 30, "!?" * 30, "123456", "\x00" * 20]
    for limit, overlap in ((16, 4), (24, 0), (64, 8), (128, 30)):
        own = Splitter(VOCABULARIES, VOCABULARY, limit, overlap)
        for _ in range(60):
            text = "".join(r.choices(parts, k=r.randint(1, 60)))
            pieces = own.pieces(text)
            assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b[0] <= a[1] and a[0] < b[0] for a, b in zip(pieces, pieces[1:]))
            for a, b, n in pieces:
                assert sum(1 for _ in own.encoder.tokens(text[a:b])) == n <= limit
    with pytest.raises(ValueError):
        Splitter(VOCABULARIES, VOCABULARY, 8, 2)
