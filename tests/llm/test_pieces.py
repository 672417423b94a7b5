"""SentencePiece encoding against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece

from gaugeworks.llm import pieces
from gaugeworks.llm.queries import op11_sentencepiece, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "  hello  world ", "▁", "x▁▁y▁ ", "a\tb\nc\r\n", "<s></s> <unk> <0x41>", "\x00", "é́ 日本 𝒳 \xa0", "\n\n\n\n", "=" * 500, "ab" * 3000, " " * 300 + "z" * 200, "the " * 5000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def some_texts(n):
    rng = random.Random(4)
    letters = "aeinrst thelo  ▁\n,.-=0123é日𝒳ß\t"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_words_alone_give_the_ids_of_the_whole(library):
    model = pieces.Model(open(PATH, "rb").read())
    for t in ODD + some_texts(300):
        own = [i for w in (pieces.marked_words(t) if t else []) for p in model.parts.findall(pieces.MARK + w) for i in model.segment(p)]
        assert own == library.encode(t)


def test_decoding(library):
    rng = random.Random(5)
    for t in ODD + some_texts(50):
        ids = library.encode(t, add_eos=True)
        assert pieces.decode(ids, PATH) == library.decode(ids)
    for _ in range(100):
        ids = [rng.choice([rng.randrange(1, 32000), rng.randrange(3, 259), 28705]) for _ in range(rng.randrange(12))]
        assert pieces.decode(ids, PATH) == library.decode(ids)


@pytest.mark.parametrize(("chars", "words", "part"), [(pieces.BLOCK_CHARS, pieces.BLOCK_WORDS, pieces.PART_WORDS), (300, 20, 7)])
def test_tables_with_odd_rows(spark, library, chars, words, part):
    texts = [*ODD, None, *some_texts(40), "hello hello", "hello hello"]
    rows = [(k if k != 3 else None, t, f"extra{k}") for k, t in enumerate(texts)] + [(7, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    got = pieces.encode(docs, PATH, block_chars=chars, block_words=words, part_words=part)
    assert got.columns == ["doc_id", "n_tokens", "token_ids"]
    want = sorted(((k, library.encode(t or "", add_eos=True)) for k, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.token_ids) for r in got.collect()), key=repr) == want
    assert all(r.n_tokens == len(r.token_ids) for r in got.collect())
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_words_beyond_sixteen_bits(spark, library):
    """More words of a block occur twice than 16 bits number, and some once."""
    words = [f"w{a}{b}" for a in range(300) for b in "abcdefghijklmnopqrstuvwxyz" for _ in range(9)]
    rng = random.Random(9)
    names = ["".join(rng.choice("aeioustr") for _ in range(7)) for _ in range(70_000)]
    rows = [(k, " ".join(names[k * 700 : k * 700 + 701])) for k in range(100)] + [(100 + k, " ".join(reversed(names[k * 700 : k * 700 + 700]))) for k in range(99)] + [(200, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.token_ids for r in pieces.encode(docs, PATH).collect()}
    assert got == {k: library.encode(t, add_eos=True) for k, t in rows}


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op11_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_piece_across_a_marker_is_refused(monkeypatch):
    class Odd(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 5000 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError, match="crosses"):
        pieces.Model(open(PATH, "rb").read())
