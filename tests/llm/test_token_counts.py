import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from textloom.llm.token_counts import Transducer, count_tokens, read_tokenizer  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def fsm():
    return Transducer(read_tokenizer(PATH))


def counts(fsm, texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    return fsm.count(np.frombuffer(b"".join(raw) + b"\0\0", np.uint8), offsets).tolist()


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts(fsm, library):
    rnd = random.Random(7)
    parts = [*" \n\tabcdersvltm'\"!.,019éßñ", "  ", "'s", "'re", "'ll", " the", "ing", "中", "한", "😀", "<|endoftext|>", "́", "²", "\x1c", "　", "\u0085"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    assert counts(fsm, texts) == expected(library, texts)


def test_edges(fsm, library):
    texts = ["", " ", "'", "'r", "'re", "'rex", "  a", "\n\na", "x" * 5000, "ab " * 3000, " " * 3000, "é" * 2500, "<|endoftext|><|endoftext|>", "a<|endoftext|>", "don't they'll"]
    assert counts(fsm, texts) == expected(library, texts)


def long_texts():
    rnd = random.Random(11)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9)))
    return {
        "english": " ".join(word("etaoinshrdlu") for _ in range(4000)),
        "russian": " ".join(word("оеаинтсрвлкмдпу") for _ in range(4000)),
        "greek": ", ".join(word("αβγδεζηθικ") for _ in range(2000)),
        "arabic": " ".join(word("ابتثجحخد") for _ in range(2000)),
        "chinese": "".join(word("的一是不了人我在有他") + "，。" * (rnd.random() < 0.2) for _ in range(3000)),
        "letters": "".join(rnd.choice("abcdefghij") for _ in range(30_000)),
        "same": "a" * 30_000,
        "digits": "".join(rnd.choice("0123456789") for _ in range(20_000)),
        "code": "".join(rnd.choice(["x=", "(a,b)", "'s", "''", "re", "'re", "\n", "\t\t", "12", "é'", "—"]) for _ in range(9000)),
        "marks": "".join(rnd.choice("!?.,'") for _ in range(9000)),
        "spaces": "".join(rnd.choice([" ", "\n", "\u3000", "\u00a0"]) for _ in range(9000)),
    }


def test_long_texts_in_many_scripts(fsm, library):
    texts = list(long_texts().values())
    assert counts(fsm, texts) == expected(library, texts)
    for text in texts:
        assert counts(fsm, [text]) == expected(library, [text])


def test_few_states(library, monkeypatch):
    from textloom.llm import token_counts

    monkeypatch.setattr(token_counts, "MAX_STATES", 500)
    monkeypatch.setattr(token_counts, "MAX_ANSWERS", 2000)
    fsm = Transducer(read_tokenizer(PATH))
    texts = [t[:6000] for t in long_texts().values()]
    assert counts(fsm, texts) == expected(library, texts)
    assert len(fsm.states) < 20_000 and len(fsm.bpe.fits) <= 2000


def test_many_special_strings(fsm, library):
    texts = ["<|endoftext|>".join(["a b", "'s", "", " ", "é"] * 300), "x<|endoftext|>"]
    assert counts(fsm, texts) == expected(library, texts)


def test_reset_keeps_counts(fsm, library):
    texts = ["some text, again and again", "others"]
    fsm.reset()
    assert counts(fsm, texts) == expected(library, texts)


def test_neighbours_agree_with_merging(fsm):
    bpe, rnd = fsm.bpe, random.Random(1)
    for _ in range(5000):
        a, b = rnd.randrange(len(bpe.sorted)), rnd.randrange(len(bpe.sorted))
        if bpe.reachable[a] and bpe.reachable[b]:
            assert bpe.neighbours(a, b) == (bpe.encode(bpe.sorted[a] + bpe.sorted[b]) == [bpe.sorted[a], bpe.sorted[b]])


def test_frame(spark, library):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, None, "y"), (3, "", "z"), (4, "long " * 20000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, PATH).collect())
    assert out == [(0, 0, 0), (1, 11, 2), (1, 11, 2), (3, 0, 0), (4, 100000, expected(library, ["long " * 20000])[0])]
    assert count_tokens(df.limit(0), PATH).collect() == []
