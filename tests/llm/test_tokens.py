import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from linkloom.llm.bpe import Codec, bpe, bpe_digests
from linkloom.llm.ordering import materialise, read_slots
from linkloom.llm.token_counts import count_huge, count_tokens, spaces_are_stable, token_counts

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def pieces(tokenizer_path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


@pytest.fixture(scope="module")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORDS))
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "Bc", "é", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "</s>", "<s>", "́", " ", "\x85", "\x1c", " ", " ", " ", "\n", "\t", "'s", "12", "\x00", "Σς", "😀", "İ", "ſ", "***", ".", "hello ", "▁"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(n)]


def test_token_counts(docs, texts, nothing, tokenizer_path, pieces):
    got = Counter(tuple(r) for r in token_counts(docs, tokenizer_path(PIECES)).collect())
    assert got == Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for i, t, *_ in texts)
    assert token_counts(nothing, tokenizer_path(PIECES)).count() == 0


def test_chunks_are_spliced_exactly(tokenizer_path, pieces):
    assert spaces_are_stable(tokenizer_path(PIECES))
    rng = random.Random(3)
    long = ["x" * 5000, "日本語" * 2000, " ".join(["ab cd  e"] * 900), "a b " * 2000, "".join(rng.choice("ab \n\t▁é日") for _ in range(6000)), *odd_texts(30, 4)]
    for t in long:
        assert count_huge(pieces, t, 300, 16) == len(pieces.encode(t))
    assert count_tokens(long, tokenizer_path(PIECES), 300, 16) == [len(pieces.encode(t)) for t in long]


def test_codec_equals_the_library(tokenizer_path, library):
    codec = Codec(tokenizer_path(WORDS), mean=48)
    small = Codec(tokenizer_path(WORDS), mean=16, words=40, chunks=5)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    rng = random.Random(9)
    latin = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",***"]) for _ in range(60)) for _ in range(150)]
    for t in [*odd_texts(400, 1), *latin, "x" * 3000, "no" + "日本" * 800 + " end"]:
        ids = library.encode(t, add_special_tokens=False).ids
        want = (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert codec.encode(t) == want
        assert small.encode(t) == want


def test_bpe(docs, texts, nothing, tokenizer_path, library):
    path = tokenizer_path(WORDS)
    want = []
    for i, t, *_ in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in bpe(docs, path).collect()) == Counter((i, len(x), tuple(x), d) for i, x, d in want)
    assert Counter(tuple(r) for r in bpe_digests(docs, path).collect()) == Counter((i, len(x), sha(" ".join(map(str, x))), sha(d)) for i, x, d in want)
    assert bpe(nothing, path).count() == 0


@pytest.mark.parametrize("coded", [False, True])
def test_training_order(docs, texts, nothing, tokenizer_path, library, tmp_path, coded):
    path = tokenizer_path(WORDS) if coded else None
    folder = f"file://{tmp_path}/shards"
    rows = sorted(materialise(docs, path, folder, length=16, records=64).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    got = list(read_slots(folder, 0, len(rows), 16, 64, path))
    end, streams = (0xFFFE, {}) if coded else (0xFE, {})
    for r, g in sorted(zip(rows, got, strict=True), key=lambda x: (x[0]["part"], x[0]["seq_no"])):
        assert r["position"] == r["slot"] % 64 * 16 * (2 if coded else 1) and r["n_tokens"] == len(g)
        stream, owners = streams.setdefault(r["part"], ([], []))
        assert r["seq_no"] * 16 == len(stream)
        ends = sum(x == end for x in g.tolist())
        assert len(r["doc_ids"]) == ends + (g[-1] != end)
        owners += r["doc_ids"][1:] if stream and stream[-1] != end else r["doc_ids"]
        stream += g.tolist()
    found = Counter()
    for stream, owners in streams.values():
        cut = [k for k, x in enumerate(stream) if x == end]
        found.update((i, tuple(stream[a + 1 : b])) for i, a, b in zip(owners, [-1, *cut], cut, strict=False))
        assert len(owners) == len(cut)
    want = Counter()
    for i, t, *_ in texts:
        if t and (ids := library.encode(t, add_special_tokens=False).ids if coded else list(t.encode())):
            want[i, tuple(ids)] += 1
    assert found == want
    resumed = list(read_slots(folder, 100, 30, 16, 64, path))
    assert all(np.array_equal(a, b) for a, b in zip(resumed, got[100:130], strict=True))
    assert [(r["part"], r["seq_no"]) for r in rows] != sorted((r["part"], r["seq_no"]) for r in rows)
    assert materialise(nothing, path, f"file://{tmp_path}/none").count() == 0


def test_training_order_query_writes_the_vocabulary(spark, library):
    from linkloom.llm.queries import documents, op9_training_order

    data = "/root/testdata/sf0.001"
    want = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in documents(spark, data).collect()]
    rows = op9_training_order(spark, data).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(n + 1 for n in want if n)


def test_ids_alone_equal_the_library(tokenizer_path, library):
    texts = ["", *odd_texts(200, 6), "no" + "日本" * 300 + " end", ""]
    got = Codec(tokenizer_path(WORDS)).ids_all(texts, at_once=2000, chunked=False)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_training_order_encodes_distinct_words_array_wise(tokenizer_path, library, monkeypatch):
    """No step for each word of a text in Python: the library sees only words that aren't of Latin letters, and signs, once each."""
    from linkloom.llm import ordering

    known = Codec(tokenizer_path(WORDS))
    asked, by_library = [], known.by_library
    monkeypatch.setattr(known, "by_library", lambda words: asked.extend(words) or by_library(words))
    monkeypatch.setattr(known, "learn", lambda words: pytest.fail("words one by one"))
    monkeypatch.setattr(ordering, "codec", lambda path: known)
    texts = ["one Word, WORD; a word.", None, " \t", "Éa éA, İa. ȺȾ ß x y z\x1cz,", "one " * 50 + "x" * 70 + " a1, a1;", *odd_texts(50, 8)]
    got = ordering.ids_of(texts, WORDS)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u2") for t in texts]
    assert got == [w.tobytes() + b"\xfe\xff" if len(w) else b"" for w in want]
    assert len(asked) == len(set(asked)) and {b",", b"a1,"} <= {*asked} and not {b"one", b"Word,", b"word", "éa".encode()} & {*asked}


def test_letters_that_are_kept_are_bounded(tokenizer_path, library):
    codec = Codec(tokenizer_path(WORDS))
    codec.plain.most = 5
    texts = ["alpha beta gamma", "beta delta, epsilon zeta eta theta iota", "alpha theta beta", ""] * 2
    assert [x.tolist() for x in codec.ids_all(texts, at_once=20, chunked=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < len(codec.plain.known) == len(codec.plain.sizes) <= 5 and codec.plain.sizes.sum() == len(codec.plain.ids)
