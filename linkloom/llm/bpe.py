"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes sets cuts, so that passages that documents share are
cut alike wherever they stand. What lies between the words that two cuts fall into is a
chunk. Chunks are looked up first, by their 128-bit hash; only the words of chunks that
aren't found are looked up or encoded, and the chunk's ids are kept. At each cut the join is
repaired: the word that the cut falls into is encoded anew as a whole, and it is checked, by
encoding a stretch of text around it, that the pieces on both sides agree with what the
stretch gives. The stretch is widened word by word until they do, in the end to the whole
text, which is then encoded as it is.

Chunks and words are kept per Python worker, for all documents that it sees, in caches bounded by entries
and bytes, in two generations: what is used again stays.

Null texts count as empty: no tokens, digests of nothing. Repeated rows each return a row.
Null ids stay null. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, small_batches
from .merges import Merges
from .words import Words

_SPACES = SPACES.encode()
WINDOW = 16
#: Fixed by rule: a hash for each byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
#: Signs that a word may end in: a run of them is a token sequence of its own, and none is part of a special token or contraction.
TAIL = b".,;:!?*$%&#)("
Piece = tuple[int, str, str]


class Generations:
    """A dictionary that forgets what wasn't asked for lately: at most twice `most` entries, or twice `size` bytes of values.

    `young` holds what the current part of the input needs; `turn` begins a new generation between parts.
    """

    def __init__(self, most: int, size: int = 1 << 62):
        self.most, self.size, self.held, self.young, self.old = most, size, 0, {}, {}

    def turn(self) -> None:
        if len(self.young) >= self.most or self.held >= self.size:
            self.old, self.young, self.held = self.young, {}, 0

    def fetch(self, keys: Iterable[bytes]) -> list[bytes]:
        """Brings what is known of keys to `young`; the rest of them, once each."""
        young, old, unknown = self.young, self.old, []
        for k in set(keys).difference(young):
            if (found := old.get(k)) is None:
                unknown.append(k)
            else:
                young[k] = found
        return unknown

    def put(self, key: bytes, value: bytes) -> None:
        self.young[key] = value
        self.held += len(value)


def cuts(texts: list[bytes], mean: int) -> list[list[int]]:
    """By text, the places where the rolling hash of the last WINDOW bytes falls into one of `mean` equal ranges."""
    ends = np.cumsum([len(t) for t in texts])
    whole, at, block = b"".join(texts), [], 1 << 20
    for lo in range(0, len(whole) - WINDOW + 1, block):
        h = GEAR[np.frombuffer(whole[lo : lo + block + WINDOW - 1], np.uint8)]
        step = 1
        # Sums of 2, 4, 8, 16 shifted values: log2(WINDOW) additions.
        while step < WINDOW:
            h = h[:-step] * np.uint32(pow(3, step, 1 << 32)) + h[step:]
            step *= 2
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
        at.append(np.flatnonzero(h < np.uint32((1 << 32) // mean)) + lo + WINDOW)
    found = np.concatenate(at) if at else np.zeros(0, int)
    text = np.searchsorted(ends, found, side="left")
    begin = np.concatenate([[0], ends])[text]
    inside = found - WINDOW >= begin  # not across two texts
    found, text = (found - begin)[inside], text[inside]
    border = np.searchsorted(text, np.arange(len(texts) + 1))
    return [found[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)]


class Codec:
    """Encodes as the library does with add_special_tokens=False, and decodes what that gives.

    The vocabulary must drop white space between words and have no decoder, so that
    the decoded text is the tokens joined by a space; `check` probes both. Ids are held as
    bytes, two or four for each.
    """

    def __init__(self, path: str, mean: int = 2048, words: int = 100_000, chunks: int = 10_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size()
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.decimals = [str(i) for i in range(size)]
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.mean, self.words, self.chunks, self.joins = mean, Generations(words), Generations(chunks, 8 << 20), Generations(chunks)
        self.asked = self.reused = 0  # bytes of chunks, for figures
        self.merges = None
        self.check()
        self.merges = merges_of(path, self.library)
        self.plain = Words(self, _SPACES, TAIL)

    def check(self) -> None:
        probe = "ab cd\n\tE'll 12é <|endoftext|>x y"
        ids = self.library.encode(probe, add_special_tokens=False).ids
        parts = list(chain.from_iterable(self.library.encode(w.decode(), add_special_tokens=False).ids for w in probe.encode().split()))
        if ids != parts or self.library.decode(ids, skip_special_tokens=False) != " ".join(self.tokens[i] for i in ids):
            raise ValueError("this vocabulary doesn't drop white space between words, or has a decoder")

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def by_library(self, texts: list[bytes]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, words: Iterable[bytes]) -> None:
        """Brings the ids of all words to words.young; those that aren't known are encoded together."""
        fresh = self.words.fetch(words)
        if not fresh:
            return
        others, cut = [], []
        for w in fresh:
            core = w.rstrip(TAIL)
            plain = plain_form(core) if self.merges else None
            if plain is None:
                others.append(w)
            else:
                cut.append((w, plain, w[len(core) :]))
        put, young = self.words.put, self.words.young
        cores = self.words.fetch([plain for _, plain, _ in cut])
        for c, ids in zip(cores, self.merges.tokens(cores, self.kind) if cores else [], strict=True):
            put(c, ids)
        others += self.words.fetch([t for _, _, t in cut if t])
        for w, ids in zip(others, self.by_library(others), strict=True):
            put(w, ids)
        for w, plain, tail in cut:
            if w != plain:
                put(w, young[plain] + young[tail] if tail else young[plain])

    def of_words(self, words: Iterable[bytes]) -> bytes:
        """Ids of words that were learnt."""
        return b"".join(map(self.words.young.__getitem__, words))

    def encode_part(self, part: list[bytes]) -> list[bytes]:
        """Ids of each text: chunks first, then the words of those that aren't known, then the joins."""
        self.words.turn()
        self.chunks.turn()
        self.joins.turn()
        plans = [pieces(raw, at) for raw, at in zip(part, cuts(part, self.mean), strict=True)]
        known, keys, missed = self.chunks, [], {}
        for raw, plan in zip(part, plans, strict=True):
            keys.append([xxhash.xxh3_128_digest(raw[a:b]) for a, b, _, _ in plan])
        fresh = set(known.fetch(chain.from_iterable(keys)))
        stretches = {}
        for raw, plan, ks in zip(part, plans, keys, strict=True):
            for (a, b, start, stop), k in zip(plan, ks, strict=True):
                self.asked += b - a
                if k in fresh:
                    missed[k] = raw[a:b].split()
                    fresh.discard(k)
                else:
                    self.reused += b - a
                if stop > start:
                    s = stretch(raw, start, stop, 1)
                    stretches[s] = (raw, start, stop)
        unproven = [s for s in stretches if s not in self.joins.young and s not in self.joins.old]
        self.learn(chain(chain.from_iterable(missed.values()), chain.from_iterable(chain.from_iterable(stretches))))
        for k, words in missed.items():
            known.put(k, self.of_words(words))
        # A join is repaired once its word's neighbours agree with what the library makes of the stretch.
        bad = set()
        for s, whole in zip(unproven, self.by_library([b" ".join(chain.from_iterable(s)) for s in unproven]), strict=True):
            if self.of_words(chain.from_iterable(s)) == whole or self.widened(*stretches[s]):
                self.joins.put(s, b"")
            else:
                bad.add(s)
        out = []
        for raw, plan, ks in zip(part, plans, keys, strict=True):
            ids = []
            for (_, _, start, stop), k in zip(plan, ks, strict=True):
                ids.append(known.young[k])
                if stop > start:
                    if bad and stretch(raw, start, stop, 1) in bad:
                        ids = self.by_library([raw])
                        break
                    ids.append(self.words.young[raw[start:stop]])
            out.append(b"".join(ids))
        return out

    def widened(self, raw: bytes, start: int, stop: int) -> bool:
        """Whether some wider stretch agrees with its words one by one; the widest is the whole text."""
        wide = 2
        while True:
            s = stretch(raw, start, stop, wide)
            self.learn(chain.from_iterable(s))
            if self.of_words(chain.from_iterable(s)) == self.by_library([b" ".join(chain.from_iterable(s))])[0]:
                return True
            if len(s[0]) < wide and len(s[2]) < wide:
                return False
            wide *= 2

    def ids_all(self, texts: list[str], chunked: bool = True, at_once: int = 1 << 20) -> list[np.ndarray]:
        """The ids of all texts, about a megabyte of them together; without chunks word by word."""
        out, part, size = [], [], 0
        for k, raw in enumerate(t.encode() for t in texts):
            part.append(raw)
            size += len(raw)
            if size >= at_once or k == len(texts) - 1:
                if chunked:
                    out += [np.frombuffer(x, self.kind) for x in self.encode_part(part)]
                else:
                    self.words.turn()
                    out += self.plain.encode(part)
                part, size = [], 0
        return out

    def piece(self, ids: np.ndarray) -> Piece:
        """Number of tokens, decimal ids joined by a space, decoded text."""
        each = ids.tolist()
        return len(each), " ".join(map(self.decimals.__getitem__, each)), " ".join(map(self.tokens.__getitem__, each))

    def encode(self, text: str) -> Piece:
        return self.piece(self.ids_all([text])[0])


def pieces(raw: bytes, at: list[int]) -> list[tuple[int, int, int, int]]:
    """Chunk (start, stop) and the join's word behind it (start, stop; empty if there is none) of each piece of raw."""
    out, begin = [], 0
    for cut in at:
        if cut < begin or cut >= len(raw):
            continue
        start, stop = word_around(raw, cut, begin)
        out.append((begin, start, start, stop))
        begin = stop
    out.append((begin, len(raw), len(raw), len(raw)))
    return out


def stretch(raw: bytes, start: int, stop: int, wide: int) -> tuple[tuple[bytes, ...], tuple[bytes, ...], tuple[bytes, ...]]:
    """Up to `wide` whole words before raw[start:stop], the word itself, and up to `wide` behind it."""
    reach = 64 * wide
    left, right = raw[max(0, start - reach) : start].split(), raw[stop : stop + reach].split()
    if start > reach and len(left) <= wide:  # a word that may be cut off, or too few
        left = raw[:start].split()
    if stop + reach < len(raw) and len(right) <= wide:
        right = raw[stop:].split()
    return tuple(left[-wide:]), (raw[start:stop],), tuple(right[:wide])


def plain_form(core: bytes) -> bytes | None:
    """The lower-case form of a word that has only Latin letters; null for any other. Below U+0250 nothing else happens to a letter in normalisation."""
    if core.isalpha():  # ASCII letters only
        return core.lower()
    text = core.decode()
    if not text.isalpha() or max(text) >= "ɐ":
        return None
    low = text.lower()
    return low.encode() if len(low) == len(text) and low.isalpha() and max(low) < "ɐ" else None


def merges_of(path: str, library) -> Merges | None:
    """Merges for plain words, if the vocabulary is of the kind that they are for and agrees on probes."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    normal, model = json.dumps(whole.get("normalizer")), whole["model"]
    if "Lowercase" not in normal or "ByteLevel" not in json.dumps(whole.get("pre_tokenizer")) or not model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    found = Merges(path, model["end_of_word_suffix"])
    probes = [b"the", b"internationalisation", "déjà".encode(), "ñandú".encode(), "straße".encode(), b"a", b"zzzzzzzz"]
    kind = np.dtype("<u4")
    return found if found.tokens(probes, kind) == [np.array(library.encode(w.decode(), add_special_tokens=False).ids, kind).tobytes() for w in probes] else None


def word_around(raw: bytes, cut: int, least: int) -> tuple[int, int]:
    """Start and end of the word that the cut falls into; both the cut if that is white space."""
    start = max(least, max(raw.rfind(bytes([s]), max(least, cut - 256), cut) for s in _SPACES) + 1)
    if start == least and cut - 256 > least:  # a huge word
        start = max(least, max(raw.rfind(bytes([s]), least, cut) for s in _SPACES) + 1)
    ends = [e for s in _SPACES if (e := raw.find(bytes([s]), cut, cut + 256)) >= 0]
    if not ends:
        ends = [e for s in _SPACES if (e := raw.find(bytes([s]), cut)) >= 0]
    return start, min(ends, default=len(raw))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The Python worker's codec."""
    return Codec(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession, rows=500, size=2 << 20)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row of docs."""

    def run(batches):
        for batch in batches:
            known = codec(vocabulary)
            each = known.ids_all([t or "" for t in batch.column("text").to_pylist()])
            yield {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) for x in each], "ids": each, "decoded": [" ".join(map(known.tokens.__getitem__, x.tolist())) for x in each]}

    return arrow_map(_rows(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: digests of what `bpe` returns, taken where it is made."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        for batch in batches:
            known = codec(vocabulary)
            each = [known.piece(x) for x in known.ids_all([t or "" for t in batch.column("text").to_pylist()])]
            yield {"doc_id": batch.column("doc_id"), "n_tokens": [e[0] for e in each], "ids_sha256": [sha(e[1]) for e in each], "decoded_sha256": [sha(e[2]) for e in each]}

    return arrow_map(_rows(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
