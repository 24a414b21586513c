"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than `chunk_chars` code points is encoded in overlapping chunks.
Each chunk gives its pieces with offsets into the document. Two neighbouring
chunks are spliced at a boundary that both have and that is proven stable: a
space between two other characters, where no piece of the vocabulary holds the
space mark behind another character, so that no merge can reach across and the
encoder adds its own mark to a chunk that starts behind the space. If the
overlap has no such boundary on which the two agree, it is widened, in the end
to the rest of the document.

Null texts count as empty. Repeated rows, null ids and further columns do no harm:
each row is counted for itself, and other columns aren't read.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches

MARK = "▁"


@lru_cache(maxsize=4)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def spaces_are_stable(path: str) -> bool:
    """Whether no piece has the space mark behind another character, and text passes the normaliser unchanged but for the mark."""
    processor = _processor(path)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        return False
    probe = "a  bé ﬁÅ\tc\n d "
    return processor.decode(processor.encode(probe)) == probe


def _stable(text: str, at: int) -> bool:
    """Whether text[at] is a single plain space between two characters that are no space or mark."""
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1] not in (" ", MARK) and text[at + 1] not in (" ", MARK)


def _ends(processor, text: str, at: int) -> dict[int, int]:
    """Where pieces of text end, in code points counted from `at`, with the number of pieces up to there."""
    ends: dict[int, int] = {}
    for k, piece in enumerate(processor.encode(text, return_type="proto").pieces):
        at += len(piece.surface)
        ends.setdefault(at, k + 1)  # the first bytes of a character have no surface yet
    return ends


def count_huge(processor, text: str, chunk: int, overlap: int) -> int:
    """Pieces of text, by chunks of about `chunk` code points that overlap by about `overlap`."""
    total, start, n = 0, 0, len(text)
    while True:
        if n - start <= chunk + overlap:
            return total + len(processor.encode(text[start:]))
        wide = overlap
        while True:
            # The chunk is text[start:stop]; the next one starts inside it, behind a stable space.
            stop = min(n, start + chunk + wide)
            if stop == n:
                return total + len(processor.encode(text[start:]))
            left = _ends(processor, text[start:stop], start)
            middle = stop - wide
            first = next((i for i in range(middle, stop - 1) if _stable(text, i)), None)
            cut = None
            if first is not None:
                right = _ends(processor, text[first + 1 : min(n, stop + wide)], first + 1)
                # Both must break at the same later space too: there the chunks agree beyond doubt.
                for i in range(first + 1, stop - 1):
                    if _stable(text, i) and i in left and i in right:
                        cut = i
                        break
            if cut is not None:
                break
            wide *= 2
        total += left[cut]
        start = cut + 1


def count_tokens(texts: list[str], path: str, chunk: int = 16_384, overlap: int = 512) -> list[int]:
    processor = _processor(path)
    huge = {i for i, t in enumerate(texts) if len(t) > 2 * chunk} if spaces_are_stable(path) else set()
    counts = [0] * len(texts)
    rest = [i for i in range(len(texts)) if i not in huge]
    for lo in range(0, len(rest), 256):
        part = rest[lo : lo + 256]
        for i, ids in zip(part, processor.encode([texts[i] for i in part], num_threads=1), strict=True):
            counts[i] = len(ids)
    for i in huge:
        counts[i] = count_huge(processor, texts[i], chunk, overlap)
    return counts


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row of docs, as the library counts the whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = count_tokens(texts, model)
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
