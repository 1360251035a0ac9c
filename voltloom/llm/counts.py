"""Token counts under a unigram vocabulary, without the tokens.

Every distinct unit of the corpus is counted once (voltloom.llm.distinct): an Aho-Corasick
automaton finds the vocabulary pieces that end at each character, and dynamic programming carries
the best score and its number of pieces. Ties are the tokenizer's: matches are tried from the
earliest start on and replace the best only if they score strictly more, so the longer piece stays.
A character that no piece covers counts as its UTF-8 bytes (byte fallback), each at `below` less
than the lowest score.

With `white`, texts are taken whole as the model file takes them: a space in front of every text
that is not empty, spaces as the mark U+2581, other white space as it is (its bytes, where no piece has
it). They are cut only where no piece of the file can cross, so the counts are those of whole texts.
Without it, white space is dropped: the units are runs of other than white space, each with the
mark before it, and blank texts have no tokens. Null and empty texts never have any; rows that
repeat a key are counted each; null keys stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from voltloom.llm.distinct import assemble, once_per_word, staged_blocks
from voltloom.llm.kept import once_per_worker
from voltloom.llm.spans import Coded, coded, flat, words

VOCABULARY, MARK, BELOW = "piece_bpe_32k.model", "▁", 10.0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@once_per_worker
def pieces(path: str) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece model and their scores."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}


@once_per_worker
def automaton(path: str):
    import ahocorasick

    found = ahocorasick.Automaton()
    for piece, score in pieces(path).items():
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    return found


def count(word: str, found, low: float) -> int:
    """Pieces of the best split of one word."""
    n = len(word)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for at, (size, score) in found.iter(word):
        ends[at].append((size, score))
    best, number = [0.0] * (n + 1), [0] * (n + 1)
    for at in range(n):
        top, many = -math.inf, 0
        for size, score in sorted(ends[at], reverse=True):  # the earliest start first
            start = at + 1 - size
            if best[start] + score > top:
                top, many = best[start] + score, number[start] + 1
        width = len(word[at].encode())
        if not any(size == 1 for size, _ in ends[at]) and best[at] + low * width > top:
            top, many = best[at] + low * width, number[at] + width
        best[at + 1], number[at + 1] = top, many
    return number[n]


@once_per_worker
def cuts(path: str) -> tuple[bool, bytes]:
    """Whether no piece has a mark behind another character, and the white space that no longer piece holds."""
    several = [p for p in pieces(path) if len(p) > 1]
    return not any(MARK in p.lstrip(MARK) for p in several), "".join(c for c in "\t\n\v\f\r" if not any(c in p for p in several)).encode()


def white_units(column: pa.Array, path: str) -> Coded:
    """Texts with a space in front, cut before marks and around white space of its own."""
    before_marks, alone = cuts(path)
    column = pc.fill_null(column, "")
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", column.type), column, pa.scalar(" ", column.type)))
    data, off = flat(column)
    cut, own = np.zeros(len(data), bool), np.isin(data, np.frombuffer(alone, np.uint8))
    cut[1:] = own[1:] != own[:-1]
    if before_marks and len(data):
        mark = data == 0x20
        written = np.zeros(len(data), bool)  # the last byte of a mark that the text itself holds
        written[2:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        cut[1:] |= mark[1:] & ~mark[:-1] & ~written[:-1]
    cut[off[:-1][np.diff(off) > 0]] = True
    begins = np.flatnonzero(cut)
    codes, distinct = coded(data, np.concatenate((begins, [len(data)])))
    return Coded(codes, np.searchsorted(begins, off), distinct)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, white: bool = False) -> DataFrame:
    """key and n_tokens of every row."""
    path = path or vocabulary_path()

    def work(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found, low = automaton(path), min(pieces(path).values(), default=0.0) - BELOW
        marked = (w.decode().replace(" ", MARK) if white else MARK + w.decode() for w in batch)
        return np.fromiter((count(w, found, low) for w in marked), np.uint32, len(batch)), np.ones(len(batch), np.int64)

    def finish(keys: pa.Array, out: np.ndarray, counts: np.ndarray) -> pa.Table:
        ends = np.concatenate(([0], np.cumsum(counts)))
        sums = np.concatenate(([0], np.cumsum(out, dtype=np.int64)))
        return pa.table({key: keys, "n_tokens": pa.array(np.diff(sums[ends]), pa.int64())})

    doc_rows, word_rows = staged_blocks(docs, key, text, (lambda c: white_units(c, path)) if white else words)
    return assemble(doc_rows, once_per_word(word_rows, work), finish, f"{key} bigint, n_tokens bigint")
