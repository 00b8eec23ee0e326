"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

Words are split greedily: the longest vocabulary piece at the start (of the pieces
that begin a word), then the longest continuing piece, and so on. Where no piece
begins a word but the bare word start is a piece, that is the first piece and the word
goes on with continuing pieces; a character without a piece falls back to the pieces
of its bytes, if the vocabulary has them. A word that still can't be covered is one
unknown token. The trie of the vocabulary gets failure
links: f(v) is where matching goes on after the longest pieces of v's string have
been popped, and the number of popped pieces is precomputed, so a word's length in
pieces is found in one pass over its bytes, without building a piece.

Counts depend on the word only, hence each worker runs the automaton once per
distinct word of a chunk and keeps a bounded table of word hash to count.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import chunks, spans, word_hashes

SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"
START = "▁".encode()
CACHE_WORDS = 400_000


class Automaton:
    """Trie over bytes with failure links and popped-piece counts.

    ``begin`` pieces start a word and ``inside`` pieces continue one; with ``bare``, the
    word start alone is a piece too. Node 0 is the root of ``begin``, node 1 that of
    ``inside``; fail is -1 where nothing can be popped.
    """

    def __init__(self, begin: list[bytes], inside: list[bytes], bare: bool = False):
        self.next: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for piece in pieces:
                node = root
                for b in piece:
                    to = self.next[node].get(b)
                    if to is None:
                        to = len(self.next)
                        self.next.append({})
                        final.append(False)
                        self.next[node][b] = to
                    node = to
                if piece:
                    final[node] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        if bare:
            self.fail[0], self.popped[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for b, to in self.next[node].items():
                if final[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    at, n = self.fail[node], self.popped[node]
                    while at != -1 and b not in self.next[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at != -1:
                        self.fail[to], self.popped[to] = self.next[at][b], n
                queue.append(to)

    def count(self, word: bytes) -> int:
        """Pieces of the word, or -1 if it can't be covered."""
        step, fail, popped, at, n = self.next, self.fail, self.popped, 0, 0
        for b in word:
            to = step[at].get(b)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at == -1:
                    return -1
                to = step[at].get(b)
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at == -1:
                return -1
        return n


def load_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-starting and continuing pieces of a sentencepiece model file, without byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, inside = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).encode()
        (begin if piece.startswith(START) else inside).append(piece.removeprefix(START))
    return begin, inside


def load_vocabulary(path: str) -> tuple[list[bytes], list[bytes], bool]:
    """All pieces of the file for an automaton: byte pieces (``<0xE2>``) continue a word; whether the bare word start is a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, inside = load_pieces(path)
    single = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) for i in range(model.get_piece_size()) if model.is_byte(i)]
    return begin, inside + single, b"" in begin


def count_tokens(docs: DataFrame, vocabulary: tuple, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens (pieces; an uncoverable word is 1) and n_unknown (such words).

    Null and empty texts have no words and no tokens. Null ids and repeated rows are
    rows like others. An empty table gives no rows. The vocabulary (the arguments of
    ``Automaton``) is what the driver loaded from a file of fixed size; it is broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        automaton, known = Automaton(*shared.value), {}
        for chunk in chunks(batches):
            starts, ends, woff = spans(chunk.buf, chunk.off)
            hashes, first, inverse = np.unique(word_hashes(chunk.buf, starts, ends, fold=False), return_index=True, return_inverse=True)
            data = chunk.buf.tobytes()
            if len(known) > CACHE_WORDS:
                known.clear()
            counts = np.empty(len(hashes), np.int64)
            for i, (h, a, b) in enumerate(zip(hashes.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
                n = known.get(h)
                if n is None:
                    n = known[h] = automaton.count(data[a:b])
                counts[i] = n
            unknown = counts < 0
            totals = [np.concatenate([[0], np.cumsum(x[inverse])])[woff] for x in (np.where(unknown, 1, counts), unknown.astype(np.int64))]
            columns = [chunk.ids, *(pa.array(np.diff(x).astype(np.int64)) for x in (woff, *totals))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
