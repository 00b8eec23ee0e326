import random
import re
from pathlib import Path

import pytest

from tallyframe.llm import piece_counts as op
from tallyframe.llm.queries import PIECES
from tests.llm.cases import documents, empty, frame


def greedy(word, begin, inside):
    at, n = 0, 0
    while at < len(word):
        pieces = begin if at == 0 else inside
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_automaton_agrees_with_greedy_matching():
    rng = random.Random(6)
    for _ in range(60):
        piece = lambda: bytes(rng.choices(b"abc", k=rng.randrange(1, 5)))  # noqa: E731, B023
        begin, inside = ({piece() for _ in range(rng.randrange(1, 12))} for _ in range(2))
        automaton = op.Automaton(sorted(begin), sorted(inside))
        for _ in range(200):
            word = bytes(rng.choices(b"abcd", weights=[9, 9, 9, 1], k=rng.randrange(1, 12)))
            assert automaton.count(word) == greedy(word, begin, inside), (begin, inside, word)


def test_documents(spark):
    begin, inside = [b"w", b"w1", b"x", b"a", b"row"], [b"%d" % i for i in range(30)] + ["é".encode()]
    rows = documents()
    got = op.count_tokens(frame(spark, rows), (begin, inside)).collect()
    want = []
    for d, t in rows:
        counts = [greedy(w.encode(), set(begin), set(inside)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        want.append((d, len(counts), sum(max(c, 1) for c in counts), sum(c < 0 for c in counts)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert op.count_tokens(empty(spark), (begin, inside)).count() == 0


@pytest.mark.skipif(not Path(PIECES).exists(), reason="no vocabulary file here")
def test_a_public_vocabulary():
    begin, inside = op.load_pieces(PIECES)
    automaton = op.Automaton(begin, inside)
    b, i = set(begin), set(inside)
    for word in ("the", "unbelievable", "Größenwahn", "l'été", "x" * 50, "日本語", "á"):
        assert automaton.count(word.encode()) == greedy(word.encode(), b, i)


def test_a_bare_word_start_is_a_piece():
    rng = random.Random(7)
    for _ in range(60):
        piece = lambda: bytes(rng.choices(b"abc", k=rng.randrange(1, 5)))  # noqa: E731, B023
        begin, inside = ({piece() for _ in range(rng.randrange(1, 12))} for _ in range(2))
        automaton = op.Automaton(sorted(begin), sorted(inside), True)
        for _ in range(200):
            word = bytes(rng.choices(b"abcd", weights=[9, 9, 9, 1], k=rng.randrange(1, 12)))
            first = max((n for n in range(1, len(word) + 1) if word[:n] in begin), default=0)
            rest = greedy(b"!" + word[first:], {b"!"}, inside)
            assert automaton.count(word) == rest, (begin, inside, word)


@pytest.mark.skipif(not Path(PIECES).exists(), reason="no vocabulary file here")
def test_a_public_vocabulary_covers_every_word():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    size = range(model.get_piece_size())
    pieces = {model.id_to_piece(i) for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    assert "\u2581" in pieces and sum(model.is_byte(i) for i in size) == 256

    def by_characters(word):
        word, at, n = "\u2581" + word, 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
            n += 1 if end else len(word[at].encode())  # no piece: one for each byte
            at = end or at + 1
        return n

    automaton = op.Automaton(*op.load_vocabulary(PIECES))
    rng = random.Random(8)
    alphabet = "abcdeXYZ019.,-ñçêßüλδЖ中文字符日本語한국\U0001f600\U00013000\ufffd\u0301"
    words = ["ñandú", "Größe", "être", "ß", "中文没有空格的段落", "\U00013000", "a\U00013000b", *("".join(rng.choices(alphabet, k=rng.randrange(1, 15))) for _ in range(3000))]
    for word in words:
        assert automaton.count(word.encode()) == by_characters(word), word
