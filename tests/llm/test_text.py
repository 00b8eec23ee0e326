import random
import re

import numpy as np
import pyarrow as pa

from tallyframe.llm.text import chunks, sequence_hash, spans, word_hashes

PIECES = ["a", "B", "é", " ", "\t", "\n", "\x0b", " ", " ", "Zz", "."]


def test_words_agree_with_the_pattern_and_hashes_with_folded_words():
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(30))) for _ in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "t"])
    seen: dict[str, int] = {}
    got = 0
    for chunk in chunks(iter([batch.slice(3)]), 64):
        starts, ends, woff = spans(chunk.buf, chunk.off)
        hashes = word_hashes(chunk.buf, starts, ends)
        for d, i in enumerate(chunk.ids.to_pylist()):
            text = (texts[i] or "").translate({k: k + 32 for k in range(65, 91)})
            expected = re.findall(r"[^\x20\x09-\x0D]+", text)
            own = hashes[woff[d] : woff[d + 1]].tolist()
            assert len(own) == len(expected)
            for w, h in zip(expected, own, strict=True):
                assert seen.setdefault(w, h) == h
            got += 1
    assert got == len(texts) - 3
    assert len(set(seen.values())) == len(seen)


def test_sequences_depend_on_order_and_length():
    w = np.array([1, 2, 3, 1, 2], np.uint64)
    h = sequence_hash(w, 2)
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    assert len(sequence_hash(w, 6)) == 0
