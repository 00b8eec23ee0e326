import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tallyframe.llm import boosted_toxicity, line_crf
from tallyframe.llm.text import chunks
from tests.llm.cases import documents, empty, frame, words

LABELS = "doc_id long, quality int, toxic int, score double"


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, 0.5) for i, q, t in rows], LABELS)


def base_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    repeated = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)} if len(w) < 3000 else set()
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(lines)


def test_base_counts(spark):
    rng = random.Random(3)
    rows = [(d, t) for d, t in documents() if d != 400]
    rows += [(600 + i, "".join(rng.choices(["a", "b", " ", "\n", "\t", "é", "#", "|", "\x0b", " "], k=rng.randrange(80)))) for i in range(60)]
    rows += [(700, "a b c d e f\na b c d e f\n\n\na b c d e f "), (701, "x " * 50)]
    got = line_crf.quality(frame(spark, rows), labels(spark, [])).collect()
    want = []
    for d, t in rows:
        n, chars, symbols, equal, repeated, lines = base_of(t)
        failed = n < 10 or 100 * repeated > 20 * n
        want.append((d, n, chars, symbols, equal, repeated, failed, lines, 1.0 if lines else 0.0, not failed))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert line_crf.quality(empty(spark), labels(spark, [])).count() == 0


def field(rng, lengths):
    first = np.concatenate([[0], np.cumsum(lengths)])
    lines = line_crf.Lines(first, np.ones(first[-1], np.int64), rng.normal(size=(first[-1], 4)).astype(np.float32))
    return lines, line_crf.LineField(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))


def test_viterbi_agrees_with_all_labellings():
    lines, model = field(np.random.default_rng(1), [3, 0, 6, 1, 5])
    got = model.decode(lines)
    emit = lines.features @ model.weights
    for a, b in zip(lines.first[:-1], lines.first[1:], strict=True):
        score = lambda y, a=a: sum(emit[a + i, k] for i, k in enumerate(y)) + sum(model.steps[p, q] for p, q in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=b - a), key=score)
        assert tuple(got[a:b]) == best


def test_fit_recovers_labels():
    rng = np.random.default_rng(2)
    lines, model = field(rng, [8] * 60)
    truth = model.decode(lines).astype(np.int64)
    fitted = line_crf.LineField.fit(lines, truth, rounds=150, penalty=1e-4)
    assert (fitted.decode(lines) == truth).mean() > 0.95


def test_quality_follows_the_labels(spark):
    rng = random.Random(1)
    good = [(i, "\n".join(" ".join(words(rng, 14, 9000)) + "." for _ in range(5))) for i in range(80)]
    bad = [(1000 + i, "\n".join("### " + " | ".join(w.upper() for w in words(rng, 5, 9000)) for _ in range(6))) for i in range(80)]
    marks = labels(spark, [(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in bad[:40]] + [(None, 1, 1), (9999, 0, 0), (3, None, None)])
    got = {r.doc_id: r.kept for r in line_crf.quality(frame(spark, good + bad), marks).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def mixed_rows():
    rng = random.Random(6)
    prose = lambda: " ".join(words(rng, 14, 9000)) + "."
    table = lambda: "### " + " | ".join(w.upper() for w in words(rng, 6, 9000))
    good = [(i, "\n".join([prose() for _ in range(6)] + [table() for _ in range(i % 3)])) for i in range(90)]
    bad = [(1000 + i, "\n".join([prose() for _ in range(i % 3)] + [table() for _ in range(6)])) for i in range(90)]
    return good, bad


def test_lines_of_mixed_documents_are_told_apart(spark):
    good, bad = mixed_rows()
    marks = labels(spark, [(i, 1, 0) for i, _ in good[:45]] + [(i, 0, 0) for i, _ in bad[:45]])
    got = {r.doc_id: r for r in line_crf.quality(frame(spark, good + bad), marks).collect()}
    for d, text in good + bad:
        lines = text.split("\n")
        size = lambda x: len(x.replace(" ", ""))
        content = sum(size(x) for x in lines if not x.startswith("###"))
        assert got[d].content_share == content / sum(map(size, lines)) and got[d].kept == (d < 1000)


def test_shares_agree_with_all_labellings(spark):
    good, bad = mixed_rows()
    docs, marks = frame(spark, good + bad), labels(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad])
    model = line_crf.fit_field(docs, marks, "doc_id", "text", 40, 500, 4)
    got = {r.doc_id: r for r in line_crf.quality(docs, marks, sample_docs=40, sample_lines=500, sample_doc_lines=4).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in good + bad]), pa.array([t for _, t in good + bad])], ["doc_id", "text"])
    for chunk in chunks([batch]):
        _, lines = line_crf.measure(chunk)
        emit = lines.features @ model.weights
        for d, a, b in zip(chunk.ids.to_pylist(), lines.first[:-1], lines.first[1:], strict=True):
            score = lambda y, a=a: sum(emit[a + i, k] for i, k in enumerate(y)) + sum(model.steps[p, q] for p, q in itertools.pairwise(y))
            best = max(itertools.product((0, 1), repeat=b - a), key=score)
            share = sum(c for c, y in zip(lines.chars[a:b], best, strict=True) if y) / sum(lines.chars[a:b])
            assert got[d].content_share == share and got[d].kept == (not got[d].base_failed and share >= 0.5)


def test_line_labels_keep_to_their_documents():
    rng = np.random.default_rng(8)
    lengths = [4, 1, 7, 0, 3, 5]
    first = np.concatenate([[0], np.cumsum(lengths)])
    lines = line_crf.Lines(first, rng.integers(1, 50, first[-1]), np.zeros((first[-1], 1), np.float32))
    quality = np.array([1, 0, 0, 1, 1, 0])
    evidence = rng.normal(size=first[-1])
    got = line_crf.line_labels(lines, quality, evidence)
    for q, a, b in zip(quality, first[:-1], first[1:], strict=True):
        order = sorted(range(a, b), key=lambda i: -evidence[i] if q else evidence[i])
        held, half = 0, sum(lines.chars[a:b]) / 2
        for i in order:
            assert got[i] == (q if held <= half else evidence[i] > 0)
            held += lines.chars[i]


def toxic_rows():
    rng = random.Random(9)
    clean = [(i, " ".join(words(rng, 40, 3000))) for i in range(400)]
    toxic = []
    for i in range(200):
        w = words(rng, 40, 3000)
        for _ in range(3):
            w[rng.randrange(40)] = rng.choice(["badword", "nastyone", "horridest", "horrid"])
        toxic.append((5000 + i, " ".join(w)))
    return clean, toxic


def test_toxicity_on_held_out_rows(spark):
    clean, toxic = toxic_rows()
    marks = labels(spark, [(i, 1, 0) for i, _ in clean[:300]] + [(i, 1, 1) for i, _ in toxic[:150]] + [(None, 1, 1), (3, None, None), (99999, 1, 1)])
    docs = frame(spark, clean + toxic + documents())
    got = boosted_toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(clean) + len(toxic) + len(documents())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert sum(by[i] for i, _ in toxic[150:]) >= 47 and sum(by[i] for i, _ in clean[300:]) <= 2
    left = boosted_toxicity.drop_toxic(docs, marks)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    clean, toxic = toxic_rows()
    rows = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in rows]
    docs = frame(spark, clean + toxic)
    first, second = ({r.doc_id: r.score for r in boosted_toxicity.toxicity(docs, labels(spark, x)).collect()} for x in (rows, flipped))
    assert first == second


def test_no_labels_and_no_rows(spark):
    assert {r.score for r in boosted_toxicity.toxicity(frame(spark), labels(spark, [])).collect()} == {0.0}
    assert boosted_toxicity.toxicity(empty(spark), labels(spark, [])).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(5)
    raw = rng.normal(size=500).round(1)
    y = (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(int)
    x, p = boosted_toxicity.isotonic(raw, y, np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all()
    assert abs(np.interp(raw, x, p).mean() - y.mean()) < 1e-9


def test_second_person_proximity():
    texts = ["you are an idiot", "the idiot " + "x " * 30 + "you", "nothing"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["i", "t"])
    none = (np.zeros(0, np.uint64), np.zeros(0))
    x = boosted_toxicity.features_of(next(chunks(iter([batch]))), none, none)
    near = x[:, boosted_toxicity.FEATURES.index("near second person")]
    assert near[0] > 0 and near[1] == 0 and near[2] == 0
