import random

import pytest

import corpus_pipeline
from tallyframe.llm import queries, store
from tests.llm.cases import words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels, benchmark and pages with planted cases."""
    rng = random.Random(11)
    top = tmp_path_factory.mktemp("tables")
    docs = [(i, " ".join(words(rng, 60, 5000)), "en", f"s{0 if i % 20 else i % 3}") for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " tail", "en", "s0") for i in range(20)]
    docs += [(2000 + i, docs[40 + i][1], "de", "s1") for i in range(20)]
    items = [(i, " ".join(words(rng, 25, 5000))) for i in range(5)]
    docs += [(3000 + i, " ".join(words(rng, 20)) + " " + items[i % 5][1], "en", "s2") for i in range(15)]
    docs += [(4000 + i, " ".join(words(rng, 30, 5000)) + " vilest vilest " + " ".join(words(rng, 9)), "en", "s0") for i in range(80)]
    docs += [(5000, None, None, None), (5001, "", "en", "s1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    marks = [(i, 1, 0) for i in range(250)] + [(4000 + i, 1, 1) for i in range(70)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, "u", "x" * (i % 7)) for i in range(50)], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return str(top)


def test_every_stage_takes_effect(spark, folder):
    docs = queries.table(spark, folder, "documents")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = store.cut(stage(spark, docs, folder))
        if name != "sharding":
            assert docs.columns == columns
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = {*range(300), *range(1000, 1020), *range(2000, 2020), *range(3000, 3015), *range(4000, 4080), 5000, 5001}
    toxic = every - left[0]
    assert toxic <= set(range(4000, 4080)) and len(toxic) >= 76
    assert left[0] - left[1] == {*range(1000, 1020), *range(2000, 2020)}
    assert left[1] - left[2] == set(range(3000, 3015))
    assert left[3] < left[2] and len(left[3]) > 0.5 * len(left[2])
    assert left[4] == left[3]


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert got and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, folder, name):
    if name == "op4_tokens":
        pytest.importorskip("sentencepiece")
    n = queries.QUERIES[name](spark, folder).count()
    rows = queries.table(spark, folder, "pages" if name == "op7_warc" else "documents").count()
    assert n == (15 if name == "op5_decontamination" else rows)
