"""The stages of the pipeline on a small table, against what each is meant to do."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from perfattr.llm.common import scratch


@pytest.fixture(scope="module")
def tables(spark):
    """Clean texts, junk, copies, near copies, a common line and passages of a benchmark."""
    draw = random.Random(11)

    def prose(n):
        return " ".join(f"{draw.choice('bcdfgklm')}{draw.choice(['ano', 'eli', 'ura', 'ito'])}{k % 7}" for k in range(n))

    passage = " ".join(f"probe{k}" for k in range(14))
    common = "This common line stands at the head of many of the documents."
    docs = []
    for k in range(60):
        lines = [prose(draw.randint(30, 60)) for _ in range(3)]
        docs.append([k, "\n".join([common, *lines] if k % 3 == 0 else lines)])
    for k in range(60, 70):
        docs.append([k, " ".join(x + "&&&" for x in prose(40).split())])
    for k in range(70, 75):
        docs.append([k, docs[k - 70][1]])
    for k in range(75, 80):
        docs.append([k, docs[k - 60][1].replace("\n", " extra\n", 1)])
    docs[20][1] += "\n" + passage
    folder = scratch(spark, "tables")
    rows = [(k, t, "en", "src", len(t)) for k, t in docs] + [(90, None, None, None, None), (91, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(not 60 <= k < 70), 0) for k in range(0, 80, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}, common, passage


def test_stages(spark, tables):
    folder, texts, common, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, found = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
            found[name] = {r.doc_id: r.text for r in docs.collect()}
    good = set(texts) - set(range(60, 70)) - {90, 91}
    assert set(found["quality classifier"]) == good
    lines = found["line dedup"]
    assert set(lines) == good and sum(common in t for t in lines.values()) < sum(common in texts[k] for k in good) / 2
    assert lines[0].startswith(common) and lines[1] == texts[1]
    kept = found["MinHash near-dedup"]
    assert set(kept) == set(range(60)) and all(kept[k] == lines[k] for k in kept)
    clean = found["benchmark decontamination"]
    assert set(clean) == set(kept) and passage not in clean[20] and "probe" not in clean[20]
    assert all(clean[k] == kept[k] for k in clean if k != 20)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    packed = sorted(docs.collect(), key=lambda r: (r.doc_id, r.piece))
    assert {r.doc_id for r in packed} == set(clean)
    for r in packed:
        ids = tokenizer.encode(clean[r.doc_id], add_special_tokens=False).ids + [1]
        own = memoryview(bytes(r.ids)).cast("I").tolist()
        assert own == ids[r.start : r.start + r.length]


def test_run_gives_the_last_stage(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    assert {r.doc_id for r in rows} == set(range(60))
