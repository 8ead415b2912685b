"""Each stage of the pipeline on what the stage before it kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import brute_classes, brute_contamination, brute_repeats, docs_of, sentence

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in out[name][1].select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [i for i in out["quality"][0] if i in labels]
    assert sum((i in ids("quality")) == (labels[i] == 1) for i in known) >= 0.95 * len(known)
    before, _ = out["near_duplicates"]
    assert ids("near_duplicates") == set(brute_classes(list(before.items())).values())
    before, _ = out["repeats"]
    want = brute_repeats(list(before.items()))
    after = {r["doc_id"]: r["text"] for r in out["repeats"][1].collect()}
    assert set(after) == set(want)
    assert all(after[i] == before[i] for i, w in want.items() if w[1] == 0)
    assert all(len(after[i].encode()) <= w[0] - w[1] for i, w in want.items())
    before, _ = out["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own, whole = (brute_contamination(((i, texts[i]) for i in before), items) for texts in (before, source))
    assert ids("decontamination") == {i for i in before if not own[i][4] and not whole[i][4]}
    assert ids("packing") == ids("decontamination")


def tables(spark, folder, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(17)
    good = [sentence(rng, 60).capitalize() + "." for _ in range(40)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, 60).split()) for _ in range(40)]
    passage = sentence(rng, 40)
    more = [good[0] + " " + passage, good[1] + " and " + passage, good[2], None, "", good[3], good[4]]
    texts, ids = [*good, *bad, *more], [*range(80), 100, 101, 102, 103, 104, 3, None]
    docs = docs_of(spark, texts, ids)
    extra = {c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in ("_score", "_hits", "_b", "_n_bytes", "rep", "label")}
    docs = docs.withColumns(extra)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    folder, seen = tables(spark, tmp_path, docs, labels, bench), {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == columns
            rows = docs.collect()
            assert all(r[c] == c + ("" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in extra)
            seen[name] = [r["doc_id"] for r in rows]
    assert not {i for i in seen["quality"] if i is not None and 40 <= i < 80}
    assert sorted(i for i in seen["near_duplicates"] if i is not None) == sorted(set(seen["near_duplicates"]) - {None})
    assert 102 not in seen["near_duplicates"] and {0, 3} <= set(seen["near_duplicates"])
    assert sorted(seen["repeats"], key=str) == sorted(seen["near_duplicates"], key=str)
    # both documents of the passage go, the second although its passage was cut before
    assert {100, 101} <= set(seen["repeats"]) and not {100, 101} & set(seen["decontamination"])
    assert {r["doc_id"] for r in docs.collect()} == set(seen["decontamination"])


def test_no_documents(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    folder = tables(spark, tmp_path, docs_of(spark, []), labels, bench)
    assert corpus_pipeline.run(spark, folder).count() == 0
