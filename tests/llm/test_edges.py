"""Clashing names, nulls, empty tables, repeated rows, very long texts, orders of rows: for each operator and stage."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, embed_dedup, near_dup, packing, quality, sharding, suffix_dedup, token_counts, toxicity, warc
from tests.llm.test_llm import brute_contamination, brute_repeats, docs_of, sentence

CLASH = ("_score", "_hits", "_items", "_n_words", "_id", "_b", "_text", "_kept", "_n_removed", "_SHA256", "__x", "shard", "slot", "size", "label", "part", "hub", "rep", "t")


def clashing(df):
    """df with columns named like the operators' own, each with a value that tells its row."""
    return df.select("*", *[F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])


def same_values(before, after):
    own = lambda df: Counter(tuple(r[c] for c in ("doc_id", *CLASH)) for r in df.collect())
    return after.columns == before.columns and not own(after) - own(before)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(77)
    good = [sentence(rng, 40).capitalize() + "." for _ in range(40)]
    bad = [" ".join(w.upper() + "!!" for w in sentence(rng, 40).split()) for _ in range(40)]
    passage = sentence(rng, 30)
    texts = [*good, *bad, good[0] + " " + passage, good[1] + " " + passage, good[2], None, ""]
    df = docs_of(spark, texts + [good[3], None], [*range(len(texts)), 3, None])
    labels = spark.createDataFrame([(i, int(i < 40), int(i >= 40)) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, passage), (None, good[5]), (2, None)], "item_id long, text string")
    return df, labels, bench


def test_stages_keep_the_values_of_columns_named_like_theirs(corpus):
    df, labels, bench = corpus
    df = clashing(df)
    for stage in (
        lambda d: quality.keep_good(d, labels), near_dup.drop_near_duplicates, suffix_dedup.drop_repeats,
        lambda d: decontaminate.drop_contaminated(d, bench), lambda d: decontaminate.drop_contaminated(d, bench, d),
    ):
        out = stage(df)
        assert out.count() > 40 and same_values(df, out)


def test_operators_replace_columns_named_like_their_results(corpus):
    df, labels, bench = corpus
    df = clashing(df)
    scored = quality.score_quality(df, quality.fit_quality(df, labels))
    assert sorted(scored.columns) == sorted(df.columns) and 0 <= scored.agg(F.min("_score")).first()[0]
    toxic = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels))
    assert sorted(toxic.columns) == sorted(df.columns) and toxic.agg(F.max("_score")).first()[0] <= 1
    cut = suffix_dedup.remove_repeats(df)
    assert [c for c in cut.columns if c.lower() == "_sha256"] == ["_sha256"] and cut.schema["_n_removed"].dataType.typeName() == "long"
    assert decontaminate.find_passages(df, bench).schema["_hits"].dataType.typeName() == "binary"
    assert token_counts.count_tokens(df).count() == packing.pack_documents(df).where("piece = 0").count() == df.count()
    assert sharding.shard_documents(df).count() == df.count()
    assert near_dup.near_duplicates(df).columns == ["doc_id", "class_id"]


def test_empty_tables(spark, corpus):
    df, labels, bench = corpus
    none, no_bench = df.limit(0), bench.limit(0)
    assert quality.keep_good(none, labels).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    scores = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels.limit(0)))
    assert scores.select("_score").distinct().collect()[0][0] == 0.5
    assert decontaminate.contamination(none, bench).count() == 0
    rows = decontaminate.contamination(df, no_bench).collect()
    assert len(rows) == df.count() and not any(r["n_hit"] or r["n_items"] or r["contaminated"] for r in rows)
    assert near_dup.drop_near_duplicates(none).count() == suffix_dedup.drop_repeats(none).count() == packing.pack_documents(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_duplicate_vectors(vectors).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(5)
    a, b = sentence(rng, 30), sentence(rng, 3000)
    ids, texts = [1, 1, 1, None, None, 2, None], [a, a, b, a, None, a, ""]
    df = docs_of(spark, texts, ids)
    pieces = packing.pack_documents(df).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(ids)
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    assert all(s != t or o + n == p for (s, o, n), (t, p, _) in zip(spots, spots[1:]))
    shards = sharding.shard_documents(df).collect()
    assert Counter(r["doc_id"] for r in shards) == Counter(ids) and len({(r["shard"], r["slot"]) for r in shards}) == len(ids)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(df, quality.fit_quality(df, labels)).count() == len(ids)
    scores = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels)).collect()
    assert len(scores) == len(ids) and len({r["_score"] for r in scores if r["text"] == a}) == 1
    rows = suffix_dedup.remove_repeats(df).collect()
    want = brute_repeats([(i if i is not None else 1 << 60, t) for i, t in zip(ids, texts)][3:])
    assert len(rows) == len(ids) and {r["_n_removed"] for r in rows if r["doc_id"] == 1} == {0}
    assert [r["_n_removed"] for r in rows if r["doc_id"] == 2] == [len(a)] and want
    # an item without an id hits words, but is no item
    bench = spark.createDataFrame([(None, a), ("null", a[:80]), ("null", sentence(rng, 20))], "item_id string, text string")
    found = decontaminate.contamination(df, bench).where("doc_id = 2").first()
    assert found["n_hit"] == 30 and found["n_items"] == 1 and found["items_sha256"] == hashlib.sha256(b"null").hexdigest()


def test_a_very_long_text(spark):
    rng = random.Random(6)
    long = sentence(rng, 700_000, 5000)
    part = long[2_000_000:2_000_400]
    rows = [(1, part), (2, long), (3, "x" * 3_000_000)]
    df = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    cut = {r["doc_id"]: (r["_n_bytes"], r["_n_removed"], r["_n_spans"]) for r in suffix_dedup.remove_repeats(df, keep_text=False).collect()}
    assert cut == {1: (400, 0, 0), 2: (len(long), 400, 1), 3: (3_000_000, 0, 0)}
    assert {r[0]: r[1] for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3}
    bench = spark.createDataFrame([(7, part)], "item_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_items"]) for r in decontaminate.contamination(df, bench).collect()}
    assert found[2] == (700_000, 1) and found[3] == (1, 0)
    scores = toxicity.score_toxicity(df, toxicity.Scorer(["scum"])).collect()
    assert all(r["_score"] == 0.5 for r in scores)
    assert quality.score_quality(df, None).where("_score = 0.5").count() == 3


def test_models_do_not_depend_on_order_or_files(spark, corpus, tmp_path):
    df, labels, _ = corpus
    df.repartition(7).write.parquet(str(tmp_path / "a"))
    df.orderBy(F.desc("doc_id")).coalesce(1).write.parquet(str(tmp_path / "b"))
    models, scorers = [], []
    for name in "ab":
        docs = spark.read.parquet(str(tmp_path / name))
        models.append(quality.fit_quality(docs, labels))
        scorers.append(toxicity.fit_toxicity(docs, labels).weights)
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1]
    assert np.array_equal(*scorers)
    scored = [{(r["doc_id"], r["text"], r["_score"]) for r in quality.score_quality(spark.read.parquet(str(tmp_path / n)), models[0]).collect()} for n in "ab"]
    assert scored[0] == scored[1]


def test_the_sample_is_bounded_in_the_order_of_the_hash(spark, corpus):
    df, labels, _ = corpus
    everything, marks = quality.labelled_sample(df, labels, "quality", F.lit(True))
    assert len(everything) == 40 == len(marks)
    budget = 100 * max(map(len, everything))
    few, _ = quality.labelled_sample(df, labels, "quality", F.lit(True), max_bytes=budget // 10, rows=40)
    assert all(len(t) <= budget // 1000 for t in few)
    some, _ = quality.labelled_sample(df, labels, "quality", F.lit(True), rows=9)
    assert some == everything[:9]


def test_a_lexicon_of_several_automata(monkeypatch):
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(60)})
    words = terms + ["".join(rng.choice("abcdex") for _ in range(rng.randrange(1, 10))) for _ in range(400)]
    whole = toxicity.Scorer(terms)
    monkeypatch.setattr(toxicity, "TERMS_EACH", 7)
    parted = toxicity.Scorer(terms)
    assert len(parted.automaton.parts) > 5
    assert np.array_equal(whole.features(words), parted.features(words))
    text = "$" + "! ".join(words)
    assert np.array_equal(whole.features([text]), parted.features([text]))


def test_toxicity_scores_against_brute_force():
    """Counts of terms, misspelled and quoted, and the score, by plain edit distance over plain words."""
    rng = random.Random(4)
    scorer = toxicity.Scorer(["scum", "loser", "idiots"])
    scorer.weights = np.array([1.5, 0.7, -0.4, -0.2, 2.0, 1.0, -1.0])

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d, old = [i + 1], d
            for j, y in enumerate(b):
                d.append(min(old[j] + (x != y), old[j + 1] + 1, d[j] + 1))
        return d[-1]

    def brute(text):
        counts, n, at = [0, 0, 0, 0], 0, 0
        for w in text.split(" "):
            core = w.strip('"')
            n += 1
            best = min((e for t in scorer.automaton.terms if (e := edits(core, t)) <= (1 if len(t) >= 5 else 0)), default=9)
            if best < 9:
                lo = at + w.index(core)
                left, right = text[max(0, lo - 24) : lo], text[lo + len(core) : lo + len(core) + 24]
                quoted = ('"' in left and '"' in right) or (('"' in left or '"' in right) and any(x in left or x in right for x in toxicity.REPORTING))
                counts[2 * quoted + (best > 0)] += 1
            at += len(w) + 1
        x = [*np.log1p(counts), min(1, 20 * (counts[0] + 0.5 * counts[1]) / max(n, 1)), float(counts[0] > 0 or counts[1] > 1), 1]
        return 1 / (1 + np.exp(-np.dot(x, scorer.weights)))

    vocabulary = ["scum", "loser", "lser", "idiot", "idiots", '"loser"', "said", "plain", "word", '"idots"', "tree", "scam"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 15))) for _ in range(300)]
    assert np.allclose(scorer.score(texts), [brute(t) for t in texts])
    assert np.allclose(scorer.score([t.upper() for t in texts]), scorer.score(texts))


def test_shards_by_a_reference_ranking(spark, monkeypatch):
    """Shard and slot of every row against a plain sort by fractional rank; buckets added up in groups."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(sharding, "RUN_BITS", 2)
    rows = [(i, f"s{0 if i % 3 else i % 7}") for i in range(700)] + [(800 + i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "key_of long, stratum string").withColumn("key", F.xxhash64("key_of"))
    found = {r["key_of"]: (r["shard"], r["slot"]) for r in sharding.interleave_shards(df, 16).collect()}
    keys = {r["key_of"]: r["key"] for r in df.collect()}
    unsigned = lambda k: k % (1 << 64)
    by = {}
    for i, s in rows:
        by.setdefault("" if s is None else "=" + s, []).append(i)
    order = []
    for s, own in by.items():
        # buckets go by the unsigned hash, ties of a bucket by the signed one
        n = -(-len(own) // 3)
        own.sort(key=lambda i: (int((unsigned(keys[i]) >> 24) / (1 << 40) * n), keys[i]))
        order += [((r + 0.5) / len(own), s, keys[i], i) for r, i in enumerate(own)]
    want, total = {}, len(rows)
    for at, (*_, i) in enumerate(sorted(order)):
        shard = at * 16 // total
        want[i] = (shard, at - -(-shard * total // 16))
    assert found == want


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [2e-200, 2e-200], 0), (4, [1e308, -1e308], 0), (5, [5e-324, 5e-324], 0), (6, [0.0, 0.0], 0), (7, [float("inf"), 1.0], 0), (8, [float("nan"), 1.0], 0), (9, [None, 1.0], 0), (10, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicate_vectors(df).collect()}
    assert found == {**{i: (3, 1) for i in (1, 2, 3, 5)}, **{i: (0, i) for i in (4, 6, 7, 8, 9, 10)}}


def test_a_payload_that_most_pages_have(spark):
    body = "y" * 300
    rows = [(i, "u", body if i % 3 else body + str(i % 5)) for i in range(2500)]
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert found == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h in rows}


def test_contamination_of_texts_as_they_were(spark):
    rng = random.Random(8)
    passage, a, b = sentence(rng, 40), sentence(rng, 60), sentence(rng, 60)
    sources = docs_of(spark, [a + " " + passage, b + " " + passage, a + " z", "q"], [1, 2, 3, None])
    cut = docs_of(spark, [a + " " + passage, b, "z", "q"], [1, 2, 3, None])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    left = lambda out: sorted(((r["doc_id"] or -1), r["text"]) for r in out.collect())
    assert left(decontaminate.drop_contaminated(cut, bench)) == [(-1, "q"), (2, b), (3, "z")]
    assert left(decontaminate.drop_contaminated(cut, bench, sources)) == [(-1, "q"), (3, "z")]
    assert brute_contamination([(2, b + " " + passage)], [(1, passage)])[2][4] and zlib


def plain_features(text):
    """Words, pairs and n-grams of a text, as strings, kind by kind."""
    raw = bytes(c if c > 32 else 32 for c in (text or "").encode())
    words = raw.split()
    pairs = [("same",) if a == b else (a, b) for a, b in zip(words, words[1:])]
    grams = [[w[i : i + k] for w in (b" " + x + b" " for x in words) for i in range(len(w) - k + 1)] for k in quality.NGRAMS]
    return [words, pairs, *grams]


def test_features_and_scores_against_plain_ones():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "of", "of", "other", "été", "x" * 70, "end."]) for _ in range(rng.randrange(0, 12))) for _ in range(40)] + [None, "", " \n ", "same same same"]
    data = [(t or "").encode() for t in texts]
    found = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 30)
    bucket = {}
    for i, text in enumerate(texts):
        for kind, ((ids, by_doc), want) in enumerate(zip(found, plain_features(text))):
            own = ids[by_doc[i] : by_doc[i + 1]].tolist()
            assert len(own) == len(want)
            for b, feature in zip(own, want):
                assert bucket.setdefault((kind, feature), b) == b
    assert len({(k, b) for (k, _), b in bucket.items()}) == len(bucket)
    weights = np.random.default_rng(1).normal(size=1 << 18).astype(np.float32)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"text": texts})
    scores = np.concatenate([b.column("_score").to_numpy() for b in quality._score(weights, 0.2, 18)([batch])])
    for i, text in enumerate(texts):
        own = [weights[b] for ids, by_doc in quality.features(np.frombuffer(data[i], np.uint8), np.array([0, len(data[i])])) for b in ids]
        assert np.isclose(scores[i], 1 / (1 + np.exp(-(0.2 + (float(np.mean(own, dtype=np.float64)) if own else 0.0)))))


def test_training_steps_against_plain_gradients():
    """One epoch's steps are those of softmax cross-entropy by finite differences."""
    rng = np.random.default_rng(3)
    bits, dim = 6, 4
    bags = [(np.array([1, 5, 9]), np.array([0.5, 0.25, 0.25], np.float32)), (np.array([5, 11]), np.array([0.5, 0.5], np.float32))]
    vectors, layer, bias = rng.normal(size=(1 << bits, dim)), rng.normal(size=(2, dim)), rng.normal(size=2)

    def loss(v, w, b, i, y):
        z = w @ (bags[i][1] @ v[bags[i][0]]) + b
        return float(np.log(np.exp(z - z.max()).sum()) - (z - z.max())[y])

    ids, share = bags[0]
    z = layer @ (share @ vectors[ids]) + bias
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    p[1] -= 1
    back = layer.T @ p
    for k in range(dim):
        moved = vectors.copy()
        moved[5, k] += 1e-6
        assert np.isclose((loss(moved, layer, bias, 0, 1) - loss(vectors, layer, bias, 0, 1)) / 1e-6, share[1] * back[k], atol=1e-4)
    # learned weights part the two bags
    weights, offset = quality.train(bags, np.array([1, 0]), bits, dim, epochs=50)
    score = [weights[i] @ s + offset for i, s in bags]
    assert score[0] > 0 > score[1]
