"""Packing, mixing, toxicity, token counts and the pipeline."""

import zlib

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferryload.llm import mixing, neardup, packing, queries, tokencount, toxicity
from ferryload.llm.common import Workspace

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


HAND = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n", "en", None, 2), (4, "one two", None, "a", 7), (4, "one two", "en", "b", 7),
        (None, "x " * 9000, "de", "b", 18000), (5, "<|endoftext|> é😀 <|endoftext|>", "fr", "a", 30)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_bins_hold_their_pieces(sizes):
    how = packing.Bins(lengths=(8, 16, 32, 64), overhead=2)
    bins, places, lengths = packing.best_fit(np.array(sizes, np.int64), how)
    for b, length in enumerate(lengths):
        mine = sorted((p, s) for p, s, x in zip(places, sizes, bins) if x == b)
        assert mine and [p for p, _ in mine] == list(np.cumsum([0] + [s for _, s in mine[:-1]]))
        total = sum(s for _, s in mine)
        assert length == min(c for c in how.lengths if c >= total)


def test_best_fit_takes_the_tightest_bin_and_is_close_to_full():
    how = packing.Bins()
    bins, _, lengths = packing.best_fit(np.array([3000, 2000, 1000, 90]), packing.Bins(lengths=(3072, 4096)))
    assert bins[0] == bins[2] or bins[0] != bins[1]
    sizes = np.random.default_rng(2).integers(1, 3000, 5000)
    _, _, lengths = packing.best_fit(sizes, how)
    assert sizes.sum() / sum(lengths) > 0.97


def test_packing_places_every_token_once(spark):
    for docs in (rows_of(spark, HAND), spark.read.parquet(f"{SMALL}/documents.parquet")):
        placed = packing.packed(docs, packing.Bins(group_rows=60)).collect()
        counts = sorted(len(brute.words(r.text)) for r in docs.collect())
        assert sum(r.n_tokens for r in placed) == sum(counts)
        assert sum(r.bin_id is None for r in placed) == sum(c == 0 for c in counts)
        by_bin = {}
        for r in placed:
            by_bin.setdefault(r.bin_id, []).append((r.bin_start, r.n_tokens, r.bin_length))
        by_bin.pop(None, None)
        for parts in by_bin.values():
            parts.sort()
            assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts[:-1]]))
            assert sum(p[1] for p in parts) <= parts[0][2] and len({p[2] for p in parts}) == 1
    assert packing.packed(rows_of(spark, [])).count() == 0


def test_sequences_are_a_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    placed = packing.packed(docs).cache()
    texts = {r.bin_id: r.text.split() for r in packing.sequences(docs, placed).collect()}
    original = {r.doc_id: [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text)] for r in docs.collect()}
    for r in placed.where("bin_id is not null").collect():
        assert texts[r.bin_id][r.bin_start : r.bin_start + r.n_tokens] == original[r.doc_id][r.start : r.start + r.n_tokens]


def test_raking_meets_the_marginals():
    cells = np.random.default_rng(4).integers(1, 100, (5, 3, 4)).astype(float)
    shares = [np.random.default_rng(i).dirichlet(np.ones(n)) for i, n in enumerate(cells.shape)]
    weights = mixing.rake(cells, shares, 500, 1e-12)
    for axis in range(3):
        assert np.allclose(weights.sum(axis=tuple(a for a in range(3) if a != axis)), shares[axis], atol=1e-9)
    odds = weights / cells  # raking keeps the odds ratios of the cells
    assert np.isclose(odds[0, 0, 0] * odds[1, 1, 0] / odds[0, 1, 0] / odds[1, 0, 0], 1)
    chance = mixing.probabilities(cells, weights, mixing.Mix(least_keep=0.6))
    assert chance.max() <= 1 and np.isclose((chance * cells).sum(), 0.6 * cells.sum())


def test_mixing_draws_the_targets(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    targets = {"source": {"src0": 0.5, "(other)": 0.5}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"prose": 0.5, "(other)": 0.5}}
    rows = mixing.mixed(docs, targets, mixing.Mix(least_keep=0.0))
    expected = lambda c: {r[0]: r[1] for r in rows.groupBy(c).agg(F.sum(F.col("probability") * F.col("n_tokens"))).collect()}
    for column, name in (("source", "src0"), ("lang", "en"), ("topic", "prose")):
        sums = expected(column)
        assert abs(sums[name] / sum(sums.values()) - 0.5) < 1e-6
    assert rows.count() == docs.count() and mixing.mixed(docs).where("kept").count() > 600
    assert rows.where("kept").select("doc_id").collect() == rows.where("kept").select("doc_id").collect()


def test_bounded_raking_meets_the_marginals_beyond_the_first_cut():
    """One scarce cell cuts the draw without bounded raking; the other cells of its categories make up for it."""
    cells = np.array([[[1.0], [500.0]], [[500.0], [500.0]]])
    weights = mixing.rake(cells, [np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.ones(1)], 500, 1e-12)
    chance = mixing.probabilities(cells, weights, mixing.Mix(least_keep=0.0))
    drawn = chance * cells
    assert drawn.sum() / cells.sum() > 1.01 / (weights * cells.sum() / cells).max() and chance.max() <= 1
    assert np.allclose(drawn.sum(axis=(1, 2)) / drawn.sum(), 0.5, atol=1e-6) and np.allclose(drawn.sum(axis=(0, 2)) / drawn.sum(), 0.5, atol=1e-6)


def test_mixing_query_draws_its_targets(spark):
    rows = queries.op2_mixing(spark, MORE)
    total, drawn = rows.agg(F.sum("n_tokens"), F.sum(F.col("probability") * F.col("n_tokens"))).first()
    for margin in mixing.MARGINS:
        sums = rows.groupBy(margin).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("probability") * F.col("n_tokens")).alias("drawn")).where("n > 0").collect()
        smooth = sum(r.n**0.7 for r in sums)
        assert all(abs(r.drawn / drawn - r.n**0.7 / smooth) < 0.0015 for r in sums)


def test_mixing_gives_every_source_a_target(spark):
    """300 sources: the smallest ones have marginals of their own, as the largest have."""
    docs = rows_of(spark, [(i, "w " * (40 + 7 * (i % 5)), "en" if i < 600 else "de", f"s{i % 300}", 0) for i in range(900)])
    sums = mixing.mixed(docs).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("weight") * F.col("n_tokens")).alias("w")).collect()
    total, smooth = sum(r.n for r in sums), sum(r.n**0.7 for r in sums)
    assert len(sums) == 300 and all(abs(r.w / total - r.n**0.7 / smooth) < 1e-8 for r in sums)


def test_mixing_hand_cases(spark):
    found = mixing.mixed(rows_of(spark, HAND))
    assert found.count() == len(HAND) and found.where("kept is null or probability is null or weight is null").count() == 0
    assert mixing.mixed(rows_of(spark, [])).count() == 0
    clash = rows_of(spark, HAND).withColumn("topic", F.lit(1)).withColumn("weight", F.lit("w"))
    assert mixing.draw(clash).columns == clash.columns


def test_toxicity_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    ranked = sorted((r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth)
    ones = [i for i, (_, y) in enumerate(ranked) if y]
    zeros = len(ranked) - len(ones)
    auc = (sum(ones) - len(ones) * (len(ones) - 1) / 2) / len(ones) / zeros
    assert auc > 0.7  # three hundred labelled rows; 0.999 on the larger tables


def test_toxicity_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in toxicity.toxicity(docs, t).collect()} for t in (labels, flipped))
    assert a == b


def test_toxicity_hand_cases(spark):
    labels = spark.createDataFrame([(4, 0, 1), (4, 1, None), (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    docs = rows_of(spark, HAND).withColumn("score", F.lit("s")).withColumn("label", F.lit(1))
    assert toxicity.toxicity(docs, labels).count() == len(HAND)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_fit_equals_plain_learning_in_any_number_of_shards(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    chosen = toxicity.labels_of(labels).where(~toxicity.held_out("doc_id")).join(docs.select("doc_id", "text"), "doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = chosen.select(F.xxhash64("doc_id", F.lit(7)).alias("order"), "doc_id", F.xxhash64(text).alias("tie"), "label", text.alias("text")).collect()
    rows = sorted((r.order, r.doc_id, r.tie, r.label, r.text) for r in rows)
    words = toxicity.WordHashes(100)  # forgets words now and then
    plain = toxicity.learn([(toxicity.features(r[4], words), r[3]) for r in rows], toxicity.Ftrl())
    assert np.allclose(plain, toxicity.fit(docs, labels)) and np.count_nonzero(plain)
    some = toxicity.fit(docs, labels, toxicity.Ftrl(shard_bytes=20_000))
    assert np.count_nonzero(some) and not np.allclose(plain, some)


def test_ftrl_is_sparse_and_learns():
    chance = np.random.default_rng(0)
    rows = []
    for i in range(600):
        label = int(i % 3 == 0)
        at = np.unique(np.append(chance.integers(10, 5000, 30), [0] + [5] * label))
        rows.append((at, label))
    weights = toxicity.learn(rows, toxicity.Ftrl())
    assert weights[5] > 1 and np.count_nonzero(weights) < 1500


def library_counts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts_and_cache(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = rows_of(spark, HAND).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))
    cache = Workspace(spark, "test").path + "/cache"
    for _ in range(2):
        found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs, path, cache).collect())
        rows = docs.collect()
        counts = library_counts([r.text for r in rows])
        assert found == sorted((r.doc_id or 0, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, counts))
        # each distinct text was counted once, and nothing in the second call
        assert spark.read.parquet(cache).count() == len({r.text or "" for r in rows})
    known = spark.read.parquet(cache)
    wrong = known.withColumn("tokenizer", F.lit("another")).withColumn("n_tokens", F.lit(-1).cast("long"))
    wrong.write.mode("append").parquet(cache)
    assert tokencount.token_counts(docs, path, cache).where("n_tokens < 0").count() == 0
    assert tokencount.token_counts(docs.limit(0), path).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    work = Workspace(spark, "test")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = work.write(stage(spark, docs, SMALL), f"s{n}")
        out.append((docs, after))
        docs = after
    return out


def test_pipeline_stages(spark, stages):
    for before, after in stages[:4]:
        assert after.columns == before.columns
        assert after.subtract(before).count() == 0
    toxic = {r.doc_id for r in stages[0][1].collect()}
    scores = toxicity.toxicity(stages[0][0], spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert toxic == {r.doc_id for r in scores if not r.predicted}
    last = {}
    for r in stages[1][0].collect():
        last[r.text] = max(r.doc_id, last.get(r.text, 0))
    assert sorted(r.doc_id for r in stages[1][1].collect()) == sorted(last.values())
    near = brute.near_groups([(r.doc_id, r.text) for r in stages[2][0].collect()], 5)
    assert sorted(r.doc_id for r in stages[2][1].collect()) == sorted(i for i, (_, _, kept) in near.items() if kept)
    drawn = mixing.mixed(stages[3][0]).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in stages[3][1].collect()) == sorted(r.doc_id for r in drawn)
    assert {r.doc_id for r in stages[4][1].collect()} == {r.doc_id for r in stages[3][1].collect()}


def test_pipeline_of_empty_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n for n in range(1, 14)} == {int(x[2:].split("_")[0]) for x in names if x[:2] == "op" and x[2].isdigit()}
    assert set(queries.QUERIES) <= names and set(queries.ORACLE) <= set(entry.oracle_sql())
    assert neardup.BANDS * neardup.ROWS % neardup.BATCH == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    from compare import differences, duck

    assert differences(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLE[name]) is None


def test_toxicity_stage_hands_few_texts_to_python(spark, monkeypatch):
    name, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", toxicity.scored

    def watched(docs, weights):
        made = keep(docs, weights)

        @F.pandas_udf("long")
        def rows(texts: pd.Series) -> pd.Series:
            return pd.Series([len(texts)] * len(texts), dtype="int64")

        return made.withColumn("_row", F.col("_row").withField("n", rows(F.col("_row.text"))))

    monkeypatch.setattr(toxicity, "scored", watched)
    docs = spark.range(2500).selectExpr("id as doc_id", "concat('text ', id) as text").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    before = spark.conf.get(name)
    kept = toxicity.drop_toxic(docs, labels, toxicity.Ftrl(threshold=0.6))
    assert kept.count() == 2500 and kept.agg(F.max("n")).first()[0] <= 1000
    assert spark.conf.get(name) == before
