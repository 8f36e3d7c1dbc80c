"""Exact and near copies against plain versions."""

import random

import brute
from pyspark.sql import functions as F

from ferryload.llm import exactdup, neardup

FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, head string, n long, rest string").repartition(3)


def wide(rows):
    return [(i, t, "x", 1, "y") for i, t in rows]


def near(spark, rows, **how):
    found = neardup.near_groups(frame(spark, wide(rows)), **how).collect()
    assert len(found) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def test_exact_hand_cases(spark):
    long = "ab" * 5000
    rows = wide([(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long + "c"), (7, long), (8, "a "), (None, "a"), (9, "é" * 40),
                 (10, "é" * 40), (11, "z"), (11, "z"), (None, None)])
    got = sorted(((r.doc_id or -1), r.keep_id, r.group_size, r.kept) for r in exactdup.exact_groups(frame(spark, rows)).collect())
    assert got == sorted([(1, 2, 3, False), (2, 2, 3, True), (-1, 2, 3, False), (3, 4, 3, False), (4, 4, 3, True), (-1, 4, 3, False),
                          (5, 7, 2, False), (7, 7, 2, True), (6, 6, 1, True), (8, 8, 1, True), (9, 10, 2, False), (10, 10, 2, True),
                          (11, 11, 2, False), (11, 11, 2, True)])


def test_exact_prefixes_that_end_at_a_digit(spark):
    texts = ["q" * n for n in (63, 64, 65, 511, 512, 513, 4095, 4096, 4097)] * 2
    found = exactdup.exact_groups(frame(spark, wide(list(enumerate(texts))))).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id % 9 + 9 for r in found)


def test_exact_empty_and_kept_rows(spark):
    none = frame(spark, [])
    assert exactdup.exact_groups(none).count() == 0 and exactdup.drop_exact_copies(none).count() == 0
    rows = frame(spark, wide([(1, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (5, "c"), (5, "c"), (5, "d")]))
    kept = exactdup.drop_exact_copies(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (2, "a"), (4, ""), (5, "c"), (5, "d")]


def test_near_hand_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, base), (8, base + " x"), (9, base.replace("w30 ", "")),
            (10, "two one"), (11, "é"), (12, "É")]
    assert near(spark, rows) == brute.near_groups(rows)
    assert neardup.near_groups(frame(spark, [])).count() == 0


def test_large_ids_beside_null_ones(spark):
    from ferryload.llm import packing, quality

    big = 2**62 + 1
    rows = frame(spark, wide([(None, "a b"), (big, "c d"), (big + 1, "c d")])).coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for found in (neardup.near_groups(rows), quality.quality(rows, labels), packing.packed(rows), exactdup.exact_groups(rows)):
        assert {r.doc_id for r in found.collect()} == {None, big, big + 1}
    assert {r.component_id for r in neardup.near_groups(rows).collect()} == {None, big}


def test_near_threshold_is_exact(spark):
    """4 of 5 shingles are exactly 80 percent."""
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d"), (4, "a b c"), (9, "x y z"), (8, "x y z w")]
    assert near(spark, rows) == brute.near_groups(rows)


def test_near_repeated_and_null_ids(spark):
    rows = frame(spark, wide([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "q r")]))
    found = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_groups(rows).collect())
    assert found == [(0, 0, True), (0, 3, False), (3, 3, False), (3, 3, True)]
    assert sorted(r.text for r in neardup.drop_near_copies(rows).collect()) == ["a b c"] * 3 + ["q r"]


def test_near_large_group_of_drifting_copies(spark):
    """Copies of copies: most pairs of the group are below the threshold, chains hold it together."""
    chance = random.Random(3)
    rows, texts = [], [[f"v{i}" for i in range(80)]]
    for i in range(300):
        text = list(chance.choice(texts))
        for _ in range(chance.choice((1, 2, 5))):
            text[chance.randrange(80)] = f"r{chance.randrange(10**6)}"
        texts.append(text)
        rows.append((i, " ".join(text)))
    assert near(spark, rows) == brute.near_groups(rows)


def test_near_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for size in (2, 5):
        found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(docs, size=size).collect()}
        assert found == brute.near_groups(rows, size)


def test_bayes_bound_is_the_posterior():
    """The fewest matches leave a posterior mass of at least the miss probability; one less would not."""
    import numpy as np

    for n, fewest in neardup.least_matches(0.8, 1e-4):
        grid = (np.arange(200_000) + 0.5) / 200_000
        mass = []
        for m in (fewest - 1, fewest):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            mass.append(density[grid >= 0.8].sum() / density.sum())
        assert mass[0] < 1e-4 <= mass[1]


def test_components_of_a_long_chain(spark):
    from ferryload.llm.common import Workspace

    n = 500
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    stars = neardup.components(Workspace(spark, "test"), edges, "chain")
    assert stars.agg(F.count("*"), F.sum("v")).first()[:] == (n - 1, 0)


def test_python_gets_few_texts_at_once(spark, monkeypatch):
    keep = neardup._sketches

    def watched(size):
        run = keep(size)

        def checked(frames):
            def few(f):
                assert len(f) <= 1000
                return f

            return run(few(f) for f in frames)

        return checked

    monkeypatch.setattr(neardup, "_sketches", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(2500).selectExpr("id as doc_id", "concat('one two three four five six seven eight nine w', id div 2) as text").coalesce(1)
    assert neardup.near_groups(rows, size=9, percent=100).where("kept").count() == 1250
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
