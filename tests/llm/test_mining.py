"""Phrases, token files and whitening against brute force, round trips and a plain eigenvalue routine."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brute import collocations as plain_collocations
from ferryload.llm import phrases, tokenfiles, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, n long, phrase string, rank int, a string"


def frame(spark, rows):
    """(doc_id, text, lang) with columns whose names the results have, too."""
    return spark.createDataFrame([(*row, 1, "x", 2, "y") for row in rows], SCHEMA)


def texts():
    pick = random.Random(3)
    words = ["alpha", "Beta", "gamma", "d", "é", "ñu", "\x00", "x-y", "日本"]
    rows = [(i, " ".join(pick.choices(words, [9, 8, 7, 3, 3, 2, 1, 1, 1], k=pick.randrange(60))).replace("d ", pick.choice(["d ", "d, ", "d\n", "d\t "])), pick.choice(["en", "de", None]))
            for i in range(150)]
    return rows + [(1, None, "en"), (2, "", None), (3, " \t ", "en"), (4, "alpha beta", "zz"), (5, "one two three four " * 40, "en"), (5, "one two three four " * 40, "en"),
                   (None, "pieces. of: text; here! and? there", "en"), (7, "alpha beta gamma " * 4000, "de")]


@pytest.mark.parametrize("shards,slots", [(1, 1 << 23), (3, 1 << 23), (2, 64)])
def test_phrases(spark, monkeypatch, shards, slots):
    """A filter of 64 slots is always full and changes nothing."""
    monkeypatch.setattr(phrases, "SLOTS", slots)
    monkeypatch.setattr(phrases, "_CHUNK_WORDS", 500)
    monkeypatch.setattr(phrases, "_SLICE_BYTES", 2000)
    how = phrases.Phrases(least=5, top=40, shards=shards)
    got = phrases.collocations(frame(spark, texts()).repartition(3), how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_collocations([(lang, text) for _, text, lang in texts()], least=5, top=40))


@pytest.mark.parametrize("slots", [1 << 12, 1 << 10])
def test_a_half_full_filter_loses_no_phrase(spark, monkeypatch, slots):
    """A phrase whose slots are set by others before its words are frequent is still counted for a full cycle."""
    monkeypatch.setattr(phrases, "SLOTS", slots)
    monkeypatch.setattr(phrases, "_CHUNK_WORDS", 700)
    monkeypatch.setattr(phrases, "_SLICE_BYTES", 3000)
    pick = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    parts = [" ".join(pick.choices(words, k=pick.randint(3, 7))) for _ in range(300)]
    rows = [("en" if i % 3 else "de", ". ".join(pick.choices(parts, [1 / (j + 3) for j in range(300)], k=12))) for i in range(900)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_collocations(rows, least=30, top=2000))


def test_phrases_of_nothing(spark):
    assert phrases.collocations(frame(spark, [])).collect() == [] and phrases.collocations(frame(spark, [(1, None, None), (2, "", "en")])).collect() == []
    with pytest.raises(ValueError, match="shards"):
        phrases.collocations(frame(spark, []), phrases.Phrases(shards=100))


def test_a_late_phrase_is_counted_for_one_cycle():
    """Two shards: the phrase's words reach the threshold with the second scan, so it is counted in steps 2 and 3."""
    how, words = phrases.Phrases(least=4, shards=2), pa.array(["u", "v"])
    hashes, ids = phrases.word_hashes("en", words), np.array([1, 2, 0] * 3, np.int32)
    steps, counts = np.full(phrases.SLOTS, phrases.NEVER, np.uint8), Counter()
    for step in range(6):
        for k, h, _, n in phrases.scan(ids, hashes, steps, step, how):
            counts.update({(k, int(x)): int(c) for x, c in zip(h, n)})
        fresh = np.array([h for (_, h), n in counts.items() if n >= how.least], np.uint64)
        for at in phrases.slots(fresh):
            steps[at] = np.minimum(steps[at], step + 1)
    assert {(k, n) for (k, _), n in counts.items()} == {(1, 6), (2, 6)}


def encoded(rows, tokenizer):
    """Plain version: (doc_id, start, n_tokens, ids_crc32)."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_are_a_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "_SLICE_BYTES", 3000)
    rows = [(i * 7 - 40, text) for i, (_, text, _) in enumerate(texts())] + [(2**60 + 1, "It's  a<|endoftext|> test,don't. \x85 x"), (2**60, "z" * 100_000)]
    tokenfiles.write(frame(spark, [(i, t, "en") for i, t in rows]).repartition(5), str(tmp_path / "f"), TOKENIZER, block_ids=1000, parts=4)
    got = tokenfiles.read(spark, str(tmp_path / "f")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == encoded(sorted(rows), tokenfiles.load_tokenizer(TOKENIZER))


def test_token_files_with_repeated_and_null_ids(spark, tmp_path):
    rows = [(3, "b"), (3, "b"), (3, "a a"), (None, "x"), (None, None), (1, "")]
    tokenfiles.write(frame(spark, [(*r, "en") for r in rows]), str(tmp_path / "f"), TOKENIZER)
    got = sorted(tokenfiles.read(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3, 3] and [r["start"] for r in got][0] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and sum(r["n_tokens"] for r in got) == 11
    tokenfiles.write(frame(spark, []), str(tmp_path / "none"), TOKENIZER)
    assert tokenfiles.read(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("m,most", [(1, 1), (1, 70_000), (2, 3), (255, 1), (256, 9), (257, 500), (4000, 40)])
def test_elias_fano_ends(m, most):
    lengths = np.random.default_rng(m).integers(1, most + 1, m)
    ends = np.cumsum(lengths)
    ids = np.arange(ends[-1]) % 50_000
    image = tokenfiles.image_of(ids, ends, 2)
    block = tokenfiles.Block(image)
    assert (block.ends(0, m) == ends).all()
    for i in {0, m // 2, m - 1, min(m - 1, 255), min(m - 1, 256)}:
        assert block.bounds(i) == (ends[i] - lengths[i], ends[i]) and (block.document(i) == ids[ends[i] - lengths[i] : ends[i]]).all()
    boundary_bits = 8 * (len(image) - 2 * len(ids) - 44)
    assert boundary_bits <= m * (max(0, (len(ids) // m).bit_length() - 1) + 3.2) + 64
    with pytest.raises(ValueError):
        tokenfiles.Block(b"x" * len(image))


@pytest.mark.parametrize("known", [0, 1 << 20])
def test_parts_of_words_have_the_ids_of_the_text(monkeypatch, known):
    monkeypatch.setattr(tokenfiles, "_KNOWN_BYTES", known)
    pick = random.Random(5)
    bits = ["a", "Ab", " ", "  ", "     ", "\t", "\n", "'s", "'ll", "é", "1", "23", ".", "!?", ",", " the", "\xa0", "\x85", "\x1c", "<|endoftext|>", "日本", "😀", "_", "²", "\x00", "İ", "ß"]
    some = ["".join(pick.choices(bits, k=pick.randrange(14))) for _ in range(5000)] + ["", "x" * 50_000]
    encoder = tokenfiles.Encoder(TOKENIZER)
    for _ in range(2):
        ids, lengths = encoder.encode(pa.array(some))
        want = encoder.tokenizer.encode_batch(some, add_special_tokens=False)
        assert encoder.by_words and [len(w.ids) for w in want] == lengths.tolist() and [i for w in want for i in w.ids] == ids.tolist()


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, component int, whitened double")


def test_whitening_against_a_plain_routine(spark):
    rng = np.random.default_rng(1)
    c = (rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40)) / 5 + 3).astype(np.float32)
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [1.0, 2.0]), (905, [])]
    rows = [(i if i else None, [float(v) for v in row]) for i, row in enumerate(c)] + [(5, [float(v) for v in c[5]])] + bad
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    x = np.floor(64 * np.vstack([c, c[5]]).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    want = np.abs(centred @ parts[:, ::-1][:, :32] / np.sqrt(values[::-1][:32]))
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    seven = got[got["vec_id"] == 7].sort_values("component")
    assert np.allclose(np.abs(seven["whitened"]), want[7], atol=1e-8) and set(seven["deviation"]) == {int(((n * x[7] - total) ** 2).sum())}
    assert np.allclose(seven["explained"], values[::-1][:32] / values.sum(), rtol=1e-10)
    assert (got["vec_id"] == 5).sum() == 64 and got["vec_id"].isna().sum() == 32


def test_whitening_of_degenerate_tables(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        assert whitening.whitened(vectors(spark, rows)).collect() == []
    two = whitening.whitened(vectors(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [1e30, 0.0])])).toPandas()
    assert len(two) == 3 and two["deviation"].isna().all()  # beyond 64 bits; the second eigenvalue is 0 by rounding


@pytest.mark.parametrize("values", [[5.0] * 20, [3, 3, 3, 1, 1, 0, 0], [5, 5, 5 + 1e-9, 4, 2, 1], list(np.geomspace(1e6, 1e-6, 40)), [0.0] * 4, [7.0]])
def test_spectrum(values):
    rng = np.random.default_rng(len(values))
    basis = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, parts = whitening.Spectrum(matrix).pairs(32)
    largest = sorted((v for v in values if v > 1e-9 * max(values)), reverse=True)[:32]
    assert np.allclose(found[: len(largest)], largest, rtol=1e-6, atol=1e-12) and len(found) >= len(largest)
    assert np.allclose(parts.T @ parts, np.eye(len(found)), atol=1e-8)
    assert np.abs(matrix @ parts - parts * found).max(initial=0) <= 1e-8 * max(max(values), 1)


def test_inertia_counts_and_solutions():
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        made = whitening.factor(a, 1e-300)
        assert made.above() == (np.linalg.eigvalsh(a) > 0).sum()
        b = rng.standard_normal((n, 2))
        assert np.allclose(a @ made.solve(b), b, atol=1e-6)
    assert whitening.factor(np.array([[0.0, 1.0], [1.0, 0.0]]), 1e-300).above() == 1
