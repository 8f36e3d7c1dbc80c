"""Token-id files with Elias-Fano encoded document boundaries.

`write` encodes texts and lays their ids one after the other in ascending doc_id order, an end id behind each document.
The array is cut into blocks at document ends. A block is one image of bytes:

    header   magic, documents m, ids u, bytes an id, low bits l, documents a sample, bytes of the high part
    low      the l = floor(log2(u / m)) low bits of every document's end, packed
    high     a bit string with bit (end >> l) + i set for document i: at most 2 m + 1 bits and a few
    samples  the place of every SAMPLE-th set bit (unsigned 32 bit)
    ids      u ids, 2 bytes each if the vocabulary allows, else 4, little-endian

An end takes l + 2 bits where a table takes 64. The start of document i is the end of document i - 1; an end is found
by `select`, which looks only at the bits between two samples. Images lie as rows (part, block, first, n_ids, doc_ids,
image) of Parquet files, as these are committed task by task in any store; the image itself is the file format.

Texts are dealt to parts by ranges of doc_id, ties by the text's hash and then by the row's place, so that no id
makes a part of its own; a part holds about PART_BYTES of text, and there are at most MOST_PARTS. Only totals of the parts
(one number each) reach the driver; a block knows its place in its part.

The library gives the ids of every text. Where its tokenizer is byte-level BPE that parts words before blanks and before
punctuation, a text is parted before every blank that touches no other white space and before punctuation behind a letter,
and each part is encoded once, as long as not too many are known. What is known stays with the Python process, in a
dictionary that is broadcast empty. Texts that hold an added token are encoded whole.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryload.llm.common import arrow_rows, whole
from ferryload.llm.tokencount import load_tokenizer

MAGIC, SAMPLE = b"EFIDS\x00\x00\x01", 256
_HEADER = "<8sQQIIII"
_BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<long>, image binary"
_READ = "doc_id long, start long, n_tokens long, ids binary"
PART_BYTES, MOST_PARTS = 24 << 20, 20_000
_KNOWN_BYTES, _BATCH_WORDS, _SLICE_BYTES, _BATCH_ROWS = 24 << 20, 2_000, 4 << 20, 1_000
_IDS = pa.list_(pa.uint32())
_FILES = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": False}  # a reader holds one row group of images
_SPACE = r"[\t-\r\x1c-\x1f\x{85}\pZ]"
_RUNS = [(f"({_SPACE})\x00 ", r"\1 "), (f"({_SPACE})\x00 ", r"\1 "), (f"\x00 ({_SPACE})", r" \1")]  # the first leaves every other blank of a run
_GLUED = r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?])"  # a letter run ends here in every version of the pattern's classes


class Encoder:
    """Ids of texts as the library gives them, without added tokens."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        before, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
        self.by_words = (config.get("normalizer") is None and config.get("post_processor") is None and model.get("type") == "BPE"
                         and not model.get("dropout") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                         and not before.get("add_prefix_space", True))
        added = [re.escape(t["content"]) for t in config.get("added_tokens", [])]
        self.not_words = "|".join([r"\x00", *added])
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], _IDS)

    def _library(self, texts: list[str]) -> pa.Array:
        """Ids of texts as the library gives them."""
        counts, ids = array("i", [0]), array("I")
        for i in range(0, len(texts), _BATCH_WORDS):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + _BATCH_WORDS], add_special_tokens=False):
                ids.extend(e.ids)
                counts.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(counts, np.int32)), pa.array(np.frombuffer(ids, np.uint32)))

    def _known(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words; what is new is encoded. All are forgotten when there are too many."""
        if self.words.nbytes + self.ids.nbytes > _KNOWN_BYTES:
            self._forget()
        found = pc.index_in(words, value_set=self.words)
        is_new = pc.is_null(found)
        new = words.filter(is_new)
        numbers = found.fill_null(0).to_numpy().astype(np.int32)
        numbers[is_new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = pa.concat_arrays([self.ids, self._library(new.to_pylist())])
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        plain = np.zeros(len(texts), bool)
        if self.by_words:
            plain = ~pc.match_substring_regex(texts, self.not_words).to_numpy(zero_copy_only=False)
        parted = pc.replace_substring(texts.filter(pa.array(plain)), " ", "\x00 ")
        for pattern, undone in _RUNS:
            parted = pc.replace_substring_regex(parted, pattern, undone)
        split = pc.split_pattern(pc.replace_substring_regex(parted, _GLUED, "\\1\x00\\2"), "\x00")
        words = split.flatten().dictionary_encode()
        per_text = np.ones(len(texts), np.int64)
        per_text[plain] = np.diff(split.offsets.to_numpy())
        units = np.empty(per_text.sum(), np.int32)
        of_plain = np.repeat(plain, per_text)
        units[of_plain] = self._known(words.dictionary)[words.indices.to_numpy()]
        units[~of_plain] = len(self.ids) + np.arange(len(texts) - np.count_nonzero(plain))
        others = self._library(texts.filter(pa.array(~plain)).to_pylist())
        taken = (pa.concat_arrays([self.ids, others]) if len(others) else self.ids).take(pa.array(units))
        upto = taken.offsets.to_numpy()[np.concatenate([[0], np.cumsum(per_text)])].astype(np.int64)
        return taken.flatten().to_numpy(), np.diff(upto)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batches, about _SLICE_BYTES of text at once; small batches are put together."""
    held, size = [], 0
    for batch in batches:
        number = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64) + size
        cuts = (np.flatnonzero(np.diff(number // _SLICE_BYTES, prepend=0)) + 1).tolist()  # behind the row that fills a slice
        at = 0
        for cut in cuts:
            yield pa.concat_batches([*held, batch.slice(at, cut - at)])
            held, at = [], cut
        size = int(number[-1]) % _SLICE_BYTES if len(number) else size
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def image_of(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """A block's image; ``ends`` rise, the last one is len(ids)."""
    m, u = len(ends), len(ids)
    low_bits = max(0, (u // m).bit_length() - 1)
    ends = ends.astype(np.int64)
    low = np.packbits(((ends[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1), bitorder="little")
    places = (ends >> low_bits) + np.arange(m)
    high = np.zeros(m + (u >> low_bits) + 1, np.uint8)
    high[places] = 1
    high = np.packbits(high, bitorder="little")
    head = struct.pack(_HEADER, MAGIC, m, u, width, low_bits, SAMPLE, len(high))
    return b"".join([head, low.tobytes(), high.tobytes(), places[::SAMPLE].astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()])


class Block:
    """Reads an image in place."""

    def __init__(self, image: bytes | memoryview):
        magic, self.m, self.u, width, self.low_bits, self.step, n_high = struct.unpack_from(_HEADER, image, 0)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        sizes = (-(-self.m * self.low_bits // 8), n_high, 4 * -(-self.m // self.step), width * self.u)
        at = np.cumsum([struct.calcsize(_HEADER), *sizes])
        part = [np.frombuffer(image, np.uint8, n, int(a)) for n, a in zip(sizes, at)]
        self.low, self.high, self.samples, self.ids = part[0], part[1], part[2].view("<u4"), part[3].view(f"<u{width}")

    def select(self, first: int, count: int) -> np.ndarray:
        """Places of the set bits number first to first + count - 1 of the high part."""
        out = []
        for group in range(first // self.step, -(-(first + count) // self.step)):
            begin = int(self.samples[group]) >> 3
            end = (int(self.samples[group + 1]) >> 3) + 1 if group + 1 < len(self.samples) else len(self.high)
            bits = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
            bits = bits[np.searchsorted(bits, self.samples[group]) :][: self.step]
            out.append(bits[max(0, first - group * self.step) : first + count - group * self.step])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def ends(self, first: int, count: int) -> np.ndarray:
        """Ends of the documents number first to first + count - 1."""
        i = np.arange(first, first + count)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[at >> 3] >> (at & 7)).astype(np.int64) & 1) << np.arange(self.low_bits)
        return ((self.select(first, count) - i) << self.low_bits) + low.sum(axis=1)

    def bounds(self, i: int) -> tuple[int, int]:
        ends = self.ends(max(i - 1, 0), min(i, 1) + 1)
        return (int(ends[0]) if i else 0), int(ends[-1])

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.ids[start:end]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, block_ids: int = 1 << 20, parts: int | None = None) -> None:
    """Files of the ids of ``docs`` (doc_id, text) below ``folder``, which all machines see.

    Documents lie in ascending doc_id order, null ids first, equal ids in an order of their texts. Null texts count as
    empty; an empty text has the end id alone. Every row is written, repeated ones as often as they occur; other columns
    are not looked at; an empty table gives no block. A document is never cut: a block holds at least one.
    """
    spark = docs.sparkSession
    width = 2 if load_tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4

    kept = spark.sparkContext.broadcast({})  # read once a Python process, which serves several tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in kept.value:
            kept.value["encoder"] = Encoder(tokenizer_path)
        encoder, part, block, first = kept.value["encoder"], TaskContext.get().partitionId(), 0, 0
        for batch in _slices(batches):
            ids, lengths = encoder.encode(batch.column("text"))
            pa.default_memory_pool().release_unused()
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            ends = np.cumsum(lengths + 1)
            at = 0
            while at < len(ends):
                begin = int(ends[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, begin + block_ids, "right")))
                n = int(ends[upto - 1]) - begin
                image = image_of(ids[begin : begin + n], ends[at:upto] - begin, width)
                doc_ids = batch.column("doc_id").slice(at, upto - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([image], pa.binary())],
                    names=["part", "block", "first", "n_ids", "doc_ids", "image"])
                at, block, first = upto, block + 1, first + n

    body = whole("text")
    order = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tie"),
                       F.monotonically_increasing_id().alias("place"))
    if parts is None:
        size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = min(max(spark.sparkContext.defaultParallelism, size // PART_BYTES), MOST_PARTS)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with arrow_rows(spark, _BATCH_ROWS):
        rows.select("doc_id", "text").mapInArrow(run, _BLOCKS).write.mode("overwrite").options(**_FILES).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bit each)."""
    blocks = spark.read.schema(_BLOCKS).parquet(folder)
    bases, base = {}, 0
    for row in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per part
        bases[row["part"]], base = base, base + row["n"]

    def run(rows) -> Iterator[tuple]:
        for part, first, doc_ids, image in rows:
            block = Block(image)
            ends = block.ends(0, block.m)
            starts = np.concatenate([[0], ends[:-1]])
            ids = block.ids.astype("<u4")
            for doc_id, start, end in zip(doc_ids, starts.tolist(), ends.tolist()):
                yield doc_id, bases[part] + first + start, end - start, ids[start:end].tobytes()

    # Row by row: an Arrow batch would hold all images of a task at once.
    made = blocks.select("part", "first", "doc_ids", "image").rdd.mapPartitions(run)
    return spark.createDataFrame(made, _READ, verifySchema=False)
