"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Record format (little-endian): length of the data in bytes (uint64), masked checksum of those 8 bytes (uint32), the
data, masked checksum of the data (uint32). The checksum is CRC-32 (the zlib polynomial), masked as rotate-right-by-15
plus 0xa282ead8, so that a checksum of data that hold checksums is not itself regular. The data of a sequence: a flag
byte (bit 0: the id is null, bit 1: ids are 16 bits wide, else 32), the id (int64), then the token ids compressed by
zstd. A shard file is a run of records and nothing else but the one line end Spark's text writer adds.

Writing. Rows are dealt into ranges of ascending id by a range partitioning on (id, hash of the text, row number), so
the sample that finds the ranges reads ids and texts only; each range is sorted and encoded in its own task (the
tokenizers library's normalizer and BPE model; its split pattern applied in Python with a memory of split words, which
gives the library's ids exactly and is tested against it), the end id appended, and written as shard files of at
most SHARD_BYTES, in order, below the range's folder. Texts cross the shuffle once; ids never do.

Index. The shards are read back as binary files (bounded as above) and cut into records; the index (Parquet) has per
record the id, range, file, record number, byte offset, number of ids and `start`: the ids of all records before it,
from one small table of totals per file summed up in order and the ids before it in its file.

Defined results: a null text counts as empty, so it is the end id alone. Rows with a null id come first; rows of one
id are ordered by a hash of their text, then as read; equal rows give equal records. Extra columns are not read. An
empty table writes no shard and an empty index and reads back as an empty table. A damaged record raises.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import cut_lineage, small_batches

#: Bytes of a shard file; only file sizes depend on it.
SHARD_BYTES = 16_000_000
#: Fixed values of the checksum mask.
MASK_DELTA, MASK_ROTATE = 0xA282EAD8, 15
#: Split words a Python worker remembers, and the longest it remembers; only speed depends on them.
MEMO, MEMO_CHARS = 300_000, 64
#: Last code point up to which str.lower and a plain pattern do what the library's normalizer and split pattern do: such
#: texts are in NFC and have no letter whose lower case depends on its place.
LATIN = "\u017f"
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased texts up to LATIN (U+0130 becomes i and U+0307, which is no letter).
_L, _N, _S = "a-zªµºß-öø-\u017f", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
LATIN_WORDS = f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+"

RECORDS = "doc_id long, range int, file int, record long, offset long, n_tokens long, ids_crc32 long, within long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_ROTATE) | (crc << (32 - MASK_ROTATE))) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked(head)) + data + struct.pack("<I", masked(data))


def unframe(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each record of a shard; a trailing line end is no record."""
    at = 0
    while at + 12 <= len(blob):
        head = blob[at:at + 8]
        (size,) = struct.unpack("<Q", head)
        if struct.unpack("<I", blob[at + 8:at + 12])[0] != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        data = blob[at + 12:at + 12 + size]
        if len(data) != size or struct.unpack("<I", blob[at + 12 + size:at + 16 + size])[0] != masked(data):
            raise ValueError(f"damaged record at byte {at}")
        yield at, data
        at += 16 + size
    if blob[at:] not in (b"", b"\n"):
        raise ValueError(f"{len(blob) - at} bytes after the last record")


class WordEncoder(dict):
    """The library's normalizer and BPE model; split pattern and byte-level alphabet taken from its pre-tokenizer.

    As a dict it is a bounded memory: split word -> its ids as the bytes of an int32 array.
    """

    def __init__(self, path: str):
        super().__init__()
        import json

        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        config = json.load(open(path, encoding="utf-8"))
        steps = config["pre_tokenizer"].get("pretokenizers", [config["pre_tokenizer"]])
        split = [x for x in steps if x["type"] == "Split"]
        if len(split) != 1 or not split[0]["invert"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError("only a split pattern followed by a byte-level step is known here")
        pattern = split[0]["pattern"]["Regex"]
        # The library's \s is Unicode White_Space.
        self.find = regex.compile(pattern.replace("\\s", "\\p{White_Space}")).findall
        self.normalize, self.model = tok.normalizer.normalize_str, tok.model
        # Below LATIN the library's normalizer, if it is the one known here, is str.lower but for white space, which the
        # pattern, if it is the one known here, drops.
        known = config["normalizer"] == NORMALIZER and pattern == WORDS
        self.other = re.compile(f"[^\\x00-{LATIN}]").search if known else None
        self.find_latin = re.compile(LATIN_WORDS).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        # Added tokens are found in the raw text first, longest first; the text between them is encoded as usual.
        added = sorted(config.get("added_tokens", []), key=lambda t: -len(t["content"]))
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only added tokens matched as they are written are known here")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None

    def __missing__(self, word: str) -> bytes:
        mapped = "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")])
        out = array("i", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def words(self, text: str) -> list[str]:
        if self.other is not None and (text.isascii() or not self.other(text)):
            return self.find_latin(text.lower())
        return self.find(self.normalize(text))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(b"".join(map(self.__getitem__, self.words(text))), np.int32)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(self.__getitem__, self.words(text[at:m.start()]))
            out.append(array("i", [self.added[m.group()]]).tobytes())
            at = m.end()
        out += map(self.__getitem__, self.words(text[at:]))
        return np.frombuffer(b"".join(out), np.int32)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]


#: The last encoder of this Python worker, so that tasks that follow each other share its memory.
_last: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _last:
        _last.clear()
        _last[path] = WordEncoder(path)
    return _last[path]


def serialize(doc_id, ids: np.ndarray, packer) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flag = (doc_id is None) | (0 if wide else 2)
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    return struct.pack("<Bq", flag, doc_id or 0) + packer.compress(raw)


def deserialize(data: bytes, unpacker) -> tuple[int | None, np.ndarray]:
    flag, doc_id = struct.unpack("<Bq", data[:9])
    raw = unpacker.decompress(data[9:])
    ids = np.frombuffer(raw, "<u2" if flag & 2 else "<u4").astype(np.uint32)
    return (None if flag & 1 else doc_id), ids


def write_records(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text") -> None:
    """Shards below `path`/shards/range=R, index at `path`/index."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
                       F.monotonically_increasing_id().alias("seq"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("seq")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        packer = zstandard.ZstdCompressor(level=3)
        held, size = [], 0
        for part in parts:
            ids_of = enc.encode_many(part.column(1).to_pylist())
            for doc_id, ids in zip(part.column(0).to_pylist(), ids_of, strict=True):
                record = frame(serialize(doc_id, np.append(ids, end_id), packer))
                if held and size + len(record) > SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    # Each shard is one row and one file; files of a range are numbered in the order they are written.
    (small_batches(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, "value binary").select(F.spark_partition_id().alias("range"), F.col("value").cast("string"))
     .write.mode("overwrite").partitionBy("range").option("maxRecordsPerFile", 1).option("lineSep", "\n")
     .text(f"{path}/shards"))
    records = cut_lineage(read_records(df.sparkSession, path), "records-read")
    sizes = records.groupBy("range", "file").agg(F.sum("n_tokens").alias("size"))
    # One row per file: the running sum over them is a small table, however many records there are.
    before = sizes.select("range", "file", (F.sum("size").over(Window.orderBy("range", "file")) - F.col("size")).alias("before"))
    (records.join(before, ["range", "file"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within")
     .write.mode("overwrite").parquet(f"{path}/index"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the shards: RECORDS (`within`: ids of the file before it), checksums verified."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for part in parts:
            for name, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                where = regex.search(r"range=(\d+)/part-\d+-.*?c(\d+)(?:\.[a-z]+)*$", name)
                rows, within = [], 0
                for k, (at, data) in enumerate(unframe(blob)):
                    doc_id, ids = deserialize(data, unpacker)
                    rows.append((doc_id, int(where.group(1)), int(where.group(2)), k, at, len(ids),
                                 zlib.crc32(ids.astype("<u4").tobytes()), within))
                    within += len(ids)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                         *(pa.array(c, pa.int64()) for c in cols[3:])],
                        names=["doc_id", "range", "file", "record", "offset", "n_tokens", "ids_crc32", "within"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/shards")
    return small_batches(files.select("path", "content")).mapInArrow(run, RECORDS)


def read_back(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per record, from the index the shards gave: id, start, n_tokens, ids_crc32."""
    index = spark.read.parquet(f"{path}/index")
    return index.select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """The index in a seeded random order (column `draw`): which range, file and offset to read next."""
    return spark.read.parquet(f"{path}/index").withColumn("draw", F.xxhash64(F.lit(seed), "range", "file", "record")).orderBy("draw")
