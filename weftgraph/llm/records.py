"""Token-ID output as length-delimited binary records with a separate offset index.

A file is a run of frames. A frame is::

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of payload | 0x0A

all little-endian. A payload is ``i64 doc_id, u8 flags, u32 n, ids``: flag 1
says that the doc_id is null, flag 2 that ids take two bytes each (a vocabulary
under 65,536), else four. Files are written by Spark's own committer to any
file system it knows; the index is a Parquet table with one row per record.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, materialize, partitions_for, table, text_or_empty

#: Id appended to each document.
END_ID = 2
#: Estimated bytes of input storage for one output file; the estimate is low by about half, since text outweighs the other columns.
SHARD_BYTES = 10_000_000
#: Records of one file at most: a reader holds a whole file, and range partitions may be larger than planned.
FILE_RECORDS = 20_000
#: Distinct words whose ids a worker keeps, about.
MEMO_WORDS = 1_000_000
MEMO_CHARS = 40
#: Stands between words that are encoded together; a token of its own.
MARK = "\x00"


def mask(crc: int) -> int:
    """Rotate right by 15 and add a constant, so that checksums of data that hold checksums stay sound."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", mask(zlib.crc32(head))) + payload + struct.pack("<I", mask(zlib.crc32(payload))) + b"\n"


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at ``at`` and where the next frame starts; ValueError if a checksum differs."""
    data = memoryview(data)
    head = data[at : at + 8]
    n, crc = struct.unpack_from("<QI", data, at)
    if crc != mask(zlib.crc32(head)):
        raise ValueError(f"length at {at} is damaged")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != mask(zlib.crc32(payload)):
        raise ValueError(f"record at {at} is damaged")
    return payload, at + 17 + n


def pack(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    return struct.pack("<qBI", doc_id or 0, (doc_id is None) | 2 * narrow, len(ids) // (2 if narrow else 4)) + ids


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, flags, n = struct.unpack_from("<qBI", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", n, 13)


class WordEncoder:
    """Ids of whole texts, for tokenizers that never join characters across a blank.

    Such a tokenizer's ids of a text are those of its blank-separated words in
    order. Words go to the library many at a time; the ids of short ones are
    kept as bytes. When the memo is full, the words of the last batch stay.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.narrow = self.tok.get_vocab_size(with_added_tokens=True) <= 65_536
        self.memo: dict[str, bytes] = {"": b""}
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.folds = all(ids(a) == ids(b) for a, b in (("Quartz", "quartz"), ("\u00c9T\u00c9", "\u00e9t\u00e9"), ("it's, x9. ", "it's , x9 . ")))
        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix")
        self.closes: np.ndarray | None = None
        if suffix:
            self.closes = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
            self.closes[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u2" if self.narrow else "<u4").tobytes()

    def _runs(self, words: list[str], between: str, cut_at: Callable[[np.ndarray], tuple[list[int], list[int]]], run: int = 500) -> dict[str, bytes]:
        """Ids of ``words``, encoded ``run`` at once with ``between`` between them; words of runs that do not come apart are missing."""
        found: dict[str, bytes] = {}
        width = 2 if self.narrow else 4
        parts = [words[k : k + run] for k in range(0, len(words), run)]
        for part, e in zip(parts, self.tok.encode_batch_fast([between.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2" if self.narrow else "<u4")
            begin, end = cut_at(ids)
            if len(begin) == len(part):
                data = ids.tobytes()
                found.update(zip(part, [data[x * width : y * width] for x, y in zip(begin, end, strict=True)], strict=True))
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word. Words of letters end with their one token that closes a word; others have a mark between them."""

        def at_ends(ids: np.ndarray) -> tuple[list[int], list[int]]:
            end = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            return [0, *end[:-1]], end

        def at_marks(ids: np.ndarray) -> tuple[list[int], list[int]]:
            cut = np.flatnonzero(ids == self.mark)
            return [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)]

        found = self._runs([w for w in words if w.isalpha()], " ", at_ends) if self.closes is not None else {}
        found |= self._runs([w for w in words if w not in found and MARK not in w], f" {MARK} ", at_marks)
        for w in words:
            if w not in found:
                found[w] = self._bytes(self.tok.encode(w, add_special_tokens=False).ids)
        return found

    def words(self, text: str) -> list[str]:
        """Pieces of ``text`` whose ids, in order, are those of the text.

        Where the tokenizer folds case, a text of Latin-1 characters is lowered
        first (no rule there depends on a neighbour), and full stops and commas
        at a word's end stand apart unless another mark touches them.
        """
        if self.folds:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                text = text.lower()
                if not _TOUCHING(text):
                    text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.words, texts))
        words = set().union(*split)
        memo = self.memo
        ask = list(words.difference(memo))
        memo.update(self.encode_words(ask))
        out = [b"".join(map(memo.__getitem__, w)) for w in split]
        if len(memo) > MEMO_WORDS:
            self.memo = {w: memo[w] for w in words}
        elif ask:
            for w in ask:
                if len(w) > MEMO_CHARS:
                    del memo[w]
        return out


#: A mark right before a full stop or comma.
_TOUCHING = re.compile(r"(?:[^\w\s]|_)[.,]").search

_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Tokenize ``docs`` (doc_id, text) into record files under ``path``, in ascending doc_id over files and within them.

    Null texts are empty (the end id alone); a null doc_id comes first; rows
    that repeat a doc_id are all written, ordered by text, and may lie in
    several files; a text of any length is one record; extra columns are not
    read, whatever their names; an empty table gives no records.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        enc = encoder(tokenizer)
        end = enc._bytes([end_id])
        for b in batches:
            yield {"frame": [frame(pack(d, ids + end, enc.narrow))[:-1] for d, ids in zip(b["doc_id"], enc.encode(b["text"]), strict=True)]}

    base = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("nth"))
    n = shards or partitions_for(docs.select("doc_id", "text"), SHARD_BYTES)
    # rows of one doc_id may be many: the front of the text and a number of the row part them in the same order
    ordered = base.repartitionByRange(n, "doc_id", F.substring("text", 1, 32), "nth").select("doc_id", "text").sortWithinPartitions("doc_id", "text")
    frames = arrow_map(ordered, run, "frame binary")
    # the text writer ends each row with the last byte of the frame
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _place(name: str) -> int:
    """Order of a file among those of a folder: its task's number, then its number within the task."""
    part, nth = re.search(r"part-(\d+)(?:.*-c(\d+))?", name.rsplit("/", 1)[1]).groups()
    return int(part) << 32 | int(nth or 0)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, from a read of all files: one row per record, with its start among its file's ids."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                shard = _place(name)
                rows: dict[str, list] = {k: [] for k in ("doc_id", "shard", "file", "offset", "length", "start_in_shard", "n_tokens", "ids_crc32")}
                at = start = 0
                while at < len(data):
                    payload, after = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    for k, v in zip(rows, (doc_id, shard, name, at, after - at, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        rows[k].append(v)
                    at, start = after, start + len(ids)
                yield rows

    files = spark.read.format("binaryFile").load(path).select("path", F.expr("content"))
    return arrow_map(files, run, "doc_id long, shard long, file string, offset long, length long, start_in_shard long, n_tokens long, ids_crc32 long")


def with_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``: ids of all records before. The window is over files, not records."""
    per = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(per, "shard").withColumn("start", F.col("_before") + F.col("start_in_shard")).drop("_before")


def read_records(index: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the records that ``index`` lists, in any order or selection.

    Only the listed files are opened (their names, not their records, go
    through the driver, as Spark's own listing of files does), and only the
    listed offsets are decoded. An empty index gives no rows.
    """
    spark = index.sparkSession
    wanted = index.select("file", "offset")
    names = [r["file"] for r in wanted.select("file").distinct().collect()]
    if not names:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    files = spark.read.format("binaryFile").load(names).select(F.col("path").alias("file"), "content")
    per = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for data, offsets in zip(b["content"], b["offsets"], strict=True):
                for k in range(0, len(offsets), 1000):
                    got = [unpack(unframe(data, at)[0]) for at in offsets[k : k + 1000]]
                    yield {"doc_id": [d for d, _ in got], "ids": [ids.tolist() for _, ids in got]}

    return arrow_map(files.join(per.hint("shuffle_hash"), "file").select("content", "offsets"), run, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as records, then index them from the files; the index has ``start`` over the whole corpus."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    write_records(docs, path, tokenizer or default_tokenizer())
    return with_starts(materialize(scan_records(spark, path), "records-index"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
