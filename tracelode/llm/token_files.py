"""Token-id files: documents as compressed id arrays under one shared zstandard dictionary.

A shard file holds, in this order:

* 8 bytes of magic, 1 byte of id width (2 or 4), 32 bytes: the SHA-256 of the dictionary;
* a zstandard frame for each document, made with the dictionary: its ids as little-endian unsigned integers;
* the index: for each document 5 little-endian 64-bit integers: has a doc_id (0 or 1), doc_id, offset of the
  frame, its size, number of ids;
* the footer: number of documents and offset of the index as 64-bit integers, then the magic again.

One document is read by its index entry and one frame. ``dictionary.zdict`` lies beside the shards. Shards are
in ascending doc_id order and within; the manifest, a Parquet table, names the files that count, with the
number of ids before each. A task that is run again writes a file of another name, and only the rows of tasks
that succeeded reach the manifest, so lost executors leave at most unused files.

The dictionary is trained on a bounded sample: about SAMPLE documents chosen by hash of doc_id, less those of
over SAMPLE_CHARS code points. It affects sizes only, never ids.

Defined cases: null or empty text gives the end id alone. Null doc_ids come first. Repeated rows each are a
document; rows of one doc_id are ordered by their frames. An empty table gives no shards. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from string import punctuation as PUNCTUATION

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

MAGIC = b"TLTOKEN1"
HEAD = struct.Struct("<8sB32s")
FOOT = struct.Struct("<QQ8s")
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 2000, 20_000, 64 << 10
#: A Python worker remembers the ids of so many chunks of text, and as many older ones.
MEMORY = 300_000
#: Documents encoded before they are handed on.
ROWS = 256

#: Between two characters that are not white space, a space starts a pre-token of the byte-level pattern.
SEAM = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def _tokenizer(path: str, plain_specials: bool = False):
    """plain_specials: what looks like a special token in a text is ordinary text there, which isn't the library's default."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain_specials
    return t


class _Odd(Exception):
    """A space that has white space or an end of the text beside it."""


def byte_letters() -> str:
    """The letters by which byte-level vocabularies write the 256 bytes: a printable byte is its own letter, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


class _Known(dict):
    """Ids of chunks that follow a space (or, with lead "", nothing), each encoded when it is first met.

    The lead and Latin letters are one pre-token, which goes to the library's model without its pattern.
    Punctuation after the letters is another, and so is a line feed between what is not white space; these are
    put together. All other chunks take the library's whole way.
    """

    def __init__(self, encode, tokenizer, width: int, lead: str = " ") -> None:
        self.encode, self.lead, self.older, self.tails = encode, lead, {}, {}
        self.pieces, self.letters = tokenizer.model.tokenize, byte_letters()
        self.start = self.letters[32] if lead else ""
        self.raw = [i.to_bytes(width, "little") for i in range(tokenizer.get_vocab_size())]
        self.bare = _Known(encode, tokenizer, width, "") if lead else self
        self.feed = encode("\n")

    def __missing__(self, part: str) -> bytes:
        if (out := self.older.get(part)) is not None:
            self[part] = out
            return out
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        if part.isalpha() and (part.isascii() or max(part) < "\u0250"):
            raw, letters = self.raw, part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            self[part] = out = b"".join([raw[x.id] for x in self.pieces(self.start + letters)])
        else:
            self[part] = out = self.mixed(part)
        return out

    def mixed(self, part: str) -> bytes:
        word = part.rstrip(PUNCTUATION)
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            tail = part[len(word) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self.encode(tail)
            return self[word] + self.tails[tail]
        if part.count("\n") == 1:
            above, below = part.split("\n")
            if not above[-1].isspace() and not below[0].isspace():
                return self[above] + self.feed + self.bare[below]
        return self.encode(self.lead + part)


def _apart(token) -> bool:
    """Whether a special token starts with punctuation, has letters and no white space, and leaves what is around it alone: no cut goes through it, and no word or mark is a part of it."""
    s = token.content
    return s[:1] in PUNCTUATION and any(map(str.isalnum, s)) and not any(map(str.isspace, s)) and not (token.lstrip or token.rstrip or token.single_word)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A text is cut where pre-tokens start for certain, so that each chunk has the ids that it has within the
    text, and each distinct chunk is encoded once while it is remembered.
    """

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        self.tokenizer = _tokenizer(path, plain_specials)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        kind, encode = "H" if self.width == 2 else "I", self.tokenizer.encode
        self.encode = lambda text: array(kind, encode(text, add_special_tokens=False).ids).tobytes()
        self.known = _Known(self.encode, self.tokenizer, self.width)
        self.whole = not plain_specials and not all(map(_apart, self.tokenizer.get_added_tokens_decoder().values()))

    def __call__(self, text: str, end: bytes) -> bytes:
        """The ids as unsigned integers of this machine's order, little-endian where Spark runs."""
        if self.whole:
            return self.encode(text) + end
        parts = text.split(" ")
        first = parts[0]
        try:
            if len(parts) > 1 and (not first or first[-1].isspace()):
                raise _Odd
            return self.encode(first) + b"".join(map(self.known.__getitem__, islice(parts, 1, None))) + end
        except _Odd:
            return b"".join(map(self.encode, SEAM.split(text))) + end


@lru_cache(maxsize=1)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """This worker's encoder, kept from task to task."""
    return Encoder(path, plain_specials)


def _end(end_id: int, width: int) -> bytes:
    return end_id.to_bytes(width, "little")


def train(docs: DataFrame, path: str, end_id: int, plain_specials: bool = False) -> bytes:
    """The shared dictionary, or b"" where the sample is too small to make one."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    chosen = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31))) & (F.length("text") <= SAMPLE_CHARS)
    texts = sorted(r[0] for r in docs.filter(chosen).select("text").limit(2 * SAMPLE).collect())
    encode = encoder(path, plain_specials)
    samples = [encode(t, _end(end_id, encode.width)) for t in texts]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # a handful of documents
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def frames(docs: DataFrame, path: str, end_id: int, dictionary: bytes, plain_specials: bool = False, level: int = 1) -> DataFrame:
    """doc_id, n_tokens and the compressed frame of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, d = encoder(path, plain_specials), _dictionary(dictionary)
        press = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
        end = _end(end_id, encode.width)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                raw = [encode(t.as_py(), end) for t in b.column(1).slice(at, ROWS)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS), pa.array([len(x) // encode.width for x in raw], pa.int64()), pa.array([press.compress(x) for x in raw], pa.binary())], names=["doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """One shard file: documents one after another, then the index and the footer."""

    def __init__(self, uri: str, dictionary_digest: bytes, width: int) -> None:
        store, path = _open(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.index, self.at = store.open_output_stream(path), [], HEAD.size
        self.out.write(HEAD.pack(MAGIC, width, dictionary_digest))

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append((doc_id is not None, doc_id or 0, self.at, len(frame), n_tokens))
        self.at += len(frame)

    def close(self) -> tuple[int, int]:
        """The numbers of documents and of ids."""
        self.out.write(np.array(self.index, "<i8").tobytes())
        self.out.write(FOOT.pack(len(self.index), self.at, MAGIC))
        self.out.close()
        return len(self.index), sum(x[4] for x in self.index)


def write_shards(parts: DataFrame, folder: str, dictionary: bytes, width: int, n_shards: int) -> DataFrame:
    """A row (shard, file, n_docs, n_tokens) for each shard written; parts: from ``frames``."""
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        for b in batches:
            if b.num_rows and out is None:
                out = ShardWriter(f"{folder}/{name}", digest, width)
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out.add(*row)
        if out is not None:
            n_docs, n_tokens = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["shard", "file", "n_docs", "n_tokens"])

    ordered = parts.repartitionByRange(n_shards, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame")
    return ordered.select("doc_id", "n_tokens", "frame").mapInArrow(run, "shard long, file string, n_docs long, n_tokens long")


class ShardReader:
    """Documents of one shard file, all or one by one."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        magic, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        n, at, again = FOOT.unpack(self.file.read_at(FOOT.size, self.file.size() - FOOT.size))
        if (magic, again) != (MAGIC, MAGIC):
            raise ValueError(f"{uri} is not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(40 * n, at), "<i8").reshape(n, 5)
        self.unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        _, _, at, size, n = self.index[k].tolist()
        raw = self.unpress.decompress(self.file.read_at(size, at), max_output_size=n * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2, plain_specials: bool = False, n_shards: int | None = None) -> DataFrame:
    """Write docs as token files under folder and return the manifest (shard, file, n_docs, n_tokens, start)."""
    spark = docs.sparkSession
    dictionary = train(docs, path, end_id, plain_specials)
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/dictionary.zdict") as f:
        f.write(dictionary)
    width = encoder(path, plain_specials).width
    parts = c.written(frames(docs, path, end_id, dictionary, plain_specials), "frames")
    n_shards = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_shards(parts, folder, dictionary, width, n_shards).write.parquet(f"{folder}/files")
    # One row for each shard: the window holds few rows.
    files = spark.read.parquet(f"{folder}/files").selectExpr("*", "coalesce(sum(n_tokens) over (order by shard rows between unbounded preceding and 1 preceding), 0) as start")
    files.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document, from the files."""
    store, base = _open(folder)
    with store.open_input_file(f"{base}/dictionary.zdict") as f:
        dictionary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                shard, rows = ShardReader(f"{folder}/{name}", dictionary), []
                starts = start + np.cumsum(shard.index[:, 4]) - shard.index[:, 4]
                for k in range(len(shard)):
                    ids = shard.ids(k)
                    rows.append((int(shard.index[k, 1]) if shard.index[k, 0] else None, int(starts[k]), len(ids), zlib.crc32(ids.astype("<u4"))))
                    if len(rows) == 10_000 or k == len(shard) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []

    files = spark.read.parquet(f"{folder}/manifest").select("file", "start")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = c.fresh_path(spark, "token-files")
    write_token_files(c.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)
