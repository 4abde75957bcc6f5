"""Token ids in bit-packed files.

Documents are dealt out by ranges of doc_id, sorted, encoded, given an end id and packed:
each id takes the fewest bits that the vocabulary needs.  A file is a Parquet table with a
row per block of about ``BLOCK_IDS`` ids (whole documents): shard (the writing task, in
doc_id order), block, start (ids of the shard before the block), n_ids, width (bits),
doc_ids and doc_at (each document's first id in the block) and the packed payload.  Ids
``a`` to ``b`` of a block lie in bits ``a * width`` to ``b * width`` (most significant bit
first), so that any document can be unpacked without the rest, by numpy.

Encoding: byte-level BPE never joins what stands before a run of blanks with what follows,
so texts are cut there and each distinct piece is encoded by the tokenizers library once
per worker; the table of pieces (by 64-bit hashes, compared byte by byte) is bounded and emptied when it is full.  A piece is cut by
the vocabulary's published pattern and its parts go straight to the library's BPE model,
which is less than half the work of an encoding with offsets.  A text with blanks beyond
ASCII, with characters that Python's Unicode tables don't know (newer ones, on which the libraries' tables differ) or
with the content of an added token (``<|endoftext|>``, which becomes that token) is encoded as a whole.

Nulls: a null text is empty and has only the end id; null doc_ids come first.  A very long
text is encoded as one and makes a block of its own length.  Rows that
repeat a doc_id stand side by side, in the order of their texts.  Empty tables give empty
files.  Other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_STEP_BYTES, freed_shuffles, scratch, steps, table, text_of
from .words import mix, raw_of, words_of

TOKENIZER, END_ID, VOCABULARY = "byte_bpe_50k.json", 2, 50_257
BLOCK_IDS, PIECES = 1 << 16, 3 << 19
#: Pieces that a new table has room for; it grows with what it holds.
FIRST_PIECES = 1 << 16
BLOCK_SCHEMA = "shard int, block long, start long, n_ids long, width int, doc_ids array<long>, doc_at array<long>, payload binary"

_ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_UNUSUAL = re.compile("[\u0378-\U0010ffff]")  # from the first unassigned character on
_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_NOT_PLAIN = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _letters()
#: Blanks and line feeds part pieces (0); a zero byte stands as 255, which UTF-8 never has.
_PIECES_APART = np.arange(256, dtype=np.uint8)
_PIECES_APART[[0, 10, 32]] = 255, 0, 0
_ASCII_WORD = np.isin(np.arange(256), np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))


def unknown(text: str) -> bool:
    """Whether the text has characters without a category."""
    return not text.isascii() and bool(_UNUSUAL.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


class PieceTable:
    """Ids of pieces by a 64-bit key, in open addressing: numpy looks up a whole batch at once."""

    def __init__(self, limit: int):
        self.limit = limit
        self.mask = (1 << (2 * min(limit, FIRST_PIECES) - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.keys = np.zeros(self.mask + 1, np.uint64)  # 0: free
        self.values = np.zeros(self.mask + 1, np.int32)
        self.flat, self.data = np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, np.uint8)
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.data_start, self.data_length, self.data_used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for none."""
        out = np.full(len(keys), -1, np.int32)
        open_, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            there, wanted = self.keys[slot], keys[open_]
            hit = there == wanted
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (there != 0)
            open_, slot = open_[more], (slot[more] + 1) & self.mask
        return out

    def same(self, at: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether the entries are of the pieces with the bytes ``raw[start:end]``."""
        length = end - start
        if (self.data_length[at] != length).any():
            return False
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return bool((self.data[np.repeat(self.data_start[at], length) + inside] == raw[np.repeat(start, length) + inside]).all())

    def add(self, keys: np.ndarray, ids: list[list[int]], pieces: list[bytes]) -> None:
        """New distinct keys."""
        bytes_ = np.fromiter(map(len, pieces), np.int32, len(pieces))
        while self.data_used + int(bytes_.sum()) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total, entry = int(sizes.sum()), self.n + np.arange(len(keys))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(keys) > len(self.start):
            self.start, self.length, self.data_start, self.data_length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.data_start, self.data_length))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.start[entry], self.length[entry] = self.used + np.cumsum(sizes) - sizes, sizes
        self.data_start[entry], self.data_length[entry] = self.data_used + np.cumsum(bytes_) - bytes_, bytes_
        self.data[self.data_used : self.data_used + int(bytes_.sum())] = np.frombuffer(b"".join(pieces), np.uint8)
        self.n, self.used, self.data_used = self.n + len(keys), self.used + total, self.data_used + int(bytes_.sum())
        if 2 * self.n > self.mask:
            full = self.keys != 0
            keys, entry = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], entry])
            self.mask = (1 << (2 * self.n).bit_length()) - 1
            self.keys, self.values = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of keys for one slot the last one stays
            own = free & (self.keys[slot] == keys)
            self.values[slot[own]] = entry[own]
            keys, entry, slot = keys[~own], entry[~own], (slot[~own] + 1) & self.mask


class Encoder:
    def __init__(self, path: str, limit: int = PIECES):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.table = PieceTable(limit)
        self.newline = np.uint32(self.whole("\n")[0])
        self.marks = {ord(x): np.uint32(self.whole(x)[0]) for x in ".,"}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cut(self, text: str) -> list[str]:
        """Parts of the pattern; for a word, or a word and a stop or comma, without the regular expression."""
        word = text[1:] if text[0] == " " else text
        if word.isalpha():
            return [text]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [text[:-1], word[-1]]
        return self.pattern.findall(text)

    def parts(self, texts: list[str]) -> list[list[int]]:
        """Ids of short texts: the parts of the pattern, each distinct one through the BPE model once."""
        cut, tokenize, known = [self.cut(x) for x in texts], self.model.tokenize, {}
        for x in dict.fromkeys(chain.from_iterable(cut)):
            letters = "Ġ" + x[1:] if x[0] == " " and x.isascii() and x[1:].isalpha() else x.encode().decode("latin-1").translate(_BYTE_LETTERS)
            known[x] = [y.id for y in tokenize(letters)]
        return [known[c[0]] if len(c) == 1 else [i for p in c for i in known[p]] for c in cut]

    def plain(self, text: str) -> bool:
        """Whether single blanks and line feeds part the words."""
        return not (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _NOT_PLAIN)) and (not _ODD_BLANK.search(text) if not text.isascii() else not any(x in text for x in "\x1c\x1d\x1e\x1f"))

    def plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts: a word after a blank, a line feed and a word, or a bare word at the start.

        A stop or comma that ends a word after an ASCII letter or digit is a part of its own.
        """
        array = pa.array(texts, pa.large_string())
        raw, offsets = raw_of(array)
        ends = np.append(_PIECES_APART[raw[1:]] == 0, True)
        ends[offsets[1:] - 1] = True
        marks = np.flatnonzero(((raw == 46) | (raw == 44)) & ends)
        marks = marks[(marks > 0) & _ASCII_WORD[raw[marks - 1]]]
        marks = marks[~np.isin(marks, offsets)]  # what begins a text follows no word
        apart = raw.copy()
        apart[marks] = 32
        w = words_of(pa.LargeStringArray.from_buffers(len(array), pa.py_buffer(offsets), pa.py_buffer(apart)), _PIECES_APART)
        mark = np.zeros(len(raw) + 1, np.uint8)
        mark[marks] = raw[marks]
        mark = mark[w.end]
        first = np.concatenate([[True], w.row[1:] != w.row[:-1]])
        after_line = np.zeros(len(w.key), bool)
        after_line[~first] = w.raw[w.start[~first] - 1] == 10
        bare = first | after_line
        keys = mix(w.key + bare.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
        at = self.table.find(keys)
        if (at < 0).any():
            new, place = np.unique(keys[at < 0], return_index=True)
            if self.table.n + len(new) > self.table.limit and self.table.n:
                self.table.clear()
                new, place = np.unique(keys, return_index=True)
            else:
                place = np.flatnonzero(at < 0)[place]
            data = w.raw.tobytes()
            pieces = [data[a:b] for a, b in zip(w.start[place].tolist(), w.end[place].tolist(), strict=True)]
            self.table.add(new, self.parts([x.decode() if b else " " + x.decode() for x, b in zip(pieces, bare[place].tolist(), strict=True)]), pieces)
            at = self.table.find(keys)
        if not self.table.same(at, w.raw, w.start, w.end):  # pieces with one 64-bit key
            return [np.array(self.whole(x), np.uint32) for x in texts]
        length = self.table.length[at].astype(np.int64)
        size = length + after_line + (mark > 0)
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[begin[after_line]] = self.newline
        for byte, token in self.marks.items():
            ended = mark == byte
            out[(begin + size)[ended] - 1] = token
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(begin + after_line, length) + inside] = self.table.flat[np.repeat(self.table.start[at], length) + inside]
        ends = np.cumsum(np.bincount(w.row, weights=size, minlength=len(texts))).astype(np.int64)
        return np.split(out, ends[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.zeros(0, np.uint32)] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.added) or unknown(text):
                out[i] = np.array(self.whole(text), np.uint32)
            elif self.plain(text):
                plain.append(i)
            elif not text.isascii() and _ODD_BLANK.search(text) or any(x in text for x in "\x1c\x1d\x1e\x1f"):
                out[i] = np.array(self.whole(text), np.uint32)
            else:
                out[i] = np.array([*chain.from_iterable(self.parts(_PIECE.findall(text)))], np.uint32)
        if plain:
            for i, ids in zip(plain, self.plain_ids([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"the id {int(ids.max())} takes more than {width} bits; give the tokenizer's vocabulary size")
    if width == 16:
        return ids.astype(">u2").tobytes()
    if width % 8 == 0:
        return ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width // 8 :].tobytes()
    bits = (ids[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, width: int, first: int, stop: int) -> np.ndarray:
    """Ids ``first`` to ``stop`` (exclusive) of a payload."""
    n = stop - first
    if width == 16:
        return np.frombuffer(payload, ">u2")[first:stop].astype(np.uint32)
    if width % 8 == 0:
        size = width // 8
        cells = np.zeros((n, 4), np.uint8)
        cells[:, 4 - size :] = np.frombuffer(payload, np.uint8)[first * size : stop * size].reshape(n, size)
        return cells.view(">u4").ravel().astype(np.uint32)
    low, high = first * width // 8, -(-stop * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)[low:high])[first * width - low * 8 :][: n * width].reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width - 1, -1, -1, dtype=np.uint32))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, vocabulary: int = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes ``docs`` in ascending doc_id order into ``path``; the tokenizer's file lies at that place on each machine."""
    width = width_of(max(vocabulary, end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer or tokenizer_path())
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs_in: list[int | None] = []
        size = 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids])
            at = ends - [len(x) for x in ids]
            values = [[shard], [block], [start], [size], [width], [docs_in], [at.tolist()], [pack(np.concatenate(ids), width)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for part in steps(batch, limit=SMALL_STEP_BYTES):
                for doc, found in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").to_pylist()), strict=True):
                    ids.append(np.append(found, np.uint32(end_id)))
                    docs_in.append(doc)
                    size += len(found) + 1
                    if size >= block_ids:
                        yield row()
                        block, start = block + 1, start + size
                        ids, docs_in, size = [], [], 0
        if ids:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with freed_shuffles(docs.sparkSession):
        ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # a row per writing task
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"))
    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("start") + F.col("ids_before")).alias("start"), "n_ids", "width", "doc_ids", "doc_at", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = unpack(b["payload"], b["width"], 0, b["n_ids"]).astype("<u4")
                at = np.array(b["doc_at"], np.int64)
                ends = np.append(at[1:], b["n_ids"])
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array(at + b["start"]), pa.array(ends - at), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the rows with this doc_id; only their bits of their blocks are unpacked."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    place = F.filter(F.transform("doc_ids", lambda d, i: F.when(d.eqNullSafe(F.lit(doc_id).cast("long")), i)), lambda i: i.isNotNull())
    found = []
    for b in blocks.withColumn("places", place).where(F.size("places") > 0).orderBy("shard", "block").collect():
        at = [*b["doc_at"], b["n_ids"]]
        found += [unpack(b["payload"], b["width"], at[i], at[i + 1]) for i in b["places"]]
    return found


def token_output(docs: DataFrame) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and describes each document from them."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path)
    return read_documents(docs.sparkSession, path)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
