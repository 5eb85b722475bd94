"""Token-ID files (operator 8): flat unsigned integers plus 64-bit document offsets, written and memory-mapped in tasks.

A set of files is a folder with, for each part k: part-k.ids, the token ids of its documents one after
another, unsigned little-endian, 16-bit where the vocabulary allows and else 32-bit; part-k.off, n + 1
signed 64-bit offsets in ids of the part's documents; part-k.doc, n signed 64-bit doc_ids. Documents
are in ascending doc_id over all parts, null ids first. A part's base, the number of ids in the parts
before it, is a prefix sum over the part totals.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.llm.common import ready, shared_dir, whole, written

END_ID = 1
MEMO_MOST = 400_000  #: encoded chunks, and encoded pieces, that a worker remembers
LONG = 64  #: characters of the longest chunk that is remembered
PIECE = 1 << 22  #: chunks encoded, and bytes of ids held, at a time
_encoders: dict[str, tuple] = {}

#: Characters whose pieces are found here, not by the library: printable ones of the Latin blocks that need no
#: normalising but lower-casing, each to one character. An encoder checks all of them against the library first.
_PLAIN = "".join(chr(c) for c in range(0x20, 0x250) if chr(c).isprintable() and c != 0x130)


class _Memo(dict):
    """Makes what is missing and remembers it while there is room; what is known stays."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(self) < MEMO_MOST and len(key) <= LONG:
            self[key] = got
        return got


class Encoder:
    """Encodes texts with a tokenizers file. Texts are cut at spaces and line ends, which no token of the
    file may span, chunks into the pieces that the file's own pre-tokenizer makes, and each different piece
    is encoded once by its model. Pieces of plain Latin chunks are found by one pattern. Both short cuts are held
    against the library on sample texts when the file is read, and left out if it does otherwise."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        added = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(added) or "(?!)").search
        self.splitter, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.plain = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]*").fullmatch
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        for self.cuts, self.pattern in ((True, True), (True, False), (False, False)):
            self.pieces, self.chunks = _Memo(self._piece), _Memo(self._chunk)
            if not self.cuts or self.splitter and self._as_library():
                break

    def _as_library(self) -> bool:
        samples = ["It's a Test,  of\n\ncuts: don't 12 ß ñ!\tx", " lead and tail ", "a\n", "e ́ x y <|endoftext|> z", "I'LL we've\r\n'd", "日本 가é x\x85y"]
        samples += [_PLAIN, " ".join(_PLAIN), *(f"a{c}{c}1'{c}S" for c in _PLAIN)]
        return [e.ids for e in self.tokenizer.encode_batch(samples, add_special_tokens=False)] == [np.frombuffer(b"".join(self.encode(s)), self.dtype).tolist() for s in samples]

    def _piece(self, piece: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ascii_ = chunk.isascii() and chunk.isprintable()
        plain = self.pattern and (ascii_ or self.plain(chunk) is not None)
        if plain and chunk.isalpha():
            found = [chunk.lower()]
        elif self.special(chunk):
            return self._whole(chunk)
        elif plain:
            found = self.find(chunk.lower())
        else:
            found = [p for p, _ in self.splitter.pre_tokenize_str(self.normalize(chunk))]
        if plain and not ascii_:
            found = [p.encode().decode("latin-1").translate(_BYTE_NAMES) for p in found]
        return b"".join(map(self.pieces.__getitem__, found))

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> list[bytes]:
        """The ids of a text as bytes, in pieces."""
        if not text:
            return []
        if not self.cuts:
            return [self._whole(text)]
        chunks = text.replace("\n", " ").split(" ")
        return [b"".join(map(self.chunks.__getitem__, chunks[at : at + PIECE])) for at in range(0, len(chunks), PIECE)]


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level pieces: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


_BYTE_NAMES = _byte_names()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _write_part(batches: Iterator[pd.DataFrame], folder: str, vocabulary: str) -> Iterator[pd.DataFrame]:
    """Streams a part's documents, in order, into files of their own name; a rerun of the task writes others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    enc, part = encoder(vocabulary), TaskContext.get().partitionId()
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    docs, total, nulls, width, last = 0, 0, 0, enc.dtype.itemsize, np.array([END_ID], dtype=enc.dtype).tobytes()
    ids, off, doc = (fs.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "off", "doc"))
    try:
        off.write(np.zeros(1, "<i8").tobytes())
        for pdf in batches:
            ends, held, size = [], [], 0
            for text in pdf["text"]:
                got = [*enc.encode(text), last]
                held += got
                size += sum(map(len, got))
                ends.append(total + size // width)
                if len(held) > 500 or size > PIECE:
                    ids.write(b"".join(held))
                    total, held, size = total + size // width, [], 0
            ids.write(b"".join(held))
            total += size // width
            off.write(np.array(ends, "<i8").tobytes())
            doc.write(pdf["doc_id"].to_numpy().astype("<i8").tobytes())
            docs, nulls = docs + len(pdf), nulls + int(pdf["doc_id_null"].sum())
    finally:
        for f in (ids, off, doc):
            f.close()
    if docs:
        yield pd.DataFrame({"part": [part], "path": [f"{folder}/{name}"], "docs": [docs], "nulls": [nulls], "ids": [total], "width": [width]})


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Writes doc_id, text of docs as token files; returns the parts: part, path, docs, nulls, ids, width, base.

    Null and empty texts are the end id alone. Rows with one doc_id each have their place, by a hash of the text, then text.
    """
    spark = docs.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "tokens")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("o"), "text")  # a null or repeated doc_id may have rows in many parts
    dealt = keyed.repartitionByRange("doc_id", "o").sortWithinPartitions("doc_id", "o", "text").select(*whole("doc_id"), "text")
    parts = dealt.mapInPandas(lambda it: _write_part(it, folder, vocabulary), "part int, path string, docs long, nulls long, ids long, width int")
    parts = written(parts, "parts")  # a row per part: read again, never written again
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def mapped(uri: str) -> memoryview:
    """A file as memory-mapped bytes where the store is a local one, else read once."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).size:
        return memoryview(pa.memory_map(path).read_buffer())
    with fs.open_input_file(path) as f:
        return memoryview(f.read_buffer())


def _read_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for p in pdf.itertuples():
            ids = np.frombuffer(mapped(f"{p.path}.ids"), f"<u{p.width}")
            off = np.frombuffer(mapped(f"{p.path}.off"), "<i8")
            doc = np.frombuffer(mapped(f"{p.path}.doc"), "<i8")
            for at in range(0, len(doc), 10_000):
                to = min(at + 10_000, len(doc))
                crc = [zlib.crc32(ids[off[k] : off[k + 1]].astype("<u4").tobytes()) for k in range(at, to)]
                who = pd.array(doc[at:to], dtype="Int64")
                if p.nulls > at:
                    who[: p.nulls - at] = pd.NA
                yield pd.DataFrame({"doc_id": who, "start": p.base + off[at:to], "n_tokens": off[at + 1 : to + 1] - off[at:to], "ids_crc32": crc})


def read_tokens(parts: DataFrame) -> DataFrame:
    """The documents in a set of token files: doc_id, start, n_tokens, ids_crc32; parts as write_tokens gives them."""
    ready(parts.sparkSession)
    dealt = parts.repartition(max(1, parts.count()), "part")
    return dealt.mapInPandas(_read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text, ...) as token files and reads them back. Other columns are ignored; an empty table gives no rows."""
    return read_tokens(write_tokens(docs, vocabulary, folder))
