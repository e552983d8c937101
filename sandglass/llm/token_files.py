"""Token-ID files (operator 5): byte-level BPE ids in Simple-8b blocks, written and read back through Spark.

Documents are range-partitioned by doc_id; each task tokenizes its range in order, appends the end id
to each document and writes blocks of whole documents. A block is a binary record with a header (see ``pack``): document ids and
lengths, Simple-8b words, escapes, and per ``STRIDE`` words the place of the next id, so that readers start at any
stride; a checksum covers it all. Shards are tasks, and blocks of a shard are rows of a table in the shared folder, which only
serves as the container. Reading starts anywhere: a block needs the ids before its shard (a sum over shards) and before itself
in it, and a document in a block only the strides that hold its ids (``read_ids``).

Tokenization is the tokenizers library's. Its splitter never crosses a single space or newline between two
other characters, so texts without other white space are cut there and each distinct piece is encoded once
while it stays in a bounded table; every other text is given to the library whole.

Defined cases: a null text counts as empty and has the end id alone; null ids come first; rows with one id
are ordered by a hash of their text and then by it, equal rows lie side by side; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simple8b
from .bpe_stream import byte_letters
from .common import arrow_schema, ship, stored

END_ID = 0
BLOCK_IDS = 1 << 18
STRIDE = 128
PIECES = 350_000
_TEXTS = 2048
_BYTES = 1 << 23
#: Texts that can't be cut at each space and newline: empty, with white space at an end, doubled, or of another kind.
_UNEVEN = r"\A(?:[ \n]|\z)|[ \n]\z|[ \n]{2}|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A piece of one split: Latin letters, which the splitter keeps together, then a comma or full stop, which it splits off.
_LETTERS = re.compile("(\n?)([a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([.,]?)")
_ENCODERS: dict = {}


class PieceEncoder:
    """Ids of texts by the tokenizers library, distinct pieces encoded once while they stay in the table.

    A piece is a word after a single space, or a newline and the word after it. Texts are cut into pieces and numbered by
    Arrow, a batch at once; only a batch's distinct pieces are looked up. Missing words of Latin letters (a comma or full
    stop may follow) are a split of their own and go to the library's model as such; other missing pieces are joined as they
    stand in texts. Both are encoded many at once and told apart by the tokens that begin with the space or are the newline.
    """

    def __init__(self, path: str, limit: int = PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.splits = Tokenizer(self.tok.model)  # the model alone, for splits that are already made
        self.splits.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        names = self.tok.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(names.values()) < 1 << 16 else np.uint32
        self.newline = names["\u010a"]
        self.opens = np.zeros(max(names.values()) + 1, dtype=bool)
        self.opens[[self.newline, *(i for t, i in names.items() if t.startswith("\u0120"))]] = True
        self.end_marks = {c: np.array([names[c]], self.kind).tobytes() for c in ".,"}
        self.letters = str.maketrans({chr(b): x for b, x in enumerate(byte_letters()) if chr(b) not in " \n"})
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of pieces into the table."""
        table, plain, joined, marked = self.table, {}, [], []
        for piece in pieces:
            if not _LETTERS.fullmatch(piece):
                joined.append(piece)
                continue
            if piece[-1] in self.end_marks:
                marked.append(piece)
                piece = piece[:-1]
            if piece not in table:
                plain[piece] = None
        plain = list(plain)
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            text = (" " + " ".join(part)).encode().decode("latin-1").translate(self.letters)
            text = text.replace(" \n", "\n").replace(" ", " \u0120").replace("\n", " \u010a ")
            self._put(part, np.array(self.splits.encode_batch_fast([text[1:]], add_special_tokens=False)[0].ids, self.kind))
        for at in range(0, len(joined), 1024):
            part = joined[at : at + 1024]
            self._put(part, self.ids("".join([p if p[0] == "\n" else " " + p for p in part])))
        table.update((p, table[p[:-1]] + self.end_marks[p[-1]]) for p in marked)

    def _put(self, pieces: list[str], ids: np.ndarray) -> None:
        """The ids of joined pieces into the table, cut at opening tokens."""
        width = self.kind().itemsize
        cuts = (np.flatnonzero(self.opens[ids]) * width).tolist()
        raw = ids.tobytes()
        if len(cuts) == len(pieces):
            self.table.update((p, raw[a:b]) for p, a, b in zip(pieces, cuts, [*cuts[1:], len(raw)]))
        else:  # some piece has an opening token inside: each is encoded alone
            self.table.update((p, self.ids(p if p[0] == "\n" else " " + p).tobytes()) for p in pieces)

    def look_up(self, pieces: list[str]) -> list[bytes]:
        if len(self.table) > self.limit:  # frequent pieces come back from the older table
            self.older, self.table = self.table, {}
        table, older = self.table, self.older
        got = list(map(table.get, pieces))
        gaps = [i for i, g in enumerate(got) if g is None]
        unknown = []
        for i in gaps:
            if (known := older.get(pieces[i])) is None:
                unknown.append(pieces[i])
            else:
                table[pieces[i]] = known
        self.learn(unknown)
        for i in gaps:
            got[i] = table[pieces[i]]
        return got

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        """The ids of each text; nulls count as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = pc.match_substring_regex(texts, _UNEVEN)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        own = iter(self._even(texts.filter(pc.invert(odd))))
        return [self.ids(t.as_py()) if whole else next(own) for t, whole in zip(texts, odd.to_pylist())]

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts with single spaces and newlines between words and no other white space."""
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        edges = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        known = self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, data = pa.array(known, pa.large_binary()).take(coded.indices).buffers()
        all_ids = np.frombuffer(data, self.kind)
        cuts = (np.frombuffer(ends, np.int64)[edges - edges[0]] // self.kind().itemsize).tolist()
        return [all_ids[a + 1 : b] for a, b in zip(cuts, cuts[1:])]  # no newline stands before a text


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


BLOCKS = "shard int, block int, before long, n_ids long, n_docs int, payload binary"
#: Of a block: magic, version, words of a stride, ids, documents, bytes of the sections, checksum of these.
HEADER = struct.Struct("<4sHHQI6II")
MAGIC, VERSION = b"S8TK", 1


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: HEADER, then doc ids, bits of null ids, lengths (Simple-8b), words, escapes and places of the strides."""
    words, escapes = simple8b.encode(ids)
    sections = [
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.packbits(np.array([i is None for i in doc_ids])).tobytes(), simple8b_bytes(lengths.astype(np.uint64)),
        words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), simple8b.offsets(words, STRIDE).astype("<u4").tobytes(),
    ]
    body = b"".join(sections)
    return HEADER.pack(MAGIC, VERSION, STRIDE, len(ids), len(doc_ids), *map(len, sections), zlib.crc32(body)) + body


class Block:
    """A packed block opened for reading."""

    def __init__(self, payload: bytes, check: bool = True):
        magic, version, self.stride, self.n_ids, n_docs, *sizes, checksum = HEADER.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block of this version")
        body = memoryview(payload)[HEADER.size :]
        if check and zlib.crc32(body) != checksum:
            raise ValueError("token block is damaged")
        cuts = np.cumsum([0, *sizes])
        ids, gone, lengths, words, escapes, places = (body[a:b] for a, b in zip(cuts, cuts[1:]))
        self.words, self.escapes, self.places = np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"), np.frombuffer(places, "<u4")
        null = np.unpackbits(np.frombuffer(gone, np.uint8))[:n_docs]
        self.doc_ids = [None if g else i for i, g in zip(np.frombuffer(ids, "<i8").tolist(), null)]
        self.lengths = simple8b.decode(np.frombuffer(lengths, "<u8"), np.empty(0, np.uint64), n_docs).astype(np.int64)

    def read_ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from the ``first`` on; only the strides that hold them are decoded."""
        if count <= 0:
            return np.empty(0, np.uint64)
        a = int(np.searchsorted(self.places, first, "right")) - 1
        b = int(np.searchsorted(self.places, first + count, "left"))
        skip = first - int(self.places[a])
        return simple8b.decode(self.words[a * self.stride : b * self.stride], self.escapes, skip + count)[skip:]

    def documents(self, sections: int = 64) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc id, its ids) in order, decoded ``sections`` strides at a time and never as a whole."""
        held, at = np.empty(0, np.uint64), 0
        stops = [*self.places[sections::sections].tolist(), self.n_ids]
        for name, size in zip(self.doc_ids, self.lengths.tolist()):
            parts = [held]
            have = len(held)
            while have < size:
                stop = stops.pop(0)
                parts.append(self.read_ids(at, stop - at))
                have += stop - at
                at = stop
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield name, held[:size]
            held = held[size:]


def slices(batch: pa.RecordBatch, rows: int = _TEXTS, size: int = _BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows or bytes of text in column 1 at most, a row at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The stored table of blocks."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        target = arrow_schema(BLOCKS)
        enc = encoder(tokenizer)
        ids: list = []
        held: list[np.ndarray] = []
        waiting = block = before = 0

        def close() -> pa.RecordBatch:
            nonlocal waiting, block, before
            all_ids = np.concatenate(held)
            payload = pack(ids, np.array([len(h) for h in held]), all_ids)
            row = [shard, block, before, len(all_ids), len(ids), payload]
            before += len(all_ids)
            block += 1
            waiting = 0
            ids.clear()
            held.clear()
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

        for batch in batches:
            for part in slices(batch):
                for i, found in zip(part.column(0).to_pylist(), enc.encode(part.column(1))):
                    ids.append(i)
                    held.append(np.append(found, np.array(end_id, found.dtype)))
                    waiting += len(held[-1])
                    if waiting >= block_ids:
                        yield close()
        if ids:
            yield close()

    # the hash of the text keeps rows of one id, null ids too, from falling into one range
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return stored(ordered.mapInArrow(run, BLOCKS), "token-blocks")


def simple8b_bytes(values: np.ndarray) -> bytes:
    """Lengths are small numbers of ids too: Simple-8b words without escapes (a length has under 60 bits)."""
    return simple8b.encode(values)[0].astype("<u8").tobytes()


def read_token_files(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    ship(blocks.sparkSession)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                block, at = Block(row["payload"]), row["base"] + row["before"]
                starts, sums = [], []
                for _, ids in block.documents():
                    starts.append(at)
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (block.doc_ids, starts, block.lengths.tolist(), sums)], schema=target)

    # one row a shard, and shards are shuffle partitions: their number is set, not grown with the data
    return blocks.join(F.broadcast(bases), "shard").mapInArrow(run, schema)


def read_documents(blocks: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents: other blocks are passed by, and of theirs only the strides asked for are decoded."""
    ship(blocks.sparkSession)
    names = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                block = Block(payload)
                ends = np.cumsum(block.lengths)
                found = [(i, block.read_ids(int(e - n), int(n)).astype(np.int64)) for i, n, e in zip(block.doc_ids, block.lengths, ends) if i in names]
                yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([x.tolist() for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.select("payload").mapInArrow(run, "doc_id long, ids array<long>")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer))


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Where the vocabulary lies: spark.sandglass.tokenizers if set, else the installed package's folder."""
    folder = spark.conf.get("spark.sandglass.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
