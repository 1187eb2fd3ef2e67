"""Token ids in files: frequency-ranked ids, byte-aligned codes, control bytes apart from data.

Documents are dealt to shards by ranges of ``doc_id`` and tokenised once, in order. Ids are then counted
over all documents and ranked, the most frequent first. A rank is written in as few bytes as hold it (one
to four); control bytes of four 2-bit lengths each stand in a column of their own, so a block of ids is
decoded by table lookups and sums, without a loop over ids.

Documents read from files that are in order already, such as a mix sorted by training position, are tokenised in that
order where they are read, without moving: a file is a shard, a block is named by the row that it starts with.

A file row is a block of whole documents: shard, block, the documents' ids and lengths, control bytes, data
bytes. Order is (shard, block). The folder also holds the rank table. All files go through Spark's writer, whose
commit keeps one copy of what retried tasks write.

What reaches the driver is the count of each id: as many rows as the vocabulary has. Null ids come first;
a null text is empty and still gets its end id; equal ids are ordered by their texts, so equal rows are
interchangeable; an empty table gives an empty folder listing; long texts are tokenised in pieces between
which no token can reach, whole in effect. Further columns stay out of the way.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hazelake.llm.common import handed, whole_text, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 18
BATCH_BYTES = 1 << 21
#: bytes of texts or of blocks that a task hands to Python at a time, and about what a file's row group has
HANDED = 1 << 23
CACHED_WORDS = 300_000
LONG_WORD = 64
CACHED_TAILS = 10_000
#: marks in ASCII but the apostrophe, which may belong to letters
MARKS = string.punctuation.replace("'", "")

_RAW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("file", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()),
])
_RAW_DDL = "shard int, block long, file string, doc_ids array<bigint>, lengths array<bigint>, ids binary"
_CODED_DDL = "shard int, block long, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"

#: writers hold a row group and readers up to 4,096 of its rows, here blocks of a megabyte; sizes are looked at after every
#: block, rows are limited as well because ids that repeat take little room in files and all of it in memory
ROW_GROUPS = {"parquet.block.size": str(HANDED), "parquet.block.row.count.limit": str(HANDED // (4 * BLOCK_IDS)), "parquet.page.size.row.check.min": "1"}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------ text to ids
def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(others)}


class _Generation(dict):
    """Ids of words; one that is missing comes from the generation before, or is encoded."""

    def __init__(self, encode, before: dict):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word) or self.encode(word)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class WordTokenizer:
    """Ids of texts, word by word, with the ids of words that come again kept.

    The file's added tokens come first, as in the library: texts are cut at them, each gives its own id, and what
    stands between two is encoded as a text of its own.

    The pre-tokenizer starts a new token at a space unless white space stands in front of it, and no merge
    reaches over that. So texts are cut there and each piece is encoded once. Where a space is followed by
    more white space, a stricter cut is used: only at spaces behind something else. A line feed without
    other white space beside it, save one space behind it, is a token of its own, so texts are cut there too.

    Pieces are keyed by what they begin with: a line feed that was cut at, white space that belongs to the piece
    and is encoded as it stands, or anything else, which follows a space. Plain letters are one pre-token,
    punctuation behind them another, and both go to the library's model as they are; other pieces go
    through its pre-tokenizer first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if given["normalizer"] or given["pre_tokenizer"]["type"] != "ByteLevel" or given["model"]["type"] != "BPE":
            raise ValueError(f"not a byte-level BPE tokenizer: {path}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in given["model"]["merges"]]
        added = [t for t in given.get("added_tokens", ()) if t["content"]]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens that do not match as they stand: {path}")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.merge = models.BPE(vocab=given["model"]["vocab"], merges=merges, cache_capacity=0).tokenize
        self.letters = _byte_letters()
        self.space = chr(self.letters[0x20])
        self.known = _Generation(self.encode_piece, {})
        self.tails: dict[str, bytes] = {}
        self.feed = self._ids(chr(self.letters[0x0A]))
        self.odd = re.compile(r" \s")
        self.odd_feed = re.compile(r"\n(?:[^\S ]|(?<=\s\n)| \Z)")
        self.cut = re.compile(r"(?<=\S) ")
        # letters of the first blocks, on which all versions of Unicode agree; no apostrophe, which may belong to letters
        self.plain = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch

    def _ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._ids(marks)
            if len(self.tails) < CACHED_TAILS and len(marks) <= LONG_WORD:
                self.tails[marks] = ids
        return ids

    def encode_piece(self, piece: str, space: str = " ") -> bytes:
        if piece.isascii():  # most pieces: letters, then marks
            letters = piece.rstrip(MARKS)
            if letters.isalpha():
                if len(letters) == len(piece):
                    return self._ids(self.space + piece if space else piece)
                return (self.known[letters] if space else self._ids(letters)) + self._tail(piece[len(letters):])
        if space and piece[:1] == "\n":
            return self.feed + self.encode_piece(piece[1:], "")
        m = self.plain(piece)
        if m is None:
            if piece[:1].isspace():
                space = ""
            return b"".join([self._ids(s) for s, _ in self.split(space + piece)])
        letters, tail = m.groups()
        if tail:
            return (self.known[letters] if space else self.encode_piece(letters, "")) + self._tail(tail)
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return self._ids(self.space + shown if space else shown)

    def pieces(self, text: str) -> list[str]:
        """The first piece, which follows nothing, and the keys of the others."""
        if text.isascii():
            odd = any(x in text for x in ("  ", " \n", " \t", " \r")) or any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f")
        else:
            odd = self.odd.search(text)
        if odd:
            first, *others = self.cut.split(text)
            return [first, *(" " + p if p[:1].isspace() else p for p in others)]
        if "\n" in text and not self.odd_feed.search(text):
            text = text.replace("\n", " \n")
        return text.split(" ")

    def segments(self, text: str) -> list[str]:
        """The text cut at added tokens, each of which is a segment."""
        if not any(token in text for token in self.added):
            return [text]
        return [s for s in self.at_added(text) if s]

    def _encode_segment(self, text: str) -> bytes:
        if text in self.added:
            return self.added[text]
        pieces = self.pieces(text)
        first = self.encode_piece(pieces.pop(0), "")
        if len(self.known) > CACHED_WORDS:
            older = self.known
            older.before = {}  # two generations at a time, neither of them copied
            self.known = _Generation(self.encode_piece, older)
        return first + b"".join(map(self.known.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Native-endian 32-bit ids of each text."""
        return [b"".join(map(self._encode_segment, self.segments(text))) for text in texts]

    def encode_long(self, text: str) -> bytes:
        """Ids of a long text, encoded in pieces; added tokens stay whole."""
        pieces = (p for s in self.segments(text) for p in ([s] if s in self.added else parts(s)))
        return b"".join(map(self._encode_segment, pieces))


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def forget() -> None:
    """Give back what this worker keeps for tokenising, once all texts are tokenised."""
    _LOADED.clear()


def parts(text: str, size: int = BATCH_BYTES) -> Iterator[str]:
    """A long text in pieces of about ``size`` that start at a space behind a word."""
    at = 0
    for m in re.finditer(r"(?<=\S) ", text) if len(text) > size else ():
        if m.start() - at >= size:
            yield text[at:m.start()]
            at = m.start()
    yield text[at:]


def _blocks(path: str, end_id: int, block_ids: int):
    """Batches of (doc_id, text) in order to blocks of ids; of (doc_id, text, file, place) to blocks of rows that follow each other."""

    def run(batches):
        from pyspark import TaskContext

        shard, words = TaskContext.get().partitionId(), loaded(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        state = {"block": 0, "file": None, "next": None, "held": 0, "ids": [], "docs": [], "lengths": []}

        def flush():
            out = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([state["block"]], pa.int64()), pa.array([state["file"]], pa.string()),
                pa.array([state["docs"]], pa.list_(pa.int64())), pa.array([state["lengths"]], pa.list_(pa.int64())),
                pa.array([b"".join(state["ids"])], pa.binary()),
            ], schema=_RAW)
            state.update(block=state["block"] + 1, held=0, ids=[], docs=[], lengths=[])
            return out

        def encoded(group):
            short = iter(words.encode([t for _, t, _ in group if len(t) <= BATCH_BYTES]))
            for doc, text, at in group:
                ids = next(short) if len(text) <= BATCH_BYTES else words.encode_long(text)
                yield doc, ids + end, at

        def groups():
            group, size = [], 0
            for batch in batches:
                at = zip(*[batch.column(i).to_pylist() for i in (2, 3)]) if batch.num_columns > 2 else [None] * batch.num_rows
                for doc, text, place in zip(batch.column(0).to_pylist(), batch.column(1), at):
                    text = text.as_py()
                    group.append((doc, text, place))
                    size += len(text)
                    if size >= BATCH_BYTES:
                        yield group
                        group, size = [], 0
            yield group

        for group in groups():
            for doc, ids, at in encoded(group):
                if at and at != state["next"]:  # another file, or rows between that another task reads
                    if state["docs"]:
                        yield flush()
                    state.update(file=at[0], block=at[1])
                elif at and not state["docs"]:
                    state["block"] = at[1]
                state["next"] = at and (at[0], at[1] + 1)
                state["docs"].append(doc)
                state["lengths"].append(len(ids) // 4)
                state["ids"].append(ids)
                state["held"] += len(ids) // 4
                if state["held"] >= block_ids:
                    yield flush()
        if state["docs"]:
            yield flush()

    return run


# ------------------------------------------------------------------ ids to bytes and back
def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[:len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


#: lengths of the four numbers of each control byte
LENGTHS = (1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)).astype(np.uint8)
#: bits kept of four bytes, by length
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    four = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        four |= padded[starts + k].astype(np.uint32) << (8 * k)
    return four & MASKS[lengths]


def _counts(batches):
    forget()
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for ids in batch.column(0):
            here = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
            if len(here) > len(total):
                here[:len(total)] += total
                total = here
            else:
                total[:len(here)] += here
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["id", "n"])


def _coder(rank_of: np.ndarray):
    """Blocks of ids to coded blocks, one at a time."""

    def run(batches):
        forget()
        for batch in batches:
            for block in map(batch.slice, range(batch.num_rows), [1] * batch.num_rows):
                control, data = encode_ranks(rank_of[np.frombuffer(block.column(4)[0].as_buffer(), "<u4")])
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:4], pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                    names=["shard", "block", "doc_ids", "lengths", "control", "data"],
                )

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, column: str = "text", block_ids: int = BLOCK_IDS, as_stored: bool = False) -> None:
    """Tokenise all documents into ``folder``, in order of their ids or, ``as_stored``, of the files that they are read from."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    own = [F.col("doc_id").cast("long").alias("doc_id"), whole_text(column).alias("text")]
    if as_stored:
        ordered = docs.select(*own, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    else:
        tie = F.xxhash64("text")
        ordered = docs.select(*own).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    with handed(spark, HANDED):
        raw = written(ordered.mapInArrow(_blocks(path, end_id, block_ids), _RAW_DDL), "token-ids", compression="zstd", **ROW_GROUPS)
    counts = raw.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    with handed(spark, HANDED):
        held = sorted(((-r.n, r.id) for r in counts.collect()))  # a row per id of the vocabulary
    rank_of = np.zeros(max((i for _, i in held), default=0) + 1, dtype="<u4")
    rank_of[[i for _, i in held]] = np.arange(len(held))
    ranks = spark.createDataFrame([(r, int(i), int(-n)) for r, (n, i) in enumerate(held)], "rank int, id int, n long")
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    if as_stored:
        files = raw.select("file").distinct()  # as many as tasks that wrote them
        number = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
        ranked = files.select("file", (F.row_number().over(Window.orderBy(number, "file")) - 1).alias("shard"))
        raw = raw.drop("shard").join(F.broadcast(ranked), "file")
    raw = raw.select("shard", "block", "doc_ids", "lengths", "ids")
    with handed(spark, HANDED):
        raw.mapInArrow(_coder(rank_of), _CODED_DDL).write.options(compression="zstd", **ROW_GROUPS).parquet(f"{folder}/ids")


_DOCUMENT_DDL = "doc_id long, shard int, block long, start long, n_tokens long, ids_crc32 long"


def _decoder(id_of: np.ndarray, with_ids: bool):
    """Blocks back to a row per document: doc_id, shard, block, start in the block, length, checksum and, if asked for, ids."""
    names = ["doc_id", "shard", "block", "start", "n_tokens", "ids_crc32", "ids"][:7 if with_ids else 6]

    def run(batches):
        for batch in batches:
            for block in map(batch.slice, range(batch.num_rows), [1] * batch.num_rows):
                row = block.to_pylist()[0]
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                whole = memoryview(id_of[decode_ranks(row["control"], row["data"], int(ends[-1]))].astype("<u4").tobytes())
                own = [whole[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(own), pa.int32()), pa.array([row["block"]] * len(own), pa.int64()), pa.array(starts),
                    pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of the folder: doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit), which may be left out."""
    blocks = spark.read.schema(_CODED_DDL).parquet(f"{folder}/ids")
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # a row per id of the vocabulary
    id_of = np.zeros(max(len(ranks), 1), dtype="<u4")
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    own = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.select("shard", "block", own.alias("n"))  # a row per block
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", earlier(Window.orderBy("shard")).alias("offset"))  # a row per shard
    placed = sizes.select("shard", "block", earlier(Window.partitionBy("shard").orderBy("block")).alias("inside")).join(shards, "shard")
    docs = blocks.mapInArrow(_decoder(id_of, with_ids), _DOCUMENT_DDL + ", ids binary" * with_ids)
    start = (F.col("offset") + F.col("inside") + F.col("start")).alias("start")
    return docs.join(placed, ["shard", "block"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, with_ids=False)
