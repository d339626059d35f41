"""Token ids in binary files: encode, write in order of document, read back.

Ids are numbered by falling frequency over the whole corpus, so frequent ones are small
numbers, and numbers are stored in one to four whole bytes each. Lengths stand apart from
the bytes: two bits for each number, four to a control byte. A table gives the four lengths
of a control byte, so a block is decoded by a few numpy look-ups without a loop.

A file is a run of blocks, each of at most BLOCK_TOKENS ids or of one longer document: a
header of four unsigned 64-bit numbers (documents, ids, control bytes, data bytes), the
documents' ids (signed 64-bit), whether they are known (one byte each), their numbers of ids
(unsigned 64-bit), the control bytes (each document begins a new one) and the data bytes.
The manifest, a table, has a row for each block: its file, its place there, and the number
of ids of all blocks before it. Everything is little-endian.

Documents are dealt by ranges of doc_id, ties by size, checksum and row number, so equal
doc_ids are dealt out too. A file is written under a name of its own for each attempt of a
task and only counts if the manifest has it: lost executors leave no half files that are read.

Defined results: a null text is an empty one, whose only id is the end mark; every row is a
document of its own, even if its doc_id repeats; null doc_ids come first; an empty table
gives an empty manifest and no file; other columns are left behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import text, units
from lodeweave.llm.shared import discard, shared_dir, tidy, written

END_ID = 0
#: Ids of one block, and blocks of one file, at most.
BLOCK_TOKENS, FILE_BLOCKS = 1 << 20, 64
#: Units that a worker remembers; beyond it starts afresh.
CACHE_UNITS = 1_000_000

_state: dict[str, object] = {}
_LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)
_BYTES = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
MANIFEST = "file string, part int, seq long, place long, n_docs long, n_tokens long"


class Encoder:
    """Ids of texts by units, each unit encoded once."""

    def __init__(self, path: str):
        self.tokenizer, entries = units.byte_tokenizer(path, plain_specials=False)
        self.size = np.array([len(e) for e in entries], np.int64)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.units, self.flat, self.used = text.Strings(), np.zeros(1 << 16, np.uint32), 0
        self.start, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def group(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn (uint32), and the rows' n + 1 offsets among them."""
        whole = units.aside(buf, offs)
        data = buf.tobytes()
        if any(s in data for s in self.special):
            whole |= np.array([any(s in data[a:b] for s in self.special) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
        starts, ends, rows = units.cut(buf, offs, marks=True)
        plain = np.repeat(~whole, np.diff(rows))
        if self.units.n > CACHE_UNITS:
            self.clear()

        def learn(first: np.ndarray, last: np.ndarray) -> None:
            ids, sizes = units.split_up(self.encode, lambda t: self.encode([t])[0], self.size, buf, first, last)
            k = self.units.n - len(sizes)
            self.flat, self.start, self.n = text.grown(self.flat, self.used + len(ids)), text.grown(self.start, self.units.n), text.grown(self.n, self.units.n)
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[k : self.units.n], self.n[k : self.units.n] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)

        numbers = self.units.numbers(buf, starts[plain], ends[plain], learn)
        ids = self.flat[text.ragged(self.start[numbers], self.n[numbers])]
        counts = np.zeros(len(offs) - 1, np.int64)
        np.add.at(counts, np.repeat(np.arange(len(counts)), np.diff(rows))[plain], self.n[numbers])
        if whole.any():
            parts, at = [], 0
            for i, n in enumerate(counts.tolist()):
                if whole[i]:
                    parts.append(np.array(self.encode([data[offs[i] : offs[i + 1]].decode()])[0], np.uint32))
                    counts[i] = len(parts[-1])
                else:
                    parts.append(ids[at : at + n])
                    at += n
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(counts)])


def _encoder(path: str) -> Encoder:
    if _state.get("path") != path:
        _state.update(path=path, encoder=Encoder(path))
    return _state["encoder"]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, crc, ids) of every document: its ids with the end mark, as little-endian unsigned 16-bit or 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        kind = "<u2" if len(encoder.size) <= 1 << 16 else "<u4"
        for batch in batches:
            for lo, hi, buf, offs in text.groups(batch.column("text"), 4 * text.CHUNK_BYTES):
                ids, ends = encoder.group(buf, offs)
                own = [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                crc = [zlib.crc32(x.astype("<u4")) for x in own]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(ends) + 1), pa.array(crc, pa.int64()), pa.array([x.astype(kind).tobytes() for x in own], pa.binary())], ["doc_id", "n", "crc", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, crc long, ids binary")


def _ids(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ids of all rows in turn."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u2" if len(data) == 2 * int(n.sum()) else "<u4")


def frequencies(rows: DataFrame) -> np.ndarray:
    """The ids by falling frequency over all rows of `encoded`, ties by id. At most one row for each entry of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(_ids(batch.column("ids"), batch.column("n").to_numpy()))
            total, here = (here, total) if len(here) > len(total) else (total, here)
            total[: len(here)] += here
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    found = rows.select("n", "ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(found, key=lambda r: (-r.n, r.id))], np.uint32)


def packed(numbers: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents' numbers, and how many of each a document has."""
    numbers = numbers.astype("<u4")
    length = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    controls = -(-sizes // 4)
    first = np.cumsum(controls) - controls
    codes = np.zeros(4 * int(controls.sum()), np.uint8)
    codes[text.ragged(4 * first, sizes)] = length - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    sums = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    borders = np.concatenate([[0], np.cumsum(sizes)])
    return control.astype(np.uint8).tobytes(), data.tobytes(), controls, np.diff(sums[borders])


def unpacked(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of documents with so many each, from their control bytes and data bytes."""
    controls = -(-sizes // 4)
    first = np.cumsum(controls) - controls
    length = _LENGTHS[control].reshape(-1)[text.ragged(4 * first, sizes)]
    padded = np.zeros(len(data) + 4, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    return at[np.cumsum(length) - length] & _BYTES[length]


def _block(docs: list[tuple]) -> bytes:
    """The bytes of one block from (doc_id, n, control, data)."""
    ids = np.array([d[0] or 0 for d in docs], "<i8").tobytes() + np.array([d[0] is not None for d in docs], np.uint8).tobytes() + np.array([d[1] for d in docs], "<u8").tobytes()
    control, data = b"".join(d[2] for d in docs), b"".join(d[3] for d in docs)
    return np.array([len(docs), sum(d[1] for d in docs), len(control), len(data)], "<u8").tobytes() + ids + control + data


def read_block(file: object, place: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, sizes, numbers) of the block that begins at `place` of an open file."""
    file.seek(place)
    docs, _, control, data = np.frombuffer(file.read(32), "<u8").tolist()
    rest = np.frombuffer(file.read(17 * docs + control + data), np.uint8)
    ids, known = rest[: 8 * docs].view("<i8").tolist(), rest[8 * docs : 9 * docs].tolist()
    sizes = np.frombuffer(rest[9 * docs : 17 * docs].tobytes(), "<u8").astype(np.int64)
    numbers = unpacked(rest[17 * docs : 17 * docs + control], rest[17 * docs + control :], sizes)
    return [i if k else None for i, k in zip(ids, known, strict=True)], sizes, numbers


def write(docs: DataFrame, path: str, folder: str) -> tuple[DataFrame, np.ndarray]:
    """Write all documents' ids as files in `folder` (shared, by any scheme that Arrow knows); the manifest, and the ids by rank."""
    rows = written(encoded(docs, path), "encoded")
    ranked = frequencies(rows)
    rank = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    # The size of the vocabulary bounds it.
    sent = rows.sparkSession.sparkContext.broadcast(rank)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            control, data, a, b = packed(sent.value[_ids(batch.column("ids"), n)], n)
            a, b = np.concatenate([[0], np.cumsum(a)]).tolist(), np.concatenate([[0], np.cumsum(b)]).tolist()
            columns = [pa.array([x[i:j] for i, j in zip(p[:-1], p[1:], strict=True)], pa.binary()) for x, p in ((control, a), (data, b))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "crc", "row")), *columns], ["doc_id", "n", "crc", "row", "control", "data"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        file, name, made, held, tokens = None, "", [], [], 0

        def flush() -> tuple:
            nonlocal file, name, held, tokens, seq
            if file is None:
                name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
                file = system.open_output_stream(f"{root}/{name}")
            place = file.tell()
            file.write(_block(held))
            row = (name, part, seq, place, len(held), tokens)
            held, tokens, seq = [], 0, seq + 1
            if seq % FILE_BLOCKS == 0:
                file.close()
                file = None
            return row

        for batch in batches:
            for d in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "control", "data")), strict=True):
                if held and tokens + d[1] > BLOCK_TOKENS:
                    made.append(flush())
                held.append(d)
                tokens += d[1]
        if held:
            made.append(flush())
        if file is not None:
            file.close()
        if made:
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    order = ["doc_id", "n", "crc", "row"]
    coded = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidy(code), "doc_id long, n long, crc long, row long, control binary, data binary")
    manifest = written(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(save), MANIFEST), "manifest")
    discard(rows)
    return with_starts(manifest), ranked


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the number of ids of all blocks before; parts' totals (one row for each task that wrote) are summed up apart."""
    from pyspark.sql import Window

    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in parts:
        rows.append((r.part, before))
        before += r.n
    first = manifest.sparkSession.createDataFrame(rows, "part int, before long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("start", within).join(F.broadcast(first), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read(manifest: DataFrame, ranked: np.ndarray, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents of the files: ids as little-endian unsigned 32-bit numbers."""
    sent = manifest.sparkSession.sparkContext.broadcast(ranked)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, place, start in zip(*(batch.column(c).to_pylist() for c in ("file", "place", "start")), strict=True):
                with system.open_input_file(f"{root}/{name}") as file:
                    doc_ids, sizes, numbers = read_block(file, place)
                data = sent.value[numbers].astype("<u4").tobytes()
                ends = np.concatenate([[0], np.cumsum(sizes)])
                own = [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends[:-1]), pa.array(sizes), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = manifest.select("file", "place", "start").repartition("file", "place")
    return blocks.mapInArrow(tidy(load), "doc_id long, start long, n_tokens long, ids binary")


def through_files(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from files that are written and read back."""
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    manifest, ranked = write(docs, path, folder)
    return read(manifest, ranked, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
