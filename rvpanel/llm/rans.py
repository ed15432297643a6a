"""Token ids written as interleaved rANS blocks, and read back block by block.

One static table of id frequencies, taken over all documents and scaled to a power of two,
serves every block.  A record holds whole documents in ascending ``doc_id`` order; its ids
are cut into blocks, each coded by ``LANES`` interleaved 64-bit states, so a block can be
decoded alone and many blocks side by side as vectors.

File format: a folder of Parquet files with one row per record
``(shard, record, shard_start, n_tokens, doc_index, payload)``.  Shards follow the order of
``doc_id``, records the order inside a shard; ``shard_start`` counts the ids of the shard
before the record.  ``doc_index`` is ``doc_id`` (int64; the smallest int64 stands for null) and
length (uint32) of each document.  ``payload``, all little-endian:

    magic "RANS0001", block length, number of blocks, number of ids    (8 bytes, 3 x uint64)
    checkpoint of each block: word offset uint64, words uint32, crc32 of words, crc32 of ids
    final states of each block: LANES x uint64
    words of all blocks: uint32

The table is stored beside the records (``table`` folder, one row).  Spark writes and reads
all of it, so any store that Spark reaches will do.

Edge cases: null and empty texts hold the end id only; a repeated ``doc_id`` keeps one entry a row,
neighbours in the order of their texts; a null ``doc_id`` comes first; an empty table gives
no rows.  Texts are encoded whole; a document never leaves its record, however long.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rvpanel.llm import words as W
from rvpanel.llm.tasks import on_executors, partition_id, sent, text_slices
from rvpanel.sources.store import materialize, release, shared_folder

SCALE_BITS = 20
LANES = 32
#: Ids in a block, the unit of decoding.
BLOCK_IDS = 1 << 14
#: A record is closed when it holds this many ids.
RECORD_IDS = 1 << 21

_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_MAGIC = b"RANS0001"
_NULL_ID = -(1 << 63)


class Table:
    """Scaled frequencies of ids: every id has at least 1 of ``2**SCALE_BITS``."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        if not 0 < n <= 1 << (SCALE_BITS - 1):
            raise ValueError(f"a table holds 1 to {1 << (SCALE_BITS - 1)} ids")
        total = 1 << SCALE_BITS
        share = (counts.astype(np.float64) + 1e-9) / (counts.sum() + 1e-9 * n)
        freq = 1 + np.floor(share * (total - n)).astype(np.int64)
        freq[int(np.argmax(freq))] += total - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(n, dtype=np.uint32), freq)


def _lanes(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """ids as (step, block x lane) with the number of ids in each block."""
    blocks = max(1, -(-len(ids) // block))
    padded = np.zeros(blocks * block, np.uint32)
    padded[: len(ids)] = ids
    sizes = np.full(blocks, block, np.int64)
    sizes[-1] = len(ids) - (blocks - 1) * block
    grid = padded.reshape(blocks, block // LANES, LANES).transpose(1, 0, 2).reshape(block // LANES, blocks * LANES)
    return grid, sizes


def encode(ids: np.ndarray, table: Table, block: int = BLOCK_IDS) -> bytes:
    """Payload of the ids (uint32)."""
    grid, sizes = _lanes(ids, block)
    steps, width = grid.shape
    blocks = len(sizes)
    # Lane l of a block holds ids l, l + LANES, ...: the last block may be shorter.
    depth = (sizes[:, None] - np.arange(LANES)[None, :] + LANES - 1).clip(0) // LANES
    depth = depth.reshape(-1)
    full = int(depth.min())
    state = np.full(width, _LOW, np.uint64)
    shift = np.uint64(63 - SCALE_BITS)
    words, owners = [], []
    for step in range(steps - 1, -1, -1):
        on = slice(None) if step < full else np.flatnonzero(depth > step)
        sym = grid[step][on]
        if not len(sym):
            continue
        x, f = state[on], table.freq[sym]
        over = x >= f << shift
        if over.any():
            at = np.flatnonzero(over)
            words.append((x[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owners.append((at if step < full else on[at]).astype(np.int32))
            x[at] >>= _32
        q = x // f
        state[on] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + table.start[sym]
    if words:
        # The decoder takes words from first to last step, lanes in order: reverse the steps only.
        word = np.concatenate(words[::-1])
        owner = np.concatenate(owners[::-1]) // LANES
        order = np.argsort(owner, kind="stable")
        word, per_block = word[order], np.bincount(owner, minlength=blocks)
    else:
        word, per_block = np.zeros(0, np.uint32), np.zeros(blocks, np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_block)])
    raw, id_bytes = word.astype("<u4"), ids.astype("<u4")
    out = [_MAGIC, struct.pack("<3Q", block, blocks, len(ids))]
    for b in range(blocks):
        mine = raw[offsets[b] : offsets[b + 1]].tobytes()
        check = zlib.crc32(id_bytes[b * block : b * block + sizes[b]].tobytes())
        out.append(struct.pack("<QIII", offsets[b], per_block[b], zlib.crc32(mine), check))
    out += [state.astype("<u8").tobytes(), raw.tobytes()]
    return b"".join(out)


def decode(payload: bytes, table: Table, only: list[int] | None = None) -> list[np.ndarray]:
    """ids of each block (of the blocks ``only`` names), checked against its checksums."""
    if payload[:8] != _MAGIC:
        raise ValueError("not an rANS payload")
    block, blocks, total = struct.unpack_from("<3Q", payload, 8)
    at = 32
    marks = np.frombuffer(payload, np.dtype([("at", "<u8"), ("n", "<u4"), ("words", "<u4"), ("ids", "<u4")]), blocks, at)
    at += marks.nbytes
    states = np.frombuffer(payload, "<u8", blocks * LANES, at).reshape(blocks, LANES)
    at += states.nbytes
    words = np.frombuffer(payload, "<u4", offset=at)
    sizes = np.full(blocks, block, np.int64)
    sizes[-1] = total - (blocks - 1) * block
    picked = np.arange(blocks) if only is None else np.array(only, np.int64)
    for b in picked:
        if zlib.crc32(words[marks["at"][b] : marks["at"][b] + marks["n"][b]].tobytes()) != marks["words"][b]:
            raise ValueError(f"block {b}: damaged words")
    x = states[picked].reshape(-1).astype(np.uint64)
    depth = ((sizes[picked][:, None] - np.arange(LANES)[None, :] + LANES - 1).clip(0) // LANES).reshape(-1)
    steps, full = int(depth.max(initial=0)), int(depth.min(initial=0))
    read = marks["at"][picked].astype(np.int64)
    grid = np.zeros((steps, len(x)), np.uint32)
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    owner = np.repeat(np.arange(len(picked)), LANES)
    for step in range(steps):
        on = slice(None) if step < full else np.flatnonzero(depth > step)
        part = x[on]
        slot = part & mask
        sym = table.symbol[slot]
        grid[step][on] = sym
        part = table.freq[sym] * (part >> bits) + slot - table.start[sym]
        low = np.flatnonzero(part < _LOW)
        if len(low):
            own = owner[low] if step < full else owner[on[low]]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(own)))
            rank = np.arange(len(own)) - np.repeat(starts, counts)
            part[low] = part[low] << _32 | words[read[own] + rank]
            read[own[starts]] += counts
        x[on] = part
    out = []
    if (x != _LOW).any():
        raise ValueError("states do not return to their start")
    for i, b in enumerate(picked):
        ids = grid[:, i * LANES : (i + 1) * LANES].reshape(-1)[: sizes[b]].copy()
        if zlib.crc32(ids.astype("<u4").tobytes()) != marks["ids"][b]:
            raise ValueError(f"block {b}: damaged ids")
        out.append(ids)
    return out


_memos: dict[tuple, W.IdMemo] = {}


def _encoder(path: str, dtype: str):
    """The process's memo, and what looks up all words of lists in it."""
    W.claim("rans", _memos)
    if (path, dtype) not in _memos:
        _memos[path, dtype] = W.IdMemo(path, dtype)
    memo = _memos[path, dtype]

    def learn(lists):
        for ws in lists:
            for w in ws:
                memo[w]

    return memo, learn


def stage_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, counts binary): each text's ids with the end id, 2 bytes an id where the vocabulary allows, and a
    last row a task without ids that holds how often it met each id."""
    on_executors(docs.sparkSession)

    def run(batches):
        vocabulary = max(W.tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
        dtype, total = W.id_type(vocabulary), np.zeros(vocabulary, np.int64)
        memo, _ = _encoder(tokenizer_path, dtype)
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            out = []
            for _, texts in text_slices(batch):
                memo.room()
                found = [b"".join(map(memo.__getitem__, W.folded(tokenizer_path, t).split())) + end if t else end for t in texts]
                total += np.bincount(np.frombuffer(b"".join(found), dtype), minlength=vocabulary)
                out += found
            ids = batch.column(0).cast(pa.int64())
            yield pa.record_batch({"doc_id": ids, "ids": pa.array(out, pa.binary()), "counts": pa.nulls(len(out), pa.binary())})
        yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def id_counts(counted: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of each id over all documents: the vectors that the tasks counted, added up by id, so only
    ``vocabulary`` rows reach the driver."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), np.int64)
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    counts = np.zeros(vocabulary, np.int64)
    for r in counted.select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> str:
    """Encode the documents and write them in the file format; returns the folder."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/rans-{uuid.uuid4().hex}"
    vocabulary = max(W.tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = W.id_type(vocabulary)
    both = materialize(stage_ids(docs, tokenizer_path, end_id, id_col, text), compression="zstd")
    counts = id_counts(both.where("ids IS NULL"), vocabulary)
    staged = both.where("ids IS NOT NULL").select("doc_id", "ids")
    spark.createDataFrame([(SCALE_BITS, counts.astype("<i8").tobytes())], "scale_bits int, counts binary").coalesce(1).write.parquet(f"{path}/table")
    shipped = sent(spark, counts)

    def run(batches):
        table, shard, record, start = Table(shipped.value), partition_id(), 0, 0
        ids, index, held = [], [], 0

        def row():
            nonlocal record, start, held
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            docs_ = np.array([i for i, _ in index], "<i8").tobytes() + np.array([n for _, n in index], "<u4").tobytes()
            out = pa.record_batch(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "record": pa.array([record], pa.int32()),
                    "shard_start": pa.array([start], pa.int64()),
                    "n_tokens": pa.array([held], pa.int64()),
                    "doc_index": pa.array([docs_], pa.binary()),
                    "payload": pa.array([encode(flat.astype(np.uint32), table)], pa.binary()),
                }
            )
            record, start, held = record + 1, start + held, 0
            ids.clear()
            index.clear()
            return out

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), dtype)
                ids.append(own.copy())
                index.append((_NULL_ID if doc is None else doc, len(own)))
                held += len(own)
                if held >= RECORD_IDS:
                    yield row()
        if index:
            yield row()

    schema = "shard int, record int, shard_start long, n_tokens long, doc_index binary, payload binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    # Payloads are at their entropy already.
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/records")
    release(both)
    return path


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(spark.read.parquet(f"{path}/table").first()["counts"], "<i8")


def read(spark: SparkSession, path: str, outputs: bool = False) -> DataFrame:
    """Documents of a written folder: ``doc_id, start, n_tokens, ids_crc32`` and with
    ``outputs`` also ``ids array<long>``.

    Starts add the shards before (one row per shard) to the place inside the shard.
    """
    on_executors(spark)
    schema = "shard int, record int, shard_start long, n_tokens long, doc_index binary, payload binary"
    records = spark.read.schema(schema).parquet(f"{path}/records")
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    shipped = sent(spark, read_table(spark, path))

    def run(batches):
        table = None
        for batch in batches:
            table = table or Table(shipped.value)
            for i in range(batch.num_rows):
                first = batch.column(0)[i].as_py()
                raw = batch.column(1)[i].as_py()
                n = len(raw) // 12
                doc_ids, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)
                ids = np.concatenate(decode(batch.column(2)[i].as_py(), table)).astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = {
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL_ID),
                    "start": pa.array(first + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if outputs:
                    out["ids"] = pa.array([ids[e - k : e].astype(np.int64) for e, k in zip(ends, lengths, strict=True)], pa.list_(pa.int64()))
                yield pa.record_batch(out)

    placed = records.join(shards, "shard").select((F.col("before") + F.col("shard_start")).alias("first"), "doc_index", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if outputs else ""))
