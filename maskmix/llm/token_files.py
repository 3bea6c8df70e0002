"""Token ids in fixed-width bit-packed segments, written in id order and read back.

A segment holds the ids of consecutive documents.  Its payload is a header (magic, version, width,
ids per block, number of ids, number of blocks), one byte offset per block, and the blocks: every id
takes the bits of the largest vocabulary id, 64 ids take ``width`` 64-bit words, so whole blocks
are packed and unpacked by shifts over numpy columns, and any id range touches its blocks only.
Segments are rows of a Parquet table, so they live in every store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import partition_bases, regroup, texts_of
from maskmix.llm.tokens import encoder

BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 20
#: Bytes of text encoded at once; the more, the more of its words are the same.
ENCODED_BYTES = 8_000_000
_HEADER = struct.Struct("<4sHHIQI")
_MAGIC = b"MXTK"
#: Widths that are whole numbers of a machine's, and their types.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The payload of a segment; ``block_ids`` is a multiple of 64."""
    blocks = -(-len(ids) // block_ids)
    offsets = np.arange(blocks, dtype="<u8") * (block_ids // 64 * width * 8) + _HEADER.size + 8 * blocks
    head = _HEADER.pack(_MAGIC, 1, width, block_ids, len(ids), blocks) + offsets.tobytes()
    if width in _WHOLE:  # ids side by side are their bits side by side
        padded = np.zeros(blocks * block_ids, dtype=_WHOLE[width])
        padded[: len(ids)] = ids
        return head + padded.tobytes()
    columns = np.zeros((blocks * block_ids // 64, 64), dtype=np.uint64)
    columns.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(columns), width), dtype=np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= columns[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= columns[:, j] >> np.uint64(64 - shift)
    return head + words.astype("<u8").tobytes()


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment, decoding only the blocks they lie in."""
    magic, version, width, block_ids, n, blocks = _HEADER.unpack_from(payload)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a token segment of version 1")
    stop = n if stop is None else min(stop, n)
    if stop <= start:
        return np.zeros(0, dtype=np.uint32)
    first, last = start // block_ids, (stop - 1) // block_ids
    offsets = np.frombuffer(payload, dtype="<u8", count=blocks, offset=_HEADER.size)
    count = (last + 1 - first) * (block_ids // 64) * width
    if width in _WHOLE:
        held = np.frombuffer(payload, dtype=_WHOLE[width], count=count * 64 // width, offset=int(offsets[first]))
        return held[start - first * block_ids : stop - first * block_ids].astype(np.uint32)
    words = np.frombuffer(payload, dtype="<u8", count=count, offset=int(offsets[first])).reshape(-1, width)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((len(words), 64), dtype=np.uint32)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, at + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out.reshape(-1)[start - first * block_ids : stop - first * block_ids]


SEGMENT_COLUMNS = "__part int, segment int, first long, n_ids long, counts array<int>, payload binary"


def _write_segments(batches, tokenizer_path: str, end_id: int, segment_ids: int):
    tokens = encoder(tokenizer_path)
    width = width_for(max(tokens.vocabulary(), end_id + 1))
    end = np.array([end_id], dtype="<u4").tobytes()
    part, segment, first, id_type = 0, 0, 0, None
    keys: list = []
    held: list[bytes] = []
    size = 0

    def close():
        ids = np.frombuffer(b"".join(held), dtype="<u4")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([segment], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int32())),
                pa.array([pack(ids, width)], pa.binary()),
                pa.array([keys], pa.list_(id_type)),
            ],
            names=["__part", "segment", "first", "n_ids", "counts", "payload", "keys"],
        )

    for batch in regroup(batches, "__text", ENCODED_BYTES):
        part = batch.column(batch.schema.get_field_index("__part"))[0].as_py()
        ids_of = batch.column(batch.schema.get_field_index("__id")).to_pylist()
        id_type = batch.schema.field("__id").type
        for key, raw in zip(ids_of, tokens.encode(texts_of(batch, "__text"))):
            keys.append(key)
            held.append(raw + end)
            size += len(raw) // 4 + 1
            if size >= segment_ids:
                yield close()
                segment, first = segment + 1, first + size
                keys, held, size = [], [], 0
    if held:
        yield close()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending order of ``id_col``.

    Texts move once, by range of the id; each task tokenises its range in order and keeps one
    segment in memory.  A missing text is empty, missing ids come first, rows of one id are
    ordered by text.
    """
    kind = docs.schema[id_col].dataType
    ordered = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .repartitionByRange("__id")
        .sortWithinPartitions("__id", "__text")
        .withColumn("__part", F.spark_partition_id())
    )
    schema = f"{SEGMENT_COLUMNS}, keys array<{kind.simpleString()}>"
    step = partial(_write_segments, tokenizer_path=tokenizer_path, end_id=end_id, segment_ids=segment_ids)
    map_arrow(ordered, step, schema).write.mode("overwrite").parquet(path)


def _read_segments(batches, with_ids: bool):
    for batch in batches:
        for row in range(batch.num_rows):
            cell = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: E731,B023
            raw = unpack(cell("payload").as_buffer().to_pybytes()).astype("<u4")
            counts = np.array(cell("counts").as_py(), dtype=np.int64)
            ends = np.cumsum(counts)
            starts = ends - counts
            view = memoryview(raw.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            keys = cell("keys").values
            out = [
                keys,
                pa.array(starts + cell("first").as_py() + cell("__base").as_py(), pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["__id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                out.append(pa.ListArray.from_arrays(offsets, pa.array(raw.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)


def read_token_files(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``id_col, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    stored = spark.read.parquet(path)
    bases = partition_bases(stored.select("__part", "n_ids"), "__part", "n_ids", "__base")
    placed = stored.join(F.broadcast(bases), "__part")
    kind = stored.schema["keys"].dataType.elementType.simpleString()
    schema = f"__id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_arrow(placed, partial(_read_segments, with_ids=with_ids), schema).withColumnRenamed("__id", id_col)
