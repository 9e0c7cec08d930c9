"""Documents staged as compressed blocks, and exchanges of packed arrays between them.

A block is a few MB of whole documents (or one document that alone has more). What blocks have to
tell each other travels as packs: one row for each block and hash partition with a packed array,
already reduced within the block, so a value that a third of the corpus holds is sent once a block.
The number of hash partitions follows the bytes of the input, so each stays of bounded size.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, cut, pick, utf8, written


@functools.lru_cache(1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def squeeze(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + _codec().compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return _codec().decompress(memoryview(data)[8:], struct.unpack_from("<q", data)[0], asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, with their types and lengths, as compressed bytes."""
    head = [struct.pack("<i", len(arrays))]
    head += [struct.pack("<4sq", a.dtype.str.encode(), len(a)) for a in arrays]
    return squeeze(b"".join(head + [_planes(np.ascontiguousarray(a)).tobytes() for a in arrays]))


def _planes(a: np.ndarray) -> np.ndarray:
    """First bytes of all numbers, then second ones and so on: high bytes alike are next to each other."""
    return a if a.itemsize == 1 else a.view(np.uint8).reshape(-1, a.itemsize).T


def unpack(data: bytes) -> list[np.ndarray]:
    raw = unsqueeze(data)
    (n,) = struct.unpack_from("<i", raw)
    kinds = [struct.unpack_from("<4sq", raw, 4 + 12 * i) for i in range(n)]
    at, out = 4 + 12 * n, []
    for kind, length in kinds:
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        part = np.frombuffer(raw, np.uint8, dtype.itemsize * length, at)
        out.append((part if dtype.itemsize == 1 else np.ascontiguousarray(part.reshape(dtype.itemsize, length).T).reshape(-1)).view(dtype))
        at += dtype.itemsize * length
    return out


@dataclass
class Block:
    """ids: of the documents, NO_ID for null. null: whether they are. starts: len(ids) + 1 offsets into data."""

    ids: np.ndarray
    null: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    others: bytes

    @classmethod
    def of(cls, payload: bytes) -> Block:
        ids, null, sizes, data, others = unpack(payload)
        return cls(ids, null, np.concatenate([[0], np.cumsum(sizes)]), data, others.tobytes())

    def named(self) -> pa.Array:
        """The ids, nulls again null."""
        return pa.array(self.ids, mask=self.null)

    def carried(self) -> dict[str, pa.Array]:
        """The further columns that staged() was given."""
        batch = pa.ipc.open_stream(self.others).read_next_batch()
        return dict(zip(batch.schema.names, batch.columns, strict=True))

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]


def staged(docs: DataFrame, block_bytes: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, n_bytes, payload): all documents as blocks, written once to the shared folder, with columns to carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in cut([batch], "text", block_bytes):
                texts = utf8(part.column(1))
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                data = b"".join(texts)
                others = b""
                if carry:
                    out = pa.BufferOutputStream()
                    kept = pa.record_batch([pa.concat_arrays([part.column(2 + i)]) for i in range(len(carry))], list(carry))
                    with pa.ipc.new_stream(out, kept.schema) as stream:
                        stream.write_batch(kept)
                    others = out.getvalue().to_pybytes()
                payload = pack(ids, null, np.fromiter(map(len, texts), np.int64, len(texts)), np.frombuffer(data, np.uint8), np.frombuffer(others, np.uint8))
                yield pa.RecordBatch.from_pydict({"block": pa.array([number]), "n_bytes": pa.array([len(data)]), "payload": pa.array([payload])})
                number += 1

    rows = pick(docs, "doc_id", "text", *carry).mapInArrow(run, "block long, n_bytes long, payload binary")
    return written(rows, compression="none")


def parts_for(blocks: DataFrame, bytes_each: int) -> int:
    """Hash partitions for what blocks exchange."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(8, -(-total // bytes_each))


def packs(blocks: DataFrame, make: Callable[[int, Block], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(part, block, pack): what make(block number, block) yields for each hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _rows(number, make(number, Block.of(payload.as_py())))

    return blocks.select("block", "payload").mapInArrow(run, "part int, block long, pack binary")


def _rows(number: int, made: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    made = list(made)
    return pa.RecordBatch.from_pydict(
        {"part": pa.array([p for p, _ in made], pa.int32()), "block": pa.array([number] * len(made), pa.int64()), "pack": pa.array([x for _, x in made], pa.binary())}
    )


def met(sent: DataFrame, answer: Callable[[list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(part, block, pack): answers to blocks from all packs of a hash partition together."""

    def run(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        made = list(answer(rows["block"].to_pylist(), rows["pack"].to_pylist()))
        return pa.table(
            {"part": pa.array([key[0].as_py()] * len(made), pa.int32()), "block": pa.array([b for b, _ in made], pa.int64()), "pack": pa.array([x for _, x in made], pa.binary())}
        )

    return sent.groupBy("part").applyInArrow(run, "part int, block long, pack binary")


def returned(blocks: DataFrame, answers: DataFrame, finish: Callable[[int, Block, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """What finish(number, block, {part: answer}) makes of each block and the answers to it."""

    def run(key: tuple[pa.Scalar], mine: pa.Table, got: pa.Table) -> pa.Table:
        if not mine.num_rows:
            raise RuntimeError("answers to a block that is not there")
        told = dict(zip(got["part"].to_pylist(), got["pack"].to_pylist(), strict=True))
        return finish(key[0].as_py(), Block.of(mine["payload"][0].as_py()), told)

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
