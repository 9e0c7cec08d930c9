"""Documents as sequences of numbered words, one small dictionary a block.

Texts are cut to words once. What a block is goes to a file of its own in the shared folder: document
ids, sequences of word numbers, and its words where they are asked for. Its distinct words meet those
of all other blocks in hash partitions, packed: a word that a block holds a thousand times goes there
once. What is found out about words comes back to the block, which is read again from its file.

A file has the number of its block and a digest of what is in it as its name, and the digest travels
with the words. A task that runs again writes the same file; one that is dealt other rows another
time writes another, and the words it sends lead there.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, pick
from .blocks import pack, unpack
from .files import put, whole
from .repeats import Rolling, _ranges

BLOCK_BYTES, PART_BYTES = 3 << 20, 8 << 20
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, np.uint64)


def kept_by_worker(key, make):
    """make(), once in each Python worker."""
    held = sys.__dict__.setdefault("_fleetloom_kept", {})
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Returns freed memory to the system; else each Python worker holds on to the most it ever had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


@dataclass
class Lexed:
    """ids: of documents, null ones 0. null: whether they are. sizes: their numbers of words. flat: the words' numbers.

    lengths, data: the words by number, frequent ones first, one after the other.
    """

    ids: np.ndarray
    null: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray
    lengths: np.ndarray
    data: np.ndarray

    def parts(self, n: int) -> np.ndarray:
        """The hash partition of each word."""
        ends = np.cumsum(self.lengths, dtype=np.int64)
        return (Rolling(_BYTE[self.data]).some(ends - self.lengths, ends) % np.uint64(n)).astype(np.uint32)


def texts_of(column: pa.Array) -> pa.Array:
    """Whole texts; null is empty. Copied, as kernels of Arrow go wrong on offsets that don't begin at 0."""
    return spell(*spelled(column.cast(pa.large_string()).fill_null(""))).cast(pa.large_string())


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of words in bytes, and the bytes one after the other."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.diff(at).astype(np.uint32), held[at[0] : at[-1]]


def spell(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Words from their lengths and bytes."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def taken(lengths: np.ndarray, data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in another order."""
    ends, sizes = np.cumsum(lengths, dtype=np.int64), lengths[order].astype(np.int64)
    return lengths[order], data[_ranges((ends - lengths)[order], sizes)]


def numbered(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lists of words as the lists' sizes, the words' numbers, and the distinct words by number. Empty words are left out."""
    flat = parts.flatten().dictionary_encode()
    words, sizes = flat.dictionary, pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        real = numbers != empty
        sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(sizes)])])
        numbers = numbers[real]
        numbers -= numbers > empty
        words = words.filter(pc.not_equal(words, ""))
    return sizes, numbers, words


def lexed(ids: pa.Array, texts: pa.Array, lexer: Callable) -> Lexed:
    """Documents as one block. lexer(texts): sizes of documents in words, the words' numbers, the words."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    sizes, flat, words = lexer(texts)
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return Lexed(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), null, sizes, rank[flat], *taken(*spelled(words), order))


def few(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n in as few bytes as they need."""
    return x.astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)


def words_sent(docs: DataFrame, lexer: Callable, parts: int, folder: str, weigh: Callable[[Lexed], np.ndarray] | None = None, keep: bool = False) -> DataFrame:
    """(part, block, digest, pack): the distinct words of each block for each hash partition, with their weights.

    Each block is in a file in folder, with its words if they are to keep. A block without words sends
    an empty pack, so each one is heard of.
    """

    def send(block: int, found: Lexed) -> pa.RecordBatch:
        of, weights = found.parts(parts), weigh(found) if weigh else np.zeros(0, np.uint32)
        words = [found.lengths, found.data]
        mine = [found.ids, found.null, found.sizes.astype(np.uint32), few(found.flat, len(of)), few(of, parts)]
        digest = xxhash.xxh64_intdigest(b"".join(x.tobytes() for x in [*mine, *words])) >> 1
        put(folder, _name(block, digest), [pack(*mine, *(words if keep else []))])
        order = np.argsort(of, kind="stable")
        lengths, data = taken(*words, order)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        cuts = np.flatnonzero(np.diff(of[order], prepend=-1)) if len(of) else np.zeros(0, np.int64)
        packs = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            packs.append(pack(lengths[a:b], data[ends[a] : ends[b]], weights[order[a:b]] if weigh else weights))
        to = of[order[cuts]].astype(np.int32)
        if not packs:
            packs, to = [pack(lengths, data, weights)], np.zeros(1, np.int32)
        n = len(packs)
        return pa.RecordBatch.from_pydict({"part": pa.array(to), "block": pa.array([block] * n, pa.int64()), "digest": pa.array([digest] * n, pa.int64()), "pack": pa.array(packs, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in cut([batch], "text", BLOCK_BYTES):
                made = send(block, lexed(part.column(0), texts_of(part.column(1)), lexer))
                give_back()
                yield made
                block += 1

    return pick(docs, "doc_id", "text").mapInArrow(run, "part int, block long, digest long, pack binary")


def _name(block: int, digest: int) -> str:
    return f"{block:016x}-{digest:016x}.block"


def sent_words(packs: list[bytes]) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """The distinct words of packs, and of each pack the numbers of its words and their weights."""
    got = [unpack(x) for x in packs]
    words = spell(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])).dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return words.dictionary, np.split(numbers, np.cumsum([len(g[0]) for g in got])[:-1]), [g[2] for g in got]


def held(folder: str, block: int, digest: int) -> list[np.ndarray]:
    """What the file of a block has: ids, null, sizes, flat, the words' hash partitions, and words as lengths and bytes if kept."""
    return unpack(whole(folder, _name(block, digest)))


def by_block(answers: DataFrame, parts: int):
    """answers grouped by block, in as many tasks as the blocks' files need: they are larger than what is shuffled."""
    n = max(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts // 8))
    return answers.repartition(n, "block", "digest").groupBy("block", "digest")


def joined(answers: DataFrame, folder: str, parts: int, finish: Callable[..., pa.Table], schema: str) -> DataFrame:
    """What finish(doc ids, sizes, flat, answers, order, *words) makes of each block.

    answers (part, block, digest, pack): the arrays of each hash partition, in ascending order of
    partitions; word i of a block is number order[i] in them, taken one after the other.
    """

    def run(key: tuple[pa.Scalar, ...], told: pa.Table) -> pa.Table:
        ids, null, sizes, flat, of, *words = held(folder, key[0].as_py(), key[1].as_py())
        order = np.empty(len(of), np.int64)
        order[np.argsort(of, kind="stable")] = np.arange(len(of))
        packs = [unpack(x) for _, x in sorted(zip(told["part"].to_pylist(), told["pack"].to_pylist(), strict=True))]
        made = finish(pa.array(ids, mask=null), sizes.astype(np.int64), flat, packs, order, *words)
        give_back()
        return made

    return by_block(answers, parts).applyInArrow(run, schema)


def parts_of(docs: DataFrame) -> int:
    """Hash partitions for the words of documents."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-total // PART_BYTES))
