"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, shared_dir, written
from .blocks import pack
from .lexicon import give_back, joined, kept_by_worker, parts_of, sent_words, words_sent
from .repeats import _ranges


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts as sizes and numbers of their pre-tokens, and those: text is cut before each space that stands alone
    between other characters.

    No match of a byte-level BPE pattern goes over such a place: a match holds white space at its
    start or holds nothing else, and what it looks ahead to lies on the same side. So the pieces,
    encoded one by one, give the ids of the whole text.
    """
    parts = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    numbers, pieces = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    begins = np.cumsum(sizes) - sizes
    # A piece that is empty, or has white space at an end, may belong to its neighbours.
    odd = pc.match_substring_regex(pieces, r"^\s|\s$|^$|^\pZ|\pZ$|[\x{0b}\x{85}\x{1c}-\x{1f}]").to_numpy(zero_copy_only=False)
    plain = np.add.reduceat(odd[numbers], begins) == 0 if len(begins) else np.zeros(0, bool)
    # After the pieces with a space before them: first pieces, which have none, and what odd texts are cut to.
    firsts = pieces.take(pa.array(numbers[begins[plain]]))
    rows = [list(_joined(parts[i].as_py())) if sizes[i] > 1 or len(texts[i].as_py()) else [] for i in np.flatnonzero(~plain).tolist()]
    more = pa.concat_arrays([firsts, pa.array([w for r in rows for w in r], pieces.type)]).dictionary_encode()
    numbers[begins[plain]] = len(pieces) + more.indices.to_numpy(zero_copy_only=False)[: len(firsts)]
    if rows:
        each = np.split(numbers, begins[1:])
        own = np.split(len(pieces) + more.indices.to_numpy(zero_copy_only=False)[len(firsts) :].astype(np.int64), np.cumsum([len(r) for r in rows])[:-1])
        for i, x in zip(np.flatnonzero(~plain).tolist(), own, strict=True):
            each[i], sizes[i] = x, len(x)
        numbers = np.concatenate(each)
    used, numbers = np.unique(numbers, return_inverse=True)
    spaced = pc.binary_join_element_wise(pa.scalar("", pieces.type), pieces, pa.scalar(" ", pieces.type))
    return sizes, numbers, pa.concat_arrays([spaced, more.dictionary]).take(pa.array(used))


def _joined(parts: list[str]) -> Iterator[str]:
    run, last = [parts[0]], parts[0]
    for part in parts[1:]:
        if last and not last[-1].isspace() and part and not part[0].isspace():
            yield "".join(run)
            run = []
        last = " " + part
        run.append(last)
    yield "".join(run)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): every whole text in token ids, without special tokens.

    Global distinct-word shuffle: pre-tokens go out with their positions, packed by block; the distinct
    ones of a block go to hash partitions, where equal ones of all blocks meet and each is encoded
    once; ids go back to the blocks, and documents are put together by position. A word in all blocks
    is one entry a block in its partition, and partitions grow in number with the input.

    Null text: as empty, no ids. Null doc_id: kept. Repeated rows stay rows. No documents: no rows.
    """

    def encode(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        import tiktoken

        coder = kept_by_worker(("tiktoken", ranks_path, pattern), lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}))
        words, numbers, _ = sent_words(rows["pack"].to_pylist())
        found = list(map(coder.encode_ordinary, words.cast(pa.large_string()).to_pylist()))
        sizes = np.fromiter(map(len, found), np.uint32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        flat = flat.astype(np.uint16) if not len(flat) or flat.max() < 1 << 16 else flat
        ends, packs = np.cumsum(sizes, dtype=np.int64), []
        del found, words
        for mine in numbers:
            n = sizes[mine].astype(np.int64)
            packs.append(pack(sizes[mine], flat[_ranges((ends - sizes)[mine], n)]))
        made = pa.table({"part": rows["part"], "block": rows["block"], "digest": rows["digest"], "pack": pa.array(packs, pa.binary())})
        give_back()
        return made

    def together(ids_: pa.Array, sizes: np.ndarray, flat: np.ndarray, packs: list[list[np.ndarray]], order: np.ndarray) -> pa.Table:
        length = np.concatenate([p[0] for p in packs])[order].astype(np.int64) if packs else np.zeros(0, np.int64)
        asked = np.concatenate([p[1] for p in packs]).astype(np.int32) if packs else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(np.concatenate([p[0] for p in packs]), dtype=np.int64)])[order] if packs else length
        each = length[flat]
        ids = asked[_ranges(starts[flat], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.table({"doc_id": ids_, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))})

    docs, folder = pick(docs, "doc_id", "text"), shared_dir(docs.sparkSession)
    parts = parts_of(docs)
    answers = words_sent(docs, pre_tokens, parts, folder).groupBy("part").applyInArrow(encode, "part int, block long, digest long, pack binary")
    return joined(answers, folder, parts, together, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(tokens): the token-byte table as one row, the bytes of token i as hex digits at place i. The vocabulary bounds it."""
    ranks = read_ranks(ranks_path)
    out: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token.hex()
    return written(spark.createDataFrame([(out,)], "tokens array<string>").coalesce(1))


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """tokens(doc_id, ids) with the bytes they stand for: (doc_id, ids, data).

    Each id is looked up in the token-byte table, which every task has. Null ids: no bytes. An id that
    the table doesn't have is an error.
    """
    table = token_bytes(tokens.sparkSession, ranks_path).scalar()
    known = F.expr("transform(ids, i -> coalesce(get(tokens, i), raise_error('an id without a token')))")
    rows = pick(tokens, "doc_id", "ids").withColumn("tokens", table).withColumn("hex", F.coalesce(F.array_join(known, ""), F.lit("")))
    return rows.select("doc_id", "ids", F.unhex("hex").alias("data"))


def op5_byte_bpe(spark, sf_dir):
    """Contract query of operator 5 over all of documents."""
    import public_tokenizers

    from ._common import table

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = decoded(encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
