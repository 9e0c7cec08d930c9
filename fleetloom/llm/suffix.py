"""Suffix-array deduplication over bytes, by prefix-free parsing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pick
from .blocks import Block, returned, staged
from .repeats import Stretches, _ranges, covered, smallest_starts, stretches


def byte_symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return block.data, block.starts


def _placed(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """x, numbers of so many bits, in order, and where each was; equal ones as they came.

    Where number and place fit 64 bits they are sorted as one, in a fifth of the time of an argsort.
    """
    n = len(x).bit_length()
    if bits + n > 64:
        order = np.argsort(x, kind="stable")
        return x[order], order
    both = (x << np.uint64(n)) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    return both >> np.uint64(n), (both & np.uint64((1 << n) - 1)).astype(np.int64)


def _dense(x: np.ndarray, bits: int) -> np.ndarray:
    """The rank of each value, a number of so many bits, among the distinct ones."""
    ordered, order = _placed(x, bits)
    out = np.empty(len(x), np.uint64)
    out[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
    return out


def prefix_ranks(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The rank of the `length` bytes at each place among all such strings, equal strings alike.

    Prefix doubling: from ranks of some bytes to twice as many and so on, then of the length asked
    for. Each place needs `length` bytes in data.
    """
    n = len(data)
    bits = n.bit_length()
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = data
    first = min(8 if 3 * bits > 64 else (64 - bits) // 8, length)
    key = np.zeros(n, np.uint64)
    for i in range(first):
        key = (key << np.uint64(8)) | wide[i : i + n]
    ranks, have = _dense(key, 8 * first), first
    while have < length:
        step = min(have, length - have)
        ahead = np.zeros(n, np.uint64)
        ahead[: n - step] = ranks[step:] if step < n else 0
        ranks, have = _dense((ranks << np.uint64(bits)) | ahead, 2 * bits), have + step
    return ranks[places]


def suffix_array(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes of a dictionary at these places: their order by their first `length` bytes, and where in it each run of equal ones begins."""
    ranks, order = _placed(prefix_ranks(data, places, length), len(data).bit_length())
    return order, np.flatnonzero(np.diff(ranks.astype(np.int64), prepend=-1))


def parse_array(phrase: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parse's places in order of their phrase, then of their document, and where each phrase begins.

    The strings asked for end within their phrase, so what follows in the parse orders none of them.
    """
    order = np.lexsort((docs, phrase))
    return order, np.flatnonzero(np.diff(phrase[order], prepend=-1))


def smallest_in_corpus(windows: np.ndarray, phrase: np.ndarray, docs: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """The smallest document that has each `length`-byte string of the phrases, which lie in data one after the other.

    Corpus order of all strings: by the suffix array of the dictionary, and among equal ones by that of
    the parse. In it, the first of a run of equal strings is that with the smallest document.
    """
    sizes = windows + length - 1
    order, runs = suffix_array(data, _ranges(np.cumsum(sizes) - sizes, windows), length)
    in_parse, begins = parse_array(phrase, docs)
    first = docs[in_parse[begins]][np.repeat(np.arange(len(windows)), windows)[order]]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(first, runs), np.diff(np.append(runs, len(order))))
    return out


def repeated_bytes(docs: DataFrame, length: int = 50, trigger_bytes: int = 16, block_bytes: int = 8 << 20, part_bytes: int = 16 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the bytes that a document with a smaller id has in the same `length`-byte string.

    (doc_id, n_bytes, n_removed, n_spans, kept): a byte goes if it lies in a `length`-byte string of
    the UTF-8 text that also starts in a document with a smaller id; n_spans counts the maximal runs
    that go, kept is the rest as binary (a run may end within a character); then the columns to `carry`.

    Prefix-free parsing: a rolling hash over `trigger_bytes` bytes sets off a phrase at its minimum
    within each string, so triggers lie at most `length` bytes apart, and a phrase overlaps the next
    by length - 1 bytes: each `length`-byte string starts in exactly one phrase and ends within it,
    and no proper suffix that counts is the prefix of another. Equal phrases, told by their bytes, are
    one entry of the dictionary, and the parse is the list of who has which. The suffix array of the
    dictionary, made by prefix doubling, and that of the parse combine into corpus order, where the
    first of equal strings is that with the smallest doc_id. Dictionary and parse are cut up by the
    hash of the trigger, which equal strings share, so the arrays are made in pieces of bounded size,
    and phrases whose trigger one document alone has stay out.

    Null text: as empty. A null doc_id counts as larger than any other. Rows with one doc_id never
    cost each other bytes. Texts shorter than the string lose nothing; a text of more than block_bytes
    is a block of its own. No documents: no rows.
    """
    blocks = staged(docs, block_bytes, carry)
    others = "".join(f", {pick(docs, c).schema.simpleString()[7:-1].replace(':', ' ', 1)}" for c in carry)

    def content(found: Stretches, chosen: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
        sizes = found.last[chosen] - found.first[chosen] + length
        return block.data[_ranges(found.first[chosen], sizes)], sizes.astype(np.uint16)

    def meet(windows: np.ndarray, phrase: np.ndarray, docs_: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return smallest_in_corpus(windows, phrase, docs_, data, length)

    def finish(number: int, block: Block, told: dict[int, bytes]) -> pa.Table:
        symbols, starts = byte_symbols(block)
        gone = covered(block, stretches(symbols, starts, length, trigger_bytes), told, len(symbols), length)
        n_removed, n_spans, kept = [], [], []
        for text, a, b in zip(block.texts(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            out = gone[a:b]
            n_removed.append(int(out.sum()))
            n_spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
            kept.append(block.data[a:b][~out].tobytes() if n_removed[-1] else text)
        return pa.table(
            {
                "doc_id": block.named(),
                "n_bytes": pa.array(np.diff(starts), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                **(block.carried() if carry else {}),
            }
        )

    answers = smallest_starts(blocks, byte_symbols, content, meet, length, trigger_bytes, part_bytes)
    return returned(blocks, answers, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + others)


def op10_suffix_dedup(spark, sf_dir):
    """Contract query of operator 10 over all of documents."""
    from pyspark.sql import functions as F

    from ._common import table

    found = repeated_bytes(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Strings of 50 bytes as 100 hex digits; the smallest doc_id of each; bytes that one with a smaller doc_id covers go.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS t FROM d, unnest(range(1, length(h) // 2 - 48)) AS u(i)
), m AS (
  SELECT t, min(doc_id) AS least FROM s GROUP BY t HAVING min(doc_id) < max(doc_id)
), v AS (
  SELECT s.doc_id, s.i FROM s JOIN m USING (t) WHERE m.least < s.doc_id
), b AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b
), r AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 49 AS z FROM g GROUP BY doc_id, run
), n AS (
  SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE
         array_to_string(list_transform(range(1, n_spans + 2), lambda k:
           substr(h, CASE WHEN k = 1 THEN 1 ELSE 2 * r[k - 1].z + 1 END,
                  CASE WHEN k > n_spans THEN length(h) ELSE 2 * (r[k].a - 1) - CASE WHEN k = 1 THEN 0 ELSE 2 * r[k - 1].z END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
