"""Substring deduplication over words: winnowed seeds, extended both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, returned, staged
from .repeats import Rolling, Stretches, _ranges, covered, smallest_starts, stretches

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, 256, np.uint64)


def word_places(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a block with a space after each document, where its words begin and end, and offsets of documents in them."""
    if hasattr(block, "_places"):
        return block._places
    # The space keeps a document's last word from the next one's first.
    n = len(block.ids)
    data = np.full(len(block.data) + n, 32, np.uint8)
    sizes = np.diff(block.starts)
    data[_ranges(block.starts[:-1] + np.arange(n), sizes)] = block.data
    letter = ~_SPACE[data]
    turn = np.diff(letter.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    block._places = data, first, end, np.searchsorted(first, np.append(block.starts[:-1] + np.arange(n), len(data)))
    return block._places


def word_symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a block as a 64-bit hash; offsets of its documents in them."""
    data, first, end, starts = word_places(block)
    return Rolling(_BYTE[data]).some(first, end) ^ (end - first).astype(np.uint64), starts


def _classes(own: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of numbers: a number for each that two or more have alike, and which those are."""
    _, which, count = np.unique(own * (int(more.max(initial=0)) + 1) + more, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    return which, shared


def extended(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, seed: np.ndarray, length: int) -> tuple[list, list]:
    """Seeds extended word by word: for each number of words to the left of the seed's begin, and to its
    right, the stretches that agree so far with another one, and the class of those that agree.

    A stretch goes no further where no other agrees, or where it ends.
    """
    sides = []
    for step in (-1, 1):
        alive = np.arange(len(begins))
        own = np.zeros(len(begins), np.int64)
        found = [(alive, own)]
        for j in range(length):
            at = seed[alive] + (j if step > 0 else -1 - j)
            inside = (at >= 0) & (at < sizes[alive])
            alive, own = alive[inside], own[inside]
            own, shared = _classes(own, words[begins[alive] + at[inside]])
            alive, own = alive[shared], own[shared]
            found.append((alive, own))
            if not len(alive):
                break
        sides.append(found)
    return sides[0], sides[1]


def smallest_by_seed(words: np.ndarray, sizes: np.ndarray, seed: np.ndarray, windows: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """The smallest doc_id of each window of stretches, from seeds at places `seed` and doc_ids `least`.

    Windows of two stretches are equal where what lies to the left of the seeds and what lies to their
    right agree as far as the window reaches.
    """
    begins, at = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    out = np.repeat(least, windows)
    left, right = extended(words, begins, sizes, seed, length)
    for l_, (here, own) in enumerate(left):
        if length - l_ >= len(right):
            continue
        there, other = right[length - l_]
        both, i, j = np.intersect1d(here, there, assume_unique=True, return_indices=True)
        ok = (seed[both] >= l_) & (seed[both] - l_ < windows[both])
        both, i, j = both[ok], i[ok], j[ok]
        if not len(both):
            continue
        _, which = np.unique(own[i] * (int(other.max(initial=0)) + 1) + other[j], return_inverse=True)
        small = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(small, which, least[both])
        out[at[both] + seed[both] - l_] = small[which]
    return out


def repeated_words(docs: DataFrame, length: int = 50, seed_words: int = 16, block_bytes: int = 2 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """Every document without the words that a document with a smaller id has in the same run of `length`.

    (doc_id, n_words, n_removed, n_repeats, kept): a word goes if it lies in a window of `length`
    words whose sequence also starts in a document with a smaller id; n_repeats counts the maximal
    runs of such words, kept is what is left, joined by single spaces.

    Seeds are winnowed: of the `seed_words`-grams in a window the one with the least hash. Documents
    meet at seeds that two of them have, with the words that windows around the seed reach. There the
    words are compared one by one, from the seed to the left and to the right, as long as another
    document agrees; runs of `length` words that agree are matches, and overlapping ones merge to
    maximal repeats. See repeats.py for how hot seeds stay cheap.

    Null text: as empty. A null doc_id counts as larger than any other. Rows with one doc_id never
    cost each other words. Texts shorter than the window lose nothing; a text of more than block_bytes
    is a block of its own. No documents: no rows.
    """
    blocks = staged(docs, block_bytes)

    def content(found: Stretches, chosen: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
        data, first, end, _ = word_places(block)
        n = found.last[chosen] - found.first[chosen] + length
        word = _ranges(found.first[chosen], n)
        sizes = end[word] - first[word] + 1  # with a space after each
        taken = data[_ranges(first[word], sizes)]
        taken[np.cumsum(sizes) - 1] = 32
        return taken, np.add.reduceat(sizes, np.cumsum(n) - n).astype(np.uint32), (found.place[chosen] - found.first[chosen]).astype(np.uint16)

    def meet(windows: np.ndarray, phrase: np.ndarray, docs_: np.ndarray, data: np.ndarray, sizes: np.ndarray, seed: np.ndarray) -> np.ndarray:
        words = pa.array(data.tobytes().split(b" ")[:-1], pa.large_binary()).dictionary_encode().indices.to_numpy()
        least = np.full(len(windows), np.iinfo(np.int64).max)
        np.minimum.at(least, phrase, docs_)
        return smallest_by_seed(words.astype(np.int64), windows + length - 1, seed.astype(np.int64), windows, least, length)

    def finish(number: int, block: Block, told: dict[int, bytes]) -> pa.Table:
        symbols, starts = word_symbols(block)
        gone = covered(block, stretches(symbols, starts, length, seed_words), told, len(symbols), length)
        n_removed, n_repeats, kept = [], [], []
        for text, a, b in zip(block.texts(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            words, out = text.split(), gone[a:b]
            n_removed.append(int(out.sum()))
            n_repeats.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
            kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if n_removed[-1] else words))
        return pa.table(
            {
                "doc_id": block.named(),
                "n_words": pa.array(np.diff(starts), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_repeats": pa.array(n_repeats, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    answers = smallest_starts(blocks, word_symbols, content, meet, length, seed_words, part_bytes)
    return returned(blocks, answers, finish, "doc_id long, n_words long, n_removed long, n_repeats long, kept string")


def op9_substring_dedup(spark, sf_dir):
    """Contract query of operator 9 over all of documents."""
    from pyspark.sql import functions as F

    from ._common import table

    found = repeated_words(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "n_repeats")


#: Windows of 50 words as text; the smallest doc_id of each; words that a window with a smaller one covers go.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM d, unnest(range(1, len(w) - 48)) AS u(i)
), m AS (
  SELECT t, min(doc_id) AS least FROM s GROUP BY t HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT DISTINCT s.doc_id, s.i + k AS p FROM s JOIN m USING (t), unnest(range(0, 50)) AS r(k) WHERE m.least < s.doc_id
), x AS (
  SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         list_sort(coalesce(gone, [])) AS gone, w
  FROM d LEFT JOIN x USING (doc_id)
), e AS (
  SELECT doc_id, p, w[p] AS word FROM k, unnest(range(1, len(w) + 1)) AS v(p)
  WHERE n_removed > 0
), f AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY p) AS kept
  FROM e ANTI JOIN g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id
)
SELECT k.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(CASE WHEN n_removed = 0 THEN array_to_string(w, ' ') ELSE coalesce(f.kept, '') END) AS kept_sha256,
       CAST(len(list_filter(gone, lambda p, i: i = 1 OR gone[i - 1] <> p - 1)) AS BIGINT) AS n_repeats
FROM k LEFT JOIN f ON f.doc_id = k.doc_id
"""
