"""Scores documents with word frequencies and with a recurrent language model learned from the corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, shared_dir, written
from .gru import Shape, Trainer, flat, scores, start, unflat
from .blocks import pack
from .lexicon import Lexed, give_back, held, joined, numbered, parts_of, sent_words, spell, words_sent

#: The end of a document as a word. No word of a text is empty.
END = b""


def lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts as sizes and numbers of their words and the end, and those: A-Z are lower-cased."""
    sizes, numbers, words = numbered(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    flat = np.full(len(numbers) + len(sizes), len(words), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(flat), bool)
    inner[ends] = False
    flat[inner] = numbers
    return sizes + 1, flat, pa.concat_arrays([words.cast(pa.large_binary()), pa.array([END], pa.large_binary())])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % 5 == 1


def _kept_out(ids: pa.Array) -> np.ndarray:
    return np.fromiter(map(held_out, ids.to_pylist()), bool, len(ids))


def tail_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def word_counts(docs: DataFrame, parts: int, heads: int, tails: int, folder: str) -> DataFrame:
    """What the training documents hold of each word, written once, and all documents as blocks in folder. Rows of three kinds:

    answers to blocks (part, block, digest, pack): the counts of their words; the `heads` most frequent
    words of a hash partition (word, n); words and counts of tail classes in it (tail, n, v).
    """

    def weigh(found: Lexed) -> np.ndarray:
        mine = ~_kept_out(pa.array(found.ids, mask=found.null))
        return np.bincount(found.flat[np.repeat(mine, found.sizes)], minlength=len(found.lengths)).astype(np.uint32)

    def count(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        found, asked, weights = sent_words(rows["pack"].to_pylist())
        words = found.to_pylist()
        total = np.bincount(np.concatenate(asked), np.concatenate(weights), len(words)).astype(np.int64)
        top = np.argsort(-total, kind="stable")
        if len(top) > heads:  # all that the last of them ties with
            top = top[: int(np.searchsorted(-total[top], -total[top[heads - 1]], "right"))]
        top = sorted(((int(total[i]), words[i]) for i in top.tolist() if total[i]), key=lambda x: (-x[0], x[1]))[:heads]
        classes = np.fromiter((tail_class(w, tails) for w in words), np.int64, len(words))
        n, v = np.bincount(classes, total, tails).astype(np.int64), np.bincount(classes[total > 0], minlength=tails)
        m, k = len(asked), len(top)
        blank = lambda size, kind: pa.nulls(size, kind)
        few = lambda x: x.astype(np.uint8) if not len(x) or x.max() < 256 else x.astype(np.uint32) if x.max() < 1 << 32 else x
        return pa.table(
            {
                "part": pa.concat_arrays([rows["part"].combine_chunks(), pa.array([key[0].as_py()] * (k + tails), pa.int32())]),
                "block": pa.concat_arrays([rows["block"].combine_chunks(), blank(k + tails, pa.int64())]),
                "digest": pa.concat_arrays([rows["digest"].combine_chunks(), blank(k + tails, pa.int64())]),
                "pack": pa.array([pack(few(total[a])) for a in asked] + [None] * (k + tails), pa.binary()),
                "word": pa.array([None] * m + [w for _, w in top] + [None] * tails, pa.binary()),
                "tail": pa.array([None] * (m + k) + list(range(tails)), pa.int32()),
                "n": pa.array([None] * m + [c for c, _ in top] + n.tolist(), pa.int64()),
                "v": pa.array([None] * (m + k) + v.tolist(), pa.int64()),
            }
        )

    sent = words_sent(docs, lower_words, parts, folder, weigh, keep=True)
    return written(sent.groupBy("part").applyInArrow(count, "part int, block long, digest long, pack binary, word binary, tail int, n long, v long"))


def train(blocks: DataFrame, folder: str, heads: dict[bytes, int], shape: Shape, params: dict[str, np.ndarray], rounds: int, rate: float) -> dict[str, np.ndarray]:
    """The model after `rounds` passes, each over other blocks (block, digest) of documents.

    In a round every task learns from the training documents of its blocks from the model of the round
    before, by truncated backpropagation; models are averaged by the numbers of tokens they saw, in two
    steps, so that no task and not the driver sees more than 64 models. All training documents are
    learned from once.
    """
    fan, most = 64, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for r in range(rounds):
        values = flat(params)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, seen, texts, size = Trainer(unflat(shape, values), shape, rate), 0, [], 0  # noqa: B023
            for batch in batches:
                for block, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids, null, sizes, numbers, _, lengths, data = held(folder, block, digest)
                    rows = _rows(heads, shape, spell(lengths, data).to_pylist()).astype(np.int64)[numbers]
                    each = np.split(rows, np.cumsum(sizes, dtype=np.int64)[:-1])
                    out = _kept_out(pa.array(ids, mask=null)).tolist()
                    texts += [t for t, o in zip(each, out, strict=True) if not o]
                    size += len(rows)
                    if size > 2_000_000:
                        seen += trainer.run(texts)
                        texts, size = [], 0
            seen += trainer.run(texts)
            give_back()
            if seen:
                yield pa.RecordBatch.from_pydict({"seen": pa.array([float(seen)]), "model": pa.array([(flat(trainer.p).astype(np.float64) * seen).astype(np.float64).tobytes()], pa.binary())})

        def add(key: tuple[pa.Scalar], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = None, 0.0
            for batch in rows:
                for s, m in zip(batch.column("seen").to_pylist(), batch.column("model").to_pylist(), strict=True):
                    seen += s
                    total = np.frombuffer(m) + (0 if total is None else total)
            yield pa.RecordBatch.from_pydict({"seen": pa.array([seen]), "model": pa.array([total.tobytes()], pa.binary())})

        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r)
        n = mine.count()
        if not n:
            continue
        models = mine.repartition(min(most, -(-n // 3))).mapInArrow(run, "seen double, model binary").withColumn("g", F.spark_partition_id() % fan)
        sums = models.groupBy("g").applyInArrow(add, "seen double, model binary").collect()
        if sums:
            values = sum(np.frombuffer(x.model) for x in sums) / sum(x.seen for x in sums)
            params = unflat(shape, values)
    return params


def _rows(heads: dict[bytes, int], shape: Shape, words: list[bytes]) -> np.ndarray:
    """Input rows of words: head words have one each, others that of their tail class."""
    found = (heads.get(w, -1) for w in words)
    return np.fromiter((r if r >= 0 else shape.head + tail_class(w, shape.tail_classes) for r, w in zip(found, words, strict=True)), np.uint16, len(words))


def scored(docs: DataFrame, shape: Shape = Shape(), rounds: int = 3, rate: float = 0.01) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Counts, classes and biases come from all training documents (those not held out), and the model
    learns from all of them. The most frequent words fill head classes; every other word belongs to
    the tail class of its last three bytes and has there the probability
    (c + 0.5) / (N_class + 0.5 * (V_class + 1)), unseen words the share of c = 0; so probabilities of
    all words add up to one after any state. The state starts from zero at a document's first word and
    is carried on to its end.

    Vocabulary sent to the driver: the head words only, a number that `shape` fixes. Counts go back to
    documents by the distinct words of blocks.

    Null text: as empty, its only token the end. Null doc_id: kept, never held out. Repeated rows stay
    rows and count again. No documents: no rows.
    """
    docs, folder = pick(docs, "doc_id", "text"), shared_dir(docs.sparkSession)
    parts = parts_of(docs)
    counts = word_counts(docs, parts, shape.head, shape.tail_classes, folder)
    top = counts.where("word is not null").orderBy(F.desc("n"), "word").limit(shape.head).collect()
    heads = {bytes(x.word): i for i, x in enumerate(top)}
    head_counts = np.zeros(shape.head)
    head_counts[: len(top)] = [x.n for x in top]
    tail_n, tail_v = np.zeros(shape.tail_classes), np.zeros(shape.tail_classes)
    for x in counts.where("tail is not null").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tail_n[x.tail], tail_v[x.tail] = x.n, x.v
    n, v = int(tail_n.sum()), int(tail_v.sum())
    for word, i in heads.items():
        tail_n[tail_class(word, shape.tail_classes)] -= head_counts[i]
        tail_v[tail_class(word, shape.tail_classes)] -= 1
    class_counts = np.concatenate([head_counts.reshape(shape.head_classes, -1).sum(axis=1), tail_n])
    answers = counts.where("block is not null").select("part", "block", "digest", "pack")
    blocks = written(answers.select("block", "digest").distinct())
    params = train(blocks, folder, heads, shape, start(shape, class_counts, head_counts), rounds, rate)
    values = flat(params)

    def finish(ids: pa.Array, sizes: np.ndarray, numbers: np.ndarray, packs: list[list[np.ndarray]], order: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> pa.Table:
        row = _rows(heads, shape, spell(lengths, data).to_pylist()).astype(np.int64)
        c = np.concatenate([p[0] for p in packs])[order].astype(np.float64)
        tail = np.maximum(row - shape.head, 0)
        within = np.where(row < shape.head, 0.0, np.log((c + 0.5) / (tail_n[tail] + 0.5 * (tail_v[tail] + 1))))
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        starts = np.cumsum(sizes) - sizes  # no document is without its end
        model = scores(unflat(shape, values), shape, np.split(row[numbers], starts[1:]))
        total = model + np.add.reduceat(within[numbers], starts)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(_kept_out(ids)),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64)[numbers], starts)),
                "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                "base_score": pa.array(np.add.reduceat(base[numbers], starts)),
                "score": pa.array(total / np.log(10)),
            }
        )

    return joined(answers, folder, parts, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark, sf_dir):
    """Contract query of operator 8 over all of documents."""
    from ._common import table

    return scored(table(spark, sf_dir, "documents"))
