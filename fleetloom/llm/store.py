"""A content-addressed store of token-id streams: packs, recipes and a Merkle manifest.

packs/BLOCK.pack          chunks in order of their digests, compressed, then the index of digests and ends, then its size
recipes/SHARD-NNNN.rec    documents in ascending doc_id: doc_id, tokens, and pack and digest of each chunk
manifest.json             of each recipe file: tokens before it, tokens in it, Merkle root; the root of roots
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, dropped, pick, shared_dir, written
from .blocks import pack, squeeze, unpack, unsqueeze
from .files import Ranges, put, whole
from .lexicon import give_back, kept_by_worker, numbered, spell, spelled, texts_of
from .repeats import Rolling, _ranges

SIZE = 16
#: Bytes of a chunk in a recipe: the block whose pack has it, and its digest.
REF = 8 + SIZE
_MIX = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 4096, np.uint64)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=SIZE).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves; an odd one goes up as it is. No leaves: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def chunks(ids: np.ndarray, window: int = 16, mean: int = 512, least: int = 128, most: int = 4096) -> list[int]:
    """Ends of the chunks of an id stream: where the hash of the last `window` ids has zeros at its end."""
    n, ends, start = len(ids), [], 0
    if n > least:
        symbols = _MIX[ids & 4095] ^ (ids.astype(np.uint64) << np.uint64(12))
        marks = np.flatnonzero((Rolling(symbols).every(window) & np.uint64(mean - 1)) == 0) + window if n >= window else np.zeros(0, np.int64)
        for mark in [*marks.tolist(), n]:
            while mark - start > most:
                start += most
                ends.append(start)
            if mark - start >= least and mark < n:
                start = mark
                ends.append(start)
    return [*ends, n] if start < n or not ends else ends


class _Lists:
    """Lists of numbers, one after the other."""

    def __init__(self, lengths: np.ndarray, flat: np.ndarray):
        self.lengths, self.flat = lengths.astype(np.int64), flat

    def __add__(self, other: _Lists) -> _Lists:
        return _Lists(np.concatenate([self.lengths, other.lengths]), np.concatenate([self.flat, other.flat]))

    def take(self, order: np.ndarray) -> _Lists:
        n = self.lengths[order]
        return _Lists(n, self.flat[_ranges((np.cumsum(self.lengths) - self.lengths)[order], n)])

    def grouped(self, counts: np.ndarray) -> _Lists:
        """So many lists at a time as one."""
        ends = np.concatenate([[0], np.cumsum(self.lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return _Lists(np.diff(ends), self.flat)

    def each(self) -> list[np.ndarray]:
        return np.split(self.flat, np.cumsum(self.lengths)[:-1])


class WordEncoder:
    """Ids of texts with a tokenizers file that cuts at white space and lower-cases, as the plain library gives them.

    No step of such a tokenizer reaches over ASCII white space, so the ids of a text are those of its
    words, each distinct one encoded once in a while; nor from a letter to the ASCII punctuation at a
    word's end, which is encoded by itself. New words go through it many at a time. A word of letters
    a to z has one token that ends a word, its last; for others the places of tokens in the text tell
    whose they are. Words that differ in A-Z only are one, but for texts with "<|": the strings of
    special tokens are told from their upper-case forms.
    """

    most, marks, group = 400_000, ".,!?;:", 500

    def __init__(self, path: str, end_id: int, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.dtype, self.end = np.dtype(dtype), np.array([end_id], dtype)
        self.known = pa.array([], pa.large_string())
        self.ids = _Lists(np.zeros(0, np.int64), np.zeros(0, dtype))

    def _narrow(self, found: list) -> np.ndarray:
        ids = np.array(found, np.int64)
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError("an id does not fit the width")
        return ids.astype(self.dtype)

    def _joined(self, units: pa.Array) -> list[str]:
        at = np.append(np.arange(0, len(units), self.group), len(units))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), units), pa.scalar(" ", units.type)).to_pylist()

    def _letters(self, units: pa.Array) -> _Lists | None:
        """Ids of words of letters, or None: then the tokenizer is not such a one."""
        ids = self._narrow([i for e in self.tokenizer.encode_batch_fast(self._joined(units), add_special_tokens=False) for i in e.ids])
        ends = np.flatnonzero(self.last[ids]) + 1
        return _Lists(np.diff(ends, prepend=0), ids) if len(ends) == len(units) and ends[-1] == len(ids) else None

    def _placed(self, units: pa.Array) -> _Lists:
        sizes, lengths, ids = pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64), [], []
        for k, text in enumerate(self._joined(units)):
            found = self.tokenizer.encode_batch([text], add_special_tokens=False)[0]
            mine = sizes[k * self.group : (k + 1) * self.group]
            places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            ends = np.append(np.searchsorted(places, np.cumsum(mine + 1)[:-1], "left"), len(found.ids))
            lengths.append(np.diff(ends, prepend=0))
            ids.append(self._narrow(found.ids))
        return _Lists(np.concatenate(lengths), np.concatenate(ids))

    def learn(self, units: pa.Array) -> np.ndarray:
        """Encodes units that are not known; their places among the known."""
        plain = pc.match_substring_regex(units, "^[a-z]+$") if self.last.any() else pa.array(np.zeros(len(units), bool))
        place = np.empty(len(units), np.int64)
        for which, way in ((plain, self._letters), (pc.invert(plain), self._placed)):
            some = units.filter(which)
            if len(some):
                place[which.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(some))
                self.ids += way(some) or self._placed(some)
                self.known = pa.concat_arrays([self.known, some])
        return place

    def units(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What words are made of: distinct units, the number of each word's first, and of its second or -1."""
        core = pc.ascii_rtrim(words, characters=self.marks)
        cut_ = pc.and_(pc.not_equal(core, words), pc.match_substring_regex(core, "[a-z]$"))
        split = cut_.to_numpy(zero_copy_only=False)
        lengths, data = spelled(words.filter(cut_))
        kept, ends = spelled(core.filter(cut_))[0], np.cumsum(lengths, dtype=np.int64)
        sizes = (lengths - kept).astype(np.int64)
        marks = spell(sizes, data[_ranges(ends - sizes, sizes)]).cast(pa.large_string())
        both = pa.concat_arrays([pc.if_else(cut_, core, words), marks]).dictionary_encode()
        numbers = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        second = np.full(len(words), -1)
        second[split] = numbers[len(words) :]
        return both.dictionary, numbers[: len(words)], second

    def __call__(self, texts: pa.Array) -> _Lists:
        """The ids of texts, each with the end id."""
        special = pc.match_substring(texts, "<|")
        lower = pc.ascii_lower(texts)
        if pc.any(special).as_py():
            lower = pc.if_else(special, texts, lower)
        sizes, numbers, words = numbered(pc.ascii_split_whitespace(lower))
        units, first, second = self.units(words)
        place = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        old = place >= 0
        if len(self.known) > self.most:  # what was known and is met again stays
            self.known, self.ids = self.known.take(pa.array(place[old])), self.ids.take(place[old])
            place[old] = np.arange(int(old.sum()))
        place[~old] = self.learn(units.filter(pa.array(~old)))
        pairs = np.stack([place[first], np.where(second >= 0, place[second], -1)], axis=1)
        ids = self.ids.take(pairs[pairs >= 0]).grouped(1 + (second >= 0))
        ids += _Lists(np.ones(1, np.int64), self.end)
        flat = np.full(len(numbers) + len(sizes), len(words), np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        flat[inner] = numbers
        return ids.take(flat).grouped(sizes + 1)


def _cuts(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def write_store(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, width: int = 2, batch_bytes: int = 4 << 20, recipe_bytes: int = 8 << 20) -> None:
    """Encodes every whole text, appends end_id, and writes the store.

    width: bytes of an id in files, 2 or 4; an id that doesn't fit is an error. Rolling hashes cut
    each document's ids into chunks; equal chunks have one address, the digest of their bytes, and are
    stored once. A block of documents stages its distinct chunks in a file and only their digests are
    shuffled, one row a block, so a chunk that a third of all documents hold is a row a block. The
    first block that has a chunk owns it, and its pack is what it owns. Recipes are sorted by doc_id
    and go to files of some MB.

    Null text: as empty, only the end id. Null doc_id: after all others. Repeated rows stay rows. A
    text of more than a block's bytes is a block of its own. No documents: a manifest without files.
    """
    spark = docs.sparkSession
    dtype = f"<u{width}"
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(("words", tokenizer_path, end_id, dtype), lambda: WordEncoder(tokenizer_path, end_id, dtype))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in cut([batch], "text", batch_bytes):
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                found: dict[bytes, bytes] = {}
                recipes, sizes, counts = [], [], []
                for text in encoder(texts_of(part.column(1))).each():
                    at = 0
                    ends = chunks(text)
                    for end in ends:
                        piece = text[at:end].tobytes()
                        recipes.append(digest(piece))
                        if recipes[-1] not in found:
                            found[recipes[-1]] = squeeze(piece)
                        at = end
                    sizes.append(at)
                    counts.append(len(ends))
                own = sorted(found)
                raw = [np.frombuffer(b"".join(x), np.uint8) for x in (recipes, own)]
                head = pack(ids, null, np.array(sizes, np.int64), np.array(counts, np.uint32), *raw, np.array([len(found[d]) for d in own], np.uint32))
                name = f"{block:016x}-{xxhash.xxh64_intdigest(head):016x}.block"
                put(f"{folder}/staged", name, [struct.pack("<q", len(head)), head, *(found[d] for d in own)])
                yield pa.RecordBatch.from_pydict({"block": pa.array([block]), "name": pa.array([name]), "digests": pa.array([own], pa.list_(pa.binary()))})
                found.clear()
                block += 1

    staged = written(pick(docs, "doc_id", "text").mapInArrow(stage, "block long, name string, digests array<binary>"))
    rows = staged.select("block", F.explode("digests").alias("digest"))
    shared = rows.groupBy("digest").agg(F.min("block").alias("own"), F.max("block").alias("last")).where("own < last").select("digest", "own")
    foreign = rows.join(shared, "digest").where("block <> own").groupBy("block").agg(F.collect_list(F.struct("digest", "own")).alias("foreign"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, name, others in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = whole(f"{folder}/staged", name)
                begin = 8 + struct.unpack_from("<q", raw)[0]
                ids, null, sizes, counts, recipe, own, lengths = unpack(raw[8:begin])
                owner = {x["digest"]: x["own"] for x in others or ()}
                kept, held, at = [], [], begin
                for d, length in zip(_cuts(own.tobytes(), SIZE), lengths.tolist(), strict=True):
                    if d not in owner:
                        kept.append(d)
                        held.append(raw[at : at + length])
                    at += length
                index = b"".join(kept) + np.cumsum([len(x) for x in held], dtype="<i8").tobytes()
                put(f"{folder}/packs", f"{block:016x}.pack", [*held, index, struct.pack("<q", len(kept))])
                refs = [struct.pack("<q", owner.get(d, block)) + d for d in _cuts(recipe.tobytes(), SIZE)]
                ends = np.cumsum(counts, dtype=np.int64).tolist()
                each = [b"".join(refs[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=null), "n": pa.array(sizes), "refs": pa.array(each, pa.binary()), "stored": pa.array([len(kept)] + [0] * (len(each) - 1), pa.int64())})

    placed = staged.select("block", "name").join(foreign, "block", "left").repartition(n_parts, "block", "name")
    placed = written(placed.mapInArrow(place, "doc_id long, n long, refs binary, stored long"))

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, k, out, roots, size, tokens = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{shard:08d}-{k:04d}.rec"
            put(f"{folder}/recipes", name, out)
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "docs": pa.array([len(roots)]), "tokens": pa.array([tokens]), "root": pa.array([merkle(roots)], pa.binary())})

        for batch in batches:
            for doc, n, refs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out.append(struct.pack("<?qqq", doc is None, doc or 0, n, len(refs) // REF) + refs)
                roots.append(merkle([r[8:] for r in _cuts(refs, REF)]))
                size, tokens = size + len(out[-1]), tokens + n
                if size >= recipe_bytes:
                    yield flush()
                    k, out, roots, size, tokens = k + 1, [], [], 0, 0
        if out:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.col("n"), F.col("refs")]
    shards = placed.select("doc_id", "n", "refs").repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(recipes, "file string, docs long, tokens long, root binary").collect()
    shards.sort(key=lambda x: x.file)
    starts = np.cumsum([0] + [x.tokens for x in shards]).tolist()
    files = [{"file": x.file, "start": a, "tokens": x.tokens, "docs": x.docs, "root": bytes(x.root).hex()} for x, a in zip(shards, starts, strict=False)]
    root = merkle([bytes(x.root) for x in shards]).hex()
    n_chunks = placed.agg(F.sum("stored")).first()[0] or 0
    put(folder, "manifest.json", [json.dumps({"chunks": n_chunks, "width": width, "end_id": end_id, "root": root, "recipes": files}).encode()])
    dropped(spark, f"{folder}/staged")


class _Packs:
    """Chunks by address. Those of one pack are found by binary search over its index and read in ranges."""

    def __init__(self, folder: str, dtype: str):
        self.reader, self.dtype = Ranges(f"{folder}/packs"), dtype

    def get(self, block: int, digests: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        """The ids of chunks (digests ascending) of a pack, each held against its digest."""
        name = f"{block:016x}.pack"
        size = self.reader.size(name)
        (k,) = struct.unpack("<q", self.reader.read(name, size - 8, 8))
        raw = self.reader.read(name, size - 8 - k * (SIZE + 8), k * (SIZE + 8))
        index, ends = _cuts(raw[: k * SIZE], SIZE), np.frombuffer(raw, "<i8", k, k * SIZE).tolist()
        spans = []
        for d in digests:
            i = bisect.bisect_left(index, d)
            if i == k or index[i] != d:
                raise ValueError(f"{name} has no chunk {d.hex()}")
            spans.append((ends[i - 1] if i else 0, ends[i]))
        held, begin, end = b"", 0, 0
        for j, ((a, b), d) in enumerate(zip(spans, digests, strict=True)):
            if b > end:
                begin, end = a, b
                for c, e in spans[j + 1 :]:  # on over small gaps
                    if c - end > 1 << 14 or e - begin > 1 << 23:
                        break
                    end = e
                held = self.reader.read(name, begin, end - begin)
            raw = unsqueeze(held[a - begin : b - begin])
            if digest(raw) != d:
                raise ValueError(f"a chunk of {name} is not what its address says")
            yield d, np.frombuffer(raw, self.dtype)


def read_store(spark: SparkSession, folder: str, run_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, data) of every document of a store, data its ids as little-endian uint32.

    Each recipe file is read by a task of its own, in runs of about run_tokens; a run's chunks are
    fetched once each, pack by pack, by binary search over the pack's index and reads of ranges, so no
    chunk is shuffled. Every chunk is held against its digest, every recipe file against its Merkle
    root, the roots against the manifest's.
    """
    manifest = json.loads(whole(folder, "manifest.json"))
    if merkle([bytes.fromhex(x["root"]) for x in manifest["recipes"]]).hex() != manifest["root"]:
        raise ValueError("the manifest's root is not that of its recipe files")
    dtype = f"<u{manifest['width']}"
    files = spark.createDataFrame([(x["file"], x["start"], x["root"]) for x in manifest["recipes"]], "file string, start long, root string")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(folder, dtype)

        def together(run: list[tuple]) -> pa.RecordBatch:
            need: dict[int, set[bytes]] = {}
            for *_, refs in run:
                for block, d in refs:
                    need.setdefault(block, set()).add(d)
            found = dict(x for block in sorted(need) for x in packs.get(block, sorted(need[block])))
            data = []
            for doc, _, n, refs in run:
                ids = np.concatenate([found[d] for _, d in refs])
                if len(ids) != n:
                    raise ValueError(f"document {doc} has {len(ids)} ids and should have {n}")
                data.append(ids.astype("<u4").tobytes())
            found.clear()
            docs_, starts, sizes, _ = zip(*run, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "data"])

        for batch in batches:
            for name, start, root in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, at, run, held, roots = whole(f"{folder}/recipes", name), 0, [], 0, []
                while at < len(raw):
                    null, doc, n, k = struct.unpack_from("<?qqq", raw, at)
                    at += struct.calcsize("<?qqq")
                    refs = [(struct.unpack_from("<q", r)[0], r[8:]) for r in _cuts(raw[at : at + REF * k], REF)]
                    roots.append(merkle([d for _, d in refs]))
                    run.append((None if null else doc, start, n, refs))
                    start, at, held = start + n, at + REF * k, held + n
                    if held >= run_tokens:
                        yield together(run)
                        run, held = [], 0
                if merkle(roots).hex() != root:
                    raise ValueError(f"{name} is not what the manifest says")
                if run:
                    yield together(run)
                give_back()

    return files.repartition(max(1, len(manifest["recipes"]))).mapInArrow(documents, "doc_id long, start long, n_tokens long, data binary")


def op7_token_store(spark, sf_dir):
    """Contract query of operator 7 over all of documents."""
    import public_tokenizers

    from ._common import table

    folder = shared_dir(spark)
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("data").alias("ids_crc32"))
