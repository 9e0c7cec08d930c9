"""Each operator against plain Python on small texts with nulls, empty and repeated rows, ties and extra columns."""

import glob
import gzip
import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fleetloom.llm import bpe, contamination, gru, licenses, lm, quality, repeats, simhash, store, substring, suffix, warc
from fleetloom.llm._common import shared_dir

SCHEMA = "doc_id long, text string, w string, h long, block int"


def some_texts(seed=3, n=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, texts = say(70), [None, "", "  \n\t ", "one", "a b\nc"]
    for i in range(n):
        t = say(rng.randint(1, 160))
        if i % 3 == 0:
            t += "\n" + passage[rng.randint(0, 30) :] + " " + say(5)
        texts.append(t)
    texts += texts[7:12]
    texts.append(texts[8].replace("a", "A", 1) + " extra")
    texts += ["Say <|endoftext|> and<|startoftext|>, <|ENDOFTEXT|>.", " ".join(say(4000) for _ in range(5)) + "z" * 70_000]
    return texts


@pytest.fixture(scope="module")
def texts():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", i, 0) for i, t in enumerate(texts)]
    rows += [(None, texts[9], None, None, None), (12, texts[12], "again", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def all_rows(texts):
    return [(i, t or "") for i, t in enumerate(texts)] + [(None, texts[9]), (12, texts[12])]


def covered(seqs, length):
    """For each (id, sequence): which symbols go. A null id is the largest."""
    big = 1 << 62
    least = {}
    for i, s in seqs:
        for k in range(len(s) - length + 1):
            key = tuple(s[k : k + length])
            least[key] = min(least.get(key, big), big if i is None else i)
    out = []
    for i, s in seqs:
        gone = [False] * len(s)
        for k in range(len(s) - length + 1):
            if least[tuple(s[k : k + length])] < (big if i is None else i):
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_substring(spark, docs, texts, block_bytes):
    rows = [(i, t.encode().split()) for i, t in all_rows(texts)]
    want = sorted((str(i), len(s), sum(g), b" ".join(w for w, x in zip(s, g, strict=True) if not x).decode()) for (i, s), g in zip(rows, covered(rows, 50), strict=True))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.repeated_words(docs, block_bytes=block_bytes).collect())
    assert got == want
    assert substring.repeated_words(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_suffix(spark, docs, texts, block_bytes):
    rows = [(i, t.encode()) for i, t in all_rows(texts)]
    want = sorted((str(i), len(s), sum(g), bytes(c for c, x in zip(s, g, strict=True) if not x)) for (i, s), g in zip(rows, covered(rows, 50), strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix.repeated_bytes(docs, block_bytes=block_bytes, carry=("w",)).collect())
    assert got == want


def test_corpus_order():
    rng = random.Random(4)
    phrases = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(3, 9))) for _ in range(30)]
    parse = [(rng.randrange(30), rng.randrange(100)) for _ in range(200)] + [(i, 1000) for i in range(30)]
    least = {}
    for p, d in parse:
        for o in range(len(phrases[p]) - 2):
            w = phrases[p][o : o + 3]
            least[w] = min(least.get(w, d), d)
    got = suffix.smallest_in_corpus(np.array([len(p) - 2 for p in phrases]), *np.array(parse).T, np.frombuffer(b"".join(phrases), np.uint8), 3)
    assert got.tolist() == [least[p[o : o + 3]] for p in phrases for o in range(len(p) - 2)]


def test_seeds_extended():
    rng = np.random.default_rng(5)
    length, n = 6, 60
    rows = []
    for i in range(n):  # the seed, two words 8 and 9, at a place of its own; each window holds it
        left, right = rng.integers(0, 3, rng.integers(0, 5)), rng.integers(0, 3, rng.integers(0, 5))
        words = np.concatenate([left, [8, 9], right])
        if len(words) >= length:
            rows.append((words, len(left), int(rng.integers(0, 100))))
    least = {}
    key = lambda w, at, i: (at - i, *w[i : i + length].tolist())
    for w, at, d in rows:
        for i in range(len(w) - length + 1):
            least[key(w, at, i)] = min(least.get(key(w, at, i), d), d)
    sizes = np.array([len(w) for w, _, _ in rows])
    got = substring.smallest_by_seed(np.concatenate([w for w, _, _ in rows]), sizes, np.array([a for _, a, _ in rows]), sizes - length + 1, np.array([d for _, _, d in rows]), length)
    assert got.tolist() == [least[key(w, at, i)] for w, at, _ in rows for i in range(len(w) - length + 1)]


def test_packs_stay_few_as_the_input_grows():
    size = {k: v.default for k, v in inspect.signature(suffix.repeated_bytes).parameters.items()}
    text = 10 << 30  # of 6 GB of documents
    assert (text // size["block_bytes"]) * (text // size["part_bytes"]) <= 1_000_000


def test_blocks_and_partitions_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    data, starts = rng.integers(97, 99, 5000, np.uint8), np.array([0, 0, 40, 900, 2500, 2501, 4000, 5000])
    whole = repeats.stretches(data, starts, 50, 16)
    for size in (1, 1000, 3000):
        monkeypatch.setattr(repeats, "PIECE_SYMBOLS", size)
        found = repeats.stretches(data, starts, 50, 16)
        assert all(np.array_equal(getattr(whole, f), getattr(found, f)) for f in ("first", "last", "place", "anchor", "key", "doc"))
    anchor, sizes = rng.integers(0, 40, 300).astype(np.uint32), rng.integers(1, 60, 300)
    for most in (1, 500, 5000, 1 << 20):
        pieces = list(repeats.gram_pieces(anchor, sizes, most))
        assert sorted(np.concatenate(pieces).tolist()) == list(range(300))
        assert all(sizes[x].sum() <= most or len(np.unique(anchor[x])) == 1 for x in pieces)
        assert sum(len(np.unique(anchor[x])) for x in pieces) == len(np.unique(anchor))
    x = rng.integers(0, 50, 200).astype(np.uint64)
    for bits in (6, 64):
        ordered, order = suffix._placed(x, bits)
        assert np.array_equal(order, np.argsort(x, kind="stable")) and np.array_equal(ordered, np.sort(x))


def test_hashes_that_collide():
    held = [b"ab", b"ab", b"cd", b"abc", b"cd", b"x"]
    sizes = np.array([len(x) for x in held])
    one, which = repeats.distinct(np.array([7, 7, 7, 7, 7, 9], np.uint64), np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert [held[one[w]] for w in which] == held and len(one) == 4


def test_simhash(spark, docs, texts):
    def slow(t):
        w = t.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = all_rows(texts)
    fps = [slow(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), f, str(least[g])) for r, f, g in zip(rows, fps, group, strict=True))
    got = simhash.simhash_components(docs, 3, 2)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got.collect()) == want
    a = spark.createDataFrame([(x,) for x in {f - (1 << 64) if f >> 63 else f for f in fps}], "fp long")
    links = {tuple(sorted((r.a, r.b))) for r in simhash.hamming_links(a, 2).collect()}
    values = [r.fp for r in a.collect()]
    assert links == {tuple(sorted((x, y))) for x in values for y in values if x < y and bin((x ^ y) % (1 << 64)).count("1") <= 2}


def test_near_links_at_every_distance(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << i) for i in range(64)} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()}
    assert got == {(x, y) for x in signed for y in signed if x < y and bin((x ^ y) % (1 << 64)).count("1") <= 2}


def test_near_copies(spark):
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    base = say(300)
    edit = base[:150] + ["changed"] + base[151:]
    rows = [(5, " ".join(base)), (3, " ".join(edit)), (9, " ".join(base)), (7, " ".join(say(300))), (8, None), (2, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7, 8: 8, 2: 2}


def test_near_copies_all_pairs(spark):
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        base = say(rng.randrange(60, 300))
        for edits in (0, 1, 2, 3, 4, 5, 6):
            copy = list(base)
            for _ in range(edits * len(base) // 120):
                copy[rng.randrange(len(copy))] = say(1)[0]
            rows.append((len(rows), " ".join(copy)))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    rows += [(None, rows[0][1]), (None, " ".join(say(90)))]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([(str(i), str(g)) for i, g in enumerate(group)] + [("None", "0"), ("None", "None")])


def test_bpe(spark, docs, texts):
    import public_tokenizers as P
    import tiktoken

    ranks = P.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.data)) for r in bpe.decoded(bpe.encoded(docs, ranks, P.PATTERN), ranks).collect())
    assert got == sorted((str(i), coder.encode_ordinary(t), t.encode()) for i, t in all_rows(texts))
    odd = ["  a  b ", "\n\n x\t y", " ", "a \n b", "x\x1cy z", "don't  we'll 12 3.5", "日本語 テスト", "a" * 500, None]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in bpe.encoded(df, ranks, P.PATTERN).collect():
        assert list(r.ids) == coder.encode_ordinary(odd[r.doc_id] or "")


def test_store(spark, docs, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    folder = shared_dir(spark)
    store.write_store(docs, path, folder, batch_bytes=500)
    t = Tokenizer.from_file(path)
    want = sorted((str(i), np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in all_rows(texts))
    rows = store.read_store(spark, folder).collect()
    assert sorted((str(r.doc_id), bytes(r.data)) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and len(r.data) == 4 * r.n_tokens
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order[-1] is None and order[:-1] == sorted(order[:-1])
    empty = shared_dir(spark)
    store.write_store(docs.limit(0), path, empty)
    assert store.read_store(spark, empty).count() == 0


def test_chunks():
    ids = np.random.default_rng(1).integers(0, 40000, 20000)
    ends = store.chunks(ids)
    assert ends[-1] == len(ids) and all(b > a for a, b in zip(ends, ends[1:], strict=False))
    moved = store.chunks(np.concatenate([ids[:50], ids]))
    assert len({x - 50 for x in moved} & set(ends)) > len(ends) // 2
    assert store.chunks(ids[:0]) == [0] and store.chunks(ids[:1]) == [1]


def test_words_of_the_encoder():
    import public_tokenizers as P

    e = store.WordEncoder(P.path("word_bpe_49k.json"), 2, "<u2")
    texts = ["Ab  c", "x", "", "\n", "İ ß ΑΣ", "a" * 300, "hello <|endoftext|> world", "Hello<|startoftext|>b, <|ENDOFTEXT|>. <|End", "word, word. it's. don't! x.,;:? y.#", "a\u00a0b\u3000, c\u0301. \u0301 d", "1, e.g. ,, A.\tB.\x0bC.\x1cD", "\u00a0 \u2003", "\ue000 \ue000\ue000."]
    e.most = 3
    for t, got in zip(texts + texts, e(pa.array(texts, pa.large_string())).each() + e(pa.array(texts, pa.large_string())).each(), strict=True):
        assert got.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_warc(spark):
    h = "x" * 200
    rows = [(3, "http://a.b.c/x?y", h, 0), (1, "https://A.b.c:80/x y\n", h, 0), (None, "u", h, 0), (7, None, h, 0), (7, None, h, 0), (9, "http://a.b.c/x?y", None, 0), (10, "q", "é" * 30, 0), (11, "q", "é" * 30, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    folder = shared_dir(spark)
    warc.write_archives(df, folder, block_lines=2)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.lookups(spark, folder, df).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [("3", "revisit", 1, 200, sha(h)), ("1", "response", None, 200, sha(h)), ("None", "revisit", 1, 200, sha(h)), ("7", "revisit", 1, 200, sha(h)), ("7", "revisit", 1, 200, sha(h))]
    want += [("9", "response", None, 0, sha("")), ("10", "response", None, 60, sha("é" * 30)), ("11", "response", None, 60, sha("é" * 30))]
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert sorted(x["page_id"] for x in warc.lookup(folder, "http://a.b.c/x?y")) == [3, 9]
    assert warc.lookup(folder, "http://zz/") == []
    empty = shared_dir(spark)
    warc.write_archives(df.limit(0), empty)
    assert warc.lookups(spark, empty, df).count() == 0
    some = df.select("url").where("page_id = 9").union(df.select("url").where("page_id = 9"))
    assert sorted(r.page_id for r in warc.lookups(spark, folder, some).collect()) == [3, 9]
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder.removeprefix('file://')}/warc/*.gz"))
    ids = re.findall(rb"WARC-Record-ID: (<[^>]*>)", data)
    assert len(ids) == len(set(ids)) == len(rows) and set(re.findall(rb"WARC-Refers-To: (<[^>]*>)", data)) <= set(ids)


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30)] + [(5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels, carry=("block",)).collect()
    assert len(got) == len(all_rows(texts))
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        marks = [any(tri.count(tri[k]) > 1 for k in range(max(0, j - 2), min(j, len(tri) - 1) + 1)) for j in range(len(w))] if tri else []
        lines = [x for x in (t or "").split("\n") if x.split()]
        r = by[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(marks), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * sum(marks) > 50 * len(w)) and (not r.kept or not r.base_failed)
    none = quality.quality_rules(docs, labels.limit(0)).collect()
    assert {r.llr for r in none} == {0.0}
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


def test_quality_verdicts_by_plain_python(spark, docs, texts):
    """Symbols, characters, ratios and verdicts; XXH64 with seed 42 as the engine hashes words, and pairs of hashes."""
    import math
    import struct

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda w: signed(xxhash.xxh64_intdigest(w, 42))
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))
    good, buckets, threshold = {0, 3, 7, 8, 12, 15, 20}, 1 << 8, -0.05
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    grams = []
    for i, t in all_rows(texts):
        h = [word(w) for w in t.encode().split()]
        grams.append((i, [x & (buckets - 1) for x in h + [pair(a, b) for a, b in zip(h, h[1:], strict=False)]]))
    raw, trusted = [0] * buckets, [0] * buckets
    for i, g in grams:
        for x in g:
            raw[x] += 1
            trusted[x] += i in good
    scale = sum(trusted) / sum(raw)
    ratio = [math.floor(1e6 * (math.log(t + 1.0) - math.log(r * scale + 1.0)) * r / (r + 30.0) + 0.5) for t, r in zip(trusted, raw, strict=True)]
    got = sorted(quality.quality_rules(docs, labels, threshold, buckets).collect(), key=lambda r: str((r.doc_id, r.n_words, r.llr)))
    want = []
    for (i, t), (_, g) in zip(all_rows(texts), grams, strict=True):
        want.append((i, len(t.split()) if t.isascii() else len(t.encode().split()), sum(ratio[x] for x in g) / max(len(g), 1) / 1e6, sum(map(len, t.encode().decode().split())), sum(c in "#*$%&|<>" for c in t)))
    want.sort(key=lambda x: str(x[:3]))
    assert len(got) == len(want)
    for r, (i, n, llr, chars, symbols) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols) == (i, n, chars, symbols)
        assert r.llr == pytest.approx(llr, abs=2e-6)
        assert r.kept == (not r.base_failed and r.llr >= threshold) or abs(r.llr - threshold) < 2e-6


def test_quality_repeats_of_long_texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(n))) for i, n in enumerate((4000, 4100, 9000))]
    rows.append((3, " ".join(f"u{i}" for i in range(9000)) + " u1 u2 u3"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.n_repeat_words for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    for i, t in rows:
        w = t.split()
        seen, marks = {}, [False] * len(w)
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for ks in seen.values():
            for k in ks if len(ks) > 1 else ():
                marks[k] = marks[k + 1] = marks[k + 2] = True
        assert got[i] == sum(marks)


def test_empty_tables_and_clashing_columns(spark, docs):
    """No documents: no rows, from any operator; columns that are called as an operator's own do no harm."""
    import public_tokenizers as P

    none, ranks = docs.limit(0), P.path("byte_bpe_50k.tiktoken")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    ids = spark.createDataFrame([], "doc_id long, ids array<int>")
    made = [contamination.leaks(none, items), contamination.leaks(docs, items.limit(0)), simhash.simhash_components(none), simhash.near_copies(none), bpe.encoded(none, ranks, P.PATTERN), bpe.decoded(ids, ranks), licenses.license_scan(none), substring.repeated_words(none), suffix.repeated_bytes(none)]
    for df in made:
        assert df.count() == 0
    rows = [(1, "a b c d e f g h", 1, 2, 3, 4), (2, "a b c d e f g h", 1, 2, 3, 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, fp int, sh int, k int, item_id int")
    assert sorted((r.doc_id, r.item_id) for r in contamination.leaks(odd, items).collect()) == [(1, 1), (2, 1)]
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_copies(odd).collect()) == [(1, 1), (2, 1)]
    known = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    table = {i: t for t, i in bpe.read_ranks(ranks).items()}
    assert {r.doc_id: bytes(r.data) for r in bpe.decoded(known, ranks).collect()} == {1: b"", 2: b"", 3: table[0] + table[1]}
    with pytest.raises(Exception, match="an id without a token"):
        bpe.decoded(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>"), ranks).collect()


def test_largest_id_is_no_null(spark):
    import public_tokenizers as P

    big = (1 << 63) - 1
    df = spark.createDataFrame([(big, "one two three"), (4, "one two"), (None, "x")], "doc_id long, text string")
    path, folder = P.path("word_bpe_49k.json"), shared_dir(spark)
    store.write_store(df, path, folder)
    made = [bpe.encoded(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), store.read_store(spark, folder), substring.repeated_words(df), suffix.repeated_bytes(df), lm.scored(df, gru.Shape(2, 2, 2, 2), rounds=1), simhash.near_copies(df)]
    for x in made:
        assert sorted(str(r.doc_id) for r in x.select("doc_id").collect()) == sorted(["4", str(big), "None"])


def test_quality_lines_of_f_and_of_form_feeds(spark):
    texts = ["f\nf\nff f\nff f\nfoo", "\f\na\n\f\nb\n \f\t\n \f\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality_rules(df, labels).collect()} == {0: 2, 1: 0}


def test_licenses(spark):
    grant = licenses.TEMPLATES["MIT"][1].split()
    wrapped = "\n".join(" ".join(grant[i : i + 8]) for i in range(0, len(grant), 8))
    rows = [
        (1, "Hello.\nLicensed under the APACHE license, version 2.0\nmore text here", 0),
        (2, None, 0),
        (3, "", 0),
        (4, "nothing of that kind", 0),
        (None, "All rights reserved.", 0),
        (4, "nothing of that kind", 0),
        (5, "Some words before.\n" + wrapped + "\nand some after it, all in one paragraph.", 0),
        (6, "All rights reserved.\n" * 200, 0),
        (7, ("lorem ipsum " * 20_000) + "all rights reserved", 0),
    ]
    got = sorted((str(r.doc_id), r.license, r.n_matches) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, words int")).collect())
    assert got == [("1", "Apache-2.0", 1), ("2", None, 0), ("3", None, 0), ("4", None, 0), ("4", None, 0), ("5", "MIT", 1), ("6", "Proprietary", 200), ("7", "Proprietary", 1), ("None", "Proprietary", 1)]
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_by_brute_force(spark):
    rng = random.Random(6)
    kinds = {"one": ["a b c d e f g h"], "two": ["a b x d e f g h", "p q r"], "tie": ["q r p q"]}
    rows = []
    for i in range(60):
        w = [rng.choice("mnopqrx") for _ in range(rng.randrange(12))]
        for t in rng.sample([t for ts in kinds.values() for t in ts], rng.randrange(3)):
            part = t.split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.choice("abcz")
            w += part + [rng.choice("mno")]
        rows.append((i, " ".join(w)))
    want = []
    for i, text in rows:
        w = text.split()
        b, best, n = [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)], None, 0
        for name, t in ((name, set(licenses.bigrams(t))) for name, ts in kinds.items() for t in ts):
            last = None
            for p in range(len(b)):
                found = [2.0 * len(t & set(b[p : z + 1])) / (len(set(b[p : z + 1])) + len(t)) for z in range(p, min(len(b), p + int(1.5 * len(t)))) if b[p] in t and b[z] in t]
                if found and max(found) >= 0.8:
                    best = max(best or (0.0, ""), (max(found), name))
                    n += last is None or p - last >= len(t)
                    last = p
        want.append((i, best[1] if best else None, best[0] if best else 0.0, n))
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), kinds).collect()
    assert sorted((r.doc_id, r.license, r.dice, r.n_matches) for r in got) == want


def test_leaks(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"v{rng.randrange(300)}" for _ in range(n))
    items = [(1, say(30)), (2, say(20)), (3, "too short here"), (4, None), (5, say(40))]
    edited = items[4][1].split()
    edited[0] = "other"
    docs = [(10, say(50) + " " + items[0][1].upper() + "!!! " + say(9)), (11, say(80)), (12, items[1][1]), (13, None), (14, say(7) + " " + " ".join(edited)), (15, " ".join(items[0][1].split()[:12]) + " " + say(30)), (10, say(3)), (16, "")]
    got = {(r.doc_id, r.item_id) for r in contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10, 1), (12, 2), (14, 5)}


def test_leaks_in_another_order(spark):
    rng = random.Random(14)
    say = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate((40, 60, 100, 60))]
    swapped = [say(30) + w[len(w) // 2 :] + w[: len(w) // 2] + say(20) for _, w in items]
    far = say(10) + items[3][1][:30] + say(25) + items[3][1][30:]
    docs = [(i, " ".join(w)) for i, w in enumerate([*swapped[:3], far, items[2][1][8:] + say(50), say(50) + items[2][1][:-8]])] + [(None, " ".join(swapped[0]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for d, text in docs:
        for i, w in items:
            g, t = grams(w), grams(text.split())
            found = set()
            for st in range(1 - len(g), len(t)):
                win = t[max(st, 0) : st + len(g)]
                same = sum(min(win.count(x), g.count(x)) for x in set(win))
                if 5 * same >= 4 * (len(win) + len(g) - same):
                    found.add((same / (len(win) + len(g) - same), -max(st, 0), len(win)))
            if found:
                want[d, i] = (max(found)[0], -max(found)[1], len(found))
    assert {k: (r.similarity, r.start, r.n_windows) for k, r in rows.items()} == want
    assert {(0, 0), (1, 1), (2, 2), (4, 2), (5, 2), (None, 0)} == set(want)


def test_gru_gradient():
    shape = gru.Shape(3, 4, 2, 5)
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in gru.start(shape, np.arange(5) + 1.0, np.arange(12) + 1.0).items()}
    texts = [rng.integers(0, 14, 7), rng.integers(0, 14, 9)]

    class Kept(gru.Trainer):
        def _adam(self, grads, n):
            self.g = {k: v.copy() for k, v in grads.items()}

    t = Kept(p, shape)
    first = np.zeros(16, bool)
    first[[0, 7]] = True
    t._window(np.concatenate(texts)[None, :], first[None, :], np.ones((1, 16), bool), np.zeros((1, 5)))
    for name in gru.NAMES:
        i = tuple(rng.integers(0, s) for s in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][i] += 1e-4
        down[name][i] -= 1e-4
        assert (gru.scores(down, shape, texts).sum() - gru.scores(up, shape, texts).sum()) / 2e-4 == pytest.approx(t.g[name][i], abs=1e-5)
    assert np.exp(gru.outputs(p, shape, np.tile(rng.standard_normal((1, 5)), (14, 1)), np.arange(14))).sum() == pytest.approx(1)


def test_lm(spark, docs, texts):
    rows = [(r.doc_id, r) for r in lm.scored(docs, gru.Shape(4, 4, 4, 6), rounds=2).collect()]
    assert len(rows) == len(all_rows(texts))
    tokens = [(i, t.encode().lower().split() + [b""]) for i, t in all_rows(texts)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    from collections import Counter

    c = Counter(w for i, t in tokens if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = {str(i): sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for i, t in tokens}
    for i, r in rows:
        assert r.base_score == pytest.approx(want[str(i)]) and r.train_tokens == n and r.held_out == out(i)
        t = next(t for k, t in tokens if k == i and len(t) == r.n_tokens)
        assert r.n_known == sum(c[w] > 0 for w in t)
    assert sum(r.score for _, r in rows) > sum(r.base_score for _, r in rows) * 1.2
    assert lm.scored(docs.limit(0), gru.Shape(4, 4, 4, 6), rounds=1).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, base, tail = say(25), say(200), say(60)
    rows = [(1, say(120) + " " + item), (2, base), (3, base + " end"), (4, say(100) + " " + tail), (5, say(100) + " " + tail), (6, "x"), (7, None), (8, "junk !! " * 100), (None, say(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 4)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {2, 4, 5, None}


def test_cuts_within_characters(spark):
    import corpus_pipeline

    shared = "é" + "ab" * 30 + "é"
    rows = [(1, "x " + shared + " y"), (2, "own \ufffd and \ue000b " + shared[:-1] + "è end \ufffd")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    data = [t.encode() for _, t in rows]
    strings = {data[0][i : i + 50] for i in range(len(data[0]) - 49)}
    gone = set()
    for i in range(len(data[1]) - 49):
        if data[1][i : i + 50] in strings:
            gone |= set(range(i, i + 50))
    left = bytes(c for i, c in enumerate(data[1]) if i not in gone)
    want = left.decode("utf-8", "ignore")
    assert left != want.encode() and "\ufffd" in want and "\ue000b" in want
    assert got[1].text == rows[0][1] and got[2].text == want and got[2].n_chars == len(want)


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, row int, kept string"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_rows_of_one_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b, c, item = say(200), say(200), say(200), say(30)
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    near = make([(1, a), (1, a), (None, b), (None, b), (None, a), (2, a + " end"), (2, c), (3, ""), (3, ""), (4, "")])
    assert kept(corpus_pipeline.near_dedup(spark, near, "")) == sorted([("1", a), ("None", b), ("2", c), ("3", ""), ("4", "")])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leaky = make([(None, a + " " + item), (None, b), (5, item), (5, c)])
    assert kept(corpus_pipeline.decontaminate(spark, leaky, str(tmp_path))) == sorted([("None", b), ("5", c)])
