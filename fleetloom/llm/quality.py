"""Quality rules: counts within each text, and a hashed n-gram likelihood ratio. Native expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, pick, written
from .native import hashes, longer, words

#: Trusted ids go to all executors up to this many (8 bytes each); beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Up to so many windows of a text a hash and its place share 64 bits, with 52 of the hash at least.
PACKED = 4096


def _repeats(tri: str) -> str:
    """SQL: words in 3-word windows found twice or more, from an array column of window hashes.

    Most texts have no such window, which their distinct hashes tell. In others windows are sorted
    with their places, so equal ones become neighbours: as one number with the place in the low bits
    where that leaves enough of the hash, else as pairs. Places of those with an equal neighbour,
    sorted again, cover three words each, less what they share with the one before.
    """
    packed = f"sort_array(transform({tri}, (x, i) -> (x & {-PACKED}L) | i))"
    near = f"(get(s, i - 1) & {-PACKED}L)", f"(get(s, i + 1) & {-PACKED}L)"
    few = f"transform(array({packed}), s -> transform(filter(s, (x, i) -> (x & {-PACKED}L) = {near[0]} or (x & {-PACKED}L) = {near[1]}), x -> x & {PACKED - 1}L))[0]"
    pairs = f"sort_array(transform({tri}, (x, i) -> struct(x as h, i as p)))"
    many = f"transform(array({pairs}), s -> transform(filter(s, (x, i) -> x.h = get(s, i - 1).h or x.h = get(s, i + 1).h), x -> cast(x.p as bigint)))[0]"
    places = f"sort_array(if(size({tri}) <= {PACKED}, {few}, {many}))"
    new = "aggregate(transform(p, (x, i) -> if(i = 0, 3L, least(3L, x - get(p, i - 1)))), 0L, (a, x) -> a + x)"
    return f"if(size(array_distinct({tri})) = size({tri}), 0L, transform(array({places}), p -> {new})[0])"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that a label calls good."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, prior: float, steady: float) -> DataFrame:
    """(ratios): one row, for each n-gram bucket log P(trusted) - log P(raw corpus) in millionths, from all documents.

    Words and word pairs are hashed to buckets. Both multinomials are taken on the scale of the
    trusted one with `prior` more in each bucket, else a bucket that neither has would tell something.
    A ratio counts by n / (n + steady), n the raw corpus' count: what few n-grams show is chance, and
    would speak against every text whose rare words no trusted text has. The number of buckets bounds
    what the counts and the row hold.
    """
    good = trusted_ids(labels)
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = pick(docs, "doc_id", "text").join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("good_id"), "left")
    split = marked.select(F.col("good_id").isNotNull().cast("long").alias("good"), words("text").alias("w"))
    # Each word with the next one as a row. explode_outer: Spark would filter on the size of what explode() takes, and compute it anew for that.
    pairs = split.select("good", F.explode_outer(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("z")).where("z is not null")
    hashed = pairs.select("good", F.xxhash64("z.a").alias("x"), F.xxhash64("z.b").alias("y"), F.col("z.b").isNull().alias("last"))
    both = F.expr(f"array((x & {buckets - 1}) * 2 + good, if(last, null, (xxhash64(x, y) & {buckets - 1}) * 2 + good))")
    counts = hashed.select(F.explode_outer(both).alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    sums = counts.groupBy(F.shiftright("k", 1).alias("b")).agg(F.sum(F.when(F.col("k") % 2 == 1, F.col("n"))).alias("trusted"), F.sum("n").alias("raw"))
    sums = written(sums.na.fill(0).coalesce(1))
    totals = sums.agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")).first()
    scale = (totals.trusted or 0) / max(totals.raw or 0, 1)
    ratio = (F.ln(F.col("trusted") + prior) - F.ln(F.col("raw") * scale + prior)) * F.col("raw") / (F.col("raw") + steady)
    known = docs.sparkSession.range(0, buckets, 1, 1).join(sums.withColumn("v", F.round(ratio * 1e6).cast("long")), F.col("id") == F.col("b"), "left")
    row = known.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).alias("v")))).alias("all"))
    return written(row.select(F.expr("transform(all, x -> x.v)").alias("ratios")).coalesce(1))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = -0.13, buckets: int = 1 << 18, prior: float = 1.0, steady: float = 30.0, least_words: int = 50, most_repeated: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts on every whole text: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, llr), and the columns to `carry` after doc_id.

    Base rules: fewer than least_words words, or over most_repeated percent of the words in 3-word
    windows that the text has twice or more. Then the mean over all words and word pairs of the
    hashed n-gram log-likelihood ratio between the multinomial of trusted documents (labels.quality
    = 1) and that of the raw corpus; a text is kept at threshold or more. Ratios are whole
    millionths, so sums and verdicts don't depend on the order of rows. buckets is a power of two.

    Null text: as empty, fails the base rules; llr 0. No trusted documents: no bucket tells
    anything, every llr is 0. Null doc_id: judged, never trusted.
    Repeated rows stay rows and count again. No documents: no rows.
    """
    ratios = log_ratios(docs, labels, buckets, prior, steady).scalar()
    text = F.coalesce("text", F.lit(""))
    each = (
        pick(docs, *dict.fromkeys(("doc_id", "text", *carry)))
        .withColumn("w", words("text"))
        .withColumn("h", hashes("w"))
        .withColumn("h2", longer("h", "h", 2))
        .withColumn("tri", longer("h2", "h", 3))
        .withColumn("ratios", ratios)
        .withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
        .select(
            "doc_id",
            *carry,
            F.size("w").cast("long").alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.expr(_repeats("tri")).alias("n_repeat_words"),
            F.expr(f"aggregate(concat(h, h2), 0L, (a, x) -> a + get(ratios, cast(x & {buckets - 1} as int)))").alias("total"),
            (F.size("h") + F.size("h2")).alias("grams"),
        )
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    passed = F.col("total") >= F.col("grams").cast("long") * round(threshold * 1e6)
    llr = F.col("total") / F.greatest("grams", F.lit(1)) / 1e6
    return each.select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"), llr.alias("llr"))


def op2_quality_rules(spark, sf_dir):
    """Contract query of operator 2 over all of documents."""
    from ._common import table

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
