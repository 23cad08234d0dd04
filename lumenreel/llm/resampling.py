"""Importance resampling towards a target: hashed word features, a gain for each bucket, and draws by Gumbel noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch

#: Buckets that features are hashed to.
BUCKETS = 10_000
#: What stands between words, which are runs of 0-9, a-z and everything beyond ASCII, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Drawn rows of a range that is sorted in one task.
RANGE = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a whole text; none for a null text."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, BETWEEN), "")


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of one word, and of every run of two, repeats counted. The words are bound by a lambda, so
    that a text is cut once."""
    hashed = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")

    def each(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: hashed(F.concat(a, F.lit(" "), b)))
        return F.concat(F.transform(w, hashed), pairs)

    return F.element_at(F.transform(F.array(words), each), 1)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): how often each occurs in arrays of buckets. Counts are combined in a task before they are shuffled."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(scratch: Scratch, source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln of the target's smoothed share over the source's) of each bucket: a list of `buckets` numbers."""
    every = scratch.spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_counts(source).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    n = scratch.write(both, "counts")
    whole = n.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(whole["s"] + buckets))) / ((s + 1) * F.lit(float(whole["t"] + buckets)))
    rows = n.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # one row a bucket
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weight_of(buckets: Column, gain: list[int]) -> Column:
    """The floored mean of the gains over an array of buckets; none: 0. The gains are one literal array, made of one literal
    string when the plan is made."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    n = F.size(buckets).cast("long")
    return F.when(n > 0, F.floor((total - F.pmod(total, n)) / n)).otherwise(F.lit(0)).cast("long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times Gumbel noise that follows from the id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scratch: Scratch, scored: DataFrame, share: int) -> DataFrame:
    """scored (row, doc_id, eligible, n_features, weight, score) with rank: 1, 2, 3... over the floor(share * N / 100)
    highest scores of the N eligible rows, ties to the smaller id (none: last), null for all other rows.

    Scores are whole thousandths of logarithms of bounded range, so there are some 10^5 of them at most, however
    many rows: their counts give the score to cut at. Rows from there on are dealt by ranges of (score, id, row)
    and sorted inside; a row's place is its place in its range and the rows of the ranges before. `row` tells
    repeated rows apart, so no tie meets in one task.
    """
    by_score = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    most = F.expr(f"(sum(n) over () * {share}) div 100")
    cut = by_score.withColumn("upto", upto).withColumn("most", most).where("most > 0 and upto >= most").agg(F.max("score").alias("cut"), F.max("most").alias("most")).first()
    names = ["doc_id", "n_features", "weight", "score"]
    if cut["cut"] is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    over = F.col("eligible") & (F.col("score") >= cut["cut"])
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight"), F.col("row")]
    dealt = scored.where(over).repartitionByRange(max(1, -(-cut["most"] // RANGE)), *order).sortWithinPartitions(*order)
    dealt = scratch.write(dealt.select(*names, F.monotonically_increasing_id().alias("at")), "sorted")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    held = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a range
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    first = dealt.withColumn("part", part).withColumn("place", place).join(F.broadcast(held), "part").withColumn("rank", F.when(rank <= cut["most"], rank))
    return first.select(*names, "rank").unionByName(scored.where(~over).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(scratch: Scratch, docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, least_words: int = 20, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: `share` of a hundred of those with enough words are
    drawn without replacement, likelier the more their features are the target's than the source's.

    A document's features are its words and pairs of neighbours, hashed to buckets. A bucket's gain is the log of its
    smoothed share of the target's features over that of the source's; a document's weight is the floored mean of
    its features' gains, its score the weight and Gumbel noise that its id and the seed decide. All counts cover all rows;
    only counts of buckets, and of drawn rows their numbers, are shuffled.

    Null and empty texts and those without a word: weight 0, never drawn. Long texts count whole. Rows that share an id
    share its noise; rows alike are drawn one by one, those with the smaller id first among equal scores, null ids
    (hashed like an empty one) last. Empty target: gains from counts of zero. Empty table: no rows. Other columns are
    not read.
    """
    names = docs.select(F.col(doc_id).cast("long").alias("doc_id"), buckets_of(words(F.col(text)), buckets).alias("buckets"))
    source = scratch.write(names, "features")
    gain = gains(scratch, source, target.select(buckets_of(words(F.col(text)), buckets).alias("buckets")), buckets)
    n = F.size("buckets").cast("long")
    rows = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.alias("n_features"), weight_of(F.col("buckets"), gain).alias("weight"))
    eligible = F.col("n_features") >= max(1, 2 * least_words - 1)  # n words have 2 n - 1 runs of one or two
    scored = scratch.write(rows.select("*", eligible.alias("eligible"), (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scored")
    scratch.drop(source)
    return ranked(scratch, scored, share)


def drawn(docs: DataFrame, result: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn; rows without an id are none."""
    return docs.join(result.where("rank is not null").select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_semi")
