"""A corpus from raw documents to packed sequences.

Toxicity, line dedup, near-dedup, mixing to target weights, packing. Each stage takes all that
the one before it kept, from a table in the shared folder, and its decisions take effect: rows go, texts
lose lines, rows are repeated. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm import lines, mixing, nearcopies, packing, toxicity
from lumenreel.llm.common import Scratch

#: No SQL: a model is trained, hashes and tokenizers have no counterpart. Tests hold it against brute force.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Empty texts, null texts and null ids are scored like any other."""
    scratch = Scratch(spark, "toxic")
    model = toxicity.fit(scratch, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(scratch, docs, model, out="__toxic").where("__toxic < 0.5").select(docs.columns)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text keeps the first of every class of near-equal lines. No document goes; n_chars follows."""
    out = lines.dedup_lines(Scratch(spark, "lines"), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word similarity 0.8 or more) the document with the smallest id
    stays, once. Candidates come from op1's SimHash components and from MinHash bands; the shingles decide.

    Documents without an id come last: one stays only if its component has no id, that with the smallest
    hash. Rows that share an id are one document, of which the row with the smallest hash stays.
    """
    scratch = Scratch(spark, "copies")
    found = nearcopies.near_copies(scratch, docs)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "n")).alias("at"))
    keep = scratch.write(first.select(F.col("at.uid").alias("__uid"), F.col("at.doc_id").alias("__id"), F.col("at.n").alias("__rows")), "keep")
    kept = docs.withColumn("__own", F.xxhash64(*docs.columns))
    kept = kept.join(keep, (kept["__own"] == keep["__uid"]) & kept["doc_id"].eqNullSafe(keep["__id"]))
    row = F.struct(*docs.columns)
    one = kept.where("__rows > 1").groupBy("__id", "__uid").agg(F.first(row).alias("row")).select("row.*")
    return kept.where("__rows = 1").select(docs.columns).unionByName(one)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix takes it: not at all, or up to three times. Null texts and null sources are
    mixed like any other; rows alike in id, source and text are all taken or none; columns keep their names."""
    out = mixing.mix(Scratch(spark, "mix"), docs).apply(docs)
    copies = F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return out.withColumn("__copy", F.explode(copies)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. Null texts hold an end id only; repeated rows are packed as often as they stand;
    other columns are not read."""
    import public_tokenizers

    return packing.pack(Scratch(spark, "pack"), docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_out),
    ("near-dedup", copies_out),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. An empty table gives no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
