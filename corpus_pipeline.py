"""A training-corpus pipeline: each stage works on the documents its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common, decontam, langid, minhash, packing, substrings

#: A rejected document has no letters, or its best language holds less than half of the posterior.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found; lang stays as it came.

    Without a training row of known language there is no model; then texts
    without letters are rejected and all others stay. Null texts go; null and
    repeated ids, and columns of any name, stay.
    """
    import pyarrow as pa

    model = langid.learn(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = langid.Scorer(shared.value) if shared.value else None
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            if scorer is None:
                keep = [bool(t) and common.LETTER.search(t) is not None for t in texts]
            else:
                keep = [p != "und" and s >= LEAST_SHARE for p, s in zip(*scorer.predict(texts))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: the smallest id, then text; nulls come last.

    Of equal rows of one id and text one stays. Texts without words, null ones
    too, are classes of their own. All columns stay, whatever their names.
    """
    found = minhash.classes(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    kept = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed[key] == found["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated 200-byte strings from texts; documents of which no word is left go.

    Texts that occur twice as a whole are repeats of each other and go. All
    columns stay, whatever their names; ``n_chars``, where there is one, is
    that of the new text.
    """
    out = substrings.without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with windows of two benchmark items or more, and cut the hit words of one out of the others.

    All other rows and columns stay as they are, null texts and ids too;
    ``n_chars``, where there is one, is that of the new text.
    """
    import pyarrow as pa

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def finish(batch, found):
        cols, names = list(batch.columns), batch.schema.names
        at = names.index("text")
        texts = [decontam.cut_spans(t, f.spans) for t, f in zip(cols[at].to_pylist(), found)]
        cols[at] = pa.array(texts, cols[at].type)
        if "n_chars" in names:
            k = names.index("n_chars")
            cols[k] = pa.array([None if t is None else len(t) for t in texts], cols[k].type)
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array([len(f.items) < 2 for f in found], pa.bool_()))

    return decontam.spans(docs, bench, finish, docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens; a null text is an empty one, and other columns are ignored."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result a written table."""
    common.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
