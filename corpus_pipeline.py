"""The corpus pipeline: documents through its stages, each written as Parquet and reread as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.llm import bpe, language, mixing, near_dedup, pii
from murmur.llm.common import release, scratch_path, written


def identify_language(spark, docs, sf_dir):
    """Documents with a letter whose language is told with some certainty; the others go."""
    release(spark)
    path = language.pieces_path()
    return language.keep_identified(docs, language.learn(docs, path), path)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8."""
    release(spark)
    gone = written(near_dedup.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def sanitise_personal_data(spark, docs, sf_dir):
    """All documents, personal data in their texts replaced and what discloses it generalised or removed."""
    release(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Documents drawn so that sources, languages and topics come near their target weights."""
    release(spark)
    return mixing.mix(docs).where("__kept").select(*docs.columns)


def encode_bpe(spark, docs, sf_dir):
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each document, with the SHA-256 of the ids
    and of the text that they decode to."""
    release(spark)
    rows = bpe.encode(docs, bpe.vocabulary_path(), decoded=True)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", sanitise_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_bpe),
]

#: SQL can't express the language model, the exact groups of near duplicates or the encoding.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
