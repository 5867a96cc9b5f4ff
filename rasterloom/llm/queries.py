"""The opN queries: thin frames over the operators, each over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, lm, minhash, mixing, packing, pii, quality, tokens, toxicity
from .common import documents, let, materialize, remainder

#: Vocabularies are read from where they are installed, never copied here.
WORD_VOCAB, BYTE_VOCAB = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backoff-automaton score of each text, learnt from rows whose remainder by 7 is not 2."""
    return lm.score(documents(spark, sf_dir), lm.by_remainder(7, 2))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document in the near-duplicate graph."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each text: base counts and digest, and all spans."""
    return pii.summary(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii.*")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each text and of its edited form; see fingerprint.py."""
    rows = fingerprint.with_next(documents(spark, sf_dir))
    n = F.char_length("text").cast("int")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), n - k), F.left(F.col("next_text"), k))
    seen = rows.select(F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text")
    canon = seen.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        let(
            F.struct(*[fingerprint.canonical(F.col(c)).alias(c) for c in ("text", "edited", "next_text")]),
            lambda c: let(
                F.struct(*[fingerprint.digest(c[x]).alias(x) for x in ("text", "edited", "next_text")]),
                lambda f: F.struct(
                    f["text"].alias("fingerprint"),
                    f["edited"].alias("edited_fingerprint"),
                    fingerprint.likeness(c["text"], c["edited"], f["text"], f["edited"]).alias("near_edited"),
                    fingerprint.likeness(c["text"], c["next_text"], f["text"], f["next_text"]).alias("near_next"),
                ),
            ),
        ).alias("v"),
    )
    out = canon.select("doc_id", "n_chars", "edited_sha256", "v.fingerprint", "v.edited_fingerprint", "v.near_edited", "v.near_next")
    out = materialize(out, "fingerprints")
    # groups of equal fingerprints, their bytes compared: only texts that share a fingerprint are read again
    marks = out.select(F.col("doc_id").alias("id"), F.col("fingerprint").alias("f"))
    copies = marks.join(marks.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f"), "f", "left_semi").select("id").distinct()
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("id"), "text").join(copies.withColumnRenamed("id", "k"), F.col("id").eqNullSafe(F.col("k")), "left_semi")
    texts = docs.select("id", let(fingerprint.canonical(F.col("text")), lambda c: F.struct(fingerprint.digest(c).alias("f"), c.alias("c"))).alias("v")).select("id", "v.f", "v.c")
    found = fingerprint.groups(texts, marks).groupBy("id", "f").agg(F.min("group_id").alias("group_id"), F.max("n_copies").alias("n_copies"))
    found = found.select(F.col("id").alias("k"), F.col("f").alias("kf"), "group_id", "n_copies")
    return out.join(found, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("fingerprint") == F.col("kf")), "left").drop("k", "kf")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measurements, the base verdict and the verdict of the newest policy."""
    rows = quality.apply_policy(quality.ledger(documents(spark, sf_dir)), quality.POLICIES["v2"])
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.Policy("base", quality.BASE).mask)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits"
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-centroid language of each text, learnt from rows whose remainder by 3 is not 1."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, ~held)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed(documents(spark, sf_dir), vocabulary(WORD_VOCAB))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of every document under the repetition limit."""
    return mixing.mix(documents(spark, sf_dir)).drop("text", "lang", "n_chars")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each text, learnt from labels whose remainder by 4 is not 2."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels, ~held)
    rows = toxicity.scored(docs, model, lang="lang")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return tokens.token_files(documents(spark, sf_dir), vocabulary(BYTE_VOCAB))[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_near_dedup,
        op3_pii,
        op4_fingerprint,
        op5_language_id,
        op6_quality,
        op7_packing,
        op8_mixing,
        op9_toxicity,
        op10_token_files,
    )
}
