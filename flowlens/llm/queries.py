"""The queries of these operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, mixing, neardup, quality, substr, tokenbin, toxicity, urlrep, wordpiece


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels"))))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_read(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digest(tokenbin.encode_corpus(_read(spark, sf_dir, "documents"), _vocabulary()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(_read(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.digest(urlrep.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_turns(chat.from_rows(chat.with_probe(_read(spark, sf_dir, "conversations")))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(_read(spark, sf_dir, "documents"), wordpiece.read_vocabulary(_vocabulary()))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.digest(substr.dedup(_read(spark, sf_dir, "documents"), keep_text=False))


# --- parts of operators that SQL can say, and an operator on inputs that exercise it -----------------


def quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's figures and base rules."""
    out = quality.judge(_read(spark, sf_dir, "documents"))
    return quality.digest(out).drop("kept", "p_good")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's words."""
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_words")


def _hosted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as pages of forty hosts below ten domains, and outcomes: hosts 0 to 4 are bad nine times in ten, the others good so often; a third has none."""
    k, n = F.pmod("doc_id", F.lit(40)), F.floor(F.col("doc_id") / 40)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), k, F.lit(".d"), F.pmod(k, F.lit(10)), F.lit(".example:8080/p")).alias("url"))
    odd = F.pmod(n, F.lit(10)) == 7
    return pages, docs.where(F.pmod(n, F.lit(3)) != 2).select("doc_id", F.when((k < 5) != odd, 0).otherwise(1).alias("quality"))


def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's method on planted hosts, where no rule decides."""
    return urlrep.digest(urlrep.judge(*_hosted(_read(spark, sf_dir, "documents"))))


_HOSTED = """pages AS (SELECT doc_id AS page_id, 'http://h' || doc_id % 40 || '.d' || doc_id % 40 % 10 || '.example:8080/p' AS url FROM documents),
labels AS (SELECT doc_id, CASE WHEN (doc_id % 40 < 5) <> (doc_id // 40 % 10 = 7) THEN 0 ELSE 1 END AS quality FROM documents WHERE doc_id // 40 % 3 <> 2),"""


def queries() -> dict:
    more = {f.__name__: f for f in (quality_figures, word_counts, host_reputation)}
    return {k: v for k, v in globals().items() if k.startswith("op")} | more


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontam.ORACLE,
        "op3_mix_sources": mixing.ORACLE,
        "op7_url_filter": urlrep.ORACLE,
        "op8_chat_format": chat.ORACLE,
        "op10_substring_dedup": substr.ORACLE,
        "quality_figures": quality.FIGURES_ORACLE,
        "word_counts": quality.WORDS_ORACLE,
        "host_reputation": urlrep.ORACLE.replace("WITH ", f"WITH {_HOSTED}", 1),
    }
