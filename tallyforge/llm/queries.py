"""One query per operator, over its whole table, with the SQL of those that SQL can express."""

from __future__ import annotations

from tallyforge.llm import ctw, html_extract, linededup, media, minhash, mixing, quality, secrets, sentencepiece, toxicity
from tallyforge.llm.shared import read

QUERIES = {
    "op1_sentencepiece": lambda spark, d: sentencepiece.encode_query(read(spark, d, "documents")),
    "op2_minhash": lambda spark, d: minhash.minhash_query(read(spark, d, "documents")),
    "op3_line_dedup": lambda spark, d: linededup.dedup_query(read(spark, d, "documents")),
    "op4_secrets": lambda spark, d: secrets.secrets_query(read(spark, d, "documents")),
    "op5_toxicity": lambda spark, d: toxicity.toxicity_query(read(spark, d, "documents"), read(spark, d, "labels")),
    "op6_html": lambda spark, d: html_extract.html_query(read(spark, d, "pages")),
    "op7_mixing": lambda spark, d: mixing.mix_query(read(spark, d, "documents")),
    "op8_media": lambda spark, d: media.media_query(read(spark, d, "embeddings")),
    "op9_ctw": lambda spark, d: ctw.score_query(read(spark, d, "documents")),
    "op10_quality": lambda spark, d: quality.quality_query(read(spark, d, "documents")),
}

ORACLE_SQL = {"op4_secrets": secrets.ORACLE, "op7_mixing": mixing.ORACLE}
