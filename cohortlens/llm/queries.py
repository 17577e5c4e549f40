"""The registered queries of this package: one thin digest per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, chat, decontaminate, html_extract, html_pages, lexical, line_dedup, near_dup, neighbours, packing, phrases, quality, sharding, token_counts
from cohortlens.llm.common import table

# Where the public tokenizer files are; any other folder with the same files will do.
TOKENIZERS = Path(public_tokenizers.path(""))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return register


@query("op1_line_dedup", line_dedup.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op5_decontamination", decontaminate.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return decontaminate.report(scanned)


@query("op8_chat_formatting", chat.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.rotate(table(spark, sf_dir, "conversations")))


def word_tokenizer() -> bpe.Tokenizer:
    return bpe.Tokenizer.read(str(TOKENIZERS / "word_bpe_49k.json"))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_near_dup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_extract.fit(html_pages.labelled_pages())
    out, text = html_extract.main_text(pages, model, keep=["page_id", "url"])
    return out.select("page_id", "url", text, F.length(text).cast("long").alias("n_chars"))


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits made from its own row: its source put in
    front, forty characters cut from the middle, its language put at the end."""
    counter = token_counts.Counter.read(
        str(TOKENIZERS / "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    length = F.coalesce(F.length("text"), F.lit(0))

    def edit(at, removed, inserted):
        return F.struct(at.alias("at"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    edits = F.array(
        edit(F.lit(0), 0, F.concat(F.coalesce("source", F.lit("")), F.lit(": "))),
        edit(F.floor(length / 2).cast("int"), 40, F.lit("")),
        edit(length + 100, 0, F.concat(F.lit(" "), F.coalesce("lang", F.lit("")))),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.recount(docs, counter, keep=["doc_id"], with_text=False)


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op12_phrases", phrases.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = phrases.frequent(table(spark, sf_dir, "documents"))
    return phrases.collocations(counts)


@query("op11_lexical_search", lexical.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
