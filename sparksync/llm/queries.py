"""One query per operator, on the shared tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparksync.functions.binding import let
from sparksync.llm.chat import format_chat, learned_text, read_turns
from sparksync.llm.decontaminate import is_contaminated, mark_overlaps, n_hit
from sparksync.llm.near_dups import near_duplicates
from sparksync.llm.ngram_lm import lm_scores
from sparksync.llm.pieces import decode, encode, read_pieces
from sparksync.llm.quality import quality
from sparksync.llm.runs import find_runs
from sparksync.llm.sharding import place
from sparksync.llm.suffix_dedup import mark_repeats
from sparksync.llm.token_counts import token_counts
from sparksync.llm.topk import top_k
from sparksync.llm.toxicity import toxicity
from sparksync.llm.whitening import whiten

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, out = mark_overlaps(docs, table(spark, sf_dir, "benchmark"), width=13)
    items = F.col(f"{out}.items")
    return marked.select(
        "doc_id",
        F.col(f"{out}.n_words").cast("long").alias("n_words"),
        n_hit(out).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        is_contaminated(out).alias("contaminated"),
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, (begin, end) = mark_repeats(docs, width=100)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n_removed = F.aggregate(F.zip_with(begin, end, lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
    # What is kept lies between the end of one removed run and the begin of the next.
    pieces = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col(end)),
        F.concat(F.col(begin), F.array(F.octet_length(raw))),
        lambda a, b: F.hex(F.substring(raw, a + 1, b - a)),
    )
    return marked.select(
        "doc_id",
        F.octet_length(raw).cast("long").alias("n_bytes"),
        n_removed.cast("long").alias("n_removed"),
        F.size(begin).cast("long").alias("n_spans"),
        F.sha2(F.unhex(F.array_join(pieces, "")), 256).alias("kept_sha256"),
    )


def piece_model() -> str:
    """Where the public piece model is; SPARKSYNC_PIECE_MODEL names another file."""
    return os.environ.get("SPARKSYNC_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(piece_model())
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    back = decode(coded, pieces)
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        "piece_ids",
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))).alias("round_trip"),
    )


@query
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SHARDS = [f"shard-{i:02d}" for i in range(48)]


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(piece_model()))


@query
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    chats = format_chat(turns.unionByName(planted), parts="text")
    back = chats.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """The text of every tenth document by hash ends in a repeated stretch of its own words; others are left alone."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")), planted)).otherwise(text)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periodic_tail(F.col("text"), F.col("doc_id")).alias("text"))
    marked, out = find_runs(docs, least=6, periods=4)
    runs = F.col(f"{out}.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    marked = marked.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(f"{out}.collapsed", 256).alias("collapsed_sha256"))
    return marked.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        "best.length",
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=16)
