"""The registered queries of this folder: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apexgrid.llm import (
    cap_filters,
    chat_windows,
    content_dedup,
    minmax_dedup,
    packing,
    periodic_runs,
    pivot_search,
    quality_qda,
    repeats,
    ring_shards,
    source_mix,
    spelling_variants,
    warc_index,
)
from apexgrid.llm.columns import WORD

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, and conversation -1 whose texts look like a template's control strings."""
    odd = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = chat_windows.read_back(chat_windows.windows(conversations(spark, sf_dir), whole=True))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select(
        "conv_id",
        "n_turns",
        digest("turns_text").alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        digest("loss_text").alias("loss_sha256"),
        "formatted_chars",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_groups(table(spark, sf_dir, "documents"))


def op6_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), every=100)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mixed(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_index.write_archives(table(spark, sf_dir, "pages"))
    return warc_index.read_records(index).drop("url", "payload")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards.shard(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def vocabulary(docs: DataFrame, at_least: int = 3, letters: int = 5) -> DataFrame:
    """``word, n``: letter runs of the texts, one in 97 of which lacks a code point."""
    runs = docs.select("doc_id", F.explode(spelling_variants.letter_runs("text")).alias("run")).filter(F.length("run") >= letters)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.select("run", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(vocabulary(table(spark, sf_dir, "documents")))


def op12_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; for a tenth of the ids the words from some position on repeat the p words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def periodic(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, bound(found, periodic)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # lengths over periods compared as products
    better = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]
    order = lambda x, y: F.when(better(x, y) != 0, better(x, y)).otherwise(
        F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
    )
    best = F.try_element_at(F.array_sort("runs", lambda x, y: F.signum(order(x, y)).cast("int")), F.lit(1))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), "runs", "kept_text").select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    found = [
        op1_chat_windows,
        op2_packing,
        op3_content_dedup,
        op4_quality_qda,
        op5_minmax_dedup,
        op6_pivot_search,
        op7_source_mix,
        op8_warc_index,
        op9_repeats,
        op10_ring_shards,
        op11_spelling_variants,
        op12_cap_filters,
        op13_periodic_runs,
    ]
    return {f.__name__: f for f in found}
