"""The registered queries of the subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.llm.centroids import cluster_vectors
from tabmend.llm.chat_tools import format_chat
from tabmend.llm.common import Workspace, full, table
from tabmend.llm.decontaminate import decontaminate
from tabmend.llm.html_extract import extract_text
from tabmend.llm.line_dedup import dedup_lines
from tabmend.llm.mixing import mix_sources
from tabmend.llm.near_dedup import near_duplicates
from tabmend.llm.quality_model import score_quality
from tabmend.llm.quality_rules import quality_rules
from tabmend.llm.spelling import spelling_groups
from tabmend.llm.substring_dedup import dedup_substrings
from tabmend.llm.url_filter import filter_urls, host_path
from tabmend.llm.warc import read_warc, resolved, write_warc


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op5_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call of the tool ``reply``, made after the one before, and the
    assistant's turn that follows is its result."""
    talk = table(spark, sf_dir, "conversations")
    call_id = lambda back: F.concat(F.lit("c"), "conv_id", F.lit("_"), F.col("turn") - back)
    call = F.struct(
        call_id(0).alias("id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", full(F.col("text")).alias("question"))).alias("arguments"),
        F.array(call_id(2)).alias("after"),
    )
    asks = F.to_json(F.struct(F.lit("").alias("content"), F.array(call).alias("tool_calls")))
    tells = F.to_json(F.struct(full(F.col("text")).alias("content"), call_id(1).alias("tool_call_id")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    wire = talk.select(
        "conv_id", "turn",
        F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, asks).when(assistant, tells).otherwise(F.col("text")).alias("text"),
    )
    schemas = spark.createDataFrame(
        [("reply", "question", "string", True, 300.0), ("reply", "turn", "integer", True, None), ("reply", "lang", "string", False, None)],
        "name string, param string, type string, required boolean, most double",
    )
    return format_chat(wire, schemas).drop("message")  # a turn has one message


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as an archive and read back."""
    spark = pages.sparkSession
    space = Workspace(spark)
    path = space.path("warc")
    write_warc(pages, path)
    records = read_warc(spark, path).withColumn("n", F.octet_length("payload").cast("long")).drop("payload")
    return resolved(space.stored(records, "records")).select(
        F.col("page").cast("long").alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.regexp_replace("digest", "^sha256:", "").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.regexp_extract("refers", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
        "uri",
        "ok",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(full(F.col("text")), 256).alias("kept_sha256")
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digits = F.transform("centroid", lambda x: x.cast("string"))
    return told.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(digits, ","), 256).alias("centroid_sha256"),
    )


#: Rules of the query: host, start of the path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Labels of hosts whose pages make up the list of the query.
JUNK_HOSTS = r"(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the addresses of all pages of junk hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(host_path(F.col("url"))[0].rlike(JUNK_HOSTS))
    return filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality_model": op3_quality_model,
    "op4_html_text": op4_html_text,
    "op5_chat_tools": op5_chat_tools,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling": op11_spelling,
    "op12_clusters": op12_clusters,
    "op13_url_filter": op13_url_filter,
}
