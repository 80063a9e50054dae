"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textorbit.llm import (
    chat,
    checks,
    factors,
    licenses,
    mixing,
    neardup,
    negatives,
    neighbours,
    packing,
    quality,
    revisits,
    runs,
    token_output,
    tokens,
)

BYTE_PAIRS = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(checks.LICENSES)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence or notice that each document is, and those that its lines name."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Placed pieces of all documents with a checksum of their ids."""
    pieces = packing.token_pieces(docs, BYTE_PAIRS)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.pack(pieces, ["doc_id", "start"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed windows."""
    return packed_pieces(table(spark, sf_dir, "documents"))


@query(checks.CHATS)
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    odd = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    own = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(conversations.unionByName(own)))


#: Weights of domains, languages and sources.
TREE = {
    "web": 4,
    "forum": 2,
    "books": 3,
    "code": 1,
    "*/en": 5,
    "*/de": 2,
    "*/fr": 2,
    "*/es": 1,
    "books/en": 4,
    "web/en/src0": 3,
}


def with_leaves(docs: DataFrame, *carried: str) -> DataFrame:
    """Domain by number of the source, and tokens as four bytes each; ``carried`` columns stay."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    place = F.when(number == "", F.lit(0)).otherwise((number.cast("long") / 5).cast("long") % 4)
    domain = F.element_at(F.array(*[F.lit(d) for d in ("web", "forum", "books", "code")]), (place + 1).cast("int"))
    size = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    leaves = docs.withColumn("domain", F.coalesce(domain, F.lit("web"))).withColumn("tokens", size)
    return leaves.select("doc_id", *carried, "domain", "lang", "source", "tokens")


@query(checks.MIXING)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for 60 % of all tokens, twice at most; French books never."""
    docs = with_leaves(table(spark, sf_dir, "documents"))
    return mixing.mix(docs, TREE | {"books/fr": 0}, budget=F.expr("sum(total) * 3 div 5"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), PIECES)


@query()
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrix of all documents."""
    return token_output.packed_matrices(table(spark, sf_dir, "documents"), BYTE_PAIRS)


@query()
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 100 = 0"))


def archive_records(pages: DataFrame) -> DataFrame:
    """A full response and a later (at times earlier) revisit for each page.

    Dates follow from the page's number, validators from its content; revisits spell
    the address in other ways and carry an equal, weak, missing or changed entity tag.
    """
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(page_id % 365, 0, 0, page_id % 86400)")
    later = F.expr("day + make_dt_interval(if(page_id % 11 = 0, -3, page_id % 7 + 1))")
    pages = pages.select("page_id", "url", "html").withColumn("day", day).withColumn("later", later)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    shape = "yyyy-MM-dd HH:mm:ss"
    since = F.date_format(F.expr("day - interval 1 day"), shape)

    def headers(**fields):
        pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")), v.cast("string")) for k, v in fields.items()])
        return F.map_filter(F.map_from_entries(pairs), lambda k, v: v.isNotNull())

    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        F.col("day").alias("date"),
        F.lit("response").alias("kind"),
        headers(
            content_type=F.lit("text/html"),
            content_length=F.octet_length("html"),
            date=F.date_format("day", shape),
            etag=F.when(F.expr("page_id % 9 != 0"), tag),
            last_modified=since,
        ).alias("headers"),
    )
    turn = F.expr("page_id % 5")
    spelled = F.expr(
        "case page_id % 3 when 0 then url when 1 then regexp_replace(url, '^https?://', 'HTTPS://WWW.')"
        " else concat(url, '#again') end"
    )
    fresh = F.when(turn == 0, tag).when(turn == 1, F.concat(F.lit("W/"), tag)).when(turn == 3, F.lit('"changed"'))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        spelled.alias("url"),
        F.col("later").alias("date"),
        F.lit("revisit").alias("kind"),
        headers(
            date=F.date_format("later", shape),
            cache_control=F.lit("max-age=60"),
            connection=F.lit("close"),
            content_length=F.lit("0"),
            etag=fresh,
            last_modified=F.when(turn == 2, since),
        ).alias("headers"),
    )
    return response.unionByName(revisit)


@query(checks.REVISITS)
def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response and merged headers of each revisit."""
    found = revisits.resolve_revisits(archive_records(table(spark, sf_dir, "pages")))
    line = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return found.withColumn("headers", F.array_join(line, "\n"))


@query(checks.NEAR_DUPLICATES)
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under near-duplicate links."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query(checks.REPEATS)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 50 words that a smaller one has as well."""
    return factors.drop_repeats(table(spark, sf_dir, "documents"))


@query(checks.NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of every fiftieth vector, whose labels are partly wrong."""
    rows = table(spark, sf_dir, "embeddings")
    odd = F.exists("embedding", lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("label is not null and embedding is not null").where(~odd)
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("embedding"))
    return negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0)


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the checksum of the id, repeat a stretch of words to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    chosen = chosen.withColumn("w", words).withColumn("n", F.size("w"))
    chosen = chosen.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    period = F.expr("slice(w, int(a + 1), int(1 + (n - a) div (3 + g % 8)))")
    chosen = chosen.withColumn("period", F.when(F.col("n") > 0, period))
    again = "flatten(array_repeat(period, int((n - a) div size(period) + 1)))"
    text = F.expr(f"concat_ws(' ', slice(w, 1, int(a)), slice({again}, 1, int(n - a)))")
    return chosen.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each document, after a tenth of them were made periodic."""
    return runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
