"""The engine's inputs, derived by Spark from the test tables.

Every view covers its whole table: a time split or a label split sends each row to
one side or the other, none is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity, ts, line)``: events as runtime behaviour of users."""
    return event_flows(table(spark, sf_dir, "events"))


def event_flows(events: DataFrame) -> DataFrame:
    key = F.get_json_object("props", "$.k")
    return events.select(
        F.col("user_id").cast("string").alias("entity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat("event_type", F.lit(" k:"), key).alias("line"),
    )


def _before_split():
    return F.col("ts") < F.to_timestamp(F.lit(SPLIT))


def reference_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(device, line)``: behaviour before the split date."""
    return (
        flows(spark, sf_dir)
        .filter(_before_split())
        .select(F.col("entity").alias("device"), "line")
        .distinct()
    )


def query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query, expected, line)``: behaviour from the split date on."""
    return (
        flows(spark, sf_dir)
        .filter(~_before_split())
        .select(F.col("entity").alias("query"), F.col("entity").alias("expected"), "line")
        .distinct()
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(device, row_id, embedding, text)``: a text per vector, shared by devices."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("device"),
        F.col("vec_id").alias("row_id"),
        "embedding",
        F.concat(F.lit("rule "), (F.col("vec_id") % 97).cast("string")).alias("text"),
    )


def variant_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(label, row_id, embedding)``: all vectors under seven variants of each label.

    Variants carry the name of the next label, so that the expected device is not
    the one the vectors came from.
    """
    label = F.concat(
        ((F.col("label") + 1) % 10).cast("string"),
        F.lit("_test_"),
        (F.col("vec_id") % 7).cast("string"),
    )
    return table(spark, sf_dir, "embeddings").select(
        label.alias("label"), F.col("vec_id").alias("row_id"), "embedding"
    )


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, entity, text)``: one access-control document per event.

    The five event types give five kinds of entries; large values break the JSON.
    """
    k = F.col("k")
    empty = F.lit("{}")
    from_matches = (
        F.when(
            F.col("event_type") == "signup",
            F.format_string(
                '{"ietf-mud:mud":{"controller":"urn:x:%s"},"ipv4":{"protocol":17},'
                '"udp":{"destination-port":{"operator":"eq","port":%s}}}',
                F.when(k.cast("int") % 2 == 0, "dns").otherwise("gateway"), k,
            ),
        )
        .when(
            F.col("event_type") == "click",
            F.format_string(
                '{"ietf-mud:mud":{"local-networks":[null],"controller":""},'
                '"eth":{"ethertype":"0x0800","destination-mac-address":"00:00:00:00:00:%s"},'
                '"ipv4":{"protocol":6,"ietf-acldns:dst-dnsname":"h%s.example",'
                '"destination-ipv4-network":"10.0.0.%s/32"},'
                '"tcp":{"ietf-mud:direction-initiated":"from-device",'
                '"source-port":{"operator":"range","lower-port":1,"upper-port":%s},'
                '"destination-port":{"operator":"eq","port":443}}}',
                k, k, k, k,
            ),
        )
        .when(
            F.col("event_type") == "view",
            F.format_string(
                '{"ipv6":{"protocol":58,"source-ipv6-network":"fe80::%s/64"},"ipv4":{},'
                '"icmp":{"type":8}}', k,
            ),
        )
        .when(
            F.col("event_type") == "purchase",
            F.format_string(
                '{"ipv4":{"protocol":2,"destination-ipv4-network":"224.0.0.%s/32"}}', k
            ),
        )
        .when(
            F.col("event_type") == "error",
            F.format_string(
                '{"ipv4":{"protocol":"6","ietf-acldns:src-dnsname":"",'
                '"source-ipv4-network":"10.1.0.%s/32"},"ipv6":{"protocol":17},'
                '"tcp":{"ietf-mud:direction-initiated":"to-device",'
                '"source-port":{"operator":"eq","port":%s}},'
                '"udp":{"ietf-mud:direction-initiated":"to-device"}}', k, k,
            ),
        )
        .otherwise(empty)
    )
    text = F.concat(
        F.lit('{"ietf-access-control-list:access-lists":{"acl":[{"name":"from-x","aces":{"ace":['),
        F.lit('"no object",{"matches":'), from_matches, F.lit('},{"matches":'), from_matches,
        F.lit('}]}},{"name":"to-x","aces":{"ace":[{"matches":{"ipv4":{"protocol":1}}},'),
        F.lit('{"matches":{}}]}},'),
        F.lit('{"aces":null},{"aces":{"ace":[{"matches":{"eth":{"ethertype":null}}}]}}]}}'),
    )
    broken = F.when(F.col("value") > 100, F.substring(text, 1, 60)).otherwise(text)
    # The table is one small file; documents are dear to parse. A document names k many times.
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    events = events.repartition(spark.sparkContext.defaultParallelism, "event_id")
    return events.select(
        F.col("event_id").alias("doc_id"),
        F.col("user_id").cast("string").alias("entity"),
        broken.alias("text"),
    )
