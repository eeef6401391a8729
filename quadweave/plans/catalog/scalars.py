"""Scalar functions, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import scalars as S
from quadweave.functions import terms as T
from quadweave.operators.state import instant
from quadweave.plans import fixtures as fx
from quadweave.plans.catalog import register
from quadweave.plans.fixtures import EX, NOW, sql

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@register("s1_coalesce", sql("SELECT draftset, coalesce(title, description, 'none') AS label FROM part_sets"))
def coalesce(spark, sf_dir):
    return fx.registry(spark, sf_dir).draftsets.select("draftset", F.coalesce("title", "description", F.lit("none")).alias("label"))


@register("s2_conditional", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'edit' ELSE 'publish' END AS permission FROM orders")
def conditional(spark, sf_dir):
    orders = fx.read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "edit").otherwise("publish").alias("permission"))


@register("s3_concat_to_iri", "SELECT 'http://example.com/nation/'||n_name AS value, 'iri' AS kind FROM nation, (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey = n_nationkey")
def concat_to_iri(spark, sf_dir):
    nation = fx.read(spark, sf_dir, "nation")
    used = fx.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    made = nation.join(used, "n_nationkey", "left_semi").select(T.iri(F.concat(F.lit(EX + "nation/"), F.col("n_name"))).alias("t"))
    return made.select("t.value", "t.kind")


@register("s4_uuids", "SELECT c_custkey, true AS random_ok, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS keyed FROM (SELECT c_custkey, md5(c_name||'|x') AS h FROM customer)")
def uuids(spark, sf_dir):
    customer = fx.read(spark, sf_dir, "customer")
    return customer.select(
        "c_custkey", S.full_match(S.random_uuid(), _UUID).alias("random_ok"), S.keyed_uuid(F.col("c_name"), F.lit("x")).alias("keyed")
    )


@register("s5_current_time", f"SELECT o_orderkey, o_orderdate < TIMESTAMP '{NOW}' AS before FROM orders")
def current_time(spark, sf_dir):
    orders = fx.read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", (F.col("o_orderdate").cast("timestamp") < instant(NOW)).alias("before"))


@register(
    "s6_comparison",
    "SELECT p_partkey, p_brand = 'Brand#13' AS same, CAST(p_size AS BIGINT) > 10 AS larger, lpad(CAST(p_size AS VARCHAR), 4, '0') = CAST(p_size AS VARCHAR) AS same_term FROM part",
)
def comparison(spark, sf_dir):
    """Terms compare by all their parts, values by their cast: 0007 and 7 differ only as terms."""
    integer = "http://www.w3.org/2001/XMLSchema#integer"
    size = F.col("p_size").cast("string")
    plain, padded = T.literal(size, integer), T.literal(F.lpad(size, 4, "0"), integer)
    return fx.read(spark, sf_dir, "part").select(
        "p_partkey",
        T.same_term(T.literal(F.col("p_brand")), T.literal("Brand#13")).alias("same"),
        (T.as_integer(padded) > 10).alias("larger"),
        T.same_term(plain, padded).alias("same_term"),
    )


@register("s7_regex", "SELECT c_custkey, regexp_full_match(c_name, 'Customer#0+[0-9]{2}') AS short, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number FROM customer")
def regex(spark, sf_dir):
    return fx.read(spark, sf_dir, "customer").select(
        "c_custkey",
        S.full_match(F.col("c_name"), "Customer#0+[0-9]{2}").alias("short"),
        F.regexp_extract("c_name", r"(\d+)$", 1).cast("bigint").alias("number"),
    )


@register("s8_split_join", "SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), '; ') AS words FROM part")
def split_join(spark, sf_dir):
    return fx.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("; ", F.reverse(F.split("p_name", " "))).alias("words"))


@register("s9_md5", "SELECT doc_id, md5(text) AS hash FROM documents")
def md5(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))


@register("s10_epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def epoch_millis(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select("event_id", S.epoch_millis(F.col("ts").cast("timestamp")).alias("millis"))


@register("s11_later_time", "SELECT event_id, epoch_us(greatest(ts, TIMESTAMP '2024-01-15')) AS later FROM events")
def later_time(spark, sf_dir):
    later = S.later(F.col("ts").cast("timestamp"), instant("2024-01-15 00:00:00"))
    return fx.read(spark, sf_dir, "events").select("event_id", F.unix_micros(later).alias("later"))


@register("s12_iri_paths", "SELECT page_id, rtrim(url, '/')||'/a/'||page_id AS longer, regexp_extract(url, '([^/]+)$', 1) AS last FROM pages")
def iri_paths(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select(
        "page_id",
        S.append_path(F.col("url"), F.lit("a"), F.col("page_id").cast("string")).alias("longer"),
        S.last_segment(F.col("url")).alias("last"),
    )


@register("s13_user_iris", "SELECT c_custkey, 'mailto:'||c_name AS iri, c_name AS name FROM customer")
def user_iris(spark, sf_dir):
    iri = S.user_iri(F.col("c_name"))
    return fx.read(spark, sf_dir, "customer").select("c_custkey", iri.alias("iri"), S.user_name(iri).alias("name"))


@register("s14_membership", "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'widget') AS has, list_has_any(string_split(p_name, ' '), ['cold', 'bolt']) AS meets FROM part")
def membership(spark, sf_dir):
    words = F.split("p_name", " ")
    return fx.read(spark, sf_dir, "part").select(
        "p_partkey", F.array_contains(words, "widget").alias("has"), F.arrays_overlap(words, F.array(F.lit("cold"), F.lit("bolt"))).alias("meets")
    )


@register(
    "s15_lexical_forms",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.')||lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') AS local,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.')||lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0')||'Z' AS zoned, strftime(ts, '%Y-%m-%d') AS day,
    CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS flag FROM events""",
)
def lexical_forms(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select(
        "event_id",
        T.local_datetime_lexical(F.col("ts")).alias("local"),
        T.datetime_lexical(F.col("ts").cast("timestamp")).alias("zoned"),
        T.date_lexical(F.col("ts")).alias("day"),
        T.boolean_lexical(F.col("value") > 50).alias("flag"),
    )


