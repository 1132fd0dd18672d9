"""JSON, HTML, URL and file round trips, and the larger plans, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import reconcile
from ..sources import documents, html, tables
from .common import Registry, events, table

registry = Registry()


@registry.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_extract(spark, sf):
    """A typed field of a JSON column."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@registry.add("SELECT conv_id, COUNT(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(SUM(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def json_nest_roundtrip(spark, sf):
    """Rows nested to documents, written as JSON text, read by schema, unnested."""
    rows = table(spark, sf, "conversations")
    nested = documents.nest(rows, ["conv_id"], ["turn"], "turns")
    text = nested.select(documents.to_text("conv_id", "turns").alias("doc"))
    back = documents.from_text(text, "doc", documents.schema_of(nested))
    flat = documents.unnest(back, ["conv_id"], "turns")
    return flat.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"), F.sum(F.length("text")).cast("long").alias("chars"))


@registry.add("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_params(spark, sf):
    """Parts of a URL."""
    return table(spark, sf, "pages").select("page_id", *(c.alias(n) for n, c in html.url_parts(F.col("url")).items()))


@registry.add("SELECT o_orderkey, 'https://example.org/boxes/' || strftime(o_orderdate, '%Y%m%d') || '/' || CAST(o_custkey AS VARCHAR) || '.html?game=' || CAST(o_orderkey AS VARCHAR) AS url FROM orders")
def url_generation(spark, sf):
    """Addresses per row."""
    o = table(spark, sf, "orders")
    url = F.concat(F.lit("https://example.org/boxes/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit(".html?game="), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", url.alias("url")).where(html.query_parameter(F.col("url"), "game") == F.col("o_orderkey").cast("string"))


@registry.add()
def html_links(spark, sf):
    """Links, titles and table cells of raw pages (tested against a reading by hand)."""
    return html.parse_pages(table(spark, sf, "pages"), "page_id", "html")


@registry.add("SELECT NULLIF(c_custkey, 0) AS c_custkey, replace(c_name, ',', ';') AS c_name, NULLIF(c_nationkey, 0) AS c_nationkey, NULLIF(c_acctbal, 0) AS c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf):
    """Exported with clean values, read by schema: 0 and empty are null, commas are semicolons."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return tables.roundtrip(rows, "csv")


@registry.add("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_sink_roundtrip(spark, sf):
    """Written as JSON lines and read by schema."""
    return tables.roundtrip(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "json")


@registry.add("SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INT) AS y FROM orders WHERE year(o_orderdate) = 1996")
def partitioned_sink(spark, sf):
    """Written by year; a filter on the year reads one folder."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    return tables.roundtrip(rows, "parquet", partition_by="y").where("y = 1996").select("o_orderkey", "o_orderstatus", "y")


@registry.add("SELECT table_name, CAST(n AS BIGINT) AS n FROM (SELECT 'region' AS table_name, COUNT(*) AS n FROM region UNION ALL SELECT 'nation', COUNT(*) FROM nation UNION ALL SELECT 'supplier', COUNT(*) FROM supplier) x")
def table_counts(spark, sf):
    """Row counts of several tables (a backup report)."""
    out = None
    for name in ("region", "nation", "supplier"):
        one = table(spark, sf, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("table_name", "n")


@registry.add()
def reconcile_audit(spark, sf):
    """Two event streams of a game reconciled: at-bats from one, pitches from the other, with audits."""
    at_bats, pitches = reconcile.demo_streams(events(spark, sf))
    return reconcile.audit(reconcile.reconcile(at_bats, pitches))
