"""The given tables under names that the discovery rules can match (o_orderkey -> order_key)."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tablescope.functions import col
from tablescope.sources import TableSet

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
OTHER = ["events", "documents", "labels", "pages", "benchmark", "conversations", "embeddings"]
SPLIT = {
    "orderkey": "order_key", "custkey": "cust_key", "partkey": "part_key", "suppkey": "supp_key",
    "nationkey": "nation_key", "regionkey": "region_key", "linenumber": "line_num",
}
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "embeddings": ["vec_id", "embedding", "label"],
}
# Kinds as the classification rules see them.
KINDS = {
    "i": "r_regionkey n_nationkey n_regionkey c_custkey c_nationkey s_suppkey s_nationkey p_partkey p_size "
    "o_orderkey o_custkey l_orderkey l_partkey l_suppkey l_linenumber event_id user_id doc_id n_chars quality "
    "toxic page_id item_id conv_id turn vec_id label",
    "n": "c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax value",
    "d": "o_orderdate l_shipdate ts",
}


def plain(name: str, table: str) -> str:
    if table not in STAR:
        return name
    short = re.sub(r"^[a-z]{1,2}_", "", name)
    return SPLIT.get(short, short)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*[col(c).alias(plain(c, table)) for c in df.columns])


def tables(spark: SparkSession, sf_dir: str, *names: str) -> TableSet:
    chosen = list(names or STAR + OTHER)
    with ThreadPoolExecutor(max_workers=8) as pool:
        return TableSet(zip(chosen, pool.map(lambda n: read(spark, sf_dir, n), chosen)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the quality labels that exist for some of them."""
    from tablescope.operators.joins import merge

    return merge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", "left")


def sql(table: str, *names: str) -> str:
    """A DuckDB sub-query giving the same columns as ``read``."""
    chosen = names or COLUMNS[table]
    return "(SELECT " + ", ".join(f"{c} AS {plain(c, table)}" for c in chosen) + f" FROM {table})"


def kind(column: str) -> str:
    if column == "embedding":
        return "array"
    for k, names in KINDS.items():
        if column in names.split():
            return {"i": "integer", "n": "number", "d": "datetime"}[k]
    return "text"
