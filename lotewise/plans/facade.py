"""Listings, observations and sources made from the benchmark tables, so that every operator runs over whole tables.

The same SELECT lists serve Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import default_row

_LISTING = {
    "id": "concat('', p_partkey)",
    "fonte": "concat('f', p_partkey % 7)",
    "chave": "concat('f', p_partkey % 7, ':', p_partkey)",
    "ord": "p_partkey",
    "plataforma": "CASE WHEN p_partkey % 7 = 0 THEN 'chavesnamao' ELSE 'msys' END",
    "url": "concat('https://example.org/', p_partkey)",
    "titulo": "p_name",
    "tipo": "CASE p_size % 8 WHEN 0 THEN 'apartamento' WHEN 1 THEN 'kitnet' WHEN 2 THEN 'casa' WHEN 3 THEN 'sobrado' WHEN 4 THEN 'terreno' WHEN 5 THEN 'studio' WHEN 6 THEN 'outro' ELSE 'casa_condominio' END",
    "aluguel": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END",
    "quartos": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 5 END",
    "vagas": "p_size % 3",
    "area": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 1.5e0 END",
    "bairro": "p_brand",
    "descricao": "p_type",
    "cidade": "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'São Manuel' ELSE 'Botucatu' END",
    "lat": "CASE WHEN p_partkey % 3 = 0 THEN p_size * 1e0 END",
    "lng": "CASE WHEN p_partkey % 3 = 0 THEN p_size * -2e0 END",
    "aceita_pet": "CASE WHEN p_partkey % 4 = 0 THEN true WHEN p_partkey % 4 = 1 THEN false END",
    "primeira_vez": "concat('2024-01-', 10 + p_partkey % 20)",
    "ativo": "p_partkey % 9 <> 0",
    "status": "CASE p_partkey % 6 WHEN 0 THEN 'novo' WHEN 1 THEN 'interesse' WHEN 2 THEN 'contatado' WHEN 3 THEN 'visita' WHEN 4 THEN 'proposta' ELSE 'descartado' END",
    "grupo": "CASE WHEN p_partkey % 4 = 0 THEN concat('g:', p_brand, p_size) END",
}
LISTINGS = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _LISTING.items()) + " FROM part"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State-like rows, one a part."""
    return table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in _LISTING.items()])


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``listings`` with every column of the state's schema."""
    from ..schema import STATE

    return default_row(listings(spark, sf_dir), STATE)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices seen of (fonte, id) over time: a line item is one sighting."""
    return table(spark, sf_dir, "lineitem").selectExpr("concat(l_suppkey, ':', l_partkey) AS chave", "l_suppkey AS fonte", "l_shipdate AS ts", "l_orderkey", "l_linenumber", "l_extendedprice AS aluguel", "l_quantity")


OBSERVATIONS = "SELECT concat(l_suppkey, ':', l_partkey) AS chave, l_suppkey AS fonte, l_shipdate AS ts, l_orderkey, l_linenumber, l_extendedprice AS aluguel, l_quantity FROM lineitem"
