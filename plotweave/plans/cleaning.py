"""Queries of cleaning, classification and coercion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numeric, text
from . import inputs
from .register import query

# Raw purposes in the spellings that the rules are for; rows take them in turn.
PURPOSES = ("Espaço Estacionamento", "Garagem hotel", "Área a vistoriar", "Sobra de Área", "Área projetada de gleba", "TERRENO vago", "Imóvel especial", "Hotel  (4*)", "Apartamento", "Residência", "Loja 2", "sala", "Unidade autônoma de Comércio", "Posto de combustível", "Depósito/Armazém", "", "Box 12 vaga", "outro uso")
_SQL_PURPOSE = "[" + ", ".join(f"'{p}'" for p in PURPOSES) + f"][(p_partkey % {len(PURPOSES)}) + 1]"


def purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, PURPOSES)), (F.col("p_partkey") % len(PURPOSES) + 1).cast("int")).alias("purpose"))


def sql_normalise(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(upper(replace({col}, 'ß', 'SS'))), '[^A-Z0-9? ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, CAST(length({sql_normalise('text')}) AS INTEGER) AS n, md5({sql_normalise('text')}) AS digest, md5(regexp_replace({sql_normalise('text')}, '[^A-Z0-9?]', '', 'g')) AS squeezed FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.read(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"), F.md5(text.squeeze(F.col("t"))).alias("squeezed"))


def _sql_rules(value: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{r['pattern']}') THEN '{r[value]}'" for r in text.RULES) + " END"


@query(f"WITH p AS (SELECT p_partkey, {sql_normalise(_SQL_PURPOSE)} AS t FROM part) SELECT p_partkey, {', '.join(f'{_sql_rules(v)} AS {v}' for v in ('category', 'subcategory', 'confidence'))} FROM p")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = purposes(spark, sf_dir).select("p_partkey", text.normalise(F.col("purpose")).alias("t"))
    return p.select("p_partkey", *(text.classify(F.col("t"), text.RULES, v).alias(v) for v in ("category", "subcategory", "confidence")))


@query(f"WITH p AS (SELECT p_partkey, {sql_normalise(_SQL_PURPOSE)} AS t FROM part) SELECT p_partkey, " + ", ".join(f"regexp_matches(t, '{p}') AS {n}" for n, p in text.PARKING.items()) + " FROM p")
def parking_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = purposes(spark, sf_dir).select("p_partkey", text.normalise(F.col("purpose")).alias("t"))
    return p.select("p_partkey", *(text.parking_flag(F.col("t"), d).alias(d) for d in text.PARKING))


_NAME = "concat(CASE WHEN p_partkey % 3 = 0 THEN 'cd' ELSE 'ca' END, p_size, 'g', p_partkey % 4, 'b', p_partkey % 7, 'k', p_partkey % 2, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE '' END)"


@query(f"WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part) SELECT p_partkey, name, CASE WHEN regexp_matches(name, '{text.MEASURE_NAME}') THEN regexp_extract(name, '{text.MEASURE_NAME}', 1) END AS stem, " + ", ".join(f"TRY_CAST(regexp_extract(name, '{text.MEASURE_NAME}', {i}) AS BIGINT) AS {n}" for i, n in enumerate(("radius", "gamma", "beta", "k_offset"), 2)) + " FROM n")
def param_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat(text.encode_measure(F.when(key % 3 == 0, "cd").otherwise("ca"), F.col("p_size"), key % 4, key % 7, key % 2), F.when(key % 11 == 0, "x").otherwise(""))
    out = inputs.read(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("d", text.decode_measure(F.col("name")))
    return out.select("p_partkey", "name", "d.stem", "d.radius", "d.gamma", "d.beta", F.col("d.offset").alias("k_offset"))


_COLUMN = "concat(CASE p_partkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'G' ELSE 'X' END, CASE WHEN p_partkey % 4 = 0 THEN 'g' ELSE CAST(p_partkey * 31 AS VARCHAR(20)) END, CASE p_partkey % 5 WHEN 0 THEN 'Acc' WHEN 1 THEN 'Btw' WHEN 2 THEN 'Rea' WHEN 3 THEN 'Cnc' ELSE 'Abc' END, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '1' END)"


@query(f"SELECT p_partkey, {_COLUMN} AS name, regexp_matches({_COLUMN}, '{text.PLUGIN_NAME}') AS known FROM part")
def plugin_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.read(spark, sf_dir, "part").selectExpr("p_partkey", f"{_COLUMN} AS name").withColumn("known", text.plugin_column(F.col("name")))


_RAW = "CASE p_partkey % 6 WHEN 0 THEN 'INDETERMINADO' WHEN 1 THEN '' WHEN 2 THEN 'NA' WHEN 3 THEN '12,5' WHEN 4 THEN ' ' || p_size || '.25 ' ELSE CAST(p_size AS VARCHAR) END"


@query(f"WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part) SELECT p_partkey, CASE WHEN trim(raw) NOT IN ('INDETERMINADO', '', 'NA') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS value, regexp_matches(raw, '^\\s*-?[0-9.]*,[0-9]+\\s*$') AS comma, lower(trim(raw)) IN ('1', 'true', 't', 'yes', 'y') AS truthy FROM r")
def coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW.replace("VARCHAR", "STRING"))
    out = inputs.read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return out.select("p_partkey", numeric.coerce(F.col("raw")).alias("value"), text.decimal_comma(F.col("raw")).alias("comma"), text.truthy(F.col("raw")).alias("truthy"))


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 0 THEN round(ln(o_totalprice), 6) END AS ln_price, round(ln(o_totalprice + 1), 6) AS ln1_price, concat_ws('|', o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR)) AS key, regexp_extract(concat_ws('|', o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR)), '^(.*)\\|[^|]*$', 1) AS key_head FROM orders")
def keys_and_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.read(spark, sf_dir, "orders").withColumn("key", F.concat_ws("|", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")))
    return o.select("o_custkey", "o_orderkey", F.round(numeric.log_or_null(F.col("o_totalprice")), 6).alias("ln_price"), F.round(numeric.log_or_null(F.col("o_totalprice"), "log_plus_c"), 6).alias("ln1_price"), "key", text.before_last(F.col("key"), "|").alias("key_head"))
