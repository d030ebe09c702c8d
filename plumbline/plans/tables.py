"""Profile, encoding and data-quality jobs, and source round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import text as TX
from plumbline.operators import encode, moments, profile, quality
from plumbline.plans.inputs import SQL_WS, decisions, sql_strip
from plumbline.plans.registry import job, rounded
from plumbline.session import scratch_path
from plumbline.sources import matrix, registry, tables
from plumbline.sources.tables import load

LINE_COLUMNS = [
    ("l_orderkey", 1), ("l_partkey", 1), ("l_suppkey", 1), ("l_linenumber", 1), ("l_quantity", 1),
    ("l_extendedprice", 1), ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 0), ("l_linestatus", 0), ("l_shipdate", 0),
]


def _profile_sql(table: str, columns: list[tuple[str, int]]) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS position, {numeric} = 1 AS is_numeric, count(*) AS n_rows, count({c}) AS n_present,
count(DISTINCT {c}) AS nd, CASE WHEN count(DISTINCT {c}) <= 10 THEN list_sort(list(DISTINCT CAST({c} AS VARCHAR))) END AS listed FROM {table}"""
        for i, (c, numeric) in enumerate(columns)
    )
    return f"""SELECT "column", position, n_rows, n_present, nd AS n_distinct, type,
  CASE WHEN type = 'binary' THEN CASE WHEN position = {len(columns) - 1} THEN 'target' ELSE 'protected_attribute' END
       WHEN type = 'categorical' THEN 'protected_attribute' ELSE 'feature' END AS suggested_role,
  CASE WHEN type IN ('binary', 'categorical') THEN array_to_string(listed, '|') END AS listed_values,
  type = 'binary' AS binary_like
FROM (SELECT *, CASE WHEN nd BETWEEN 1 AND 2 THEN 'binary' WHEN NOT is_numeric AND nd BETWEEN 1 AND 10 THEN 'categorical'
                     WHEN is_numeric THEN 'numeric' ELSE 'text' END AS type FROM ({rows}))"""


def _profile(df):
    return profile.profile(df).select(
        "column", "position", "n_rows", "n_present", "n_distinct", "type", "suggested_role",
        F.array_join("values", "|").alias("listed_values"), (F.col("type") == "binary").alias("binary_like"),
    )


@job("profile_lineitem", "P2 P3", _profile_sql("lineitem", LINE_COLUMNS))
def profile_lineitem(spark, d):
    return _profile(load(spark, d, "lineitem"))


@job("profile_orders", "P2 P3", _profile_sql("orders", [
    ("o_orderkey", 1), ("o_custkey", 1), ("o_orderstatus", 0), ("o_totalprice", 1), ("o_orderdate", 0), ("o_orderpriority", 0)]))
def profile_orders(spark, d):
    return _profile(load(spark, d, "orders"))


@job("inferred_roles", "P4 P5 P6", """WITH c AS (SELECT count(DISTINCT quality) AS q, count(DISTINCT toxic) AS t, count(DISTINCT doc_id) AS i FROM labels)
SELECT unnest(['doc_id', 'quality', 'toxic']) AS "column",
       unnest(['feature', CASE WHEN q <= 2 THEN 'protected_attribute' ELSE 'feature' END, CASE WHEN t <= 2 THEN 'target' ELSE 'feature' END]) AS role,
       unnest([q = 2 AND t = 2, q = 2 AND t = 2, q = 2 AND t = 2]) AS auditable
FROM c""")
def inferred_roles(spark, d):
    """Roles found from the labels table, normalised and checked against the rules."""
    df = load(spark, d, "labels")
    profiled = profile.profile(df).cache()
    roles = profile.normalise_roles({"roles": profile.infer_roles(profiled)}, df.columns)
    auditable = not profile.check_roles(roles, profiled)
    return spark.createDataFrame([(c, r, auditable) for c, r in roles.items()], "column string, role string, auditable boolean")


@job("cleaned_cells", "P1 P11", f"""WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INT) AS k, value, event_type FROM events),
c AS (SELECT event_id, k, value, CASE WHEN k < 5 THEN ' nan ' WHEN k < 10 THEN 'None' WHEN k < 15 THEN '   ' WHEN k < 20 THEN 'null'
             WHEN k < 25 THEN chr(9) || event_type || ' ' ELSE event_type END AS cell FROM e)
SELECT event_id, CASE WHEN {sql_strip('cell')} NOT IN ('', 'nan', 'None', 'null', 'NaN') THEN {sql_strip('cell')} END AS cell,
       CASE WHEN k < 30 THEN CAST(0 AS DOUBLE) ELSE value END AS number
FROM c""")
def cleaned_cells(spark, d):
    """Spellings of 'missing' become null; NaN, infinities and nulls become zero."""
    k = F.get_json_object("props", "$.k").cast("int")
    cell = (
        F.when(k < 5, " nan ").when(k < 10, "None").when(k < 15, "   ").when(k < 20, "null")
        .when(k < 25, F.concat(F.lit("\t"), "event_type", F.lit(" "))).otherwise(F.col("event_type"))
    )
    number = (
        F.when(k < 10, F.lit(float("nan"))).when(k < 20, F.lit(float("inf"))).when(k < 30, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    return load(spark, d, "events").select("event_id", TX.clean(cell).alias("cell"), encode.finite(number).alias("number"))


@job("value_codes", "P7", """SELECT p_type AS value, dense_rank() OVER (ORDER BY p_type) - 1 AS code
FROM (SELECT DISTINCT p_type FROM part)""")
def value_codes(spark, d):
    return encode.value_codes(load(spark, d, "part"), "p_type")


@job("label_encoded_parts", "P7", """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_code FROM part""")
def label_encoded_parts(spark, d):
    return encode.label_encode(load(spark, d, "part"), "p_brand", "brand_code").select("p_partkey", "brand_code")


@job("median_imputed", "P8", """WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM e)), 9) AS value FROM e""")
def median_imputed(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rounded(encode.impute_median(e, ["value"]))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# Levels that become a column each.
MOST_COLUMNS = 1_000


@job("one_hot_priorities", "P9 P10 U4", "SELECT o_orderkey, " + ", ".join(
    f"""CASE WHEN o_orderpriority = '{p}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS "o_orderpriority__{p}\"""" for p in PRIORITIES[1:]) + " FROM orders")
def one_hot_priorities(spark, d):
    """Levels from the data; the first in string order is dropped. A column each: more than a table can hold fail."""
    orders = load(spark, d, "orders")
    levels = [r["value"] for r in profile.levels(orders, ["o_orderpriority"]).limit(MOST_COLUMNS + 1).collect()]
    if len(levels) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} levels: encode the column as rows (long_one_hot)")
    return orders.select("o_orderkey", *encode.one_hot("o_orderpriority", levels, drop_first=True))


@job("binarised_target", "P12", """WITH c AS (SELECT p_partkey, dense_rank() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1 AS code FROM part)
SELECT p_partkey, CAST(code > (SELECT median(code) FROM c) AS INT) AS y FROM c""")
def binarised_target(spark, d):
    return encode.binarise_by_median(load(spark, d, "part"), "p_size", "y").select("p_partkey", "y")


@job("encoded_table", "P13 P6 P9 P11", """SELECT l_orderkey, l_linenumber,
  CAST(l_linestatus = 'O' AS DOUBLE) AS linestatus, l_quantity AS quantity, l_discount AS discount,
  CAST(l_returnflag = 'A' AS DOUBLE) AS returnflag__A, CAST(l_returnflag = 'N' AS DOUBLE) AS returnflag__N,
  CAST(l_returnflag = 'R' AS DOUBLE) AS returnflag__R, CAST(l_extendedprice > 50000 AS DOUBLE) AS label
FROM lineitem""")
def encoded_table(spark, d):
    """The whole mapped encoding: protected code, numerics, one-hot levels, target code."""
    lines = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("linestatus"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"),
        F.when(F.col("l_extendedprice") > 50000, "large").otherwise("a small one").alias("size"),
    )
    roles = {"linestatus": "protected_attribute", "quantity": "feature", "discount": "feature", "returnflag": "feature", "size": "target"}
    encoded, _ = encode.encode_table(lines, roles, keep=["l_orderkey", "l_linenumber"])
    return encoded


@job("encoded_wide_table", "P13 P9", """SELECT l_orderkey, l_linenumber, CAST(l_linestatus = 'O' AS DOUBLE) AS linestatus,
  'shipdate__' || CAST(l_shipdate AS VARCHAR) AS sparse, CAST(l_extendedprice > 50000 AS DOUBLE) AS label FROM lineitem""")
def encoded_wide_table(spark, d):
    """A feature with more levels than columns are made for keeps all of them."""
    lines = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("linestatus"), F.col("l_shipdate").cast("string").alias("shipdate"),
        F.when(F.col("l_extendedprice") > 50000, "large").otherwise("a small one").alias("size"),
    )
    roles = {"linestatus": "protected_attribute", "shipdate": "feature", "size": "target"}
    encoded, _ = encode.encode_table(lines, roles, keep=["l_orderkey", "l_linenumber"])
    return encoded.withColumn("sparse", F.array_join("sparse", "|"))


@job("medians_with_infinities", "P8", """WITH e AS (SELECT CAST(CASE WHEN event_type = 'error' THEN 'Infinity'::DOUBLE WHEN event_type = 'view' THEN '-Infinity'::DOUBLE
  ELSE value END AS DOUBLE) AS x, value FROM events)
SELECT unnest(['x', 'value']) AS name, round(unnest([median(x), median(value)]), 9) AS middle FROM e""")
def medians_with_infinities(spark, d):
    x = F.when(F.col("event_type") == "error", float("inf")).when(F.col("event_type") == "view", float("-inf")).otherwise(F.col("value"))
    middle = moments.medians(load(spark, d, "events").select(x.alias("x"), "value"), ["x", "value"])
    return rounded(spark.createDataFrame(list(middle.items()), "name string, middle double"))


@job("long_one_hot", "P9", """SELECT 'p_brand__' || p_brand AS feature, count(*) AS n FROM part GROUP BY ALL
UNION ALL SELECT 'p_name__' || p_name, count(*) FROM part GROUP BY ALL""")
def long_one_hot(spark, d):
    """Sparse one-hot of columns with any number of levels."""
    long = encode.long_features(load(spark, d, "part"), "p_partkey", ["p_brand", "p_name"])
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


SQL_FORMULA = f"'^{SQL_WS}*[=+@]'"


@job("injection_counts", "P14", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (regexp_matches({c}, {SQL_FORMULA})) AS flagged_cells FROM documents"""
    for c in ("text", "lang", "source")) + f"""
UNION ALL SELECT 'padded', count(*) FILTER (regexp_matches(padded, {SQL_FORMULA})) FROM (SELECT ' +' || text AS padded FROM documents)""")
def injection_counts(spark, d):
    docs = load(spark, d, "documents").withColumn("padded", F.concat(F.lit(" +"), "text"))
    return quality.injection_counts(docs, ["text", "lang", "source", "padded"])


CELLS_SQL = """cells AS (
  SELECT event_id, CASE WHEN k < 10 THEN '  =SUM(' || event_type || ')' WHEN k < 20 THEN '@' || event_type WHEN k < 30 THEN chr(9) || '+1' ELSE event_type END AS note, props
  FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events))"""


def _cells(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    note = (
        F.when(k < 10, F.concat(F.lit("  =SUM("), "event_type", F.lit(")"))).when(k < 20, F.concat(F.lit("@"), "event_type"))
        .when(k < 30, "\t+1").otherwise(F.col("event_type"))
    )
    return load(spark, d, "events").select("event_id", note.alias("note"), "props")


@job("injection_rows", "P14", f"""WITH {CELLS_SQL}
SELECT event_id, 'note' AS flagged_columns FROM cells WHERE regexp_matches(note, {SQL_FORMULA})""")
def injection_rows(spark, d):
    return quality.injection_rows(_cells(spark, d)).select("event_id", F.array_join("flagged_columns", "|").alias("flagged_columns"))


@job("sanitised_cells", "P15", f"""WITH {CELLS_SQL}
SELECT event_id, CASE WHEN regexp_matches(note, {SQL_FORMULA}) AND NOT starts_with(note, chr(9)) THEN chr(9) || note ELSE note END AS note, props FROM cells""")
def sanitised_cells(spark, d):
    return quality.sanitise(_cells(spark, d))


@job("label_distribution", "P17", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def label_distribution(spark, d):
    return quality.label_distribution(load(spark, d, "documents"), "lang")


# RE2 has no look-around: the neighbours are matched and put back, twice for touching numbers.
def _sql_phone(c: str) -> str:
    body = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}"
    for _ in range(2):
        c = f"regexp_replace({c}, '(^|[^0-9]){body}($|[^0-9])', '\\1[REDACTED]\\2', 'g')"
    return c


def _sql_redact(c: str) -> str:
    mail = f"regexp_replace({c}, '{K.EMAIL_PATTERN}', '[REDACTED]', 'g')"
    return _sql_phone(f"regexp_replace({mail}, '{K.SSN_PATTERN}', '[REDACTED]', 'g')")


@job("redacted_documents", "P16", f"SELECT doc_id, {_sql_redact('text')} AS text FROM documents")
def redacted_documents(spark, d):
    return quality.redact(load(spark, d, "documents").select("doc_id", "text"), ["text"])


@job("redacted_conversations", "P16", f"SELECT conv_id, turn, {_sql_redact('text')} AS text FROM conversations")
def redacted_conversations(spark, d):
    return quality.redact(load(spark, d, "conversations").select("conv_id", "turn", "text"), ["text"])


@job("personal_data_counts", "P16")
def personal_data_counts(spark, d):
    return quality.personal_data_counts(load(spark, d, "documents"), "text", by=["lang"])


@job("table_fingerprint", "P20")
def table_fingerprint(spark, d):
    return quality.fingerprint(load(spark, d, "lineitem"))


@job("distinct_inputs", "P19", """SELECT sha256('standard|4|' || text) AS content_key, count(*) AS copies FROM documents GROUP BY ALL""")
def distinct_inputs(spark, d):
    """Inputs that share depth, cluster count and text would be computed once."""
    key = TX.content_key(F.lit("standard"), F.lit(K.CLUSTERS), F.col("text"))
    return load(spark, d, "documents").groupBy(key.alias("content_key")).agg(F.count(F.lit(1)).alias("copies"))


# --- sources and sinks -----------------------------------------------------------------


@job("csv_round_trip", "S1 S5 S14", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Written as csv and read back with its schema."""
    customer = load(spark, d, "customer")
    path = scratch_path(spark, "customer-csv")
    tables.write_csv(customer, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in customer.schema.fields)
    return tables.read_csv(spark, path, schema=schema)


@job("csv_types_inferred", "S1 S2", """SELECT unnest(['c_name', 'c_acctbal', 'c_mktsegment']) AS "column", unnest(['string', 'double', 'string']) AS type,
  (SELECT count(*) FROM customer) AS n_rows""")
def csv_types_inferred(spark, d):
    path = scratch_path(spark, "customer-untyped-csv")
    tables.write_csv(load(spark, d, "customer").select("c_name", "c_acctbal", "c_mktsegment"), path)
    back = tables.read_csv(spark, path)
    n = back.count()
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), n) for f in back.schema.fields], "column string, type string, n_rows bigint")


@job("json_round_trip", "S5", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_round_trip(spark, d):
    path = scratch_path(spark, "customer-json")
    load(spark, d, "customer").write.json(path)
    return tables.read_dataset(spark, path, "json").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@job("census_scan", "S3", f"""SELECT c_custkey AS age, c_mktsegment AS workclass, CAST(c_acctbal > 5000 AS INT) AS label
FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def census_scan(spark, d):
    """A headerless file in the income layout, where '?' marks a missing work class."""
    columns = {name: F.lit(0 if kind == "int" else "x").alias(name) for name, kind in K.CENSUS_COLUMNS}
    columns["age"] = F.col("c_custkey").alias("age")
    columns["workclass"] = F.when(F.col("c_mktsegment") == "MACHINERY", " ?").otherwise(F.col("c_mktsegment")).alias("workclass")
    columns["income"] = F.when(F.col("c_acctbal") > 5000, " >50K").otherwise(" <=50K").alias("income")
    path = scratch_path(spark, "census-csv")
    load(spark, d, "customer").select(*columns.values()).write.csv(path)
    return tables.read_census(spark, path).select("age", "workclass", "label")


@job("matrix_payloads", "S4", """SELECT l_orderkey, l_linenumber, CAST(0 AS INT) AS row, l_quantity AS a, l_discount AS b, CAST(l_returnflag = 'R' AS DOUBLE) AS label, l_discount AS protected FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 1, l_extendedprice, l_tax, CAST(l_linestatus = 'O' AS DOUBLE), l_tax FROM lineitem""")
def matrix_payloads(spark, d):
    """A two-row JSON matrix per line item, parsed, checked and exploded into rows."""
    payload = F.to_json(
        F.struct(
            F.array(F.array("l_quantity", "l_discount"), F.array("l_extendedprice", "l_tax")).alias("features"),
            F.array((F.col("l_returnflag") == "R").cast("double"), (F.col("l_linestatus") == "O").cast("double")).alias("labels"),
            F.array(F.lit("a"), F.lit("b")).alias("feature_names"),
            F.lit(1).alias("protected_index"),
        )
    )
    key = F.struct("l_orderkey", "l_linenumber").alias("key")
    parsed = matrix.parse(load(spark, d, "lineitem").select(key, payload.alias("input")), "input")
    x = F.col("features")
    return matrix.rows(parsed, "key").select("key.*", "row", x[0].alias("a"), x[1].alias("b"), "label", "protected")


@job("matrix_problems", "S4", """SELECT CASE WHEN k < 10 THEN 'invalid JSON' WHEN k < 20 THEN 'features and labels are required' WHEN k < 30 THEN 'empty dataset'
    WHEN k < 40 THEN 'features must be a full numeric 2-D array' WHEN k < 50 THEN 'features and labels differ in length'
    WHEN k < 60 THEN 'feature_names do not match the columns' WHEN k < 70 THEN 'protected_index is out of range' ELSE 'none' END AS problem,
  CASE WHEN k < 80 THEN 'dataset' ELSE 'text' END AS mode, count(*) AS n
FROM (SELECT CAST(props->>'$.k' AS INT) AS k FROM events) GROUP BY ALL""")
def matrix_problems(spark, d):
    """Malformed payloads of every kind, and what the check says about them."""
    k = F.get_json_object("props", "$.k").cast("int")
    one = F.col("event_id").cast("string")
    given = (
        F.when(k < 10, F.concat(F.lit('{"features": [['), one, F.lit("]")))
        .when(k < 20, F.concat(F.lit('{"features": [['), one, F.lit("]]}")))
        .when(k < 30, F.lit('{"features": [], "labels": []}'))
        .when(k < 40, F.concat(F.lit('{"features": [['), one, F.lit('], [1, 2]], "labels": [0, 1]}')))
        .when(k < 50, F.concat(F.lit('{"features": [['), one, F.lit(']], "labels": [0, 1]}')))
        .when(k < 60, F.concat(F.lit('{"features": [['), one, F.lit(']], "labels": [0], "feature_names": ["a", "b"]}')))
        .when(k < 70, F.concat(F.lit('{"features": [['), one, F.lit(']], "labels": [0], "protected_index": 3}')))
        .when(k < 80, F.concat(F.lit('{"features": [['), one, F.lit(']], "labels": [0]}')))
        .otherwise(F.concat(F.lit("event "), one))
    )
    parsed = matrix.parse(load(spark, d, "events").select(given.alias("input")), "input")
    return parsed.groupBy(F.coalesce("problem", F.lit("none")).alias("problem"), "mode").agg(F.count(F.lit(1)).alias("n"))


@job("file_manifest", "S6")
def file_manifest(spark, d):
    return registry.manifest(spark, d, "*.parquet").drop("uploaded_at")
