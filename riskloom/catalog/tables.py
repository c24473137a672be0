"""Sources, sinks, joins and keyed merges. Reads go through files that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.catalog.records import RECORDS, records
from riskloom.catalog.registry import query
from riskloom.operators import encoding as en
from riskloom.schemas import RECORD
from riskloom.session import shared_folder
from riskloom.sources import files as fl
from riskloom.plans.frames import written
from riskloom.sources import tables as tb
from riskloom.sources.keyed import KeyedTable
from riskloom.sources.versions import VersionedTable


def _folder(t) -> str:
    return shared_folder(t.spark, "sources", uuid.uuid4().hex)


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def _record_rows(t):
    return records(t).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields])


@query(
    "io1_records_csv",
    f"""WITH {RECORDS} SELECT record_id, CAST("limit" AS BIGINT) AS "limit", CAST(premium AS BIGINT) AS premium,
        prior_claims, years_trading, loss_ratio, is_loss_making, industry FROM records""",
)
def _(t):
    path = _folder(t)
    _record_rows(t).write.option("header", True).csv(path)
    out = fl.read_records_csv(t.spark, path)
    return out.select("record_id", "limit", "premium", "prior_claims", "years_trading", "loss_ratio", "is_loss_making", "industry")


@query(
    "io2_record_json",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN concat('R', o_orderkey) END AS record_id,
        CASE WHEN o_orderkey % 3 < 2 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS "limit", o_orderkey % 3 = 2 AS quarantined FROM orders""",
)
def _(t):
    body = F.concat(F.lit('{"record_id": "R'), F.col("o_orderkey"), F.lit('", "limit": '), F.floor("o_totalprice"), F.lit("}"))
    n = F.col("o_orderkey") % 3
    text = F.when(n == 0, body).when(n == 1, F.concat(F.lit('{"record": '), body, F.lit("}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    parsed = t.orders.select("o_orderkey", fl.record_struct(text).alias("r"))
    return parsed.select("o_orderkey", "r.record_id", "r.limit", F.col("r").isNull().alias("quarantined"))


@query(
    "io2_record_json_files",
    """SELECT CASE WHEN s_suppkey % 3 < 2 THEN concat('R', s_suppkey) END AS record_id, CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_suppkey * 10 AS DOUBLE) END AS "limit",
        CASE WHEN s_suppkey % 3 = 2 THEN concat('[', s_suppkey, ']') END AS text FROM supplier""",
)
def _(t):
    path, n = _folder(t), F.col("s_suppkey") % 3
    body = F.concat(F.lit('{"record_id": "R'), F.col("s_suppkey"), F.lit('", "limit": '), F.col("s_suppkey") * 10, F.lit("}"))
    text = F.when(n == 0, body).when(n == 1, F.concat(F.lit('{"record": '), body, F.lit("}"))).otherwise(F.concat(F.lit("["), F.col("s_suppkey"), F.lit("]")))
    fl.write_documents(t.supplier.select("s_suppkey", text.alias("text")), "s_suppkey", "text", path, one_file_each=True)
    good, bad = fl.read_record_json(t.spark, path)
    return good.select("record_id", F.col("limit").cast("double").alias("limit"), F.lit(None).cast("string").alias("text")).unionByName(
        bad.select(F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("double").alias("limit"), F.trim(F.regexp_replace("text", r"\s", "")).alias("text"))
    )


@query("io3_text_folder", "SELECT concat('S', s_suppkey) AS id, concat(s_name, chr(10), s_nationkey) AS text FROM supplier")
def _(t):
    path = _folder(t)
    docs = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("doc"), F.concat_ws("\n", "s_name", "s_nationkey").alias("text"))
    fl.write_documents(docs, "doc", "text", path, one_file_each=True)
    return fl.read_text_folder(t.spark, path)


@query(
    "io4_mixed_documents",
    """SELECT lang, CAST(sum(length(text)) + count(*) AS BIGINT) AS characters, 'loaded' AS status FROM documents GROUP BY 1""",
)
def _(t):
    path = _folder(t)
    t.documents.select("lang", "text").write.option("maxRecordsPerFile", 2000).partitionBy("lang").text(path)
    files = fl.read_mixed_documents(t.spark, path)
    return files.groupBy(F.regexp_extract("file", r"lang=([^/]+)/", 1).alias("lang"), "status").agg(
        F.sum(F.char_length("text")).alias("characters")
    )


@query(
    "io5_query_frame",
    "SELECT o_orderstatus, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
)
def _(t):
    view = _name("orders")
    t.orders.createOrReplaceTempView(view)
    sql = f"SELECT o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM {view} WHERE o_totalprice > :low GROUP BY 1"
    return tb.query_frame(t.spark, sql, {"low": 1000}, coerce_float=True).select("o_orderstatus", F.round("total", 2).alias("total"))


@query("io6_ordered_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    view = _name("supplier")
    t.supplier.createOrReplaceTempView(view)
    return tb.read_table(t.spark, view, "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@query(
    "io6_ordered_chunks",
    """SELECT chunk, min(o_orderdate) AS low, max(o_orderdate) AS high, CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys
        FROM (SELECT *, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS BIGINT) AS chunk FROM orders) GROUP BY 1""",
)
def _(t):
    chunks = tb.ordered_chunks(t.orders.select("o_orderdate", "o_orderkey"), "o_orderdate", 1000, ["o_orderkey"])
    return chunks.groupBy("chunk").agg(
        F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")
    )


@query(
    "io6_key_ranges",
    """WITH k AS (SELECT o_orderdate, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
        s AS (SELECT *, (sum(n) OVER (ORDER BY o_orderdate) - n) // 500 AS slot FROM k)
        SELECT CAST(row_number() OVER (ORDER BY slot) - 1 AS BIGINT) AS chunk, min(o_orderdate) AS low, max(o_orderdate) AS high, CAST(sum(n) AS BIGINT) AS rows FROM s GROUP BY slot""",
)
def _(t):
    return tb.chunk_bounds(t.orders, "o_orderdate", 500)


@query("io7_count_records", "SELECT CAST(count(*) AS BIGINT) AS records FROM lineitem")
def _(t):
    view = _name("lineitem")
    t.lineitem.createOrReplaceTempView(view)
    return tb.count_records(t.spark, view)


@query(
    "io8_table_columns",
    """SELECT CAST(row_number() OVER () - 1 AS INT) AS position, column_name AS name,
        CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM (DESCRIBE customer)""",
)
def _(t):
    view = _name("customer")
    t.customer.createOrReplaceTempView(view)
    return tb.table_columns(t.spark, view)


@query(
    "io9_write_table",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '+') ELSE c_name END AS c_name FROM customer",
)
def _(t):
    table, path = _name("customer"), _folder(t)
    df = t.customer.select("c_custkey", "c_name")
    tb.write_table(df, table, "fail", path, keys=["c_custkey"])
    tb.write_table(df.where("c_custkey % 2 = 0"), table, "replace", path)
    # the odd keys are new, the even multiples of three are known
    again = df.withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("+"))).otherwise(F.col("c_name")))
    tb.write_table(again.where("c_custkey % 2 = 1 OR c_custkey % 3 = 0"), table, "append")
    out = written(t.spark.table(table))
    tb.drop_table(t.spark, table)
    return out


@query(
    "io9_append_some_columns",
    """SELECT o_orderkey, o_totalprice, CASE WHEN n > 4 THEN 'long' ELSE o_orderstatus END AS o_orderstatus
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def _(t):
    table, path = _name("orders"), _folder(t)
    tb.write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), table, "fail", path, keys=["o_orderkey"])
    long = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")).where("n > 4")
    tb.write_table(long.select("o_orderkey", F.lit("long").alias("o_orderstatus")), table, "append")
    out = written(t.spark.table(table))
    tb.drop_table(t.spark, table)
    return out


_TWO_HALVES = """SELECT c_custkey, c_name, CAST(row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey)
        + CASE WHEN c_custkey % 2 = 1 THEN (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) ELSE 0 END AS BIGINT) AS id FROM customer"""


@query("io10_bulk_insert", _TWO_HALVES)
def _(t):
    table, path = _name("customer"), _folder(t)
    df = t.customer.select("c_custkey", "c_name")
    tb.write_table(tb.with_ids(df.where("c_custkey % 2 = 0"), "c_custkey"), table, "fail", path)
    tb.bulk_insert(df.where("c_custkey % 2 = 1"), table, "c_custkey")
    out = t.spark.read.parquet(path)
    tb.drop_table(t.spark, table)
    return out


@query(
    "io10_bulk_insert_text_key",
    "SELECT CAST(row_number() OVER (ORDER BY c_custkey % 2, c_name) AS BIGINT) AS id, c_name FROM customer",
)
def _(t):
    table, path = _name("customer"), _folder(t)
    df = t.customer.select("c_custkey", "c_name")
    first = tb.with_ids(df.where("c_custkey % 2 = 0").select("c_name"), "c_name").select("id", "c_name")
    tb.write_table(first, table, "fail", path)
    tb.bulk_insert(df.where("c_custkey % 2 = 1").select("c_name"), table, "c_name")
    out = t.spark.read.parquet(path)
    tb.drop_table(t.spark, table)
    return out


@query("io11_drop_table", "SELECT count(*) > 0 AS existed, FALSE AS exists_after FROM nation")
def _(t):
    table = _name("nation")
    tb.write_table(t.nation, table, "fail", _folder(t))
    existed = t.spark.catalog.tableExists(table)
    tb.drop_table(t.spark, table)
    tb.drop_table(t.spark, table)
    return t.nation.agg(F.lit(existed).alias("existed"), F.lit(t.spark.catalog.tableExists(table)).alias("exists_after"))


@query("io12_sql_script", "SELECT p_brand, CAST(count(*) AS BIGINT) AS n, ';--' AS mark FROM part WHERE p_size > 10 GROUP BY 1")
def _(t):
    view, small = _name("part"), _name("part_small")
    t.part.createOrReplaceTempView(view)
    script = f"""-- parts above a size; the rest is ignored
        CREATE TEMPORARY VIEW {small} AS SELECT * FROM {view} /* all
        columns */ WHERE p_size > 10;
        SELECT p_brand, count(*) AS n, ';--' AS mark FROM {small} GROUP BY p_brand; """
    return tb.run_script(t.spark, script)


@query("io13_latest_version", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def _(t):
    store = VersionedTable(t.spark, _folder(t))
    df = t.orders.select("o_orderkey", "o_totalprice")
    store.write(df.where("o_orderkey % 2 = 0"))
    store.write(df.where("o_orderkey % 2 = 1"))
    return store.read()


@query("io13_many_appends", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    store = VersionedTable(t.spark, _folder(t))
    df = t.orders.select("o_orderkey", "o_totalprice")
    for i in range(12):  # more batches than one size class holds
        store.append(df.where(F.col("o_orderkey") % 12 == i))
    if len(store.ready.latest()["segments"]) > 8:
        raise AssertionError("segments of one size are merged")
    return store.read()


@query("io13_two_writers", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    path = _folder(t)
    first, second = VersionedTable(t.spark, path), VersionedTable(t.spark, path)
    df = t.orders.select("o_orderkey", "o_totalprice")
    parts = [df.where(F.col("o_orderkey") % 3 == i) for i in range(3)]
    first.append(parts[0])
    publish = first.ready.publish

    def overtaken(marker):
        if marker["version"] == 2:
            second.append(parts[2])  # takes version 2 after the first writer has looked
        return publish(marker)

    first.ready.publish = overtaken
    first.append(parts[1])
    return first.read()


@query("io14_ready_marker", "SELECT 1 AS version, CAST(count(*) AS BIGINT) AS document_count, CAST(count(*) AS BIGINT) AS rows_read FROM documents")
def _(t):
    store = VersionedTable(t.spark, _folder(t))
    df = t.documents.select("doc_id", "text")
    df.limit(0).write.parquet(f"{store.path}/version=1")  # a write that never got its marker
    store.write(df)
    rows = store.read().agg(F.count(F.lit(1))).scalar()
    return store.markers().select("version", "document_count", rows.alias("rows_read"))


@query(
    "io15_usage_log",
    """SELECT concat('m', event_type) AS model, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS input_tokens,
        CAST(count(*) AS BIGINT) AS web FROM events GROUP BY 1""",
)
def _(t):
    path = _folder(t)
    k = F.get_json_object("props", "$.k").cast("long")
    usage = t.events.groupBy(F.concat(F.lit("m"), "event_type").alias("model")).agg(
        F.sum(k).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.sum(k).alias("total_tokens"),
        F.lit(None).cast("double").alias("token_cost_usd"), F.create_map(F.lit("web"), F.count(F.lit(1))).alias("tool_calls"),
        F.lit(0.0).alias("tool_cost_usd"), F.lit(None).cast("double").alias("cost_usd"),
    )
    fl.append_usage_log(usage.where("model < 'mp'"), path)
    fl.append_usage_log(usage.where("model >= 'mp'"), path)
    return fl.read_usage_log(t.spark, path).select("model", "input_tokens", F.col("tool_calls")["web"].alias("web"))


@query(
    "io16_saved_stages",
    f"""WITH {RECORDS}, m AS (SELECT broker, avg(loss_ratio) AS v FROM records WHERE broker IS NOT NULL GROUP BY 1)
        SELECT record_key, round(coalesce(m.v, (SELECT avg(loss_ratio) FROM records)), 8) AS score FROM records LEFT JOIN m USING (broker)""",
)
def _(t):
    from pyspark.ml import PipelineModel

    df = records(t).select("record_key", "broker", "loss_ratio")
    path = _folder(t)
    PipelineModel([en.OOFGroupEncoder(group_col="broker", score_col="score").fit(df)]).write().overwrite().save(path)
    return PipelineModel.load(path).transform(df).select("record_key", F.round("score", 8).alias("score"))


@query(
    "io17_eval_items",
    f"""WITH {RECORDS} SELECT record_id, loss_ratio, is_loss_making, CASE WHEN record_key % 4 = 0 THEN 'borderline' END AS case_type FROM records""",
)
def _(t):
    path = _folder(t)
    kind = F.when(F.col("record_key") % 4 == 0, F.lit("borderline")).alias("case_type")
    items = records(t).select("record_id", "risk_type", "industry", F.struct("is_loss_making", "loss_ratio", kind).alias("ground_truth"))
    fl.write_json(items, path)
    return fl.read_eval_items(t.spark, path, array=False).select("record_id", "ground_truth.*")


@query(
    "io17_eval_items_array",
    "SELECT concat('R', s_suppkey) AS record_id, CAST(s_suppkey / 8 AS DOUBLE) AS loss_ratio, s_suppkey % 2 = 0 AS is_loss_making, 'borderline' AS case_type FROM supplier",
)
def _(t):
    path = _folder(t)
    truth = F.struct((F.col("s_suppkey") % 2 == 0).alias("is_loss_making"), (F.col("s_suppkey") / 8).alias("loss_ratio"), F.lit("borderline").alias("case_type"))
    items = t.supplier.select(F.concat(F.lit("R"), F.col("s_suppkey")).alias("record_id"), truth.alias("ground_truth"))
    fl.write_json_arrays(items, path, "record_id", rows=64)
    return fl.read_eval_items(t.spark, path).select("record_id", "ground_truth.*")


@query("io18_documents_by_row", "SELECT doc_id AS id, length(text) AS characters FROM documents")
def _(t):
    path = _folder(t)
    fl.write_documents(t.documents, "doc_id", "text", path, buckets=8)
    return t.spark.read.schema("id long, text string").json(path).select("id", F.char_length("text").cast("long").alias("characters"))


@query("io19_json_results", f'WITH {RECORDS} SELECT record_id, premium FROM records')
def _(t):
    path = _folder(t)
    fl.write_json(records(t).select("record_id", "premium"), path)
    return t.spark.read.schema("record_id string, premium double").json(path)


@query("jn1_window_join", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS count_user_id_3d, value FROM events")
def _(t):
    from riskloom.operators.temporal import RollingFeatures

    return RollingFeatures("ts").count_of_last_n_days(t.events, "user_id", 3).select("event_id", "count_user_id_3d", "value")


@query(
    "jn2_lookup_default",
    """WITH m AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 20)
        SELECT c_custkey, coalesce(n_name, 'elsewhere') AS n_name FROM customer LEFT JOIN m ON k = c_nationkey""",
)
def _(t):
    table = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return tb.lookup(t.customer, table, "c_nationkey", "n_name", "elsewhere").select("c_custkey", "n_name")


@query("jn3_encoded_columns", """SELECT c_custkey, c_nationkey, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS building FROM customer""")
def _(t):
    return en.one_hot_pairs(t.customer, [("c_mktsegment", "BUILDING", "building")]).select("c_custkey", "c_nationkey", "building")


@query("jn4_missing_keys", "SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(t):
    keys = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return tb.missing_keys(keys, t.orders.where("o_totalprice > 200000"), "o_custkey")


@query("jn5_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(t):
    chosen = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(chosen, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "jn6_known_outcomes",
    "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id").select("doc_id", "quality")


@query("jn8_attach_target", "SELECT d.doc_id, n_chars, toxic FROM documents d JOIN labels USING (doc_id)")
def _(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "toxic"), "doc_id")


@query("jn9_append_bins", "SELECT p_partkey, p_size, concat(CAST(p_size > 25 AS INT), '.0') AS p_size__bin FROM part")
def _(t):
    from riskloom.operators.binning import CustomDiscretizer

    df = t.part.select("p_partkey", "p_size")
    return CustomDiscretizer(bins={"p_size": [float("-inf"), 25, float("inf")]}).fit(df).transform(df)


@query("st1_append_frames", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    left = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return left.unionByName(t.customer.select(F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("k")))


@query(
    "mg1_upsert",
    """WITH s AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS k, max(l_extendedprice) AS p FROM lineitem GROUP BY 1)
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT k FROM s) UNION ALL SELECT k, p FROM s""",
)
def _(t):
    # every fifth order's lines come under a key that is new
    key = F.when(F.col("l_orderkey") % 5 == 0, F.col("l_orderkey") + 1_000_000_000).otherwise(F.col("l_orderkey"))
    source = t.lineitem.select(key.alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    # the order value is unique; within a key the highest price comes last
    source = source.distinct().withColumn("seq", F.struct("o_totalprice", "o_orderkey"))
    return tb.upsert(t.orders.select("o_orderkey", "o_totalprice"), source, ["o_orderkey"], "seq")


@query(
    "mg1_upsert_missing_keys",
    """WITH s AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS k, c_custkey, c_name FROM customer),
        l AS (SELECT k, c_name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c_custkey DESC) AS r FROM s) WHERE r = 1)
        SELECT k, c_name AS v FROM l UNION ALL
        SELECT k, v FROM (SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey + 10 END AS k, n_name AS v FROM nation) n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k IS NOT DISTINCT FROM n.k)""",
)
def _(t):
    target = t.nation.select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey") + 10).alias("k"), F.col("n_name").alias("v"))
    source = t.customer.select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("seq"))
    return tb.upsert(target, source, ["k"], "seq")


@query(
    "mg1_keyed_table",
    """WITH s AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS k, max(l_extendedprice) AS p FROM lineitem GROUP BY 1)
        SELECT coalesce(o_orderkey, k) AS o_orderkey, coalesce(p, o_totalprice) AS o_totalprice, o_orderstatus FROM orders FULL JOIN s ON k = o_orderkey""",
)
def _(t):
    table = KeyedTable(t.spark, _folder(t), ["o_orderkey"], bucket_rows=5000)
    table.upsert(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"))
    key = F.when(F.col("l_orderkey") % 5 == 0, F.col("l_orderkey") + 1_000_000_000).otherwise(F.col("l_orderkey"))
    lines = t.lineitem.groupBy(key.alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    table.upsert(lines)  # the status stays
    return table.read()


@query(
    "mg4_keyed_table_update",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'big' WHEN o_totalprice > 200000 THEN 'mid' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""",
)
def _(t):
    table = KeyedTable(t.spark, _folder(t), ["o_orderkey"], bucket_rows=5000)
    table.upsert(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"))
    table.update("o_orderstatus", ["big", "mid"], ["o_totalprice > 400000", "o_totalprice > 200000"])
    return table.read()


@query(
    "mg1_upsert_repeated_order",
    """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2),
        s AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY CASE WHEN l_linenumber <> 2 THEN l_linenumber END DESC NULLS LAST) AS r FROM l)
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM s)
        UNION ALL SELECT l_orderkey, l_extendedprice FROM s WHERE r = 1""",
)
def _(t):
    # line numbers repeat across keys, and the second line of each has none
    seq = F.when(F.col("l_linenumber") != 2, F.col("l_linenumber"))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("o_totalprice"))
    source = lines.select(F.col("l_orderkey").alias("o_orderkey"), "o_totalprice", seq.alias("seq"))
    return tb.upsert(t.orders.select("o_orderkey", "o_totalprice"), source, ["o_orderkey"], "seq")


@query("mg2_insert_row", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name FROM nation UNION ALL SELECT CAST((SELECT count(*) FROM nation) + 1 AS BIGINT), 'NEW'")
def _(t):
    table, path = _name("nation"), _folder(t)
    tb.write_table(tb.with_ids(t.nation.select("n_nationkey", "n_name"), "n_nationkey").select("id", "n_name"), table, "fail", path)
    tb.insert_row(t.spark, {"n_name": "NEW"}, table)
    out = t.spark.read.parquet(path)
    tb.drop_table(t.spark, table)
    return out


@query("mg3_update_fields", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(t):
    return tb.update_fields(t.orders, {"o_orderpriority": "DONE"}, "o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@query(
    "mg4_update_column",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'big' WHEN o_totalprice > 200000 THEN 'mid' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def _(t):
    out = tb.update_column(t.orders, "o_orderstatus", ["big", "mid"], ["o_totalprice > 400000", "o_totalprice > 200000"])
    return out.select("o_orderkey", "o_orderstatus")


@query(
    "mg4_update_from_keys",
    """SELECT o_orderkey, coalesce(c_acctbal, o_totalprice) AS o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""",
)
def _(t):
    changes = t.customer.select(F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"))
    return tb.update_from(t.orders, changes, "o_orderkey", "o_totalprice").select("o_orderkey", "o_totalprice")
