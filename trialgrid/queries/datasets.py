"""Loading, size caps, slots, archives, exports, run tables and the warehouse."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import uuid
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators.ordinal import ordinal
from trialgrid.plans import samples, suite
from trialgrid.plans.experiment import Experiment
from trialgrid.queries.tables import table
from trialgrid.session import scratch_path
from trialgrid.sources import archives, datasets, ranges, runlog, warehouse

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDERS = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority
from orders
"""


def _dated(orders: DataFrame) -> DataFrame:
    """Times as text, the same in both engines."""
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


#: Slots, or files, of a registered query.
SLOTS = 100


def load_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole orders from a folder with partition folders."""
    source = scratch_path(spark, "source")
    table(spark, sf_dir, "orders").hint("rebalance", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(source)
    return _dated(datasets.load_dataset(spark, source, scratch_path(spark, "load")))


def load_dataset_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load up to half of the bytes of a hundred text files, one per slot; with the record of the load."""
    source, loads = scratch_path(spark, "source"), scratch_path(spark, "loads")
    line = F.concat_ws(" ", "doc_id", F.md5(F.col("text").cast("binary"))).alias("value")
    lines = table(spark, sf_dir, "documents").select(line, F.pmod("doc_id", F.lit(SLOTS)).cast("int").alias("slot"))
    datasets.place_slots(lines, SLOTS).write.partitionBy("slot").text(source)
    half = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] // 2
    loaded = datasets.load_dataset(spark, source, scratch_path(spark, "load"), "text", half, loads=loads)
    record = datasets.loaded_datasets(spark, loads).first()
    figures = [F.lit(record[name]).cast("bigint").alias(name) for name in ("desired_size", "files", "raw_bytes")]
    return loaded.select(F.col("slot").cast("int").alias("slot"), "value", *figures)


LOAD_DATASET_CAPPED = f"""
with lines as (select doc_id || ' ' || md5(text) as value, (doc_id % {SLOTS})::int as slot from documents),
sizes as (select slot, sum(strlen(value) + 1) as size from lines group by 1),
sums as (select *, sum(size) over (order by slot::varchar) - size as before, (select sum(size) // 2 from sizes) as half from sizes),
taken as (select * from (select *, lead(before) over (order by before) from sums) where before < half)
select slot, value, half::bigint as desired_size, (select count(*) from taken) as files, (select sum(size) from taken)::bigint as raw_bytes
from lines join taken using (slot)
"""


def size_capped_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    half = documents.agg(F.sum("n_chars")).first()[0] // 2
    kept = datasets.size_capped_subset(documents, ["doc_id"], "n_chars", half)
    return kept.select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SIZE_CAPPED_SUBSET = """
select doc_id, n_chars, md5(text) as text_md5
from (select *, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before
      from documents)
where before < (select sum(n_chars) // 2 from documents)
"""


def round_robin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("source", "doc_id")
    return datasets.round_robin_assign(documents, ["source", "doc_id"], 7)


ROUND_ROBIN_ASSIGN = """
select source, doc_id, ((row_number() over (order by source, doc_id) - 1) % 7)::int as slot from documents
"""


def slot_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = datasets.round_robin_assign(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SLOTS)
    placed = datasets.place_slots(documents, SLOTS).withColumn("partition_id", F.spark_partition_id())
    return placed.groupBy("slot", "partition_id").agg(F.count("*").alias("n"))


SLOT_PLACEMENT = f"""
select slot, slot as partition_id, count(*) as n
from (select ((row_number() over (order by doc_id) - 1) % {SLOTS})::int as slot from documents) group by 1
"""


def load_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.octet_length("text").alias("bytes"))
    slots = datasets.round_robin_assign(documents, ["doc_id"], 7)
    return datasets.load_size_report(slots, F.col("n_chars"), F.col("bytes"), ["slot"])


LOAD_SIZE_REPORT = """
select slot, count(*) as n, sum(n_chars)::bigint as raw_bytes, sum(strlen(text))::bigint as final_bytes
from (select *, ((row_number() over (order by doc_id) - 1) % 7)::int as slot from documents) group by 1
"""


def sort_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "lang", "source", "doc_id")
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("length"))
    return datasets.sort_files(ordinal(files, ["path"]))


SORT_FILES = """
select path, length, row_number() over (order by path) - 1 as ordinal
from (select lang || '/' || source || '/' || doc_id as path, n_chars as length from documents)
"""


def decode_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed as one file of one of five kinds, then decoded to lines."""

    def pack(batches):
        for batch in batches:
            rows = []
            for doc_id, text in batch[["doc_id", "text"]].itertuples(index=False):
                data, out, member = text.encode(), io.BytesIO(), f"doc-{doc_id}.txt"
                suffix = ("gz", "bz2", "zip", "tar.gz", "txt")[doc_id % 5]
                if suffix == "gz":
                    out.write(gzip.compress(data))
                elif suffix == "bz2":
                    out.write(bz2.compress(data))
                elif suffix == "zip":
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
                        packed.writestr(member, data)
                elif suffix == "tar.gz":
                    with tarfile.open(fileobj=out, mode="w:gz") as packed:
                        entry = tarfile.TarInfo(member)
                        entry.size = len(data)
                        packed.addfile(entry, io.BytesIO(data))
                else:
                    out.write(data)
                rows.append((f"/in/d{doc_id}.{suffix}", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    return archives.decode_archives(files)


DECODE_ARCHIVES = """
with files as (select doc_id, (['gz', 'bz2', 'zip', 'tar.gz', 'txt'])[doc_id % 5 + 1] as suffix,
                      string_split(text, chr(10)) as parts from documents),
lines as (select doc_id, suffix, unnest(parts) as line, generate_subscripts(parts, 1) - 1 as line_no, len(parts) as n from files)
select '/in/d' || doc_id || '.' || suffix as path, case when suffix <> 'txt' then suffix end as kind,
       case when suffix = 'txt' then '/in/d' || doc_id || '.txt' else '/in/data-d' || doc_id end as name,
       case when suffix in ('zip', 'tar.gz') then 'doc-' || doc_id || '.txt' end as member, line_no, line
from lines where not (line_no = n - 1 and line = '')
"""

WORDS = ("alpha", "beta", "gamma", "delta", "epsilon")


def generate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.generate_text(table(spark, sf_dir, "orders"), "o_orderkey", WORDS, 6, seed=11)


GENERATE_TEXT = """
with base as (select o_orderkey, (o_orderkey + 11) % 2147483647 as b from orders),
words as (select o_orderkey, b, unnest(range(1, 2 + b * 48271 % 2147483647 % 6)) as k from base)
select o_orderkey,
  string_agg((['alpha', 'beta', 'gamma', 'delta', 'epsilon'])[1 + (b * 31 + k) % 2147483647 * 48271 % 2147483647 % 5], ' ' order by k) as line
from words group by 1
"""


def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.ingest_files(spark, [f"{sf_dir}/part.parquet"], scratch_path(spark, "ingest"))


INGEST_FILES = "select * from part"


def export_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.when(F.col("o_custkey") % 7 > 0, F.lpad((F.col("o_custkey") % 7).cast("string"), 3, "0"))
    outputs = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", ident.alias("run_id"))
    path = scratch_path(spark, "export")
    runlog.export_output(outputs, path)
    return runlog.fetch_output(spark, path, outputs.select("run_id"))


EXPORT_OUTPUT = """
select o_orderkey, o_totalprice, case when o_custkey % 7 > 0 then lpad((o_custkey % 7)::varchar, 3, '0') end as run_id from orders
"""


def drop_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("run_id"))
    path, kept = scratch_path(spark, "outputs"), scratch_path(spark, "kept")
    runlog.export_output(outputs, path)
    dropped = outputs.filter(F.col("run_id") == "F").select("run_id")
    return runlog.drop_output(spark, path, dropped, kept)


DROP_OUTPUT = "select o_orderkey, o_totalprice, o_orderstatus as run_id from orders where o_orderstatus <> 'F'"


def drop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of text ids, empty and null ones among them, of which every third goes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", _text_id("o_custkey").alias("run_id"))
    outputs = f"`{_namespace(spark)}`.outputs"
    runlog.save_output(orders, outputs)
    number = F.coalesce(F.expr("try_cast(run_id as int)"), F.lit(0))
    runlog.drop_runs(spark, outputs, orders.filter((number % 3 == 0) & ~F.col("run_id").eqNullSafe(F.lit(""))).select("run_id"))
    return runlog.table_output(spark, outputs, "string").select("o_orderkey", "o_totalprice", "run_id")


def _text_id(key: str) -> Column:
    """Numbers with and without zeros in front, an empty text, and null, by a key."""
    rest = F.col(key) % 40
    padded = F.when(rest < 20, F.lpad(rest.cast("string"), 3, "0")).otherwise(rest.cast("string"))
    return F.when(rest == 0, F.lit("")).when(rest != 1, padded)


DROP_RUNS = """
with outputs as (select o_orderkey, o_totalprice, case when r = 0 then '' when r <> 1 then case when r < 20 then lpad(r::varchar, 3, '0') else r::varchar end end as run_id
  from (select *, o_custkey % 40 as r from orders))
select * from outputs where run_id = '' or coalesce(try_cast(run_id as int), 0) % 3 <> 0
"""


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "files")
    table(spark, sf_dir, "documents").select("text", "lang", "source").write.partitionBy("lang", "source").text(path)
    listed = datasets.file_inventory(spark, path, directories=True)
    folder = F.regexp_extract("path", r"(lang=[^/]+/source=[^/]+)", 1)
    return listed.groupBy(folder.alias("folder")).agg(
        F.count_if(F.col("kind") == "d").alias("folders"), F.sum("length").alias("bytes")
    )


FILE_INVENTORY = """
select 'lang=' || lang || '/source=' || source as folder, 1::bigint as folders, sum(strlen(text) + 1)::bigint as bytes
from documents group by 1
"""


def _namespace(spark: SparkSession) -> str:
    name = f"tg_{uuid.uuid4().hex[:12]}"
    warehouse.warehouse_namespace(spark, name, scratch_path(spark, "warehouse"))
    return name


def warehouse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    return _dated(warehouse.warehouse_table(orders, _namespace(spark), "orders", bucket_by="o_custkey", buckets=8))


def warehouse_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {name: table(spark, sf_dir, name) for name in ("orders", "customer")}
    return warehouse.warehouse_sql(spark, WAREHOUSE_SQL, views)


WAREHOUSE_SQL = """
select c_mktsegment, o_orderpriority, '${kept}' as marker, count(*) as n,
       cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from orders join customer on o_custkey = c_custkey
group by c_mktsegment, o_orderpriority
"""


def warehouse_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    cleaned, kept = _namespace(spark), _namespace(spark)
    for name in ("first", "second"):
        warehouse.warehouse_table(orders, cleaned, name)
    rest = warehouse.warehouse_table(orders, kept, "first")
    dropped = warehouse.warehouse_clean(spark, cleaned)
    left = len([found for found in spark.catalog.listTables(cleaned) if not found.isTemporary])
    counts = rest.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.withColumn("dropped", F.lit(dropped).cast("bigint")).withColumn("tables_left", F.lit(left).cast("bigint"))


WAREHOUSE_CLEAN = """
select o_orderstatus, count(*) as n, 2::bigint as dropped, 0::bigint as tables_left from orders group by 1
"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_quantity").alias("value"),
    )
    return runlog.run_summary(params, ["run_id"], [f"line{i}" for i in range(1, 8)])


RUN_SUMMARY = "select l_orderkey as run_id, {} from lineitem group by 1".format(
    ", ".join(f"max(l_quantity) filter (l_linenumber = {i}) as line{i}" for i in range(1, 8))
)


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ds_id"), F.col("p_type").alias("ds_class"), props.alias("props")
    )
    path = scratch_path(spark, "summary")
    runlog.write_csv(runlog.dataset_summary(rows), path)
    return spark.read.schema("ds_id bigint, ds_class string, ds_class_properties string").csv(path, header=True, escape="\\")


DATASET_SUMMARY = """
select p_partkey as ds_id, p_type as ds_class, '{"brand":"' || p_brand || '","size":"' || p_size || '"}' as ds_class_properties
from part
"""


def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of runs, one per order, as the CSV summary of a suite."""
    home = scratch_path(spark, "suite")
    params = F.create_map(F.lit("ds.status"), F.col("o_orderstatus"), F.lit("xp.priority"), F.col("o_orderpriority"))
    status = F.when(F.col("o_custkey") % 5 == 0, suite.CANCELLED).otherwise(suite.DONE)
    records = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("comb_key"),
        F.concat(F.lit("app_"), F.col("o_custkey")).alias("job_id"),
        params.alias("params"),
        F.lit(1).alias("rep"),
        status.alias("status"),
        F.lit(1).alias("attempt"),
        F.lit(None).cast("string").alias("error"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    records.write.parquet(f"{home}/runs")
    experiment = Experiment(options={}, classes=[], dataset={"ds.status": []}, runs={"xp.priority": []}, order=[], uses={})
    suite.write_summaries(spark, experiment, home, f"{home}/summary")
    schema = "comb_id bigint, job_id string, status string, priority string"
    return spark.read.schema(schema).csv(f"{home}/summary/{suite.SUMMARY}", header=True, enforceSchema=True)


SUITE_SUMMARY = """
select o_orderkey as comb_id, 'app_' || o_custkey as job_id, o_orderstatus as status, o_orderpriority as priority
from orders where o_custkey % 5 <> 0
"""


def pre_load_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DataFrame hook and a batch hook, one after the other."""

    def count_words(batch: pd.DataFrame) -> pd.DataFrame:
        words = batch["text"].map(lambda text: len(text.split(" ")))
        return pd.DataFrame({"doc_id": batch["doc_id"], "words": words, "n_chars": batch["text"].str.len()})

    documents = datasets.pre_load_hook(table(spark, sf_dir, "documents"), lambda df: df.select("doc_id", "text"))
    return datasets.pre_load_hook(documents, datasets.batch_hook(count_words, "doc_id long, words long, n_chars long"))


PRE_LOAD_HOOK = "select doc_id, len(string_split(text, ' '))::bigint as words, n_chars from documents"


def custom_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    @datasets.register_dataset("OrderLines")
    def order_lines(session, props, desired_size):
        lines = table(session, props["dir"], "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
        return lines.filter(F.col("lines") >= int(props["at_least"]))

    return datasets.make_dataset(spark, "OrderLines", {"dir": sf_dir, "at_least": "2"})


CUSTOM_DATASET = "select l_orderkey, count(*) as lines from lineitem group by 1 having count(*) >= 2"


def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset class as a data source: rows made from the range of order keys, of which a filter leaves the upper half."""

    def drawn(start: int, end: int) -> pa.RecordBatch:
        keys = np.arange(start, end, dtype=np.int64)
        return pa.record_batch({"key": keys, "draw": keys * 48271 % 2147483647})

    ranges.register_source(spark, "OrderDraws", "key bigint, draw bigint", "key", drawn)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    made = ranges.read_source(spark, "OrderDraws", 0, last + 1, spark.sparkContext.defaultParallelism)
    return made.filter(F.col("key") >= last // 2).join(orders, F.col("key") == F.col("o_orderkey")).select("o_orderkey", "o_orderstatus", "draw")


CUSTOM_SOURCE = """
select o_orderkey, o_orderstatus, o_orderkey * 48271 % 2147483647 as draw from orders
where o_orderkey >= (select max(o_orderkey) // 2 from orders)
"""

QUERIES = {
    "load_dataset": (load_dataset, ORDERS),
    "load_dataset_capped": (load_dataset_capped, LOAD_DATASET_CAPPED),
    "size_capped_subset": (size_capped_subset, SIZE_CAPPED_SUBSET),
    "round_robin_assign": (round_robin_assign, ROUND_ROBIN_ASSIGN),
    "load_size_report": (load_size_report, LOAD_SIZE_REPORT),
    "sort_files": (sort_files, SORT_FILES),
    "decode_archives": (decode_archives, DECODE_ARCHIVES),
    "generate_text": (generate_text, GENERATE_TEXT),
    "ingest_files": (ingest_files, INGEST_FILES),
    "export_output": (export_output, EXPORT_OUTPUT),
    "drop_output": (drop_output, DROP_OUTPUT),
    "file_inventory": (file_inventory, FILE_INVENTORY),
    "warehouse_table": (warehouse_table, ORDERS),
    "warehouse_sql": (warehouse_sql, WAREHOUSE_SQL),
    "warehouse_clean": (warehouse_clean, WAREHOUSE_CLEAN),
    "run_summary": (run_summary, RUN_SUMMARY),
    "dataset_summary": (dataset_summary, DATASET_SUMMARY),
    "pre_load_hook": (pre_load_hook, PRE_LOAD_HOOK),
    "custom_dataset": (custom_dataset, CUSTOM_DATASET),
    "slot_placement": (slot_placement, SLOT_PLACEMENT),
    "drop_runs": (drop_runs, DROP_RUNS),
    "suite_summary": (suite_summary, SUITE_SUMMARY),
    "custom_source": (custom_source, CUSTOM_SOURCE),
}
