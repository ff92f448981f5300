"""Log lines, listings, size reports and history files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.queries.tables import table
from trialgrid.sources import logs

# The same text in Spark and in SQL: three events make one log.
_JOB_LINE = """case event_type
  when 'click' then concat('24/01/01 INFO mapreduce.Job: Running job: job_', event_id)
  when 'view' then concat('24/01/01 INFO mapred.JobClient: Running job: job_old_', event_id)
  when 'error' then concat('WARN Running job: job_bad_', event_id)
  else concat('INFO mapreduce.Job: map ', event_id) end"""
_LISTING_LINE = """case event_type when 'click' then concat('-rw ', event_id)
  when 'view' then concat('drwx ', event_id) else concat('Found ', event_id) end"""
_WARN_LINE = """case event_type when 'error' then concat('x WARN fs.FileSystem ', event_id) else concat('INFO ', event_id) end"""
_SIZE_LINE = """case event_type when 'error' then concat('WARN ', event_id, '\t/') when 'view' then 'n/a\t/'
  when 'click' then concat('1.', event_id, '\t/') when 'signup' then concat('no tab ', event_id)
  else concat(event_id * 1000, '\t/') end"""
_OLD_SIZE_LINE = """case event_type when 'error' then concat('WARN \t', event_id) when 'view' then '/\tn/a'
  else concat('/\tx\t', event_id * 1000) end"""


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    log = F.floor(F.col("event_id") / 3).cast("bigint")
    return events.select(log.alias("log_id"), F.col("event_id").alias("line_no"), F.expr(text).alias("line"))


def extract_job_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.extract_job_id(_lines(spark, sf_dir, _JOB_LINE), ["log_id"], ["line_no"])


EXTRACT_JOB_ID = f"""
with lines as (select event_id // 3 as log_id, event_id, {_JOB_LINE} as line from events),
hits as (select log_id, arg_min(regexp_extract(line, '.*Running job: (.*)', 1), event_id) as job_id from lines
         where line like '%Running job: %' and (line like '%mapred.JobClient%' or line like '%mapreduce.Job%') group by 1)
select l.log_id, coalesce(job_id, 'unknown') as job_id from (select distinct log_id from lines) l left join hits using (log_id)
"""


def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.listing_lines(_lines(spark, sf_dir, _LISTING_LINE)).select("line_no", "line")


LISTING_LINES = f"""
select event_id as line_no, line from (select event_id, {_LISTING_LINE} as line from events) where line[1] in ('d', '-')
"""


def drop_warn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drop_warn_lines(_lines(spark, sf_dir, _WARN_LINE)).select("line_no", "line")


DROP_WARN_LINES = f"""
select event_id as line_no, line from (select event_id, {_WARN_LINE} as line from events)
where line not like '%WARN fs.FileSystem%'
"""


def first_parsable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_parsable_size(_lines(spark, sf_dir, _SIZE_LINE), ["log_id"], ["line_no"])


FIRST_PARSABLE_SIZE = f"""
with lines as (select event_id // 3 as log_id, event_id, {_SIZE_LINE} as line from events),
hits as (select log_id, arg_min(regexp_extract(line, '^(.*)\t', 1)::bigint, event_id) as size from lines
         where not contains(line, 'WARN') and not contains(line, 'warning')
           and regexp_full_match(regexp_extract(line, '^(.*)\t', 1), '\\s*[+-]?\\d+\\s*') group by 1)
select l.log_id, size from (select distinct log_id from lines) l left join hits using (log_id)
"""


def first_parsable_size_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_parsable_size(_lines(spark, sf_dir, _OLD_SIZE_LINE), ["log_id"], ["line_no"], old_form=True)


FIRST_PARSABLE_SIZE_OLD = f"""
with lines as (select event_id // 3 as log_id, event_id, {_OLD_SIZE_LINE} as line from events),
hits as (select log_id, arg_min(regexp_extract(line, '\t([^\t]*)$', 1)::bigint, event_id) as size from lines
         where not contains(line, 'WARN') and not contains(line, 'warning')
           and regexp_full_match(regexp_extract(line, '\t([^\t]*)$', 1), '\\s*[+-]?\\d+\\s*') group by 1)
select l.log_id, size from (select distinct log_id from lines) l left join hits using (log_id)
"""


def job_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", F.lit("job"), "o_orderkey", "o_orderstatus")
    files = table(spark, sf_dir, "orders").select(name.alias("name"), "o_orderkey")
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("job_"), F.col("c_custkey"), F.lit("_")))
    return logs.job_history_scan(files, "name", ids)


JOB_HISTORY_SCAN = """
select name, o_orderkey from (select 'job_' || o_orderkey || '_' || o_orderstatus as name, o_orderkey from orders)
where exists (select 1 from customer where starts_with(name, 'job_' || c_custkey || '_'))
"""

QUERIES = {
    "extract_job_id": (extract_job_id, EXTRACT_JOB_ID),
    "listing_lines": (listing_lines, LISTING_LINES),
    "drop_warn_lines": (drop_warn_lines, DROP_WARN_LINES),
    "first_parsable_size": (first_parsable_size, FIRST_PARSABLE_SIZE),
    "first_parsable_size_old": (first_parsable_size_old, FIRST_PARSABLE_SIZE_OLD),
    "job_history_scan": (job_history_scan, JOB_HISTORY_SCAN),
}
