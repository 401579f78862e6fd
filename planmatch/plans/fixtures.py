"""Inputs of the operators as views over the test tables, in Spark and as SQL for DuckDB: both give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.operators import catalog as cat
from planmatch.operators import native

CATALOG = """with b as (select p_partkey k, concat(substr('ODQILJSGAB', cast(1 + p_partkey % 10 as int), 1), lpad(cast((p_partkey {div} 10) % 1000 as {text}), 3, '0')) stem,
    p_size % 2 = 0 f, 2000000 + p_retailprice x, 600000 + p_size * {ten} y from {part})
select concat('S', k) source_id, concat(stem, case when f then 'F' else '' end) pole_id_raw, case when k % 97 = 0 then null else x end x, case when k % 97 = 0 then null else y end y from b
union all select concat('D', k), concat(stem, case when f then 'F' else '' end), x + case when k % 40 = 0 then 0 else 5 end, y from b where k % 20 = 0
union all select concat('T', k), concat(stem, case when f then '' else 'F' end), x, y from b where k % 15 = 0"""

READINGS = """with r as (select l_orderkey % 50 + 1 page_number, l_linenumber tile_index,
    row_number() over (partition by l_orderkey % 50, l_linenumber order by l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) pos,
    lpad(cast((l_partkey {div} 10) % 1000 as {text}), 3, '0') d, case when cast(l_quantity as int) % 2 = 0 then 'F' else '' end f,
    (l_orderkey + l_partkey) % 12 k, round(1 - l_discount * 3, 4) model_confidence, l_returnflag <> 'R' model_reports_complete, (l_linestatus = 'O' and l_tax > 0.07) model_reports_edge_clipped from {lineitem})
select page_number, tile_index, pos,
    case k when 0 then concat('O', d, f) when 1 then concat('P#O', d, f) when 2 then concat('P#0', d, f) when 3 then concat('P-1', d, f) when 4 then concat('XY:5', d, f) when 5 then concat('P6', d, f)
           when 6 then concat('O-', d, f) when 7 then concat('0', d) when 8 then 'UNK' when 9 then 'P#TBD' when 10 then concat(d, ' ELM ST') else concat('O ', d, f) end raw_text,
    case when k = 7 then concat('POLE#: 0', d) else '' end label_text, model_confidence, model_reports_complete, model_reports_edge_clipped from r"""

REPLIES = """select page_number, tile_index, reply, concat(case when tile_index % 3 = 0 then '```json ' else '' end, '{{"candidates": [', {listagg}, ']}}', case when tile_index % 3 = 0 then ' ```' else '' end) raw_response
from (select *, cast((pos - 1) {div} 50 as bigint) reply, concat('{{"text": "', raw_text, '", "label_text": "', label_text, '", "confidence": ', cast(cast(round(model_confidence * 100) as int) as {text}), 'e-2',
        case when pos % 5 = 0 then '' else concat(', "complete": ', case when model_reports_complete then 'true' else '"no"' end) end,
        ', "touches_tile_edge": ', case when model_reports_edge_clipped then 'true' else 'false' end, '}}') j from {readings}) t
group by page_number, tile_index, reply"""

PAGES = """select o_custkey % 50 doc_id, row_number() over (partition by o_custkey % 50 order by o_orderkey) page_number, case when o_orderstatus = 'F' then 0 else cast(o_orderkey % 400 as int) end embedded_word_count,
    cast(o_custkey % 3 as int) image_count, case when o_custkey % 3 = 0 then {zero} else round((o_orderkey % 101) / {hundred}, 4) end largest_image_coverage, {height} height_points,
    case when o_orderkey % 2 = 0 then {wide} else {narrow} end width_points from {orders}"""

JOBS = """select user_id job_id, row_number() over (partition by user_id order by ts, event_id) seq, ts,
    case event_type when 'signup' then 'queued' when 'view' then 'processing' when 'click' then 'progress' when 'purchase' then 'completed' else 'failed' end event, event_id from {events}"""

_SPARK = {"div": "div", "text": "string", "ten": "10.0D", "zero": "0.0D", "hundred": "100.0D", "height": "1728.0D", "wide": "2592.0D", "narrow": "1224.0D", "listagg": "listagg(j, ', ') within group (order by pos)"}
_DUCK = {"div": "//", "text": "varchar", "ten": "10.0::double", "zero": "0.0::double", "hundred": "100.0::double", "height": "1728.0::double", "wide": "2592.0::double", "narrow": "1224.0::double", "listagg": "string_agg(j, ', ' order by pos)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(text.format(**_SPARK, **{k: "{" + k + "}" for k in tables}), **tables)


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few bytes a record but much work: a small file would make few tasks of all of it, and a count given isn't merged again
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _view(spark, CATALOG, part=part)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.load(raw_catalog(spark, sf_dir))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As after a reply is parsed: an empty label is the text itself."""
    rows = _view(spark, READINGS, lineitem=table(spark, sf_dir, "lineitem"))
    return rows.withColumn("label_text", F.coalesce(F.nullif("label_text", F.lit("")), F.col("raw_text")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings, as replies of up to 50 each."""
    return _view(spark, REPLIES.replace("{{", "{{{{").replace("}}", "}}}}"), readings=_view(spark, READINGS, lineitem=table(spark, sf_dir, "lineitem")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, PAGES, orders=table(spark, sf_dir, "orders"))
    # the window's few bytes come in one task, and what follows works hard on each row: a count given isn't merged again
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, JOBS, events=table(spark, sf_dir, "events"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their words; numbers count empty strings between two blanks too."""
    # words are matched where their text is read: one small file would make few tasks of all of it
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    y = F.col("line_number") * F.lit(12.0)

    def word(text, i):
        x = i * F.lit(10.0)
        return F.struct(i.alias("word_number"), text.alias("text"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 10).alias("y1"))

    there = F.filter(F.transform(F.split("line", " "), word), lambda w: w["text"] != "")
    return native.lines(each.select(F.col("doc_id").alias("page_index"), (F.col("doc_id") + 1).alias("page_number"), F.lit(0).alias("block_number"), "line_number", there.alias("words")))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.rows_of(lines(spark, sf_dir))


def text_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur in texts: long words of the benchmark table, in upper case."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[\n ]")).alias("w")).filter("length(w) >= 8").select(F.upper("w").alias("id")).distinct()
    return cat.load(w.select(F.concat(F.lit("B"), "id").alias("source_id"), F.col("id").alias("pole_id_raw"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))


# ---------------------------------------------------------------- the same for DuckDB, as common table expressions


def duck(text: str, **tables: str) -> str:
    return text.format(**_DUCK, **tables)


DUCK_CATALOG = f"fx_catalog as (select source_id, pole_id_raw, upper(pole_id_raw) as pole_id_normalized, x, y from ({duck(CATALOG, part='part')}))"
DUCK_RAW_READINGS = f"fx_raw as ({duck(READINGS, lineitem='lineitem')})"
DUCK_READINGS = DUCK_RAW_READINGS + ", fx_readings as (select * replace (case when label_text = '' then raw_text else label_text end as label_text) from fx_raw)"
DUCK_REPLIES = DUCK_RAW_READINGS + f", fx_replies as ({duck(REPLIES, readings='fx_raw')})"
DUCK_PAGES = f"fx_pages as ({duck(PAGES, orders='orders')})"
DUCK_JOBS = f"fx_jobs as ({duck(JOBS, events='events')})"
DUCK_WORDS = """fx_l as (select doc_id, unnest(range(len(a))) line_number, unnest(a) line from (select doc_id, string_split(text, chr(10)) a from documents)),
fx_w as (select doc_id, line_number, unnest(range(len(a))) word_number, unnest(a) text from (select doc_id, line_number, string_split(line, ' ') a from fx_l)),
fx_words as (select doc_id page_index, doc_id + 1 page_number, line_number, word_number, text, 10.0::double * word_number x0, 12.0::double * line_number y0, 10.0::double * word_number + 8 x1, 12.0::double * line_number + 10 y1
    from fx_w where text <> '')"""
DUCK_TEXT_CATALOG = """fx_tcat as (select distinct upper(replace(w, 'ß', 'SS')) as id from (select unnest(string_split_regex(text, '[\\n ]')) w from benchmark) where length(w) >= 8)"""
