"""Model replies: JSON out of free text, page assessments and tile readings.

Well-formed replies are parsed by Spark. Only those that Spark can't parse go through a Python decoder that takes the first JSON value which begins
in the text. Scalars are handled as JSON text, so that an absent key, a null and an empty value stay apart.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.text import BLANKS, WS, explicit_label, trimmed
from planmatch.functions.values import confidence, flag, once
from planmatch.operators.pages import FLAGS


def unfenced(c: Column) -> Column:
    """Without a fence around it. Patterns see only texts that begin with one: a reply is long."""
    opened = lambda t: F.when(t.startswith("```"), F.regexp_replace(t, rf"^(?i)```(?:json)?{WS}*", "")).otherwise(t)
    closed = lambda t: F.when(t.endswith("```"), F.rtrim(F.left(t, F.length(t) - 3), F.lit(BLANKS))).otherwise(t)
    return once(once(trimmed(c), opened), closed)


def first_json(text: Column) -> Column:
    """The first JSON value that starts at a brace or bracket, written anew; null if none does, or if values nest deeper than the decoder goes."""

    def found(text: str | None) -> str | None:
        decoder = json.JSONDecoder()
        for i, c in enumerate(text or ""):
            if c in "{[":
                try:
                    return json.dumps(decoder.raw_decode(text, i)[0])
                except RecursionError:
                    return None
                except ValueError:
                    pass
        return None

    @F.pandas_udf("string")
    def salvage(texts: pd.Series) -> pd.Series:
        return texts.map(found)

    return salvage(text)


def payload(rows: DataFrame, column: str = "raw_response") -> DataFrame:
    """``rows`` with ``payload`` (variant) and ``error``. The decoder gets only the texts that need it, nulls for the rest.

    A reply is few bytes but much work: replies are dealt to as many tasks as shuffles have, which a count given keeps from being merged.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = unfenced(F.coalesce(column, F.lit("")))
    needed = once(text, lambda t: F.when(F.try_parse_json(t).isNull() & (t != ""), t))
    rows = rows.withColumn("__salvaged", first_json(needed))
    rows = rows.withColumn("payload", F.coalesce(F.try_parse_json(text), F.try_parse_json("__salvaged")))
    blank = trimmed(F.coalesce(column, F.lit(""))) == ""
    error = F.when(blank, "the reply is empty").when(F.col("payload").isNull(), "the reply holds no valid JSON")
    return rows.withColumn("error", error).drop("__salvaged")


def scalar(v: Column, path: str) -> Column:
    """A scalar of a variant as text; null for an absent key and for a JSON null."""
    return F.try_variant_get(v, path, "string")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_list(v: Column) -> Column:
    """Whether it is an array, told without the kinds of all that it holds."""
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def present(v: Column, key: str) -> Column:
    """Whether an object has the key, null values included."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def truthy(v: Column, path: str) -> Column:
    """A scalar as text where it is neither empty, zero nor false; else null."""
    zero = lambda x: F.coalesce(kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (scalar(x, "$").try_cast("double") == 0), F.lit(False)) | ((kind(x) == "BOOLEAN") & (scalar(x, "$") == "false"))
    return once(F.try_variant_get(v, path, "variant"), lambda x: F.when((scalar(x, "$") != "") & ~zero(x), scalar(x, "$")))


def assessments(rows: DataFrame, column: str = "raw_response") -> DataFrame:
    """The four flags, confidence, reason and error of page replies."""
    out = payload(rows, column)

    def parts(p: Column) -> Column:
        flags = [flag(F.coalesce(scalar(p, f"$.{c}"), F.lit(""))).alias(c) for c in FLAGS]
        reason = F.left(trimmed(F.coalesce(truthy(p, "$.reason"), F.lit(""))), F.lit(500))
        return F.struct(*flags, confidence(F.coalesce(scalar(p, "$.confidence"), F.lit(""))).alias("confidence"), reason.alias("reason"), (~kind(p).startswith("OBJECT")).alias("other"))

    given = [c for c in out.columns if c not in ("payload", "error", "__p")]
    out = out.withColumn("__p", once(F.col("payload"), parts))
    error = F.coalesce("error", F.when(F.col("__p.other"), "the reply is no JSON object"))
    return out.select(*given, *(F.col(f"__p.{c}").alias(c) for c in (*FLAGS, "confidence", "reason")), error.alias("error"))


LISTS = ["candidates", "facility_ids", "pole_ids"]


def readings(rows: DataFrame, keys: list[str], column: str = "raw_response") -> DataFrame:
    """keys, pos (from 1), raw_text, label_text, context_type, model_confidence, model_reports_complete, model_reports_edge_clipped, explicit_pole_context."""
    out = payload(rows, column).filter("error is null")
    p = F.col("payload")
    lists = [F.when(is_list(F.try_variant_get(p, f"$.{c}", "variant")) & F.try_variant_get(p, f"$.{c}[0]", "variant").isNotNull(), F.try_variant_get(p, f"$.{c}", "variant")) for c in LISTS]
    chosen = F.when(is_list(p), p).when(is_object(p), F.coalesce(*lists))

    def item(x: Column) -> Column:
        """An entry with its kind and text: made once, where a filter on columns would make them again."""
        kind_ = F.when(is_object(x), "OBJECT").otherwise(kind(x))
        of_object = trimmed(F.coalesce(*(truthy(x, f"$.{c}") for c in ("text", "id", "facility_id", "pole_id"))))
        return once(kind_, lambda k: F.struct(x.alias("v"), k.alias("kind"), F.when(k == "OBJECT", of_object).when(k == "STRING", trimmed(scalar(x, "$"))).alias("raw_text")))

    items = out.select(*keys, F.posexplode(F.transform(F.try_variant_get(chosen, "$", "array<variant>"), item)).alias("__pos", "__item")).select(*keys, "__pos", "__item.*")
    v = F.col("v")
    text, is_text = scalar(v, "$"), F.col("kind") == "STRING"
    either = lambda a, b: flag(F.coalesce(F.when(present(v, a), scalar(v, f"$.{a}")).otherwise(scalar(v, f"$.{b}")), F.lit("")))
    items = items.filter(F.col("raw_text") != "")
    label = F.when(is_text, text).otherwise(trimmed(F.coalesce(truthy(v, "$.label_text"), F.col("raw_text"))))
    return items.select(
        *keys, (F.col("__pos") + 1).alias("pos"), "raw_text", label.alias("label_text"), F.when(is_text, "unknown").otherwise(F.lower(trimmed(F.coalesce(truthy(v, "$.context_type"), F.lit("unknown"))))).alias("context_type"),
        F.when(is_text, 0.0).otherwise(confidence(F.coalesce(scalar(v, "$.confidence"), F.lit("")))).alias("model_confidence"), F.when(is_text, False).otherwise(either("complete", "is_complete")).alias("model_reports_complete"),
        F.when(is_text, False).otherwise(either("touches_tile_edge", "edge_clipped")).alias("model_reports_edge_clipped"),
    ).withColumn("explicit_pole_context", explicit_label("label_text") | explicit_label("raw_text"))


def errors(rows: DataFrame, column: str = "raw_response") -> DataFrame:
    """``rows`` with the error of each tile reply, null where it has a list of candidates, perhaps an empty one."""
    out = payload(rows, column)
    p = F.col("payload")
    bad = [kind(F.try_variant_get(p, f"$.{c}", "variant")) for c in LISTS]
    # the first value that isn't empty decides
    empty = lambda k, c: k.isNull() | (k == "VOID") | (k.startswith("ARRAY") & F.try_variant_get(p, f"$.{c}[0]", "variant").isNull()) | (F.try_variant_get(p, f"$.{c}", "variant").isNotNull() & truthy(p, f"$.{c}").isNull() & ~k.rlike("^(ARRAY|OBJECT<.)")) | (k == "OBJECT<>")
    first = F.coalesce(*(F.when(~empty(k, c), k) for k, c in zip(bad, LISTS)), F.lit("ARRAY"))
    error = F.when(kind(p).startswith("ARRAY"), None).when(~kind(p).startswith("OBJECT"), "the reply has no list of candidates").when(~first.startswith("ARRAY"), "candidates are no JSON list")
    return out.withColumn("error", F.coalesce("error", error)).drop("payload")
