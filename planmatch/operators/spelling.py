"""How labels spell ids: the parts of a label, the spellings that a label stands for, and those that stand for an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.text import LOOKALIKES, PENALTY, lookalike_name, normalized, plan_prefix, shape, trimmed, unknown_body, without_separators
from planmatch.operators import catalog as cat

VARIANT = "struct<phase:int,ord:int,text:string,penalty:int,steps:array<string>>"


def _variant(phase: int, order: int, text: Column, penalty: Column, steps: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), F.lit(order).alias("ord"), text.alias("text"), penalty.cast("int").alias("penalty"), steps.alias("steps")).cast(VARIANT)


def base_variants(body: Column, name: Column, penalty: Column, letters: Column) -> Column:
    """The body, and the body with each look-alike of its leading digit that begins a catalog id."""
    table = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d).alias("digit"), F.lit(x).alias("letter"), F.lit(cost).alias("cost"), F.lit(lookalike_name(d, x)).alias("step")) for i, (d, x, cost) in enumerate(LOOKALIKES, 1)])
    alike = F.filter(table, lambda x: (x["digit"] == F.left(body, F.lit(1))) & F.array_contains(letters, x["letter"]))
    rest = F.substring(body, 2, 2**31 - 1)
    more = F.transform(
        alike,
        lambda x: F.struct(F.lit(2).alias("phase"), x["ord"].alias("ord"), F.concat(x["letter"], rest).alias("text"), (penalty + x["cost"]).cast("int").alias("penalty"), F.array(name, x["step"]).alias("steps")).cast(VARIANT),
    )
    return F.when(body == "", F.array().cast(f"array<{VARIANT}>")).otherwise(F.concat(F.array(_variant(2, 0, body, penalty, F.array(name))), more))


def toggled(variant: Column) -> Column:
    ends = variant["text"].endswith("F")
    text = F.when(ends, F.left(variant["text"], F.length(variant["text"]) - 1)).otherwise(F.concat(variant["text"], F.lit("F")))
    step = F.when(ends, "removed_terminal_f").otherwise("added_terminal_f")
    return F.struct(
        F.lit(3).alias("phase"), variant["ord"].alias("ord"), text.alias("text"), (variant["penalty"] + PENALTY["added_terminal_f"]).alias("penalty"), F.concat(variant["steps"], F.array(step)).alias("steps")
    ).cast(VARIANT)


SPELLED = ["raw", "norm", "unknown", "joined", "body", "body_unknown", "context", "base", "more", "variants", "norm_shape"]


def spelled(readings: DataFrame, catalog: DataFrame) -> DataFrame:
    """``readings`` with SPELLED: normal form, body behind a marker and spelling variants."""
    none, nothing = F.array().cast(f"array<{VARIANT}>"), F.array().cast("array<string>")
    r = grammar(readings, cat.letters_array(catalog))
    readable = (F.col("norm") != "") & F.col("unknown").isNull()
    base = F.when(F.col("body").isNotNull() & F.col("body_unknown").isNull() & readable, base_variants(F.col("body"), F.col("name"), F.col("penalty"), F.col("__letters"))).otherwise(none)
    r = r.withColumn("base", base)
    r = r.withColumn("more", F.when(F.col("context"), none).otherwise(F.filter(F.transform("base", toggled), lambda v: v["text"] != "")))
    joined = F.when(F.col("joined") != F.col("norm"), _variant(1, 0, F.col("joined"), F.lit(0), F.array(F.lit("removed_identifier_separators"))))
    plain = F.array_compact(F.array(_variant(0, 0, F.col("norm"), F.lit(0), nothing), joined))
    r = r.withColumn("variants", F.when(readable, F.filter(F.concat(plain, "base", "more"), lambda v: v["text"] != "")).otherwise(none))
    return r.select(*[c for c in readings.columns if c not in SPELLED], *SPELLED)


def forms(ids: DataFrame) -> DataFrame:
    """form, pole_id, phase, ord, cost, made: every spelling of a label's body that is read as an id, with what that costs and the steps by which it is read so.

    At most nine for each of ``ids`` (pole_id): itself, with a last F more or less, and each with the digits that its first letter looks like.
    """
    ids = ids.filter("pole_id <> ''").distinct()
    whole, shorter = F.col("pole_id"), F.expr("left(pole_id, length(pole_id) - 1)")
    read = lambda text, phase, step: F.struct(text.alias("text"), F.lit(phase).alias("phase"), F.lit(step).alias("toggle"))
    toggled = F.when(whole.endswith("F") & ~shorter.endswith("F"), read(shorter, 3, "added_terminal_f"))
    each = ids.select("pole_id", F.inline(F.array_compact(F.array(read(whole, 2, ""), read(F.concat(whole, F.lit("F")), 3, "removed_terminal_f"), toggled)))).filter("text <> ''")
    table = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d).alias("digit"), F.lit(x).alias("letter"), F.lit(cost).alias("cost"), F.lit(lookalike_name(d, x)).alias("step")) for i, (d, x, cost) in enumerate(LOOKALIKES, 1)])
    same = F.struct(F.lit(0).alias("ord"), F.col("text").alias("form"), F.lit(0).alias("cost"), F.lit("").alias("step"))
    alike = F.transform(F.filter(table, lambda x: x["letter"] == F.left("text", F.lit(1))), lambda x: F.struct(x["ord"].alias("ord"), F.concat(x["digit"], F.expr("substring(text, 2)")).alias("form"), x["cost"].alias("cost"), x["step"].alias("step")))
    spelt = each.select("pole_id", "phase", "toggle", F.inline(F.concat(F.array(same), alike)))
    cost = F.col("cost") + F.when(F.col("phase") == 3, PENALTY["added_terminal_f"]).otherwise(0)
    return spelt.select("form", "pole_id", "phase", "ord", cost.cast("int").alias("cost"), F.filter(F.array("step", "toggle"), lambda x: x != "").alias("made"))


def grammar(readings: DataFrame, letters: Column) -> DataFrame:
    """``readings`` with the parts of a label: raw, norm, unknown, joined, norm_shape, context, name and penalty of the marker, body, body_unknown."""
    explicit = "model_confirmed_explicit_pole_context"
    r = readings.withColumn("raw", trimmed(F.coalesce(F.col("raw_text").cast("string"), F.lit("")))).withColumns({"norm": normalized("raw"), "__letters": letters})
    r = r.withColumns({"unknown": unknown_body("norm"), "joined": without_separators("norm"), "norm_shape": shape("norm"), "__p": plan_prefix("norm", F.col("__letters"))})
    context = F.col("__p").isNull() & F.coalesce(F.col("explicit_pole_context"), F.lit(False)) & F.left("norm", F.lit(1)).rlike(r"\p{Nd}|[²³¹]")
    r = r.withColumns({"context": context, "name": F.coalesce(F.col("__p.name"), F.lit(explicit)), "penalty": F.coalesce(F.col("__p.penalty"), F.lit(PENALTY[explicit])), "body_unknown": unknown_body(F.col("__p.body"))})
    return r.withColumn("body", F.when(F.col("context"), F.col("norm")).otherwise(F.col("__p.body"))).drop("__p")


def tried_bodies(body: Column, letters: Column) -> Column:
    """The spellings of a body that are looked up: itself, and with look-alikes of its leading digit that begin a catalog id; none of an empty one."""
    table = F.array(*[F.struct(F.lit(d).alias("digit"), F.lit(x).alias("letter")) for d, x, _ in LOOKALIKES])
    alike = F.filter(table, lambda x: (x["digit"] == F.left(body, F.lit(1))) & F.array_contains(letters, x["letter"]))
    rest = F.substring(body, 2, 2**31 - 1)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(body), F.transform(alike, lambda x: F.concat(x["letter"], rest))))
