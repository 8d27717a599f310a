"""Tolerant reading of loosely structured JSON, such as answers of language models, with the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bullets, json_array, json_object, key_sentences, strip, string_list

SENTIMENTS = ("positive", "negative", "neutral")
#: Phrases of the requested schema; an answer with two of them echoes it.
ECHO = ("單一字串", "單字串", "非array", "每點用", "每點之間用換行符", "唔超過10個字", "唔超過10字", "至8重點", "5至8個重點")


def parsed(c: Column) -> Column:
    """The widest JSON object of an answer as a variant; null if there is none."""
    return F.try_parse_json(json_object(c))


def strings(v: Column, path: str) -> Column:
    """An array of strings, from an array or from text between commas."""
    many = F.try_variant_get(v, path, "array<string>")
    one = F.try_variant_get(v, path, "string")
    return F.coalesce(many, F.when(one.isNotNull() & ~one.startswith("["), F.split(one, "[,，、\n]")), F.array().cast("array<string>"))


def short_list(v: Column, path: str, limit: int, width: int = 24) -> Column:
    return string_list(F.array_join(strings(v, path), "\n"), limit, width)


def score(v: Column, path: str = "$.score") -> Column:
    """1 to 10; 5 if it can't be read. Numbers lose their fraction, text must be a whole number, true counts 1."""
    one = F.try_variant_get(v, path, "variant")
    told = F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(one)
    text = F.when(told.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(told)).try_cast("decimal(38,0)")
    n = F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.when(told == "true", 1).otherwise(0)).otherwise(F.try_variant_get(v, path, "double"))
    n = F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(11.0), n.cast("double"))).cast("int"))
    return F.when(n.isNull(), 5).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), n)))


def summary(v: Column, path: str = "$.summary") -> Column:
    """A bullet a line, from a list or from text."""
    many = F.try_variant_get(v, path, "array<string>")
    lines = F.filter(F.transform(many, lambda x: strip(F.regexp_replace(strip(x), "^・", ""))), lambda x: x != "")
    return F.coalesce(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("・"), x)), "\n"), bullets(F.try_variant_get(v, path, "string")), F.lit(""))


def entities(v: Column) -> Column:
    return F.struct(*(short_list(v, f"$.entities.{k}", 2).alias(k) for k in ("people", "companies", "places", "dates", "numbers")))


def upcoming(v: Column) -> Column:
    """At most two announced events with a padded date and a title of up to 30 characters."""
    rows = F.coalesce(F.try_variant_get(v, "$.upcoming_events", "array<struct<date:string,title:string>>"), F.array().cast("array<struct<date:string,title:string>>"))
    ok = F.filter(rows, lambda e: strip(e["date"]).rlike(r"^\d{4}-\d{2}-\d{2}$") & (strip(e["title"]) != ""))
    return F.slice(F.transform(ok, lambda e: F.struct(strip(e["date"]).alias("date"), F.substring(strip(e["title"]), 1, 30).alias("title"))), 1, 2)


def analysis(raw: Column) -> Column:
    """All fields of an article's analysis; null if the answer holds no object."""
    v = parsed(raw)
    tone = F.lower(F.try_variant_get(v, "$.sentiment", "string"))
    text = lambda p, n: F.substring(strip(F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))), 1, n)
    out = F.struct(
        summary(v).alias("summary"), score(v).alias("score"), short_list(v, "$.tags", 3).alias("tags"), F.when(tone.isin(*SENTIMENTS), tone).otherwise("neutral").alias("sentiment"), text("$.topic", 20).alias("topic"), text("$.event_type", 12).alias("event_type"),
        entities(v).alias("entities"), key_sentences(strings(v, "$.key_sentences")).alias("key_sentences"), upcoming(v).alias("upcoming_events"),
    )
    return F.when(v.isNotNull(), out)


def digest(raw: Column) -> Column:
    """A cluster's digest: a headline and two to four angles, else null; at most three contradictions and six timeline rows."""
    v = parsed(raw)
    head = strip(F.coalesce(F.try_variant_get(v, "$.headline", "string"), F.lit("")))
    list_of = lambda p, t: F.coalesce(F.try_variant_get(v, p, f"array<{t}>"), F.array().cast(f"array<{t}>"))
    filled = lambda x: F.coalesce(strip(x), F.lit("")) != ""
    angles = F.slice(F.filter(list_of("$.angles", "struct<label:string,sources:array<string>,summary:string>"), lambda a: filled(a["label"]) & (F.size(F.coalesce(a["sources"], F.array().cast("array<string>"))) > 0)), 1, 4)
    against = F.slice(F.filter(list_of("$.contradictions", "struct<topic:string,claim_a:string,claim_b:string,note:string>"), lambda c: filled(c["topic"]) & filled(c["claim_a"]) & filled(c["claim_b"]) & filled(c["note"])), 1, 3)
    line = F.slice(F.filter(list_of("$.timeline", "struct<time:string,event:string>"), lambda t: filled(t["event"])), 1, 6)
    return F.when((head != "") & (F.size(angles) >= 2), F.struct(head.alias("headline"), angles.alias("angles"), against.alias("contradictions"), line.alias("timeline")))


def slots(df: DataFrame, raw: str, expected: str, key: str) -> DataFrame:
    """(key, pos, slot): a batch answer's slots by position. All null if their number isn't the expected one; a slot that is no object is null."""
    v = F.try_parse_json(json_array(F.col(raw)))
    items = F.try_variant_get(v, "$", "array<variant>")
    whole = df.select(key, F.when(F.size(items) == F.col(expected), items).alias("items"), F.sequence(F.lit(0), F.greatest(F.col(expected) - 1, F.lit(0))).alias("at")).filter(F.size("at") > 0)
    each = whole.select(key, "items", F.explode("at").alias("pos"))
    got = F.get(F.col("items"), F.col("pos"))
    return each.select(key, "pos", F.when(F.schema_of_variant(got).startswith("OBJECT"), F.to_json(got)).alias("slot"))


def echoes_schema(c: Column) -> Column:
    """Whether two or more of the schema's own phrases are in the text."""
    n = F.lit(0)
    for phrase in ECHO:
        n = n + F.lower(F.coalesce(c, F.lit(""))).contains(phrase).cast("int")
    return n >= 2


def stale(version: Column, current: str, score_: Column, summary_: Column) -> Column:
    """Whether a cached analysis is to be made again."""
    return score_.isNull() | ~version.eqNullSafe(F.lit(current)) | F.coalesce(strip(summary_).startswith("["), F.lit(False)) | echoes_schema(summary_)
