"""Board payloads: a table of (source_id, company, body) with a board's JSON a row; with a
column page, a board's JSON is several rows, and repeats are found across them.

The envelope must parse, else the whole source is invalid; items are checked one by
one. Values keep their JSON types, so a numeric title is an invalid item and not "7".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(item: str, path: str) -> Column:
    """A string at a path; null if it is absent or no string."""
    at = F.expr(f"try_variant_get({item}, '{path}', 'variant')")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def _wrong(item: str, *paths: str) -> Column:
    """Whether something other than a string stands at one of the paths."""
    bad = F.lit(False)
    for path in paths:
        at = F.expr(f"try_variant_get({item}, '{path}', 'variant')")
        bad = bad | F.coalesce(F.schema_of_variant(at) != "STRING", F.lit(False))
    return bad


def _items(bodies: DataFrame, path: str) -> DataFrame:
    array = F.expr(f"try_variant_get(try_parse_json(body), '{path}', 'array<variant>')")
    rows = bodies.withColumn("items", array)
    if "page" not in bodies.columns:
        return rows.select("source_id", "company", F.posexplode("items").alias("pos", "item"))
    rows = rows.select("source_id", "company", "page", F.posexplode("items").alias("pos", "item"))
    return rows.withColumn("pos", F.struct("page", "pos"))


def invalid_envelopes(bodies: DataFrame, path: str) -> DataFrame:
    """Sources whose body is no JSON, or has no list where the items should be."""
    return bodies.where(F.expr(f"try_variant_get(try_parse_json(body), '{path}', 'array<variant>')").isNull()).select("source_id")


def _repeats(rows: DataFrame) -> DataFrame:
    """The first valid item of an id stays, also if it turns out to be unusable later."""
    from ..operators.collect import first_by_external_id

    good = first_by_external_id(rows.where("NOT invalid"), "pos")
    return good.unionByName(rows.where("invalid"), allowMissingColumns=True)


def board_a(bodies: DataFrame) -> DataFrame:
    """Items of {jobs: [...]}: id (string or number), title, absolute_url and optional fields."""
    rows = _items(bodies, "$.jobs")
    id_kind = F.schema_of_variant(F.expr("try_variant_get(item, '$.id', 'variant')"))
    number = F.regexp_replace(F.try_variant_get("item", "$.id", "string"), r"(\.[0-9]*?)0+$", "$1")
    id_ = F.when(id_kind == "STRING", F.try_variant_get("item", "$.id", "string")).when(id_kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), F.regexp_replace(number, r"\.$", ""))
    title, url = _text("item", "$.title"), _text("item", "$.absolute_url")
    bad = id_.isNull() | title.isNull() | url.isNull() | _wrong("item", "$.content", "$.updated_at", "$.location.name")
    updated = _text("item", "$.updated_at")
    return _repeats(rows.select(
        "source_id", "company", "pos", bad.alias("invalid"), id_.alias("external_id"), title.alias("title"), url.alias("source_url"), url.alias("application_url"), _text("item", "$.content").alias("description"),
        _text("item", "$.location.name").alias("location_text"), _text("item", "$.departments[0].name").alias("department"), *(F.lit(None).cast("string").alias(c) for c in ("raw_employment_type", "raw_workplace_type", "published_at", "expires_at")),
        F.when(updated.isNotNull(), F.to_json(F.struct(updated.alias("sourceUpdatedAt")))).alias("metadata"),
    ))


def board_b(bodies: DataFrame) -> DataFrame:
    """Items of a top-level list: id, text, hostedUrl and optional fields; createdAt in milliseconds."""
    rows = _items(bodies, "$")
    id_, title, url = _text("item", "$.id"), _text("item", "$.text"), _text("item", "$.hostedUrl")
    bad = id_.isNull() | title.isNull() | url.isNull() | _wrong("item", "$.applyUrl", "$.description", "$.descriptionPlain", "$.workplaceType", "$.categories.location", "$.categories.team", "$.categories.commitment")
    created = F.date_format(F.timestamp_millis(F.try_variant_get("item", "$.createdAt", "bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _repeats(rows.select(
        "source_id", "company", "pos", bad.alias("invalid"), id_.alias("external_id"), title.alias("title"), url.alias("source_url"), _text("item", "$.applyUrl").alias("application_url"),
        F.coalesce(_text("item", "$.descriptionPlain"), _text("item", "$.description")).alias("description"), _text("item", "$.categories.location").alias("location_text"), _text("item", "$.categories.team").alias("department"),
        _text("item", "$.categories.commitment").alias("raw_employment_type"), _text("item", "$.workplaceType").alias("raw_workplace_type"), created.alias("published_at"), F.lit(None).cast("string").alias("expires_at"), F.lit(None).cast("string").alias("metadata"),
    ))


def registry(*entries: tuple[str, Callable[[DataFrame], DataFrame]]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Source types to loaders, in order; a type that comes twice is an error."""
    out: dict[str, Callable[[DataFrame], DataFrame]] = {}
    for source_type, load in entries:
        if source_type in out:
            raise ValueError(f'SOURCE_CONFIGURATION_INVALID: Collector type "{source_type}" is registered more than once.')
        out[source_type] = load
    return out


#: The legacy type yields no collectable source.
REGISTRY = registry(("greenhouse", board_a), ("lever", board_b))


def supported_types(known: dict[str, Callable[[DataFrame], DataFrame]] = REGISTRY) -> tuple[str, ...]:
    return tuple(known)


def loader(source_type: str, known: dict[str, Callable[[DataFrame], DataFrame]] = REGISTRY) -> Callable[[DataFrame], DataFrame]:
    if source_type not in known:
        raise KeyError(f'COLLECTOR_NOT_FOUND: No collector is registered for source type "{source_type}".')
    return known[source_type]
