"""Greedy de-duplication as a lexicographically first maximal independent set.

Rows are ordered by (first_seen_at, id). A row is a confirmed duplicate if an earlier
*retained* row shares a strong key: source and external id, canonical URL, or
fingerprint of a posting with a description. Confirmed duplicates register nothing,
so this is no dropDuplicates. Each round retains the rows that are first in all
their key groups and drops those that share a key with one of them; the number of
rounds is the length of the longest chain of dependencies, not of the input.
Retained rows then meet by company, title and location: up to 20 earliest retained
ones are candidates for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc
from ..scratch import checkpointed
from .vocabulary import MOST_CANDIDATES

LAYERS = ["SOURCE_EXTERNAL_ID", "CANONICAL_APPLICATION_URL", "STABLE_FINGERPRINT"]
DETAILS = {
    "SOURCE_EXTERNAL_ID": "Source and external identifier match exactly.",
    "CANONICAL_APPLICATION_URL": "Canonical application URLs match exactly.",
    "STABLE_FINGERPRINT": "Versioned normalized-job fingerprints match exactly.",
    "COMPANY_TITLE_LOCATION": "Normalized company, title, and location keys match; retained for review.",
}


_SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def json_string(text: Column) -> Column:
    """A JSON string; null becomes null. Control characters in short or four-digit form."""
    out = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    for code, letter in _SHORT.items():
        out = F.regexp_replace(out, f"\\x{code:02x}", rf"\\{letter}")
    full = out
    for code in set(range(32)) - set(_SHORT):
        full = F.regexp_replace(full, f"\\x{code:02x}", rf"\\u{code:04x}")
    out = F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), full).otherwise(out)
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), out, F.lit('"')))


def fingerprint_text() -> Column:
    """The canonical JSON whose SHA-256 is a posting's fingerprint."""
    pairs = {
        "company": F.col("company_key"), "department": F.lower(nfkc(F.col("department"))), "description": nfkc(F.col("description")), "employmentType": F.col("employment_type"),
        "location": F.col("location_key"), "office": F.lower(nfkc(F.col("office"))), "title": F.col("title_key"),
    }
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), json_string(nfkc(v))) for k, v in pairs.items())), F.lit("}"))


def with_fingerprint(normalized: DataFrame) -> DataFrame:
    return normalized.withColumn("fingerprint", F.sha2(fingerprint_text(), 256))


def strong_keys(jobs: DataFrame) -> DataFrame:
    """(ord, layer, key): one row a strong key of a posting."""
    described = F.length(F.btrim(F.coalesce("description", F.lit("")))) > 0
    keys = F.array(
        F.when(F.col("source_id").isNotNull() & F.col("external_id").isNotNull(), F.struct(F.lit(0).alias("layer"), F.concat_ws("\0", "source_id", "external_id").alias("key"))),
        F.struct(F.lit(1).alias("layer"), F.col("identity_url").alias("key")),
        F.when(described, F.struct(F.lit(2).alias("layer"), F.col("fingerprint").alias("key"))),
    )
    ord_ = F.struct(F.col("first_seen_at").alias("seen"), F.col("id").alias("id"))
    return jobs.select(ord_.alias("ord"), F.explode(F.array_compact(keys)).alias("k")).select("ord", "k.layer", "k.key")


def retained(keys: DataFrame) -> DataFrame:
    """(ord) of the rows the greedy scan keeps."""
    left = checkpointed(keys)
    kept = None
    while not left.isEmpty():
        heads = left.groupBy("layer", "key").agg(F.min("ord").alias("head"))
        met = checkpointed(left.join(heads, ["layer", "key"]))
        now = checkpointed(met.groupBy("ord").agg(F.bool_and(F.col("head") == F.col("ord")).alias("first")).where("first").select("ord"))
        lost = met.join(now.select(F.col("ord").alias("head")), "head", "left_semi").select("ord").distinct()  # itself or a follower
        kept = now if kept is None else checkpointed(kept.unionAll(now))
        left = checkpointed(left.join(lost, "ord", "left_anti"))
    return kept if kept is not None else keys.select("ord")


def classify(jobs: DataFrame) -> DataFrame:
    """jobs (with fingerprint) plus decision, primary_job_id, duplicate_layer and candidate_job_ids."""
    keys = checkpointed(strong_keys(jobs))
    kept = retained(keys)
    owners = keys.join(kept, "ord", "left_semi").select("layer", "key", F.col("ord").alias("owner"))
    matched = keys.join(kept, "ord", "left_anti").join(owners, ["layer", "key"]).where("owner < ord")
    best = matched.groupBy("ord").agg(F.min(F.struct("layer", "owner")).alias("best"))
    best = best.select(F.col("ord.id").alias("id"), F.col("best.owner.id").alias("primary_job_id"), F.get(F.array(*map(F.lit, LAYERS)), F.col("best.layer")).alias("duplicate_layer"))
    out = jobs.join(best, "id", "left")

    group = ["company_key", "title_key", "location_key"]
    ord_ = F.struct("first_seen_at", "id")
    alone = out.where("primary_job_id IS NULL").select("id", *group, ord_.alias("ord"))
    early = alone.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("ord"))).where(F.col("n") <= MOST_CANDIDATES)
    early = early.groupBy(*group).agg(F.array_sort(F.collect_list("ord")).alias("early"))  # MOST_CANDIDATES at most
    before = F.transform(F.filter("early", lambda x: x < F.col("ord")), lambda x: x["id"])
    review = alone.join(early, group).select("id", before.alias("candidate_job_ids")).where(F.size("candidate_job_ids") > 0)
    out = out.join(review, "id", "left")
    decision = F.when(F.col("primary_job_id").isNotNull(), "DUPLICATE").when(F.col("candidate_job_ids").isNotNull(), "POSSIBLE_DUPLICATE").otherwise("UNIQUE")
    return out.withColumn("duplicate_decision", decision).withColumn("duplicate_evidence", evidence())


def evidence() -> Column:
    """Which layer matched which posting, with the compared values of the row itself."""
    own = F.struct(F.col("identity_url").alias("canonicalApplicationUrl"), F.col("company_key").alias("company"), F.col("title_key").alias("title"), F.col("location_key").alias("location"))
    table = F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv])
    row = lambda layer, matched: F.struct(layer.alias("layer"), matched.alias("matched_job_id"), F.try_element_at(table, layer).alias("details"), own.alias("compared_values"))
    weak = F.transform(F.coalesce("candidate_job_ids", F.array().cast("array<string>")), lambda x: row(F.lit("COMPANY_TITLE_LOCATION"), x))
    return F.when(F.col("primary_job_id").isNotNull(), F.array(row(F.col("duplicate_layer"), F.col("primary_job_id")))).otherwise(weak)
