"""Claims against their evidence: references checked with the fragment they name, values looked for in the quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of a claim's path that make it a decision, and the decisions that a claim may not make.
DECISION_PARTS = ("bid_decision", "final_recommendation", "recommendation", "decision")
POSITIVE = ("GO", "GO_WITH_CONDITIONS", "READY", "APPROVED", "APPROVED_WITH_NOTES", "YES", "TRUE")
#: Fields of a reference that have to be those of the fragment, with the error that each gives.
SAME = {"document_id": "reference_document_id_mismatch", "document_name": "reference_document_name_mismatch", "chunk_id": "reference_chunk_id_mismatch"}


def plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\x85\xa0]+", " ")))


def packet(fragments: DataFrame) -> DataFrame:
    """`fragments` (case, document_id, document_name, chunk_id, text) with `fragment_id`, a hash of all that is in it, and `text_sha256`; equal ones once."""
    said = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document_id", "document_name", "chunk_id", "text")))
    return fragments.withColumn("fragment_id", F.sha2(said, 256)).withColumn("text_sha256", F.sha2("text", 256)).dropDuplicates(["case", "fragment_id"])


def checked_references(references: DataFrame, fragments: DataFrame) -> DataFrame:
    """`references` (claim_id, case, fragment_id, document_id, document_name, chunk_id, quote, quote_sha256) with `errors`, in a fixed order.

    A reference is joined with the fragment whose id it gives, so no text is searched for but the quote in its own fragment; that is
    a comparison of characters, not of hashes. Null quotes are found nowhere.
    """
    right = fragments.select(F.col("fragment_id").alias("__id"), F.col("case").alias("__case"), F.col("text").alias("__text"), *(F.col(c).alias(f"__{c}") for c in SAME))
    j = references.join(right, references["fragment_id"] == right["__id"], "left")
    found = F.col("__id").isNotNull()
    tests = [(~F.col("case").eqNullSafe(F.col("__case")) & found, "reference_procurement_case_mismatch"), (~found, "reference_fragment_not_found")]
    tests += [(found & ~F.col(c).eqNullSafe(F.col(f"__{c}")), e) for c, e in SAME.items()]
    tests += [(found & ~F.sha2("quote", 256).eqNullSafe(F.col("quote_sha256")), "reference_quote_hash_mismatch"), (found & ~F.coalesce(F.contains("__text", "quote"), F.lit(False)), "reference_quote_not_found")]
    return j.withColumn("errors", F.array_compact(F.array(*(F.when(t, e) for t, e in tests)))).select(*references.columns, "errors")


def prohibited(path: Column, value: Column) -> Column:
    """A claim that takes part itself: its path names a decision, and its value is a positive one."""
    parts = F.transform(F.split(path, r"[.\[\]/]"), lambda x: F.lower(x))
    return F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, DECISION_PARTS))) & F.upper(F.trim(value)).isin(*POSITIVE), F.lit(False))


def supported(values: Column, quotes: Column) -> Column:
    """Each of the values (an array; blanks do not count, one has to be left) stands in the joined quotes, spacing and case aside."""
    text = plain(F.array_join(quotes, "\n"))
    some = F.filter(F.transform(values, plain), lambda v: v != "")
    return F.coalesce((F.size(some) > 0) & F.forall(some, lambda v: F.contains(text, v)), F.lit(False))


def validated(claims: DataFrame, references: DataFrame) -> DataFrame:
    """`claims` (claim_id, field_path, value, values) with support_status, validated_confidence, basis and errors. references: as checked above.

    Positive decisions are rejected whatever they cite; claims without references lack evidence; any error of a reference, or a value that no
    quote holds, rejects; one good reference supports at 0.95, several at 0.98. Claims that share an id are told of it and so rejected, but for the first by `at`.
    """
    own = references.groupBy("claim_id").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("wrong"), F.collect_list("quote").alias("quotes"))
    first = claims.groupBy("claim_id").agg(F.min("at").alias("first"))
    j = claims.join(own, "claim_id", "left").join(first, "claim_id")
    twice = F.when(F.col("at") > F.col("first"), F.array(F.lit("duplicate_claim_id"))).otherwise(F.array().cast("array<string>"))
    wrong = F.array_union(twice, F.coalesce("wrong", F.array().cast("array<string>")))
    lexical = F.when((F.size(wrong) == 0) & ~supported(F.col("values"), F.col("quotes")), F.array(F.lit("claim_value_not_lexically_supported"))).otherwise(F.array().cast("array<string>"))
    never, none = prohibited(F.col("field_path"), F.col("value")), F.col("n").isNull()
    errors = F.when(never, F.concat(twice, F.array(F.lit("provider_positive_decision_prohibited")))).when(none, F.concat(twice, F.array(F.lit("claim_has_no_evidence")))).otherwise(F.array_sort(F.concat(wrong, lexical)))
    good = ~never & ~none & (F.size(errors) == 0)
    status = F.when(never, "REJECTED").when(none, "INSUFFICIENT_EVIDENCE").when(good, "SUPPORTED").otherwise("REJECTED")
    basis = F.when(never, "prohibited_decision").when(none, "provider_only_assertion").when(~good, "incomplete_evidence").when(F.col("n") > 1, "multiple_exact_evidence").otherwise("direct_exact_evidence")
    return j.select(*claims.columns, status.alias("support_status"), F.when(good, F.when(F.col("n") > 1, 0.98).otherwise(0.95)).alias("validated_confidence"), basis.alias("basis"), errors.alias("errors"))
