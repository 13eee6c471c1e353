"""Planted true, altered and absent quotations."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from offerlens.operators import grounding

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_claims(spark):
    fragments = spark.createDataFrame([("k", "d1", "a.txt", "1", "The price is 100\n roubles, paid at once."), ("k", "d2", "b.txt", "1", "Delivery in ten days"), ("k", "d2", "b.txt", "1", "Delivery in ten days"), ("k", "d3", None, None, None)], "case string, document_id string, document_name string, chunk_id string, text string")
    packet = grounding.packet(fragments)
    ids = {r.document_id: r.fragment_id for r in packet.collect()}
    assert packet.count() == 3
    ref = lambda c, d, name, q, h=None, case="k", chunk="1": (c, case, ids.get(d, "none"), d, name, chunk, q, h or (sha(q) if q else None))
    refs = [
        ref("true", "d1", "a.txt", "price is 100\n roubles"), ref("two", "d1", "a.txt", "The price"), ref("two", "d2", "b.txt", "ten days"), ref("altered", "d1", "a.txt", "price is 200"), ref("hash", "d1", "a.txt", "price", "0"),
        ref("absent", "d9", "a.txt", "price"), ref("name", "d1", "x.txt", "price"), ref("case", "d1", "a.txt", "price", case="z"), ref("value", "d1", "a.txt", "price is 100"), ref("decision", "d1", "a.txt", "price"), ref("again", "d1", "a.txt", "price"), ref("nulls", "d3", None, None, chunk=None),
    ]
    rows = [
        ("true", 1, "price", "x", ["100 ROUBLES"]), ("two", 2, "price", "x", ["price", "ten  days", " "]), ("altered", 3, "price", "x", ["price"]), ("hash", 4, "price", "x", ["price"]), ("absent", 5, "price", "x", ["price"]), ("name", 6, "price", "x", ["price"]), ("case", 7, "price", "x", ["price"]),
        ("value", 8, "price", "x", ["101"]), ("decision", 9, "a/bid_decision", " go ", ["price"]), ("none", 10, "price", "x", ["price"]), ("again", 11, "price", "x", ["price"]), ("again", 12, "price", "x", ["price"]), ("nulls", 13, "price", "x", []),
    ]
    r = spark.createDataFrame(refs, "claim_id string, case string, fragment_id string, document_id string, document_name string, chunk_id string, quote string, quote_sha256 string")
    c = spark.createDataFrame(rows, "claim_id string, at int, field_path string, value string, values array<string>")
    got = {(x.claim_id, x.at): (x.support_status, x.validated_confidence, x.errors) for x in grounding.validated(c, grounding.checked_references(r, packet)).collect()}
    assert got == {
        ("true", 1): ("SUPPORTED", 0.95, []),
        ("two", 2): ("SUPPORTED", 0.98, []),
        ("altered", 3): ("REJECTED", None, ["reference_quote_not_found"]),
        ("hash", 4): ("REJECTED", None, ["reference_quote_hash_mismatch"]),
        ("absent", 5): ("REJECTED", None, ["reference_fragment_not_found"]),
        ("name", 6): ("REJECTED", None, ["reference_document_name_mismatch"]),
        ("case", 7): ("REJECTED", None, ["reference_procurement_case_mismatch"]),
        ("value", 8): ("REJECTED", None, ["claim_value_not_lexically_supported"]),
        ("decision", 9): ("REJECTED", None, ["provider_positive_decision_prohibited"]),
        ("none", 10): ("INSUFFICIENT_EVIDENCE", None, ["claim_has_no_evidence"]),
        ("again", 11): ("SUPPORTED", 0.95, []),
        ("again", 12): ("REJECTED", None, ["duplicate_claim_id"]),
        ("nulls", 13): ("REJECTED", None, ["reference_quote_not_found"]),
    }
    assert grounding.validated(c.limit(0), grounding.checked_references(r, packet)).count() == 0


def test_plain(spark):
    assert spark.createDataFrame([(" A  b\n\tC ",)], "s string").select(grounding.plain(F.col("s"))).first()[0] == "a b c"
