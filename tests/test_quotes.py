"""Labelled fields, merged readings and addresses, by values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.plans import quotes


def one(spark, text):
    found = quotes.fields_of(F.col("t"))
    return spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in found.items())).first().asDict()


def test_fields(spark):
    r = one(spark, "Коммерческое предложение\r\nTotal Price :  1 234,50 EUR\nDelivery time - up to 30 days\nWarranty: 24 months\nPackaging/Delivery: included\nInstallation: нет\nValid until: до 2024-05-01\nE-mail: X@Y.example")
    assert (r["total_amount"], r["delivery_time_days"], r["warranty_months"], r["includes_delivery"], r["includes_installation"], r["valid_until"]) == (1234.5, 30, 24, True, False, "2024-05-01")
    assert (r["currency_code"], r["contact_email"], r["payment_terms"], r["vat_rate"]) == ("EUR", "x@y.example", None, None)
    assert one(spark, "Итого: \nСумма: 5")["total_amount"] == 5.0 and one(spark, "")["currency_code"] == "RUB"
    assert all(v is None for k, v in one(spark, None).items() if k != "currency_code")


def test_merge(spark):
    cols = "id int, a_x string, a_line_items array<int>, a_review array<string>, a_warnings array<string>, a_status string, a_confidence double, a_mode string, b_x string, b_line_items array<int>, b_review array<string>, b_warnings array<string>, b_status string, b_confidence double, b_mode string"
    rows = [
        (1, "", [], ["q"], ["w"], "partial", 0.5, "deterministic", "b", [7], ["p", "q"], ["v", "w"], "parsed", 0.8, "llm"),
        (2, None, [], [], [], "parsed", 0.95, "deterministic", "b", [7], ["p"], ["v"], "parsed", 0.99, "llm"),
        (3, "a", [1], [], [], "partial", 0.9, "llm_only", "b", [7], [], [], "failed", 0.3, "llm"),
        (4, None, [], ["r"], [], "failed", 0.1, "deterministic", None, None, None, None, None, None, None),
    ]
    got = {r.id: tuple(r)[1:] for r in quotes.merged(spark.createDataFrame(rows, cols), ("x",)).collect()}
    assert got == {
        1: ("b", [7], ["p", "q"], ["w", "v"], "parsed", 0.8, "hybrid"),
        2: (None, [], [], [], "parsed", 0.95, "deterministic"),
        3: ("a", [1], [], [], "partial", 0.9, "llm"),
        4: (None, [], ["r"], [], "failed", 0.1, "deterministic"),
    }


def test_addresses(spark):
    cases = {" HTTPS://A.example/x/?utm_source=1&b=2&A=1#f ": "https://a.example/x/?a=1&b=2", "https://a.example/x///": "https://a.example/x", "https://a.example//x": "https:/a.example/x", "https://a.example/?ref=1": "https://a.example", "a?q&ref": "a?q&ref", "": "", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select(quotes.dedup_url(F.col("u"))).collect()
    assert [r[0] for r in got] == list(cases.values())
