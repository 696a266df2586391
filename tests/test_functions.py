"""Literal cases of text, number and date functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import dates, fuzzy, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("profile", "said", "value"),
    [
        ("nlp", "5 950,00 TND", 5950.0),
        ("payment", "2.520,000", 2520.0),
        ("payment", "5 950,00 DT", 5950.0),
        ("payment", "250.500", 250.5),
        ("payment", "1250.500", 1250500.0),
        ("payment", "234,567", 234567.0),
        ("payment", "12,3456", 12.456),
        ("payment", "-5", 5.0),
        ("payment", "", None),
        ("typed", "2.520,000", 2520.0),
        ("cell", "1729.486", 1729.486),
        ("cell", "1 729,486", 1729.486),
        ("cell", "1,729.486", 1729.486),
        ("cell", "12 kg", None),
        ("cell", "19%", None),
        ("pipeline", "1 130.500 DT", 1130.5),
        ("bom", "1.234,5", 1234.5),
        ("price", "0.05", None),
        ("extractor", "1.234,56", 0.0),
        ("api", "abc", 0.0),
    ],
)
def test_amounts(spark, profile, said, value):
    assert one(spark, numbers.amount(F.lit(said), profile)) == value


def test_payment_without_quirks(spark):
    assert one(spark, numbers.amount_payment(F.lit("1 234,567"), False)) == 1234.567


def test_matcher_amount_is_text(spark):
    assert one(spark, numbers.amount_matcher(F.lit("5 950,00"))) == "5950.0"


@pytest.mark.parametrize(("said", "inside", "most"), [("1,413.22", [1413.22], 1413.22), ("1 452,509", [1452509.0, 1452.509], 1452509.0), ("1.438,128", [1438128.0], 1438128.0)])
def test_scanned_amounts(spark, said, inside, most):
    got = one(spark, numbers.scan_amounts(F.lit(said)))
    assert set(inside) <= set(got) and max(got) == most and len(got) == len(set(got))


@pytest.mark.parametrize(
    ("said", "floor", "flush", "value"),
    [
        ("la somme de mille sept cent vingt-neuf dinars et quatre cent quatre-vingt-six millimes", 100, False, 1729.486),
        ("somme de cinquante dinars", 100, False, None),
        ("somme de cinquante dinars", 10, False, 50.0),
        ("somme de deux cent mille dinars", 100, False, 200000.0),
        ("somme de deux cent mille dinars", 100, True, 1200.0),
        ("rien", 10, False, None),
    ],
)
def test_amounts_in_words(spark, said, floor, flush, value):
    assert one(spark, numbers.amount_in_words(F.lit(said), float(floor), flush)) == value


@pytest.mark.parametrize(("said", "value"), [("mille sept cent vingt-neuf", 1729), ("quatre-vingt-six", 86), ("soixante-dix", 70), ("deux millions trois", 2000003), ("", None)])
def test_words(spark, said, value):
    assert one(spark, numbers.words_to_number(F.lit(said))) == value


@pytest.mark.parametrize(("old", "new", "want"), [("100", 1999.0, False), ("100", 2000.0, True), (None, 5.0, True), ("x", 5.0, True), ("100", 0.0, False), ("100", None, False)])
def test_replacement(spark, old, new, want):
    assert one(spark, numbers.replaces(F.lit(old).cast("string"), F.lit(new).cast("double"))) is want


def test_text(spark):
    assert one(spark, text.field_key(F.lit("Numéro Facture"))) == "numero_facture"
    assert one(spark, text.fold(F.lit("ÉÈÀÇ Žluť"))) == "eeac zlut"
    assert one(spark, text.squeeze(F.lit(" a   b\n"))) == "a b"
    assert one(spark, text.part_code(F.lit("vVIS012"))) == "VIS012"
    assert one(spark, text.repair_codes(F.lit("ACIOO1 FOO"))) == "ACI001 FOO"
    assert one(spark, text.file_variants(F.lit("facture_a1b2c3d4.pdf"))) == ["facture_a1b2c3d4.pdf", "facture.pdf", "facture_a1b2c3d4", "facture"]
    assert [one(spark, text.unit(F.lit("xyz"), p)) for p in ("item", "bom", "sheet")] == ["", "XYZ", "xyz"]
    assert one(spark, text.payment_method(F.lit("Lettre de change"))) == "traite"
    assert one(spark, text.payment_method(F.lit("Virement"))) is None
    assert one(spark, text.account_number(F.lit("10 500 002 1234567 123 45"))) == "10 500 002 1234567 123 45"
    assert one(spark, text.item_code(F.lit("ACP0011. x"))) == "ACP0011"


@pytest.mark.parametrize(("said", "value"), [("05/04/2024", (2024, 4, 5)), ("5 avril 2024", (2024, 4, 5)), ("2024-04-05", (2024, 4, 5)), ("31/02/2024", None), ("05/04/85", (1985, 4, 5)), ("05/04/24", (2024, 4, 5)), ("", None), (None, None)])
def test_dates(spark, said, value):
    assert one(spark, dates.normalised(F.lit(said).cast("string"))) == (value and datetime.date(*value))


def test_date_rules(spark):
    day = lambda s: F.lit(s).cast("date")
    assert [one(spark, dates.stale_hard(day(d), day("2024-12-31"))) for d in ("2024-01-01", "2023-12-31")] == [False, True]
    assert [one(spark, dates.stale_on_save(day(d), day("2024-12-31"))) for d in ("2024-07-01", "2024-06-30")] == [False, True]
    assert one(spark, dates.due_after(F.lit("à 90 jours"), day("2024-01-01"))) == datetime.date(2024, 3, 31)
    got = one(spark, dates.repair_year(day("2029-05-01"), day("2024-06-01")))
    assert (got.date, got.corrected) == (datetime.date(2024, 5, 1), True)
    got = one(spark, dates.repair_year(day("2084-05-01"), day("2024-06-01")))
    assert (got.date, got.corrected) == (datetime.date(2084, 5, 1), False)
    both = one(spark, dates.reconcile_due(day("2024-03-20"), day("2024-03-01")))
    assert (both.emitted, both.due) == (datetime.date(2024, 3, 1), datetime.date(2024, 3, 20))
    assert one(spark, dates.scan(F.lit("du 01/02/2024 au 30 / 02 / 2024 et 3.4.2025"), day("2024-01-01"))) == [datetime.date(2024, 2, 1), datetime.date(2025, 4, 3)]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_similarity():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fuzzy.common(a, b) == slow_common(a, b)
    assert fuzzy.token_set_ratio("acier tunisie", "tunisie acier sarl") == 100.0
    assert fuzzy.token_sort_ratio("b a", "a b") == 100.0
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100.0
    assert fuzzy.ratio("", "") == 100.0 and fuzzy.token_set_ratio("", "a") == 0.0
