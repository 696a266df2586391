"""Literal cases of extraction, checks, resolution and state."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.operators import checks, classify, documents, fields, fleet, grid, payments, resolve, sheets
from docloom.sources import files
from docloom.streaming import status


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "said", "value"),
    [
        ("numero_facture", "Numéro Facture : FAC-2024-00142", "FAC-2024-00142"),
        ("montant_ht", "Montant HT : 5 950.000 DT", "5 950.000"),
        ("tva", "TVA (19%) : 1 130.500 DT", "1 130.500"),
        ("tva", "TVA: 1314124ZAM000", None),
        ("montant_ttc", "Montant TTC : 7 080.500 DT", "7 080.500"),
        ("echeance", "15/04/2024 Date Echeance", "15/04/2024"),
        ("date", "Date Échéance : 15/04/2024", None),
        ("date", "Date Échéance : 15/04/2024\nDate : 01/04/2024", "01/04/2024"),
        ("fournisseur", "Fournisseur : Acier Tunisie SARL, Tunis 12", "Acier Tunisie SARL"),
        ("fournisseur", "Fournisseur : TVA 19", None),
        ("numero_facture", "rien", None),
    ],
)
def test_fields(spark, name, said, value):
    assert one(spark, fields.field(F.lit(said), name)) == value


def test_zones(spark):
    assert [one(spark, fields.zone_of_line(F.lit(t), F.lit(t), F.lit(100.0))) for t in (29.0, 30.0, 75.0)] == ["header", "body", "footer"]
    got = one(spark, fields.body_line(F.lit("ABC1234 | Tube acier | 3 | 10,5 | 31,5")))
    assert (got.reference, got.designation, got.quantity, got.price, got.total) == ("ABC1234", "Tube acier", 3.0, 10.5, 31.5)


def test_roles(spark):
    assert one(spark, fields.roles(F.lit("Total HT : 100,00 TVA : 19,00\nNet à payer 119,00"), "amount")) == {"montant_ht": "100,00", "montant_tva": "19,00", "montant_ttc": "119,00"}
    assert one(spark, fields.roles(F.lit("Date 01/02/2024 échéance 01/03/2024"), "date")) == {"date": "01/02/2024", "echeance": "01/03/2024"}


def test_confidence(spark):
    got = one(spark, fields.most_confident(F.lit("ref 12 et ref 1234567"), [r"ref (\d+)"], "number"))
    assert (got.value, got.confidence) == ("12", 0.99)  # the earliest of equals
    assert one(spark, fields.most_confident(F.lit("x"), [r"ref (\d+)"])) is None


def test_classes(spark):
    assert one(spark, classify.by_patterns(F.lit("facture de vente"))) == "facture_vente"
    assert tuple(one(spark, classify.cheque_or_draft(F.lit("chèque et traite")))) == ("inconnu", 0.0)
    assert one(spark, classify.text_quality(F.lit("quatre mots sont là"), F.lit(0))) == "too few words"
    assert one(spark, classify.text_quality(F.lit("un texte de bonne qualité ici"), F.lit(30))) == "low score"
    assert [one(spark, classify.band(F.lit(x))) for x in (80, 60, 59)] == ["green", "orange", "red"]


@pytest.mark.parametrize(
    ("said", "kind"),
    [("acture n 12, montant ttc", "facture"), ("Bon de commande", "bon_commande"), ("chque, rib", "cheque"), ("BL N° 4, bordereau", "bon_livraison"), ("فاتورة", "facture"), ("rien", "inconnu")],
)
def test_substring_classes(spark, said, kind):
    assert one(spark, classify.by_substrings(F.lit(said))) == kind


@pytest.mark.parametrize(
    ("said", "kind"),
    [("Fiche nomenclature, composants", "nomenclature"), ("Fiche article : A1", "fiche_article"), ("B.L. 12 livraison", "bon_livraison"), ("Purchase order", "bon_commande"), ("Proforma", "devis"), ("facture et devis", "facture"), ("chèque", None)],
)
def test_types_that_are_no_payment(spark, said, kind):
    assert one(spark, classify.other_type(F.lit(said))) == kind


@pytest.mark.parametrize(
    ("said", "wanted", "duplicate", "drafts", "points", "result"),
    [
        ("Chèque N° 1234567", "cheque", True, 0, 0, (False, "duplicate", "cheque")),
        ("Facture N° 1, chèque", "cheque", False, 0, 0, (False, "other type", "facture")),
        ("Lettre de change", "cheque", False, 0, 0, (False, "words of a draft", "traite")),
        ("Payez contre ce chèque", "traite", False, 0, 0, (False, "words of a cheque", "cheque")),
        ("Chèque N° 1234567", "traite", False, 0, 0, (False, "is the other kind", "cheque")),
        ("illisible", "cheque", False, 2, 9, (False, "fields of a draft", "traite")),
        ("illisible", "cheque", False, 0, 2, (False, "no sign of a cheque", "inconnu")),
        ("illisible", "cheque", False, 1, 3, (True, "as wanted", "cheque")),
        ("illisible", "traite", False, 0, 0, (True, "as wanted", "traite")),
        ("Chèque barré", None, True, 0, 0, (True, "as found", "cheque")),
        ("Devis 3", None, False, 0, 0, (False, "other type", "devis")),
        ("illisible", None, False, 0, 0, (False, "unknown", "inconnu")),
    ],
)
def test_payment_gate(spark, said, wanted, duplicate, drafts, points, result):
    got = one(spark, classify.payment_gate(F.lit(said), F.lit(wanted).cast("string"), F.lit(duplicate), F.lit(drafts), F.lit(points)))
    assert tuple(got) == result


@pytest.mark.parametrize(
    ("said", "name", "fields", "result"),
    [("Fiche article A1", "a.pdf", 0, (True, "fiche_article")), ("Fiche article A1", "cheque_1.pdf", 0, (False, "cheque")), ("Code article 1, échéance 01/01/2024", "a.pdf", 2, (False, "traite")), ("Total TTC 5", "a", 0, (False, "facture")), ("Liste BOM 3", "a", 0, (False, "nomenclature")), ("repère 1, niveau 2", "a", 0, (False, "nomenclature")), ("net à payer", "a", 0, (False, "inconnu")), ("rien", "a", 1, (True, "fiche_article")), ("rien", "a", 0, (False, "inconnu"))],
)
def test_item_gate(spark, said, name, fields, result):
    assert tuple(one(spark, classify.item_gate(F.lit(said), F.lit(name), F.lit(fields)))) == result


@pytest.mark.parametrize(
    ("said", "second", "result"),
    [("Nomenclature, facture", None, (True, "nomenclature")), ("facture de composant", None, (False, "facture")), ("taux de perte 3", None, (True, "nomenclature")), ("sku 1, part no 2", None, (False, "fiche_article")), ("flou", "bom 3", (True, "nomenclature")), ("flou", None, (False, "inconnu"))],
)
def test_bill_gate(spark, said, second, result):
    assert tuple(one(spark, classify.bill_gate(F.lit(said), F.lit(second).cast("string")))) == result


@pytest.mark.parametrize(
    ("said", "second", "result"),
    [("Facture N° 1, total TTC", None, (True, "facture")), ("Subtotal 5", None, (True, "facture")), ("Fiche article, facture", None, (False, "fiche_article")), ("Stock site, gestion lot, tva", None, (False, "fiche_article")), ("Devis N° 3, tva", None, (False, "devis")), ("flou", "net a payer", (True, "facture")), ("flou", None, (False, "inconnu"))],
)
def test_invoice_gate(spark, said, second, result):
    assert tuple(one(spark, classify.invoice_gate(F.lit(said), F.lit(second).cast("string")))) == result


@pytest.mark.parametrize(("width", "contrast", "sharpness", "score"), [(2000, 81.0, 501.0, 100), (1999, 80.0, 500.0, 55), (1199, 40.0, 100.0, 10)])
def test_image_quality(spark, width, contrast, sharpness, score):
    assert one(spark, classify.image_quality(F.lit(width), F.lit(contrast), F.lit(sharpness))) == score


@pytest.mark.parametrize(
    ("net", "tax", "gross", "want"),
    [(None, 19.0, 119.0, (100.0, 19.0)), (100.0, 19.0, 120.0, (100.0, 20.0)), (None, 95.0, 100.0, (None, None)), (100.0, None, 119.0, (100.0, 19.0)), (99.0, None, 100.0, (None, None)), (20.0, None, 100.0, (None, None)), (None, None, None, (None, None))],
)
def test_reconciliation(spark, net, tax, gross, want):
    r = checks.reconciled(spark.createDataFrame([(net, tax, gross)], "net double, tax double, gross double")).first()
    assert (r.net, r.tax) == want


def test_validation(spark):
    rows = [(1, "facture", {"numero_facture": "1", "date": "15.04.2024", "fournisseur": "x", "montant_ttc": "119,4", "montant_ht": "100", "montant_tva": "19"}), (2, "facture", {"montant_ttc": "119.6", "montant_ht": "100", "montant_tva": "19"}), (3, None, {})]
    got = {r.id: r for r in checks.validated(spark.createDataFrame(rows, "id int, doc_type string, fields map<string,string>")).collect()}
    assert [e.code for e in got[1].errors] == ["FORMAT_DATE_INVALIDE"]
    assert [e.code for e in got[2].errors] == ["CHAMP_MANQUANT"] * 3 + ["INCOHERENCE_MONTANTS"]
    assert got[3].status == "valide"
    assert one(spark, checks.date_format(F.lit("15-04-2024"))) == "15/04/2024"
    assert [one(spark, checks.final_status(F.lit(n))) for n in (2, 3)] == [V.TO_CHECK, V.VALID]


def test_compatibility(spark):
    def score(field, a, b):
        r = one(spark, resolve.compatible(F.lit(field), F.lit(a), F.lit(b)))
        return r.compatible, round(r.score, 2)

    assert [score("montant_ttc", "100", x) for x in ("100.01", "104", "120")] == [(True, 1.0), (True, 0.8), (False, 0.1)]
    assert score("date", "15/04/2024", "15/04/2023") == (True, 0.85)
    assert score("fournisseur", "Acier Tunisie", "acier tunisie sarl") == (True, 0.8)
    assert score("fournisseur", "x", "") == (True, 1.0)


def test_candidates(spark):
    mapping = spark.createDataFrame([("facture", k, f, f) for k, f in enumerate(["numero_facture", "date", "fournisseur", "montant_ttc"])], "doc_type string, ord int, field string, name string")
    good = {"numero_facture": "FAC-1", "date": "01/02/2024", "fournisseur": "Acier"}
    cand = spark.createDataFrame([(1, "a", 0.9, "facture", "FAC-1 01/02/2024 Acier", good), (1, "b", 0.8, "facture", "FAC-1", {"numero_facture": "FAC-1"}), (2, "c", 0.8, "facture", "rien", {"numero_facture": "??"})], "form_id int, candidate_id string, confidence double, doc_type string, text string, fields map<string,string>")
    forms = spark.createDataFrame([(1, {"numero_facture": "FAC-1"}), (2, {"numero_facture": "Z9"})], "form_id int, values map<string,string>")
    got = {r.form_id: r for r in resolve.best_candidate(cand, mapping, forms).collect()}
    assert got[1].candidate_id == "a" and got[1].ratio == 0.75
    assert got[2].candidate_id is None and got[2].blocking_field == "numero_facture"


def test_items(spark):
    items = spark.createDataFrame([("I1", "Tube acier 20", "SP1"), ("I2", "Vis inox", "SP2")], "id string, item_name string, supplier_part_no string")
    lines = spark.createDataFrame([(1, "SP2", "?"), (2, "x", "Tube acier 20"), (3, "x", "acier tube 20mm"), (4, None, "autre")], "line_id int, reference string, name string")
    assert {r.line_id: r.item for r in resolve.item_match(lines, items).collect()} == {1: "I2", 2: "I1", 3: "I1", 4: None}
    codes = spark.createDataFrame([("ACP00011",), ("X",)], "code string")
    assert {r.code: r.resolved for r in resolve.zero_padding(codes, spark.createDataFrame([("ACP0011",), ("ACP011",)], "item_code string")).collect()} == {"ACP00011": "ACP0011", "X": None}


def test_state(spark):
    assert one(spark, documents.status_of(F.lit("Approved"), F.lit(0))) == V.VALID
    assert one(spark, documents.status_of(F.lit(None).cast("string"), F.lit(2))) == V.REJECTED
    assert one(spark, documents.guarded_status(F.lit(V.VALID), F.lit(V.PENDING))) == V.VALID


def test_links(spark):
    docs = spark.createDataFrame([("d1", "PI", "e1", {}), ("d2", None, None, {"n": "77"})], "name string, linked_doctype string, linked_docname string, fields map<string,string>")
    entries = spark.createDataFrame([("PI", "e1", "76"), ("PI", "e2", "77")], "doctype string, entry string, bill_no string")
    assert {(r.name, r.entry, r.by_number) for r in documents.linked(docs, entries).collect()} == {("d1", "e1", False), ("d2", "e2", True)}


def test_availability(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    cars = spark.createDataFrame([("a", "1", "x", "y", "Disponible"), ("b", "2", "x", "y", "Disponible"), ("c", "3", "x", "y", "En maintenance")], "name string, plate string, make string, model string, status string")
    booked = spark.createDataFrame([("r1", "a", at(12), at(13), "Confirmée"), ("r2", "b", at(10), at(12), "Terminée"), ("r3", None, at(10), at(12), "Confirmée")], "name string, vehicle string, start timestamp, end timestamp, status string")
    got = fleet.available(cars, booked, F.lit(at(10)), F.lit(at(12)))
    assert [r.name for r in got.collect()] == ["a", "b"]
    assert [r.name for r in fleet.available(cars, booked, F.lit(at(11)), F.lit(at(13)), limit_first=True, n=1).collect()] == []


def told(spark, column):
    return {k: v.value for k, v in one(spark, column).items()}


def test_bill_head(spark):
    said = "Article  0004 — Châssis Soudé\nBOM-0002-001\nGamme (Routing) RT-CHASSIS-001\nSociété : Groupe Alpha est actif Oui\nQuantité produite 2,5\nUDM de l'article : pcs\nDevise : TND\nPrix basé sur dernier achat\nTransfert matériel ordre de fabrication\nTaux de change 3,2\nTaux de perte processus 4 %\nCoût total : 1.234,5\nPar défaut"
    got = told(spark, sheets.bill_head(F.lit(said)))
    assert got == {"name": "BOM-0002-001", "item": "0004", "item_name": "Châssis Soudé", "routing": "RT-CHASSIS-001", "company": "Groupe Alpha", "quantity": "2.5", "uom": "Unité", "currency": "TND", "rm_cost_as_per": "Last Purchase Rate", "transfer_material_against": "Work Order", "conversion_rate": "3.2", "scrap_percentage": "4.0", "total_cost": "1234.5", "is_active": "1", "is_default": "1"}
    assert one(spark, sheets.bill_head(F.lit("devise NOM, EUR"))) ["currency"].confidence == 0.65


def test_item_labels(spark):
    said = "Article : ACP0011\nDésignation : Embout gauche\nPoids de l'US : 1,250\nUnité de stock : pcs\nCode EAN : 61912345678\nStock sécurité : 5\nGestion lot : Non géré, Gestion série : Sortie\nImmobilisable\nGestion emplacement : Oui\nGarantie en mois : 24\nCoefficient UA-US : 1.5\nCatégorie ABC : Classe A"
    got = told(spark, sheets.by_labels(F.lit(said), sheets.ITEM_LABELS))
    assert got == {"item_code": "ACP0011", "description": "Embout gauche", "weight_per_unit": "1.25", "stock_uom": "Unité", "barcode": "61912345678", "safety_stock": "5.0", "custom_gestion_lot_mode": "Non géré", "custom_gestion_serie_mode": "Sortie", "custom_immobilisable": "1", "custom_gestion_emplacement": "1", "warranty_period": "24", "custom_coef_ua_us": "1.5", "custom_categorie_abc": "Classe A"}
    assert len({n for n, *_ in sheets.ITEM_LABELS}) > 120
    assert told(spark, sheets.basic_item(F.lit("Réf. : A-12\nPrix : 12,5\nMarque : Bêta"))) == {"item_code": "A-12", "standard_rate": "12.5", "brand": "Bêta"}


@pytest.mark.parametrize(
    ("said", "group"),
    [
        ("Catégorie : CONS", ("Consommables", 0.88)), ("Catégorie : ZZ9", ("ZZ9", 0.8)), ("Groupe d'article *\nPeintures  x", ("Peintures", 0.9)), ("Item Group : Peintures (bleu)", ("Peintures", 0.85)),
        ("fournitures de bureau et mobilier", ("Fournitures de bureau", 0.75)), ("une perceuse", ("Outillage", 0.65)), ("Fiche technique : perceuse", None), ("rien", None),
    ],
)
def test_item_group(spark, said, group):
    got = one(spark, sheets.item_group(F.lit(said)))
    assert (None if got is None else tuple(got)) == group


def test_sites(spark):
    sites = one(spark, sheets.site_blocks(F.lit("x\nStock site : A1\nStock sécurité : 5\nStock site : B2\nSeuil réappro : 7")))
    assert [(s.code, s.safety_stock, s.reorder_level) for s in sites] == [("A1", 5.0, None), ("B2", None, 7.0)]


def test_payments(spark):
    assert one(spark, payments.cheque_number(F.lit("90001420"))) == "00001420"
    said = "Lettre de change N° T-2024-001\nDate d'émission : 01/01/2024\nÀ 90 jours\nMontant : 1 500,000 DT\nTireur : Acier Tunisie SARL\nBon pour accord"
    r = payments.drafts(spark.createDataFrame([(1, said)], "doc_id int, text string"), F.lit("2024-06-01").cast("date")).first()
    assert (r.amount, r.emitted, r.due, r.drawer, r.accepted) == (1500.0, datetime.date(2024, 1, 1), datetime.date(2024, 3, 31), "Acier Tunisie SARL", True)


def workbook(rows):
    out = io.BytesIO()
    cells = "".join(f"<row>{''.join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row))}</row>" for r, row in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="BOM"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Code article", "Quantité", "Désignation"], ["P1", "2", "Tube"], ["P2", "3,5", "Vis"], ["Total", "", ""]]))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.bin").write_bytes(b"%PDF" + b" " * 3000)
    found = files.binary_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.refused) for r in files.intake(found).collect()}
    assert got == {"a.xlsx": ("xlsx", "too small"), "b.xlsx": ("xlsx", "too small"), "c.bin": ("pdf", None)}
    cells = files.cells(found.where("path like '%.xlsx'"))
    names = spark.createDataFrame([("Code article", "item_code"), ("Quantité", "qty"), ("Désignation", "item_name")], "heading string, field string")
    rows = grid.component_defaults(grid.table_rows(cells, grid.header_row(cells, names, ["item_code", "qty", "item_name"]), "item_code")).orderBy("r").collect()
    assert [(r.item_code, r.item_name, r.qty) for r in rows] == [("P1", "Tube", 2.0), ("P2", "Vis", 3.5)]
    assert files.unseen(found, found.select(F.md5("content").alias("file_hash")).limit(1)).count() == 2


def test_status_stream(spark, tmp_path):
    rows = [("a", V.VALID, 1), ("a", V.PENDING, 2), ("b", V.PENDING, 1), ("b", V.REJECTED, 2)]
    spark.createDataFrame(rows, "name string, status string, at int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("name string, status string, at int").parquet(f"{tmp_path}/in")
    q = status.guarded(stream).writeStream.format("memory").queryName("guarded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("guarded").collect()} == {("a", V.VALID, True), ("a", V.VALID, False), ("b", V.PENDING, True), ("b", V.REJECTED, True)}
    seen = []
    status.upserts(stream, lambda df, n: seen.append((n, df.count())), f"{tmp_path}/d").awaitTermination(60)
    assert seen == [(0, 4)]


def test_entry_has_sql_for_every_query():
    from docloom import queries

    assert set(queries.oracle_sql()) == set(queries.queries())


def test_forms(spark):
    from docloom.operators import forms

    assert [one(spark, forms.client_amount(F.lit(x))) for x in ("(12,5)", "1.438", "12.438", "5 950,00 DT")] == [-12.5, 1438.0, 12.438, 5950.0]
    assert one(spark, forms.may_save(F.array(F.struct(F.lit("x").alias("value"), F.lit(False).alias("resolved"))))) is False
    assert one(spark, forms.item_value(F.lit("text"), F.lit("OLD"), F.lit("NEW"), F.lit(True))) == "OLD"
    assert one(spark, forms.item_value(F.lit("number"), F.lit("0"), F.lit("0"), F.lit(False))) is None
    docs = spark.createDataFrame([("d1", None, None)], "name string, linked_doctype string, linked_docname string")
    saved = spark.createDataFrame([("d1", "PI", "e1")], "name string, doctype string, entry string")
    assert forms.linked_back(docs, saved).first().linked_docname == "e1"
    master = spark.createDataFrame([("Alpha SARL",), ("Alpha SA",), ("Beta",)], "id string")
    df = spark.createDataFrame([("Beta",), ("alpha sa",), ("alp",), ("zzz",), (None,)], "value string")
    assert {r.value: r.resolved for r in forms.link_value(df, master).collect()} == {"Beta": "Beta", "alpha sa": "Alpha SA", "alp": "Alpha SA", "zzz": None, None: None}
    assert [one(spark, forms.item_amount(F.lit(x))) for x in ("1.234,5", "1,234.5", "12,5 DT")] == [1234.5, 1234.5, 12.5]
    assert [one(spark, forms.bill_amount(F.lit(x))) for x in ("12,5 kg", "x")] == [12.5, 0.0]
    assert one(spark, forms.missing_on_item(F.create_map(F.lit("item_code"), F.lit("A")), ["item_code", "item_name", "item_group", "stock_uom"], "item_group")) == ["item_name", "stock_uom"]
    assert one(spark, forms.field_confidence(F.lit("date"), F.lit("01/02/2024"), F.lit("le 01/02/2024"))) == 0.8


@pytest.mark.parametrize(
    ("said", "number"),
    [("Facture N° : FAC-2024-01", "FAC-2024-01"), ("N° facture : A/12", "A/12"), ("Facture N° 812", "812"), ("N° 2024 et N° 77", None), ("N° : 77", "77"), ("FACT 2024001", "2024001"), ("rien", None)],
)
def test_invoice_number(spark, said, number):
    from docloom.operators import forms

    assert one(spark, forms.invoice_number(F.lit(said))) == number


@pytest.mark.parametrize(
    ("said", "name"),
    [("Facture\nAlpha Métal SARL rue 3\nTotal", "Alpha Métal SARL"), ("Facture\n12 rue X\nBeta Négoce\nDésignation\nx", "Beta Négoce"), ("Désignation\nTRUC", None), ("Tel 71\nDésignation", None), ("  \n", None)],
)
def test_supplier(spark, said, name):
    from docloom.operators import forms

    assert one(spark, forms.supplier(F.split(F.lit(said), "\n"))) == name


def test_known_supplier(spark):
    from docloom.operators import forms

    master = spark.createDataFrame([("Gamma Industrie", 1), ("Delta Chimie", 0), ("Ab", 2)], "name string, ord int")
    docs = spark.createDataFrame([(1, "Facture\nGAMMA INDUSTRIE et Delta Chimie"), (2, "Delta Chimle\nx"), (3, "Alpha SARL"), (4, "")], "doc_id int, text string")
    assert {r.doc_id: r.supplier for r in forms.known_supplier(docs, master).collect()} == {1: "Delta Chimie", 2: "Delta Chimie", 3: "Alpha SARL", 4: None}


@pytest.mark.parametrize(
    ("said", "field", "name"),
    [
        ("Acier Tunisie SARL", "tireur", "Acier Tunisie SARL"), ("signature", "tireur", None), ("Bon pour aval", "tireur", None), ("Acier (Tunis)", "tireur", None), ("A 12345 B", "tireur", None), ("- - A1 - . .", "tireur", None), ("ab cd ef gh", "tireur", None),
        ("aCieR tUnIs", "tireur", None), ("aCieR tUnIs", "titulaire_compte", "aCieR tUnIs"), ("OT OLEO TECHNO", "tireur", "OLEO TECHNO"), ("Acier x Tunisie", "beneficiaire", "Acier Tunisie"), ("agence BIAT Tunis", "tire", "BIAT"), ("xy", "tire", None), ("x" * 81, "tireur", None),
    ],
)
def test_parties(spark, said, field, name):
    assert one(spark, payments.plausible_party(F.lit(said), field)) == name
    assert [one(spark, payments.company_name(F.lit(x))) for x in ("Alpha", "TVA 19", "12 34", "ab", None)] == [True, False, False, False, False]


def test_draft_days(spark):
    from docloom.functions import dates

    day, as_of = datetime.date, F.lit("2024-06-01").cast("date")
    said = F.lit("Emission 01/01/2024 puis 15/03/2024 échéance\n01/01/2024")
    assert one(spark, dates.nearest_to(said, "[eé]ch[eé]ance", as_of)) == day(2024, 3, 15)
    assert one(spark, dates.nearest_to(said, "livraison", as_of)) is None
    assert one(spark, dates.voted(said, as_of)) == day(2024, 1, 1)
    fixed = lambda d: tuple(one(spark, dates.repair_year(F.lit(d).cast("date"), as_of, "traite")))
    assert fixed("2025-01-01") == (day(2025, 1, 1), False)
    assert fixed("2026-07-01") == (day(2024, 7, 1), True)
    assert fixed("2028-07-01")[1] is True
    assert fixed("2035-01-01") == (day(2035, 1, 1), False)


def test_amounts_of_forms(spark):
    assert one(spark, checks.net_amount(F.lit(0.0), F.lit(119.0), F.lit(19.0))) == 100.0
    assert one(spark, checks.net_amount(F.lit(0.0), F.lit(1.1), F.lit(0.1))) == 1.0
    assert one(spark, checks.net_amount(F.lit(None).cast("double"), F.lit(-5.0), F.lit(1.0))) == 0.0
    assert tuple(one(spark, checks.derived_on_form(F.lit(0.0), F.lit(19.0), F.lit(119.0)))) == (100.0, 19.0)
    assert tuple(one(spark, checks.matched_share(F.lit(1), F.lit(3)))) == (33, True)
    assert tuple(one(spark, checks.matched_share(F.lit(0), F.lit(0), F.lit(55.5)))) == (55, True)
    cases = [("Currency", "1.234,50", "1234.5"), ("Int", "12,00", "12"), ("Date", "05/04/2024", "2024-04-05"), ("Check", "Oui", "1"), ("Data", " x ", "x"), ("Int", "abc", None)]
    assert [one(spark, checks.coerced(F.lit(k), F.lit(v))) for k, v, _ in cases] == [w for *_, w in cases]


@pytest.mark.parametrize(("said", "method"), [("Chéque", "cheque"), ("check", "cheque"), ("Draft", "traite"), ("effet", "traite"), ("virement", None)])
def test_payment_methods(spark, said, method):
    from docloom.functions import text

    assert one(spark, text.payment_method(F.lit(said))) == method
    assert [one(spark, text.unit(F.lit(x), p)) for x, p in (("Boîte", "item"), ("zz", "item"), ("zz", "bom"), ("Zz long", "bom"), (" Zz", "sheet"), ("pcs.", "item"))] == ["Box", "", "ZZ", "Zz long", "Zz", "Unité"]


def test_one_word_common_to_all_names(spark):
    """Names that share a word are told apart by the rest; texts without it meet none."""
    names = spark.createDataFrame([(f"CUSTOMER {k:09d}",) for k in range(200)] + [("Acier Tunisie",)], "name string")
    docs = spark.createDataFrame([(k, f"Vendu à : Customer {k:09d}") for k in range(40)] + [(900, "customer 0000001I7"), (901, "acier de Tunisie"), (902, "rien du tout"), (903, "")], "doc_id int, text string")
    got = {r.doc_id: r.party for r in resolve.party_match(docs, names).collect()}
    assert {k: got[k] for k in range(40)} == {k: f"CUSTOMER {k:09d}" for k in range(40)}
    assert got[900].startswith("CUSTOMER") and got[901] == "Acier Tunisie" and 902 not in got and 903 not in got


def brute_party(text, names):
    import re

    from docloom.functions.fuzzy import token_set_ratio

    said = " ".join(re.sub(r"[^A-Za-zÀ-ÿ0-9 ]", " ", text).upper().split())
    tokens, best = [t for t in said.split() if len(t) >= 3], None
    for n in names:
        up, alpha = n.upper(), re.sub(r"[^A-ZÀ-Ü0-9]", "", n.upper())
        cover = max([len(t) / len(alpha) * 100 for t in tokens if t in up or t in alpha], default=0.0)
        alike = token_set_ratio(said, up)
        if cover > 0 and (cover >= 30 or alike >= 60):
            best = max(best or (0, ""), (cover * 0.7 + alike * 0.3, n, cover, alike))
    return best[1] if best and (best[2] >= 40 or best[3] >= 70) else None


def test_parties_by_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(resolve, "COMMON", 4)
    rng = random.Random(3)
    parts = ["ALPHA", "BETA", "METAL", "ACIER", "SARL", "TUNISIE", "NEGOCE", "SUD", "INDUSTRIE", "TRANS"]
    names = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(60)})
    docs = [(k, " ".join(rng.choice(["acier", "Alpha", "metal", "sud", "tunis", "METALSUD", "nego", "beta", "ind", "facture", "sarl"]) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    got = {r.doc_id: r.party for r in resolve.party_match(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {k: w for k, t in docs if (w := brute_party(t, names)) is not None}
