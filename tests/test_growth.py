"""Work that must not grow faster than its input: plans, partitions and pairs, and results on keys as larger tables have them."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom import queries
from docloom.operators import grid
from docloom.sources import tables

DATA = Path("/root/testdata/sf0.001")
data = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@data
def test_words_travel_once_to_their_page(spark):
    said = plan(queries.queries()["box_table"](spark, str(DATA)))
    assert said.count("Exchange") == 1 and "REPARTITION_BY_NUM" in said and "Join" not in said


def test_equal_stretches_are_one(spark):
    rows = spark.createDataFrame([(1, 0, 10, "a"), (1, 0, 10, "b"), (1, 20, 12, "c"), (1, 20, 12, "d"), (1, 40, 50, "e")], "page long, a long, z long, w string")
    got = grid.sessions(rows, ["page"], F.col("a"), F.col("z"), 4, "n")
    assert {r.w: r.n for r in got.collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}


def test_partitions_grow_with_the_rows(spark, tmp_path):
    spark.range(220_000).write.parquet(str(tmp_path / "t.parquet"))
    rows = tables.read(spark, str(tmp_path), "t")
    assert tables.spread(rows).rdd.getNumPartitions() == 5
    assert tables.together(rows, "id").rdd.getNumPartitions() == 5


@data
@pytest.mark.parametrize("name", ["gates", "class_rules"])
def test_texts_are_made_once(spark, name):
    said = plan(queries.queries()[name](spark, str(DATA)))
    assert said.count("vu par") <= 60


def test_short_numbers_are_no_accounts(spark):
    from docloom.operators import payments

    docs = spark.createDataFrame([(1, "Lettre\nOrdre de paiement\n10500004"), (2, "Lettre\nOrdre de paiement\n10500002123"), (3, "Lettre\nOrdre de paiement\n10499996")], "doc_id long, text string")
    got = {r.doc_id: r.number for r in payments.drafts(docs, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {1: "10500004", 2: None, 3: "10499996"}


def test_values_meet_only_names_that_begin_with_them(spark):
    from docloom.operators import forms

    master = spark.createDataFrame([(f"Customer#{n:03d}",) for n in range(60)] + [("customer#00",)], "id string")
    asked = spark.createDataFrame([(1, "customer#007"), (2, "Cus"), (3, "CUSTOMER#00"), (4, "x"), (5, None), (6, "Customer#009")], "k long, value string")
    got = forms.link_value(asked, master)
    assert "startswith" not in plan(got).lower()
    # the one that equals it but for case comes sixth or later in order, so it is not among the five
    assert {r.k: r.resolved for r in got.collect()} == {1: "Customer#007", 2: "Customer#000", 3: "Customer#000", 4: None, 5: None, 6: "Customer#009"}


def test_equal_requests_are_answered_once(spark, monkeypatch):
    from docloom.operators import fleet

    at = datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)
    asked = spark.createDataFrame([(n, at, at + 24 * hour, 1) for n in range(50)] + [(50, at + 48 * hour, at + 50 * hour, 1), (51, at, at + hour, None)], "request long, start timestamp, end timestamp, nation int")
    cars = spark.createDataFrame([(1, "a", "Disponible", 1), (2, "b", "Disponible", 1)], "name long, plate string, status string, nation int")
    booked = spark.createDataFrame([(9, 1, at + hour, at + 2 * hour, "Confirmée")], "name long, vehicle long, start timestamp, end timestamp, status string")
    met, overlaps = [], fleet.overlaps
    monkeypatch.setattr(fleet, "overlaps", lambda q, *a: met.append(q.count()) or overlaps(q, *a))
    got = {r.request: (r.n_free, r.plate) for r in fleet.available_for(asked, cars, booked, ["nation"]).collect()}
    assert met == [3]
    assert got == {n: (1, "b") for n in range(50)} | {50: (2, "a"), 51: (0, None)}


@data
def test_sites_are_read_without_joins(spark):
    assert "Join" not in plan(queries.queries()["site_workbook"](spark, str(DATA)))


def test_a_column_may_hold_several_fields(spark):
    cells = [(r, c, v) for r, row in enumerate([["Titre", "", ""], ["Code", "Nom site", "Stock"], ["A", "x", "1"], ["", "y", "2"]]) for c, v in enumerate(row)]
    sheet = spark.createDataFrame([("f", "s", *x) for x in cells] + [("g", "s", 0, 0, "nothing")], "file string, sheet string, r int, c int, v string")
    got = grid.site_table(sheet, [("code", ["site", "code"]), ("label", ["nom"])]).collect()
    # the first word counts before the first column: the site's column is the one of names
    assert [(r.file, r.r, r["values"]) for r in sorted(got, key=lambda r: r.r)] == [("f", 2, {"code": "x", "label": "x"}), ("f", 3, {"code": "y", "label": "y"})]


def test_names_are_filed_under_their_rarest_word(spark):
    from docloom.operators import forms

    master = spark.createDataFrame([(n, f"Supplier {n:05d}") for n in range(80)] + [(-1, "Acier du Sud"), (90, "Supplier"), (91, "Nord Metal")], "ord long, name string")
    docs = spark.createDataFrame([(1, "Vendeur supplier 00007\nTotal"), (2, "les Aciers\nacier du sudiste\n"), (3, "x supplier\n"), (4, "Nord Metall"), (5, "plomb")], "doc_id long, text string")
    got = forms.known_supplier(docs, master)
    assert "min_by(_word" in plan(got)
    known = {r.doc_id: r.supplier for r in got.collect()}
    assert {k: known[k] for k in (1, 2, 3, 4)} == {1: "Supplier 00007", 2: "Acier du Sud", 3: "Supplier", 4: "Nord Metal"}


@data
def test_few_names_bring_no_rows_together(spark):
    said = plan(queries.queries()["field_mapping"](spark, str(DATA)))
    assert "BroadcastHashJoin" in said and "SortMergeJoin" not in said


@data
@pytest.mark.parametrize("name", ["zero_padding", "field_mapping"])
def test_rows_that_give_many_are_dealt_out(spark, name):
    said = plan(queries.queries()[name](spark, str(DATA)))
    assert "RoundRobinPartitioning" in said and "REPARTITION_BY_NUM" in said


@data
def test_cells_of_a_file_lie_together(spark):
    assert plan(queries.queries()["grid_bom_components"](spark, str(DATA))).count("Exchange") == 1


def test_partitions_of_a_store_are_written_by_several_tasks(spark, tmp_path):
    from docloom.sources.store import DocumentStore

    store = DocumentStore(spark, str(tmp_path), 1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        store.create(spark.range(20_000).selectExpr("uuid() AS name", "concat('f', id, 'x.pdf') AS document_name", "'a' AS status"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "documents" / "part=0").glob("*.parquet"))) > 1 and store.documents().count() == 20_000


def test_values_by_role_are_those_of_the_patterns():
    import random

    from docloom.operators import roles

    rnd = random.Random(1)
    parts = ["SARL", "sa ", "visa", "GROUPE", "gie", "A", "é", "Metal 5", " ", "  ", "\n", ", ", "12/03/2024", "1.2.24", "2024-01-02", "12/3/202", "/5", "7", "_3/4/2024", "SAS", "snc ltd", "ſarl", "gıe", "GİE", "KSA"]
    for _ in range(2000):
        said = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        for profile in ("text", "sheet"):
            for kind in roles.KINDS:
                assert [[m.span() for m in some] for some in roles.matches(said, profile, kind)] == [[m.span() for m in p.finditer(said)] for p in roles._patterns(profile, kind)]
    # a text without a legal form is not tried at each of its letters
    assert not list(roles._before_legal("Commande CDE-2023-12 Fournisseur : Acier"))


def test_only_ways_whose_phrases_are_there_are_tried(monkeypatch):
    """a text costs the labels that it has, whatever fields are looked for; words of a list are found as labels are."""
    from docloom.functions import vocabulary as V
    from docloom.operators import fields, labels

    ways, tried = fields.ways(tuple(V.LABELS)), []
    matches = labels.Ways._matches
    monkeypatch.setattr(labels.Ways, "_matches", staticmethod(lambda *a: tried.append(1) or matches(*a)))
    plain = next(ways.found(["rien"], True))
    shapes = sum(not w.labels and w.value != "bank" for ws in V.LABELS.values() for w in ws)
    assert not any(plain) and len(tried) <= shapes
    # letters that patterns take for others are looked for everywhere
    names = list(V.LABELS)
    for text, bank in (("chez biat, Sfax", "biat"), ("ſtb", "ſtb"), ("xbiatx", None), ("Banque de\tTunisie", None), ("la SOCIÉTÉ TUNISIENNE DE BANQUE", "SOCIÉTÉ TUNISIENNE DE BANQUE")):
        found = dict(zip(names, next(ways.found([text], True)), strict=True))
        assert [v for k, v in found["tire"] if k == 1] == ([bank] if bank else []), text


def test_arrays_of_what_was_found():
    from docloom.operators import labels

    for rows in ([], [[]], [[(0, "a"), (1, None)], [], [(2, "é")]]):
        assert labels.listed(rows, labels._SPANS).to_pylist() == [[{"way": k, "value": v} for k, v in r] for r in rows]


def test_words_and_days_are_taken_apart_once(spark):
    """A name's words are folded once, a day's text is matched once; days are those that the format gave."""
    from pyspark.sql import functions as F

    from docloom.functions import dates
    from docloom.operators import fields

    assert fields.party_name(F.col("x"))._jc.toString().count("translate(") == 1
    assert dates.normalised(F.col("x"))._jc.toString().lower().count("regexp_extract(") == 1  # of a month's name
    grid = spark.sql("SELECT y, m, d FROM (SELECT explode(array(0, 1, 69, 99, 1899, 1900, 2023, 2024, 9999, 12345)) AS y) CROSS JOIN (SELECT id AS m FROM range(0, 14)) CROSS JOIN (SELECT id AS d FROM range(0, 33))")
    text = F.concat_ws("-", F.lpad(F.col("y").cast("string"), 4, "0"), F.lpad(F.col("m").cast("string"), 2, "0"), F.lpad(F.col("d").cast("string"), 2, "0"))
    assert grid.where(~dates.date_of(F.col("y"), F.col("m"), F.col("d")).eqNullSafe(F.try_to_date(text, "yyyy-MM-dd"))).count() == 0


def test_a_body_line_is_split_once(spark):
    """with the fields of the line taken one by one, as the query takes them."""
    from docloom.operators import fields

    rows = spark.createDataFrame([("AB1 | Tube acier | 3 | 10,5 | 1 200,75",), ("mot; 7",), ("",), (None,), ("AB-2\tx  5",)], "x string").select(fields.body_line(F.col("x")).alias("g")).select("g.reference", "g.designation", "g.quantity", "g.price", "g.total")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r) for r in rows.collect()] == [("AB1", "Tube acier", 3.0, 10.5, 1200.75), (None, "mot", None, None, 7.0), (None,) * 5, (None,) * 5, ("AB-2", "x", None, None, 5.0)]


def test_lines_of_totals_are_read_once(spark):
    from docloom.operators import sheets

    texts = ["TOTAL  H.T 1 000,5 DT\nT.V.A (19 %)\n 190,095 \nNET À PAYER\n\n1.190.595", "Total brut HT 5\nHORS TAXES 12 x 200\nBase TVA 100\nTVA 19,000\nTIMBRE 0,600", "articles 1 234,500\nfin 1 300,000", "FODEC 2,5\nTTC 300", "Tél 71 123,450", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sheets.totals(docs)
    assert {r.doc_id: (r.net, r.tax, r.gross) for r in got.collect()} == {0: (1000.5, 190.095, 190.095), 1: (200.0, 19.0, 119.6), 2: (1234500.0, 65500.0, 1300000.0), 3: (250.0, 50.0, 300.0), 4: (None, None, None), 5: (None, None, None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp") <= 30


def test_small_books_are_read_by_many_tasks(tmp_path):
    from docloom.sources import workbooks

    for n in range(1_200):
        (tmp_path / f"{n}.xlsx").write_bytes(b"x" * 2_000)
    parts = workbooks._Reader(str(tmp_path), list(workbooks._KINDS)).partitions()
    # 2,000 bytes and the opening of each: 345 books to 2 MB
    assert [len(p.files) for p in parts] == [345, 345, 345, 165]


def test_books_are_not_dealt_by_their_bytes(spark):
    from docloom.sources import workbooks

    cells = spark.range(100).select(F.col("id").cast("string").alias("file"), F.lit("s").alias("sheet"), F.lit(0).alias("place"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit("v").alias("v"))
    assert workbooks.sheets_together(cells).rdd.getNumPartitions() == 4
    assert workbooks.sheets_together(cells.repartition(3, "file"), dealt=True).rdd.getNumPartitions() == 3


def test_sheets_are_chosen_without_joins(spark):
    from docloom.sources import workbooks

    cells = spark.createDataFrame([("a", "Stock fiche", 0, 0, 0, "v"), ("a", "Site", 1, 0, 0, "v"), ("b", "x", 1, 0, 0, "v"), ("b", "Site", 2, 0, 0, "v"), ("b", None, 3, 0, 0, "v")], workbooks.SCHEMA)
    marked = workbooks.marked_sheets(cells)
    assert "Join" not in plan(marked) and plan(marked).count("Exchange") == 1
    # the first sheet named as a sites' one is the item's own: no other takes its place
    assert {(r.file, r.place): (r.is_item, r.is_site) for r in marked.collect()} == {("a", 0): (True, False), ("a", 1): (False, False), ("b", 1): (True, False), ("b", 2): (False, True), ("b", 3): (False, False)}


def test_cells_as_they_stand_in_xml():
    import io
    import zipfile

    from docloom.sources import workbooks

    sheet = '<c r="A1" t="inlineStr"><is><r><t>a&amp;</t></r><!-- no --><r><t xml:space="preserve"> b<!-- no -->c</t></r></is></c><c><f>1+1</f><v>2</v><v>3</v></c><c r="AB1"><v/></c><c r="AC1" t="str"><v>é</v><extLst><ext><v>no</v></ext></extLst></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData><row r="1">{sheet}</row><row><c><v>4</v></c></row><row r="9"><c><v>5</v></c></row><row r="x"><c><v>6</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData></sheetData></worksheet>')
    # a damaged sheet ends where it is damaged
    assert [x[2:] for x in workbooks.rows(out)] == [(0, 0, "a& bc"), (0, 1, "2"), (0, 28, "é"), (1, 0, "4"), (8, 0, "5")]


def test_rows_of_sheets_need_no_shuffle(spark, tmp_path):
    from docloom.sources import workbooks

    rows = [("a", "S", 0, 0, ["x", None, "z<", ""]), ("a", "S", 0, 7, ["1"]), ("a", "T", 1, 0, [None, "2\x01"]), ("b", "S", 0, 3, [None])]
    workbooks.write(spark.createDataFrame(rows, workbooks.ROWS), str(tmp_path / "o"))
    got = workbooks.read(spark, str(tmp_path / "o"), by_rows=True)
    assert "Exchange" not in plan(got)
    assert sorted((r.file[-6:-5], r.sheet, r.place, r.r, r.v) for r in got.collect()) == [("a", "S", 0, 0, ["x", None, "z<"]), ("a", "S", 0, 7, ["1"]), ("a", "T", 1, 0, [None, "2"])]
    assert workbooks.read(spark, str(tmp_path / "o")).where("sheet = 'S'").count() == 3


@pytest.fixture
def no_broadcasts(spark):
    """Joins as they are where both sides are large."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_parties_by_shuffled_joins(spark, no_broadcasts):
    from docloom.operators import resolve

    names = spark.createDataFrame([(f"CUSTOMER {k:09d}",) for k in range(200)] + [("Acier Tunisie",)], "name string")
    docs = spark.createDataFrame([(k, f"Vendu à : Customer {k:09d}") for k in range(40)] + [(900, "customer 0000001I7"), (901, "acier de Tunisie"), (902, "rien du tout"), (903, "")], "doc_id int, text string")
    got = [(r.doc_id, r.party) for r in resolve.party_match(docs, names).collect()]
    assert sorted(p for p in got if p[0] != 900) == [(k, f"CUSTOMER {k:09d}") for k in range(40)] + [(901, "Acier Tunisie")]
    assert [p[:8] for k, p in got if k == 900] == ["CUSTOMER"]


def test_names_by_stretches_that_begin_as_tokens_do(spark):
    from docloom.operators import resolve

    names = ["ANANAS ANANAS", "A.B-C ABC", "CUSTOMER 000000001", "ÉLAN & CO", "SA"]
    words = ["ANA", "NAN", "ANANAS", "ANANASANANAS", "ABC", "ABCABC", "BCA", "CUSTOMER", "000000001", "000", "R000", "ÉLANCO", "LAN", "XYZ", "CUSTOMERS"]
    rows = spark.createDataFrame([(n.lower(), n) for n in names], "party string, upper string")
    got = resolve.pieces(rows, spark.createDataFrame([(w,) for w in words], "token string")).select("upper", "token").collect()
    plain = {n: "".join(c for c in n if c.isalnum()) for n in names}
    assert sorted(map(tuple, got)) == sorted((n, w) for n in names for w in words if w in n or w in plain[n])
