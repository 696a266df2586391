"""The label index, roles, workbooks, keyed state, joins by time and containment, merges, boxes and step counts: literal cases and brute force."""

import datetime
import io
import os
import random
import re
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as V
from docloom.operators import classify, contains, documents, fields, fleet, grid, labels, payments, roles, sheets
from docloom.plans import worker
from docloom.plans.steps import StepListener, Steps, listening
from docloom.sources import workbooks
from docloom.sources.store import PART, DocumentStore
from docloom.streaming import intake


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# labels


def said_by(rng: random.Random) -> str:
    """Lines of labels and values in many spellings, with noise."""
    every = [(x, n) for n, ways in V.LABELS.items() for w in ways for x in w.labels]
    out = []
    for _ in range(rng.randrange(1, 14)):
        label = rng.choice(every)[0].replace("|", "").replace("?", "")
        if rng.random() < 0.4:
            label = label.upper()
        if rng.random() < 0.3:
            label = "".join(labels.folded(c) or c for c in label)
        gap = rng.choice([" ", " : ", ":", " - ", "\n", "  "])
        value = rng.choice(["FAC-2024-01", "12/03/2024", "1 250,500 DT", "Acier SARL, Tunis", "3 mars 2024", "N° 7", "0123456", "*12,5*", "STB", "TVA (19%)", "", "échéance", "20 123 456 789 012 345 678 90", "1314124ZAM000"])
        out.append(rng.choice(["", "  ", "x "]) + label + gap + value)
    return rng.choice(["\n", " ", "\n\n"]).join(out)


def test_the_index_finds_what_each_pattern_alone_finds():
    rng = random.Random(4)
    texts = [said_by(rng) for _ in range(150)] + ["", "\n", "İstanbul N° 12", "🙂 Facture n° A-1"]
    names = [n for n in V.LABELS if n != "date"]
    index = labels.Ways({n: V.LABELS[n] for n in names}, V.VALUES, None, {"tva": V.TAX_NUMBER})
    for every in (False, True):
        for text, row in zip(texts, index.found(texts, every), strict=True):
            for name, got in zip(names, row, strict=True):
                want = []
                for k, way in enumerate(V.LABELS[name]):
                    pattern = re.compile(f"(?i:{way.pattern(V.VALUES)})" + (V.TAX_NUMBER if name == "tva" else ""), re.M)
                    found = [(k, m[1]) for m in pattern.finditer(text)]
                    want += found if every else found[:1]
                assert got == want, (text, name)


def test_a_sheet_is_read_as_by_one_pattern_for_each_label():
    rng = random.Random(5)
    rules = [*sheets.ITEM_LABELS, *sheets.MORE_LABELS]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randrange(1, 12)):
            _, ls, _, _ = rng.choice(rules)
            label = rng.choice(ls).replace("?", "")
            lines.append(rng.choice(["", " ", "abc", "abc  ", "x,", "x | ", "x ; ", "\t"]) + label + rng.choice(["", " ", "\t"]) + rng.choice(["12,5", "Oui", "C-12", "Non géré, x", "kg", "", "61912345678"]))
        texts.append("\n".join(lines))
    index = labels.Sheet(rules, sheets.KINDS)
    for text, row in zip(texts, index.found(texts), strict=True):
        got = {n: v for n, _, _, v in row}
        for name, ls, kind, _ in rules:
            want = None
            for label in ls:
                if kind == "flag":
                    m = re.search(labels.sign(label), text, re.I | re.M)
                    want = "1" if m else None
                else:
                    end = "" if label.endswith(":") else "\\s*[:\\-]?"
                    m = re.search(r"(?:^|[\t,|;]|\s{2,})\s*" + labels.words(label) + end + "[ \t]*" + sheets.KINDS[kind], text, re.I | re.M)
                    want = m[1] if m else None
                if want is not None:
                    break
            assert got.get(name) == want, (text, name)


def test_spellings():
    assert labels.spellings("n° de la traite") == {"nodelatraite"}
    assert labels.spellings("quantités?") == {"quantite", "quantites"}
    assert labels.spellings("bl n° #") == {"blno"}
    assert labels.folded("Échéance\n: L'Été") == "echeancelete"
    with pytest.raises(ValueError):
        labels.Finder([" : "])


@pytest.mark.parametrize(
    ("said", "kind"),
    [
        ("Facture n° 12\nVendu à : X", "facture"), ("facture, vendu à X", "facture_vente"), ("République tunisienne : lettre", "traite"), ("ordre de paiement : c'p", "traite"), ("Montant max : 3000 DT", "cheque"), ("chèque : 12", "cheque"),
        ("facture\n1234567 mille dt\n10 500 002 12345678", "cheque"), ("facture\nfacture v 12", "facture_vente"), ("facture\nveuillez payer, sept dinars", "traite"), ("rien", "inconnu"), ("", "inconnu"),
    ],
)
def test_types_by_signs(spark, said, kind):
    assert one(spark, classify.by_patterns(F.lit(said))) == kind


@pytest.mark.parametrize(
    ("said", "result"),
    [
        ("somme de 5", ("cheque", 1.0)), ("à l'ordre de X, échéance le 3, tireur Y", ("traite", 0.667)), ("Tunis, le 3\nCMC 7", ("cheque", 1.0)), ("10 123 4567 123 45", ("cheque", 1.0)), ("T-2024-12", ("traite", 1.0)), ("LC N° 5", ("traite", 1.0)),
        ("payez contre ce chèque", ("cheque", 1.0)), ("traite, chèque", ("inconnu", 0.0)), ("", ("inconnu", 0.0)), ("non endossable", ("cheque", 1.0)),
    ],
)
def test_cheques_and_drafts_by_their_own_signs(spark, said, result):
    assert tuple(one(spark, classify.cheque_or_draft(F.lit(said)))) == result


@pytest.mark.parametrize(
    ("said", "fixed"),
    [("PANNEA|", "PANNEAUX"), ("PANNEAU", "PANNEAU"), ("tunigia", "TUNISIA"), ("TUWN187A7", "TUNISIA"), ("oleo tecning", "OLEO TECHNO"), ("OLEO TECN0", "OLEO TECHNO"), ("1 2/03/2024", "12/03/2024"), ("12/O3/2024", "12/03/2024"), ("1-l-2", "1-1-2"), ("12 J500", "12,500"), ("1–2", "1-2")],
)
def test_repairs(spark, said, fixed):
    assert one(spark, T.repair_names(T.repair_payment(F.lit(said)))) == fixed


@pytest.mark.parametrize(
    ("said", "name"),
    [("Acier Tunisie SARL Tél 71", "Acier Tunisie SARL"), ("Acier du Sud , Ben Arous 12", "Acier du Sud"), ("Alpha 12/03/2024", "Alpha"), ("Alpha | Beta", "Alpha"), ("Beta Négoce Rue 3", "Beta Négoce"), ("Lot 5", "Lot 5"), ("Lottier Frères", "Lottier Frères"), ("Tunis Air", "Tunis Air")],
)
def test_party_names_end(spark, said, name):
    assert one(spark, fields.party_name(F.lit(said))) == name


def test_cut_before_fields(spark):
    cut = lambda s: one(spark, T.before_field(F.lit(s), ["montant", "date", "tunisia"]))
    assert [cut(x) for x in ("ALPHA TUNISIA DATE 3", "Alpha montant 5", "Montant Alpha date", "STB", "Alpha")] == ["ALPHA TUNISIA", "Alpha", "Montant Alpha", "STB", "Alpha"]
    assert one(spark, T.before_word_label(F.lit("Alpha Tel fixe : 71"))) == "Alpha"


@pytest.mark.parametrize(
    ("said", "number"),
    [("Ordre de paiement 12345678", "12345678"), ("ordre de paiement\n123456789", "123456789"), ("LC N° AB12", "AB12"), ("CNP: 12345678", "12345678"), ("RIB 123456789\nx 323456789", "323456789"), ("201234567890\n12/03/2024 323456789", None), ("", None)],
)
def test_draft_numbers(spark, said, number):
    assert one(spark, payments.draft_number(F.lit(said))) == number
    assert one(spark, payments.drawer_company(F.lit("LETTRE\nAcier 12 SARL\nx"))) == "Acier  SARL"


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("Le 01/02/2024, 2024-03-01 et 3 février 2024, encore 01/02/2024", (["01/02/2024", "2024-03-01", "3 février 2024"], [], [], [])),
        ("Payer 1 250,500 DT\nTotal : 2 500\n12 €", ([], ["1 250,500", "12", "2 500"], [], [])),
        ("la somme de deux mille dinars", ([], ["2000.0"], [], [])),
        ("FAC-12 et BL1234/5", ([], [], ["FAC-12", "BL1234/5"], [])),
        ("A Acier du Sud SARL\nSociété : Beta Trading\nFournisseur : Montant HT", ([], [], [], ["Acier du Sud SARL", "Beta Trading"])),
        ("FORTI STORE\nTVA\nx", ([], [], [], ["FORTI STORE"])),
        ("", ([], [], [], [])),
    ],
)
def test_entities(spark, said, found):
    got = one(spark, fields.entities(F.lit(said)))
    assert (got.dates, got.amounts, got.references, got.companies) == found


# roles


def by_role(spark, said, profile):
    r = one(spark, roles.by_role(F.lit(said), profile))
    return r.dates, r.amounts, r.references, r.names


def test_roles_of_text(spark):
    assert by_role(spark, "", "text") == ({}, {}, {}, {})
    far = "\n" + "." * 70 + "\n"
    days, amounts, refs, names = by_role(spark, f"Facture FAC-2024-01 du 01/02/2024{far}échéance 2024-03-01{far}livraison 01.04.202{far}TVA 19,00{far}Net à payer 1 119,00{far}tel 71,00{far}Fournisseur : Acier Tunisie\n{far}Banque du Sud SA", "text")
    assert days == {"date": "01/02/2024", "date_echeance": "2024-03-01", "date_livraison": "01.04.202"}
    # the cut day is read as an amount too
    assert amounts == {"montant_ttc": 1119.0, "montant_tva": 19.0, "montant": 1.04}
    assert refs["numero_facture"] == "FAC-2024-01" and names["fournisseur"] == "Acier Tunisie" and names["banque"] == "Banque du Sud SA"
    # net and tax follow from the gross where both lack
    assert by_role(spark, "Total 119,00", "text")[1] == {"montant_ttc": 119.0, "montant_ht": 100.0, "montant_tva": 19.0}


def test_roles_of_a_sheet(spark):
    said = "Total HT 1 000,00\nTVA 19% 190,00\nTimbre 0,600\nRemise 5,00\nTotal HT brut 1 005,00\nNet à payer 1 190,60\nRIB 12,00"
    assert by_role(spark, said, "sheet")[1] == {"montant_ttc": 1190.6, "montant_ht": 1000.0, "montant_tva": 190.0, "remise": 5.0, "montant_ht_brut": 1005.0, "montant_taxe_detail": 0.6}
    # what begins inside a value is none; what begins before it is another one, and the largest is the gross
    assert by_role(spark, "x 1 231,919 y", "sheet")[1]["montant_ttc"] == 1231.919
    assert by_role(spark, "x 1.231,91", "sheet")[1]["montant_ttc"] == 1231.91
    entry = one(spark, roles.entry_of(roles.by_role(F.lit("Facture n° F-12\nDate 01/02/2024\nsociété Alpha SARL\nTotal TTC 10,00\nTVA 1,00"), "sheet")))
    assert entry == {"bill_date": "01/02/2024", "posting_date": "01/02/2024", "bill_no": "F-12", "supplier": "société Alpha SARL", "montant_ttc": "10.0", "montant_tva": "1.0"} or entry["supplier"].endswith("Alpha SARL")


# workbooks


def book(sheets_: list[tuple[str, str, str]], shared: list[str] = (), titles: bool = True) -> bytes:
    """Sheets of (title, part, rows as xml)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if titles:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbooks.MAIN}" xmlns:r="{workbooks.RELATIONS}"><sheets>' + "".join(f'<sheet name="{t}" r:id="k{n}"/>' for n, (t, _, _) in enumerate(sheets_)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}">' + "".join(f'<Relationship Id="k{n}" Target="{"/xl/" if n % 2 else ""}worksheets/{p}"/>' for n, (_, p, _) in enumerate(sheets_)) + "</Relationships>")
        for _, part, rows in sheets_:
            z.writestr(f"xl/worksheets/{part}", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
    return out.getvalue()


def test_sheets_are_named_by_relations(spark, tmp_path, monkeypatch):
    cells = '<row r="2"><c r="B2" t="s"><v>1</v></c><c><v>5</v></c></row><row><c t="s"><v>0</v></c></row>'
    whole = book([("Second part", "sheet2.xml", cells), ("First part", "sheet1.xml", '<row r="1"><c r="AA1" t="inlineStr"><is><t>x</t></is></c></row>'), ("Lost", "sheet9.xml", "")], ["<t>plain</t>", "<r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh>"])
    (tmp_path / "a.xlsx").write_bytes(whole)
    (tmp_path / "bad.xlsx").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "bare.xlsx").write_bytes(book([("", "sheet2.xml", "<row><c><v>2</v></c></row>"), ("", "sheet1.xml", "<row><c><v>1</v></c></row>")], titles=False))
    (tmp_path / "note.txt").write_text("no")
    want = {("a", "Second part", 0, 1, 1, "rich"), ("a", "Second part", 0, 1, 2, "5"), ("a", "Second part", 0, 2, 0, "plain"), ("a", "First part", 1, 0, 26, "x"), ("bare", "xl/worksheets/sheet1.xml", 0, 0, 0, "1"), ("bare", "xl/worksheets/sheet2.xml", 1, 0, 0, "2")}
    plain = lambda df: {(os.path.basename(r.file)[:-5], r.sheet, r.place, r.r, r.c, r.v) for r in df.collect()}
    got = workbooks.read(spark, str(tmp_path))
    assert plain(got) == want
    assert plain(workbooks.read(spark, f"file:{tmp_path}/a*.xlsx")) == {w for w in want if w[0] == "a"}
    assert plain(got.where("sheet = 'First part'")) == {w for w in want if w[1] == "First part"}
    assert spark.read.format("workbook").schema("v string, sheet string").load(str(tmp_path)).columns == ["v", "sheet"]
    assert plain(workbooks.cells_of_content(spark.read.format("binaryFile").load(f"{tmp_path}/*.xlsx"))) == want
    # large files give a partition for each sheet
    monkeypatch.setattr(workbooks, "LARGE", 1)
    reader = workbooks._Reader(str(tmp_path), list(workbooks._KINDS))
    parts = reader.partitions()
    assert len(parts) == 5 and sum(b.num_rows for p in parts for b in reader.read(p)) == len(want)
    assert list(reader.pushFilters([workbooks.EqualTo(("sheet",), "First part"), workbooks.EqualTo(("r",), 1)])) == [workbooks.EqualTo(("r",), 1)]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1


def test_written_books_are_read_back(spark, tmp_path):
    rows = [("a", "Zwei & <3>", 1, 0, 0, "x\x01y"), ("a", "Eins", 0, 5, 30, " é "), ("b/c", "S", 0, 0, 0, "1"), ("a", "Eins", 0, 5, 1, "first")]
    df = spark.createDataFrame(rows * 1, "file string, sheet string, place int, r int, c int, v string")
    workbooks.write(df, str(tmp_path / "out"))
    got = {(os.path.basename(r.file), *tuple(r)[1:]) for r in workbooks.read(spark, str(tmp_path / "out")).collect()}
    assert got == {("a.xlsx", "Zwei & <3>", 1, 0, 0, "xy"), ("a.xlsx", "Eins", 0, 5, 30, " é "), ("b%2Fc.xlsx", "S", 0, 0, 0, "1"), ("a.xlsx", "Eins", 0, 5, 1, "first")}
    assert sorted(os.listdir(tmp_path / "out")) == ["a.xlsx", "b%2Fc.xlsx"]
    with zipfile.ZipFile(tmp_path / "out" / "a.xlsx") as z:
        assert {"xl/worksheets/sheet9999.xml", "xl/worksheets/sheet9998.xml"} <= set(z.namelist())


def test_a_large_book_needs_little_memory(tmp_path):
    """100 MB of cells and 20 MB of shared strings, in a process of its own."""
    with zipfile.ZipFile(tmp_path / "large.xlsx", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'<worksheet xmlns="{workbooks.MAIN}"><sheetData>'.encode())
            for k in range(0, 1_000_000, 10_000):
                f.write("".join(f'<row r="{n + 1}"><c r="A{n + 1}" t="s"><v>{n % 200_000}</v></c><c r="B{n + 1}"><v>{n}.{"0" * 30}5</v></c></row>' for n in range(k, k + 10_000)).encode())
            f.write(b"</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}">' + "".join(f"<si><t>{n}{'x' * 90}</t></si>" for n in range(200_000)) + "</sst>")
        assert sum(i.file_size for i in z.infolist()) > 120 << 20
    script = f"import resource, sys; sys.path.insert(0, {str(os.path.dirname(os.path.dirname(__file__)))!r})\nfrom docloom.sources import workbooks\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nn = sum(1 for _ in workbooks.rows(open({str(tmp_path / 'large.xlsx')!r}, 'rb')))\nprint(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    n, mb = map(int, subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True).stdout.split())
    assert n == 2_000_000 and mb < 60


def test_chosen_sheets(spark):
    rows = [("a", "Notes", 0), ("a", "Ma Fiche", 1), ("a", "STOCK", 2), ("b", "x", 0), ("b", "y", 1), ("c", "Article stock", 0), ("c", "z", 1)]
    cells = spark.createDataFrame([(f, s, p, 0, 0, "v") for f, s, p in rows], "file string, sheet string, place int, r int, c int, v string")
    items, sites = workbooks.item_book(cells)
    assert {(r.file, r.sheet) for r in items.collect()} == {("a", "Ma Fiche"), ("b", "x"), ("c", "Article stock")}
    assert {(r.file, r.sheet) for r in sites.collect()} == {("a", "STOCK")}


def test_site_levels(spark):
    rows = [["Liste"], ["Site", "Nom site", "Stock sécu.", "Max", "Acheteur"], ["S1", "Un", "5", "0", ""], ["S2", "Deux", "3", "", "B"], ["", "Sans", "99", "", "C"]]
    cells = spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v], "file string, sheet string, r int, c int, v string")
    got = grid.site_levels(cells).first()
    assert (got.n_sites, got.safety_stock, got.stock_max, got.buyer, got.abc) == (2, 5, None, "B", None)


# streams


def batches(spark, folder, rounds, schema):
    """Each round is a file of its own, taken in one micro-batch."""
    for k, rows in enumerate(rounds):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")


def run(spark, out, tmp_path, name):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name).collect()


def minute(m: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)


def test_files_settle_once(spark, tmp_path):
    intake.use_state(spark)
    rounds = [
        [("a", minute(0)), ("b", minute(1)), ("a", minute(2)), ("a", minute(2))],
        [("a", minute(11)), ("b", minute(30))],  # a goes on within ten minutes; b comes again after them
        [("c", minute(40)), ("a", minute(9))],  # late, but not behind the watermark
        [("c", minute(70)), ("a", minute(5))],  # a is settled by now: its late event counts no more
        [("a", minute(75)), ("d", minute(300))],  # known: not released again
        [("e", minute(900))],
    ]
    batches(spark, tmp_path / "in", rounds, "path string, at timestamp")
    stream = spark.readStream.schema("path string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withWatermark("at", "15 minutes")
    got = {(r.path, r.first, r["last"], r.n) for r in run(spark, intake.debounced(stream, 600), tmp_path, "settled")}
    assert got == {("a", minute(0), minute(11), 4), ("b", minute(1), minute(1), 1), ("c", minute(40), minute(40), 1), ("d", minute(300), minute(300), 1)}
    # a whole table without the late event and what the watermark has not passed
    table = spark.createDataFrame([x for k, r in enumerate(rounds[:5]) for x in r if (k, x[0]) != (3, "a")], "path string, at timestamp")
    assert {(r.path, r.first, r["last"], r.n) for r in intake.settled(table, 600).collect()} == got


def test_a_gap_of_just_the_quiet_time_belongs(spark):
    rows = [("a", minute(0)), ("a", minute(10)), ("a", minute(20.001)), ("b", minute(0)), ("b", minute(10) + datetime.timedelta(milliseconds=1))]
    got = intake.settled(spark.createDataFrame(rows, "path string, at timestamp"), 600).collect()
    assert {(r.path, r.n) for r in got} == {("a", 2), ("b", 1)}


def test_results_are_kept_for_a_while(spark, tmp_path):
    intake.use_state(spark)
    rng, rounds = random.Random(8), []
    for k in range(6):
        rounds.append([(f"k{rng.randrange(4)}", minute(60 * k + rng.randrange(80)), rng.choice(["put", "get", "get"]), f"v{rng.randrange(9)}") for _ in range(25)])
    rounds += [[("z", minute(2000), "get", None)], [("z", minute(2001), "get", None)]]
    schema = "key string, at timestamp, kind string, value string"
    batches(spark, tmp_path / "in", rounds, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withWatermark("at", "3 hours")
    plain = lambda rows: sorted((r.key, r.at, r.outcome, r.value or "") for r in rows if r.key != "z")
    got = plain(run(spark, intake.kept(stream, 3600), tmp_path, "kept"))
    table = spark.createDataFrame([x for r in rounds for x in r], schema)
    want = plain(intake.kept_in(table, F.lit(minute(1900)), 3600).collect())
    assert got == want and {o for _, _, o, _ in got} == {"hit", "miss", "expired"}
    brute, rows = [], [x for r in rounds for x in r if x[0] != "z"]
    for key, at, kind, _ in rows:
        if kind == "get":
            puts = [(a, v) for k, a, x, v in rows if k == key and x == "put" and a <= at]
            alive = puts and max(puts)[0] + datetime.timedelta(hours=1) > at
            brute.append((key, at, "hit" if alive else "miss", max(puts)[1] if alive else ""))
    assert sorted(brute) == [g for g in got if g[2] != "expired"]


def test_steps_of_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Facture N° 12", V.PENDING), ("b", " ", V.RUNNING), ("c", "x", V.VALID)], "name string, text string, status string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    watched = Steps("in_stream", streaming=True).watch("loaded", stream)
    with listening(spark, StepListener("in_stream")) as heard:
        watched.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if heard.found:
                break
            import time

            time.sleep(0.1)
    assert {(s, m): v for _, s, m, v in heard.found if v} == {("loaded", "rows_in"): 3, ("loaded", "rows_out"): 2}


def test_steps_of_a_table(spark):
    docs = spark.createDataFrame([("a", "Facture N° 12", V.PENDING), ("b", " ", V.RUNNING), ("c", "x", V.VALID)], "name string, text string, status string")
    steps = Steps()
    assert {r.name: r.status for r in worker.worked(docs, steps).collect()} == {"a": V.TO_CHECK, "b": V.REJECTED}
    got = {(r.step, r.metric): r.value for r in steps.rows(spark).collect()}
    assert got["checked", "rows_in"] == 2 and got["checked", "refused"] == 1 and got["checked", "to_check"] == 1 and got["checked", "errors"] == 4


# joins and merges


@pytest.mark.parametrize("bucket", [60, 3_600, 86_400])
def test_overlaps_are_those_of_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    span = lambda: (lambda a: (minute(a), minute(a + rng.choice([0, 1, 30, 59, 60, 61, 4000]))))(rng.randrange(6000))
    q = [(k, *span(), k % 3) for k in range(40)] + [(99, None, minute(3), 0)]
    r = [(k, *span(), k % 4) for k in range(60)]
    df = lambda rows, n: spark.createDataFrame(rows, f"{n} int, start timestamp, end timestamp, nation int")
    got = fleet.overlaps(df(q, "request"), df(r, "reservation"), ["nation"], bucket)
    pairs = [(x.request, x.reservation) for x in got.collect()]
    want = {(a, b) for a, s, e, n in q for b, s2, e2, n2 in r if s and n == n2 and s < e and s2 < e2 and s < e2 and s2 < e}
    assert sorted(pairs) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_free_vehicle(spark):
    cars = spark.createDataFrame([(f"v{k}", f"P{9 - k}", "En maintenance" if k == 3 else "Disponible", 0) for k in range(6)] + [("w", "P1", "Disponible", 1)], "name string, plate string, status string, nation int")
    booked = spark.createDataFrame([("r1", "v5", minute(0), minute(100), "Confirmée"), ("r2", "v4", minute(50), minute(60), "Confirmée"), ("r3", "v2", minute(0), minute(9), "Annulée")], "name string, vehicle string, start timestamp, end timestamp, status string")
    asked = spark.createDataFrame([(1, minute(55), minute(56), 0), (2, minute(100), minute(101), 0), (3, minute(0), minute(1), 1), (4, minute(0), minute(1), 7)], "request int, start timestamp, end timestamp, nation int")
    got = {r.request: (r.n_free, r.plate) for r in fleet.available_for(asked, cars, booked, ["nation"]).collect()}
    assert got == {1: (3, "P7"), 2: (5, "P4"), 3: (1, "P1"), 4: (0, None)}


def test_phrases_in_texts_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé %_") for _ in range(n))
    texts = [word(rng.randrange(0, 30)) for _ in range(120)] + [None, ""]
    phrases = [word(rng.randrange(0, 6)) for _ in range(60)] + [t[3:9] for t in texts[:40] if t] + [None, "zzz", "ab" * 40]
    got = contains.held(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert sorted(map(tuple, got.collect())) == sorted({(t, p) for t in texts for p in phrases if t is not None and p and p in t})
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_numbers_in_fields_link_five_documents(spark):
    docs = spark.createDataFrame([(f"d{k}", None, None, {"memo": f"voir N77 et {k}"}) for k in range(8)], "name string, linked_doctype string, linked_docname string, fields map<string,string>")
    entries = spark.createDataFrame([("PI", "e1", "N77"), ("PI", "e2", ""), ("PI", "e3", None), ("PI", "e4", "et 7")], "doctype string, entry string, bill_no string")
    got = {(r.entry, r.name) for r in documents.linked(docs, entries).collect()}
    assert got == {("e1", f"d{k}") for k in range(5)} | {("e4", "d7")}


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    docs = spark.createDataFrame([(f"D{k}", f"file_{k}x.pdf", V.PENDING) for k in range(200)], "name string, document_name string, status string")
    store = DocumentStore(spark, str(tmp_path / "s"), 16)
    store.create(docs)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, fs in os.walk(tmp_path / "s" / "documents") for f in fs if f.endswith(".parquet")}
    before = files()
    new = spark.createDataFrame([("file_7x_a1b2c3d4.pdf", V.VALID), ("new.pdf", V.TO_CHECK)], "document_name string, status string")
    touched = store.merge(new, ["status"], 5)
    after = files()
    kept = {f for f in before if after.get(f) == before[f]}
    rewritten = {int(re.search(f"{PART}=(\\d+)", f)[1]) for f in after if f not in kept}
    assert 1 <= len(touched) <= 2 and rewritten <= set(touched) and len(kept) >= len(before) - 2
    assert store.merge(new.withColumn("status", F.lit(V.REJECTED)), ["status"], 5) == []
    got = {r.document_name: r.status for r in store.documents().collect()}
    assert got["file_7x.pdf"] == V.VALID and got["new.pdf"] == V.TO_CHECK and len(got) == 201
    # another spelling of the new document's name finds it
    store.merge(spark.createDataFrame([("new-00112233.pdf", V.REJECTED)], "document_name string, status string"), ["status"], 6)
    assert {r.document_name: r.status for r in store.documents().collect()}["new.pdf"] == V.REJECTED
    assert store.merge(new.limit(0), ["status"], 7) == [] and store.documents().count() == 201


@pytest.mark.parametrize(("name", "bare"), [("a_b.pdf", "a_b"), ("a_b_a1b2c3d4.pdf", "a_b"), ("a_b_a1b2c3d4", "a_b"), ("a-00ff00-11ee11.tar.gz", "a"), ("", "")])
def test_bare_names(spark, name, bare):
    assert one(spark, T.bare_name(F.lit(name))) == bare


# boxes


def test_separators(spark):
    assert one(spark, grid.separators(F.array(*map(F.lit, [30, 5, 12, 14, 16, 16, 31, 60])))) == [5, 16, 30, 60]
    assert one(spark, grid.separators(F.array().cast("array<int>"))) == []


def test_boxes_to_cells(spark):
    words = [(1, 0, 0, 30, 10, "Réf"), (1, 100, 1, 140, 11, "Nom"), (1, 300, 0, 340, 10, "Total"), (1, 0, 30, 40, 40, "AB1"), (1, 100, 31, 130, 41, "Tube"), (1, 136, 29, 170, 39, "fin"), (1, 300, 30, 340, 40, "12,5"), (2, 5, 5, 9, 9, "seul")]
    got = {(r.page, r.r, r.c): r.v for r in grid.cells_of_boxes(spark.createDataFrame(words * 2, "page int, x0 int, y0 int, x1 int, y1 int, word string").distinct()).collect()}
    assert got == {(1, 0, 0): "Réf", (1, 0, 1): "Nom", (1, 0, 2): "Total", (1, 1, 0): "AB1", (1, 1, 1): "Tube fin", (1, 1, 2): "12,5", (2, 0, 0): "seul"}
    cells = spark.createDataFrame([(*k, v) for k, v in got.items()], "page int, r int, c int, v string")
    assert [tuple(r) for r in grid.invoice_table(cells).collect()] == [(1, 1, "AB1", "Tube fin", 1, 12.5, 12.5)]


def test_a_table_in_one_pass_is_that_of_two(spark):
    rng = random.Random(9)
    names = [("Code article", "item_code"), ("Quantité", "qty"), ("Désignation", "item_name")]
    rows = []
    for f in range(12):
        for r in range(rng.randrange(2, 14)):
            kind = rng.random()
            vs = [h for h, _ in names] if kind < 0.25 else ["Total", "", ""] if kind < 0.35 else [f"P{r}", str(r), rng.choice(["Vis", ""])]
            rows += [(f"f{f}", "s", r, c, v) for c, v in enumerate(vs)]
    cells = spark.createDataFrame(rows, "file string, sheet string, r int, c int, v string")
    columns = spark.createDataFrame(names, "heading string, field string")
    wanted = ["item_code", "qty", "item_name"]
    plain = lambda df: sorted((r.file, r.r, sorted(r["values"].items())) for r in df.collect())
    assert plain(grid.table(cells, names, wanted, "item_code")) == plain(grid.table_rows(cells, grid.header_row(cells, columns, wanted), "item_code"))
