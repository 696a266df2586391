"""Spreadsheets as a relation of cells (file, sheet, r, c, v): labels beside values, tables under headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.numbers import amount_cell
from docloom.functions.text import fold, let, once, rx, squeeze
from docloom.operators.contains import either_holds

SHEET = ["file", "sheet"]
ROW = [*SHEET, "r"]


def label_of_numbers(cells: DataFrame) -> DataFrame:
    """Each numeric cell with the nearest cell to its left that holds a text."""
    left = Window.partitionBy(*ROW).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    words = F.when(amount_cell(F.col("v")).isNull() & (F.trim("v") != ""), F.trim("v"))
    return cells.withColumn("label", F.last(words, True).over(left)).withColumn("amount", amount_cell(F.col("v"))).where("amount is not null and label is not null")


def label_values(cells: DataFrame, labels: DataFrame, rows: int = 30, reach: int = 3) -> DataFrame:
    """(file, sheet, field, value): in the first rows, the next filled cell within reach of a label. labels: (label, field, ord); the first in order that a cell's text contains, or that contains it (of three characters or more), counts. Cells meet labels by docloom.operators.contains, each distinct text once."""
    head = cells.where(F.col("r") < rows).withColumn("key", fold(squeeze(F.col("v"))))
    ahead = Window.partitionBy(*ROW).orderBy("c").rangeBetween(1, reach)
    near = head.withColumn("value", F.first(F.when(F.trim("v") != "", F.trim("v")), True).over(ahead)).where("key <> '' and value is not null")
    known = labels.withColumn("_label", fold(squeeze(F.col("label"))))
    pairs = either_holds(near.select("key"), known, "key", "_label").where(F.contains("key", "_label") | (F.length("key") >= 3))
    first = pairs.join(known, "_label").groupBy("key").agg(F.min_by("field", "ord").alias("field"))
    return near.join(first, "key").groupBy(*SHEET, "field").agg(F.min_by("value", F.struct("r", "c")).alias("value"))


def label_pairs(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file, sheet, field, value): on a sheet of four columns, labels in the first and third with their values behind them; of equal labels the last row counts, of a field's aliases the first that has a value. aliases: a small dimension (alias, field, ord)."""
    key = F.lower(F.btrim(squeeze(F.col("v")), F.lit(": ")))
    pairs = None
    for left in (0, 2):
        label = cells.where(F.col("c") == left).select(*ROW, key.alias("label")).where("label <> ''")
        said = cells.where(F.col("c") == left + 1).select(*ROW, F.trim("v").alias("value"))
        both = label.join(said, ROW, "left").withColumn("side", F.lit(left))
        pairs = both if pairs is None else pairs.unionByName(both)
    last = pairs.groupBy(*SHEET, "label").agg(F.max_by(F.struct("value"), F.struct("r", "side"))["value"].alias("value")).where("value <> ''")
    return last.join(aliases, F.col("label") == F.lower("alias")).groupBy(*SHEET, "field").agg(F.min_by("value", "ord").alias("value"))


def site_table(cells: DataFrame, columns: list[tuple[str, list[str]]]) -> DataFrame:
    """X11: (file, sheet, r, values): rows below the first one with a cell that is site or code, by the columns whose heading holds one of a field's words (the first word, then the first column); rows need a code. columns: field and its words, in order."""
    low = F.lower(F.trim("v"))
    sheet = Window.partitionBy(*SHEET)
    # windows over a sheet's cells after one shuffle, without joins; a cell's place among its sheet's headings decides its column's fields
    inside = cells.withColumn("_low", low).withColumn("_header", F.min(F.when(F.col("_low").isin("site", "code"), F.col("r"))).over(sheet)).where("r >= _header")
    ranks = [F.coalesce(*[F.when(F.contains("_low", F.lit(w)), F.lit(k)) for k, w in enumerate(words)]) for _, words in columns]
    place = lambda rank: F.min(F.when((F.col("r") == F.col("_header")) & rank.isNotNull(), F.struct(rank.alias("rank"), F.col("c").alias("c"))))
    placed = inside.withColumns({f"_c{k}": place(rank).over(sheet) for k, rank in enumerate(ranks)})
    of = F.filter(F.array(*[F.when(F.col(f"_c{k}.c") == F.col("c"), F.lit(field)) for k, (field, _) in enumerate(columns)]), lambda x: x.isNotNull())
    said = placed.where((F.col("r") > F.col("_header")) & (F.trim("v") != "")).select(*ROW, F.explode(of).alias("field"), F.trim("v").alias("v"))
    rows = said.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("values"))
    return rows.where(F.array_contains(F.map_keys("values"), "code"))


#: The columns of a sites' table: field and the words that its heading holds, in order.
SITE_COLUMNS = [
    ("code", ["site", "code"]), ("label", ["nom site", "nom", "label", "désignation"]), ("abc", ["abc", "catégorie abc"]), ("counting", ["inventaire", "mode inventaire"]), ("picking", ["retrait", "mode retrait"]), ("buyer", ["acheteur", "approv"]),
    ("safety_stock", ["sécurité", "securite", "sécu"]), ("stock_max", ["maximum", "max"]), ("reorder_level", ["seuil", "réappro", "reappro"]), ("reorder_qty", ["qté mini", "qte mini", "quantité mini", "quantite mini"]),
]
SITE_LEVELS, SITE_WORDS = ["safety_stock", "stock_max", "reorder_level", "reorder_qty"], ["abc", "counting", "picking", "buyer"]


def site_levels(cells: DataFrame) -> DataFrame:
    """Of each sheet (file, sheet, n_sites, the greatest of each level that isn't zero, the first of each attribute that isn't empty) from its sites' table."""
    rows = site_table(cells, SITE_COLUMNS)
    v = lambda n: F.nullif(F.try_element_at("values", F.lit(n)), F.lit(""))
    whole = lambda n: F.coalesce(F.floor(amount_cell(v(n))).cast("long"), F.lit(0))
    return rows.groupBy(*SHEET).agg(F.count("*").alias("n_sites"), *[F.max(F.when(whole(n) != 0, whole(n))).alias(n) for n in SITE_LEVELS], *[F.min_by(v(n), F.when(v(n).isNotNull(), F.col("r"))).alias(n) for n in SITE_WORDS])


def header_row(cells: DataFrame, columns: DataFrame, wanted: list[str], rows: int = 50, least: int = 3, of_wanted: int = 2) -> DataFrame:
    """(file, sheet, header, mapping from c to field) of the first row with enough known headings."""
    named = cells.where(F.col("r") < rows).withColumn("heading", fold(squeeze(F.col("v")))).join(columns.select(fold("heading").alias("heading"), "field"), "heading")
    per_row = named.groupBy(*ROW).agg(F.count_distinct("field").alias("n"), F.size(F.array_intersect(F.collect_set("field"), F.array(*map(F.lit, wanted)))).alias("k"), F.map_from_entries(F.collect_list(F.struct("c", "field"))).alias("columns"))
    return per_row.where((F.col("n") >= least) & (F.col("k") >= of_wanted)).groupBy(*SHEET).agg(F.min("r").alias("header"), F.min_by("columns", "r").alias("columns"))


def table_rows(cells: DataFrame, header: DataFrame, key: str, end: str = "^(total|notes?|remarques?|observations?)\\b") -> DataFrame:
    """(file, sheet, r, values): rows under the header, up to a row that begins with a closing word, that have the key field."""
    body = cells.join(header, SHEET).where("r > header")
    stop = body.where((F.col("c") < 3) & F.col("v").rlike(rx(end))).groupBy(*SHEET).agg(F.min("r").alias("stop"))
    inside = body.join(stop, SHEET, "left").where("stop is null or r < stop").withColumn("field", F.try_element_at("columns", F.col("c"))).where("field is not null and trim(v) <> ''")
    return inside.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("field", F.trim("v").alias("v")))).alias("values")).where(F.array_contains(F.map_keys("values"), key))


def table(cells: DataFrame, columns: list[tuple[str, str]], wanted: list[str], key: str, first_rows: int = 50, least: int = 3, of_wanted: int = 2, end: str = "^(total|notes?|remarques?|observations?)\\b", together: bool = False) -> DataFrame:
    """(file, sheet, r, values): what header_row and table_rows give, from one shuffle of the cells by sheet: rows are put together, then headings, the first header and the first closing row below it are found by windows over a sheet's rows. columns: heading and field. together: whether a file's cells lie in one partition already.

    A sheet is one task's work; the format bounds its rows.
    """
    field_of = F.create_map(*[fold(F.lit(h)) if k == 0 else F.lit(f) for h, f in columns for k in (0, 1)])
    rows = (cells if together else cells.repartition(*SHEET)).groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("_v"))
    named = F.map_filter(F.transform_values("_v", lambda c, v: F.try_element_at(field_of, fold(squeeze(v)))), lambda c, f: f.isNotNull())
    rows = rows.withColumn("_named", F.when(F.col("r") < first_rows, named))
    fields = F.array_distinct(F.map_values("_named"))
    is_header = (F.size(fields) >= least) & (F.size(F.array_intersect(fields, F.array(*map(F.lit, wanted)))) >= of_wanted)
    rows = rows.withColumn("_header", F.when(is_header, F.col("r")))
    sheet = Window.partitionBy(*SHEET)
    rows = rows.withColumns({"header": F.min("_header").over(sheet), "_columns": F.min_by("_named", "_header").over(sheet)})
    closes = F.exists(F.map_entries("_v"), lambda e: (e["key"] < 3) & e["value"].rlike(rx(end)))
    rows = rows.withColumn("_stop", F.min(F.when((F.col("r") > F.col("header")) & closes, F.col("r"))).over(sheet))
    inside = rows.where((F.col("r") > F.col("header")) & (F.col("_stop").isNull() | (F.col("r") < F.col("_stop"))))
    pairs = F.filter(F.transform(F.map_entries("_v"), lambda e: F.struct(F.try_element_at("_columns", e["key"]).alias("field"), F.trim(e["value"]).alias("v"))), lambda e: e["field"].isNotNull() & (e["v"] != ""))
    return inside.select(*ROW, F.map_from_entries(pairs).alias("values")).where(F.array_contains(F.map_keys("values"), key))


def component_defaults(rows: DataFrame) -> DataFrame:
    """Typed component columns; quantity 1, rate 0, factor 1, quantity per unit as the quantity."""
    v = lambda n: F.try_element_at("values", F.lit(n))
    qty = F.coalesce(amount_cell(v("qty")), F.lit(1.0))
    return rows.select(*ROW, v("item_code").alias("item_code"), F.coalesce(v("item_name"), v("item_code")).alias("item_name"), qty.alias("qty"), v("uom").alias("uom"), F.coalesce(amount_cell(v("qty_per_unit")), qty).alias("qty_per_unit"), F.coalesce(amount_cell(v("conversion_factor")), F.lit(1.0)).alias("conversion_factor"), F.coalesce(amount_cell(v("rate")), F.lit(0.0)).alias("rate"))


def cell_value(field: Column, value: Column, numbers: list[str], flags: list[str]) -> Column:
    """A cell's text in the form of its field: a number, 0 or 1, or trimmed."""
    return F.when(field.isin(numbers), amount_cell(value).cast("string")).when(field.isin(flags), F.lower(F.trim(value)).isin("oui", "yes", "1", "true", "vrai", "actif").cast("int").cast("string")).otherwise(F.trim(value))


def sheet_text(cells: DataFrame) -> DataFrame:
    """The text cells of each file in order, one to a line. A file's cells are one spreadsheet."""
    words = cells.where(amount_cell(F.col("v")).isNull() & (F.trim("v") != ""))
    return words.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "r", "c", "v"))), lambda x: x["v"]), "\n").alias("text"))


def separators(positions: Column, tolerance: int = 10) -> Column:
    """Of the places of drawn pixels those that begin a line: each that lies more than the tolerance behind the last one taken. positions: whole pixels, so a page's height or width bounds them."""
    return F.aggregate(F.array_sort(F.array_distinct(positions)), F.array().cast("array<int>"), lambda kept, p: F.when((F.size(kept) == 0) | (p - F.element_at(kept, F.when(F.size(kept) == 0, 1).otherwise(-1)) > tolerance), F.concat(kept, F.array(p.cast("int")))).otherwise(kept))


def sessions(df: DataFrame, keys: list[str], start: Column, end: Column, tolerance: float, name: str) -> DataFrame:
    """df with the number, from 0, of the run that a row's stretch lies in: a gap of more than the tolerance behind all stretches before it begins a new one. Equal stretches are one. Windows over the keys only, so that rows that lie together by them stay where they are, and a page's rows are never one list."""
    rows = df.withColumns({"_a": start, "_z": end})
    ahead = Window.partitionBy(*keys).orderBy("_a", "_z")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    same = F.lag("_a").over(ahead).eqNullSafe(F.col("_a")) & F.lag("_z").over(ahead).eqNullSafe(F.col("_z")) & (F.row_number().over(ahead) > 1)
    rows = rows.withColumns({"_reach": F.max("_z").over(before), "_same": same})
    new = F.when(F.col("_same"), 0).otherwise(F.coalesce((F.col("_a") - F.col("_reach") > tolerance).cast("int"), F.lit(0)))
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(ahead.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_a", "_z", "_reach", "_same", "_new")


def cells_of_boxes(words: DataFrame, page: str = "page", line_gap: float = 4, column_gap: float = 14) -> DataFrame:
    """(page, r, c, v) from words with their boxes (page, x0, y0, x1, y1, word): rows are runs of words by height, columns are runs of the whole page by width, so that a gap that all lines leave parts two columns; a cell's words stand from left to right. Words travel once at most, to their page."""
    lined = sessions(words, [page], F.col("y0"), F.col("y1"), line_gap, "r")
    placed = sessions(lined, [page], F.col("x0"), F.col("x1"), column_gap, "c")
    said = placed.groupBy(page, "r", "c").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "word"))).alias("_w"))
    return said.select(page, "r", "c", F.array_join(F.transform("_w", lambda w: w["word"]), " ").alias("v"))


#: What the columns of an invoice's table are, by how many there are.
TABLE_COLUMNS = {7: ["reference", "designation", "qty", "rate", "tax", "discount", "amount"], 6: ["reference", "designation", "qty", "rate", "discount", "amount"], 5: ["reference", "designation", "qty", "rate", "amount"], 4: ["reference", "designation", "qty", "amount"], 3: ["reference", "designation", "amount"]}


def invoice_table(cells: DataFrame, page: str = "page") -> DataFrame:
    """(page, r, reference, designation, qty, rate, amount) of the rows of an invoice's table, its columns named by their number. Rows need an amount and a reference of two characters or a designation of three, and are no headings. A quantity that lacks is the amount by the rate, else one; a rate that lacks is the amount by the quantity."""
    # a window over the pages, on which the cells lie together already
    wide = cells.withColumn("_width", F.max("c").over(Window.partitionBy(page)) + 1).where("_width >= 3")
    names = F.create_map(*[x for n, ns in TABLE_COLUMNS.items() for x in (F.lit(n), F.array(*map(F.lit, ns)))])
    named = wide.withColumn("field", F.get(F.try_element_at(names, F.least("_width", F.lit(7))), F.col("c"))).where("field is not null")
    fields = ["reference", "designation", "qty", "rate", "amount"]
    rows = named.groupBy(page, "r").agg(*[F.coalesce(F.max(F.when(F.col("field") == n, F.trim("v"))), F.lit("")).alias(f"_{n}") for n in fields])
    v = lambda n: F.col(f"_{n}")
    heading = F.concat_ws(" ", v("reference"), v("designation")).rlike(rx("r[ée]f[ée]rence|d[ée]signation|qt[ée]|p\\.?ht"))
    kept = rows.where(~heading & ((F.length(v("designation")) >= 3) | (F.length(v("reference")) >= 2)))
    number = lambda n: let(amount_cell(v(n)), lambda x: F.when(x > 0, x))
    kept = once(kept, {"qty_": number("qty"), "rate_": number("rate"), "amount": number("amount")}).where("amount is not null")
    kept = kept.select(page, "r", v("reference").alias("reference"), v("designation").alias("designation"), F.col("qty_").alias("_qty"), F.col("rate_").alias("_rate"), "amount")
    qty = F.coalesce("_qty", F.when(F.col("_rate").isNotNull(), F.round(F.col("amount") / F.col("_rate"))), F.lit(1.0))
    kept = kept.withColumn("_q", qty)
    rate = F.coalesce("_rate", F.when(F.col("_q") > 0, F.round(F.col("amount") / F.col("_q"), 3)), "amount")
    said = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return kept.select(page, "r", said("reference", F.lit("N/A")).alias("reference"), said("designation", said("reference", F.lit("Article"))).alias("designation"), F.round("_q").cast("int").alias("qty"), rate.alias("rate"), "amount")
