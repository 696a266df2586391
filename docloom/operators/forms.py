"""What a form does with extracted fields: aliases, marks, gates, links back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.functions.fuzzy import partial_ratio_of
from docloom.functions.phrases import LINK, any_of, signs
from docloom.functions.text import fold, is_missing, rx, squeeze
from docloom.operators.contains import either_holds
from docloom.operators.resolve import shape_score, words


def form_value(fields: Column, aliases: list[str], name: str, raw: str) -> Column:
    """The first alias that isn't missing, then the name in the books, then the extracted field."""
    return F.coalesce(*[F.when(~is_missing(v), v) for v in (F.try_element_at(fields, F.lit(a)) for a in [*aliases, name, raw])])


def is_uncertain(uncertain: Column, raw: str, aliases: list[str]) -> Column:
    """J2."""
    return F.coalesce(F.arrays_overlap(uncertain, F.array(*map(F.lit, [raw, *aliases]))), F.lit(False))


def mark(value: Column, uncertain: Column, sensitivity: Column) -> Column:
    """J3."""
    return F.when(uncertain, "low").when(is_missing(value) & (sensitivity == 1), "mandatory").when(~is_missing(value) & (sensitivity == 1), "high")


def positive(amount: Column) -> Column:
    """J4."""
    return F.when(amount > 0, amount)


def client_amount(text: Column) -> Column:
    """Brackets are minus; one digit, a dot and three digits are thousands."""
    s = F.regexp_replace(text, "[\\s €$]|DT|TND", "")
    minus = s.rlike("^\\(.*\\)$")
    bare = F.regexp_replace(s, "[()]", "")
    v = F.when(bare.rlike("^\\d\\.\\d{3}$"), F.replace(bare, F.lit("."), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit("."))).try_cast("double")
    return F.when(minus, -v).otherwise(v)


def may_save(links: Column) -> Column:
    """An array of struct (value, resolved): nothing is saved while a link with a value is unresolved."""
    return ~F.exists(links, lambda x: ~is_missing(x["value"]) & ~x["resolved"])


def linked_back(docs: DataFrame, saved: DataFrame) -> DataFrame:
    """Documents with the entry that was saved from them. saved: name, doctype, entry."""
    side = saved.groupBy(F.col("name").alias("_name")).agg(F.max(F.struct("doctype", "entry")).alias("_to"))
    j = docs.join(side, docs["name"] == side["_name"], "left")
    return j.withColumns({"linked_doctype": F.coalesce("_to.doctype", "linked_doctype"), "linked_docname": F.coalesce("_to.entry", "linked_docname")}).drop("_name", "_to")


def item_value(kind: Column, old: Column, read: Column, is_code: Column) -> Column:
    """An existing code stays; numbers as numbers, a zero only where a zero was there; flags as 0 or 1."""
    number = F.replace(read, F.lit(","), F.lit(".")).try_cast("double")
    new = F.when(kind == "number", F.when((number != 0) | (old.try_cast("double") != 0), number.cast("string"))).when(kind == "check", F.lower(read).isin("oui", "yes", "1", "true", "vrai").cast("int").cast("string")).otherwise(F.trim(read))
    return F.when(is_code & ~is_missing(old), old).otherwise(new)


def row_complete(code: Column, uom: Column, qty: Column) -> Column:
    """J9."""
    return ~is_missing(code) & ~is_missing(uom) & F.coalesce(qty > 0, F.lit(False))


def completed(status: Column, n_empty: Column) -> Column:
    """J10."""
    return F.when(n_empty == 0, V.VALID).otherwise(status)


def warehouses(sites: DataFrame, houses: DataFrame) -> DataFrame:
    """Sites with reorder data and the first warehouse whose name holds the site's label or is held by it. houses: (warehouse, ord). Labels meet names by docloom.operators.contains."""
    some = sites.where("coalesce(reorder_level, 0) <> 0 or coalesce(reorder_qty, 0) <> 0").withColumn("_a", fold(squeeze(F.col("label"))))
    known = houses.withColumn("_b", fold(squeeze(F.col("warehouse"))))
    best = either_holds(some, known, "_a", "_b").join(known, "_b").groupBy("_a").agg(F.min_by("warehouse", "ord").alias("warehouse"))
    return some.join(best, "_a", "left").drop("_a")


def link_value(df: DataFrame, master: DataFrame, value: str = "value") -> DataFrame:
    """The id if it exists, else of five names that begin with it, in order, the one that equals it but for case, else the first."""
    ids = master.select(F.col("id").alias("_id")).distinct()
    names = master.select(F.col("id").alias("found"), F.lower("id").alias("low")).distinct()
    want = df.select(F.col(value).alias("want")).where(F.col(value) != "").distinct().withColumn("head", F.lower("want"))
    # names are filed under their beginnings of the lengths that values have, so that each value meets its five by an equi-join
    lengths = want.agg(F.collect_set(F.length("head")).alias("_lengths")).scalar()
    begins = names.withColumn("_n", F.explode(lengths)).where(F.col("_n") <= F.length("low")).select("found", "low", F.substring(F.col("low"), F.lit(1), F.col("_n")).alias("head"))
    wanted = begins.join(want.select("head").distinct(), "head", "left_semi")
    five = wanted.withColumn("k", F.row_number().over(Window.partitionBy("head").orderBy("found"))).where("k <= 5")
    best = want.join(five.groupBy("head").agg(F.min_by("found", F.struct((F.col("low") != F.col("head")).alias("other"), F.col("k"))).alias("found")), "head").select("want", "found")
    out = df.join(ids, df[value] == ids["_id"], "left").join(best, df[value] == best["want"], "left")
    return out.withColumn("resolved", F.coalesce("_id", "found")).drop("_id", "want", "found")


def field_confidence(field: Column, value: Column, text: Column) -> Column:
    """0.5 for presence in the text (or half of the partial ratio, 0.9 at most), and the shape's share."""
    v, t = F.lower(F.trim(value)), F.lower(F.coalesce(text, F.lit("")))
    return F.least(F.when(t.contains(v), 0.5).otherwise(F.least(partial_ratio_of(v, t) / 100, F.lit(0.9)) * 0.5) + shape_score(field, value), F.lit(1.0))


#: Words of a table's head, of lines that name no supplier, of goods, and of what capitals often say.
TABLE_WORDS = ["désignation", "designation", "description", "article", "qte", "qté", "prix", "total", "tva", "montant"]
NO_NAME = ["rue", "avenue", "blvd", "boulevard", "tel", "tél", "fax", "mail", "@", "mf :", "matricule", "r.c.s", "siret", "rib", "iban", "page"]
GOODS = ["souris", "clavier", "ecran", "imprimante", "chargeur", "cartes", "memoires", "boitier", "cables?"]
CAPITALS = ["FACTURE", "INVOICE", "DATE", "TVA", "TOTAL", "MONTANT", "DESIGNATION", "QTE", "PRIX", "CLIENT", "ADRESSE", "TEL", "FAX", "PAGE", "TIMBRE", "FODEC"]
FORMS = r"\b(?:SARL|SA\b|SUARL|SAS\b|EURL|SNC|GIE)\b"


def supplier(lines: Column) -> Column:
    """X27 without master data: the first of 20 lines up to its legal form; else the first of ten plausible lines before a table; else the capitals of the first line before it that has some."""
    trimmed = F.transform(lines, lambda x: F.trim(x))
    first = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(1))
    legal = F.transform(F.slice(trimmed, 1, 20), lambda x: squeeze(F.nullif(F.regexp_extract(x, f"(?U)^(.*?{FORMS})", 1), F.lit(""))))
    some = F.filter(trimmed, lambda x: x != "")
    is_table = lambda x: x.rlike(rx(signs(TABLE_WORDS)))

    def before(xs: Column) -> Column:
        at = F.array_position(F.transform(xs, is_table), True)
        return F.when(at > 0, F.slice(xs, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(xs)

    bad = lambda x: x.rlike(rx(any_of(NO_NAME) + r"|\d{8,}")) | x.rlike(rx(signs(GOODS))) | (F.length(x) < 3) | x.rlike(r"^[\d\s\-._|/]+$")
    clean = lambda x: F.trim(F.regexp_replace(x, "^[^A-Za-zÀ-ÿ]+", ""))
    label = lambda x: F.lower(x).rlike("^(facture|invoice|devis|bon\\s*de|n°|date|client|fournisseur)$")
    plausible = F.transform(F.slice(before(some), 1, 10), lambda x: F.when(~bad(x) & (F.length(clean(x)) >= 2) & ~label(clean(x)), F.substring(clean(x), 1, 80)))
    capitals = lambda x: F.array_join(F.regexp_extract_all(x, F.lit("\\b([A-ZÀ-Ü]{2,})\\b"), F.lit(1)), " ")
    loud = F.transform(before(F.slice(trimmed, 1, 12)), lambda x: F.when((F.length(capitals(x)) >= 3) & ~capitals(x).rlike(r"\b(?:" + "|".join(CAPITALS) + r")\b"), capitals(x)))
    good = lambda xs, n: first(F.transform(xs, lambda x: F.when(F.length(x) >= n, x)))
    return F.coalesce(good(legal, 3), first(plausible), good(loud, 3))


def known_supplier(docs: DataFrame, master: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name", least: float = 80) -> DataFrame:
    """Docs with supplier: the first name of the master data (by ord) that the text holds, else the first that is as similar as that to a line of the first 30, else by heuristics. master: a dimension (name, ord).

    A name in the text, and one as similar, has a word in common with it. Names meet the texts that may hold them over their
    rarest word; only texts that hold none meet all names that share a word.
    """
    names = master.where(F.length(F.trim(name)) >= 3).select(F.trim(name).alias("_name"), "ord").withColumn("_words", words(F.col("_name")))
    low = names.select("_name", "ord", F.explode("_words").alias("_word"))
    often = low.groupBy("_word").agg(F.count("*").alias("_n"))
    filed = low.join(often, "_word").groupBy("_name", "ord").agg(F.min_by("_word", F.struct("_n", "_word")).alias("_word"))
    said = docs.select(F.col(key).alias("_key"), F.lower(text).alias("_text"), words(F.col(text)).alias("_said"))
    # a name inside a text has all of its words there, but for the first and last, which may be cut off longer ones
    shorter = lambda w: F.sequence(F.lit(3), F.greatest(F.length(w) - 1, F.lit(3)))
    cuts = F.array_distinct(F.concat("_said", F.flatten(F.transform("_said", lambda w: F.filter(F.concat(F.transform(shorter(w), lambda n: F.left(w, n)), F.transform(shorter(w), lambda n: F.right(w, n))), lambda x: F.length(x) < F.length(w))))))
    keys = said.select("_key", F.explode(cuts).alias("_word"))
    met = keys.join(filed, "_word").select("_key", "_name", "ord").join(said, "_key")
    held = met.where(F.contains("_text", F.lower("_name")) & F.arrays_overlap("_said", words(F.col("_name"))))
    whole = held.groupBy("_key").agg(F.min_by("_name", "ord").alias("_known"))
    lines = F.slice(F.split(F.col(text), "\\r?\\n"), 1, 30)
    rest = docs.select(F.col(key).alias("_key"), F.transform(lines, lambda x: F.lower(F.trim(x))).alias("_lines"), F.explode(words(F.col(text))).alias("_word")).join(whole, "_key", "left_anti")
    near = rest.join(low, "_word").select("_key", "_lines", "_name", "ord").distinct().select("_key", "_name", "ord", F.explode("_lines").alias("_line")).where(F.col("_line") != "")
    # a part that is as similar shares so many of the shorter text's characters that one of them can't be much the longer
    near = near.withColumn("_score", partial_ratio_of(F.lower("_name"), F.col("_line"))).where(F.col("_score") >= least)
    similar = near.groupBy("_key").agg(F.min_by("_name", "ord").alias("_known"))
    found = whole.unionByName(similar)
    out = docs.join(found, docs[key] == found["_key"], "left")
    return out.withColumn("supplier", F.coalesce("_known", supplier(F.split(F.col(text), "\\r?\\n")))).drop("_key", "_known")


def invoice_number(text: Column) -> Column:
    """By a code of its own, behind labels, behind the sign for number; no year, at most 30 characters."""
    label = r"(?:num[eé]ro\s*(?:de\s*)?facture|n[°o]\s*(?:de\s*)?facture)"
    shapes = [V.VALUES["invoice code"], label + LINK + r"([A-Za-z0-9][A-Za-z0-9\-/]{1,25})", r"facture\s*n[°o]" + LINK + r"(\d{1,10})", r"\bn[°o]" + LINK + r"(\d{1,10})", r"\bfact[-\s]?(\d{2,})\b"]
    tries = [F.nullif(F.trim(F.regexp_extract(text, rx(p), 1)), F.lit("")) for p in shapes]
    return F.coalesce(*[F.when(~t.rlike("^(19|20)\\d{2}$") & (F.length(t) <= 30), t) for t in tries])


def missing_on_item(fields: Column, mandatory: list[str], spared: str) -> Column:
    """The mandatory item fields that a map lacks or holds empty; one of them is spared."""
    return F.array_compact(F.array(*[F.when(is_missing(F.try_element_at(fields, F.lit(f))), f) for f in mandatory if f != spared]))


def item_amount(text: Column) -> Column:
    """As the item form reads: unit and blanks dropped; with both separators the last one is decimal, a lone comma is."""
    s = F.regexp_replace(text, "(?i)[\\s\u00a0€$]|DT|TND", "")
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    plain = F.when(s.contains(",") & s.contains("."), F.when(comma_last, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit(""))))
    return F.coalesce(plain, F.replace(s, F.lit(","), F.lit("."))).try_cast("double")


def bill_amount(text: Column) -> Column:
    """As the bill's form reads: comma as dot, all else but digits dropped; 0 where that is no number."""
    return F.coalesce(F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "[^\\d.\\-]", "").try_cast("double"), F.lit(0.0))


def final_sheet_type(text: Column, n_fields: Column, words: list[str], least: int) -> Column:
    """A sheet's type holds by a word or by enough filled fields."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)) | (n_fields >= least)
