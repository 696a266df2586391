"""Resolution of names and codes against master data.

Fuzzy matches need a token in common, so candidates come from an equi-join on tokens; tokens that many names
share are held back for what rarer ones leave open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fuzzy import token_set_ratio_of, token_sort_ratio_of
from docloom.functions.numbers import amount_nlp
from docloom.functions.text import fold, once, rx, squeeze
from docloom.operators.contains import either_holds
from docloom.sources.tables import parted


def by_priority(df: DataFrame, master: DataFrame, rules: list[tuple[str, str]], out: str) -> DataFrame:
    """Df with the id of the first rule (column of df, column of master) that finds one row; master: id and the rules' columns. Each rule is an equi-join with a unique side."""
    got = []
    for k, (left, right) in enumerate(rules):
        side = master.where(F.col(right).isNotNull()).groupBy(F.col(right).alias(f"_k{k}")).agg(F.min("id").alias(f"_v{k}"))
        df = df.join(side, F.col(left) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        got.append(f"_v{k}")
    return df.withColumn(out, F.coalesce(*map(F.col, got))).drop(*got)


def words(text: Column) -> Column:
    """Upper-case words of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.upper(F.regexp_replace(text, "[^A-Za-zÀ-ÿ0-9 ]", " ")), " +"), lambda w: F.length(w) >= 3))


#: A key that more names hold is common: it is joined only for the texts that rarer keys don't settle.
COMMON = 50


#: Characters of a token's beginning by which it is looked for in names; no token has fewer.
HEAD = 3


def pieces(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """names (party, upper) by those of their stretches, with and without signs and blanks, that begin as a token of their length does: each token once for a name. tokens: distinct; only their beginnings and lengths, which an alphabet bounds, go to every task."""
    heads = tokens.groupBy(F.left("token", F.lit(HEAD)).alias("head")).agg(F.collect_set(F.length("token")).alias("lengths"))
    forms = names.select("party", "upper", F.explode(F.array_distinct(F.array("upper", bare(F.col("upper"))))).alias("form")).where(F.length("form") >= HEAD)
    starts = forms.select("*", F.explode(F.sequence(F.lit(1), F.length("form") - HEAD + 1)).alias("at")).withColumn("head", F.substring("form", F.col("at"), F.lit(HEAD)))
    found = starts.join(F.broadcast(heads), "head").select("party", "upper", "form", "at", F.explode("lengths").alias("n")).where(F.col("at") + F.col("n") - 1 <= F.length("form"))
    found = found.withColumn("token", F.substring("form", F.col("at"), F.col("n")))
    first = (F.position("token", "form") == F.col("at")) & ((F.col("form") == F.col("upper")) | ~F.contains("upper", "token"))
    return found.where(first).select("party", "upper", "token").join(tokens, "token", "left_semi")


def bare(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-ZÀ-Ü0-9]", "")


def coverage(tokens: Column, upper: Column) -> Column:
    """The share, in percent, of a name that the longest token inside it covers."""
    inside = F.filter(tokens, lambda t: F.contains(upper, t) | F.contains(bare(upper), t))
    return F.coalesce(F.array_max(F.transform(inside, F.length)), F.lit(0)) / F.length(bare(upper)) * 100


def party_match(docs: DataFrame, parties: DataFrame, text: str = "text", name: str = "name", key: str = "doc_id") -> DataFrame:
    """Key, party, token_score, fuzzy_score: the party with the best of 0.7 token coverage and 0.3 token-set ratio, if a token of the text inside its name covers 40 % of it, or the ratio is 70 or more with any token inside.

    Tokens meet names over those stretches of names that begin as tokens do, as an equi-join. Stretches of many names (COMMON) don't pair
    texts and names at first: they only bound what a name that shares nothing rarer could reach, and are
    joined for those texts whose best name so far lies below that bound. Bounds come from built-ins; the
    similarity is computed for what is above the best lower bound.
    """
    names = parties.select(F.col(name).alias("party"), F.upper(name).alias("upper")).distinct().where(F.length(bare(F.col("upper"))) > 0)
    said = docs.select(key, F.trim(squeeze(F.upper(F.regexp_replace(text, "[^A-Za-zÀ-ÿ0-9 ]", " ")))).alias("said"), words(F.col(text)).alias("tokens"))
    tokens = said.select(key, F.explode("tokens").alias("token"))
    listed = pieces(names, tokens.select("token").distinct())
    share = F.max(F.length("token") / F.length(bare(F.col("upper"))) * 100)
    per = listed.groupBy("token").agg(F.count("*").alias("n"), share.alias("reach"))
    rare = listed.join(per.where(F.col("n") <= COMMON).select("token"), "token").select("token", F.struct("party", "upper").alias("name"), F.lit(None).cast("double").alias("reach"))
    common = per.where(F.col("n") > COMMON).select("token", "reach")
    look = parted(rare.unionByName(common.select("token", F.lit(None).cast(rare.schema["name"].dataType).alias("name"), "reach")), "token")
    met = tokens.join(look, "token").groupBy(F.col(key).alias("_key")).agg(F.collect_set("name").alias("names"), F.max("reach").alias("reach"))
    seen = said.join(met, said[key] == met["_key"]).drop("_key")
    rated = F.transform("names", lambda n: F.struct(n["party"].alias("party"), n["upper"].alias("upper"), coverage(F.col("tokens"), n["upper"]).alias("token_score"), (F.size(F.array_except(F.split(n["upper"], " +"), F.split(F.col("said"), " +"))) == 0).alias("whole")))
    seen = once(seen, {"rated": rated})
    # a name whose words are all in the text has ratio 100
    floor = lambda n: F.when(n["whole"] | (n["token_score"] >= 30), n["token_score"] * 0.7 + F.when(n["whole"], 30.0).otherwise(0.0))
    seen = once(seen, {"floor": F.coalesce(F.array_max(F.transform("rated", floor)), F.lit(0.0))})
    cut = (F.col("token_score") * 0.7 + 30 >= F.col("floor")) & (F.col("token_score") > 0)
    pairs = seen.select(key, "said", "floor", F.inline("rated")).where(cut).select(key, "said", "party", "upper", "token_score")
    unsettled = seen.where(F.col("reach") * 0.7 + 30 > F.col("floor")).select(key, "said", "tokens", "floor", F.explode("tokens").alias("token"))
    wide = unsettled.join(listed.join(common.select("token"), "token"), "token").select(key, "said", "party", "upper", "floor", coverage(F.col("tokens"), F.col("upper")).alias("token_score")).where(cut)
    pairs = parted(pairs.unionByName(wide.select(key, "said", "party", "upper", "token_score")), key).distinct()
    scored = pairs.withColumn("fuzzy_score", token_set_ratio_of("said", "upper")).where("token_score >= 30 or fuzzy_score >= 60")
    best = scored.groupBy(key).agg(F.max_by(F.struct("party", "token_score", "fuzzy_score"), F.struct((F.col("token_score") * 0.7 + F.col("fuzzy_score") * 0.3).alias("s"), "party")).alias("b")).select(key, "b.*")
    return best.where("token_score >= 40 or (fuzzy_score >= 70 and token_score > 0)")


def item_match(lines: DataFrame, items: DataFrame, key: str = "line_id", reference: str = "reference", name: str = "name", least: float = 75) -> DataFrame:
    """By the supplier's part number, then by name, then the most similar name (sorted tokens, least or more) among those that share a word. Words of many names (COMMON) are tried only for lines that rarer words leave without an item. items: id, item_name, supplier_part_no."""
    exact = by_priority(lines, items, [(reference, "supplier_part_no"), (name, "item_name")], "item")
    rest = exact.where("item is null").select(key, F.col(name).alias("said"))
    side = items.select("id", "item_name", F.explode(words(F.col("item_name"))).alias("word"))
    often = side.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("word")

    def found(rest: DataFrame, side: DataFrame) -> DataFrame:
        said = rest.select(key, "said", F.explode(words(F.col("said"))).alias("word"))
        # common characters are at most those of the shorter name
        a, b = F.length("said"), F.length("item_name")
        pairs = said.join(side, "word").where(200 * F.least(a, b) >= least * (a + b)).select(key, "said", "id", "item_name").distinct()
        scored = pairs.withColumn("score", token_sort_ratio_of(F.upper("said"), F.upper("item_name"))).where(F.col("score") >= least)
        return scored.groupBy(F.col(key).alias("_line")).agg(F.max_by("id", F.struct("score", "id")).alias("similar"))

    first = found(rest, side.join(often, "word", "left_anti"))
    second = found(rest.join(first, rest[key] == first["_line"], "left_anti"), side.join(often, "word", "left_semi"))
    best = first.unionByName(second)
    return exact.join(best, exact[key] == best["_line"], "left").withColumn("item", F.coalesce("item", "similar")).drop("similar", "_line")


def zero_padding(codes: DataFrame, items: DataFrame, code: str = "code", item: str = "item_code") -> DataFrame:
    """Codes with resolved: the code itself or, of those with fewer zeros before its last digits, the one with most that exists."""
    head, zeros, tail = (F.regexp_extract(code, "^(.*?[^0-9])(0*)([1-9][0-9]*)$", k) for k in (1, 2, 3))
    tries = F.when(head != "", F.transform(F.sequence(F.lit(0), F.length(zeros)), lambda n: F.concat(head, F.repeat(F.lit("0"), n), tail))).otherwise(F.array(code))
    have = items.select(F.col(item).alias("try")).distinct()
    found = codes.select(code, F.explode(F.array_distinct(tries)).alias("try")).join(have, "try").groupBy(F.col(code).alias("_c")).agg(F.max_by("try", F.length("try")).alias("resolved"))
    return codes.join(found, codes[code] == found["_c"], "left").drop("_c")


def contained_match(df: DataFrame, names: DataFrame, value: str = "value", name: str = "name", least: int = 5, share: float = 0.6) -> DataFrame:
    """Df with found: the name that equals the value, else the one that equals it without accents, case and signs, else the longest name that holds it or is held by it, if the shorter has least characters and that share of the longer. names: a dimension; those that are held share a word with the value."""
    plain = lambda c: F.regexp_replace(fold(squeeze(c)), "[^a-z0-9]", "")
    side = names.select(F.col(name).alias("_name")).distinct().withColumn("_plain", plain(F.col("_name")))
    want = df.select(F.col(value).alias("_value")).where(F.trim(value) != "").distinct().withColumn("_said", plain(F.col("_value")))
    equal = want.join(side, F.col("_said") == F.col("_plain")).groupBy("_value").agg(F.max_by("_name", F.struct((F.col("_name") == F.col("_value")).alias("same"), "_name")).alias("_equal"))
    near = want.select("*", F.explode(words(F.col("_value"))).alias("_word")).join(side.select("*", F.explode(words(F.col("_name"))).alias("_word")), "_word")
    short, long = F.least(F.length("_said"), F.length("_plain")), F.greatest(F.length("_said"), F.length("_plain"))
    near = near.where((F.contains("_said", "_plain") | F.contains("_plain", "_said")) & (short >= F.greatest(F.lit(float(least)), share * long)))
    held = near.groupBy("_value").agg(F.max_by("_name", F.struct(F.length("_plain"), "_name")).alias("_held"))
    found = want.join(equal, "_value", "left").join(held, "_value", "left").select("_value", F.coalesce("_equal", "_held").alias("found"))
    return df.join(found, df[value] == found["_value"], "left").drop("_value")


def item_or_like(df: DataFrame, items: DataFrame, code: str = "code") -> DataFrame:
    """Df with item and exists: the item of that code, else the first in order whose name holds it as a word; null where neither is. items: id, item_name."""
    exact = items.select(F.col("id").alias("_id")).distinct()
    like = items.select("id", F.explode(words(F.col("item_name"))).alias("_word")).groupBy("_word").agg(F.min("id").alias("_like"))
    out = df.join(exact, df[code] == exact["_id"], "left").join(like, F.upper(df[code]) == like["_word"], "left")
    return out.withColumn("item", F.coalesce("_id", "_like")).withColumn("exists", F.col("item").isNotNull()).drop("_id", "_word", "_like")


def to_create(df: DataFrame, master: DataFrame, column: str, id_column: str) -> DataFrame:
    """The values that the master data lacks, once each."""
    return df.select(column).where(F.trim(column) != "").distinct().join(master.select(F.col(id_column).alias(column)), column, "left_anti")


def with_existence(df: DataFrame, master: DataFrame, column: str, id_column: str, flag: str = "exists") -> DataFrame:
    """Df with whether the key exists in the master data."""
    side = master.select(F.col(id_column).alias("_id")).distinct().withColumn("_there", F.lit(True))
    return df.join(side, df[column] == side["_id"], "left").withColumn(flag, F.coalesce("_there", F.lit(False))).drop("_id", "_there")


def label_match(labels: DataFrame, fields: DataFrame) -> DataFrame:
    """Labels with the field of equal name, else the last in order that contains the label or is contained in it. fields: (field, ord). Labels meet fields by docloom.operators.contains."""
    said = labels.select("label", fold(squeeze(F.col("label"))).alias("_a")).distinct()
    known = fields.withColumn("_b", fold(squeeze(F.col("field"))))
    near = either_holds(said, known, "_a", "_b").join(said, "_a").join(known, "_b")
    best = near.groupBy("label").agg(F.max_by("field", F.struct((F.col("_a") == F.col("_b")).cast("int").alias("same"), F.col("ord"))).alias("field"))
    return labels.join(best, "label", "left")


def compatible(field: Column, found: Column, form: Column) -> Column:
    """Struct (compatible, score) of an extracted value and the form's; an empty form value is neutral. Amounts by difference, dates by parts, texts by equality, containment and token-set ratio."""
    is_amount, is_date = field.rlike("montant|total|ttc|ht|tva|paid"), field.contains("date")
    say = lambda ok, s: F.struct(F.lit(ok).alias("compatible"), (s if isinstance(s, Column) else F.lit(float(s))).alias("score"))
    a, b = amount_nlp(found), amount_nlp(form)
    off = F.abs(a - b)
    date = lambda c: F.regexp_replace(F.trim(c), "\\s", "")
    parts = lambda c: F.array_distinct(F.split(date(c), "[/.\\-]"))
    x, y = fold(squeeze(found)), fold(squeeze(form))
    alike = token_set_ratio_of(x, y) / 100
    return (
        F.when(form.isNull() | (F.trim(form) == ""), say(True, 1.0))
        .when(is_amount & a.isNotNull() & b.isNotNull(), F.when(off < 0.02, say(True, 1.0)).when(off / F.greatest(b, F.lit(1.0)) < 0.05, say(True, 0.8)).otherwise(say(False, 0.1)))
        .when(is_date & ~is_amount, F.when(date(found) == date(form), say(True, 1.0)).when(F.substring(date(found), 1, 8) == F.substring(date(form), 1, 8), say(True, 0.85)).when(F.size(F.array_intersect(parts(found), parts(form))) >= 2, say(True, 0.65)).otherwise(say(False, 0.1)))
        .when(x == y, say(True, 1.0))
        .when(x.contains(y) | y.contains(x), say(True, 0.8))
        .otherwise(F.struct((alike >= 0.55).alias("compatible"), alike.alias("score")))
    )


#: Shapes of fields' values.
SHAPES = {**dict.fromkeys(["date", "date_livraison", "date_echeance", "date_commande"], r"\d{1,4}[/\-.]\d{1,2}[/\-.]\d{2,4}"), **dict.fromkeys(["montant_ttc", "montant_ht", "montant_tva", "montant"], r"\d[\d\s]*[,.]?\d*"), **dict.fromkeys(["numero_facture", "numero_bl", "numero_commande"], r"[A-Za-z0-9\-/]{3,}"), "numero_cheque": r"\d{5,}", **dict.fromkeys(["fournisseur", "client", "banque"], r"[A-Za-zÀ-ÿ\s]{3,40}")}


def shape_score(field: Column, value: Column) -> Column:
    """0.3 for a value of the field's shape, or of a field without one."""
    out = F.lit(0.3)
    for pattern in dict.fromkeys(SHAPES.values()):
        of = [f for f, p in SHAPES.items() if p == pattern]
        out = F.when(F.lower(field).isin(of), F.when(value.rlike(rx(pattern)), 0.3).otherwise(0.0)).otherwise(out)
    return out


def field_score(field: Column, value: Column, text: Column, form: Column) -> Column:
    """Presence in the text 0.4, shape 0.3, agreement with the form 0.3; at most 1."""
    v, t = F.lower(F.trim(value)), F.lower(F.coalesce(text, F.lit("")))
    is_amount, is_date = F.lower(field).rlike("montant|total|ttc|ht|tva"), F.lower(field).contains("date")
    tight = lambda c: F.replace(F.regexp_replace(c, "[\\s ]", ""), F.lit(","), F.lit("."))
    digits = lambda c: F.regexp_replace(c, "[^\\d]", "")
    share = lambda parts: F.when(F.size(parts) > 0, F.size(F.filter(parts, lambda p: F.contains(t, p) & (p != ""))) / F.size(parts)).otherwise(0.0)
    amount = F.when(tight(t).contains(tight(v)) | tight(t).contains(F.split(tight(v), "\\.")[0]), 0.4).when((F.length(digits(v)) >= 3) & digits(t).contains(digits(v)), 0.3).otherwise(0.0)
    date = F.when(F.regexp_replace(t, "\\s", "").contains(F.substring(v, 1, 8)), 0.4).otherwise(0.4 * share(F.split(v, "[/.\\-]")))
    other = 0.4 * share(F.filter(F.split(v, "[\\s\\-/]+"), lambda m: F.length(m) > 1))
    presence = F.when(t.contains(v), 0.4).when(is_amount, amount).when(is_date, date).otherwise(other)
    f = F.lower(F.trim(form))
    alike = token_set_ratio_of(f, v) / 100
    agrees = F.when(form.isNull(), 0.0).when(f == v, 0.3).when(v.contains(f) | f.contains(v), 0.15).when(is_amount, F.when(F.abs(amount_nlp(f) - amount_nlp(v)) < 0.01, 0.3).otherwise(0.0)).when(alike >= 0.8, 0.3).when(alike >= 0.55, 0.15).otherwise(0.0)
    return F.least(presence + shape_score(field, value) + agrees, F.lit(1.0))


def best_candidate(candidates: DataFrame, mapping: DataFrame, forms: DataFrame, least: float = 0.5, reject: float = 0.35, most: int = 20) -> DataFrame:
    """For each form the candidate with the best share of compatible fields among all mapped ones; one field under reject drops a candidate; beside it, for forms without one, the field that blocked most often.

    candidates: form_id, candidate_id, confidence, doc_type, text, fields (map); mapping: doc_type, ord, field, name; forms: form_id, values (map). The cap of candidates is the operator's own: those with the highest confidence.
    """
    w = Window.partitionBy("form_id").orderBy(F.desc("confidence"), "candidate_id")
    top = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    rows = top.join(mapping, "doc_type").join(forms, "form_id")
    value, form = F.try_element_at("fields", F.col("field")), F.try_element_at("values", F.col("name"))
    rows = rows.select("form_id", "candidate_id", "rank", "ord", "field", F.when(value.isNotNull() & (value != ""), field_score(F.col("field"), value, F.col("text"), form)).alias("score"))
    per = rows.groupBy("form_id", "candidate_id", "rank").agg(F.min("score").alias("worst"), (F.count_if(F.col("score") >= reject) / F.count("*")).alias("ratio"), F.min_by("field", F.when(F.col("score") < reject, F.col("ord"))).alias("blocking"))
    valid = (F.coalesce(F.col("worst"), F.lit(1.0)) >= reject) & (F.col("ratio") >= least)
    blocked = per.where("blocking is not null").groupBy("form_id", "blocking").agg(F.count("*").alias("n"), F.min("rank").alias("first")).groupBy("form_id").agg(F.max_by("blocking", F.struct("n", -F.col("first"))).alias("blocking_field"))
    best = per.groupBy("form_id").agg(F.max_by(F.when(valid, F.col("candidate_id")), F.when(valid, F.struct("ratio", -F.col("rank")))).alias("candidate_id"), F.max(F.when(valid, F.col("ratio"))).alias("ratio"))
    return best.join(blocked, "form_id", "left").withColumn("blocking_field", F.when(F.col("candidate_id").isNull(), F.col("blocking_field")))


def enriched(fields: Column, entities: Column) -> Column:
    """E5: map of field to struct (value, confidence, source): extracted values at 0.9, gaps filled from the entities."""
    have = F.transform_values(fields, lambda k, v: F.struct(v.alias("value"), F.lit(0.9).alias("confidence"), F.lit("regex").alias("source")))
    largest = F.array_max(F.transform(entities["amounts"], lambda a: F.struct(amount_nlp(a).alias("n"), a.alias("a"))))["a"]
    add = [("fournisseur", F.try_element_at(entities["companies"], F.lit(1)), 0.5), ("date", F.try_element_at(entities["dates"], F.lit(1)), 0.55), ("montant_ttc", largest, 0.4), ("numero_facture", F.try_element_at(entities["references"], F.lit(1)), 0.4)]
    more = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit("nlp_ner").alias("source")).alias("value")) for n, v, c in add]), lambda e: e["value"]["value"].isNotNull() & ~F.array_contains(F.map_keys(fields), e["key"]))
    return F.map_concat(have, F.map_from_entries(more))
