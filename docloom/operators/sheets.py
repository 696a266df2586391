"""Item sheets, bills of materials, invoice lines and totals from text."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.numbers import BLANK, amount_bom, scan_amounts
from docloom.functions.phrases import any_of, signs, words
from docloom.functions.text import before_label, chain, first_group, let, once, part_code, rx, squeeze, unit
from docloom.operators.labels import Sheet, sheet

#: Shapes of values, by kind: up to a comma, bar, tab or line end for words.
_WORDS, _NUMBER, _CODE, _UNIT = r"([^\n\t,|]{2,80})", r"(\d[\d.,]*)", r"([A-Z0-9][\w\-]{0,39})", r"([A-Za-z]\w{0,9})"
KINDS = {"words": _WORDS, "line": r"([^\n\t]{2,140})", "number": _NUMBER, "code": _CODE, "unit": _UNIT, "digits": r"(\d{8,14})", "count": r"(\d{1,4})", "yes": r"(oui|non|yes|no|1|0)"}
#: Fields of an item sheet: name, labels (phrases), kind of the value, confidence. A flag holds where its label stands.
ITEM_LABELS = [
    ("item_code", ["article :", "code article :", "référence article :"], "code", 0.9),
    ("barcode", ["code ean :", "ean :", "code barres? :"], "digits", 0.9),
    ("custom_designation2", ["désignation 2 :"], "line", 0.85),
    ("custom_designation3", ["désignation 3 :"], "line", 0.85),
    ("description", ["désignation :", "description :"], "line", 0.8),
    ("custom_cle_recherche", ["clé recherche :"], "line", 0.85),
    ("custom_ligne_produit", ["ligne de produit :", "ligne produit :"], "line", 0.85),
    ("custom_norme", ["norme :"], "words", 0.85),
    ("custom_ref_douaniere", ["référence douanière :", "réf. douanière :"], "code", 0.85),
    ("custom_acces_gestionnaire", ["accès gestionnaire :"], "words", 0.8),
    ("custom_statut_article", ["statut :"], "words", 0.9),
    ("custom_gestion_stock", ["gestion stock :"], "words", 0.88),
    ("custom_gestion_lot_mode", ["gestion lot :"], "words", 0.85),
    ("custom_gestion_serie_mode", ["gestion série :"], "words", 0.85),
    ("custom_gestion_peremption", ["gestion de péremption :", "gestion péremption :"], "words", 0.82),
    ("custom_mode_gestion", ["mode gestion :"], "words", 0.85),
    ("custom_tracabilite", ["traçabilité :"], "words", 0.82),
    ("custom_nature", ["nature :"], "words", 0.8),
    ("custom_carac_technique", ["caractéristique technique :", "carac technique :"], "words", 0.8),
    ("stock_uom", ["unité de stock :", "unité stock :"], "unit", 0.85),
    ("purchase_uom", ["unité d'achat :", "unité achat :"], "unit", 0.85),
    ("sales_uom", ["unité de vente :", "unité vente :"], "unit", 0.85),
    ("weight_uom", ["unité poids :"], "unit", 0.85),
    ("custom_uom_conditionnement", ["unité de conditionnement :", "unité conditionnement :"], "unit", 0.85),
    ("custom_uom_stat", ["unité statistique :"], "unit", 0.82),
    ("custom_uom_cee", ["unité cee :"], "unit", 0.82),
    ("custom_unite_volume", ["unité volume :"], "unit", 0.82),
    ("custom_unite_jours", ["unité pour les jours :"], "unit", 0.78),
    ("custom_unite_heures", ["unité pour les heures :"], "unit", 0.78),
    ("custom_unite_minutes", ["unité pour les minutes :"], "unit", 0.78),
    ("weight_per_unit", ["poids de l'us :"], "number", 0.82),
    ("custom_volume_us", ["volume de l'us :"], "number", 0.82),
    ("custom_densite", ["densité :"], "number", 0.82),
    ("custom_format_etiquette_us", ["format étiquette us :"], "words", 0.78),
    ("custom_long_barre", ["long barre :", "long barre/cor :"], "number", 0.8),
    ("custom_epaisseur", ["épaisseur :"], "number", 0.8),
    ("custom_dim_long", ["longueur :"], "number", 0.8),
    ("custom_dim_larg", ["largeur :"], "number", 0.8),
    ("custom_forme", ["forme :"], "words", 0.78),
    ("custom_type_tole", ["type tôle :"], "words", 0.78),
    ("custom_film", ["film :"], "words", 0.78),
    ("custom_couleur_sup", ["couleur sup. :"], "words", 0.78),
    ("custom_couleur_inf", ["couleur inf. :"], "words", 0.78),
    ("custom_coef_ua_us", ["coefficient ua-us :", "coef ua-us :"], "number", 0.85),
    ("custom_coef_uv_us", ["coefficient uv-us :", "coef uv-us :"], "number", 0.85),
    ("custom_coef_ustat_us", ["coefficient ustat-us :", "coef ustat-us :"], "number", 0.82),
    ("custom_coef_ucee_us", ["coefficient ucee-us :", "coef ucee-us :"], "number", 0.82),
    ("custom_coef_uc_ua", ["coefficient uc-ua :", "coef uc-ua :"], "number", 0.82),
    ("custom_coef_jour_heures", ["coefficient jour-heures? :", "coef jour-heures? :"], "number", 0.78),
    ("custom_coef_frais_approche", ["coefficient frais approche :", "coef frais approche :"], "number", 0.8),
    ("custom_coef_dlu", ["coefficient dlu :"], "number", 0.8),
    ("custom_titre_pct", ["titre (en %) :", "titre :"], "number", 0.8),
    ("custom_delai_peremption", ["délai péremption :", "délai de péremption :"], "number", 0.8),
    ("custom_delai_recontrol", ["délai recontrôle :"], "number", 0.8),
    ("custom_statut_peremption", ["statut péremption :"], "words", 0.78),
    ("custom_statut_recontrol", ["statut recontrôle :"], "words", 0.78),
    ("custom_compteur_lot", ["compteur lot :"], "code", 0.82),
    ("custom_compteur_serie", ["compteur série :"], "code", 0.82),
    ("custom_article_remplacement", ["article remplacement :"], "code", 0.82),
    ("custom_article_substitution", ["article substitution :"], "code", 0.82),
    ("custom_date_substitution", ["date substitution :"], "words", 0.78),
    ("custom_code_comptable", ["code comptable :"], "code", 0.85),
    ("custom_libelle_comptable", ["libellé comptable :"], "words", 0.8),
    ("custom_niveau_taxe", ["niveau taxe :", "niveau de taxe :"], "words", 0.82),
    ("custom_libelle_taxe", ["libellé taxe :"], "words", 0.8),
    ("custom_famille_cout", ["famille de coût :", "famille coût :"], "words", 0.8),
    ("valuation_method", ["méthode valorisation :", "méthode de valorisation :"], "words", 0.82),
    ("standard_rate", ["prix de base :", "prix base :", "prix de vente ht :", "prix unitaire ht :"], "number", 0.85),
    ("last_purchase_rate", ["prix achat ht :", "dernier prix achat :"], "number", 0.82),
    ("valuation_rate", ["prix de revient :", "coût standard :"], "number", 0.8),
    ("custom_prix_theorique", ["prix théorique :"], "number", 0.82),
    ("custom_prix_plancher", ["prix plancher :"], "number", 0.82),
    ("custom_marge_minimale", ["marge minimale :"], "number", 0.82),
    ("min_order_qty", ["quantité minimale :", "qté minimum achat :", "qté min. achat :"], "number", 0.8),
    ("custom_qte_max_vente", ["quantité maximale :"], "number", 0.8),
    ("custom_qte_directe", ["qté directe :"], "number", 0.78),
    ("custom_tolerance_reliquat", ["tolérance reliquat % :", "tolérance reliquat :"], "number", 0.8),
    ("warranty_period", ["garantie en mois :"], "count", 0.82),
    ("safety_stock", ["stock sécurité :", "stock de sécurité :"], "number", 0.85),
    ("custom_stock_max", ["stock maximum :"], "number", 0.85),
    ("custom_seuil_reappro", ["seuil de réapprovisionnement :", "seuil de réappro :"], "number", 0.85),
    ("custom_qte_mini_reappro", ["qté mini réapprovisionnement :", "qté mini réappro :"], "number", 0.85),
    ("custom_taille_lot", ["taille du lot :"], "number", 0.82),
    ("custom_categorie_abc", ["catégorie abc :"], "words", 0.82),
    ("custom_mode_inventaire", ["mode inventaire :"], "words", 0.82),
    ("custom_mode_retrait", ["mode retrait de stock :", "mode retrait :"], "words", 0.82),
    ("custom_gestion_emplacement", ["gestion emplacement :"], "yes", 0.82),
    ("custom_acheteur_approv", ["acheteur/approv. :", "acheteur / approv. :"], "words", 0.8),
    ("custom_sites_appro", ["sites? d'approvisionnement :", "sites? appro :"], "words", 0.78),
    ("custom_fournisseur_principal", ["fournisseur principal :", "fournisseur :"], "words", 0.82),
    ("custom_ref_fournisseur", ["article fournisseur :", "réf. fournisseur :"], "code", 0.82),
    ("custom_ean_fournisseur", ["code ean fournisseur :"], "digits", 0.82),
    ("custom_majoration_cee", ["majoration cee :"], "number", 0.78),
    ("custom_delai_sous_traitance", ["délai sous-traitance :"], "number", 0.78),
    ("custom_alt_sous_traitance", ["alternative sous-traitance :", "alt sous-traitance :"], "words", 0.78),
    ("custom_blocage_fournisseur", ["blocage :"], "words", 0.78),
    ("custom_three_way_match", ["three-way match :"], "yes", 0.78),
    ("custom_conditionnement_achat", ["conditionnement :"], "words", 0.78),
    ("custom_priorite_fournisseur", ["priorité :"], "count", 0.78),
    ("custom_note_qualite", ["note qualité :"], "number", 0.78),
    ("custom_soumis_controle", ["soumis à contrôle :"], "words", 0.78),
    ("custom_frequence_controle", ["fréquence :"], "number", 0.78),
    ("custom_numero_controle", ["numéro contrôle :"], "number", 0.78),
    ("custom_fiche_qualite", ["fiche qualité :"], "words", 0.78),
    ("custom_categorie_coupon", ["catégorie de coupon :"], "words", 0.78),
    ("custom_contrat_pret", ["contrat de prêt :"], "words", 0.78),
    ("custom_contrat_garantie", ["contrat de garantie :"], "words", 0.78),
    ("custom_contrat_service", ["contrat de service :"], "words", 0.78),
    ("custom_debit_points", ["débit de points :"], "number", 0.78),
    ("custom_jetons_crediter", ["jetons? à créditer :"], "number", 0.78),
    ("custom_frequence_points", ["toutes les"], "words", 0.75),
    ("custom_type_article_sav", ["type d'article :"], "words", 0.78),
    ("custom_article_client", ["article-client :"], "code", 0.82),
    ("custom_designation_client", ["désignation client :"], "words", 0.82),
    ("custom_designation_remplacement", ["désignation remplacement :"], "words", 0.78),
    ("custom_soumis_deb", ["soumis deb", "soumis à la deb"], "flag", 0.78),
    ("custom_modifiable_uv", ["modifiable"], "flag", 0.75),
    ("custom_immobilisable", ["immobilisable"], "flag", 0.8),
    ("custom_autorisation_pret", ["autorisation prêt"], "flag", 0.78),
    ("custom_contremarque_vente", ["contremarque"], "flag", 0.78),
    ("custom_texte_vente", ["texte vente"], "flag", 0.78),
    ("custom_texte_production", ["texte production"], "flag", 0.78),
    ("custom_texte_preparation", ["texte préparation"], "flag", 0.78),
    ("custom_creation_parc_client", ["création de parc client"], "flag", 0.78),
    ("custom_valeur_nulle_points", ["valeur nulle prise en compte"], "flag", 0.75),
    ("custom_sortie_stock_defaut", ["sortie de stock par défaut"], "flag", 0.78),
    ("custom_inter_sites_client", ["inter-sites?"], "flag", 0.78),
    ("custom_infos_produit", ["informations produit"], "flag", 0.78),
    ("custom_stock_negatif", ["stock négatif"], "flag", 0.78),
]
#: The head of a bill of materials.
BOM_LABELS = [
    ("quantity", ["quantité produite", "quantité :", "qty produite"], "number", 0.85),
    ("uom", ["udm de l'article :", "udm de l'article", "unité de mesure", "unité :", "uom", "udm"], "unit", 0.8),
    ("conversion_rate", ["taux de change", "conversion rate", "taux conversion"], "number", 0.8),
    ("scrap_percentage", ["taux de perte processus (%)", "taux de perte processus", "scrap %", "scrap", "rebut", "perte"], "number", 0.8),
    ("raw_material_cost", ["coût matière :", "coût des matières premières", "coût matière"], "number", 0.8),
    ("operating_cost", ["coût opération :", "coût des opérations", "coût opération"], "number", 0.8),
    ("total_cost", ["coût total :", "coût total"], "number", 0.8),
]
#: What a bill's prices are based on, and what its material is transferred for, by words.
COST_BASIS = {"valorisation": "Valuation Rate", "valuation": "Valuation Rate", "dernier": "Last Purchase Rate", "last": "Last Purchase Rate", "liste": "Price List", "price list": "Price List"}
TRANSFERRED = {"ordre": "Work Order", "work order": "Work Order", "carte": "Job Card", "job card": "Job Card"}
CURRENCIES, NO_CURRENCY = ["TND", "EUR", "USD", "MAD", "GBP"], ["NOM", "UDM", "QTE", "BOM", "OCR"]


def by_labels(text: Column, rules: list[tuple], profile: str = "item") -> Column:
    """Map of field to struct (value, confidence): of each field the value behind the first of its labels that has one. A line that names another label ends a value. All labels are found in one pass; only what stands behind them is worked on."""

    def typed(e: Column) -> Column:
        v, kind = squeeze(e["value"]), e["kind"]
        value = F.when(kind.isin("words", "line"), chain(before_label(v))).when(kind == "unit", unit(v, profile)).when(kind == "number", amount_bom(v).cast("string")).when(kind == "yes", F.lower(v).isin("oui", "yes", "1").cast("int").cast("string")).otherwise(v)
        return F.struct(e["k"].alias("k"), F.struct(F.nullif(value, F.lit("")).alias("value"), e["confidence"].alias("confidence")).alias("v"))

    return F.map_from_entries(F.filter(F.transform(sheet(lambda: Sheet(rules, KINDS))(text), typed), lambda e: e["v"]["value"].isNotNull()))


#: Further labels of an item sheet.
MORE_LABELS = [
    ("item_name", ["désignation 1 :", "nom article :", "nom de l'article :"], "line", 0.85), ("item_group", ["groupe d'article :", "item group :"], "words", 0.85), ("custom_type_composition", ["type de composition :", "type composition :"], "words", 0.78),
    ("custom_alt_nomenclature_sav", ["alternative nomenclature sav :", "alt nomenclature sav :"], "words", 0.78), ("custom_contremarque_fournisseur", ["contremarque fournisseur :"], "yes", 0.78), ("custom_methode_valorisation", ["méthode valorisation :", "méthode de valorisation :"], "words", 0.82),
]


def item_fields(text: Column) -> Column:
    """X14 with its rules across fields: the labelled fields; a status tells whether the item is disabled, and the other way round; whether stock, lots and series are kept from the ways they are managed; name and description stand in for each other; levels of sites (site_blocks) overrule those of the sheet, the last that isn't zero."""

    def whole(f: Column, sites: Column) -> Column:
        v = lambda n: F.try_element_at(f, F.lit(n))["value"]
        conf = lambda n, other: F.coalesce(F.try_element_at(f, F.lit(n))["confidence"], F.lit(other))
        low = lambda n: F.lower(v(n))
        off = low("custom_statut_article").rlike("inactif|non actif|désactivé|desactive|bloqué|obsolète")
        kept = lambda n: F.when(v(n).isNotNull(), F.when(low(n).rlike("^(non|aucun|pas)"), "0").otherwise("1"))
        last = lambda n: F.try_element_at(F.filter(F.transform(sites, lambda s: s[n]), lambda x: x != 0), F.lit(-1)).cast("string")
        more = [
            ("disabled", F.when(v("custom_statut_article").isNotNull(), F.when(off, "1").otherwise("0")), conf("custom_statut_article", 0.8)), ("is_stock_item", kept("custom_gestion_stock"), conf("custom_gestion_stock", 0.8)), ("has_batch_no", kept("custom_gestion_lot_mode"), conf("custom_gestion_lot_mode", 0.8)),
            ("has_serial_no", kept("custom_gestion_serie_mode"), conf("custom_gestion_serie_mode", 0.8)), ("item_name", F.when(v("item_name").isNull(), v("description")), F.lit(0.75)), ("description", F.when(v("description").isNull(), v("item_name")), F.lit(0.7)),
            *[(name, last(of), F.lit(0.85)) for name, of in (("safety_stock", "safety_stock"), ("custom_stock_max", "stock_max"), ("custom_seuil_reappro", "reorder_level"), ("custom_qte_mini_reappro", "reorder_qty"))],
        ]
        added = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.struct(x.alias("value"), c.alias("confidence")).alias("v")) for k, x, c in more]), lambda e: e["v"]["value"].isNotNull())
        return F.map_concat(F.map_filter(f, lambda k, _: ~F.exists(added, lambda e: e["k"] == k)), F.map_from_entries(added))

    return let(F.struct(by_labels(text, [*ITEM_LABELS, *MORE_LABELS]).alias("f"), site_blocks(text).alias("s")), lambda x: whole(x["f"], x["s"]))


def _found(name: str, value: Column, confidence: float) -> Column:
    return F.struct(F.lit(name).alias("k"), F.struct(F.nullif(value, F.lit("")).alias("value"), F.lit(confidence).alias("confidence")).alias("v"))


def _of(table: dict[str, str], said: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(said), F.lit(w)), name) for w, name in table.items()])


def bill_head(text: Column) -> Column:
    """Map of field to struct (value, confidence): the bill's number, its item, company, quantity, unit, currency, routing, basis of costs, transfer, rates, losses, costs and flags."""
    g = lambda p, k=1: first_group(text, rx(p, True), k)
    item = r"(?:article|item)\s*[:\-]?\s+([A-Z0-9]+)\s*[—\-–]+\s*(\S[^\n]{0,79})"
    company = chain(F.regexp_replace(g(r"(?:soci[eé]t[eé]\s*[:\-]?|company\s*[:\-]?)\s*((?:groupe\s+)?[^\n:]{3,80})"), rx(r"\s*(?:est\s+(?:actif|d[eé]faut)|udm|unit[eé]|quantit[eé]|devise|taux|routing|gamme|transfert|statut|nomenclature|bom).*$"), ""))
    said_currency = F.upper(g(r"devise\s*[:\-]?\s*([A-Z]{2,4})\b"))
    listed = F.coalesce(*[F.when(F.upper(text).rlike(rf"\b{c}\b"), c) for c in CURRENCIES])
    flag = lambda p: F.lower(g(p)).isin("oui", "yes").cast("int").cast("string")
    rows = [
        _found("name", F.upper(g(r"\b(BOM-\d{4}-\d{3,})\b")), 0.95), _found("name", F.upper(g(r"nomenclature\s+([A-Z0-9\-]*\d[A-Z0-9\-]{3,19})")), 0.70),
        _found("item", g(item), 0.85), _found("item", g(r"^article\s*[:\-]\s*([A-Z0-9]{2,12})"), 0.60), _found("item_name", chain(g(item, 2)), 0.80), _found("company", company, 0.80),
        _found("currency", F.when(~said_currency.isin(NO_CURRENCY), said_currency), 0.90), _found("currency", listed, 0.65),
        _found("routing", g(r"(?:gamme\s*\(routing\)|routing\s*[:\-]?|route\s*[:\-]?|gamme\s*[:\-]?)\s+([\w\-]{3,})"), 0.75),
        _found("rm_cost_as_per", _of(COST_BASIS, g(r"(?:prix\s+bas[eé]\s+sur|(?:rm\s+)?cost\s+as\s+per)\s+([^\n]+)")), 0.85),
        _found("transfer_material_against", _of(TRANSFERRED, g(r"(?:transfert\s+mat[eé]riel|transfer\s+material)\s*[:\-]?\s*([^\n]+)")), 0.80),
        _found("is_active", flag(r"est\s+actif\s+(oui|non|yes|no)"), 0.90), _found("is_active", F.when(text.rlike(rx(r"statut\s*[:|]\s*actif")), "1"), 0.85), _found("is_active", F.when(text.rlike(rx(r"\bactif\b")), "1"), 0.60),
        _found("is_default", flag(r"est\s+d[eé]faut\s+(oui|non|yes|no)"), 0.90), _found("is_default", F.when(text.rlike(rx(r"par\s+d[eé]faut")), "1"), 0.75),
    ]
    some = F.filter(F.array(*rows), lambda e: e["v"]["value"].isNotNull())
    # the first of several ways to a field counts
    firsts = F.filter(some, lambda e, i: ~F.exists(F.slice(some, F.lit(1), i), lambda b: b["k"] == e["k"]))
    return F.map_concat(F.map_from_entries(firsts), by_labels(text, BOM_LABELS, "bom"))


def basic_item(text: Column) -> Column:
    """Map of the fields that a plain reading finds where the sheet's own labels fail, at a confidence of 0.6."""
    rules = [
        ("item_code", ["référence :", "réf. :", "code :", "sku :", "part number :"], "code", 0.6), ("item_name", ["désignation :", "nom :", "name :"], "line", 0.6), ("description", ["description :"], "line", 0.6),
        ("stock_uom", ["unité :", "uom :", "udm :"], "unit", 0.6), ("standard_rate", ["prix ht :", "prix unitaire :", "prix :", "price :"], "number", 0.6), ("item_group", ["catégorie :", "groupe :", "group :"], "words", 0.6),
        ("brand", ["marque :", "brand :"], "words", 0.6), ("barcode", ["ean :", "code barres? :", "barcode :"], "digits", 0.6),
    ]
    return by_labels(text, rules)


#: Shapes of a component's line: place, code, name, quantity, unit; then another quantity and unit, a factor, a price, where they stand.
_START, _AMOUNT, _IN = r"(\d{1,3})\s+([A-Za-z]*[A-Z0-9][\w\-]{1,})\s+(\S.*?)\s+", r"(\d+(?:[.,]\d+)?)", r"([\p{L}²³°/%]{1,10}\d?)"
COMPONENT = rf"^\s*{_START}{_AMOUNT}\s+{_IN}(?:\s+{_AMOUNT}\s+{_IN}\s+{_AMOUNT})?(?:\s+{_AMOUNT})?\s*$"
#: The same eight values where a text has lost its lines.
RUNNING = rf"\b(\d{{1,3}})\s+([A-Za-z]*[0-9][\w\-]{{0,14}})\s+([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9\-/,.]*(?:\s+[A-Za-zÀ-ÿ0-9\-/,.]+)*?)\s+{_AMOUNT}\s+(Unité|Unite|Kg|m²|m³|[A-Z]{{1,6}})\s+{_AMOUNT}\s+(Unité|Unite|Kg|m²|m³|[A-Z]{{1,6}})\s+{_AMOUNT}"
#: Phrases that begin the list of components, and that end it.
LIST_BEGINS, LIST_ENDS = ["composants?", "bom items?", "bill of materials?"], ["paramètres de fabrication", "résumé des coûts", "manufacturing parameters", "cost summary", "opérations", "gamme de fabrication"]


def component_section(text: Column) -> Column:
    """The part of a text between the phrases that begin and end a list of components; all of it where none begins one."""
    behind = F.nullif(F.regexp_extract(text, "(?s)" + rx(any_of(LIST_BEGINS) + "(.*)$"), 1), F.lit(""))
    return F.regexp_replace(F.coalesce(behind, text), "(?s)" + rx(any_of(LIST_ENDS) + ".*$"), "")


def components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, item_code, item_name, qty, uom, qty_per_unit, stock_uom, conversion_factor, rate): a row for each line of a component list; where lines are lost, for each run of eight values in the joined text, which counts first."""
    mark = "\u0001"
    parted = lambda c, pattern, n: F.regexp_replace(c, rx(pattern), mark.join(["", *[f"${k}" for k in range(1, n + 1)]]))
    df = once(df, {"_part": component_section(F.col(text))})
    lines = F.filter(F.transform(F.split("_part", "\\r?\\n"), lambda x: parted(x, COMPONENT, 9)), lambda x: x.startswith(mark))
    df = once(df, {"_hits": lines})
    runs = F.transform(F.regexp_extract_all(F.trim(F.regexp_replace("_part", "\\s+", " ")), F.lit(rx(RUNNING)), F.lit(0)), lambda x: parted(x, RUNNING, 8))
    rows = df.select(key, F.explode(F.when(F.size("_hits") == 0, runs).otherwise(F.col("_hits"))).alias("_line"))
    rows = once(rows, {"_v": F.split("_line", mark)})
    g = lambda k: F.nullif(F.get("_v", F.lit(k)), F.lit(""))
    amount = lambda k, default: F.coalesce(amount_bom(g(k)), default)
    rows = once(rows, {"qty": amount(4, F.lit(1.0)), "uom": unit(F.get("_v", F.lit(5)), "bom")})
    return rows.select(
        key, g(1).cast("int").alias("idx"), part_code(g(2)).alias("item_code"), F.trim(g(3)).alias("item_name"), "qty", "uom", amount(6, F.col("qty")).alias("qty_per_unit"), F.when(g(7).isNotNull(), unit(g(7), "bom")).otherwise(F.col("uom")).alias("stock_uom"),
        amount(8, F.lit(1.0)).alias("conversion_factor"), amount(9, F.lit(0.0)).alias("rate"),
    )


def site_blocks(text: Column) -> Column:
    """Array of struct (code, safety_stock, stock_max, reorder_level, reorder_qty): a text cut before each site."""
    blocks = F.filter(F.split(text, "(?i)(?=Stock\\s+site\\s*[:\\-])"), lambda b: b.rlike("(?i)^Stock\\s+site"))
    n = lambda b, p: amount_bom(first_group(b, rx(p + r"\s*:\s*([\d.,]+)")))
    return F.transform(blocks, lambda b: F.struct(first_group(b, rx(r"^stock\s+site\s*[:\-]\s*(\S+)")).alias("code"), n(b, r"stock\s*(?:de\s*)?s[ée]curit[ée]").alias("safety_stock"), n(b, r"stock\s*maxi\w*").alias("stock_max"), n(b, r"seuil\s*(?:de\s*)?r[ée]appro\w*").alias("reorder_level"), n(b, r"quantit[ée]\s*[ée]co\w*").alias("reorder_qty")))


#: Codes of item groups, groups by name, and words that speak for a group.
GROUP_CODES = {"CONS": "Consommables", "ACCP": "Accessoires", "AACP": "Accessoires", "PIEC": "Pièces détachées", "MATO": "Matières premières", "EMBA": "Emballage", "OUTL": "Outillage", "EQUI": "Équipement", "PROD": "Produits finis", "ELEC": "Électricité", "INFO": "Informatique", "RESEAU": "Réseau"}
GROUPS = ["Informatique", "Bureautique", "Électronique", "Mobilier", "Fournitures de bureau", "Consommables", "Pièces détachées", "Outillage", "Matières premières", "Produits finis", "Emballage", "Équipement", "Accessoires", "Câblage", "Réseau", "Sécurité", "Électricité", "Plomberie", "Mécanique", "Chimie", "Hygiène", "Alimentaire", "All Item Groups"]
GROUP_WORDS = {
    "Informatique": ["ordinateur", "pc ", "laptop", "notebook", "processeur", "cpu", "ram", "disque dur", "ssd", "nvme", "carte mère", "gpu", "carte graphique", "écran", "moniteur", "clavier", "souris", "imprimante", "scanner", "usb", "hdmi", "vga"],
    "Réseau": ["switch", "routeur", "router", "wifi", "ethernet", "rj45", "fibre", "sfp", "access point", "borne wifi", "modem"],
    "Électronique": ["arduino", "raspberry", "capteur", "sensor", "module", "transistor", "condensateur", "résistance", "diode", "led", "alimentation", "transformateur", "onduleur", "ups"],
    "Mobilier": ["bureau", "chaise", "armoire", "étagère", "table", "caisson", "classeur", "meuble"],
    "Fournitures de bureau": ["stylo", "crayon", "ramette", "papier", "agrafeuse", "classeur", "pochette", "reliure", "enveloppe", "toner", "cartouche", "ruban"],
    "Outillage": ["perceuse", "visseuse", "meuleuse", "scie", "marteau", "tournevis", "clé", "pince", "niveau", "mètre"],
    "Câblage": ["câble", "cable", "fil", "gaine", "conduit", "prise", "connecteur", "fiche", "cordon"],
    "Sécurité": ["caméra", "alarme", "détecteur", "badge", "lecteur", "contrôle d'accès", "surveillance", "dvr", "nvr"],
    "Consommables": ["encre", "toner", "cartouche", "ruban", "étiquette", "papier thermique", "film", "colle", "lubrifiant"],
    "Électricité": ["disjoncteur", "fusible", "tableau", "câble électrique", "prise électrique", "interrupteur", "contacteur", "relais"],
}


def item_group(text: Column) -> Column:
    """C14: struct (group, confidence): the code behind a category's label, the name behind a group's label (on the next line first), a group named in the text, the longest first, or the first group that a word speaks for. Data sheets tell by labels only. Null without any."""
    code = F.upper(first_group(text, rx(r"cat[eé]gorie\s*:\s*([A-Z0-9]{2,10})\b")))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUP_CODES.items() for x in kv]), code)
    cut = lambda v: F.substring(chain(F.split(v, r"\s*\(|\s{2,}|\t")[0]), 1, 80)
    label = r"(?:groupe\s*d['’ ]article|item\s*group)\s*\*?"
    below, beside = cut(first_group(text, rx(label + r"[^\n]*\n\s*([^\n]+)"))), cut(first_group(text, rx(label + r"\s*[:\-]?[ \t]*([^\n]+)")))
    fits = lambda v: F.when((F.length(v) >= 5) & ~F.upper(v).isin(*GROUP_CODES), v)
    low = F.lower(text)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(g.lower())), g) for g in sorted(GROUPS, key=len, reverse=True)])
    spoken = F.coalesce(*[F.when(low.rlike(rx("|".join(rf"\b{w}\b" for w in ws))), g) for g, ws in GROUP_WORDS.items()])
    data_sheet = text.rlike(rx(r"\btechnical\s+data\s+sheet\b|\bfiche\s+technique\b")) | (text.rlike(rx(r"\bcharacteristics\b")) & text.rlike(rx(r"\bproperties\b")))
    say = lambda v, c: F.when(v.isNotNull(), F.struct(v.alias("group"), F.lit(c).alias("confidence")))
    return F.coalesce(say(known, 0.88), say(code, 0.80), say(fits(below), 0.90), say(fits(beside), 0.85), F.when(~data_sheet, F.coalesce(say(named, 0.75), say(spoken, 0.65))))


#: Lines that hold no total: accounts, addresses, signatures, long numbers.
NO_TOTAL = r"t[ée]l|fax|adress|mail|@|www\.|au\s+capital|r\.?i\.?b|scann|cachet|\d{10,}|tva\s*:\s*\d{5,}"


#: What a line of each total says, what it mustn't, and parts of words in lower case one of which stands in any line that says it (of letters that have one capital only).
TOTAL_LABELS = {
    "net": ("total\\s*h\\.?t|montant\\s*h\\.?t|hors\\s*taxe|net\\s*commercial", "brut", ["total", "montant", "taxe", "net"]),
    "tax": ("(?<!\\p{L})t\\.?v\\.?a(?!\\p{L})[^\\d\\n]*(?:\\d+\\s*%\\)?)?", "bas[ae]", ["tv", "t.v"]),
    "gross": ("t\\.?t\\.?c|net\\s*à\\s*payer|total\\s*g[ée]n[ée]ral|amount\\s*due", None, ["tt", "t.t", "net", "total", "amount"]),
    "base": ("bas[ae]\\s*tva", None, ["tva"]),
    "stamp": ("timbre", None, ["mbre"]),
    "levy": ("fodec", None, ["fodec"]),
}


def totals(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, net, tax, gross): amounts beside their labels, else on the nearest of the lines around them (next before previous); taxes of several rates are added, equal ones once.

    Where the gross lacks, or is no more than the base of the tax, it is base, tax and stamp together, else the largest
    amount above 100; where the net lacks, the largest amount between 40 and 99 % of the gross that isn't the base, else
    a hundred times the one-percent levy; the third of net, tax and gross follows from the other two. The lines of a text
    stay in its row, and each is parsed once, for all labels.
    """
    sum_of = "(\\d[\\d . ]*(?:[.,]\\d{1,3})?)\\s*(?:DT|TND|€)?\\s*$"

    def told(line: Column) -> Column:
        # digits, blanks and separators of an amount, of which only the blanks go
        found = lambda begins: F.regexp_replace(F.regexp_extract(line, rx(begins + sum_of), 1), BLANK, "")
        return F.struct(line.alias("line"), F.lower(line).alias("low"), F.when(line.rlike(rx("\\d")), found("")).alias("own"), F.when(line.rlike(rx("^\\s*\\d")), found("^\\s*")).alias("alone"))

    def number(s: Column) -> Column:
        # a cast of what is no number costs as much as a line's patterns
        return F.when((s != "") & s.contains("."), s).when(s != "", F.replace(s, F.lit(","), F.lit("."))).try_cast("double")

    def said(x: Column, label: str, but: str | None, parts: list[str]) -> Column:
        # 0: the label isn't there, 1: without digits beside it, 2: with some
        here = functools.reduce(operator.or_, [F.contains(x["low"], F.lit(p)) for p in parts]) & x["line"].rlike(rx(label))
        return F.when(here & (~x["line"].rlike(rx(but)) if but else F.lit(True)), F.when(F.regexp_replace(x["line"], rx(label), "").rlike("\\d"), 2).otherwise(1)).otherwise(0)

    df = once(df, {"_text": F.filter(F.split(text, "\\r?\\n"), lambda x: ~x.rlike(rx(NO_TOTAL)))})
    df = once(df, {"_told": F.transform("_text", told)})
    df = once(df, {"_lines": F.transform("_told", lambda x: F.struct(number(x["own"]).alias("own"), number(x["alone"]).alias("alone"), *[said(x, *label).alias(n) for n, label in TOTAL_LABELS.items()]))}).drop("_told")
    lines = F.col("_lines")

    def read(name: str, most: float = 9_999_999.0) -> Column:
        def at(line: Column, i: Column) -> Column:
            alone = lambda j: F.when(j >= 0, F.get(lines, j)["alone"])
            around = F.coalesce(*[F.when(alone(i + s * d) < most, alone(i + s * d)) for d in range(1, 6) for s in (1, -1)])
            return F.when(line[name] > 0, F.coalesce(F.when(line[name] == 2, line["own"]), around))

        return F.filter(F.transform(lines, at), lambda x: x.isNotNull() & (x < most))

    net, tax, gross, base, stamp, levy = (read(n, 5000.0 if n == "stamp" else 9_999_999.0) for n in TOTAL_LABELS)
    added = F.round(F.aggregate(F.array_distinct(F.transform(tax, lambda x: F.round(x, 3))), F.lit(0.0), lambda a, x: a + x), 3)
    rows = once(df, {"net": F.array_max(net), "tax": F.when(F.size(tax) > 0, added), "gross": F.array_max(gross), "_base": F.array_max(base), "_stamp": F.array_max(stamp), "_levy": F.array_max(levy)})
    summed = F.round(F.col("_base") + F.col("tax") + F.coalesce("_stamp", F.lit(0.0)), 3)
    near_base = F.coalesce(F.abs(F.col("gross") - F.col("_base")) < 0.02 * F.col("_base"), F.lit(False))
    rows = once(rows, {"_gross": F.coalesce(F.when(near_base, summed), "gross", summed, F.round(F.col("net") + F.col("tax"), 3))})
    # all amounts of a text are read only where its labels leave the gross or the net open
    every = F.filter(F.flatten(F.transform("_text", lambda x: F.when(x.rlike(rx("\\d")), scan_amounts(x)).otherwise(F.array().cast("array<double>")))), lambda x: x > 100)
    rows = once(rows, {"_all": F.when(F.col("_gross").isNull() | (F.col("net").isNull() & F.col("tax").isNull()), every)}).drop("_text", "_lines")
    rows = rows.withColumn("_gross", F.coalesce("_gross", F.array_max("_all")))
    between = F.array_max(F.filter("_all", lambda x: (x < 0.99 * F.col("_gross")) & (x >= 0.40 * F.col("_gross")) & F.coalesce(F.abs(x - F.col("_base")) > 0.001 * F.col("_base"), F.lit(True))))
    rows = once(rows, {"_net": F.coalesce("net", F.when(F.col("tax").isNotNull(), F.round(F.col("_gross") - F.col("tax"), 3)), between, F.when(F.col("_levy") > 1, F.round(F.col("_levy") / 0.01, 3)))})
    rest = F.round(F.col("_gross") - F.col("_net"), 3)
    return rows.select(key, F.col("_net").alias("net"), F.coalesce("tax", F.when(rest > 0, rest)).alias("tax"), F.col("_gross").alias("gross"))


#: What no reference begins with, and words of lines below a table.
NO_REFERENCE = ["FACT", "FACTURE", "BL", "BC", "INV", "TVA", "FODEC", "MF", "CIN", "TEL", "REF"]
BELOW_TABLE = ["total", "tva", "remise", "fodec", "timbre", "montant ht", "net à payer", "cachet", "signature"]


def invoice_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reference, designation, qty, rate, amount, estimated): a line that begins with a reference takes its numbers from it and the two below it; reading goes on behind them.

    Percentages and measures (2x3) are no numbers. The largest number is the amount, the first whole one the quantity, the price
    the one whose product with it is the amount, else another one (an amount a thousand times off is set right by
    it), else an estimate. Lines below the table and references that are none are passed over. What comes next depends
    on what was taken, so each text is read in one go, in Arrow batches.
    """
    import re

    ref = re.compile(r"^\s*((?=[A-Z0-9\-/]*\d)[A-Z]{2,}[A-Z0-9\-/]{2,})\b\s*(.*)$")
    no_ref, below = re.compile("^(?:" + "|".join(NO_REFERENCE) + r")\b"), re.compile(any_of(BELOW_TABLE), re.I)
    aside = re.compile(r"\d{1,3}(?:[.,]\d{1,2})?\s*%|\b\d{1,4}\s*[xX]\s*\d{1,4}\b(?![.,]\d)")
    number = re.compile(r"(?<![\w.,])\d{1,3}(?: \d{3})*(?:[.,]\d{1,3})?(?![\w%.,])|(?<![\w.,])\d+(?:[.,]\d{1,3})?(?![\w%.,])")

    def value(s: str) -> float:
        return float(s.replace(" ", "").replace(",", "."))

    def priced(numbers: list[float]) -> tuple[float | None, float | None, float | None, bool]:
        amount = max(numbers, default=None)
        qty = next((x for x in numbers if x == int(x) and 0 < x <= 100_000), None)
        if amount is None or not qty:
            return qty, None, amount, False
        rate = next((x for x in numbers if abs(x * qty - amount) < 0.01), None)
        if rate is not None:
            return qty, rate, amount, False
        rate = next((x for x in numbers if x not in (qty, amount)), None)
        if rate:
            off = amount / (rate * qty)
            if off > 500 or off < 0.002:
                return qty, rate, round(amount / 1000 if off > 500 else amount * 1000, 3), False
        return qty, round(amount / qty, 3), amount, True

    def one(page: str) -> list[tuple]:
        rows, lines, k = [], page.split("\n"), 0
        while k < len(lines):
            m = ref.match(lines[k])
            if not m or no_ref.match(m[1]) or below.search(lines[k]):
                k += 1
                continue
            window = [m[2]]
            for nxt in lines[k + 1 : k + 3]:
                if ref.match(nxt) or below.search(nxt):
                    break
                window.append(nxt)
            numbers = [value(x) for w in window for x in number.findall(aside.sub(" ", w))]
            name = re.split(r"\s{2,}|\s\d|\|", m[2].strip())[0].strip(" .|")
            rows.append((m[1], name, *priced(numbers)))
            k += len(window)
        return rows

    kinds = [("reference", pa.string()), ("designation", pa.string()), ("qty", pa.float64()), ("rate", pa.float64()), ("amount", pa.float64()), ("estimated", pa.bool_())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t.as_py() or "") for t in b.column(1)]
            at = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64())
            flat = [r for rows in found for r in rows]
            yield pa.record_batch([b.column(0).take(at), *[pa.array([r[k] for r in flat], t) for k, (_, t) in enumerate(kinds)]], [key, *[n for n, _ in kinds]])

    return df.select(key, text).mapInArrow(work, f"{key} {dict(df.dtypes)[key]}, reference string, designation string, qty double, rate double, amount double, estimated boolean")
