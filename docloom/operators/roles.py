"""Values told apart by what stands around them: days, amounts, references and names of a text, each with its role.

Several tables of shapes are tried in order. A value counts once, and a stretch that a value covers gives no other; its role is
the first one that words in its surroundings tell: a window around it, its line, or what stands before it on its
line. Of each role the first value counts, or that of the role's rank. Two profiles: recognised text, and the
flattened text of a sheet. A text is read in one go, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.functions.phrases import any_of
from docloom.functions.text import let

KINDS = ("dates", "amounts", "references", "names")
WINDOW = 60
#: A value above it is no amount of an invoice, and the usual tax.
MOST, TAX = 999_999, 0.19


def day(*sizes: tuple[int, int]) -> str:
    """Three numbers of so many digits, parted by a slash, hyphen or dot."""
    return r"\b(" + r"[/\-.]".join(f"\\d{{{a},{b}}}" for a, b in sizes) + r")\b"


def grouped(group: str, more: str, mark: str, digits: str, unit: str = "") -> str:
    """An amount: up to three digits, groups of three behind a sign, and digits behind a mark."""
    return rf"(\d{{1,3}}(?:[{group}]\d{{3}}){more}" + (f"[{mark}]\\d{digits}" if mark else "") + ")" + unit


def numbered(letters: str, most: int) -> str:
    """A code of letters, a year and a number; or of a year and a number."""
    return rf"\b([{letters}]{{1,{most}}}[-/]\d{{4}}[-/]\d+)\b" if most else r"\b(\d{4}[-/]\d{3,6})\b"


#: Years of two to four digits; a year of three is a cut one.
_D2, _D4, _D12, _Y, _Y3 = (2, 2), (4, 4), (1, 2), (2, 4), (3, 3)
_MONEY = r"\s*" + any_of(["tnd", "dt", "eur", "€", "$", "دينار"])
#: By profile, shapes of each kind in order.
SHAPES = {
    "text": {
        "dates": [day(_D2, _D2, _D4), day(_D4, _D2, _D2), day(_D12, _D12, _Y), day(_D2, _D2, _Y3)],
        "amounts": [grouped(r"\s.", "*", ".,", "{2}", f"(?:{_MONEY})?"), grouped(r"\s", "+", "", "", f"(?:{_MONEY})?")],
    },
    "sheet": {
        "dates": [day(_D2, _D2, _D4), day(_D4, _D2, _D2), day(_D12, _D12, _Y)],
        "amounts": [grouped("  ", "*", ",", "{2,3}"), grouped(".", "+", ",", "{2,3}"), grouped(",", "+", ".", "{2,3}"), r"(?<!\d)(\d{1,6}[.]\d{2,3})(?!\d)"],
    },
}
#: By profile, words before a reference, kinds of document between them, the most letters of a code and the most signs of a reference.
NUMBERS = {"text": (["numéro", "n°.", "num.", "réf.", "#", "uméro", "umeéro"], ["facture", "fact.", "bl", "commande", "chèque"], 3, ""), "sheet": (["numéro", "n°.", "num.", "réf.", "#"], ["facture", "fact.", "bl", "commande"], 4, "20")}
#: By profile, words before a supplier's name and what ends it; legal forms that end a name.
SELLERS = {"text": (["fournisseur", "supplier", "vendeur", "vendor"], ["mf", "rib", "tél", "date", "adresse", "n°", "f:"]), "sheet": (["fournisseur", "supplier", "vendeur"], ["mf", "rib", "tél", "date", "n°"])}
LEGAL = ["SARL", r"SA\b", "EURL", "GROUP", "GROUPE", "SNC", "LLC", "SAS", "GIE"]
#: Words that a name doesn't end with.
AFTER_NAMES = ["date", "adresse", "tel", "tél", "mf", "rib", "n°", ":"]
#: By profile, words whose neighbours are no amounts.
NO_AMOUNT = {
    "text": ["mf", "matricule", "rib", "iban", "bic", "swift", "tel", "tél", "fax", "rc", "registre", "code postal", "bp ", "b.p", "cp ", "siret", "siren", "ice"],
    "sheet": ["mf ", "mf/", "matricule", "rib", "iban", "bic", "swift", "tél :", "tel :", "téléphone", "telephone", "fax", "registre", "code postal", "bp ", "b.p", "cp ", "siret", "siren", "ice", "n° tva", "n°tva", "tva :", "tva:", "n°fiscal", "rc :", "rc:"],
}
#: By profile and kind, roles and the words that tell them, in order, and the role of all others.
ROLES = {
    "text": {
        "dates": ([("date_livraison", ["livraison"]), ("date_echeance", ["échéance", "echeance", "paiement"]), ("date_commande", ["commande"])], "date"),
        "amounts": ([("montant_ttc", ["ttc", "net à payer", "total", "net a payer"]), ("montant_tva", ["tva", "taxe"]), ("montant_ht", ["ht", "hors taxe", "hors-taxe"]), ("remise", ["remise"])], "montant"),
        "references": ([("numero_facture", ["facture", "invoice", "fact", "acture", "factue"]), ("numero_bl", ["livraison", "bl ", "b.l"]), ("numero_commande", ["commande", "bc ", "b.c"]), ("numero_cheque", ["cheque", "chèque", "chque"])], "reference"),
        "names": ([("fournisseur", ["fournisseur", "vendeur", "supplier", "vendor"]), ("client", ["client", "destinataire", "acheteur"]), ("banque", ["banque", "bank", "bnq"])], "societe"),
    },
    "sheet": {
        "dates": ([("date_livraison", ["livraison"]), ("date_echeance", ["échéance", "echeance", "paiement"]), ("date_commande", ["commande"])], "date"),
        "references": ([("numero_facture", ["facture", "fact", "invoice"]), ("numero_bl", ["bl", "livraison"]), ("numero_commande", ["commande", "bc"])], "reference"),
        "names": ([("fournisseur", ["fournisseur", "vendeur", "supplier"]), ("client", ["client", "destinataire", "acheteur"])], "societe"),
    },
}
#: Ranks of the roles of a sheet's amounts.
RANKS = ["montant_ttc", "montant_ht", "montant_tva", "remise", "montant_ht_brut", "montant_tva_ligne", "montant_taxe_detail", "montant"]


@cache
def _patterns(profile: str, kind: str) -> list[re.Pattern]:
    if kind == "references":
        before, kinds, most, length = NUMBERS[profile]
        labelled = any_of(before) + r"\s*" + any_of(kinds) + r"?[:\s]*" + f"([A-Z0-9/\\-]{{3,{length}}})"
        shapes = [numbered("A-Z", most), numbered("", 0), labelled]
    elif kind == "names":
        before, ends = SELLERS[profile]
        shapes = [any_of(before) + r"\s*[:\s]+([A-ZÀ-Ÿ][A-Za-zÀ-ÿ0-9\s&]{2,38}?)" + r"(?=\s*(?:\n|$|" + any_of(ends) + "))", r"([A-Z][A-Za-zÀ-ÿ0-9\s&,.\-]{2,44}(?:" + "|".join(LEGAL) + "))"]
    else:
        shapes = SHAPES[profile][kind]
    return [re.compile(s, 0 if kind == "dates" else re.I) for s in shapes]


#: Where a day's numbers may begin, and every place at which a legal form stands.
_DAY_AT = re.compile(r"\b(?=\d{1,4}[/\-.]\d)")
_LEGAL_AT = re.compile("(?=" + "|".join(LEGAL) + ")", re.I)
_STEMS = ["sa", "eurl", "group", "snc", "llc", "gie"]
#: How far before its legal form a name begins.
NEAR, FAR = 3, 45


def _at(pattern: re.Pattern, text: str, places: Iterable[int]) -> Iterator[re.Match]:
    """What finditer gives, where a match can only begin at one of the places, in order."""
    end = 0
    for p in places:
        m = pattern.match(text, p) if p >= end else None
        if m:
            end = m.end()
            yield m


def _legal(text: str) -> list[int]:
    """Where a legal form may stand, by the letters that begin one; where letters fold in ways of their own by the patterns."""
    if any(c in text for c in "ſıİ"):
        return [m.start() for m in _LEGAL_AT.finditer(text)]
    low, found = text.lower(), []
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            found.append(at)
            at = low.find(stem, at + 1)
    return sorted(found)


def _before_legal(text: str) -> Iterator[int]:
    begun = 0
    for at in _legal(text):
        yield from range(max(begun, at - FAR), at - NEAR + 1)
        begun = max(begun, at - NEAR + 1)


def matches(text: str, profile: str, kind: str) -> Iterator[Iterator[re.Match]]:
    """The matches of each of a kind's patterns in order. Most texts are passed over quickly: days are tried where digits and a sign stand, names before a legal form."""
    patterns = _patterns(profile, kind)
    if kind == "dates":
        places = [m.start() for m in _DAY_AT.finditer(text)]
        yield from (_at(p, text, places) for p in patterns)
    elif kind == "names":
        yield patterns[0].finditer(text)
        yield _at(patterns[1], text, _before_legal(text))
    else:
        yield from (p.finditer(text) for p in patterns)


def around(text: str, at: int) -> str:
    return text[max(0, at - WINDOW) : at + WINDOW].lower()


def line_at(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else len(text)].lower()


def told(said: str, profile: str, kind: str) -> str:
    roles, other = ROLES[profile][kind]
    return next((role for role, words in roles if any(w in said for w in words)), other)


def amount_of(raw: str, profile: str) -> float:
    """A number as the profile writes it; 0 for what is none."""
    s = raw.strip().replace(" ", " ") if profile == "sheet" else raw
    if profile == "sheet" and re.search(r"\d,\d{3}\.", s):
        s = s.replace(",", "")
    elif profile == "sheet" and re.search(r"\d\.\d{3},", s):
        s = s.replace(".", "")
    try:
        return float(s.replace(" ", "").replace(",", "."))
    except ValueError:
        return 0.0


def sheet_role(before: str) -> str:
    """The role of a sheet's amount by what stands before it on its line."""
    has = lambda *words: any(w in before for w in words)
    if has("total ttc", "net à payer", "net a payer", "montant ttc"):
        return "montant_ttc"
    if re.search(r"\bremise\b", before):
        return "remise"
    if re.search(r"total\s+ht\s*$", before) and not has("brut"):
        return "montant_ht"
    if has("ht brut") or has("total ht") and has("brut"):
        return "montant_ht_brut"
    if has("total taxe"):
        return "montant_tva"
    if re.search(r"\btva\b", before) and not has("base"):
        return "montant_tva_ligne"
    if has("base tva", "fodec", "timbre"):
        return "montant_taxe_detail"
    if has(" ht", "hors taxe", "hors-taxe"):
        return "montant_ht"
    return "montant_ttc" if has("total") else "montant"


def clean_name(value: str) -> str:
    value = value.strip().split("\n")[0].split("\r")[0]
    for word in AFTER_NAMES:
        value = re.sub(r"\s*" + re.escape(word) + r"\s*$", "", value, flags=re.I)
    return value.strip()


def firsts(found: list[tuple[str, object]]) -> dict[str, object]:
    out: dict[str, object] = {}
    for role, value in found:
        out.setdefault(role, value)
    return out


def plain_values(text: str, profile: str, kind: str) -> dict[str, str]:
    """Days, references and names by role."""
    found, seen = [], set()
    for some in matches(text, profile, kind):
        for m in some:
            value = clean_name(m[1]) if kind == "names" else m[1].strip()
            if value in seen or kind != "dates" and len(value) < 3:
                continue
            seen.add(value)
            found.append((told(around(text, m.start()), profile, kind), value))
    return firsts(found)


def amounts(text: str, profile: str) -> dict[str, float]:
    """Amounts by role. Where the gross lacks it is the largest; where net and tax lack they follow from it at the usual tax."""
    found: list[tuple[str, float]] = []
    seen, covered = set(), []
    for pattern in _patterns(profile, "amounts"):
        for m in pattern.finditer(text):
            value = amount_of(m[1], profile)
            if not 0 < value <= MOST:
                continue
            if profile == "sheet":
                said = line_at(text, m.start())
                if any(a <= m.start() < z for a, z in covered) or any(w in said for w in NO_AMOUNT[profile]):
                    continue
                covered.append((m.start(), m.end()))
                before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()].lower().strip()
                found.append((sheet_role(before), value))
            else:
                said = around(text, m.start())
                if m[1] in seen or any(w in said for w in NO_AMOUNT[profile]):
                    continue
                seen.add(m[1])
                found.append((told(said, profile, "amounts"), value))
    found.sort(key=(lambda x: RANKS.index(x[0])) if profile == "sheet" else (lambda x: -x[1]))
    out = firsts(found)
    if profile == "sheet":
        by_line = out.pop("montant_tva_ligne", None)
        if by_line is not None:
            out.setdefault("montant_tva", by_line)
    if "montant_ttc" not in out and found:
        out["montant_ttc"] = max(v for _, v in found)
    if "montant_ttc" in out and "montant_ht" not in out and "montant_tva" not in out:
        gross, digits = out["montant_ttc"], 3 if profile == "sheet" else 2
        out["montant_ht"], out["montant_tva"] = round(gross / (1 + TAX), digits), round(gross - gross / (1 + TAX), digits)
    return out


_TYPE = ", ".join(f"{k} map<string,{'double' if k == 'amounts' else 'string'}>" for k in KINDS)


def by_role(text: Column, profile: str = "text") -> Column:
    """X4 (profile text), X5 (profile sheet): struct (dates, amounts, references, names), each a map from role to value. A null text has none."""

    def work(batch: pa.Array) -> pa.Array:
        texts = [t or "" for t in batch.to_pylist()]
        columns = [pa.array([list((amounts(t, profile) if k == "amounts" else plain_values(t, profile, k)).items()) for t in texts], pa.map_(pa.string(), pa.float64() if k == "amounts" else pa.string())) for k in KINDS]
        return pa.StructArray.from_arrays(columns, list(KINDS))

    work.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(work, _TYPE)(text)


def entry_of(found: Column) -> Column:
    """Map from names in the books to values, of what was found in a sheet; the day of the bill is also that of posting."""
    def named(f: Column) -> Column:
        pairs = []
        for kind, told_roles in V.SHEET_NAMES.items():
            for role, name in told_roles:
                value = F.try_element_at(f[kind], F.lit(role))
                pairs.append(F.struct(F.lit(name).alias("k"), (F.round(value, 3).cast("string") if kind == "amounts" else value).alias("v")))
        return F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())

    def entry(some: Column) -> Column:
        once = F.filter(some, lambda p, i: ~F.exists(F.slice(some, F.lit(1), i), lambda q: q["k"] == p["k"]))
        bill = F.filter(once, lambda p: p["k"] == "bill_date")
        return F.map_from_entries(F.concat(once, F.transform(bill, lambda p: F.struct(F.lit("posting_date").alias("k"), p["v"].alias("v")))))

    return let(let(found, named), entry)
