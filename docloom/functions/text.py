"""Text normalisation as Column expressions: no Python runs on the executors.

Patterns carry the flags (?iuU), so that case, white space and word borders follow Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.vocabulary import BANKS

FLAGS = "(?iuU)"
#: Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿăąćčďęěğńňőřśšşťţůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaccdeegnnorsssttuuzzz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is named: it becomes a lambda's variable."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, each computed once for a row: later projections can't pull them in."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def rx(pattern: str, multiline: bool = False) -> str:
    return ("(?iuUm)" if multiline else FLAGS) + pattern


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def field_key(text: Column) -> Column:
    """A field's name for comparison."""
    return F.regexp_replace(F.replace(fold(text), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def repair_payment(text: Column) -> Column:
    """Dashes, slashes, letters read for digits between digits and the signs of days and numbers, split decimals."""
    out = F.translate(text, "‐‑‒–—―−⁄∕／", "-------///")
    out = F.regexp_replace(out, "(?<=[0-9/.\\-])O(?=[0-9/.\\-])", "0")
    out = F.regexp_replace(out, "(?<=[0-9/.\\-])[lI](?=[0-9/.\\-])", "1")
    return F.regexp_replace(out, "(?U)(\\d)\\s+[Jl|I](\\d{3})\\b", "$1,$2")


#: How recognition garbles names, as patterns, whether capitals count, and what the names are.
GARBLED = [
    (r"PANNEA(?:[\\|/IX'’])?(?!\w)", True, "PANNEAUX"),
    (r"TUN[I][G][I][A]", False, "TUNISIA"),
    (r"TU+W?N[I1][B8][T7]A[T7]", False, "TUNISIA"),
    (r"OLEO\s*TEC[A-Z]{0,4}(?:ING|N[GDQ0O])(?!\w)", False, "OLEO TECHNO"),
]


def repair_names(text: Column) -> Column:
    """Days with a gap between their digits, and names that recognition garbles."""
    out = F.regexp_replace(text, "(?U)\\b(\\d)\\s(\\d)(/\\d{1,2}/\\d{2,4})\\b", "$1$2$3")
    for garbled, capitals, name in GARBLED:
        out = F.regexp_replace(out, ("(?U)" if capitals else FLAGS) + garbled, name)
    return out


def repair_sheet(text: Column) -> Column:
    """Dashes, quotes, O and 0 beside digits, line ends, control characters, runs of blanks."""
    out = F.regexp_replace(text, "[‐-―−]", "-")
    out = F.regexp_replace(out, "[‘’]", "'")
    out = F.regexp_replace(out, "\\r\\n?", "\n")
    out = F.regexp_replace(out, "(?<=\\d)[oO](?=\\d)", "0")
    out = F.regexp_replace(out, "(?<=\\d)l(?=\\d)", "1")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.regexp_replace(out, "[ \\t]{2,}", " ")


def repair_codes(text: Column) -> Column:
    """Letters O inside codes (capitals and digits, with a digit) are zeros."""
    code = F.split(text, " ")
    fixed = F.transform(code, lambda w: F.when(w.rlike("^[A-Z0-9]+$") & w.rlike("[0-9]"), F.concat(F.regexp_extract(w, "^[A-Z]*?(?=O*[0-9]|$)", 0), F.replace(F.regexp_replace(w, "^[A-Z]*?(?=O*[0-9]|$)", ""), F.lit("O"), F.lit("0")))).otherwise(w))
    return F.array_join(fixed, " ")


HASH = "[_-]?[a-f0-9]{6,10}(?=\\.[^.]*$|$)"


def file_variants(name: Column) -> Column:
    """The name, without its hash suffix, and both without extension; distinct, in that order."""
    clean = F.regexp_replace(name, HASH, "")
    base = lambda c: F.regexp_replace(c, "\\.[^.]+$", "")
    return F.array_distinct(F.array(name, clean, base(name), base(clean)))


def bare_name(name: Column) -> Column:
    """The part of a file's name that all of its variants share: up to the first dot, without hash suffixes."""
    return F.regexp_replace(F.regexp_extract(name, "^[^.]*", 0), "([_-]?[a-f0-9]{6,10})+$", "")


def item_code(text: Column) -> Column:
    """First word without closing signs, of 2 to 40 characters and with a letter or digit; else null."""
    code = F.regexp_replace(F.split(F.trim(text), "\\s+")[0], "[.,;:/\\-]+$", "")
    return F.when(F.length(code).between(2, 40) & code.rlike("[A-Za-z0-9]"), code)


def part_code(text: Column) -> Column:
    """Without a lower-case prefix, in capitals, O beside a digit as zero."""
    code = F.upper(F.regexp_replace(F.trim(text), "^[a-z]+(?=[A-Z])", ""))
    return F.regexp_replace(F.regexp_replace(code, "(?<=\\d)O", "0"), "O(?=\\d)", "0")


def chain(text: Column) -> Column:
    """Squeezed, without signs at the ends."""
    return F.regexp_replace(squeeze(text), "^[ .,;:\\-|/]+|[ .,;:\\-|/]+$", "")


def before_label(text: Column) -> Column:
    """Cut before the next label that ends with a colon."""
    return F.trim(F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, rx("\\s+[\\p{L}][\\p{L} .'/]{1,30}:.*$"), "")).otherwise(text))


#: Words that belong to a company's name though labels are like them.
COMPANY_WORDS = ["TUNISIA", "TUNISIE", "INTERNATIONAL", "INDUSTRIES", "PANNEAUX", "ACCESSORIES", "EQUIPEMENTS", "SERVICES", "REPARATION", "TECHNOLOGY", "TECHNO", "TRADING", "GROUP", "HOLDING", "LEASING"]


def before_field(text: Column, labels: list[str]) -> Column:
    """Cut before the first word of another field that stands behind the last word of a company's name; two to five capitals stay as they are."""
    words = "\\b(?:" + "|".join(COMPANY_WORDS) + ")\\b"
    any_label = "\\b(?:" + "|".join(labels) + ")\\b"

    def cut(v: Column) -> Column:
        name = F.regexp_extract(v, rx(f"(?s)^.*{words}"), 0)
        rest = F.substring(v, F.length(name) + 1, F.length(v))
        # a label at the very beginning is no other field's
        short = F.regexp_replace(rest, rx(f"(?s)(?<=.){any_label}.*$"), "")
        return F.when(v.rlike("^[A-Z]{2,5}$"), v).otherwise(F.trim(F.concat(name, F.when((name != "") & rest.rlike(rx(f"^\\s*{any_label}")), F.lit("")).otherwise(short))))

    return let(F.trim(text), cut)


def before_word_label(text: Column, most: int = 40) -> Column:
    """Cut before words, the first with a capital, that end with a colon or hyphen; at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(text, "(?U)\\s+[A-ZÀ-Ÿ][^\\s]+(?:\\s+[^\\s:]+)*\\s*[:\\-](?s:.*)$", "")), 1, most)


#: Names of units of measure and the words for them, by kind of source; the first name that has the word counts.
UNITS = {
    "item": {
        "Unité": ["unité", "unite", "unit", "un", "u", "ea", "each", "nos", "pce", "pcs", "pièce", "piece", "qté", "qte"],
        "Kg": ["kg", "kilogramme", "kilo"], "g": ["g", "gramme", "gr"], "m": ["m", "mètre", "metre", "ml", "mètre linéaire"],
        "m2": ["m²", "m2", "mètre carré", "metre carre"], "m3": ["m³", "m3", "mètre cube"], "L": ["l", "litre", "liter"], "Box": ["box", "boîte", "boite", "bte", "bt"],
        "Pack": ["pack", "lot", "set"], "Pair": ["paire", "pair", "pr"], "Roll": ["rouleau", "roll", "rl"], "Doz": ["douzaine", "doz", "dozen"],
    },
    "bom": {"Kg": ["kg", "kilo", "kilogramme"], "g": ["g", "gramme"], "m": ["m", "mètre", "metre"], "m2": ["m2", "m²"], "L": ["l", "litre"], "Unité": ["unité", "unite", "u", "un", "nos", "pcs", "pce", "pièce", "piece"]},
    "sheet": {"Kg": ["kg"], "g": ["g"], "m": ["m"], "L": ["l"], "Unité": ["unité", "unite", "u", "un", "pcs", "pièce", "piece"]},
}


def unit(text: Column, profile: str = "item") -> Column:
    """The unit's name; an unknown one is empty (item), short ones in capitals (bom) or as it stands (sheet)."""
    names: dict[str, str] = {}
    for name, words in UNITS[profile].items():
        for w in words:
            names.setdefault(w, name)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    raw = F.trim(text)
    known = F.try_element_at(table, F.regexp_replace(F.lower(raw), "\\.$", ""))
    rest = {"item": F.lit(""), "bom": F.when(F.length(raw) <= 3, F.upper(raw)).otherwise(raw), "sheet": raw}[profile]
    return F.coalesce(known, rest)


def payment_method(text: Column) -> Column:
    """Cheque or traite by what the text contains; null without either."""
    low = F.lower(text)
    has = lambda *words: F.coalesce(count_in(low, list(words)) > 0, F.lit(False))
    return F.when(has("chèque", "cheque", "check", "chéque"), "cheque").when(has("traite", "lettre de change", "effet", "draft"), "traite")


def bank(text: Column) -> Column:
    """The first bank of the list that the text names."""
    return F.coalesce(*[F.when(text.rlike(rx(f"\\b{b}\\b")), b) for b in BANKS])


def account_number(text: Column) -> Column:
    """Letters read for digits repaired, the rest dropped; 20 digits in groups 2-3-3-7-3-2, at least 16 else null."""
    digits = F.regexp_replace(F.translate(F.lower(text), "tlozsg", "110259"), "\\D", "")
    grouped = F.regexp_replace(digits, "^(\\d{2})(\\d{3})(\\d{3})(\\d{7})(\\d{3})(\\d{2})$", "$1 $2 $3 $4 $5 $6")
    return F.when(F.length(digits) >= 16, grouped)


def is_missing(value: Column) -> Column:
    """None, empty text and zero are all missing."""
    return value.isNull() | (F.trim(value.cast("string")) == "") | F.coalesce(value.try_cast("double") == 0, F.lit(False))


def first_match_in(text: Column, words: list[str]) -> Column:
    """The first word of the list that the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), w) for w in words])


def count_in(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


def count_patterns(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns the text matches."""
    hits = [text.rlike(rx(p, True)).cast("int") for p in patterns]
    return sum(hits[1:], hits[0])
