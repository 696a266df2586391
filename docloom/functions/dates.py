"""Dates: parsing, scanning and repair. No clock is read: whoever needs today passes it in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import FLAGS, fold, let, squeeze
from docloom.functions.vocabulary import MONTHS

DAY_MONTH_YEAR = "(\\d{1,2})\\s*[/.\\-]\\s*(\\d{1,2})\\s*[/.\\-]\\s*(\\d{2,4})"


def year_of(text: Column, pivot: int = 69) -> Column:
    """Two digits from pivot on are 19xx."""
    y = text.try_cast("int")
    return F.when(F.length(text) > 2, y).when(y >= pivot, y + 1900).otherwise(y + 2000)


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Null where the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def digits(text: Column) -> Column:
    """The runs of digits, in order."""
    return F.regexp_extract_all(text, F.lit("\\d+"), F.lit(0))


def _int(parts: Column, k: int) -> Column:
    return F.get(parts, k).try_cast("int")


def day_of(text: Column, pivot: int = 69) -> Column:
    """The day of a text whose runs of digits are day, month and year."""
    return let(digits(text), lambda p: date_of(year_of(F.get(p, 2), pivot), _int(p, 1), _int(p, 0)))


def normalised(text: Column, pivot: int = 69) -> Column:
    """ISO, day/month/year with any separator, or a month's name; else null."""
    month = "\\b(" + "|".join(MONTHS) + ")\\b"
    number = F.create_map(*[F.lit(x) for m, n in MONTHS.items() for x in (m, str(n))])
    # no day names two months
    names = let(fold(squeeze(text)), lambda s: F.when(s.rlike("[a-z]"), let(F.regexp_extract(s, month, 1), lambda m: F.when(m != "", F.replace(s, m, F.try_element_at(number, m))).otherwise(s))).otherwise(s))
    dated = "^(?:\\d{4}[/.\\-]\\d{1,2}[/.\\-]\\d{1,2}|\\d{1,2}[/.\\- ]+\\d{1,2}[/.\\- ]+(?:\\d{2}|\\d{4}))$"
    iso = lambda p: F.length(F.get(p, 0)) == 4
    parsed = lambda s: let(F.when(s.rlike(dated), digits(s)), lambda p: F.when(iso(p), date_of(_int(p, 0), _int(p, 1), _int(p, 2))).otherwise(date_of(year_of(F.get(p, 2), pivot), _int(p, 1), _int(p, 0))))
    return let(names, parsed)


def scan(text: Column, as_of: Column, first_year: int = 2000, ahead: int = 5) -> Column:
    """All days of the calendar in a text, by day, month and year, within the years first_year to as_of plus ahead."""
    whole = F.regexp_extract_all(text, F.lit(DAY_MONTH_YEAR), F.lit(0))
    found = F.transform(whole, day_of)
    return F.filter(found, lambda d: d.isNotNull() & F.year(d).between(F.lit(first_year), F.year(as_of) + ahead))


#: Digits and what they may have been, and the window of each kind of document in months back and ahead.
CONFUSED = {"0": "6", "6": "045", "8": "603", "1": "7", "7": "1", "5": "604", "4": "96", "9": "40", "3": "8", "2": "7"}
WINDOWS = {"cheque": (12, 12), "traite": (6, 36)}


def repair_year(date: Column, as_of: Column, kind: str = "cheque") -> Column:
    """(date, corrected): a day outside its window gets the nearest day inside it that differs in one digit of the year by a digit it may have been.

    A draft's day 12 to 36 months ahead gives way to a nearer such day only; one 36 to 60 months ahead to the first
    one inside, by digit and by what it may have been; any further one stays.
    """
    back, ahead = WINDOWS[kind]
    months = lambda d: F.datediff(d, as_of) / 30.44
    inside = lambda d: months(d).between(-back, ahead)
    table = F.create_map(*[F.lit(x) for kv in CONFUSED.items() for x in kv])
    year = F.lpad(F.year(date).cast("string"), 4, "0")
    changed = lambda k: F.transform(F.split(F.try_element_at(table, F.substring(year, k, 1)), ""), lambda c: F.concat(F.substring(year, 1, k - 1), c, F.substring(year, k + 1, 4 - k)).try_cast("int"))
    days = F.filter(F.transform(F.concat(*map(changed, (1, 2, 3, 4))), lambda y: date_of(y, F.month(date), F.dayofmonth(date))), lambda d: d.isNotNull() & inside(d))
    nearest = F.array_min(F.transform(days, lambda d: F.struct(F.abs(F.datediff(d, as_of)).alias("far"), d.alias("day"))))
    fixed = nearest["day"]
    if kind == "traite":
        closer = F.when(nearest["far"] < F.abs(F.datediff(date, as_of)), nearest["day"])
        fixed = F.when(months(date).between(-back, 12), F.lit(None).cast("date")).when(inside(date), closer).when((months(date) > ahead) & (months(date) <= 60), F.try_element_at(days, F.lit(1)))
        return F.struct(F.coalesce(fixed, date).alias("date"), F.coalesce(fixed.isNotNull(), F.lit(False)).alias("corrected"))
    return F.when(date.isNull() | inside(date), F.struct(date.alias("date"), F.lit(False).alias("corrected"))).otherwise(F.struct(F.coalesce(fixed, date).alias("date"), fixed.isNotNull().alias("corrected")))


def age_in_months(date: Column, as_of: Column) -> Column:
    """T4."""
    return F.datediff(as_of, date) / 30.44


def first_plausible(text: Column, as_of: Column) -> Column:
    """T5: the first of the scanned days."""
    return F.try_element_at(scan(text, as_of), F.lit(1))


def typed(text: Column) -> Column:
    """Day, month and year, two digits as 20yy; null where the calendar has no such day."""
    return day_of(F.regexp_extract(text, "\\d{1,2}[/.\\-]\\d{1,2}[/.\\-](?:\\d{4}|\\d{2})", 0), 100)


def not_in_future(date: Column, as_of: Column) -> Column:
    """T8."""
    return date <= as_of


def stale_hard(date: Column, as_of: Column, months: int = 12) -> Column:
    """Older than so many mean months in whole days."""
    return F.datediff(as_of, date) > int(months * 30.44)


def stale_on_save(date: Column, as_of: Column, days: int = 183) -> Column:
    """T9b."""
    return date < F.date_sub(as_of, days)


def due_after(text: Column, emitted: Column) -> Column:
    """So many days after emission."""
    n = F.nullif(F.regexp_extract(text, FLAGS + "(\\d{1,3})\\s*jours?", 1), F.lit("")).try_cast("int")
    return F.date_add(emitted, n)


def reconcile_due(emitted: Column, due: Column, most_inverted: int = 7) -> Column:
    """(emitted, due): swapped if due lies more than so many days before; emitted two days earlier if both are equal."""
    swap = F.datediff(emitted, due) > most_inverted
    return F.struct(F.when(swap, due).when(emitted == due, F.date_sub(emitted, 2)).otherwise(emitted).alias("emitted"), F.when(swap, emitted).otherwise(due).alias("due"))


def nearest_to(text: Column, label: str, as_of: Column) -> Column:
    """The day whose place in the text is nearest to a match of the label, the earlier of two as near; null without one."""
    whole = F.regexp_extract_all(text, F.lit(DAY_MONTH_YEAR), F.lit(0))
    heads, labels = F.split(text, FLAGS + label), F.regexp_extract_all(text, F.lit(FLAGS + "(" + label + ")"), F.lit(1))
    length = lambda xs, i: F.aggregate(F.slice(xs, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
    # a label ends behind all parts and labels up to it
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.when(i <= F.size(labels), length(heads, i) + length(labels, i)))
    far = lambda x: F.array_min(F.transform(ends, lambda e: F.abs(F.instr(text, x) - e)))
    ranked = F.transform(F.array_distinct(whole), lambda x: F.struct(far(x).alias("far"), F.instr(text, x).alias("at"), day_of(x).alias("day")))
    near = F.array_min(F.filter(ranked, lambda r: r["far"].isNotNull() & r["day"].isNotNull()))
    return near["day"]


def voted(text: Column, as_of: Column) -> Column:
    """The day that a text names most often, the earliest of equals; null without any."""
    found = scan(text, as_of)
    counts = F.transform(F.array_distinct(found), lambda d: F.struct(F.size(F.filter(found, lambda x: x == d)).alias("n"), (-F.datediff(d, F.lit("1970-01-01").cast("date"))).alias("early"), d.alias("day")))
    return F.array_max(counts)["day"]
