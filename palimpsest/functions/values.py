"""Typed values in text, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"
# Names of months.
MONTHS = "january february march april may june july august september october november december".split()
CURRENCY = r"\$|€|£|¥|₹|usd|eur|gbp|inr|jpy"
_NAME = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
# Forms of a date, in the order in which they are tried.
DATES = [
    rf"(?i)\b([0-9]{{1,2}})(?:st|nd|rd|th)? ({_NAME}),? ([0-9]{{4}})\b", rf"(?i)\b({_NAME}) ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ([0-9]{{4}})\b", r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b",
    r"\b([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4}|[0-9]{2})\b",
]
EDGE = r"""[\s.,;:!?()\[\]{}"'“”‘’]+"""  # signs around a date that aren't part of it

DATED = "(?i)(?:" + "|".join(form.removeprefix("(?i)") for form in DATES) + ")"  # any of them
WHOLE = f"(?i)^{DATED[4:]}$"


def once(c: Column, of) -> Column:
    """of(c), with c computed once, however often it is read."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def _number(text: Column) -> Column:
    return F.replace(F.regexp_extract(text, f"({NUMBER})", 1), F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def _month(word: Column) -> Column:
    names = F.array(*(F.lit(m[:3]) for m in MONTHS))
    return F.nullif(F.array_position(names, F.lower(F.substring(word, 1, 3))), F.lit(0)).cast("int")


def _made(y: Column, m: Column, d: Column) -> Column:
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat_ws("-", F.lpad(y.cast("int").cast("string"), 4, "0"), two(m), two(d)).try_cast("date")


def parse_date(c: Column) -> Column:
    """struct(date, ambiguous): day month year, month day year, ISO, then numbers, which are ambiguous unless one exceeds 12.

    What a form finds is taken apart at its separators, so that each form is looked for once."""
    dmy, mdy, iso, num = DATES
    found = lambda form, parts, made: once(F.split(F.regexp_extract(c, form, 0), parts), lambda x: F.when(F.size(x) == 3, made(*(F.get(x, F.lit(k)) for k in range(3)))))
    digits = lambda word: F.translate(word, "stndrhSTNDRH,", "").try_cast("int")
    as_int = lambda word: word.try_cast("int")
    # A form's struct is null where it isn't found; its date is null if there is no such day.
    named = lambda form, made: found(form, " ", lambda *p: F.struct(made(*p).alias("date")))
    by_name = once(named(dmy, lambda d, m, y: _made(as_int(y), _month(m), digits(d))), lambda x: F.when(x.isNotNull(), x["date"]).otherwise(named(mdy, lambda m, d, y: _made(as_int(y), _month(m), digits(d)))["date"]))
    by_iso = found(iso, "-", lambda y, m, d: _made(as_int(y), as_int(m), as_int(d)))

    def numbers(p: Column) -> Column:
        a, b, y = p["a"], p["b"], F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"])
        return F.struct(F.when(a > 12, _made(y, b, a)).when(b > 12, _made(y, a, b)).when(a.isNotNull(), _made(y, b, a)).alias("date"), ((a <= 12) & (b <= 12) & (a != b)).alias("ambiguous"))

    by_number = once(found(num, "[/.]", lambda a, b, y: F.struct(as_int(a).alias("a"), as_int(b).alias("b"), as_int(y).alias("y"))), numbers)
    clear = once(F.coalesce(by_name, by_iso), lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(False).alias("ambiguous"))).otherwise(by_number))
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit(None).cast("boolean").alias("ambiguous"))
    return F.when(c.rlike(DATED), clear).otherwise(none)


def whole_date(c: Column) -> Column:
    """The date of a text that is a date and nothing else, signs at its edges apart; null for any other text and for no real date."""
    own = bare(c)
    return F.when(own.rlike(WHOLE), parse_date(own)["date"])


def bare(c: Column) -> Column:
    """Without the signs around a date that aren't part of it."""
    return F.regexp_replace(c, f"^{EDGE}|{EDGE}$", "")


def kind_of(c: Column, date: Column | None = None) -> Column:
    """date, percent, money, identifier, year, number or text, in that order of trying. date: that of parse_date, where it is known already."""
    date = parse_date(c)["date"] if date is None else date
    money = rf"(?i)(?:{CURRENCY})\s?(?:{NUMBER})|(?:{NUMBER})\s?(?:{CURRENCY})"
    return (
        F.when(date.isNotNull(), "date").when(c.rlike(rf"(?:{NUMBER})\s?%"), "percent").when(c.rlike(money), "money")
        .when(c.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*$"), "identifier").when(c.rlike(r"^(?:18|19|20|21)[0-9]{2}$"), "year").when(c.rlike(rf"^[-+]?(?:{NUMBER})$"), "number").otherwise("text")
    )


def value_in(c: Column, kind: Column) -> Column:
    """The part of a text that is its value: the date, percentage or amount, the whole of an identifier, else its first number; null without any. kind: that of the text."""
    date = F.lit(None).cast("string")
    for form in DATES[::-1]:
        own = F.regexp_extract(c, f"(?i)({form.removeprefix('(?i)')})", 1)
        date = F.when((own != "") & parse_date(own)["date"].isNotNull(), own).otherwise(date)
    part = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    number = part(rf"(?<![\w.])({NUMBER})(?!\w)")
    return F.when(kind == "date", date).when(kind == "percent", part(rf"((?:{NUMBER})\s?%)")).when(kind == "money", part(rf"(?i)((?:{CURRENCY})\s?(?:{NUMBER})|(?:{NUMBER})\s?(?:{CURRENCY}))")).when(kind == "identifier", c).otherwise(number)


def category_of(kind: Column) -> Column:
    """number, date or identifier, as a feed names the kinds of values; null for others."""
    return F.when(kind.isin("number", "money", "percent", "year"), "number").when(kind.isin("date", "identifier"), kind)


def plain(d: Column) -> Column:
    """A decimal without trailing zeros."""
    return once(d.cast("string"), lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s))


def number_delta(old: Column, new: Column) -> Column:
    """'+25 (+50%)': signed difference, and percent of the old number rounded half to even; null without a difference."""
    both = F.struct(old.cast("decimal(28,4)").alias("old"), new.cast("decimal(28,4)").alias("new"))
    signed = lambda c: once(c, lambda x: F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), plain(x)))
    share = lambda diff, old: F.bround((diff * 100).cast("double") / F.when(old != 0, F.abs(old)).cast("double"), 2).cast("decimal(28,2)")
    shown = lambda p: once(p["new"] - p["old"], lambda diff: F.when(diff != 0, F.concat(signed(diff), F.coalesce(F.concat(F.lit(" ("), signed(share(diff, p["old"])), F.lit("%)")), F.lit("")))))
    return once(both, shown)


def date_delta(old: Column, new: Column) -> Column:
    days = F.datediff(new, old)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit(" days later"))).when(days < 0, F.concat((-days).cast("string"), F.lit(" days earlier")))


def unit_of(c: Column) -> Column:
    """What stands beside the first number of a text: its currency, percent sign or unit, in small letters."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, f"^(.*?)(?:{NUMBER})", "$1 "), r"\s+", " ")))


def typed(c: Column) -> Column:
    """struct(kind, date, ambiguous, number, unit) of a value given as text."""
    own = lambda x, d: F.struct(kind_of(x, d["date"]).alias("kind"), d["date"].alias("date"), d["ambiguous"].alias("ambiguous"), _number(x).alias("number"), unit_of(x).alias("unit"))
    return once(c, lambda x: once(parse_date(x), lambda d: own(x, d)))


def value_delta(old: Column, new: Column) -> Column:
    """The difference of two typed() values, or null where it means nothing. They should be columns already, as each is read many times.

    Dates differ by days unless one is ambiguous. Numbers differ if both have the same unit and neither is an identifier; a percentage
    follows but for years, percents and an old value of 0.
    """
    def shown(p: Column) -> Column:
        old, new = p["old"], p["new"]
        either = lambda *kinds: old["kind"].isin(*kinds) | new["kind"].isin(*kinds)
        days = F.when(~old["ambiguous"] & ~new["ambiguous"], date_delta(old["date"], new["date"]))
        delta = number_delta(old["number"], new["number"])
        bare = F.regexp_replace(delta, r" \(.*\)$", "")
        both_dates = (old["kind"] == "date") & (new["kind"] == "date")
        return F.when(both_dates, days).when(either("date", "identifier", "text") | (old["unit"] != new["unit"]), None).when(either("year", "percent"), bare).otherwise(delta)

    return once(F.struct(old.alias("old"), new.alias("new")), shown)  # in a lambda, for as plain columns it is too long to be compiled


def label_before(line: Column, value: Column, most: int = 80) -> Column:
    """What introduces a value on its line, without colons and dashes around it; null if there is nothing, or more than a label."""
    label = F.regexp_replace(F.call_function("substring_index", line, value, F.lit(1)), r"^[ :–—\-\t]+|[ :–—\-\t]+$", "")
    return F.when((F.instr(line, value) > 0) & F.length(label).between(1, most), label)


def change_type(kind: Column, category: Column) -> Column:
    """Text and page take the kind, every other category is CHANGED."""
    return F.upper(F.when(category.isin("text", "page"), F.concat_ws("_", category, kind)).otherwise(F.concat(category, F.lit("_changed"))))
