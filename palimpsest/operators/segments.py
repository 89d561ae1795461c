"""Runs of changed words as typed changes: whole dates first, then what these leave.

"30 June 2026" made "15 July 2026" differs in two words, or in two places if only the year stands between. A date that holds a changed word on both sides is therefore one
change, and runs that lie within such dates are no changes beside it. All of it is columns of the row that holds a pair of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values

DATE_WORDS, DATE_SIGNS = 7, 60  # words, and signs, that a date has at most
DATE = f"(?i)^(?:{values.EDGE})?(?:{values.WHOLE[4:].strip('^$')})(?:{values.EDGE})?$"
# A date's first word begins, signs at its edge apart, with a digit or a month, its last one ends with a digit; words of such signs alone may stand around it.
BEGIN = f"(?i)^(?:{values.EDGE})?(?:[0-9]|{'|'.join(m[:3] for m in values.MONTHS)}|$)"
END = f"(?:^|[0-9])(?:{values.EDGE})?$"
SPAN = "old_from int, old_to int, new_from int, new_to int, old_date string, new_date string, difference string"


def date_span(words: Column, first: Column, last: Column) -> Column:
    """struct(size, first, last, text, parsed: as values.parse_date): the longest run of words, one of first up to last among them, that is a date and nothing else.

    Of equally long dates the one that begins, then ends, first; null where there is none, or no word from first to last. The places in the result are negative: -first, -last.
    """
    starts = F.filter(F.sequence(F.greatest(F.lit(0), first - (DATE_WORDS - 1)), last - 1), lambda s: F.get(words, s).rlike(BEGIN))
    ends = lambda s: F.filter(F.sequence(F.greatest(s, first) + 1, F.least(s + DATE_WORDS, F.size(words))), lambda e: F.get(words, e - 1).rlike(END))
    runs = F.flatten(F.transform(starts, lambda s: F.transform(ends(s), lambda e: F.struct((-s).alias("first"), (-e).alias("last"), F.array_join(F.slice(words, s + 1, e - s), " ").alias("run")))))
    likely = F.filter(runs, lambda x: (F.length(x["run"]) <= DATE_SIGNS) & x["run"].rlike(DATE))
    bare = F.transform(likely, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), values.bare(x["run"]).alias("text")))
    sized = F.transform(bare, lambda x: F.struct(F.length(x["text"]).alias("size"), x["first"].alias("first"), x["last"].alias("last"), x["text"].alias("text"), values.parse_date(x["text"]).alias("parsed")))
    dates = F.filter(sized, lambda x: x["parsed"]["date"].isNotNull())
    return F.when(first < last, F.array_max(dates))


def _within(first: Column, last: Column, spans: Column, side: str) -> Column:
    """Whether each word from first up to last lies in one of the spans; so it is where there is no word."""
    return (first == last) | F.forall(F.sequence(first, last - 1), lambda i: F.exists(spans, lambda s: (s[f"{side}_from"] <= i) & (i < s[f"{side}_to"])))


def _consumed(x: Column, spans: Column) -> Column:
    return _within(x["old_from"], x["old_to"], spans, "old") & _within(x["new_from"], x["new_to"], spans, "new")


def value_change(old: Column, new: Column) -> Column:
    """struct(category, difference) of two texts that are values of one category, dates that could be read in two ways apart; null for others. In lambdas, for as
    plain columns the rules are too long to be compiled."""
    kinds = F.transform(F.array(old, new), lambda c: F.struct(F.coalesce(c, F.lit("")).alias("c"), values.kind_of(F.coalesce(c, F.lit(""))).alias("kind")))
    of_one = F.filter(F.array(kinds), lambda p: F.coalesce(values.category_of(p[0]["kind"]) == values.category_of(p[1]["kind"]), F.lit(False)))
    parsed = F.transform(of_one, lambda p: F.transform(p, lambda x: values.typed(x["c"])))
    clear = F.filter(parsed, lambda p: ~((p[0]["kind"] == "date") & (p[0]["ambiguous"] | p[1]["ambiguous"])))
    return F.get(F.transform(clear, lambda p: F.struct(values.category_of(p[0]["kind"]).alias("category"), values.value_delta(p[0], p[1]).alias("difference"))), F.lit(0))


def typed(pairs: DataFrame, old: str = "old_text", new: str = "new_text", segments: str = "segments") -> DataFrame:
    """The rows of pairs, once for each change, with (nth, kind, category, old_value, new_value, difference, old_from, old_to, new_from, new_to).

    segments: the runs of words in which the texts differ, as align.segments gives them for normalised texts. Changed dates come first, in the order of the runs that they hold;
    a run whose words all lie in them is not reported. Runs whose values are of one category on both sides are changes of these values, others are changes of
    text. Dates that could be read in two ways are text. A pair without runs has no rows.
    """
    words = lambda c: text.tokens(F.coalesce(F.col(c), F.lit("")))
    df = pairs.withColumns({"_old": words(old), "_new": words(new)})
    near = lambda side, x: F.array_join(F.slice(f"_{side}", F.greatest(F.lit(1), x[f"{side}_from"] - (DATE_WORDS - 2)), x[f"{side}_to"] - x[f"{side}_from"] + 2 * DATE_WORDS - 2), " ").rlike(values.DATED)
    dated = F.filter(segments, lambda x: (x["old_from"] < x["old_to"]) & (x["new_from"] < x["new_to"]) & near("old", x) & near("new", x))
    spans = F.transform(dated, lambda x: F.struct(x.alias("x"), date_span(F.col("_old"), x["old_from"], x["old_to"]).alias("o"), date_span(F.col("_new"), x["new_from"], x["new_to"]).alias("n")))
    df = df.withColumn("_spans", F.filter(spans, lambda s: s["o"].isNotNull() & s["n"].isNotNull() & ~s["o"]["parsed"]["ambiguous"] & ~s["n"]["parsed"]["ambiguous"] & (s["o"]["parsed"]["date"] != s["n"]["parsed"]["date"])))

    def step(done: Column, s: Column) -> Column:
        o, n = s["o"], s["n"]
        one = F.struct((-o["first"]).alias("old_from"), (-o["last"]).alias("old_to"), (-n["first"]).alias("new_from"), (-n["last"]).alias("new_to"), o["text"].alias("old_date"), n["text"].alias("new_date"), values.date_delta(o["parsed"]["date"], n["parsed"]["date"]).alias("difference"))
        return F.when(_consumed(s["x"], done), done).otherwise(F.concat(done, F.array(one)))

    df = df.withColumn("_dates", F.aggregate("_spans", F.array().cast(f"array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>"), step))
    dates = F.transform("_dates", lambda d: F.struct(F.lit(True).alias("date"), d["old_date"].alias("a"), d["new_date"].alias("b"), d["difference"].alias("difference"), d["old_from"].alias("old_from"), d["old_to"].alias("old_to"), d["new_from"].alias("new_from"), d["new_to"].alias("new_to")))
    left = F.filter(segments, lambda x: ~_consumed(x, F.col("_dates")))
    rest = F.transform(left, lambda x: F.struct(F.lit(False).alias("date"), F.when(x["old_from"] < x["old_to"], x["old"]).alias("a"), F.when(x["new_from"] < x["new_to"], x["new"]).alias("b"), F.lit(None).cast("string").alias("difference"), x["old_from"].alias("old_from"), x["old_to"].alias("old_to"), x["new_from"].alias("new_from"), x["new_to"].alias("new_to")))
    names = [c for c in pairs.columns if c != segments]
    every = df.select(*names, F.posexplode(F.concat(dates, rest)).alias("nth", "_c"))
    both = F.transform(F.array("_c.a", "_c.b"), lambda x: F.struct(x.alias("c"), F.when(~F.col("_c.date") & x.rlike("[0-9]"), values.kind_of(x)).alias("kind")))  # of a date all is known
    every = every.withColumn("_v", F.transform(both, lambda x: F.when(x["kind"].isNotNull(), values.value_in(x["c"], x["kind"]))))
    kind = lambda v, t: F.when(v.rlike(r"^(?:18|19|20|21)[0-9]{2}$"), "year").otherwise(t["kind"])
    every = every.withColumn("_t", F.transform("_v", lambda v: F.when(v.isNotNull(), values.once(values.typed(v), lambda t: F.struct(values.category_of(kind(v, t)).alias("category"), t.alias("t"))))))
    a, b = F.col("_t")[0], F.col("_t")[1]
    same = a["category"]
    clear = ~((same == "date") & (a["t"]["ambiguous"] | b["t"]["ambiguous"]))
    own = F.coalesce((same == b["category"]) & clear, F.lit(False))
    every = every.withColumn("_own", own).withColumn("_delta", F.transform(F.when(F.col("_own"), F.array("_t")), lambda x: values.value_delta(x[0]["t"], x[1]["t"]))[0])  # in a lambda, for as plain columns it is too long to be compiled
    own = F.col("_own")
    date = F.col("_c.date")
    c = lambda n: F.col(f"_c.{n}")
    return every.select(
        *names, "nth", F.when(c("a").isNull(), "added").when(c("b").isNull(), "removed").otherwise("modified").alias("kind"), F.when(date, "date").when(own, same).otherwise("text").alias("category"),
        F.when(~date & own, F.col("_v")[0]).otherwise(c("a")).alias("old_value"), F.when(~date & own, F.col("_v")[1]).otherwise(c("b")).alias("new_value"),
        F.when(date, c("difference")).otherwise(F.col("_delta")).alias("difference"), *(c(n).alias(n) for n in ("old_from", "old_to", "new_from", "new_to")),
    )
