"""Rule tables over texts: topics (any number), one pricing category, calls to action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

# Topic, phrases.
VERSION = "2"
PHRASES = {
    "privacy": ["privacy", "personal data", "personal information"],
    "cookies": ["cookie", "cookies"],
    "data_sharing": ["third party", "third parties", "third-party", "third-parties", *(f"{s} {of}{what}" for s in ("share", "sharing") for of in ("", "of ") for what in ("data", "information"))],
    "retention": ["retention", "retain", "retained"],
    "security": ["security", "encrypted", "encryption"],
    "payment": ["payment", "payments", "billing", "invoice", "invoices"],
    "refund": ["refund", "refunds"],
    "cancellation": ["cancel", "cancellation", "cancelled"],
    "liability": ["liable", "liability", "indemnify", "indemnification"],
    "termination": ["terminate", "termination"],
    "governing_law": ["governing law", "jurisdiction"],
    "arbitration": ["arbitration", "dispute resolution"],
    "licence": ["licence", "license", "licenced", "licensed", "copyright"],
    "contact": ["contact us", "email", "e-mail"],
}
#: For SQL: topic, pattern.
TOPICS = [(topic, "|".join(phrases)) for topic, phrases in PHRASES.items()]
RULES = sorted((topic, phrase, VERSION, k) for k, (topic, phrases) in enumerate(PHRASES.items()) for phrase in phrases)
MONEY = r"(\$|€|£|₹|usd |eur |gbp |inr )\s?[0-9][0-9,]*(\.[0-9]+)?"
SALE, WAS, PERIOD, STOCK, PLAN = r"\b(sale|discount|save|off)\b", r"\b(was|originally|rrp|list price)\b", r"\b(per|/) ?(month|year|user|seat|week|day)\b|\b(monthly|yearly|annually)\b", r"\b(in stock|out of stock|sold out|available|pre-?order)\b", r"\b(plan|tier|basic|pro|premium|enterprise)\b"
CTA = r"\b(buy now|sign up|start (a |your )?free trial|get started|subscribe|book a demo|contact sales|learn more|download)\b"


def topics(df: DataFrame, text: str, heading: str | None = None) -> DataFrame:
    """df with one row for each topic of its text, or of its heading: topic, source, phrase, start, stop, rules_version. A text is read once for all topics."""
    found = rules.signals(df, RULES, text, heading).drop("precedence")
    return found.withColumnsRenamed({"label": "topic", "version": "rules_version"})


def price_category(text: Column) -> Column:
    low = F.lower(text)
    money = low.rlike(MONEY)
    return F.when(money & low.rlike(WAS), "original_price").when(money & low.rlike(SALE), "sale_price").when(money & low.rlike(PERIOD), "recurring_price").when(money, "price").when(low.rlike(STOCK), "availability").when(low.rlike(PERIOD), "billing").when(low.rlike(PLAN), "plan").otherwise("other")


def is_call_to_action(text: Column) -> Column:
    return (F.size(F.split(F.trim(text), r"\s+")) <= 8) & F.lower(text).rlike(CTA)
