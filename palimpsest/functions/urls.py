"""URL functions: tracking parameters, same page, validity, IPv4 ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import addresses

# Query parameters that only track.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic", "gclid", "gclsrc", "dclid",
    "fbclid", "msclkid", "yclid", "igshid", "ttclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "vero_id", "vero_conv", "wickedid", "oly_anon_id", "oly_enc_id", "s_kwcid", "twclid",
]
# Query parameters that name a session, a moment or a copy in a cache.
OPAQUE = ["sid", "sessid", "sessionid", "session_id", "phpsessid", "jsessionid", "cachebuster", "cb", "_", "ts", "timestamp", "nocache", "rand", "r", "v"]
# Fixed value: the path of links whose fragment is an e-mail address in disguise, new on every load.
MAIL_PATH = r"(?i)/cdn-cgi/l/email-protection/?$"
# IPv4 ranges that aren't public.
CLOSED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def strip_tracking(url: Column) -> Column:
    base, rest = F.substring_index(url, "?", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(rest, "&"), lambda p: (p != "") & ~name(p).isin(TRACKING))
    query = F.array_join(kept, "&")
    before = F.substring_index(url, "#", 1)
    clean = F.when(F.instr(before, "?") == 0, url).otherwise(F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), fragment))
    return F.when(F.substring_index(before, "?", 1).rlike(MAIL_PATH), F.substring_index(clean, "#", 1)).otherwise(clean)


def opaque_difference(old: Column, new: Column) -> Column:
    """Whether two links lead to the same place and only their opaque parameters differ. Parameters count in any order, decoded."""
    whole = lambda u: F.substring_index(u, "#", 1)
    query = lambda u: F.regexp_extract(whole(u), r"\?(.*)$", 1)
    named = lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("=")))
    meant = lambda u: F.array_sort(F.transform(F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(OPAQUE)), lambda p: F.coalesce(F.try_url_decode(named(p)), named(p))))
    place = lambda u: F.substring_index(whole(u), "?", 1)
    return F.coalesce((place(old) == place(new)) & (meant(old) == meant(new)) & (query(old) != query(new)), F.lit(False))


def page_key(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "#", 1), "/+$", "")


def problem(url: Column) -> Column:
    """Why a URL may not be fetched, or null."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1))
    port = F.regexp_extract(url, r"^[a-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    return (
        F.when(F.length(url) > 2048, "too long").when(~url.rlike("^https?://"), "scheme").when(url.rlike("^https?://[^/?#]*@"), "credentials").when(host == "", "no host")
        .when((port != "") & ~port.isin("80", "443"), "port").when((host == "localhost") | host.endswith(".local") | host.endswith(".internal"), "host").when(addresses.closed(host, [*CLOSED, *addresses.CLOSED_V6]), "address")
    )


def ipv4(text: Column) -> Column:
    part = F.split(text, r"\.")
    number = sum(F.element_at(part, k + 1).try_cast("long") * 256 ** (3 - k) for k in range(4))
    return F.when(text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), number)


def closed_ipv4(text: Column) -> Column:
    number, out = ipv4(text), F.lit(False)
    for cidr in CLOSED:
        net, bits = cidr.split("/")
        low = sum(int(p) << 8 * (3 - k) for k, p in enumerate(net.split(".")))
        out = out | number.between(low, low + (1 << 32 - int(bits)) - 1)
    return F.coalesce(out, F.lit(False))
