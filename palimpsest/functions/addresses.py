"""Addresses of both families as 128 bits, and the network that an address belongs to by its longest prefix.

An IPv4 address is the last 32 bits of its mapped form, so one table of networks serves both, and what an IPv6 address carries of IPv4 is judged as IPv4. Addresses are two numbers of 64 bits; a prefix is
those with all bits after it 0, so an address meets the networks of one prefix length by equality.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Networks that no page may be fetched from, beside those of IPv4.
CLOSED_V6 = ["::/128", "::1/128", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/32", "2001:2::/48", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8"]
MAPPED = 0xFFFF << 32  # the lower half of a mapped address, without its IPv4


V4 = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DOTTED, GROUP = rf"{V4}\.{V4}\.{V4}\.{V4}", r"[0-9a-f]{1,4}"
V6 = rf"^({GROUP}(:{GROUP})*)?::({GROUP}(:{GROUP})*)?$|^{GROUP}(:{GROUP}){{7}}$"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _four(own: Column) -> Column:
    """The number of the IPv4 address at the end of a text."""
    byte = lambda k: F.regexp_extract(own, rf"(?:^|:){DOTTED}$", k).try_cast("long")
    return byte(1) * (1 << 24) + byte(2) * (1 << 16) + byte(3) * 256 + byte(4)


def _groups(whole: Column) -> Column:
    """The eight groups of an IPv6 address, null for anything else."""
    parts = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")
    sides = _let(F.split(whole, "::", -1), lambda s: F.struct(parts(F.get(s, F.lit(0))).alias("left"), F.when(F.size(s) == 2, parts(F.get(s, F.lit(1)))).alias("right")))
    filled = _let(sides, lambda s: F.when(s["right"].isNull(), s["left"]).when(F.size(s["left"]) + F.size(s["right"]) <= 7, F.concat(s["left"], F.array_repeat(F.lit("0"), 8 - F.size(s["left"]) - F.size(s["right"])), s["right"])))
    return F.when(whole.rlike(V6), _let(filled, lambda g: F.when(F.size(g) == 8, g)))


def _half(groups: Column, first: int) -> Column:
    """Four groups of four hexadecimal digits as a number of 64 bits, from -2 ** 63."""
    return F.conv(F.concat(*(F.lpad(F.get(groups, F.lit(first + k)), 4, "0") for k in range(4))), 16, -10).cast("long")


def address(text: Column) -> Column:
    """struct(high long, low long) of an address of either family, null for anything else. Brackets around it are none of it; a zone (%eth0) makes it none."""
    both = lambda high, low: F.struct(high.alias("high"), low.alias("low"))

    def of(own: Column) -> Column:
        mapped = _let(_four(own), lambda n: F.concat(F.regexp_replace(own, rf"{DOTTED}$", ""), F.lower(F.hex(F.shiftrightunsigned(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF))))))
        whole = F.when(own.rlike(rf":{DOTTED}$"), mapped).otherwise(own)
        six = _let(_let(whole, _groups), lambda g: F.when(g.isNotNull(), both(_half(g, 0), _half(g, 4))))
        return F.when(own.rlike(f"^{DOTTED}$"), both(F.lit(0).cast("long"), _four(own) + MAPPED)).otherwise(six)

    return _let(F.lower(F.regexp_replace(text, r"^\[(.*)\]$", "$1")), of)


def closed(text: Column, nets: list[str]) -> Column:
    """Whether an address lies in one of a few networks; false for what is no address. IPv4 within IPv6 is judged as IPv4."""
    signed = lambda n: n - (n >> 63 << 64)

    def within(a: Column) -> Column:
        out = F.lit(False)
        for net in map(ipaddress.ip_network, nets):
            start, bits = (int(net.network_address) + MAPPED, net.prefixlen + 96) if net.version == 4 else (int(net.network_address), net.prefixlen)
            high, low = prefix(a["high"], a["low"], bits)
            out = out | ((high == signed(start >> 64)) & (low == signed(start & (1 << 64) - 1)))
        return out

    return F.coalesce(_let(address(text), within), F.lit(False))


def prefix(high: Column, low: Column, bits: int) -> list[Column]:
    """Both halves with all bits after the first `bits` 0."""
    mask = lambda n: -1 << (64 - n) if n else 0
    return [high.bitwiseAND(F.lit(mask(min(64, bits))).cast("long")), low.bitwiseAND(F.lit(mask(max(0, bits - 64))).cast("long"))]


def networks(df: DataFrame) -> DataFrame:
    """df with network (address/bits) as (high, low, bits); bits of an IPv4 network are those of its mapped form. Rows that name none are left out."""
    base, given = F.substring_index("network", "/", 1), F.regexp_extract("network", r"/([0-9]{1,3})$", 1).try_cast("int")
    most = F.when(base.contains(":"), 128).otherwise(32)
    own = df.withColumns({"_a": address(base), "bits": F.coalesce(given, most) + 128 - most}).where(F.col("_a").isNotNull() & F.col("bits").between(128 - most, 128))
    return own.select(*df.columns, F.col("_a.high").alias("high"), F.col("_a.low").alias("low"), "bits")


def longest_prefix(addresses: DataFrame, nets: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """addresses (…, high, low) with network and bits of the longest of the nets that holds them; null where none does.

    nets: networks(). An address is looked up once for each prefix length that the table has, by equality. lengths: these, where they are known; else the table is asked, which gives 129 at most.
    """
    lengths = lengths if lengths is not None else sorted(r.bits for r in nets.select("bits").distinct().collect())
    names = addresses.columns
    numbered = addresses.withColumn("_row", F.struct(*names))
    tries = F.array(*(F.struct(F.lit(n).alias("bits"), prefix(F.col("high"), F.col("low"), n)[0].alias("high"), prefix(F.col("high"), F.col("low"), n)[1].alias("low")) for n in lengths)) if lengths else F.array().cast("array<struct<bits:int,high:long,low:long>>")
    known = nets.groupBy("high", "low", "bits").agg(F.min("network").alias("network"))
    met = numbered.select("_row", F.explode(tries).alias("_t")).select("_row", F.col("_t.high").alias("high"), F.col("_t.low").alias("low"), F.col("_t.bits").alias("bits")).join(known, ["high", "low", "bits"])
    best = met.groupBy("_row").agg(F.max_by("network", "bits").alias("network"), F.max("bits").alias("bits"))
    return numbered.join(best, numbered["_row"].eqNullSafe(best["_row"]), "left").select(*(addresses[c] for c in names), "network", "bits")
