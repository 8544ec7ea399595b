"""Field rules as expressions: allow-lists, ordered reasons, opening periods, addresses, link fragments, sets, orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def one_of(c: Column, allowed: list, default=None) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def exact(c: Column, value) -> Column:
    return F.when(c == F.lit(value), c)


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def with_duplicates(df: DataFrame, keys: list[str], order: list[str], reason: str) -> DataFrame:
    """df with its column reason also set for rows that follow one of the same keys that has none."""
    w = Window.partitionBy(*keys, F.col("reason").isNull()).orderBy(*order)
    again = F.col("reason").isNull() & (F.row_number().over(w) > 1)
    return df.withColumn("reason", F.when(again, reason).otherwise(F.col("reason")))


def staged(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, n: how many rows have passed each stage and all before it, from one aggregation."""
    upto, counts = F.lit(True), []
    for name, rule in stages.items():
        upto = upto & rule
        counts.append(F.struct(F.lit(name).alias("stage"), F.count_if(upto).alias("n")))
    return df.agg(F.array(*counts).alias("counts")).select(F.explode("counts").alias("c")).select("c.*")


def rank_of(c: Column, order: list) -> Column:
    """The place of a value in a list; values that it lacks come last."""
    return F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))


def same_set(a: Column, b: Column) -> Column:
    return subset(a, b) & subset(b, a)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def opens_evenings(hours: Column) -> Column:
    return F.exists(hours, lambda p: (p["day"] < 5) & (p["close"] > "18:00"))


def opens_weekends(hours: Column) -> Column:
    return F.exists(hours, lambda p: p["day"] >= 5)


def open_at(hours: Column, local: Column) -> Column:
    """Whether a period (day from Monday, open, close) holds a local time; null without periods."""
    now = F.date_format(local, "HH:mm")
    return F.when(F.size(hours) > 0, F.exists(hours, lambda p: (p["day"] == F.weekday(local)) & (p["open"] <= now) & (now < p["close"])))


def format_hours(hours: Column, clock) -> Column:
    """'Mon-Fri 8am-5pm, Sat 9am-2pm': days of the same hours that follow each other are one run; null without any."""
    of_day = lambda d: F.array_join(F.transform(F.filter(hours, lambda p: p["day"] == d), lambda p: F.concat(clock(p["open"]), F.lit("-"), clock(p["close"]))), ", ")
    one = lambda a, b, h: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), h.alias("h"))

    def step(runs, day):
        last = F.try_element_at(runs, F.lit(-1))
        goes_on = (last["h"] == day["h"]) & (last["b"] == day["d"] - 1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(one(last["a"], day["d"], day["h"])))
        return F.when(day["h"] == "", runs).when(goes_on, longer).otherwise(F.concat(runs, F.array(one(day["d"], day["d"], day["h"]))))

    days = F.array(*[F.struct(F.lit(d).alias("d"), of_day(d).alias("h")) for d in range(7)])
    runs = F.aggregate(days, F.array().cast("array<struct<a:int,b:int,h:string>>"), step)
    name = lambda d: F.element_at(F.array(*map(F.lit, DAYS)), d + 1)
    shown = F.transform(runs, lambda r: F.concat(name(r["a"]), F.when(r["b"] > r["a"], F.concat(F.lit("-"), name(r["b"]))).otherwise(""), F.lit(" "), r["h"]))
    return F.when(F.size(hours) > 0, F.array_join(shown, ", "))


def network(ip: Column) -> Column:
    """An address as a key: IPv4 as it is, also out of an IPv6 form of it; of other IPv6 addresses the first 64 bits."""
    t = F.lower(F.trim(ip))
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    head, tail = groups(F.substring_index(t, "::", 1)), groups(F.when(t.contains("::"), F.substring_index(t, "::", -1)).otherwise(""))
    whole = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail))), tail)
    first = F.transform(F.slice(whole, 1, 4), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    return F.when(~t.contains(":"), t).when(t.contains("."), F.substring_index(t, ":", -1)).otherwise(F.concat(F.array_join(first, ":"), F.lit("::/64")))


def fragment(link: Column, keys: list[str], longest: int = 256) -> Column:
    """A struct of the keys' values in a link's fragment; a key that is repeated counts as absent."""
    parts = F.filter(F.split(F.regexp_replace(link, "^#", ""), "&"), lambda p: F.instr(p, "=") > 1)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    only = lambda key: F.filter(pairs, lambda p: p["k"] == key)
    short = F.length(link) <= longest
    return F.struct(*[F.when(short & (F.size(only(k)) == 1), F.element_at(only(k), 1)["v"]).alias(k) for k in keys])


def date_is_plausible(c: Column, least_year: int = 1900, last_year: int = 2100) -> Column:
    """Whether a text is a date that can be one: month and day in either order, or year first."""
    n = F.transform(F.regexp_extract_all(c, F.lit("\\d+"), F.lit(0)), lambda x: x.cast("int"))
    at = lambda i: F.try_element_at(n, F.lit(i))
    day_month = lambda a, b: a.between(1, 12) & b.between(1, 31) | a.between(1, 31) & b.between(1, 12)
    year = lambda y: y.between(0, 99) | y.between(least_year, last_year)
    return F.coalesce((F.size(n) == 3) & (day_month(at(1), at(2)) & year(at(3)) | at(1).between(least_year, last_year) & day_month(at(2), at(3))), F.lit(False))


def settled(outcome: Column, refunds: dict[str, list[str]], kind: Column) -> Column:
    """Whether a reservation of a kind of bucket is given back after an outcome."""
    return reduce(lambda a, b: a | b, [(outcome == o) & kind.isin(*kinds) for o, kinds in refunds.items()], F.lit(False))


def keyed_hash(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a text as lower-case hexadecimal digits; the key is the caller's and at most 64 bytes long."""
    if len(key) > 64:
        raise ValueError("the key is longer than a block of the hash")
    pad = lambda b: F.lit(bytes(x ^ b for x in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def sealed(text: Column, key: Column, context: Column) -> Column:
    """AES-GCM of a text, bound to a context that must be the same to open it; every call draws a new nonce."""
    return F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), context.cast("binary"))


def opened(cipher: Column, key: Column, context: Column) -> Column:
    """The text again; null if the key or the context is another one, or the bytes were changed."""
    return F.try_aes_decrypt(cipher, key, F.lit("GCM"), F.lit("DEFAULT"), context.cast("binary")).cast("string")
