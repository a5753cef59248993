"""Prices in questions and texts: base price, discount and fees by their places, discounts of an offer, the price that follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .guards import any_of, parse_money, price_after_discount
from .spans import AFTER, BEFORE, around, let, matches, number, overlaps
from .textnorm import norm_ascii

# How amounts and discounts are written, and words that tell what an amount is for.
AMOUNTS = (r"[0-9][0-9., ]{0,16}\s*(?:vnd|dong|đ)", r"[0-9]+(?:[.,][0-9]+)?\s*(?:tr|tri[eê]u)", r"[0-9]+(?:[.,][0-9]+)?\s*(?:k|nghin|ngan|ngàn|nghìn)", r"[0-9]+(?:[.,][0-9]+)?\s*(?:cu|củ)", r"[0-9]+(?:[.,][0-9]+)?\s*(?:canh|cành)")
CASH_OFF = rf"(?iu){BEFORE}(?:giam|giảm)\s+([^\n,;]{{1,30}})"
PERCENT = r"([0-9]{1,3}(?:[.,][0-9]+)?)\s*%"
SMALL_PERCENT = r"([0-9]{1,2}(?:[.,][0-9]+)?)\s*%"
ON_TOTAL = ("giam tong", "giam tren tong", "tren tong", "tong chi phi", "tong tien", "tong thanh toan", "tong cong")
MONTHLY = ("moi thang", "tung thang", "hang thang", "per month")
FEE_WORDS = ("giao trinh", "tai lieu", "hoc lieu", "material", "gui xe", "phu phi", "le phi", "phi xep lop", "phi hoc lieu", "xep lop")
PRICE_WORDS = ("hoc phi", "goi hoc", "tron goi", "tuition")
LINE = r"\r\n|[\n\r]"


def _cash(col):
    """The places of cash discounts: what follows the word for them, up to 30 characters, without a percent sign."""
    found = F.filter(matches(col, CASH_OFF, 1), lambda m: ~m["part"].contains("%"))
    return F.transform(found, lambda m: F.struct((m["end"] - F.length(m["part"])).alias("start"), m["end"].alias("end"), parse_money(m["part"]).alias("amount")))


def tuition_args(col):
    """struct(base_price, discount_percent, discount_cash, discount_type, discount_scope, discount_period, surcharges).

    Amounts that share characters with a cash discount are no price. Of the others, those of a million or more near a word for tuition are the base price
    (the largest), those near a word for fees are surcharges, and without a base price the largest of the rest is it. "Near" is 40 characters.
    """
    q = F.trim(F.coalesce(col, F.lit("")))
    percent = number(F.nullif(F.regexp_extract(q, PERCENT, 1), F.lit("")))
    every = F.concat(*[matches(q, f"(?iu){BEFORE}{p}{AFTER}") for p in AMOUNTS])
    price = lambda m: (m["amount"] >= 1_000_000) & any_of(m["near"], PRICE_WORDS)
    fee = lambda m: ~price(m) & any_of(m["near"], FEE_WORDS)

    def amounts(cash):
        told = F.transform(F.filter(every, lambda m: ~overlaps(m, cash)), lambda m: F.struct(parse_money(m["text"]).alias("amount"), m["text"].alias("label"), norm_ascii(around(q, m, 40)).alias("near")))
        off = F.get(F.filter(cash, lambda c: c["amount"] > 0), F.lit(0))["amount"]
        return F.struct(off.alias("off"), F.filter(told, lambda m: m["amount"] > 0).alias("told"), norm_ascii(q).alias("norm"))

    def args(x):
        largest = lambda f: F.array_max(F.transform(F.filter(x["told"], f), lambda m: m["amount"]))
        return F.struct(
            F.coalesce(largest(price), largest(lambda m: ~price(m) & ~fee(m))).alias("base_price"),
            percent.alias("discount_percent"),
            F.when(percent.isNull(), x["off"]).alias("discount_cash"),
            F.when(percent.isNotNull(), "percent").when(x["off"].isNotNull(), "cash").alias("discount_type"),
            F.when(any_of(x["norm"], ON_TOTAL), "total").otherwise("tuition").alias("discount_scope"),
            F.when(any_of(x["norm"], MONTHLY), "per_month").otherwise("one_time").alias("discount_period"),
            F.transform(F.filter(x["told"], fee), lambda m: F.struct(m["amount"], F.trim(m["label"]).alias("label"))).alias("surcharges"),
        )

    return let(let(_cash(q), amounts), args)


def price_from_args(args):
    """struct(final, fees, needs_discount): the price after ``tuition_args``; null where its discount is not valid, or where base or discount are missing."""
    fees = F.aggregate(args["surcharges"], F.lit(0).cast("long"), lambda a, s: a + s["amount"])
    final = price_after_discount(args["base_price"], fees, args["discount_percent"], args["discount_cash"], args["discount_scope"] == "total")
    missing = args["discount_type"].isNull()
    return F.struct(F.when(~missing, final).alias("final"), fees.alias("fees"), missing.alias("needs_discount"))


def _percents(col):
    found = F.transform(F.regexp_extract_all(col, F.lit(SMALL_PERCENT), F.lit(1)), number)
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: (p > 0) & (p <= 100))))


def extract_discounts(col):
    """struct(percents, combo, cash): all percentages of a text in order, the largest one up to 50 of a combo offer, and a cash discount.

    A combo's percentage stands on a line that names a combo or, without one there, on the next line unless that starts an item of its own. Where no
    line has one, it is what the word for discounts says within 120 characters after "combo". A cash discount with a percent sign in its 20 characters is none.
    """
    text = F.coalesce(col, F.lit(""))
    lines = F.transform(F.split(text, LINE), lambda s: F.struct(s.alias("line"), norm_ascii(s).contains("combo").alias("combo"), _percents(s).alias("p")))

    def offered(x, i):
        after = F.get(lines, i + 1)
        bare = F.trim(after["line"])
        runs_on = after["combo"] | ((bare != "") & ~bare.rlike(r"^[-*]|^[0-9]+[.)]\s+"))
        own = F.size(x["p"]) > 0
        return F.when(x["combo"] & own, x["p"]).when(x["combo"] & F.coalesce(runs_on, F.lit(False)), after["p"]).otherwise(F.array().cast("array<double>"))

    by_line = F.array_max(F.filter(F.flatten(F.transform(lines, offered)), lambda p: p <= 50))
    far = number(F.nullif(F.regexp_extract(text, rf"(?isu){BEFORE}combo{AFTER}.{{0,120}}?{BEFORE}giam\s*([0-9]{{1,2}}(?:[.,][0-9]+)?)\s*%", 1), F.lit("")))
    cash = F.regexp_extract(text, rf"(?iu){BEFORE}(?:giảm|giam)\s+([^\n,;]{{1,20}})", 1)
    return F.struct(_percents(text).alias("percents"), F.coalesce(by_line, F.when((far > 0) & (far <= 50), far)).alias("combo"), F.when(~cash.contains("%"), parse_money(cash)).alias("cash"))
