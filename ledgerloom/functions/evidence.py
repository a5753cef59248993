"""Evidence in course texts: durations, tuition and fees told apart by what stands near them, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .guards import any_of, parse_money
from .spans import AFTER, APART, BEFORE, around, let, matches, number
from .textnorm import strip_accents

# Words near an amount that tell tuition from fees, and how values are written.
TUITION_NEAR = ("hoc phi", "tuition", "tron goi", "niem yet", "tong hoc phi", "tong chi phi", "chi phi")
FEE_NEAR = ("le phi", "phi thi", "thi thu", "phi giu cho", "giu cho", "phi tai lieu", "tai lieu", "material", "phu thu", "phi xep lop", "xep lop")
GROUPED = rf"(?iu){APART}[0-9][0-9., ]{{4,}}\s*(?:₫(?=[\p{{L}}\p{{N}}_])|(?:đ|vnd|dong){AFTER})"
MILLIONS = rf"(?iu){BEFORE}[0-9]+(?:[.,][0-9]+)?\s*(?:tr|tri[eệ]u){AFTER}"
FIELDS = {
    "duration_months": (rf"(?iu){BEFORE}([0-9]+(?:[.,][0-9]+)?)\s*(?:thang|tháng){AFTER}", "double"),
    "duration_weeks": (rf"(?iu){BEFORE}([0-9]+(?:[.,][0-9]+)?)\s*(?:tuan|tuần){AFTER}", "double"),
    "ielts_target": (rf"(?iu){BEFORE}ielts\s*([0-9](?:[.,][0-9])?){AFTER}", "double"),
    "toeic_target": (rf"(?iu){BEFORE}toeic\s*([0-9]{{3,4}}){AFTER}", "int"),
    "cefr_target": (rf"{BEFORE}(A1|A2|B1|B2|C1|C2){AFTER}", "string"),
}


def _norm(col):
    return F.regexp_replace(F.lower(strip_accents(col)), "[^a-z0-9]+", " ")


def _sorted(values):
    return F.array_sort(F.array_distinct(values))


def extract_evidence(col, split_fees: bool = True, least: int = 1_000_000, size: int = 60):
    """struct of sorted arrays without repeats; a field without values is null.

    With ``split_fees`` an amount is a fee where it is below ``least`` and no word for tuition stands within ``size`` characters, or where only a word for
    fees does; all others are tuition. Without it every amount is tuition.
    """
    text = F.coalesce(col, F.lit(""))
    money = F.concat(matches(text, GROUPED), matches(text, MILLIONS))

    def told(m):
        if not split_fees:
            return F.struct(parse_money(m["text"]).alias("amount"))
        near = _norm(around(text, m, size))
        amount, tuition = parse_money(m["text"]), any_of(near, TUITION_NEAR)
        return F.struct(amount.alias("amount"), (((amount < least) | any_of(near, FEE_NEAR)) & ~tuition).alias("fee"))

    amounts = F.filter(F.transform(money, told), lambda m: m["amount"].isNotNull())

    def field(name):
        pattern, kind = FIELDS[name]
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return _sorted(F.transform(found, lambda v: number(v).cast(kind) if kind != "string" else v))

    return let(amounts, lambda told: _evidence(told, field, split_fees))


def _evidence(amounts, field, split_fees: bool):
    values = lambda f: _sorted(F.transform(F.filter(amounts, f) if f else amounts, lambda m: m["amount"]))
    out = {n: field(n) for n in ("duration_months", "duration_weeks")}
    out |= {"tuition_vnd": values(lambda m: ~m["fee"]) if split_fees else values(None)} | ({"fees_vnd": values(lambda m: m["fee"])} if split_fees else {})
    out |= {n: field(n) for n in ("ielts_target", "toeic_target", "cefr_target")}
    return F.struct(*[F.when(F.size(v) > 0, v).alias(n) for n, v in out.items()])


def coerce_evidence(told, text):
    """Evidence that a model gave as JSON, over what ``text`` shows, without a split of fees. Fields of an object stay, the missing ones come from the text;
    the items of a list, or a string, are read in front of the text. Whatever else there is gives the text's evidence."""
    value = F.try_parse_json(told)
    kind = F.schema_of_variant(value)
    listed = F.array_join(F.transform(F.from_json(told, "array<string>"), lambda x: F.coalesce(x, F.lit("None"))), " | ")
    said = F.when(kind.startswith("ARRAY"), listed).when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    read = extract_evidence(F.concat_ws("\n", said, F.coalesce(text, F.lit(""))), split_fees=False)
    names = {"duration_months": "array<double>", "duration_weeks": "array<double>", "tuition_vnd": "array<bigint>", "ielts_target": "array<double>", "toeic_target": "array<int>", "cefr_target": "array<string>"}
    own = F.from_json(F.when(kind.startswith("OBJECT"), told), ", ".join(f"{n} {k}" for n, k in names.items()))
    return let(F.struct(own.alias("own"), read.alias("read")), lambda x: F.struct(*[F.coalesce(x["own"][n], x["read"][n]).alias(n) for n in names]))
