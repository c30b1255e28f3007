"""Personal data by regular expressions, checksum validators and context words, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Account number lengths by country, from the registry of IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNT = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
#: The base patterns by kind, in the order in which spans of one start are listed. Quantifiers are
#: possessive, and a match may only begin where the one before ended or a run of its first characters begins: that
#: finds the same matches without trying each place of a long run again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_ACCOUNT})(?![A-Za-z0-9])",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words near a span that make it likelier, by kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|reply)",
    "ip": r"(?i)\b(?:ip|address|host|server|login)",
    "card": r"(?i)\b(?:card|visa|credit|payment|number)",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile)",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)",
}
NEAR = 40
#: Score of a span that its validator confirms, of one of an added kind that isn't in its usual form, and what context
#: adds. Added kinds need EXTRA_SCORE: context decides on those of unusual form.
BASE_SCORE, ODD_SCORE, CONTEXT_SCORE, EXTRA_SCORE = 0.7, 0.5, 0.2, 0.7
#: The usual form of an added kind: account numbers without spaces or in groups of four.
USUAL = {"iban": r"^(?:[A-Z0-9]+|[A-Z0-9]{4}(?: [A-Z0-9]{4})*(?: [A-Z0-9]{1,3})?)$"}
BASE_KINDS = ("email", "ip", "card", "phone")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves remainder 1: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.replace(found, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    return F.lit(True)


def _of(kind: str):
    return lambda x: x["kind"] == kind


def _placed(text: Column, kind: str, matches: Column) -> Column:
    """Confirmed spans of one kind. Matches and the gaps between them come in the same order, so each start is the
    length of all that stands before it; lengths count code points."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<found:string,start:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct(
            (start + F.length(x["found"])).alias("at"),
            F.when(valid(kind, x["found"]), F.concat(acc["out"], F.array(F.struct(x["found"].alias("found"), start.alias("start"))))).otherwise(acc["out"]).alias("out"),
        )

    pairs = F.arrays_zip(matches.alias("found"), F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(matches)).alias("gap"))

    def scored(x: Column) -> Column:
        end = x["start"] + F.length(x["found"])
        low = F.greatest(x["start"] - NEAR, F.lit(0))
        near = F.concat_ws(" ", F.substring(text, low + 1, x["start"] - low), F.substring(text, end + 1, F.lit(NEAR)))
        base = F.when(x["found"].rlike(USUAL[kind]), F.lit(BASE_SCORE)).otherwise(F.lit(ODD_SCORE)) if kind in USUAL else F.lit(BASE_SCORE)
        score = base + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
        return F.struct(x["start"].alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return F.transform(F.aggregate(pairs, empty, add, lambda acc: acc["out"]), scored)


def _with_spans(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``__spans``, array of struct(start, rank, end, kind, score) in order.

    In steps of one projection each: the matches, by one pass a kind over the texts that can hold it; then, only for
    texts where a match passes its check, the places.
    """
    text = F.col("__text")
    df = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    found = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    df = df.select("*", *(F.when(F.instr(text, NEEDS[k]) > 0, m).alias(f"__{k}") if k in NEEDS else m.alias(f"__{k}") for k, m in found.items()))

    def checked(kind: str):
        return lambda m: valid(kind, m)

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    placed = [F.when((F.size(f"__{k}") > 0) & F.exists(f"__{k}", checked(k)), _placed(text, k, F.col(f"__{k}"))).otherwise(none) for k in PATTERNS]
    placed[-1] = F.filter(placed[-1], lambda x: x["score"] >= EXTRA_SCORE)
    return df.withColumn("__spans", F.array_sort(F.concat(*placed)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, pii_spans)``: for every row the confirmed spans, struct(kind, start, end, score), sorted by start,
    then by the order of PATTERNS.

    Base kinds (email, ip, card, phone) are all kept once their check passes; IBANs of their country's length are added
    where mod-97 passes and they are in the usual form or context words are near. Context words near a span raise its score. Places count code points, ends are exclusive. Null and
    empty texts have no spans; rows are independent, so repeated rows and null ids repeat their result; other
    columns aren't read; an empty table gives an empty result.
    """
    rows = _with_spans(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__raw")), "__raw")
    plain = F.transform("__spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return rows.select(F.col("__id").alias(id_col), plain.alias("pii_spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each confirmed span replaced by its kind in angle brackets, and n_chars by the new length.

    Where spans overlap, the first (then the one of the earlier kind) is replaced and those that begin inside it go
    with it, their rest included. All columns are kept in their order; a null text stays null. It needs no key.
    """
    text = F.col("text")
    tagged = _with_spans(docs.select(F.struct(*docs.columns).alias("__row"), "text"), "text")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate("__spans", first, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size("__spans") > 0, rest).otherwise(text)
    tagged = tagged.select("__row", (F.size("__spans") > 0).alias("__found"), clean.alias("text"))

    def column(name: str) -> Column:
        if name == "text":
            return text
        if name == "n_chars":
            return F.when(F.col("__found"), F.length(text).cast(docs.schema[name].dataType)).otherwise(F.col("__row")[name]).alias(name)
        return F.col("__row")[name].alias(name)

    return tagged.select(*(column(c) for c in docs.columns))


def pii_query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("pii_spans", _of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
