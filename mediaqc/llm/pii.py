"""Personal data in texts (DataFrame functions only): patterns propose, checksums confirm, context words adjust.

Each kind has a pattern that proposes spans, leftmost and non-overlapping, a validator (Luhn for cards, mod-97 for bank
accounts, ranges and digit counts for the others) and words that raise a span's score when they stand near it. The base
kinds (email, ip, card, phone) stay whatever their score, as long as their validator holds; ``iban`` and ``ssn`` are
added by the method and need a score of ``LEAST``. The patterns are written so that no text makes them slow: a match
begins where its run of characters begins or where the last match ended, and quantifiers are possessive.

Positions are found without any Python: splitting by the pattern gives the gaps between the matches, and prefix sums of
gap and match lengths give the starts, in code points.

Defined results: a null or empty text has no spans; a text of any length is read whole; overlapping spans of different
kinds all stay; each row is judged alone, so repeated rows repeat; other columns are not read. The counts of a text without
spans are 0 and its digest is that of the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaqc.llm.common import documents, text_of

LEAST = 0.5
CHUNK = 256


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def _mod97(m: Column) -> Column:
    """The number made of the rearranged account, letters as 10 to 35, leaves 1."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

    def step(rest, c):
        letter = F.ascii(c) >= 65
        return F.pmod(rest * F.when(letter, 100).otherwise(10) + F.ascii(c) - F.when(letter, 55).otherwise(48), F.lit(97))

    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"


def _parts(m: Column) -> Column:
    return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")


def _digits(least: int, most: int):
    return lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(least, most)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this pattern has no span of the kind; cheap to test.
    hint: str
    valid: object
    score: float
    words: str
    base: bool = True
    #: Characters of the shortest match.
    shortest: int = 2


#: Characters of an account by country; a country that isn't listed may have 15 to 34.
ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(" ".join(ACCOUNTS.values()).split())
_ACCOUNT = "|".join([f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[\\x20]?[A-Z0-9]){{{n - 4}}}" for n, c in ACCOUNTS.items()] + [rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{11,30}}"])

BEFORE, AFTER = 60, 30

KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "e-?mail|contact|write|mailto"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _parts, 0.6, "ip|address|host|server|from|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][ -]?[0-9]", _luhn, 0.8, "card|visa|credit|debit|payment|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _digits(9, 15), 0.6, "phone|tel|call|mobile|fax|contact"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_ACCOUNT})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", _mod97, 0.7, "iban|account|bank|transfer", False, 15),
    Kind("ssn", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", "[0-9]-[0-9]", lambda m: F.lit(True), 0.3, "ssn|social|security|taxpayer", False, 11),
]


def _running(values: Column, start: Column) -> Column:
    """Prefix sums of a short array, from ``start`` on."""
    first = F.struct(F.array().cast("array<int>").alias("sums"), start.cast("int").alias("sum"))
    step = lambda acc, x: F.struct(F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums"), (acc["sum"] + x).alias("sum"))
    return F.aggregate(values, first, step, lambda acc: acc["sums"])


def prefix_sums(values: Column) -> Column:
    """Prefix sums of an array of any length, in chunks: appending to one long array would copy it again and again."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))
    long = F.flatten(F.zip_with(chunks, _running(F.transform(chunks, total), F.lit(0)), lambda c, upto: _running(c, upto - total(c))))
    return F.when(F.size(values) <= CHUNK, _running(values, F.lit(0))).otherwise(long)


NONE = "array<struct<start:int,kind:int,end:int,score:double>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: list[Kind] = KINDS) -> DataFrame:
    """(id, spans): structs of start, kind (index), end and score, by start and kind."""
    df = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    for k, kind in enumerate(kinds):
        some = F.col("text").contains(kind.hint) if kind.hint == "@" else F.col("text").rlike(kind.hint)
        df = df.withColumn(f"m{k}", F.when(some, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))))
    for k, kind in enumerate(kinds):
        df = df.withColumn(f"g{k}", F.when(F.size(f"m{k}") > 0, F.split("text", kind.pattern, -1)))
    for k, kind in enumerate(kinds):
        m, g = F.col(f"m{k}"), F.col(f"g{k}")
        steps = F.zip_with(F.slice(g, F.lit(1), F.size(m)), F.concat(F.array(F.lit("")), m), lambda gap, match: F.length(gap) + F.length(match))
        df = df.withColumn(f"s{k}", F.when(g.isNotNull(), prefix_sums(F.filter(steps, lambda x: x.isNotNull()))))
    for k, kind in enumerate(kinds):
        df = df.withColumn(f"k{k}", F.when(F.col(f"s{k}").isNotNull(), _spans(kind, k)))
    joined = F.concat(*[F.coalesce(F.col(f"k{k}"), F.array().cast(NONE)) for k in range(len(kinds))])
    return df.select("id", F.array_sort(joined).alias("spans"))


def _before(m: Column, g: Column, i: Column, shortest: int) -> Column:
    """The BEFORE characters ahead of match ``i``, over as many earlier matches and gaps as they can hold: linear in long texts."""
    end = lambda x: F.right(x, F.lit(BEFORE))
    n = F.least(i, F.lit(-(-BEFORE // shortest)))
    pieces = F.zip_with(F.slice(g, i - n + 1, n), F.slice(m, i - n + 1, n), lambda gap, match: F.concat(end(gap), end(match)))
    return end(F.concat(F.array_join(pieces, ""), end(F.element_at(g, i + 1))))


def _after(m: Column, g: Column, i: Column, shortest: int) -> Column:
    """The AFTER characters that follow match ``i``."""
    start = lambda x: F.left(x, F.lit(AFTER))
    n = F.least(F.size(m) - i - 1, F.lit(-(-AFTER // shortest)))
    pieces = F.zip_with(F.slice(m, i + 2, n), F.slice(g, i + 3, n), lambda match, gap: F.concat(start(match), start(gap)))
    return start(F.concat(start(F.element_at(g, i + 2)), F.array_join(pieces, "")))


def _spans(kind: Kind, k: int) -> Column:
    """The spans of one kind that its validator confirms and, if it isn't a base kind, whose score is enough."""
    m, g, s = F.col(f"m{k}"), F.col(f"g{k}"), F.col(f"s{k}")

    def span(match: Column, i: Column) -> Column:
        near = F.concat(_before(m, g, i, kind.shortest), F.lit(" | "), _after(m, g, i, kind.shortest))
        score = F.when(near.rlike(rf"(?i)\b(?:{kind.words})\b"), F.lit(min(1.0, kind.score + 0.3))).otherwise(F.lit(kind.score))
        start = F.element_at(s, i + 1)
        return F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + F.length(match)).alias("end"), score.alias("score"), kind.valid(match).alias("valid"))

    found = F.filter(F.transform(m, span), lambda x: x["valid"] & (F.lit(kind.base) | (x["score"] >= LEAST)))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["score"].alias("score")))


def spelled(spans: Column, kinds: list[Kind] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def how_many(k: int) -> Column:
    """The number of spans of kind ``k``. The lambda has one parameter: Spark gives a second one the place of the element."""
    return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k].name}")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, a count for each base kind, digest of the base spans, all spans, counts of the added kinds, scores)."""
    found = find_spans(docs)
    n_base = sum(kind.base for kind in KINDS)
    counts = [how_many(k) for k in range(len(KINDS))]
    base = F.filter("spans", lambda x: x["kind"] < n_base)
    return found.select(
        F.col("id").alias("doc_id"), *counts[:n_base], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        *counts[n_base:], F.transform("spans", lambda x: x["score"]).alias("scores"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
