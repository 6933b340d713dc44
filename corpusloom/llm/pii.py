"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only Spark SQL expressions: every text stays in the JVM and no row is shuffled.

Null texts count as empty. Empty tables give empty results. Rows with the same doc_id are
scored one by one. Columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the contract, in its order. The base kinds' spans never depend on the score.
#: Look-behind, possessive and \G forms match what the plain forms match, without their
#: quadratic rescans of long runs; \G lets a match start where the one before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Length of an IBAN by country (of countries that issue them, registered or not): what follows one is no part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: The codes with a known length, then any others; one pattern that Java and RE2 read alike. Java is
#: told first what all of them start with, or it tries each at every place of a text.
IBAN = "(?:" + "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()) + "|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

#: For each kind the score a confirmed span starts with, and words that raise it by CONTEXT_GAIN.
CONTEXT_CHARS, CONTEXT_GAIN, KEEP = 48, 0.3, 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap necessary condition on the text.
    hint: str
    score: float
    context: str
    base: bool


KINDS = (
    Kind("email", EMAIL, "@", 0.9, "mail|contact|write", True),
    Kind("ip", IP, ".", 0.6, "address|server|host|login", True),
    Kind("card", CARD, "", 0.7, "card|credit|visa|payment|account", True),
    Kind("phone", PHONE, "+", 0.7, "phone|call|mobile|fax|tel", True),
    Kind("iban", "(?=[A-Z]{2}[0-9]{2})" + IBAN, "", 0.8, "iban|bank|account|transfer", False),
    Kind("ssn", SSN, "-", 0.4, "ssn|social security|tax", False),
)


#: Characters of a text that are cut out together.
BLOCK = 1000


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it appears in use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(F.reverse(number), place, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(place % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves remainder 1, letters read as 10 to 35."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    # too few characters for the country's length match as another code would
    wrong = F.lit(False)
    for n, codes in IBAN_LENGTHS.items():
        wrong = wrong | F.substring(plain, 1, 2).isin(codes.split()) & (F.length(plain) != n)
    return F.length(plain).between(15, 34) & ~wrong & (F.aggregate(chars, F.lit(0), add) == 1)


#: Four numbers of at most 255 each; leading zeros do not count.
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def confirmed(kind: str, match: Column) -> Column:
    """The checksum or range test of a kind."""
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return let(digits(match), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _located(text: Column, kind: Kind, matches: Column) -> Column:
    """array<struct<start,stop,match>>: what stands between the matches tells where they are."""

    # running sums by doubling: places of as many matches as there are, each step adds the sums that lie 2**k back
    gaps = F.split(text, kind.pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    return F.zip_with(running(sizes), matches, lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("match")))


def running(sizes: Column) -> Column:
    """The sums of an array's numbers up to each of them, in n log n steps."""

    def step(sums: Column, back: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    steps = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.greatest(F.size(sizes), F.lit(1)))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, sizes, step)


def _scored(blocks: Column, kind: Kind, spans: Column) -> Column:
    """Keep confirmed spans; a context word near one raises its score; kinds of the method need KEEP.

    blocks are the text in runs of BLOCK characters: what lies around a span is read from the few it touches.
    """

    def around(start: Column, stop: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor(stop / BLOCK).cast("int") - first + 1), "")
        return F.substring(some, start - first * BLOCK + 1, stop - start)

    def score(span: Column) -> Column:
        near = F.lower(around(F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)), span["stop"] + CONTEXT_CHARS))
        bonus = F.when(near.rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        value = F.least(F.lit(1.0), F.lit(kind.score) + bonus)
        return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"), value.alias("score"))

    def sure(span: Column) -> Column:
        own = confirmed(kind.name, span["match"])
        # no letter or digit may follow an IBAN
        return own & ~around(span["stop"], span["stop"] + 1).rlike("[A-Z0-9]") if kind.name == "iban" else own

    kept = F.transform(F.filter(spans, sure), score)
    return kept if kind.base else F.filter(kept, lambda s: s["score"] >= KEEP)


def _found(text: Column, kind: Kind, matches: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(blocks, lambda b: let(_located(text, kind, matches), lambda spans: _scored(b, kind, spans)))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind,start,stop,score>>, by kind as in KINDS, then start.

    Offsets are code points, stop exclusive. Cost: each text is scanned once for each kind
    whose hint it holds, and a second time only if the kind matched.
    """
    empty = F.expr("cast(array() as array<string>)")
    no_spans = F.expr("cast(array() as array<struct<kind:string,start:int,stop:int,score:double>>)")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    matches = {}
    for kind in KINDS:
        every = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        matches[kind.name] = F.when(F.contains("text", F.lit(kind.hint)), every).otherwise(empty) if kind.hint else every
    found = found.select("doc_id", "text", *(m.alias(f"m_{k}") for k, m in matches.items()))
    spans = []
    for kind in KINDS:
        m = F.col(f"m_{kind.name}")
        spans.append(F.when(F.size(m) > 0, _found(F.col("text"), kind, m)).otherwise(no_spans))
    return found.select("doc_id", F.concat(*spans).alias("spans"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    from corpusloom.llm.common import read

    # scores in hundredths, in the order of the spans
    found = find_pii(read(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )
