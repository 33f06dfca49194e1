"""Personal data in whole texts, in Spark expressions only.

Per kind, a regular expression proposes spans; checks on the matched text
(octets of an address, Luhn's checksum, mod-97, digit counts) confirm them; words
within ``CONTEXT`` characters raise or lower the score. The four base kinds
(email, ip, card, phone) stay once confirmed, whatever their score. The further
kinds (iban, ssn, local_phone) stay only at ``ACCEPT`` or more: an IBAN by its
checksum, the others by a context word.

Positions come from splitting the text at the matches: piece and match lengths
add up to the offsets (code points). Everything is row-local: no shuffle, no
Python, and linear in the text. Patterns are possessive and start only where a
run of their first characters starts, so a long run is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.6         # least score of a span of a further kind
CONTEXT = 40         # characters looked at on either side, up to the next proposal
BLOCK = 256          # matches per block of the running sums


@dataclass(frozen=True)
class Kind:
    name: str
    gate: str               # a text without it has no match
    pattern: str
    score: float            # of a confirmed span without context
    context: str            # words that raise the score
    base: bool = True


# fixed values: the four base patterns are given; order is the output order
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         0.9, "mail|contact|write|kontakt|courriel|correo"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         0.7, "ip|host|server|address|login|logged"),
    Kind("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++", 0.7, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|anruf|appel|llam"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
         0.8, "iban|bank|account|konto|compte|cuenta", False),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social security", False),
    Kind("local_phone", "[0-9]{3}[ .-]", r"(?<![0-9+().-])(?<![0-9+)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
         0.4, "phone|tel|call|mobile|fax|anruf|appel|llam", False),
)
AGAINST = "example|sample|dummy|order no|invoice|version"   # words that lower the score
BONUS = 0.3
BASE = tuple(k.name for k in KINDS if k.base)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum over an ASCII digit string, tens and all."""
    back = F.split(F.reverse(digits), "", -1)
    total = F.aggregate(F.transform(F.array_remove(back, ""), lambda d, i: F.when(
        i % 2 == 0, F.ascii(d) - 48).otherwise((F.ascii(d) - 48) * 2 - F.when(d >= "5", 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN: country and check digits go last, letters count from 10."""
    joined = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(joined, 5, 64), F.substring(joined, 1, 4))
    letters = F.array_remove(F.split(turned, "", -1), "")
    rest = F.aggregate(letters, F.lit(0), lambda a, c: F.when(
        F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97))
    return rest == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
    return {
        "ip": m.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"),
        "card": F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
        "iban": F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(m),
        "ssn": ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    }.get(kind, F.lit(True))


def _score(kind: Kind, left: Column, right: Column) -> Column:
    near = F.lower(F.concat(F.substring(left, -CONTEXT, CONTEXT), F.lit(" "), F.substring(right, 1, CONTEXT)))
    return F.round(F.lit(kind.score)
                   + F.when(near.rlike(rf"\b(?:{kind.context})"), BONUS).otherwise(0.0)
                   - F.when(near.rlike(rf"\b(?:{AGAINST})"), BONUS).otherwise(0.0), 2)


def _running(steps: str) -> Column:
    """Sums of all elements before each one, by blocks (a single fold would copy
    its growing array at every step)."""
    folds = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(
        F.slice(F.col(steps), b * BLOCK + 1, BLOCK), F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))
    done = F.aggregate(folds, F.struct(F.lit(0).alias("base"), F.array().cast("array<array<int>>").alias("out")),
                       lambda acc, f: F.struct(
                           (acc["base"] + F.element_at(f, -1)).alias("base"),
                           F.concat(acc["out"], F.array(F.transform(F.slice(f, 1, F.size(f) - 1), lambda x: x + acc["base"])))
                           .alias("out")))
    return F.flatten(done["out"])


_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def with_spans(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and ``spans``, an array of (kind, start, end,
    score) by kind as listed in ``KINDS``, then start; offsets in code points,
    end exclusive. A null or empty text has no spans. Spans of different kinds
    may overlap. Text of ``docs`` is read under ``text_col`` only."""
    empty = F.array().cast(f"array<{_SPAN}>")
    step = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    found = []
    for k in KINDS:
        at = lambda name: f"__{k.name}_{name}"  # noqa: B023, E731
        step = step.withColumn(at("m"), F.when(
            F.col("__t").rlike(k.gate), F.regexp_extract_all("__t", F.lit(k.pattern), 0)))
        step = step.withColumn(at("g"), F.when(F.size(at("m")) > 0, F.split("__t", k.pattern, -1)))
        step = step.withColumn(at("n"), F.zip_with(
            F.slice(F.col(at("g")), 1, F.size(at("m"))), at("m"), lambda g, m: F.length(g) + F.length(m)))
        step = step.withColumn(at("o"), F.when(F.size(at("m")) > 0, _running(at("n"))))
        hits = F.transform(at("m"), lambda m, i: F.struct(
            F.lit(k.name).alias("kind"),  # noqa: B023
            (F.get(at("o"), i) + F.length(F.get(at("g"), i))).alias("start"),  # noqa: B023
            (F.get(at("o"), i) + F.length(F.get(at("g"), i)) + F.length(m)).alias("end"),  # noqa: B023
            _score(k, F.get(at("g"), i), F.get(at("g"), i + 1)).alias("score"),  # noqa: B023
            _confirmed(k.name, m).alias("sure")))  # noqa: B023
        step = step.withColumn(at("s"), F.when(F.size(at("m")) > 0, F.transform(
            F.filter(hits, lambda h: h["sure"] & (F.lit(k.base) | (h["score"] >= ACCEPT))),  # noqa: B023
            lambda h: F.struct(h["kind"], h["start"], h["end"], h["score"]))).otherwise(empty))
        found.append(at("s"))
        step = step.drop(*[at(x) for x in "mgno"])
    return step.select(*[F.col(c) for c in keep], "__t", F.concat(*found).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_extra)``, one row per input row; counts and digest are of the base kinds,
    ``spans`` lists all kinds. Null and empty texts give zeros and the digest
    of the empty string; other columns are ignored."""
    spans = with_spans(docs, keep=("doc_id",))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return spans.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_extra"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>`` and ``n_chars`` (if
    there) renewed; all rows and columns stay. Of overlapping spans, a longer
    one swallows those that start inside it. A null text stays null."""
    columns = docs.columns
    found = with_spans(docs.select(F.struct(*columns).alias("__row"), "text"), keep=("__row",))
    ordered = found.select("__row", "__t", F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), F.upper(s["kind"]).alias("kind")))).alias("__s"))
    # reach: the furthest end among the spans before; a span that starts before it is swallowed
    cuts = F.aggregate(
        "__s", F.struct(F.lit(0).alias("reach"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out")),
        lambda acc, s: F.when((s["start"] < acc["reach"]) & (-s["back"] <= acc["reach"]), acc).otherwise(F.struct(
            (-s["back"]).alias("reach"),
            F.concat(acc["out"], F.array(F.struct(F.greatest(s["start"], acc["reach"]).alias("start"),
                                                  (-s["back"]).alias("end"), s["kind"].alias("kind")))).alias("out"))))
    cut = ordered.withColumn("__c", cuts["out"])
    part = lambda start, stop: F.substring(F.col("__t"), start + 1, stop - start)
    pieces = F.transform("__c", lambda c, i: F.concat(
        part(F.coalesce(F.get("__c", i - 1)["end"], F.lit(0)), c["start"]), F.lit("<"), c["kind"], F.lit(">")))
    last = F.coalesce(F.get("__c", F.size("__c") - 1)["end"], F.lit(0))
    clean = cut.withColumn("__clean", F.when(F.size("__c") > 0, F.concat(
        F.array_join(pieces, ""), part(last, F.length("__t")))).otherwise(F.col("__row.text")))
    out = []
    for c in columns:
        if c == "text":
            out.append(F.col("__clean").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.size("__c") > 0, F.length("__clean").cast(kind)).otherwise(F.col("__row.n_chars")).alias(c))
        else:
            out.append(F.col(f"__row.`{c}`").alias(c))
    return clean.select(*out)
