r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a DataFrame expression over the row's own text. A pattern's matches are
fenced with a character that the text does not hold, the text is split at the fences,
and running lengths turn the pieces into spans in code points.

The patterns keep the leftmost matches of their plain forms but take every run of
characters whole (``++``) and start only where a run starts or the last match ended (``\G``), so
no text makes them go back over what they have read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

FENCE, STAND_IN = "\ufdd0", "\ufdd1"  # noncharacters, of one code point each
#: Code points before a span in which context words count.
NEAR = 48
#: Added spans stay from this score on; base spans always stay.
ENOUGH = 0.6


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _summed(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + x)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a card number is right."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    places = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    )
    return _summed(places) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number's remainder is 1, its first four characters moved to the end."""
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda left, c: (left * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + value(c)) % 97,
    )
    return rest == 1


@dataclass(frozen=True)
class Kind:
    name: str
    #: What every text with a match holds; keeps other texts from being searched.
    hint: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = (
    Kind(
        "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), 0.9, "e-?mail|mail|contact|write|correo|kontakt|courriel",
    ),
    Kind(
        "ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
        lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, "ip|address|server|host|login|adresse",
    ),
    Kind(
        "card", r"[0-9][ -]?[0-9]", "[0-9](?:[ -]?[0-9]){11,}+",
        lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m)), 0.8, "card|visa|credit|payment|karte|carte|tarjeta",
    ),
    Kind(
        "phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]",
        lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|call|tel|mobile|fax|telefon|teléfono|téléphone",
    ),
    Kind(
        "iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit(""))),
        0.9, "iban|account|bank|konto|compte|cuenta", base=False,
    ),
    Kind(
        "ssn", "[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda m: F.lit(True), 0.4, "ssn|social|security", base=False,
    ),
)
_SPAN = "array<struct<start:int,nth:int,end:int,kind:string,score:double>>"


#: Elements that a prefix sum adds up one by one.
_STEP = 64


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(sizes: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function from i to the sum of the first i ``sizes``.

    Sums of 64 and of 4,096 sizes are made once, so that a prefix adds at most 63 of each kind
    and the time grows with the number of sizes, not with its square.
    """

    def blocks(of: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(of) - 1, F.lit(_STEP))
        return F.transform(firsts, lambda k: _summed(F.slice(of, k + 1, F.lit(_STEP))))

    def prefix(small: Column, middle: Column, large: Column) -> Callable[[Column], Column]:
        def at(i: Column) -> Column:
            b, c = F.shiftright(i, 6), F.shiftright(i, 12)
            return F.get(large, c) + _summed(F.slice(middle, c * _STEP + 1, b - c * _STEP)) + _summed(F.slice(small, b * _STEP + 1, i - b * _STEP))

        return at

    before = lambda of: F.transform(of, lambda x, i: _summed(F.slice(of, F.lit(1), i)))
    return _with(blocks(sizes), lambda m: _with(_with(blocks(m), before), lambda s: body(prefix(sizes, m, s))))


def _spans(text: Column, nth: int, kind: Kind) -> Column:
    """The confirmed spans of one kind, in order."""
    pieces = F.split(F.regexp_replace(text, kind.pattern, f"{FENCE}$0{FENCE}"), FENCE)

    def spans(parts: Column, sizes: Column, starts: Callable[[Column], Column]) -> Column:
        # every second piece is a match; the one before it is the text between matches
        def span(piece: Column, i: Column) -> Column:
            start = starts(i)
            return F.struct(
                start.alias("start"), (start + F.get(sizes, i)).alias("end"), piece.alias("match"),
                F.right(F.get(parts, i - 1), F.lit(NEAR)).alias("before"), (i % 2 == 1).alias("_in"),
            )

        return F.filter(F.transform(parts, span), lambda s: s["_in"])

    proposed = _with(pieces, lambda p: _with(F.transform(p, lambda x: F.length(x)), lambda n: _upto(n, lambda starts: spans(p, n, starts))))
    confirmed = F.filter(proposed, lambda s: kind.valid(s["match"]))
    near = rf"(?i)(?<!\p{{L}})(?:{kind.context})(?!\p{{L}})"
    scored = F.transform(confirmed, lambda s: F.struct(
        s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), F.lit(kind.name).alias("kind"),
        F.least(F.lit(1.0), F.lit(kind.score) + F.when(s["before"].rlike(near), 0.2).otherwise(0.0)).alias("score"),
    ))
    none = F.array().cast(_SPAN)
    return F.when(text.rlike(kind.hint), scored.cast(_SPAN)).otherwise(none)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the spans of personal data in its text.

    ``found`` is an array of (start, nth, end, kind, score), in code points with the end
    exclusive, sorted by start and then the order of kinds. Base kinds (email, ip, card,
    phone) always stay; iban and ssn are added from a score of ``ENOUGH`` on, which an ssn
    reaches only near a context word. A null text counts as empty, other columns are
    ignored, an empty table gives an empty result.

    Returns doc_id, found.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("_text")).select("doc_id", F.array_sort(_kept(F.col("_text"))).alias("found"))


def _kept(text: Column) -> Column:
    """The spans of all kinds that stay, unsorted."""
    clean = F.when(F.contains(text, F.lit(FENCE)), F.translate(text, FENCE, STAND_IN)).otherwise(text)
    every = F.concat(*[_spans(clean, n, kind) for n, kind in enumerate(KINDS)])
    added = [k.name for k in KINDS if not k.base]
    return F.filter(every, lambda s: ~s["kind"].isin(*added) | (s["score"] >= ENOUGH - 1e-9))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets.

    A span that begins inside an earlier one is dropped. Columns and rows stay.
    """
    name = next(f"_found{n}" for n in range(len(docs.columns) + 1) if f"_found{n}" not in docs.columns)
    found = docs.withColumn(name, F.array_sort(_kept(F.coalesce(F.col("text"), F.lit("")))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(so_far: Column, span: Column) -> Column:
        between = F.substr(F.col("text"), so_far["at"] + 1, span["start"] - so_far["at"])
        return F.when(span["start"] < so_far["at"], so_far).otherwise(F.struct(
            span["end"].alias("at"), F.concat(so_far["made"], between, F.lit("["), span["kind"], F.lit("]")).alias("made")
        ))

    rest = lambda end: F.concat(end["made"], F.substr(F.col("text"), end["at"] + 1))
    return found.withColumn("text", F.when(F.size(name) > 0, F.aggregate(name, state, step, rest)).otherwise(F.col("text"))).drop(name)
