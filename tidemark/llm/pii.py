"""Personal data by patterns, checksums and context, with DataFrame expressions alone.

A pattern proposes spans, leftmost first and without overlap. Validators confirm them: the parts of an address, Luhn's
sum for cards, mod 97 for account numbers, the count of digits for phones. Words shortly before a span raise its score.
Patterns are written so that a search takes time in proportion to the text: runs are possessive, and a search
begins at the edge of a run or where the last match ended, which finds the same spans.

Defined results: a null text counts as empty and has no spans; copies get equal spans; the other columns are kept, and
those with the name of the output column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks the edges of matches; in the text it is replaced by another private character, which no pattern holds.
MARK, OTHER = "", ""
#: Lengths that are summed in one go when places are counted.
CHUNK = 256
#: Characters before a span in which context words count.
NEAR = 48


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass Luhn's check."""
    each = F.transform(
        F.split(F.reverse(digits(x)), ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substr(x, F.lit(5)), F.substring(x, 1, 4))
    value = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(0))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    needs: str  # a character without which there is no match
    pattern: str
    valid: Callable[[Column], Column] | None
    context: str
    weight: float  # of a span without context
    only_with_context: bool = False


#: The kinds that are always reported, in their order; then those that the method adds.
BASE = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, r"(?i)mail|contact|write|address", 0.8),
    Kind("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda x: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), r"(?i)\bip\b|address|host|server", 0.6),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", lambda x: F.length(digits(x)).between(16, 19) & luhn(x), r"(?i)card|visa|credit|pay", 0.7),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: F.length(digits(x)).between(8, 15), r"(?i)phone|tel|call|mobile|fax", 0.6),
)
ADDED = (
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", mod97, r"(?i)iban|account|bank|konto", 0.8),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda x: ~x.rlike("^(000|666|9..)|-00-|-0000$"), r"(?i)ssn|social|security", 0.3, True),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once; a lambda would otherwise do it again for each element."""
    return F.transform(F.array(value), use)[0]


def _places(length: Column) -> Column:
    """The sum of all lengths before each, in two steps so that the work doesn't grow with the square of their number."""

    def of(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        begin = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        each = lambda c, b: F.transform(c, lambda _, i: b + F.aggregate(F.slice(c, 1, i), F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(chunks, F.slice(begin, 1, F.size(begin) - 1), each))

    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / CHUNK).cast("int")), lambda c: F.slice(n, c * CHUNK + 1, CHUNK))
    return let(length, lambda n: let(cut(n), of))


def _matches(text: Column, kind: Kind) -> Column:
    """Spans (start, end, score) of a kind; starts and ends are code points, ends exclusive."""

    def spans(pieces: Column) -> Column:
        place = _places(F.transform(pieces, F.length))
        # a piece with its place and with the piece before it; every second piece is a match
        near = F.transform(F.concat(F.array(F.lit("")), F.slice(pieces, 1, F.size(pieces) - 1)), lambda p: F.right(p, F.lit(NEAR)).rlike(kind.context))
        numbered = F.zip_with(F.zip_with(pieces, place, lambda p, a: F.struct(p.alias("p"), a.alias("a"))), near, lambda x, n: F.struct(x["p"].alias("p"), x["a"].alias("a"), n.alias("n")))
        found = F.filter(numbered, lambda m, k: (k % 2 == 1) & (kind.valid(m["p"]) if kind.valid else F.lit(True)) & (m["n"] if kind.only_with_context else F.lit(True)))
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(kind.name).alias("kind"), m["a"].alias("start"), (m["a"] + F.length(m["p"])).alias("end"), F.when(m["n"], min(1.0, kind.weight + 0.2)).otherwise(kind.weight).alias("score")
            ),
        )

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    some = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]")
    pieces = F.when(some, F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK, -1))
    return let(pieces, lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(none))


def find(df: DataFrame, text: str = "text", out: str = "spans", kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """df with an array of (kind, start, end, score) by kind, then start."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER)
    return df.withColumn(out, let(clean, lambda t: F.concat(*(_matches(t, k) for k in kinds))))


def _without(text: Column, kind: Kind) -> Column:
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), kind.pattern, f"{MARK}$0{MARK}"), MARK, -1)
    shown = lambda p, k: F.when((k % 2 == 1) & (kind.valid(p) if kind.valid else F.lit(True)), f"[{kind.name}]").otherwise(p)
    return F.array_join(F.transform(pieces, shown), "")


def redact(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """df with each valid match replaced by its kind in brackets, one kind after another."""
    value = F.col(text)
    for kind in kinds:
        value = F.when(value.isNotNull(), _without(value, kind))
    return df.withColumn(text, value)
