"""Personal data in texts. DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for
account numbers), and words nearby adjust a score. The base kinds (email, ip, card, phone)
are found by their form and checksum alone, whatever stands around them: context only
raises their score. The added kinds (iban, ssn, birth, local_phone) have a form that other
things share, so they need a checksum or a context word to reach the threshold.

A span's place follows from splitting the text at the pattern: the gaps and the matches
alternate, so that lengths add up to code point offsets. Patterns are written with
possessive quantifiers and lookbehinds that start each attempt where a run of characters
begins (or a match has ended), so that matching is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24
#: Characters of a match at least, of any kind: so many fit into the context.
LEAST = 4
#: Spans of a text whose places are summed in one go.
RUN = 256


@dataclass(frozen=True)
class Kind:
    name: str
    #: a character that every match holds, or None
    needs: str | None
    pattern: str
    check: Callable[[Column], Column]
    #: score without context words, and what they add
    score: float
    context: str
    bonus: float


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = _digits(m)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * (1 + (F.length(d) - i) % 2)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether m, without spaces, is an account number by ISO 13616: first four characters last, letters as 10 to 35, 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _parts_to_255(m: Column) -> Column:
    # longer parts are over 255 unless they lead with zeros
    return F.forall(F.split(m, "[.]"), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _always(m: Column) -> Column:
    return F.lit(True)


BASE = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, 0.9, r"(?iu)\b(e-?mail|mail|contact|write to|reply)\b", 0.1),
    Kind("ip", ".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _parts_to_255, 0.7, r"(?iu)\b(ip|address|host|server|client|login)\b", 0.2),
    Kind("card", None, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", luhn, 0.8, r"(?iu)\b(card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta)\b", 0.2),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.7, r"(?iu)\b(phone|tel|mobile|cell|call|fax|téléphone|telefon|teléfono)\b", 0.2),
)
ADDED = (
    Kind("iban", None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8, r"(?iu)\b(iban|account|konto|compte|cuenta)\b", 0.2),
    Kind("ssn", "-", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", _always, 0.3, r"(?iu)\b(ssn|social security)\b", 0.5),
    Kind("birth", None, r"(?<![0-9./-])(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:19|20)[0-9]{2}(?![0-9])", _always, 0.2, r"(?iu)(\b(born|birth|dob|geboren|geburtsdatum)\b|\bnée? le\b|\bnacid[oa]\b|\bnacimiento\b)", 0.5),
    Kind("local_phone", "-", r"(?<![0-9+)(.-])(?<![0-9)] )(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}-[0-9]{4}(?![0-9-])", _always, 0.2, r"(?iu)\b(phone|tel|mobile|cell|call|fax)\b", 0.5),
)


def _running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """add over each element of an array of long and all before it.

    Appending copies an array, so elements are taken in chunks: first each chunk for itself, then what
    the chunks before it come to.
    """

    def run(chunk: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = add(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(chunk, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])

    def joined(chunks: Column) -> Column:
        # bound once: what the chunks before come to isn't computed again for each chunk
        totals = run(F.transform(chunks, lambda c: F.element_at(c, -1)))
        both = F.struct(chunks.alias("chunks"), F.concat(F.array(zero), totals).alias("before"))
        return F.element_at(F.transform(F.array(both), lambda b: F.flatten(F.zip_with(b["chunks"], F.slice(b["before"], 1, F.size(b["chunks"])), lambda c, z: F.transform(c, lambda x: add(x, z))))), 1)

    def bound(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda c: run(F.slice(all_, c * RUN + 1, F.lit(RUN))))
        return F.element_at(F.transform(F.array(chunks), joined), 1)

    return F.when(F.size(values) > 0, F.element_at(F.transform(F.array(values), bound), 1)).otherwise(F.array().cast("array<bigint>"))


def _apart(added: Column, base: Column) -> Column:
    """The added spans that overlap no base span: of the base spans that start before its end, found by halving, none ends after its start."""

    def bound(b: Column, starts: Column, ends: Column, a: Column) -> Column:
        def before(x: Column) -> Column:
            def halve(acc: Column, _: Column) -> Column:
                mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
                less = F.get(starts, mid) < x["end"]
                open_ = acc["low"] < acc["high"]
                return F.struct(F.when(open_ & less, mid + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~less, mid).otherwise(acc["high"]).alias("high"))

            return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(b) + 1)).cast("int")), F.struct(F.lit(0).alias("low"), F.size(b).alias("high")), halve, lambda acc: acc["low"])

        return F.filter(a, lambda x: F.coalesce(F.get(ends, before(x) - 1) <= x["start"], F.lit(True)))

    def with_ends(s: Column) -> Column:
        starts = F.transform(s["b"], lambda x: x["start"])
        ends = _running(F.transform(s["b"], lambda x: x["end"]), F.lit(0).cast("long"), lambda p, q: F.greatest(p, q))
        both = F.struct(s["b"].alias("b"), s["a"].alias("a"), starts.alias("starts"), ends.alias("ends"))
        return F.element_at(F.transform(F.array(both), lambda t: bound(t["b"], t["starts"], t["ends"], t["a"])), 1)

    whole = F.struct(F.array_sort(base).alias("b"), added.alias("a"))
    return F.when((F.size(added) > 0) & (F.size(base) > 0), F.element_at(F.transform(F.array(whole), with_ends), 1)).otherwise(added)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """All confirmed spans of a kind as array<struct<start, rank, end, kind, score, value>>."""
    pattern = F.lit(kind.pattern)

    def placed(m: Column, g: Column, tails: Column, heads: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(m) - 1)
        lengths = F.transform(every, lambda i: F.length(F.get(g, i)).cast("long") + F.length(F.get(m, i)))
        # where each match ends, less its length
        start = F.zip_with(_running(lengths, F.lit(0).cast("long"), lambda a, b: a + b), F.transform(m, lambda x: F.length(x)), lambda e, n: e - n)

        def before(i: Column) -> Column:
            # what lies before, other matches of the kind included: as many as there is room for
            first = F.greatest(i - BEFORE // LEAST, F.lit(0))
            pieces = F.zip_with(F.slice(tails, first + 1, i - first), F.slice(m, first + 1, i - first), lambda a, b: F.concat(a, b))
            return F.right(F.concat(F.array_join(pieces, ""), F.get(tails, i)), F.lit(BEFORE))

        def after(i: Column) -> Column:
            pieces = F.zip_with(F.slice(heads, i + 2, AFTER // LEAST), F.slice(m, i + 2, AFTER // LEAST), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            return F.left(F.array_join(pieces, ""), F.lit(AFTER))

        def row(value: Column, i: Column) -> Column:
            near = before(i).rlike(kind.context) | after(i).rlike(kind.context)
            score = F.when(near, F.lit(kind.score + kind.bonus)).otherwise(F.lit(kind.score))
            return F.struct(F.lit(0).cast("long").alias("start"), F.lit(rank).alias("rank"), F.length(value).cast("long").alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), value.alias("value"))

        def at(x: Column, start: Column) -> Column:
            return F.struct(start.alias("start"), x["rank"].alias("rank"), (start + x["end"]).alias("end"), x["kind"].alias("kind"), x["score"].alias("score"), x["value"].alias("value"))

        spans = F.zip_with(F.transform(m, row), start, at)
        return F.filter(spans, lambda x: kind.check(x["value"]) & (x["score"] >= THRESHOLD))

    def found(m: Column) -> Column:
        def ends(g: Column) -> Column:
            # only the ends of what lies between matches can be context
            return F.struct(g.alias("g"), F.transform(g, lambda x: F.right(x, F.lit(BEFORE))).alias("tails"), F.transform(g, lambda x: F.left(x, F.lit(AFTER))).alias("heads"))

        bound = F.transform(F.transform(F.array(F.split(text, kind.pattern, -1)), ends), lambda b: placed(m, b["g"], b["tails"], b["heads"]))
        return F.when(F.size(m) > 0, F.element_at(bound, 1))

    all_ = F.element_at(F.transform(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), found), 1)
    if kind.needs:
        all_ = F.when(F.contains(text, F.lit(kind.needs)), all_)
    return F.coalesce(all_, F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,value:string>>"))


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "pii") -> DataFrame:
    """Adds an array of spans (start, rank, end, kind, score, value), ordered by start, then kind as listed.

    Offsets count code points; end is exclusive. A base span always stays. An added span that
    overlaps a base span goes. A null or empty text has no spans; repeated rows each get
    theirs; a column named like the result is replaced. keep: columns to carry (default: all).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.flatten(F.array(*[_spans(t, k, i) for i, k in enumerate(BASE)]))
    added = F.flatten(F.array(*[_spans(t, k, len(BASE) + i) for i, k in enumerate(ADDED)]))

    def join(b: Column, a: Column) -> Column:
        return F.array_sort(F.concat(b, _apart(a, b)))

    whole = F.element_at(F.transform(F.array(F.struct(base.alias("b"), added.alias("a"))), lambda s: join(s["b"], s["a"])), 1)
    return docs.select(*[F.col(f"`{c}`") for c in keep], whole.alias(into))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first counts."""

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), put.alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
