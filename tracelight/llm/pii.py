"""Personal data in text, with Spark's own functions only.

Regular expressions propose spans, validators (Luhn, mod-97, octet and digit ranges) confirm
them, and words near a span move its score. Work is per row: no shuffle, no Python. Positions
come from running sums by blocks, and places are looked up in stretches of the text, so that a
text of n spans costs little more than n.

Null text counts as empty text; a text without candidates gives empty span lists. Texts are read
whole, however long. Positions are code points, ends exclusive; spans of one kind are in order of
their starts, and an additional span that overlaps a base one goes. Repeated rows give repeated
results, an empty table an empty one. Columns of the input that clash with an output name are
replaced by the output; other columns are kept by find_pii() and redact_pii().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on each side of a span in which context words count.
CONTEXT_CHARS = 40
#: A span stands if its score reaches this.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """pattern proposes; hint is a cheap test that every text with a match passes; prior is
    the score of a confirmed span, to which context adds or takes up to 0.3. The base kinds'
    prior keeps them above the threshold whatever surrounds them."""

    name: str
    pattern: str
    hint: str
    prior: float
    context: str
    against: str = ""
    base: bool = False


# A match that could begin inside a run could also begin at the run's start, or where the last
# match ended (\G); the guards only spare the engine the other starts. Possessive loops run
# without recursion, however long the text.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "e-?mail|contact|write|mailto", base=True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 0.85, "\\bip\\b|address|host|server", "version|release|section", base=True),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+", "[0-9][0-9\\x20-]{11}", 0.85, "card|visa|credit|payment", "isbn|order|serial", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 0.85, "phone|call|tel|mobile|fax", base=True),
    # group 1 looks ahead over all that an account number can take; _account() finds where it ends
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}", "[A-Z]{2}[0-9]{2}", 0.7, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", 0.4, "ssn|social security", "part|model|serial"),
    Kind("tel", r"(?<![0-9A-Za-z+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", "[0-9]{3}[.-][0-9]{4}", 0.55, "phone|call|tel|mobile|fax", "part|model|serial|isbn"),
)
BASE_KINDS = tuple(k for k in KINDS if k.base)

#: Lengths of account numbers by country code, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """The ISO 7064 remainder of an account number: its first four characters moved to the
    end, letters counted from 10."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _account(ahead: Column) -> Column:
    """The account number that begins the text: of the country's length, or for a country that
    is not listed the longest of 34 down to 15 characters, that ends at a word edge and passes
    mod-97; null if there is none."""
    lengths = F
    for n, countries in IBAN_LENGTHS.items():
        lengths = lengths.when(F.substr(ahead, F.lit(1), F.lit(2)).isin(countries.split()), F.array(F.lit(n)))
    lengths = lengths.otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1)))
    cut = lambda n: F.call_function("regexp_extract", ahead, F.concat(F.lit(r"^[A-Z0-9](?:\x20?[A-Z0-9]){"), (n - 1).cast("string"), F.lit("}(?![A-Za-z0-9])")), F.lit(0))
    return F.get(F.filter(F.transform(lengths, cut), lambda m: (m != "") & (_mod97(m) == 1)), F.lit(0))


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        value = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(value(p)) <= 3) & (F.coalesce(value(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """values with each one joined by op to all before it. Appends to an array: for short ones."""
    first = F.struct(F.lit(None).cast("int").alias("last"), F.lit([]).cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return _let(F.when(acc["last"].isNull(), x).otherwise(op(acc["last"], x)), lambda y: F.struct(y.alias("last"), F.concat(acc["out"], F.array(y)).alias("out")))

    return F.aggregate(values, first, step, lambda acc: acc["out"])


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """_scan() of arrays of any length: by blocks of the root of the length, then over blocks."""
    none = F.lit([]).cast("array<int>")

    def joined(inner: Column) -> Column:
        heads = _scan(F.transform(inner, lambda x: F.element_at(x, -1)), op)
        return _let(heads, lambda h: F.flatten(F.transform(inner, lambda x, i: F.transform(x, lambda y: F.when(i == 0, y).otherwise(op(F.get(h, i - 1), y))))))

    def blocks(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, side), lambda k: _scan(F.slice(v, k + 1, side), op))

    return _let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(_let(blocks(v), joined)))


#: Characters of the stretches that a text is cut into where places in it are looked up.
STRETCH = 1000


def _stretches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STRETCH), 0)


def _between(stretches: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, found in their stretches and not from the text's start."""
    a, b = F.floor(start / STRETCH).cast("int"), F.floor((end - 1) / STRETCH).cast("int")
    own = F.coalesce(F.get(stretches, a), F.lit(""))
    offset = start - a * STRETCH
    apart = F.concat(
        F.substr(own, offset + 1), F.array_join(F.slice(stretches, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
        F.substr(F.coalesce(F.get(stretches, b), F.lit("")), F.lit(1), end - b * STRETCH))
    return F.when(end <= start, "").when(a == b, F.substr(own, offset + 1, end - start)).otherwise(apart)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed matches of one kind as an array of (kind, start, end, match, score). split() and
    regexp_extract_all() walk the same matches; the running sums of the pieces' lengths give
    positions. The value of a match is the text of its span, null if it is not confirmed."""
    pieces, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    if kind.name == "iban":
        values = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), 1), _account)
    else:
        values = F.transform(matches, lambda m: F.when(_confirmed(kind.name, m), m))
    none = F.lit([]).cast("array<struct<kind:string,start:int,end:int,match:string,score:double>>")

    def score(stretches: Column, length: Column, start: Column, end: Column) -> Column:
        before = _between(stretches, F.greatest(start - CONTEXT_CHARS, F.lit(0)), start)
        after = _between(stretches, end, F.least(end + CONTEXT_CHARS, length))
        return _let(F.lower(F.concat(before, F.lit(" "), after)), lambda around: F.round(
            F.lit(kind.prior) + F.when(around.rlike(kind.context), 0.3 if not kind.base else 0.1).otherwise(0.0)
            - (F.when(around.rlike(kind.against), 0.3).otherwise(0.0) if kind.against else F.lit(0.0)), 2))

    def found(z: Column) -> Column:
        """z: (piece, match, value) by number; the last piece has no match."""
        ends = running(F.transform(z, lambda p: F.length(p["piece"]) + F.coalesce(F.length(p["match"]), F.lit(0))), lambda a, b: a + b)
        own = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: F.get(z, i)["value"].isNotNull())

        def spans(which: Column, ends: Column, stretches: Column) -> Column:
            def span(i: Column) -> Column:
                start = F.get(ends, i) - F.length(F.get(z, i)["match"])
                value = F.get(z, i)["value"]
                return _let(F.struct(start.alias("start"), (start + F.length(value)).alias("end")), lambda s: F.struct(
                    F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("match"),
                    score(stretches, F.element_at(ends, -1), s["start"], s["end"]).alias("score")))

            return F.transform(which, span)

        return _let(own, lambda which: F.when(F.size(which) == 0, none).otherwise(_let(ends, lambda e: _let(_stretches(text), lambda t: spans(which, e, t)))))

    both = F.zip_with(matches, values, lambda m, v: F.struct(m.alias("match"), v.alias("value")))
    zipped = F.zip_with(pieces, both, lambda a, b: F.struct(a.alias("piece"), b["match"].alias("match"), b["value"].alias("value")))
    hit = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hit, _let(zipped, found)).otherwise(none)


def _apart(base: Column, more: Column, threshold: float) -> Column:
    """Of more, the spans that reach the threshold and overlap no base span. All spans in order
    of start: one overlaps if a base span before it ends behind its start, or one from it on
    starts before its end."""
    mark = lambda base: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("span"), F.lit(base).alias("base"))
    marked = F.array_sort(F.concat(F.transform(base, mark(True)), F.transform(more, mark(False))))

    def kept(m: Column) -> Column:
        reached = running(F.transform(m, lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest)
        begun = F.reverse(running(F.reverse(F.transform(m, lambda s: F.when(s["base"], s["start"]).otherwise(2**31 - 1))), F.least))
        stands = lambda r, b: lambda s, i: ~s["base"] & (s["span"]["score"] >= threshold) & (F.get(r, i) <= s["start"]) & (F.get(b, i) >= s["end"])
        return _let(reached, lambda r: _let(begun, lambda b: F.transform(F.filter(m, stands(r, b)), lambda s: s["span"])))

    is_of = lambda name: lambda s: s["kind"] == name
    ordered = lambda spans: F.concat(*[F.filter(spans, is_of(k.name)) for k in KINDS if not k.base])
    return F.when(F.size(more) == 0, more).otherwise(_let(_let(marked, kept), ordered))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `base_spans` and `all_spans`, arrays of (kind, start, end, match, score).

    Base spans (email, ip, card, phone) always stay. A span of another kind is kept if its
    score reaches the threshold and it overlaps no base span. Both arrays are ordered by kind
    as listed in KINDS, then by start."""
    names = [f"__{k.name}" for k in KINDS]
    found = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    found = found.withColumns({f"__{k.name}": _spans(F.col("__text"), k) for k in KINDS})
    found = found.withColumn("base_spans", F.concat(*[F.col(f"__{k.name}") for k in BASE_KINDS]))
    more = F.concat(*[F.col(f"__{k.name}") for k in KINDS if not k.base])
    apart = _let(more, lambda m: _apart(F.col("base_spans"), m, threshold))
    return found.withColumn("all_spans", F.concat("base_spans", apart)).drop("__text", *names)


def digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: counts of the base kinds, the hash of the base spans, all spans."""
    found = find_pii(df.select(id_col, text_col), text_col)
    count = lambda name: F.size(F.filter("base_spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        id_col,
        *[count(k.name).alias(f"n_{k.name}") for k in BASE_KINDS],
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("all_spans", lambda s: s["score"])), F.lit(0.0)), 2).alias("top_score"),
    )


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; other columns and untouched texts
    (null included) stay as they are. Where spans overlap, the one that starts first counts,
    the longer one on equal starts; the rest of a covered span goes with it."""
    found, text = find_pii(df, text_col), F.col(text_col)
    ordered = F.array_sort(F.transform("all_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def parts(spans: Column, reached: Column, stretches: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(reached, i - 1))
            mark = F.when(s["start"] >= at, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
            return F.when(-s["back"] <= at, "").otherwise(F.concat(_between(stretches, at, s["start"]), mark))

        return F.concat(F.array_join(F.transform(spans, part), ""), _between(stretches, F.element_at(reached, -1), F.length(text)))

    ends = lambda spans: running(F.transform(spans, lambda s: -s["back"]), F.greatest)
    changed = _let(ordered, lambda spans: _let(ends(spans), lambda reached: _let(_stretches(text), lambda t: parts(spans, reached, t))))
    return found.withColumn(text_col, F.when(F.size("all_spans") > 0, changed).otherwise(text)).drop("base_spans", "all_spans")
