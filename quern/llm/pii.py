"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

DataFrame functions only. A pattern is run twice on the texts that hold it: once
for its matches and once to split the text at them, whose lengths give the
places. Starting a pattern only where its first run of characters starts (or
where the match before ended) leaves the leftmost matches as they are and makes
every search linear in the length of the text; possessive loops need no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of their rank. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: The patterns of the kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that, within CONTEXT characters before a span, make it likelier.
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security",
}
#: Scores without and with such a word. A kind is kept from KEEP on: base kinds always, a ssn only beside a word.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.8), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.9, 1.0), "ssn": (0.3, 0.8)}
KEEP, CONTEXT = 0.5, 40
#: Matches whose places are summed up together.
BLOCK = 128


def _luhn(digits: Column) -> Column:
    """Whether the digits, from the right, every second one doubled and its digits summed, give a multiple of ten."""
    n = F.length(digits)

    def part(i):
        d = F.substring(digits, n - i, 1).cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether the number made by moving four characters to the end and writing letters as 10 to 35 leaves 1 modulo 97."""
    bare = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(a, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(F.regexp_replace(found, "[^0-9]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(found)
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _starts(steps: Column) -> Column:
    """Where the matches of steps (g, n: lengths of the text before a match and of the match) start: running sums within blocks, and over the blocks, so
    that no array grows by one element for each match."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    empty = F.expr("cast(array() as array<int>)")
    inner = F.transform(
        blocks,
        lambda block: F.aggregate(
            block,
            F.struct(F.lit(0).alias("end"), empty.alias("at")),
            lambda acc, s: F.struct((acc["end"] + s["g"] + s["n"]).alias("end"), F.concat(acc["at"], F.array(acc["end"] + s["g"])).alias("at")),
        ),
    )
    whole = F.aggregate(
        inner,
        F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<array<int>>)").alias("at")),
        lambda acc, b: F.struct((acc["end"] + b["end"]).alias("end"), F.concat(acc["at"], F.array(F.transform(b["at"], lambda x: x + acc["end"]))).alias("at")),
    )
    return F.flatten(whole["at"])


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once: a variable of a function over arrays is a value, where a column may be written out wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """The confirmed spans of a kind as structs, in order of their starts.

    All steps are linear in the text: what stands before a match is the end of
    the pieces before it, so the text is never read from its start again.
    """
    gaps = F.split(text, PATTERNS[kind], -1)

    def placed(steps):
        return F.struct(steps.alias("s"), _starts(steps).alias("at"), F.transform(steps, lambda s: _end(F.concat(s["before"], s["m"]))).alias("pieces"))

    def found(all_):
        each = F.transform(all_["s"], lambda s, i: F.struct(i.alias("i"), F.get(all_["at"], i).alias("at"), s["n"].alias("n"), s["m"].alias("m"), s["before"].alias("before")))

        def scored(s):
            # A match has four characters at least, so ten pieces hold all that is looked at.
            pieces = F.slice(all_["pieces"], F.greatest(s["i"] - 9, F.lit(1)), F.least(s["i"], F.lit(10)))
            near = F.lower(_end(F.concat(F.array_join(pieces, ""), s["before"]))).rlike(rf"(?:^|[^a-z])(?:{WORDS[kind]})")
            plain, beside = SCORES[kind]
            score = F.when(near, F.lit(beside)).otherwise(F.lit(plain))
            return F.struct(s["at"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (s["at"] + s["n"]).alias("end"), score.alias("score"), s["m"].alias("found"))

        return F.filter(F.transform(F.filter(each, lambda s: _confirmed(kind, s["m"])), scored), lambda s: s["score"] >= KEEP)

    def stepped(pair):
        return F.zip_with(pair["m"], F.slice(pair["g"], F.lit(1), F.size(pair["m"])), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"), _end(g).alias("before")))

    steps = _let(F.struct(matches.alias("m"), gaps.alias("g")), stepped)
    return _let(_let(steps, placed), found)


def _end(c: Column) -> Column:
    """The last CONTEXT characters."""
    return F.substring(c, -CONTEXT, CONTEXT)


#: What a text must hold for a kind to be in it at all; a cheap test that spares most texts the patterns.
HOLDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-"}


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id and `found`, an array of (start, rank, kind, end, score, found) in order of start, then kind.

    Base kinds are kept whatever their score; IBAN and social security numbers
    are added where their checks and the words nearby confirm them. Places
    count code points, ends exclusive. A null text counts as empty and has no
    spans. Rows with equal or null ids are rows of their own; an empty table
    gives an empty table; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = "array<struct<start:int,rank:int,kind:string,end:int,score:double,found:string>>"

    def of(kind):
        return lambda m: F.when(F.size(m) > 0, _spans(kind, F.col("__text"), m)).otherwise(F.expr(f"cast(array() as {made})"))

    base = df.select(F.col(id_col), text.alias("__text"))
    for k in KINDS:
        matches = F.when(F.col("__text").rlike(HOLDS[k]), F.regexp_extract_all("__text", F.lit(PATTERNS[k]), 0))
        base = base.withColumn(f"__{k}", _let(matches, of(k)))
    return base.select(id_col, F.array_sort(F.concat(*[F.col(f"__{k}") for k in KINDS])).alias("found"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id and `redacted`, the text with each span replaced by its kind in brackets.

    Rows with equal or null ids are rows of their own. Where spans overlap, one that starts within another already replaced is
    dropped. Null texts stay null.
    """
    text = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    found = find_personal_data(text.withColumn("__key", F.struct(F.col(id_col), F.col("__text"))), "__key", "__text")
    t = F.col("__key")["__text"]
    acc = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        ),
    )
    return found.select(F.col("__key")[id_col].alias(id_col), t.alias("__text"), acc.alias("__acc")).select(
        id_col, F.when(F.col("__text").isNotNull(), F.concat(F.col("__acc")["out"], F.expr("substring(__text, __acc.at + 1)"))).alias("redacted")
    )
