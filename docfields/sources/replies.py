"""Fields of cloud replies with JSON types: a number, a boolean and an object are told from a text.

A reply is parsed once into a variant. The two readers of replies disagree on values that aren't text: the client
takes texts only and gives an error for anything else, the server writes every value as text and wants all fields
to be there. A problem is a value of the row, not an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.functions.parse import let

#: What can be wrong with a reply; the last two are followed by the field's name.
NOT_JSON, NOT_OBJECT, NOT_TEXT, NO_KEY = "not JSON", "not an object", "not a text: ", "missing: "
#: Digits that a double keeps, so that a shorter decimal is written as it is.
EXACT_DIGITS = 15
#: What the pattern (?U)\\s stands for.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The fence that may stand around a reply.
FENCE, FENCE_END = "```json", "```"


def unfenced(reply: Column) -> Column:
    """A reply without the fence that may stand around it: ```json before, ``` behind."""
    ends = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    # patterns, not conditions: within a function over arrays what a condition and its value share is worked out twice
    return ends(F.regexp_replace(F.regexp_replace(F.trim(ends(reply)), r"\A```json", ""), r"```\z", ""))


def float_text(number: Column, plain: Column) -> Column:
    """A number with a fraction as text: its shortest form, at least one decimal, with an exponent of two digits below 1e-4
    and from 1e16 on. plain: its digits without an exponent, if they are known."""
    told = number.cast("string")
    spread = F.regexp_replace(told.try_cast("decimal(38,20)").cast("string"), "0+$", "")

    def pointed(t: Column) -> Column:
        return F.when(t.endswith("."), F.concat(t, F.lit("0"))).when(t.contains("."), t).otherwise(F.concat(t, F.lit(".0")))

    power = F.regexp_extract(told, r"E(-?\d+)$", 1).try_cast("int")
    far = F.concat(
        F.regexp_replace(F.regexp_extract(told, r"^(-?[\d.]+)E", 1), r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    near = F.abs(number).between(1e-4, 9_999_999_999_999_998.0)
    return F.when(number == 0, "0.0").when(near, let(F.coalesce(plain, spread), pointed)).otherwise(far)


def value_text(value: Column, kind: Column) -> Column:
    """Any JSON value as text, as the server writes it: True and False, whole numbers by their digits, others by float_text;
    arrays and objects as JSON; null for null. kind: schema_of_variant(value)."""
    raw = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),", 1).try_cast("int")
    whole = (kind == "BIGINT") | (kind.endswith(",0)") & (digits > 18))
    return (
        F.when(kind == "BOOLEAN", F.initcap(raw))
        .when(whole, raw)
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), float_text(number, F.when(digits <= EXACT_DIGITS, raw)))
        .otherwise(raw)
    )


def _parsed(reply: Column, of) -> Column:
    """of(values, kinds, problem) of a reply: arrays of the eight fields' variants and types (null where a key is absent), and
    what is wrong with the reply as a whole."""

    def read(v: Column) -> Column:
        values = F.array(*[F.try_variant_get(v, f"$.{f}", "variant") for f in lx.FIELDS])

        def typed(own: Column) -> Column:
            kinds = F.transform(own, lambda x: F.schema_of_variant(x))
            wrong = F.when(v.isNull(), NOT_JSON).when(~F.schema_of_variant(v).startswith("OBJECT"), NOT_OBJECT)
            return let(kinds, lambda k: of(own, k, wrong))

        return let(values, typed)

    return let(F.try_parse_json(unfenced(reply)), read)


def _row(texts: Column, problem: Column) -> Column:
    """The eight fields and the problem as a struct; no field has a value where there is a problem. The texts are bound, as
    each field would write all eight anew."""
    row = lambda own, p: F.struct(*[F.get(own, F.lit(i)).alias(f) for i, f in enumerate(lx.FIELDS)], p.alias("problem"))
    return let(problem, lambda p: let(F.when(p.isNull(), texts), lambda own: row(own, p)))


def _first(names: Column, message: str) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(message), F.get(names, F.lit(0))))


def client_fields(reply: Column) -> Column:
    """The eight fields of a reply as the client takes them, and problem: a field that is absent or null is null, one that is
    anything but a text makes the reply an error. A null reply is no JSON; a key that an object repeats makes it no JSON."""

    def of(values: Column, kinds: Column, wrong: Column) -> Column:
        odd = F.filter(F.transform(kinds, lambda k, i: F.when(~k.isin("STRING", "VOID"), F.get(_names(), i))), lambda n: n.isNotNull())
        texts = F.transform(values, lambda v: F.try_variant_get(v, "$", "string"))
        return let(odd, lambda o: _row(texts, F.coalesce(wrong, _first(o, NOT_TEXT))))

    return _parsed(reply, of)


def server_fields(reply: Column) -> Column:
    """The eight fields of a reply as the server takes them, and problem: every key must be there, values are written as text
    (see value_text), null stays null."""

    def of(values: Column, kinds: Column, wrong: Column) -> Column:
        absent = F.filter(F.transform(kinds, lambda k, i: F.when(k.isNull(), F.get(_names(), i))), lambda n: n.isNotNull())
        texts = F.transform(values, lambda v, i: value_text(v, F.get(kinds, i)))
        return let(absent, lambda a: _row(texts, F.coalesce(wrong, _first(a, NO_KEY))))

    return _parsed(reply, of)


def _names() -> Column:
    return F.array(*[F.lit(f) for f in lx.FIELDS])


def read_replies(replies: DataFrame, reply: str, client: str = "client", server: str = "server") -> DataFrame:
    """Adds two structs to replies: client_fields and server_fields of the column reply. For many replies: each is parsed
    once for both, and what they read are columns, a step each, which are compiled; only a number with a fraction is written by a
    function over arrays."""
    told, bare, v = F.col("_told"), F.col("_bare"), F.col("_v")
    own = list(enumerate(lx.FIELDS))
    x = replies.withColumn("_told", F.btrim(reply, F.lit(BLANKS))).withColumn("_told", F.when(told.startswith(FENCE), F.substr(told, F.lit(len(FENCE) + 1))).otherwise(told))
    x = x.withColumn("_bare", F.btrim(F.when(told.endswith(FENCE_END), F.left(told, F.length(told) - len(FENCE_END))).otherwise(told), F.lit(BLANKS)))
    # a failure to parse raises within, so what can't begin a value isn't tried
    begins = F.left(bare, F.lit(1)).isin(*'{["-0123456789') | bare.startswith("null") | bare.startswith("true") | bare.startswith("false")
    x = x.withColumn("_v", F.when(begins, F.try_parse_json(bare)))
    x = x.withColumns({f"_v{i}": F.try_variant_get(v, f"$.{f}", "variant") for i, f in own})
    x = x.withColumns({f"_k{i}": F.schema_of_variant(F.col(f"_v{i}")) for i, _ in own} | {f"_t{i}": F.try_variant_get(F.col(f"_v{i}"), "$", "string") for i, _ in own})
    kinds, texts = [F.col(f"_k{i}") for i, _ in own], [F.col(f"_t{i}") for i, _ in own]
    wrong = F.when(v.isNull(), NOT_JSON).when(~bare.startswith("{"), NOT_OBJECT)  # what parses and begins so is an object
    odd = [F.when(~k.isin("STRING", "VOID"), F.lit(NOT_TEXT + f)) for k, f in zip(kinds, lx.FIELDS, strict=True)]
    absent = [F.when(k.isNull(), F.lit(NO_KEY + f)) for k, f in zip(kinds, lx.FIELDS, strict=True)]
    x = x.withColumns({"_odd": F.coalesce(wrong, *odd), "_absent": F.coalesce(wrong, *absent)})

    def written(i: int) -> Column:
        k, t = kinds[i], texts[i]
        number = let(F.struct(F.col(f"_v{i}").alias("v"), k.alias("k")), lambda p: value_text(p["v"], p["k"]))
        # a short decimal of 1 or more is its own text
        plain = k.startswith("DECIMAL") & (F.length(t) <= EXACT_DIGITS) & t.contains(".") & ~t.startswith("0") & ~t.startswith("-0")
        return F.when(k.isin("STRING", "VOID", "BIGINT") | plain, t).when((k == "DOUBLE") | k.startswith("DECIMAL"), number).when(k == "BOOLEAN", F.initcap(t)).otherwise(t)

    row = lambda values, problem: F.struct(*[F.when(problem.isNull(), t).alias(f) for f, t in zip(lx.FIELDS, values, strict=True)], problem.alias("problem"))
    x = x.withColumns({client: row(texts, F.col("_odd")), server: row([written(i) for i, _ in own], F.col("_absent"))})
    return x.drop("_told", "_bare", "_v", "_odd", "_absent", *[f"_{c}{i}" for c in "vkt" for i, _ in own])
