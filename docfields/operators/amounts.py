"""Rules over a document's amounts: validation, reconciliation, collision, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.functions.parse import format_amount, let, parse_decimal, try_decimal

#: Tolerances, rate bounds and penalties.
VALIDATION_GAP, RECONCILE_GAP = "0.50", "0.02"
LOWEST_RATE, HIGHEST_RATE = "0.05", "0.30"
PENALTIES = (("duplication", 0.25), ("impossible", 0.20), ("Negative", 0.20), ("Arithmetic mismatch", 0.15), ("VAT rate", 0.10), ("missing", 0.10))


def _number(text: str) -> Column:
    return F.lit(text).cast("decimal(10,3)")


def _present(*amounts: Column) -> Column:
    return sum((a.isNotNull().cast("int") for a in amounts[1:]), amounts[0].isNotNull().cast("int"))


def _parsed(parse) -> Column:
    """The four amounts as numbers, in a struct: rules read each many times, so it is worked out once."""
    return F.struct(*[parse(F.col(c)).alias(c) for c in lx.AMOUNTS])


def _empty(name: str) -> Column:
    return F.coalesce(F.length(F.col(name)), F.lit(0)) == 0


def tenths_text(x: Column) -> Column:
    """A double of 0 or more to one decimal, by its exact binary value, half to even (as C's %.1f does). The bound between two
    tenths is an odd m / 20; 16 x and m - 16 x are exact, so 4 x lies above or below it just as x does."""
    m = F.rint(x * 20.0)
    low = F.floor(m / 2.0)
    over, bound = x * 4.0, m - x * 16.0
    tenths = low + F.when(m - low * 2 == 0, 0).when(over > bound, 1).when(over < bound, 0).otherwise(low % 2)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def issues() -> Column:
    """Messages about the eight fields, in fixed order: amounts if two of three are there, then what is missing."""
    return let(_parsed(try_decimal), _issues)


def _issues(parsed: Column) -> Column:
    ht, tva, taxe, ttc = (parsed[c] for c in lx.AMOUNTS)
    zero = _number("0")
    expected = ht + tva + F.coalesce(taxe, zero)
    rate = F.when(ht > zero, tva.cast("double") / ht.cast("double"))
    of_amounts = [
        F.when((ht == tva) & (ht > zero), F.lit("HT equals TVA (duplication error)")),
        F.when((ht == ttc) & (ht > zero), F.lit("HT equals TTC (duplication error)")),
        F.when(tva > ttc, F.lit("TVA exceeds TTC (impossible)")),
        F.when(ht < zero, F.lit("Negative HT amount")),
        F.when(tva < zero, F.lit("Negative TVA amount")),
        F.when(ttc < zero, F.lit("Negative TTC amount")),
        F.when(
            (ht > zero) & (tva > zero) & ((tva < ht * _number(LOWEST_RATE)) | (tva > ht * _number(HIGHEST_RATE))),
            F.concat(F.lit("Unlikely VAT rate: "), tenths_text(rate * 100.0), F.lit("%")),
        ),
        F.when(
            F.abs(expected - ttc) > _number(VALIDATION_GAP),
            F.concat(F.lit("Arithmetic mismatch: HT+IVA+Taxe="), format_amount(expected), F.lit(" ≠ TTC="), format_amount(ttc)),
        ),
    ]
    missing = [(n, F.lit(m)) for n, m in (("numero_facture", "Invoice number missing"), ("date", "Date missing"), ("montant_ttc", "TTC amount missing"))]
    enough = _present(ht, tva, ttc) >= 2
    return F.array_compact(F.array(*[F.when(enough, m) for m in of_amounts], *[F.when(_empty(n), m) for n, m in missing]))


def reconciled(confidences: Column | None = None) -> Column:
    """struct(montant_ht, montant_tva, montant_taxe, montant_ttc, computed_fields, amount_mismatch).

    Three amounts: what is left of the total is the missing tax if it isn't negative (and, where
    they don't add up without it, at most twice the larger part); else a mismatch, and nothing
    is overwritten. Two: the third, if both come with enough confidence (absent: 1) and it
    isn't negative (a total may be)."""
    return let(_parsed(parse_decimal), lambda parsed: _reconciled(parsed, confidences))


def _reconciled(parsed: Column, confidences: Column | None) -> Column:
    ht, tva, taxe, ttc = (parsed[c] for c in lx.AMOUNTS)
    zero, tax = _number("0"), F.coalesce(taxe, _number("0"))
    sure = lambda name: F.lit(True) if confidences is None else F.coalesce(F.try_element_at(confidences, F.lit(name)), F.lit(1.0)) >= lx.LEAST_CONFIDENCE
    three = ht.isNotNull() & tva.isNotNull() & ttc.isNotNull()
    adds_up = F.abs(ht + tva + tax - ttc) <= _number(RECONCILE_GAP)
    rest = ttc - ht - tva
    fills = three & taxe.isNull() & (rest >= zero) & (adds_up | (rest <= F.greatest(ht, tva) * 2))
    new_ttc = F.when(ht.isNotNull() & tva.isNotNull() & ttc.isNull() & sure("montant_ht") & sure("montant_tva"), ht + tva + tax)
    new_tva = F.when(ht.isNotNull() & ttc.isNotNull() & tva.isNull() & sure("montant_ht") & sure("montant_ttc") & (ttc - ht - tax >= zero), ttc - ht - tax)
    new_ht = F.when(tva.isNotNull() & ttc.isNotNull() & ht.isNull() & sure("montant_tva") & sure("montant_ttc") & (ttc - tva - tax >= zero), ttc - tva - tax)
    new_taxe = F.when(fills, rest)
    new = dict(zip(lx.AMOUNTS, (new_ht, new_tva, new_taxe, new_ttc), strict=True))
    return F.struct(
        *[F.when(v.isNotNull(), format_amount(v)).otherwise(F.col(c)).alias(c) for c, v in new.items()],
        F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(c)) for c, v in new.items()])).alias("computed_fields"),
        (three & ~F.coalesce(adds_up, F.lit(False)) & ~F.coalesce(fills, F.lit(False))).alias("amount_mismatch"),
    )


def validated() -> Column:
    """struct of the four amounts, corrected: with three that don't add up to 0.50, a VAT equal to the
    net amount is what is left of the total, else the total is their sum; with two, the third."""
    return let(_parsed(parse_decimal), _validated)


def _validated(parsed: Column) -> Column:
    ht, tva, taxe, ttc = (parsed[c] for c in lx.AMOUNTS)
    zero, tax = _number("0"), F.coalesce(taxe, _number("0"))
    three = ht.isNotNull() & tva.isNotNull() & ttc.isNotNull()
    off = three & (F.abs(ht + tva + tax - ttc) > _number(VALIDATION_GAP))
    left = ttc - ht - tax
    new_tva = F.when(((off & (ht == tva)) | (ht.isNotNull() & ttc.isNotNull() & tva.isNull())) & (left >= zero), left)
    new_ttc = F.when((off & (ht != tva)) | (ht.isNotNull() & tva.isNotNull() & ttc.isNull()), ht + tva + tax)
    new_ht = F.when(tva.isNotNull() & ttc.isNotNull() & ht.isNull() & (ttc - tva - tax >= zero), ttc - tva - tax)
    new = (new_ht, new_tva, F.lit(None).cast("decimal(38,10)"), new_ttc)
    return F.struct(*[F.when(v.isNotNull(), format_amount(v)).otherwise(F.col(c)).alias(c) for c, v in zip(lx.AMOUNTS, new, strict=True)])


def collision() -> Column:
    """Whether two of the four amounts are the same number."""
    found = F.array_compact(F.array(*[parse_decimal(F.col(c)) for c in lx.AMOUNTS]))
    return let(found, lambda each: F.size(F.array_distinct(each)) < F.size(each))


def confidence(confidences: Column, told: Column) -> Column:
    """Mean of the fields' positive confidences less penalties: one per issue, by its first kind, and
    one if two or more of the three amounts are still missing; within 0..1, 0 without any field."""
    scores = F.filter(F.array(*[F.coalesce(F.try_element_at(confidences, F.lit(f)), F.lit(0.0)) for f in lx.FIELDS]), lambda s: s > 0)
    base = let(scores, lambda own: F.aggregate(own, F.lit(0.0), lambda a, s: a + s) / F.nullif(F.size(own), F.lit(0)))

    def penalty(issue: Column) -> Column:
        out = F.lit(0.0)
        for mark, cost in reversed(PENALTIES):
            out = F.when(issue.contains(mark), F.lit(cost)).otherwise(out)
        return out

    penalties = F.aggregate(told, F.lit(0.0), lambda a, i: a + penalty(i))
    gone = sum((_empty(c).cast("int") for c in ("montant_tva", "montant_ttc")), _empty("montant_ht").cast("int"))
    penalties = penalties + F.when(gone >= 2, F.lit(0.10)).otherwise(F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(base, lambda b: F.when(b.isNotNull(), b - penalties)))), F.lit(0.0))


def completeness_confidence(mismatch: Column) -> Column:
    """Confidence of a cloud reply: 0.95 times the share of fields there, 0.5 at most with a mismatch or collision."""
    n = sum(((~_empty(f)).cast("int") for f in lx.FIELDS[1:]), (~_empty(lx.FIELDS[0])).cast("int"))
    share = n / F.lit(8.0) * 0.95
    return F.when(mismatch | collision(), F.least(share, F.lit(0.5))).otherwise(share)


def capped(score: Column, mismatch: Column) -> Column:
    """A confidence, 0.5 at most where the amounts don't add up or two of them are the same."""
    return F.when(mismatch | collision(), F.least(score, F.lit(0.5))).otherwise(score)


def settle(fields: DataFrame, *keep: str) -> DataFrame:
    """From fields (the eight, confidences): issues, reconciled amounts, computed_fields,
    amount_mismatch, confidence (0.5 at most with a mismatch or collision); and the columns to keep."""
    x = fields.withColumn("issues", issues()).withColumn("_r", reconciled(F.col("confidences")))
    x = x.select("invoice_id", *lx.FIELDS[:4], *[F.col(f"_r.{c}").alias(c) for c in lx.AMOUNTS], "confidences", "issues", "_r.computed_fields", "_r.amount_mismatch", *keep)
    return x.withColumn("confidence", capped(confidence(F.col("confidences"), F.col("issues")), F.col("amount_mismatch")))
