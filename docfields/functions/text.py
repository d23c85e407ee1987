"""Text functions: normal forms, labels, plausible values. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.functions.parse import extract_amount, extract_date, let

SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Runs of white space in ASCII, but single blanks: those stay as they are, and a text without others isn't written anew.
RUN = r"[\t-\r\x1c-\x1f][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
NOISE = " :-\t\r\n"


def normalize_text(text: Column) -> Column:
    """ASCII image of compatibility decomposition, lower case, single blanks, trimmed."""
    one, image, more = lx.ascii_images()
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{got}" for c, got in more.items())), F.lit("\x01"), F.lit("\x02"))  # one literal, folded once
    spelled = F.when(text.rlike(lx.spelled_regex()), F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")).otherwise(text)
    plain = F.when(is_ascii(text), text).otherwise(F.regexp_replace(F.translate(spelled, one, image), r"[^\x00-\x7f]", ""))
    return F.trim(F.regexp_replace(F.lower(plain), RUN, " "))


def is_ascii(text: Column) -> Column:
    """Whether each character is one byte; told from the lengths, as a pattern looks at every letter."""
    return F.octet_length(text) == F.length(text)


def collapse_text(text: Column) -> Column:
    """Single blanks for white space of any kind, trimmed; letters stay."""
    return F.trim(F.when(is_ascii(text), F.regexp_replace(text, RUN, " ")).otherwise(F.regexp_replace(text, SPACE, " ")))


def latin_ratio(text: Column) -> Column:
    """Share of characters that are ASCII or letters; null for an empty text."""
    return F.length(F.regexp_replace(text, r"[^\x00-\x7f\p{L}]", "")) / F.nullif(F.length(text), F.lit(0))


def looks_like_latin_text(text: Column) -> Column:
    return F.coalesce(F.when(is_ascii(text), text != "").otherwise(latin_ratio(text) >= 0.5), F.lit(False))


def strip_noise(text: Column) -> Column:
    """collapse_text without blanks, colons and dashes at both ends."""
    return F.btrim(collapse_text(text), F.lit(NOISE))


def contains_label(norm: Column, field: str) -> Column:
    """Whether a normal form contains a label of the field as whole words."""
    return norm.rlike(lx.label_tree(field))


def label_fields(norm: Column) -> Column:
    """Fields that a normal form has a label of, in order. A text that is a label is looked up; of the others most
    have none: one pattern of all labels is tried before those of each field."""
    names = lambda fields: F.array(*map(F.lit, fields))
    each = F.array_compact(F.array(*[F.when(contains_label(norm, f), F.lit(f)) for f in lx.FIELDS]))
    whole = F.coalesce(*[F.when(norm.isin(*own), names(fields)) for fields, own in lx.whole_labels().items()])
    is_whole = norm.isin(*[label for own in lx.whole_labels().values() for label in own])
    return F.when(is_whole, whole).when(norm.rlike(lx.label_tree()), each).otherwise(F.array().cast("array<string>"))


def contains_label_relaxed(norm: Column, field: str) -> Column:
    """The same with other words between those of the label."""
    return norm.rlike(lx.relaxed_tree(field))


def looks_like_label(norm: Column) -> Column:
    return norm.rlike(lx.any_label_tree())


def looks_like_date(norm: Column) -> Column:
    return F.btrim(norm, F.lit(".,;:")).rlike(lx.date_regex())


def is_plausible(norm: Column) -> Column:
    """Whether a line of this normal form may be a value."""
    return (F.length(norm) >= 2) & ~looks_like_label(norm)


def is_plausible_number(norm: Column) -> Column:
    """Whether a line of this normal form may be an invoice number: with a digit, no address."""
    return is_plausible(norm) & is_number(norm)


def is_number(norm: Column) -> Column:
    """Whether a plausible line of this normal form may be an invoice number."""
    commas = F.length(norm) - F.length(F.replace(norm, F.lit(","), F.lit("")))
    return norm.rlike("[0-9]") & ~norm.rlike(lx.address_regex()) & (commas < 2)


def clean_value(field: str, text: Column) -> Column:
    """The value that a text holds for a field, or null."""
    def read(cleaned: Column) -> Column:
        if field in lx.AMOUNTS:
            return extract_amount(cleaned, let)
        if field == "date":
            return extract_date(cleaned, normalize_text(cleaned))
        return F.when(looks_like_latin_text(cleaned) & ~looks_like_label(normalize_text(cleaned)), cleaned)

    return let(strip_noise(text), read)  # of an empty text nothing is read


def inline_value(field: Column, text: Column, *, compat: bool = True) -> Column:
    """The value that follows a label in the same text, for the field that a column names: after a
    colon, else after the first label found, longest first, in the normal form.

    compat: letters t, r, n and backslashes at the ends of such a rest go too, as in the
    application whose results are matched; otherwise only blanks, colons, dashes."""
    return let(collapse_text(text), lambda whole: let(normalize_text(whole), lambda norm: value_behind(field, whole, norm, compat=compat)))


def value_behind(field: Column, whole: Column, norm: Column, *, compat: bool = True) -> Column:
    """inline_value of a text with single blanks and its normal form."""
    ends = F.lit(" :-\\trn" if compat else " :-")
    forms = F.create_map(*[c for f in lx.FIELDS for c in (F.lit(f), F.array(*map(F.lit, lx.forms(f))))])
    in_text = field.isin(*lx.TEXTS)

    def clean(rest: Column) -> Column:
        return F.when(in_text, clean_value("client", rest)).when(field == "date", clean_value("date", rest)).otherwise(clean_value("montant_ht", rest))

    def rest(form: Column) -> Column:
        return F.btrim(F.substring(norm, F.position(form, norm) + F.length(form), F.length(norm)), ends)

    behind_colon = F.when(whole.contains(":"), clean(F.trim(F.regexp_extract(whole, "^[^:]*:(.*)$", 1))))
    held = F.filter(F.element_at(forms, field), lambda f: norm.contains(f) & (F.length(f) < F.length(norm)))  # a text that is its label has no rest
    behind_label = F.get(F.array_compact(F.transform(F.filter(F.transform(held, rest), lambda r: r != ""), clean)), F.lit(0))
    # without a digit there is neither an amount nor a date
    return F.when(in_text | norm.rlike("[0-9]") | whole.rlike("[0-9]"), F.coalesce(behind_colon, behind_label))


def number_quality(value: Column) -> Column:
    """How much a text looks like an invoice number, from -0.3 to 0.3."""
    # fixed values: marks of a number, years, lengths, and the weight of each
    up, digits = F.upper(value), value.rlike("^[0-9]+$")
    score = F.when(up.contains("INV") | up.contains("FAC"), F.lit(0.25)).otherwise(F.lit(0.0))
    score = score + F.when(value.rlike("2023|2024|2025|2026"), F.lit(0.2)).otherwise(F.lit(0.0))
    score = score - F.when(F.length(value) < 3, F.lit(0.3)).when(F.length(value) < 5, F.lit(0.1)).otherwise(F.lit(0.0))
    score = score - F.when(digits & (F.length(value) < 6), F.lit(0.2)).otherwise(F.lit(0.0))
    score = score - F.when(value.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"), F.lit(0.3)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit(-0.3)).otherwise(F.greatest(F.lit(-0.3), F.least(F.lit(0.3), score)))
