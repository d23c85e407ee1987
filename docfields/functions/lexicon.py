"""Names of fields, label variants and patterns, and what is derived from them."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

FIELDS = ("numero_facture", "date", "fournisseur", "client", "montant_ht", "montant_tva", "montant_taxe", "montant_ttc")
AMOUNTS = FIELDS[4:]
TEXTS = ("numero_facture", "fournisseur", "client")

#: Label variants of each field, one for each normalised form, the longest spelling.
ALIASES: dict[str, tuple[str, ...]] = {
    "numero_facture": (
        "n° facture", "n°facture", "n° de facture", "numéro de facture", "numéro facture", "facture n°", "facture no",
        "no facture", "réf facture", "référence facture", "invoice number", "invoice n°", "invoice no", "invoice #",
        "invoice id", "invoice ref", "inv no", "n° commande", "numero commande", "order number", "purchase order", "po number",
    ),
    "date": (
        "date", "date de facturation", "date facture", "date de la facture", "date d'émission", "date d'émission de la facture",
        "date de création", "date de création de la facture", "date d'échéance", "date d'échéance de la facture", "échéance",
        "date limite", "date d'expédition", "émise le", "émis le", "délivrée le", "facture du", "invoice date",
        "date of invoice", "issued date", "issue date", "date issued", "invoice dated", "date d'invoice", "due date", "payment due",
    ),
    "fournisseur": (
        "fournisseur", "vendeur", "émetteur", "expéditeur", "votre entreprise", "nos coordonnées", "nos informations",
        "informations société", "informations entreprise", "coordonnées société", "coordonnées", "société", "entreprise",
        "prestataire", "émetteur de la facture", "supplier", "seller", "vendor", "from", "bill from", "billing provider", "provider",
    ),
    "client": (
        "client", "acheteur", "destinataire", "facturé à", "facturée à", "livré à", "livrée à", "expédié à",
        "à l'attention de", "attention de", "coordonnées client", "informations client",
        "customer", "bill to", "billing address", "ship to", "shipping address", "sold to",
    ),
    "montant_ht": (
        "montant ht", "total ht", "sous-total ht", "sous total ht", "ht", "base ht", "base imposable", "montant hors taxe",
        "montant hors taxes", "total hors taxe", "total hors taxes", "sous-total hors taxe", "sous total hors taxe",
        "h.t", "h.t.", "base h.t", "total h.t", "montant h.t", "subtotal", "sub total", "sub-total", "net amount", "net total",
        "total before tax", "taxable amount", "amount before tax", "total before vat",
    ),
    "montant_tva": (
        "tva", "montant tva", "total tva", "t.v.a", "t.v.a.", "tva due", "montant de la tva", "tva collectée", "tva facturée",
        "tva sur débits", "tva sur encaissements", "base tva", "vat", "vat amount", "total vat", "amount vat", "vat due",
        "vat to pay", "sales tax", "tax amount", "gst", "gst amount", "hst", "pst",
    ),
    "montant_taxe": (
        "taxe", "montant taxe", "total taxe", "timbre", "timbre fiscal", "timbre fiscale", "droit d'enregistrement",
        "droit de timbre", "contribution", "taxe spécifique", "taxe d'enregistrement", "taxe de séjour", "taxe à l'importation",
        "tax", "other tax", "additional tax", "stamp duty", "excise", "duty", "customs duty", "withholding tax",
    ),
    "montant_ttc": (
        "ttc", "montant ttc", "total ttc", "t.t.c", "t.t.c.", "total t.t.c", "net à payer", "net à payer ttc", "nette à payer",
        "total général", "total facture", "total à payer", "montant total", "montant facture", "à payer", "montant dû",
        "montant à payer", "solde à payer", "solde dû", "reste à payer", "règlement", "total", "total amount", "grand total",
        "total invoice", "invoice total", "amount due", "total due", "net amount due", "amount payable", "payable",
        "balance due", "outstanding", "total to pay",
    ),
}

#: What marks a text as a label: anywhere in it, as a word, as the last word.
LABEL_PARTS = (
    "facture", "fournisseur", "vendeur", "emetteur", "acheteur", "destinataire", "montant", "netapayer", "reference", "numero",
    "designation", "description", "produit", "article", "adresse", "code postal", "codepostal", "pays",
    "quantite", "prix", "unite", "remise", "escompte", "livraison", "port",
)
LABEL_WORDS = ("date", "client", "ht", "tva", "taxe", "ttc", "total")
LABEL_LAST = ("no", "ref")

#: Month names of dates that are read, and of dates that are only recognised.
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
OTHER_MONTHS = ("january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")

#: Words after a number that begin an address.
STREETS = ("rue", "avenue", "boulevard", "place", "chemin", "allee", "cour", "impasse", "quai", "square", "passage", "voie", "route", "montee", "cote", "ruelle")

#: Distances, scores and confidences that decide.
LOOKAHEAD_ROWS = 4
LARGEST_VERTICAL_GAP = 250.0
LARGEST_HORIZONTAL_GAP = 500.0
LEAST_SCORE = -300.0
LEAST_CONFIDENCE = 0.6
LEAST_DETECTION = 0.3


def normalise(text: str) -> str:
    """The normal form that texts are compared in: ASCII images, lower case, single blanks."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", " ", plain).strip()


@cache
def forms(field: str) -> tuple[str, ...]:
    """Normal forms of a field's labels, those of the longest spelling first."""
    return tuple(normalise(a) for a in sorted(ALIASES[field], key=len, reverse=True))


def _literal(text: str) -> str:
    """text as a regular expression that both Java and RE2 read."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


@cache
def label_regex(field: str) -> str:
    """Matches a normal form that contains a label of the field as whole words."""
    return r"\b(?:" + "|".join(_literal(f) for f in forms(field)) + r")\b"


def _tree(words: frozenset[str]) -> str:
    """Matches any of the words, one branch for each first letter, so that few are tried in vain."""
    by_first: dict[str, set[str]] = {}
    for w in words - {""}:
        by_first.setdefault(w[0], set()).add(w[1:])
    branches = [_literal(c) + _tree(frozenset(rest)) for c, rest in sorted(by_first.items())]
    if not branches:
        return ""
    inner = branches[0] if len(branches) == 1 and "" not in words else "(?:" + "|".join(branches) + ")"
    return inner + "?" if "" in words else inner


def _whole(words: frozenset[str]) -> str:
    """Matches any of the words with word boundaries at both ends, in the ASCII normal form. Spelled with
    look-arounds, as a boundary mark inside an alternation is tried at every letter."""
    closed = frozenset(w for w in words if w[-1:].isalnum())
    ends = [_tree(closed) + "(?![a-z0-9_])"] if closed else []
    ends += [_tree(words - closed) + "(?=[a-z0-9_])"] if words - closed else []
    return _begins(words) + "(?<![a-z0-9_])(?:" + "|".join(ends) + ")"


def _begins(words: frozenset[str]) -> str:
    """Looks ahead for a letter that one of the words begins with: a class of letters is told faster than what follows it here."""
    return "(?=[" + "".join(_literal(c) for c in sorted({w[0] for w in words})) + "])"


@cache
def whole_labels() -> dict[tuple[str, ...], tuple[str, ...]]:
    """The labels, by the fields that a text which is such a label has labels of."""
    found: dict[tuple[str, ...], list[str]] = {}
    for form in sorted({f for own in FIELDS for f in forms(own)}):
        found.setdefault(tuple(f for f in FIELDS if re.search(label_regex(f), form, re.ASCII)), []).append(form)
    return {fields: tuple(own) for fields, own in found.items() if fields}


@cache
def bare_labels() -> tuple[str, ...]:
    """The labels that hold no value themselves, whichever of their fields is asked for: no digit or colon, and no shorter label of a field of words."""
    rest = lambda label, field: field in TEXTS and any(f in label and len(f) < len(label) for f in forms(field))
    return tuple(label for fields, own in whole_labels().items() for label in own if not re.search("[0-9:]", label) and not any(rest(label, f) for f in fields))


@cache
def label_tree(field: str | None = None) -> str:
    """The same as label_regex, for Java, as a tree of letters; without a field, labels of any."""
    return _whole(frozenset(f for own in ((field,) if field else FIELDS) for f in forms(own)))


@cache
def any_label_tree() -> str:
    """The same as any_label_regex, for Java."""
    last = "(?<![a-z0-9_])(?:" + "|".join(LABEL_LAST) + r")(?![a-z0-9_])[.\s]*$"
    parts = frozenset(LABEL_PARTS)
    return "|".join([_begins(parts) + _tree(parts), _whole(frozenset(LABEL_WORDS)), _begins(frozenset(LABEL_LAST)) + last])


@cache
def relaxed_regex(field: str) -> str:
    """Matches a normal form whose words contain those of a label in order, others between."""
    return "|".join("(?:^| )" + "(?: .*)? ".join(_literal(w) for w in f.split(" ")) + "(?: |$)" for f in forms(field))


@cache
def relaxed_tree(field: str) -> str:
    """The same as relaxed_regex, for Java: what all labels begin and end with is tried once a word, not once a label and letter."""
    return "(?:^| )(?:" + "|".join("(?: .*)? ".join(_literal(w) for w in f.split(" ")) for f in forms(field)) + ")(?: |$)"


@cache
def any_label_regex() -> str:
    """Matches a normal form that is a label rather than a value."""
    return "|".join([*LABEL_PARTS, *(rf"\b{w}\b" for w in LABEL_WORDS), *(rf"\b{w}\b[.\s]*$" for w in LABEL_LAST)])


@cache
def date_regex() -> str:
    """Matches a normal form, without marks at its ends, that is a date and nothing else."""
    months = "|".join(dict.fromkeys([*MONTHS, *OTHER_MONTHS]))
    return rf"^(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|\d{{1,2}}\s+(?:{months})\s+\d{{4}})$"


@cache
def address_regex() -> str:
    """Matches a normal form that begins as an address does."""
    return rf"^\d+\s+(?:{'|'.join(STREETS)})"


@cache
def ascii_images() -> tuple[str, str, dict[str, str]]:
    """(characters with a one-character ASCII image, their images, characters with longer images),
    by compatibility decomposition of the planes that have such characters."""
    one, image, more = [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        got = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(got) == 1:
            one.append(chr(code))
            image.append(got)
        elif got:
            more[chr(code)] = got
    return "".join(one), "".join(image), more


@cache
def spelled_regex() -> str:
    """Matches a character with an ASCII image of several characters; ASCII is told apart first, and
    neighbours are ranges, as a class of single characters is tried one by one."""
    codes = sorted(map(ord, ascii_images()[2]))
    ranges, start = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1], strict=True):
        if b != a + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{a:x}}}")
            start = b
    return rf"[[^\x00-\x7f]&&[{''.join(ranges)}]]"
