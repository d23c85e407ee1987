"""Five made-up documents whose extraction is known field by field.

Fixed values: the documents' truth, the label and value boxes, and what is expected of each. A
value stands beside its label, 15 high; a line is as sure as 0.95 if it reads like a label, else 0.90.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from docfields.functions import lexicon as lx

#: name: (x of values, rows of (y, label, its right edge, value, its right edge))
LAYOUTS: dict[str, tuple[int, list[tuple[int, str, int, str, int]]]] = {
    "synthetic_000": (100, [
        (10, "N° Facture", 80, "INV-2024-001", 200), (35, "Date", 50, "15/03/2024", 180), (60, "Fournisseur", 100, "SARL Dupont et Fils", 280),
        (85, "Client", 60, "Entreprise Martin EURL", 300), (150, "Montant HT", 100, "1250.00", 180), (175, "TVA", 50, "250.00", 180), (200, "TTC", 50, "1500.00", 180),
    ]),
    "synthetic_001": (100, [
        (10, "Facture N°", 80, "FAC-2024-0042", 220), (35, "Date Facture", 100, "16/03/2024", 200), (60, "Fournisseur", 100, "Societe Nouvelle SARL", 300),
        (85, "Designation", 100, "Prestation de conseil", 280), (125, "Client", 60, "Cabinet Conseil Associes", 320),
        (175, "Montant HT", 100, "2500.00", 200), (200, "TVA", 50, "500.00", 200), (225, "TTC", 50, "3000.00", 200),
    ]),
    "synthetic_002": (130, [
        (10, "Numero de Facture", 120, "2024-00123", 230), (35, "Date", 50, "17/03/2024", 230), (60, "Adresse Fournisseur", 150, "123 rue de la Paix", 300),
        (85, "Fournisseur", 100, "Construction Moderne SARL", 350), (125, "Client", 60, "Mairie de Villefranche", 320),
        (175, "Montant HT", 100, "5000.00", 230), (200, "TVA", 50, "1000.00", 230), (225, "TTC", 50, "6000.00", 230),
    ]),
    "synthetic_003": (100, [
        (10, "N° Facture", 80, "INV-2024-789", 220), (35, "Date", 50, "18/03/2024", 200), (60, "Adresse", 80, "45 avenue Foch, 75008 Paris, France", 400),
        (85, "Fournisseur", 100, "Etablissements Leclerc", 300), (125, "Client", 60, "Pharmacie du Centre", 280),
        (175, "Montant HT", 100, "750.00", 180), (200, "TVA", 50, "150.00", 180), (225, "TTC", 50, "900.00", 180),
    ]),
    "synthetic_004": (100, [
        (10, "Facture", 70, "REF-2024-555", 220), (35, "Date", 50, "19/03/2024", 200), (60, "Description", 100, "Creation graphique", 280),
        (85, "Fournisseur", 100, "Atelier Creation Design", 300), (125, "Client", 60, "Agence Publicite Plus", 300),
        (175, "Montant HT", 100, "3200.00", 200), (200, "TVA", 50, "640.00", 200), (225, "TTC", 50, "3840.00", 200),
    ]),
}

#: name: the eight fields that are true
TRUTH: dict[str, tuple[str, ...]] = {
    "synthetic_000": ("INV-2024-001", "2024-03-15", "SARL Dupont et Fils", "Entreprise Martin EURL", "1250.000", "250.000", "0.000", "1500.000"),
    "synthetic_001": ("FAC-2024-0042", "2024-03-16", "Societe Nouvelle SARL", "Cabinet Conseil Associes", "2500.000", "500.000", "0.000", "3000.000"),
    "synthetic_002": ("2024-00123", "2024-03-17", "Construction Moderne SARL", "Mairie de Villefranche", "5000.000", "1000.000", "0.000", "6000.000"),
    "synthetic_003": ("INV-2024-789", "2024-03-18", "Etablissements Leclerc", "Pharmacie du Centre", "750.000", "150.000", "0.000", "900.000"),
    "synthetic_004": ("REF-2024-555", "2024-03-19", "Atelier Creation Design", "Agence Publicite Plus", "3200.000", "640.000", "0.000", "3840.000"),
}
#: name: expected overall confidence, to six digits
CONFIDENCE = {"synthetic_000": 0.921429, "synthetic_001": 0.914286, "synthetic_002": 0.914286, "synthetic_003": 0.921429, "synthetic_004": 0.816667}
#: what the rules don't find in these documents: no line names a tax, and a bare "Facture" is no label of a number
UNREAD = {(name, "montant_taxe") for name in TRUTH} | {("synthetic_004", "numero_facture")}

#: Parts of a text by which the generator takes it for a label (one letter among them).
LABEL_MARKS = ("facture", "date", "fournisseur", "client", "montant", "tva", "ttc", "ht", "description", "designation", "adresse", "n")


def is_sure(text: str) -> bool:
    return any(mark in text.lower() for mark in LABEL_MARKS)


def expected(name: str) -> tuple[str | None, ...]:
    """The fields as extraction finds them, before reconciling."""
    return tuple(None if (name, f) in UNREAD else v for f, v in zip(lx.FIELDS, TRUTH[name], strict=True))


def lines() -> Iterator[tuple]:
    """(invoice_id, pos, text, box, confidence, page_index, line_index) of every document."""
    for name, (x, rows) in LAYOUTS.items():
        cells = [c for y, label, edge, value, end in rows for c in ((label, 10, y, edge), (value, x, y, end))]
        for pos, (text, x1, y1, x2) in enumerate(cells):
            box = (float(x1), float(y1), float(x2), float(y1 + 15))
            yield name, pos, text, box, 0.95 if is_sure(text) else 0.9, 0, 0


def frame(spark: SparkSession) -> DataFrame:
    schema = "invoice_id string, pos int, text string, box struct<x1:double,y1:double,x2:double,y2:double>, confidence double, page_index int, line_index int"
    return spark.createDataFrame(list(lines()), schema)
