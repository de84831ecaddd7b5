"""Patterns and word lists of the invoice conventions."""

from __future__ import annotations

# The conventions that invoices are read by. Flags: i and u ignore case, d ends lines at \n
# alone, U makes classes Unicode-aware, m anchors at lines.
FLAGS = "(?dUm)"
DATE = r"([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})"
STANDALONE_DATE = r"datum(?<![a-zäöüß]datum):?\s*" + DATE
GERMAN_NUMBER = r"(?U)^\s*-?\d{1,3}(?:\.\d{3})*(?:,\d+)?\s*$"
VENDOR = [r"(?iu)^Rechnungssteller\s*:\s*(.+)$", r"(?iu)^Lieferant\s*:\s*(.+)$", r"(?iu)^Verk[aä]ufer\s*:\s*(.+)$", r"(?iu)^Von\s*:\s*(.+)$"]
INVOICE_NUMBER = [
    r"(?iu)Rechnungs(?:-)?Nr\.?:?\s*([A-Za-z0-9\-\/]+)",
    r"(?iu)Rechnungsnummer:?\s*([A-Za-z0-9\-\/]+)",
    r"(?iu)Invoice\s*Number:?\s*([A-Za-z0-9\-\/]+)",
    r"(?iu)^Rechnung\s*:\s*([A-Za-z0-9\-\/]+)",
    r"(?iu)^Rechnung\s+([A-Za-z0-9][A-Za-z0-9\-\/]*)$",
]
CURRENCY = [r"(?=[eE€])\b([eE][uU][rR]|€)\b"]
DESCRIPTION = [r"(?iu)Leistungsbeschreibung:?\s*(.+)", r"(?iu)Beschreibung:?\s*(.+)", r"(?iu)Betreff:?\s*(.+)"]
# Dates and amounts have no letters, so these are in lower case and run over folded text, most from a fixed word
# whose beginning is looked at behind it.
INVOICE_DATE = [r"rechnungsdatum:?\s*" + DATE, STANDALONE_DATE]
SERVICE_DATE = [r"leistungsdatum:?\s*" + DATE, r"leistungszeitraum:?\s*.*?" + DATE, STANDALONE_DATE]
NET = [r"nettobetrag:?\s*([\d.,]+)", r"netto(?:summe)?:?\s*([\d.,]+)", r"zwischensumme:?\s*([\d.,]+)"]
#: Digits up to a percent sign: as no run of them can begin later and match, none is tried from its middle.
_RATE = r"(?<![\d.,])([\d.,]++)\s*+%\s*+"
#: The last one, a rate behind the name of the tax, is read before a rate is inferred from amounts.
VAT_RATE = [r"satz(?<=(?:(?:ust|mwst)\.?-?|steuer)satz):?\s*([\d.,]+)\s*%", _RATE + r"(?:ust|mwst|umsatzsteuer)", r"(?=[um])\b(?:ust\.?|mwst\.?|umsatzsteuer)\s*([\d.,]+)\s*%"]
_VAT = r"(?=[bu])(?:betrag(?<=(?:ust|mwst)\.?-?betrag)|umsatzsteuer)"
VAT_AMOUNT = [
    _VAT + r"[^\n]*?([\d\.,]+)\s*(?:€|eur)\b",
    r"(?=[um])(?:ust\.?|mwst\.?|umsatzsteuer)\s*\(\s*[\d\.,]+\s*%\s*\)[^\n]*?([\d\.,]+)",
    _VAT + r":?\s*([\d\.,]+)(?!\s*%)",
    r"(?<![\d.,])[\d.,]++\s*+%\s*+(?:ust\.?|mwst\.?|umsatzsteuer)\s*([\d.,]+)\s*(?:€|eur)?",
]
GROSS = [r"betrag(?<=(?:gesamt|brutto|rechnungs|end)betrag):?\s*([\d.,]+)", r"gesamt(?<=\bgesamt)\b:?\s*([\d.,]+)"]
FOLDED = frozenset((*INVOICE_DATE, *SERVICE_DATE, *NET, *VAT_RATE, *VAT_AMOUNT, *GROSS))
#: Words in lower case, of ASCII but for the euro sign: every match begins with one of them.
BEGINS = {
    VENDOR[0]: ("rechnungssteller",), VENDOR[1]: ("lieferant",), VENDOR[2]: ("verk",), VENDOR[3]: ("von",), INVOICE_NUMBER[0]: ("rechnungs-nr", "rechnungsnr"), INVOICE_NUMBER[1]: ("rechnungsnummer",),
    INVOICE_NUMBER[2]: ("invoice",), INVOICE_NUMBER[3]: ("rechnung",), INVOICE_NUMBER[4]: ("rechnung",), DESCRIPTION[0]: ("leistungsbeschreibung",), DESCRIPTION[1]: ("beschreibung",), DESCRIPTION[2]: ("betreff",),
}
#: What every match holds.
HOLDS = {VAT_RATE[0]: "%", VAT_RATE[1]: "%", VAT_RATE[2]: "%", VAT_AMOUNT[1]: "(", VAT_AMOUNT[3]: "%"}
RECIPIENT_LABEL = r"(?iudU)^(?:Rechnungsempf[aä]nger|Leistungsempf[aä]nger|Rechnung\s*an|Bill\s*To|Empf[aä]nger|An)\s*:?"
#: The same in a text of stripped lines, with what follows it and the two lines below.
LABELLED_RECIPIENT = (
    r"(?iudUm)^(?:Rechnungsempf[aä]nger|Leistungsempf[aä]nger|Rechnung[^\S\n]*an|Bill[^\S\n]*To|Empf[aä]nger|An)[^\S\n]*:?(.*(?:\n.*){0,2})"
)
#: The class in front spares most places of a line the alternatives.
OTHER_LABEL = (
    r"(?=[rlafzik])(?:rechnungs(?:-)?nr|invoice\s*number|invoice\s*no|ausgestellt|f[aä]llig|kundennr|kundenkonto|zahlbar\s*bis|"
    r"leistungsdatum|leistungszeitraum|abrechnungszeitraum|rechnungsdatum|rechnung\s*:)"
)
OTHER_DATE = r"(?iudU)leistungsdatum|leistungszeitraum|abrechnungszeitraum|zahlbar|f[aä]llig"
LEGAL_FORM = r"(?iudU)\b(?:GmbH|mbH|AG|KG|UG|SE|KGaA)\b"
#: The same over folded text.
LOW_LEGAL_FORM = r"(?dU)(?=[gmakus])\b(?:gmbh|mbh|ag|kg|ug|se|kgaa)\b"
ENTITY = r"(?U)[A-ZÄÖÜ][\wÄÖÜäöüß]*(?:[\s.&-]+[A-Za-z0-9ÄÖÜäöüß][\wÄÖÜäöüß]*)*?\s+(?:GmbH|mbH|AG|KG|UG|SE|KGaA)\b"
STREET = r"(?iusU)\b[A-ZÄÖÜ][\wäöüß.\-]*(?:stra(?:ss|ß)e|str\.|weg|platz|allee|ring|gasse)\s*\d+[a-zA-Z]?\b.*$"
#: A legal form behind five digits is no city: they belong to the name.
POSTAL_CITY = r"(?sU)\b\d{5}\s+(?!(?iu:GmbH|mbH|AG|KG|UG|SE|KGaA)\b)[A-ZÄÖÜ][\wäöüß\-]*\b.*$"
#: What its matches begin with.
PARTIES = ("von", "lieferant", "verk")
PARTIES_HEADER = r"(?dU)(?=[vl])\b(?:von|lieferant|verk[aä]ufer)\b.*\b(?:an|empf[aä]nger|rechnungsempf[aä]nger)\b"
INVOICE_TITLE = r"(?iudU)^(?:Rechnung|Invoice)\s+[A-Za-z0-9][A-Za-z0-9\-\/]*$"
BARE_DATE = r"(?U)\b" + DATE + r"\b"
TABLE_HEADER = r"(?iudU)^(?:Menge|Betrag|Preis|Anzahl|St(?:k|ück)|Summe|EUR|Datum)(?:\s+(?:Menge|Betrag|Preis|Anzahl|St(?:k|ück)|Summe|EUR|Datum))*$"
LINE_ITEM = r"(?iudU)^(.+?)\s+\d+\s+[\d.,]+\s*(?:€|EUR)\s*$"
QUALITY_WORDS = r"(?iu)rechnung|nummer|datum|betrag|eur|ust|mwst|netto|brutto|iban|gmbh|steuer|leistung|empf[aä]nger|w[aä]hrung|kunden"
UNEXPECTED = r"(?U)[^\p{L}\p{N}\s.,\-:/%€·]"
VAT_ID = r"(?U)\bDE[0-9]{9}\b"
IBAN = r"(?U)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)\b(?:\+49|0)[\d\s/()-]{6,}\d\b"
#: What the four begin with, emails aside.
IDENTIFIER = r"(?U)(?=[A-Z+0])\b(?:DE[0-9]{9}|[A-Z]{2}[0-9]{2}[A-Z0-9]{10}|(?:\+49|0)[\d\s/()-]{6})"
CODE_FENCE = r"(?iumU)^```(?:json)?\s*|\s*```$"
ISO_DATE = r"(?U)^\d{4}-\d{2}-\d{2}$"
