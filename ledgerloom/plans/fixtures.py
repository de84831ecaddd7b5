"""Literal inputs of queries whose subject the given tables don't hold."""

from __future__ import annotations

from ..sources.master import CLIENTS, CREDITORS

_CLIENT = CLIENTS[0][1]
_ENERGY, _REPAIR, _LAW, _OFFICE = (c[1] for c in CREDITORS)

#: (doc, text): invented invoices, one for each way in which fields can stand on a page.
LAYOUTS = [
    # a label before each field, a period instead of a day
    ("1", f"""Lieferant: {_ENERGY}
Rechnung an: {_CLIENT}
Rechnungs-Nr.: SW/2025-774
Rechnungsdatum: 3.11.2025
Leistungszeitraum: 01.10.2025 bis 31.10.2025
Betreff: Wärmelieferung Haus B, Oktober
Netto: 412,50 EUR
USt.-Satz: 19 %
USt.-Betrag: 78,38 EUR
Bruttobetrag: 490,88 EUR"""),
    # other labels, ISO dates
    ("2", f"""Verkäufer: {_REPAIR}
Empfänger: {_CLIENT}
Invoice Number: R25-0099
Rechnungsdatum: 2025-11-07
Leistungsdatum: 2025-11-06
Beschreibung: Türschließer eingestellt
Nettosumme: 88,00 EUR
MwSt.-Satz: 19,0 %
MwSt.-Betrag: 16,72 EUR
Gesamt: 104,72 EUR"""),
    # a total that is off by 12
    ("3", f"""Verkäufer: {_REPAIR}
Bill To: {_CLIENT}
Rechnungsnummer: R25-0100
Rechnungsdatum: 09.11.2025
Leistungsdatum: 08.11.2025
Beschreibung: Dachrinne gereinigt
Nettobetrag: 200,00 EUR
Steuersatz: 19 %
Umsatzsteuer: 38,00 EUR
Endbetrag: 250,00 EUR"""),
    # no service date, the reduced rate
    ("4", f"""Von: {_OFFICE}
An: {_CLIENT}
Rechnungsnummer: OFF-5
Rechnungsdatum: 21.11.2025
Beschreibung: Fachbuch Mietrecht
Nettobetrag: 60,00 EUR
MwSt.-Satz: 7 %
MwSt.-Betrag: 4,20 EUR
Gesamtbetrag: 64,20 EUR"""),
    # a letterhead and a table; no label for either party or the date of service
    ("5", f"""{_REPAIR}
Lindenweg 3, 99999 Neustadt

{_CLIENT}
Gartenallee 12a
99998 Altstadt
Kundenkonto: 7741
Rechnung: A7/311
Datum: 19.12.2025
Zahlbar bis: 02.01.2026

Wasserhahn Küche getauscht 250,00 EUR
Zwischensumme 250,00 EUR
zzgl. 19 % Umsatzsteuer 47,50 EUR
Rechnungsbetrag 297,50 EUR"""),
    # both parties in one line below a header for both, an item as description
    ("6", f"""Rechnung 2025-W-17
SAUBERFEE
Datum 14.12.2025
Von An
Sauberfee Treppenglanz GmbH {_CLIENT}
Am Bach 4 Gartenallee 12a
Leistungsdatum 13.12.2025
Fensterreinigung Treppenhaus 2 240,00 EUR
Netto 240,00 EUR
19 % USt. 45,60 EUR
Gesamt 285,60 EUR"""),
    # a vendor's name over two lines, each with a part of its address behind it
    ("7", f"""JURISMUSTER Uferstraße 9
BERATUNG GMBH 88888 Seehafen
Rechnungsnummer: K-2025/58
Rechnungsdatum: 01.12.2025
Leistungsdatum: 28.11.2025
Leistungsempfänger:
{_CLIENT}
Leistungsbeschreibung: Gutachten zur Nebenkostenabrechnung
Nettobetrag: 1.250,00 EUR
USt.-Satz: 19,0 %
USt.-Betrag: 237,50 EUR
Gesamtbetrag: 1.487,50 EUR"""),
    # two columns: labels of another field in the same line
    ("8", f"""GRÜNER
{_ENERGY}
Solarring 77 · 77777 Sonnfeld
Rechnungsempfänger Rechnungs-Nr. GS-40210
{_CLIENT} Ausgestellt am 05.12.2025
Gartenallee 12a Fällig am 19.12.2025
Leistungszeitraum Ablesung
01.11.2025 - 30.11.2025 30.11.2025
Datum 05.12.2025
Nettobetrag 90,00 EUR
Umsatzsteuer 19 % 17,10 EUR
Rechnungsbetrag 107,10 EUR"""),
]

VENDORS = [
    _ENERGY, f"  {_ENERGY.upper()} ", f"ENERGIE {_ENERGY}", "Energie Saar", "ENERGIE", "GmbH", "ImmoFix", "JURISMUSTER BERATUNG GMBH",
    "Muster-Service", "Office Muster Handels", "Glanzwerk Musterreinigung GmbH", "", "Saar GmbH & Co. KG",
]

NUMBERS = [
    "1.234", "1234.56", "1234,56", "1.234,56", "1,234.56", "1e3", "-12,5", " 1.190,00 EUR ", "€ 5", "5€", "", "abc", "12.34.567", "0", "1.000.000", "1000", "999,999", "+7", "19,0", "7,",
]

DATES = [
    "15.03.2026", "5.3.2026", "2026-03-15", "2026-3-5", "31.02.2026", "01.01.68", "01.01.69", "1.1.26", " 03.09.2026 ", "2026/03/15", "", "29.02.2024", "29.02.2023", "00.01.2026", "15.03.202", "1.13.2026",
]

VAT_IDS = ["DE999999995", "DE123456789", "DE111111117", "DE777777773", "DE00000000", "de999999995", "DE222222220", "DE333333339", "AT999999995", ""]

IBANS = [
    "DE79100100100012345678", "DE00100100100012345678", "DE79 1001 0010 0012 3456 78", "de79100100100012345678", "GB82WEST12345698765432",
    "DE86100100100056789012", "NL91ABNA0417164300", "XX", "", "DE7910010010001234567",
]

SENSITIVE = [
    "USt-IdNr. DE999999995, IBAN DE79100100100012345678, mail buero@muster.example",
    "USt-IdNr. DE123456789 bleibt",
    "Tel 0681 123456-78 und 0681/9988776, a@b.de c@d.org DE999999995 DE111111117",
    "IBAN DE00100100100012345678 ist falsch",
    "+49 681 1234567",
    "",
]

#: (doc, rank, engine, text)
CANDIDATES = [
    ("good", 0, "pdfplumber", LAYOUTS[0][1]), ("good", 1, "pymupdf", LAYOUTS[0][1]), ("good", 2, "ocr", "Rechnung"),
    ("garbled", 0, "pdfplumber", "~~^^ \x7f\x7f ^^~~"), ("garbled", 1, "pymupdf", "^^^"), ("garbled", 2, "ocr", LAYOUTS[1][1]),
    ("empty", 0, "pdfplumber", None), ("empty", 1, "pymupdf", "  \n"),
]

#: (invoice_id, the eleven fields as text)
RECORDS = [
    ("green", _CLIENT, _ENERGY, "A-1", "2026-03-15", "2026-02-28", "EUR", "1000.00", "19", "190.00", "1190.00", "Stromlieferung"),
    ("edge", _CLIENT, _ENERGY, "A-2", "2026-03-15", "2026-02-28", "EUR", "1000.00", "19", "190.02", "1190.00", "Strom"),
    ("sum", _CLIENT, _REPAIR, "A-3", "2026-03-18", "2026-03-10", "EUR", "500.00", "19", "95.00", "620.00", "Reparatur"),
    ("other", "Andere Firma GmbH", _ENERGY, "A-4", "2026-03-15", "2026-02-28", "EUR", "1000.00", "19", "190.00", "1190.00", None),
    ("yellow", _CLIENT, "Neue Firma AG", "A-5", "2026-03-15", None, "EUR", "100.00", "7", "7.00", "107.00", "Sonstiges"),
    ("empty", None, None, None, None, None, None, None, None, None, None, None),
    ("vat", _CLIENT, _OFFICE, "A-6", "2026-03-15", "2026-02-28", "EUR", "0.13", "50", "0.10", "0.23", "Papier"),
]

JSON_ANSWERS = [
    '{"vendor_name": " Beispiel AG ", "invoice_date": "2026-03-15", "net_amount": "1.000,00"}',
    '```json\n{"vendor_name": "B", "invoice_date": "15.03.2026", "net_amount": 12.5}\n```',
    "no json", "[1, 2]", '{"vendor_name": "  ", "net_amount": "n/a"}', "",
]
