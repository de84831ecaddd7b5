"""Schemas of records, as DDL."""

from __future__ import annotations

FIELDS = ("invoice_recipient", "vendor_name", "invoice_number", "invoice_date", "service_date", "currency", "net_amount", "vat_rate", "vat_amount", "gross_amount", "description")
EXTRACTED = (
    "invoice_recipient string, vendor_name string, invoice_number string, invoice_date string, service_date string, currency string, "
    "net_amount decimal(18,2), vat_rate decimal(9,4), vat_amount decimal(18,2), gross_amount decimal(18,2), description string"
)
VALIDATION = "struct<check:string,severity:string,status:string,details:string,delta:decimal(18,4)>"
BOOKING_LINE = "struct<side:string,account:string,name:string,amount:decimal(18,2)>"
PATCH = "invoice_id string, seq long, patch map<string,string>"
AUDIT = "invoice_id string, action string, details map<string,string>, ts timestamp"
CANDIDATE = "doc string, rank int, engine string, text string"
