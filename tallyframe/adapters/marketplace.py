"""Settlements of sales."""

from tallyframe.adapters import ATTRIBUTE, DEDUCTION, GROSS, KEY, NET, PERIOD, Family, Field, Shape, register

# fixed values: header spellings of each field, and what its values look like
FAMILY = register(Family("marketplace", (
    Field("order_reference", KEY, True, ("order reference", "order id", "order no", "order number", "transaction id", "txn id", "settlement reference", "order ref", "sales order"), Shape(pattern=r"^[A-Z]{2,6}[-/]?(?:\d+[-/])*\d{3,10}$", monetary=0.0)),
    Field("period", PERIOD, True, ("period", "settlement period", "month", "payout period", "statement month"), Shape(temporal=0.9, monetary=0.0, near_constant=True)),
    Field("gross_sales", GROSS, True, ("gross sales", "gross", "item total", "order total", "gross revenue", "sales value", "gross amount", "total sales", "merchandise value"), Shape(monetary=0.99, magnitude_rank=0)),
    Field("fee", DEDUCTION, False, ("fee", "marketplace fee", "platform fee", "commission fee", "selling fee", "referral fee", "service fee", "fees"), Shape(monetary=0.99, magnitude_rank=2)),
    Field("payout", NET, False, ("payout", "seller payout", "net payout", "amount payable", "net proceeds", "settlement amount", "net", "disbursement"), Shape(monetary=0.99, magnitude_rank=1)),
    Field("seller_name", ATTRIBUTE, False, ("seller", "seller name", "merchant", "merchant name", "vendor", "store"), Shape(monetary=0.0, categorical=False)),
    Field("category", ATTRIBUTE, False, ("category", "product category", "department", "segment", "item category"), Shape(monetary=0.0, categorical=True)),
)))
