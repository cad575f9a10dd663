"""Premium statements."""

from tallyframe.adapters import ATTRIBUTE, DEDUCTION, GROSS, KEY, NET, PERIOD, Family, Field, Shape, register

# fixed values: header spellings of each field, and what its values look like
FAMILY = register(Family("insurance", (
    Field("policy_reference", KEY, True, ("policy reference", "policy ref", "policy no", "policy number", "policyref", "certificate number", "cert no", "risk reference", "unique market reference", "umr", "pol ref", "policy id"), Shape(pattern=r"^[A-Z]{2,6}[-/]?(?:\d+[-/])*\d{3,10}$", monetary=0.0)),
    Field("period", PERIOD, True, ("period", "reporting period", "month", "bordereau month", "statement period"), Shape(temporal=0.9, monetary=0.0, near_constant=True)),
    Field("gross_premium", GROSS, True, ("gross premium", "gross written premium", "gwp", "written premium", "premium gross", "prem gross", "gross prem", "gross prem excl tax", "gross premium excluding ipt", "total premium", "premium"), Shape(monetary=0.99, magnitude_rank=0)),
    Field("tax", DEDUCTION, False, ("ipt", "insurance premium tax", "tax", "premium tax", "ipt amount", "tax amount", "govt levy", "government levy"), Shape(monetary=0.99, magnitude_rank=3)),
    Field("commission", DEDUCTION, False, ("commission", "brokerage", "commission amount", "comm", "comm amount", "broker commission", "coverholder commission", "acquisition cost"), Shape(monetary=0.99, magnitude_rank=2)),
    Field("net_premium", NET, False, ("net premium", "net due", "net to carrier", "net", "nett premium", "premium net of commission", "net amount due", "settlement amount"), Shape(monetary=0.99, magnitude_rank=1)),
    Field("insured_name", ATTRIBUTE, False, ("insured", "insured name", "client", "client name", "policyholder", "assured"), Shape(monetary=0.0, categorical=False)),
    Field("peril", ATTRIBUTE, False, ("peril", "cover", "coverage", "class", "class of business", "product", "lob"), Shape(monetary=0.0, categorical=True)),
)))
