"""Eighteen layouts of statement files, two of which cannot be mapped, as declared data."""

from __future__ import annotations

from dataclasses import dataclass

from tallyframe.adapters import ATTRIBUTE, DEDUCTION, GROSS, KEY, NET, PERIOD, Family
from tallyframe.functions.money import COMMA, DOT


@dataclass(frozen=True)
class Layout:
    number: int
    name: str
    family: str
    held_out: bool
    rows: int
    currency: str
    convention: str
    dates: str
    periods: str
    style: str  # of amounts: none, symbol, code, nbsp, brackets
    file: str
    footer: str  # none, all (a total of all rows) or short (one that leaves the last row out)
    columns: tuple[tuple[str, str], ...]  # (header, what its cells hold), in the file's order

    @property
    def mappable(self) -> bool:
        return self.columns[0][1] != "opaque"

    @property
    def unseen(self) -> bool:
        """Whether its headers are declared to be in no layout that may be looked at."""
        return self.name.endswith("unseen_vocabulary")

    @property
    def day_first(self) -> bool:
        return self.dates != "M/D/Y"


# fixed values: name; family; * for held out; rows; currency; decimal mark; dates; periods; style; file; footer; header=content
_LAYOUTS = """
ins_01_canonical_gbp;insurance;*;150;GBP;dot;ISO;YYYY-MM;none;csv;none;Policy Reference=key,Period=period,Currency=currency,Inception Date=date,Coverholder=holder,Peril=peril,Gross Premium=gross,Insurance Premium Tax=tax,Commission=commission,Net Due to Carrier=net
ins_02_legacy_names_eur;insurance;*;140;EUR;comma;D/M/Y;MM/YYYY;code;csv;none;Risk Reference=key,Underwriting Period=period,Settlement Currency=currency,Date of Inception=date,Coverholder Name=holder,Gross Written Premium=gross,IPT Amount=tax,Commission Payable=commission,Settlement Amount=net
ins_03_abbreviated_reordered;insurance;;145;GBP;dot;ISO;YYYY-MM;symbol;xlsx;none;Net Due=net,GWP=gross,Pol Ref=key,Comm=commission,IPT=tax,Ccy=currency,Per=period,Inc Dt=date
ins_04_split_commission_usd;insurance;;150;USD;dot;M/D/Y;YYYY-MM;none;csv;none;Policy Ref=key,Reporting Month=period,Currency=currency,Effective Date=date,Coverholder=holder,Gross Premium=gross,Surplus Lines Tax=tax,Broker Commission=commission_a,Sub-Agent Commission=commission_b,Net Due=net
ins_05_tax_basis_ambiguous;insurance;;140;GBP;dot;D/M/Y;YYYY-MM;symbol;csv;none;Policy Reference=key,Period=period,Currency=currency,Inception=date,Premium (excl IPT)=before_tax,IPT=tax,Total Due (incl IPT)=gross,Commission=commission,Net to Carrier=net
ins_06_swapped_gross_net;insurance;;135;GBP;dot;ISO;YYYY-MM;none;csv;none;Policy Reference=key,Period=period,Currency=currency,Inception Date=date,Premium=net,Tax=tax,Commission=commission,Total Payable=gross
ins_07_duplicates_and_conflicts;insurance;;160;GBP;dot;ISO;YYYY-MM;none;csv;none;Policy Reference=key,Period=period,Currency=currency,Inception Date=date,Coverholder=holder,Gross Premium=gross,Insurance Premium Tax=tax,Commission=commission,Net Due to Carrier=net
ins_08_total_footer_disagrees;insurance;;150;GBP;dot;D/M/Y;YYYY-MM;symbol;csv;short;Policy Reference=key,Period=period,Currency=currency,Inception Date=date,Gross Premium=gross,Insurance Premium Tax=tax,Commission=commission,Net Due to Carrier=net
ins_09_total_agrees_rows_transposed;insurance;;150;EUR;comma;D/M/Y;YYYY-MM;code;csv;all;Policy Reference=key,Period=period,Currency=currency,Inception Date=date,Gross Premium=gross,IPT=tax,Commission=commission,Net Due to Carrier=net
ins_10_localised_dates_nbsp;insurance;*;145;EUR;comma;D/M/Y;Month YYYY;nbsp;xlsx;none;Policy Reference=key,Accounting Period=period,Currency=currency,Inception Date=date,Coverholder=holder,Gross Premium=gross,IPT=tax,Commission=commission,Net Due to Carrier=net
ins_11_unseen_vocabulary;insurance;*;140;GBP;dot;D Month YYYY;Month YYYY;code;csv;none;Contract Reference=key,Accounting Month=period,Denomination=currency,Attachment Date=date,Delegated Authority=holder,Consideration=gross,Fiscal Charge=tax,Intermediary Remuneration=commission,Remittance=net
ins_12_unmappable_pivot;insurance;;60;GBP;dot;ISO;YYYY-MM;none;csv;none;Region=opaque,Band=opaque,Q1=opaque,Q2=opaque,Q3=opaque,Q4=opaque,Var %=opaque
mkt_01_canonical_usd;marketplace;;150;USD;dot;M/D/Y;YYYY-MM;none;csv;none;Order Reference=key,Settlement Period=period,Currency=currency,Settlement Date=date,Seller ID=seller,Channel=channel,Gross Sales=gross,Marketplace Fee=fee,Seller Payout=net
mkt_02_abbreviated_eur;marketplace;;140;EUR;comma;D/M/Y;MM/YYYY;code;xlsx;none;Ord Ref=key,Per=period,Ccy=currency,Sttl Dt=date,Slr=seller,Gross=gross,Fee=fee,Payout=net
mkt_03_no_net_column;marketplace;;145;GBP;dot;ISO;YYYY-MM;symbol;csv;none;Order Reference=key,Settlement Period=period,Currency=currency,Settlement Date=date,Seller ID=seller,Category=category,Gross Sales=gross,Marketplace Fee=fee
mkt_04_legacy_reordered_refunds;marketplace;;150;USD;dot;M/D/Y;YYYY-MM;brackets;csv;none;Net Remittance=net,Transaction Id=key,Commission Charged=fee,Merchandise Value=gross,Statement Period=period,Currency Code=currency,Disbursement Date=date
mkt_05_unseen_vocabulary;marketplace;*;140;GBP;comma;D Month YYYY;Month YYYY;code;csv;none;Settlement Line=key,Cycle=period,Unit of Account=currency,Value Date=date,Consideration Gross=gross,Platform Charge=fee,Balance Transferred=net
mkt_06_unmappable_positional;marketplace;*;50;USD;dot;ISO;YYYY-MM;none;csv;none;field_0=opaque,field_1=opaque,field_2=opaque,field_3=opaque,field_4=opaque,field_5=opaque,field_6=opaque
"""
#: What repeats a key, or money, in the layout that has repeats: (row, row whose key it has, row whose money it has).
REPEATS = ((160, 10, 10), (161, 20, 161), (162, 162, 30))
REPEATING = "ins_07_duplicates_and_conflicts"


def _read(number: int, line: str) -> Layout:
    name, family, held, rows, currency, mark, dates, periods, style, file, footer, columns = line.split(";")
    pairs = tuple(tuple(c.split("=")) for c in columns.split(","))
    return Layout(number, name, family, held == "*", int(rows), currency, {"dot": DOT, "comma": COMMA}[mark], dates, periods, style, file, footer, pairs)


LAYOUTS = tuple(_read(i, line) for i, line in enumerate(_LAYOUTS.strip().splitlines(), 1))
#: Names of roles in the column contents; what is named here by itself is a field of that name.
_ROLES = {"key": KEY, "period": PERIOD, "gross": GROSS, "net": NET}


def true_columns(layout: Layout, family: Family) -> dict[str, str | None]:
    """field -> the header that holds it, None if none does; of two halves of a deduction the last."""
    out: dict[str, str | None] = {f.name: None for f in family.fields}
    roles = {f.role: f.name for f in family.fields if f.role in _ROLES.values()}
    named = {f.name for f in family.fields if f.role in (DEDUCTION, ATTRIBUTE)}
    for header, content in layout.columns:
        field = roles.get(_ROLES[content]) if content in _ROLES else content.removesuffix("_a").removesuffix("_b")
        if field in named or content in _ROLES:
            out[field] = header
    return out
