"""A made-up market in the archives' format: every manager files once a quarter for three quarters and
holds the securities whose reach covers it."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass

MANAGERS = 60
COLUMNS = {
    "SUBMISSION": "ACCESSION_NUMBER FILING_DATE SUBMISSIONTYPE CIK PERIODOFREPORT".split(),
    "COVERPAGE": "ACCESSION_NUMBER ISAMENDMENT AMENDMENTNO AMENDMENTTYPE REPORTTYPE FILINGMANAGER_NAME".split(),
    "SUMMARYPAGE": "ACCESSION_NUMBER TABLEENTRYTOTAL TABLEVALUETOTAL".split(),
    "INFOTABLE": (
        "ACCESSION_NUMBER INFOTABLE_SK NAMEOFISSUER TITLEOFCLASS CUSIP FIGI VALUE SSHPRNAMT SSHPRNAMTTYPE PUTCALL"
    ).split(),
}


@dataclass(frozen=True)
class Security:
    code: str
    issuer: str
    title: str
    price: int
    reach: tuple[int, int, int]  # managers holding it in each quarter, the lowest numbers first


ALDER = Security("10A000101", "ALDER MILLS INC", "COM", 50, (60, 60, 60))
BIRCH = Security("20B000202", "BIRCH FOODS CORP", "COM", 110, (40, 45, 50))
CEDAR = Security("30C000303", "CEDAR RAIL CO", "COM", 75, (50, 45, 40))
INDEX = Security("40D000404", "DOMESTIC INDEX TR", "UNIT SER 1", 300, (30, 35, 45))
EVERY = (ALDER, BIRCH, CEDAR, INDEX)
# Archive, quarter end and filing day of each quarter.
QUARTERS = (
    ("01jun2024-31aug2024_form13f.zip", "30-JUN-2024", "12-AUG-2024"),
    ("01sep2024-30nov2024_form13f.zip", "30-SEP-2024", "12-NOV-2024"),
    ("01dec2024-28feb2025_form13f.zip", "31-DEC-2024", "12-FEB-2025"),
)


def report(manager: int, quarter: int) -> dict[str, list[list]]:
    """One manager's report: its rows of each member."""
    _, period, filed = QUARTERS[quarter]
    accession = f"M{manager:04d}Q{quarter}"
    shares = 2000 * manager + 50 * quarter
    lines = [
        [accession, n, s.issuer, s.title, s.code if n else s.code.lower(), "", shares * s.price, shares, "SH", ""]
        for n, s in enumerate(s for s in EVERY if manager <= s.reach[quarter])
    ]
    lines.append([accession, 99, ALDER.issuer, ALDER.title, ALDER.code, "", 7, 7, "SH", "Call"])
    return {
        "SUBMISSION": [[accession, filed, "13F-HR", f"{manager:010d}", period]],
        "COVERPAGE": [[accession, "N", "", "", "13F HOLDINGS REPORT", f'Manager "{manager}" LLC']],
        "SUMMARYPAGE": [[accession, len(lines), 0]],
        "INFOTABLE": lines,
    }


def write_zips(folder, change=None) -> None:
    """An archive per quarter; `change(quarter, rows)` may alter what goes into it."""
    folder.mkdir(parents=True, exist_ok=True)
    for quarter, (name, _, _) in enumerate(QUARTERS):
        reports = [report(manager, quarter) for manager in range(1, MANAGERS + 1)]
        rows = {member: [line for r in reports for line in r[member]] for member in COLUMNS}
        if change:
            change(quarter, rows)
        with zipfile.ZipFile(folder / name, "w") as archive:
            for member, columns in COLUMNS.items():
                # names of members differ in case and folder from one delivery to the next
                inner = f"data/{member.lower()}.tsv" if quarter == 1 else f"{member}.tsv"
                text = "".join("\t".join(map(str, row)) + "\n" for row in [columns, *rows[member]])
                archive.writestr(inner, text)
