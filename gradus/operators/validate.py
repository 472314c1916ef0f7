"""Row validation: an ordered list of error codes for each row, as one array expression.

The codes' names (column:what_is_wrong) are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_FINITE = r"(?i)^[+-]?(s?nan[0-9]*|inf(inity)?)$"


@dataclass
class Rules:
    """What rows of text columns must meet.

    ranges: (columns, greatest value), the least is 0. formulas: column -> (divisor, parts):
    the column is their sum by the divisor, within TOLERANCE, where all are there.
    """

    year: int
    ranges: list[tuple[tuple[str, ...], int]]
    subjects: tuple[str, ...]
    formulas: dict[str, tuple[int, tuple[str, ...]]]
    total: str = "TongDiem"
    language: tuple[str, str] = ("MaMonNgoaiNgu", "NgoaiNgu")
    languages: str = "^N[1-7]$"
    widths: dict[str, int] = field(default_factory=lambda: {"SBD": 8, "Tinh": 2, "SBD_New": 6})


TOLERANCE = "0.01"
#: Sixteen whole digits and fourteen behind the point; sums of nine of them are exact, too.
KIND = "decimal(30,14)"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(name: str) -> Column:
    """A text column as a decimal; null if it is blank, no finite number, or longer than KIND."""
    return F.trim(F.col(name)).try_cast(KIND)


def too_long(name: str) -> Column:
    """Whether a text is a number of more whole digits than KIND holds: beyond every range."""
    return F.trim(F.col(name)).rlike(NUMBER) & number(name).isNull()


def padded(name: str, width: int) -> Column:
    """Digits padded with zeros to a width; anything else as it is, trimmed."""
    value = F.trim(F.col(name))
    return F.when(value.rlike("^[0-9]+$") & (F.length(value) <= width), F.lpad(value, width, "0")).otherwise(value)


def codes(rules: Rules) -> Column:
    """The codes of a row: column:what is wrong, in the order of checks."""
    blank = lambda n: F.trim(F.col(n)) == ""
    out: list[Column] = []
    (sbd, wide), (province, two), (suffix, six) = rules.widths.items()
    digits = lambda n, w: F.when(~F.trim(F.col(n)).rlike("^[0-9]+$"), f"{n}:khong_hop_le").when(F.length(F.trim(F.col(n))) > w, f"{n}:vuot_qua_{w}_chu_so")
    year = str(rules.year)
    out += [digits(sbd, wide), F.when(~F.trim(F.col("Nam")).isin(year, year[-2:]), "Nam:khong_khop_nam_file"), digits(province, two), digits(suffix, six)]
    whole = padded(sbd, wide)
    full = whole.rlike(f"^[0-9]{{{wide}}}$")
    out.append(F.when(~full, f"{sbd}:khong_du_{wide}_chu_so").when(padded(province, two) != F.substring(whole, 1, two), f"{province}:khong_khop_{sbd}"))
    out.append(F.when(full & (padded(suffix, six) != F.substring(whole, two + 1, six)), f"{suffix}:khong_khop_{sbd}"))
    names = [*rules.subjects, *[n for columns, _ in rules.ranges for n in columns if n not in rules.subjects]]
    for n in names:
        out.append(F.when(F.trim(F.col(n)).rlike(NOT_FINITE), f"{n}:so_khong_huu_han").when(~blank(n) & number(n).isNull() & ~too_long(n), f"{n}:khong_phai_so"))
    for columns, most in rules.ranges:
        out += [F.when(~number(n).between(0, most) | too_long(n), f"{n}:ngoai_khoang_0_{most}") for n in columns]
    code, score = rules.language
    given = F.upper(F.trim(F.col(code)))
    out.append(F.when((given != "") & ~given.rlike(rules.languages), f"{code}:khong_hop_le"))
    out.append(F.when((given != "") != number(score).isNotNull(), f"{code}:khong_dong_bo_diem_ngoai_ngu"))
    near = F.lit(TOLERANCE).cast(KIND)
    zero = F.lit(0).cast(KIND)
    every = sum((F.coalesce(number(s), zero) for s in rules.subjects[1:]), F.coalesce(number(rules.subjects[0]), zero))
    out.append(F.when(F.abs(number(rules.total) - every) > near, f"{rules.total}:sai_tong_cac_mon"))
    for n, (divisor, parts) in rules.formulas.items():
        expected = sum((number(p) for p in parts[1:]), number(parts[0]))
        out.append(F.when(F.abs(number(n) * divisor - expected) > near * divisor, f"{n}:sai_cong_thuc"))
    return F.array_compact(F.array(*out))
