"""Salaries in prose, read token by token: amounts with their currency, what joins two of them, labels and periods."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Currencies, the largest plausible pay and ratio of a range's ends, and how far labels reach, in characters.
CODES = ("USD", "CAD", "AUD", "NZD", "GBP", "EUR", "CHF", "JPY", "INR")
SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR"}
MOST, SPREAD = 5_000_000, 10
LABEL_REACH, LABELS_APART = 40, 400

_TOKEN = re.compile(r"(?P<number>\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+(?:\.\d+)?)(?P<k>[kK](?![A-Za-z]))?|(?P<symbol>[$£€])|(?P<word>[A-Za-z]+)|(?P<sign>\S)")
_SPLIT_THOUSANDS = re.compile(r"([$£€]\s*\d{1,3}),\s(\d{3})(?!\d)")
_JOINTS = frozenset(("-", "–", "—", "to", "and"))
_PAY = frozenset(("salary", "pay", "compensation", "wage", "rate", "base"))
_LABELS = {"minimum": "low", "min": "low", "maximum": "high", "max": "high"}
_PERIODS = {"year": "year", "yr": "year", "annum": "year", "annually": "year", "hour": "hour", "hr": "hour", "hourly": "hour", "month": "month", "week": "week"}


@dataclass
class Amount:
    value: float
    thousands: bool
    currency: str | None
    marked: bool
    first: int
    after: int

    def rounded(self) -> int:
        """In whole units; a k counts for short figures only, as long ones have it by mistake."""
        return round(self.value) * (1000 if self.thousands and round(self.value) < 1000 else 1)


class Prose:
    """The tokens of a text: (kind, text, whether a k follows, start, end)."""

    def __init__(self, text: str):
        text = _SPLIT_THOUSANDS.sub(r"\1,\2", text)
        self.at = [(m.lastgroup if m.lastgroup != "k" else "number", m["number"] or m[0], bool(m["k"]), m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def kind(self, i: int) -> str:
        return self.at[i][0] if i < len(self.at) else ""

    def word(self, i: int) -> str:
        return self.at[i][1].lower() if i < len(self.at) and self.at[i][0] in ("word", "sign") else ""

    def code(self, i: int) -> str | None:
        up = self.word(i).upper()
        return up if up in CODES else None

    def amount(self, i: int) -> Amount | None:
        """An amount from token i on: a code or a sign or both, the figure, a code."""
        first, code, sign = i, self.code(i), None
        i += code is not None
        if self.kind(i) == "symbol":
            sign = self.at[i][1]
            i += 1
        if self.kind(i) != "number":
            return None
        _, figure, k, _, _ = self.at[i]
        after = self.code(i + 1)
        return Amount(float(figure.replace(",", "")), k, code or after or SYMBOLS.get(sign or ""), bool(code or after or sign), first, i + 1 + (after is not None))

    def period(self, i: int) -> str | None:
        """The period that is stated from token i on: `annually`, `per year`, `/ hr`, `a week`."""
        if self.word(i) in ("annually", "hourly"):
            return _PERIODS[self.word(i)]
        return _PERIODS.get(self.word(i + 1)) if self.word(i) in ("per", "/", "a", "an") else None


def _plausible(low: float, high: float) -> bool:
    return 0 < low <= high <= MOST and high <= SPREAD * low


def _range(low: Amount, high: Amount) -> tuple[int, int] | None:
    """The ends of a range. A k after the second figure alone counts for both where they are of one size, as in "$50-60k"."""
    a, b = low.rounded(), high.rounded()
    if high.thousands and not low.thousands and low.value < 1000 and _plausible(low.value, high.value):
        a *= 1000
    a, b = min(a, b), max(a, b)
    return (a, b) if (low.marked or high.marked) and _plausible(a, b) else None


def _labelled(x: Prose) -> tuple[int, int, str | None, str | None] | None:
    """Ends that are stated one by one, each with a label, a currency and a word for pay near by."""
    pay = [i for i in range(len(x.at)) if x.word(i) in _PAY]
    low, last = None, 0
    for i in range(len(x.at)):
        end = _LABELS.get(x.word(i))
        if end is None:
            continue
        j = i + 1
        while j < len(x.at) and x.kind(j) not in ("number", "symbol") and x.code(j) is None and x.at[j][3] - x.at[i][4] <= LABEL_REACH:
            j += 1
        found = x.amount(j)
        if found is None or not found.marked or x.at[j][3] - x.at[i][4] > LABEL_REACH:
            continue
        # The word for pay stands between the label's reach to the left and the amount's end.
        while last < len(pay) and x.at[pay[last]][3] < x.at[i][3] - LABEL_REACH:
            last += 1
        if last == len(pay) or x.at[pay[last]][4] > x.at[found.after - 1][4]:
            continue
        here = (x.at[i][3], found.rounded(), found.currency, x.period(found.after))
        if end == "low":
            low = low or here
        elif low is not None:
            fits = here[0] - low[0] <= LABELS_APART and _plausible(low[1], here[1])
            return (low[1], here[1], low[2] or here[2], low[3] or here[3]) if fits else None
    return None


def salary(text: str | None) -> tuple[float | None, float | None, str | None, str | None]:
    """(lowest, highest, currency, period) of what a text says of pay.

    All ranges with a currency count, from the lowest end to the highest; without any, ends with labels of their own; without
    those, the first amount with a currency and a period. Implausible figures are no answer. Time grows with the text's length.
    """
    x = Prose(text or "")
    low = high = currency = period = single = None
    i = 0
    while i < len(x.at):
        first = x.amount(i) if x.kind(i) in ("number", "symbol") or x.code(i) else None
        if first is None:
            i += 1
            continue
        second = x.amount(first.after + 1) if x.word(first.after) in _JOINTS else None
        if second and (ends := _range(first, second)):
            low, high = min(ends[0], low or ends[0]), max(ends[1], high or 0)
            currency, period = currency or first.currency or second.currency, period or x.period(second.after)
            i = second.after
            continue
        if single is None and first.marked and (every := x.period(first.after)) and _plausible(first.rounded(), first.rounded()):
            single = (float(first.rounded()),) * 2 + (first.currency, every)
        i = first.after
    if low is not None:
        return float(low), float(high), currency, period
    if found := _labelled(x):
        return float(found[0]), float(found[1]), found[2], found[3]
    return single or (None, None, None, None)


PAY = T.StructType([T.StructField(c, T.DoubleType() if c in ("salary_min", "salary_max") else T.StringType()) for c in ("salary_min", "salary_max", "salary_currency", "salary_period")])


@F.pandas_udf(PAY)
def salary_from_text(col: pd.Series) -> pd.DataFrame:
    rows = [salary(x) for x in col]
    out = pd.DataFrame(rows, columns=PAY.names, dtype=object)
    return out.astype({"salary_min": float, "salary_max": float})
