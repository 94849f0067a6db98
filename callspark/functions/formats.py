"""Report columns: numbers, durations and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import CURRENCY_SYMBOLS
from .text import round_up


def fixed(value: Column, places: int, grouped: bool = False) -> Column:
    """A number with fixed places, rounded half up, optionally with thousands commas."""
    form = f"%{',' if grouped else ''}.{places}f"
    return F.format_string(form, round_up(value.cast("double"), places))


def _whole(value: Column) -> Column:
    return value.cast("bigint")


def _count(value: Column, unit: str) -> Column:
    plural = F.when(value == 1, unit).otherwise(unit + "s")
    return F.concat(value.cast("string"), F.lit(" "), plural)


def _and(first: Column, rest: Column, show: Column) -> Column:
    return F.when(show, F.concat(first, F.lit(" "), rest)).otherwise(first)


def duration_text(seconds: Column, style: str = "human") -> Column:
    """Seconds as clock (HH:MM:SS), short (1h 2m) or human (1 hour 2 minutes)."""
    s = _whole(seconds)
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    if style == "clock":
        text = F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, sec)).otherwise(
            F.format_string("%02d:%02d", m, sec)
        )
    elif style == "short":
        unit = lambda v, u: F.concat(v.cast("string"), F.lit(u))
        text = (
            F.when(s < 60, unit(s, "s"))
            .when(s < 3600, _and(unit(m, "m"), unit(sec, "s"), sec > 0))
            .otherwise(_and(unit(h, "h"), unit(m, "m"), m > 0))
        )
    else:
        text = (
            F.when(s < 60, _count(s, "second"))
            .when(s < 3600, _and(_count(m, "minute"), _count(sec, "second"), sec > 0))
            .otherwise(_and(_count(h, "hour"), _count(m, "minute"), m > 0))
        )
    return F.when(seconds.isNull() | (seconds < 0), F.lit("0s")).otherwise(text)


def metric_duration(seconds: Column) -> Column:
    """Two largest units, zeros kept: 2h 0m, 3m 0s, 5s."""
    s = _whole(seconds)
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm", h, m))
        .when(m > 0, F.format_string("%dm %ds", m, sec))
        .otherwise(F.format_string("%ds", sec))
    )


def bytes_text(count: Column, precision: int = 2) -> Column:
    units = ["KB", "MB", "GB", "TB", "PB"]
    text = F.when(count < 0, F.lit("0 B")).when(
        count < 1024, F.concat(_whole(count).cast("string"), F.lit(" B"))
    )
    for i, unit in enumerate(units, start=1):
        value = F.concat(fixed(count / F.lit(float(1024**i)), precision), F.lit(f" {unit}"))
        text = text.otherwise(value) if unit == "PB" else text.when(count < 1024 ** (i + 1), value)
    return text


def percent_text(fraction: Column, precision: int = 1, signed: bool = False) -> Column:
    body = F.concat(fixed(fraction * 100, precision), F.lit("%"))
    return F.when(fraction > 0, F.concat(F.lit("+"), body)).otherwise(body) if signed else body


def currency_text(amount: Column, currency: str = "USD", precision: int = 2) -> Column:
    symbol = CURRENCY_SYMBOLS.get(currency, currency + " ")
    places = 0 if currency == "JPY" else precision
    return F.concat(F.lit(symbol), fixed(amount, places, grouped=True))


def list_text(items: Column, max_items: int = 5, separator: str = ", ") -> Column:
    more = F.size(items) - max_items
    shown = F.array_join(F.slice(items, 1, max_items), separator)
    return F.when(
        more > 0, F.concat(shown, F.format_string(" (and %d more)", more))
    ).otherwise(shown)


def time_ago(moment: Column, reference: Column) -> Column:
    """Age of a timestamp in its largest unit, as text."""
    total = F.timestamp_diff("SECOND", moment, reference)
    days = F.floor(total / 86400)
    rest = total - days * 86400

    def ago(value: Column, unit: str) -> Column:
        return F.concat(_count(value, unit), F.lit(" ago"))

    return (
        F.when(total <= 0, F.lit("just now"))
        .when(days > 365, ago(F.floor(days / 365), "year"))
        .when(days > 30, ago(F.floor(days / 30), "month"))
        .when(days > 0, ago(days, "day"))
        .when(rest > 3600, ago(F.floor(rest / 3600), "hour"))
        .when(rest > 60, ago(F.floor(rest / 60), "minute"))
        .otherwise(F.lit("just now"))
    )


def metric_text(value: Column, kind: str = "number") -> Column:
    """A KPI value as percent, currency, duration or plain number."""
    if kind == "percent":
        return F.concat(fixed(value, 1), F.lit("%"))
    if kind == "currency":
        return F.concat(F.lit("$"), fixed(value, 2, grouped=True))
    if kind == "duration":
        return metric_duration(value)
    if kind == "integer":
        return F.format_string("%,d", value.cast("bigint"))
    return fixed(value, 1, grouped=True)


def delta_text(delta: Column, kind: str = "number") -> Column:
    """A signed KPI change; a change below 1e-9 shows as zero without sign."""
    size = F.abs(delta.cast("double"))
    shown, zero = {
        "percent": (F.concat(fixed(size, 1), F.lit("%")), "0.0%"),
        "currency": (F.concat(F.lit("$"), fixed(size, 2, grouped=True)), "$0.00"),
        "duration": (F.concat(fixed(size, 1), F.lit(" min")), "0.0 min"),
        "number": (fixed(size, 1, grouped=True), "0"),
    }[kind]
    sign = F.when(delta < 0, "-").otherwise("+")
    return F.when(size < 1e-9, F.lit(zero)).when(
        size.isNotNull(), F.concat(sign, shown)
    )


def change_text(change: Column, delta: Column) -> Column:
    """Arrow, change in percent and the difference, as in the comparison table."""
    arrow = F.when(change > 0, "↑").when(change < 0, "↓").otherwise("→")
    whole = delta == F.floor(delta)
    sign = F.when(delta < 0, "-").otherwise("+")
    size = F.abs(delta)
    number = F.when(whole, fixed(size, 0, grouped=True)).otherwise(fixed(size, 2, grouped=True))
    difference = F.when(
        delta.isNotNull() & (delta != 0), F.concat(F.lit(" (Δ "), sign, number, F.lit(")"))
    ).otherwise(F.lit(""))
    return F.when(change.isNull(), F.lit("-")).otherwise(
        F.concat(arrow, F.lit(" "), fixed(F.abs(change), 1), F.lit("%"), difference)
    )


def money_or_dash(amount: Column) -> Column:
    return F.when(amount > 0, F.concat(F.lit("$"), fixed(amount, 2))).otherwise(F.lit("-"))
