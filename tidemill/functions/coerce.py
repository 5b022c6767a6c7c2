"""Typed values from messy text: blank is unknown, and what cannot be read is unknown too."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .steps import let

#: Words read as true and as false (fixed values, the method's vocabulary).
TRUES = [
    *("true", "t", "yes", "y", "1", "1.0", "on", "success", "ok", "✓", "x"),
    *("delivered", "opened", "read", "clicked", "attended", "registered"),
    *("completed", "complete", "passed", "pass", "active", "enabled"),
]
FALSES = [
    *("false", "f", "no", "n", "0", "0.0", "off", "failed", "fail"),
    *("bounced", "blocked", "dropped", "undelivered", "expired", "declined"),
    *("not started", "notstarted", "in progress", "inprogress", "incomplete"),
    *("not registered", "notregistered", "none", "never", "inactive", "disabled"),
]


def header(name: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "")


def blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def to_bool(c: Column, trues: tuple[str, ...] = (), falses: tuple[str, ...] = ()) -> Column:
    """Own words are added to the defaults, and taken out of the opposite ones."""
    t, f = ([w.strip().lower() for w in words] for words in (trues, falses))
    token = F.lower(F.trim(c))
    yes, no = token.isin([w for w in TRUES if w not in f] + t), token.isin([w for w in FALSES if w not in t] + f)
    return F.when(yes, True).when(no, False)


def to_number(c: Column) -> Column:
    """All but digits, point and minus is dropped first."""
    return F.regexp_replace(c, r"[^\d.\-]", "").try_cast("double")


def to_bool_from_count(c: Column) -> Column:
    """Any positive number."""
    return F.when(~blank(c), to_number(c) > 0)


def to_percent(c: Column) -> Column:
    """With a percent sign or above 1, hundredths."""
    n = to_number(c)
    return F.when(F.trim(c).endswith("%") | (n > 1), n / 100).otherwise(n)


#: Spellings of the units of a duration (fixed values).
UNITS = {"h": "hours|hour|hrs|hr|h", "m": "minutes|minute|mins|min|m", "s": "seconds|second|secs|sec|s"}


def to_minutes(c: Column) -> Column:
    """A clock (H:MM[:SS], under 60 minutes and seconds), ISO PT#H#M#S, numbers with units in falling order, else what number is left, as minutes."""
    t = F.lower(F.trim(c))

    def summed(pattern: str, condition: Column) -> Column:
        h, m, s = (F.coalesce(F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).cast("double"), F.lit(0.0)) for k in (1, 2, 3))
        return F.when(t.rlike(pattern) & condition, h * 60 + m + s / 60)

    number = t.rlike(r"\d")
    clock = summed(r"^(\d+):([0-5]?\d)(?::([0-5]?\d))?$", number)
    iso = summed(r"^p?t?(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$", number & t.rlike("^[pt]"))
    units = summed("^" + r"\s*".join(rf"(?:(\d+(?:\.\d+)?)\s*(?:{u}))?" for u in UNITS.values()) + "$", number)
    return F.coalesce(clock, iso, units, to_number(t))


#: Orders of year, month and day by the shape of a date: a digit for one or two, four or eight digits as they are, b for a month's name.
SHAPES = {
    **dict.fromkeys(["9999-9-9", "9999/9/9", "9999.9.9", "9999 9 9", "9999 b 9", "9999-b-9"], "ymd"),
    **dict.fromkeys(["9/9/9999", "9-9-9999", "9.9.9999", "9 9 9999", "9/9/9", "9-9-9", "9.9.9"], "configured"),
    **dict.fromkeys(["9 b 9999", "9-b-9999", "9/b/9999", "9.b.9999", "9 b, 9999", "9-b-9", "9 b 9", "9b9999"], "dmy"),
    **dict.fromkeys(["b 9, 9999", "b 9 9999", "b-9-9999", "b. 9, 9999", "b 9,9999"], "mdy"),
    "99999999": "digits",
    "b 9999": "my",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
_DAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"
_CLOCK = r"(?:[t ]\s*(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?\s*(am|pm)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?)?$"


def to_datetime(c: Column, day_first: Column | bool = True, shapes: dict[str, str] | None = None) -> Column:
    """A point in time written in any layout of SHAPES, with or without a time of day; what has no zone is UTC.

    A text's shape says which of its numbers is which, so a row is parsed once however many layouts there are. Where day
    and month are both numbers their order is as configured (a constant, or a column, such as a source's setting); only
    if that gives no month and the other order does, the other. Two-digit years are of 1969 to 2068. Numbers that are
    text are no dates; serial_date() is for numeric cells.
    """
    swap = F.lit(day_first) if isinstance(day_first, bool) else day_first
    orders = F.create_map(*(F.lit(x) for pair in (SHAPES if shapes is None else shapes).items() for x in pair))
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)))
    part = lambda text, k: F.nullif(F.regexp_extract(text, _CLOCK, k), F.lit(""))

    def shape(day: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(day, _MONTH, "b"), r"(?<!\d)\d{8}(?!\d)", "#8")
        s = F.regexp_replace(F.regexp_replace(s, r"(?<!\d)\d{4}(?!\d)", "#4"), r"(?<![\d#])\d{1,2}(?!\d)", "9")
        return F.replace(F.replace(F.regexp_replace(s, r"\s+", " "), F.lit("#4"), F.lit("9999")), F.lit("#8"), F.lit("99999999"))

    def read(r: Column) -> Column:
        order, x, digits = r["order"], [r["n"][i] for i in range(3)], [F.substring(r["day"], p, n).try_cast("int") for p, n in ((1, 4), (5, 2), (7, 2))]
        leads = (order == "dmy") | ((order == "configured") & F.when(swap, (x[1] <= 12) | (x[0] > 12)).otherwise((x[0] > 12) & (x[1] <= 12)))
        by = lambda eight, ymd, dmy, mdy, my: F.when(order == "digits", eight).when(order == "ymd", ymd).when(order == "my", my).when(leads, dmy).otherwise(mdy)
        return let({"y": by(digits[0], x[0], x[2], x[2], x[1]), "m": by(digits[1], x[1], x[1], x[0], x[0]), "d": by(digits[2], x[2], x[0], x[1], F.lit(1))}, lambda v: stamp(r, v))

    def stamp(r: Column, v: Column) -> Column:
        year = F.when(v["y"] < 69, v["y"] + 2000).when(v["y"] < 100, v["y"] + 1900).otherwise(v["y"])
        hour = F.when(r["half"].isNull(), r["hour"]).when(r["hour"] > 12, F.lit(99)).otherwise(r["hour"] % 12 + F.when(r["half"] == "pm", 12).otherwise(0))
        east = F.when(r["zone"] == "", F.lit(0)).otherwise((F.substring(r["zone"], 2, 2).cast("int") * 60 + F.right(r["zone"], F.lit(2)).cast("int")) * F.when(F.left(r["zone"], F.lit(1)) == "-", -1).otherwise(1))
        return F.try_make_timestamp(year, v["m"], v["d"], hour, r["minute"], r["second"], F.lit("UTC")) - F.make_dt_interval(mins=east)

    number = lambda x: F.coalesce(F.try_element_at(months, F.left(x, F.lit(3))), x.try_cast("int"))
    parsed = lambda r: let(
        {
            "day": r["day"],
            "order": F.try_element_at(orders, shape(r["day"])),
            "n": F.transform(F.concat(F.regexp_extract_all(r["day"], F.lit(r"(\d+|[a-z]+)"), F.lit(1)), F.array(*[F.lit("")] * 3)), number),
            "hour": F.coalesce(part(r["text"], 1).cast("int"), F.lit(0)),
            "minute": F.coalesce(part(r["text"], 2).cast("int"), F.lit(0)),
            "second": F.coalesce(part(r["text"], 3), F.lit("0")).cast("decimal(8,6)"),
            "half": part(r["text"], 4),
            "zone": F.regexp_extract(F.coalesce(part(r["text"], 5), F.lit("")), r"[+-]\d{2}:?\d{2}", 0),
        },
        lambda q: F.when(q["order"].isNotNull(), read(q)),
    )
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), _DAY, ""), r"(?<=\d)(?:st|nd|rd|th)\b", "")
    return let({"text": bare}, lambda r: let({"text": r["text"], "day": F.regexp_replace(r["text"], _CLOCK, "")}, parsed))


def to_date(c: Column, day_first: Column | bool = True) -> Column:
    """The day of to_datetime()."""
    return to_datetime(c, day_first).cast("date")


def serial_date(c: Column) -> Column:
    """Numeric cells from 32000 to 55000 are days of a spreadsheet, fractions times of day; others are no dates."""
    n = c.cast("double")
    return F.when(n.between(32000, 55000), F.timestamp_micros(F.round((n - 25569) * 86400).cast("long") * 1_000_000))


def to_text(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trimmed, blank is null, folded by alias (as written, then in lower case)."""
    t = F.nullif(F.trim(c), F.lit(""))
    if not aliases:
        return t
    exact = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    lower = F.create_map(*(F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)))
    return F.coalesce(exact[t], lower[F.lower(t)], t)


def slug(c: Column) -> Column:
    """X11: lower case words joined by hyphens; 'unknown' if there are none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def e164(c: Column, country: str = "91") -> Column:
    """Digits with the country code and a plus."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    digits = F.regexp_replace(t, r"\D", "")
    full = F.when(digits.startswith("00"), F.substring(digits, 3, 40)).when(digits.startswith("0"), F.concat(F.lit(country), F.substring(digits, 2, 40))).when(t.startswith("+") | (digits.startswith(country) & (F.length(digits) > 10)), digits).otherwise(F.concat(F.lit(country), digits))
    return F.when(digits != "", F.concat(F.lit("+"), full))


def pseudonym(c: Column, key: bytes) -> Column:
    """First 32 hex digits of HMAC-SHA256, in built-in functions."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in k)) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(c, "utf-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, 32)


#: Builders by type name.
COERCIONS = {"bool": to_bool, "bool_from_count": to_bool_from_count, "number": to_number, "percent": to_percent, "minutes": to_minutes, "date": to_date, "datetime": to_datetime, "serial": serial_date, "text": to_text, "slug": slug}
