"""What channel exports imply: stages, lengths, places and defaults that columns of other names tell.

Each function works on the columns that an export has; columns that it lacks stay absent, so that "not measured" is
never turned into "no".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a session that counts as having stayed (a fixed value).
STAYED = 0.5
INTERACTIONS = ("camera_on", "raise_hands", "unmute")


def _if_true(c: Column) -> Column:
    """True where c is, else null."""
    return F.when(c, F.lit(True))


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def _any_known(parts: list[Column]) -> Column:
    """Whether any of the known flags holds; null if none is known."""
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def email(df: DataFrame) -> DataFrame:
    """Delivered, where unknown, is the opposite of bounced; opened or engaged prove it, and prove nothing against it."""
    if not _has(df, "delivered"):
        return df
    known = [F.col("delivered")]
    known += [~F.col("bounced")] if _has(df, "bounced") else []
    known += [_if_true(F.col(c)) for c in ("opened", "engaged") if c in df.columns]
    return df.withColumn("delivered", F.coalesce(*known))


def opened_by_stamp(df: DataFrame) -> DataFrame:
    """Where an export has the time of opening, no time means not opened."""
    if not _has(df, "opened_at"):
        return df
    stamp = F.col("opened_at").isNotNull()
    return df.withColumn("opened", F.coalesce("opened", stamp) if _has(df, "opened") else stamp)


def whatsapp(df: DataFrame) -> DataFrame:
    """Opened from its stamp; engaged if a reply or a button is known; opened proves delivered."""
    df = opened_by_stamp(df)
    answers = [F.col(c) for c in ("replied", "button_clicked") if c in df.columns]
    if answers:
        df = df.withColumn("engaged", _any_known(answers))
    if _has(df, "opened", "delivered"):
        df = df.withColumn("delivered", F.coalesce("delivered", _if_true(F.col("opened"))))
    return df


def lms(df: DataFrame) -> DataFrame:
    """Opened from its stamp; engaged from progress, an assessment, attempts or completion; a failed assessment undoes completion, and completion proves opened."""
    df = opened_by_stamp(df)
    signs = {
        "progress_pct": lambda c: c > 0,
        "assessment_passed": lambda c: _if_true(c.isNotNull()),
        "attempts": lambda c: c > 0,
        "completed": _if_true,
    }
    known = [sign(F.col(c)) for c, sign in signs.items() if c in df.columns]
    if known:
        df = df.withColumn("engaged", _any_known(known))
    if _has(df, "completed", "assessment_passed"):
        df = df.withColumn("completed", F.when(F.col("assessment_passed").eqNullSafe(False), False).otherwise(F.col("completed")))
    if _has(df, "completed", "opened"):
        df = df.withColumn("opened", F.coalesce("opened", _if_true(F.col("completed"))))
    return df


def place_in_name(name: Column) -> Column:
    """City of 'Name (City - Unit)' or 'Name (City)'; null without brackets or text in them."""
    inside = F.regexp_extract(name, r"\(([^)]+)\)", 1)
    return F.nullif(F.trim(F.split_part(inside, F.lit("-"), F.lit(1))), F.lit(""))


def webinar(df: DataFrame, file: str = "file", stayed: float = STAYED) -> DataFrame:
    """Attendance exports. Each value of the column file is one export; what holds for a whole export comes from one aggregation, joined back.

    engaged, where unknown, is minutes over 0; engaged proves opened. An export that tells neither opened nor engaged
    of anyone lists attendees only: targeted and opened are then unknown. The session's length is the exported one,
    or the span from the first join to the last leave; completed is having stayed for a share of it, or any time
    where no length is known. Without departments the place in the names serves; interactions add up.
    """
    missing = {c: t for c, t in (("targeted", "boolean"), ("opened", "boolean"), ("engaged", "boolean"), ("session_minutes", "double"), ("department", "string"), ("participant_name", "string"), ("attendance_minutes", "double"), ("engaged_at", "timestamp"), ("left_at", "timestamp")) if c not in df.columns}
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()})
    span = (F.unix_micros(F.max("left_at")) - F.unix_micros(F.min("engaged_at"))) / 60e6
    whole = df.groupBy(F.col(file).alias("_file")).agg(
        F.bool_or(F.col("opened").isNotNull() | F.col("engaged").isNotNull()).alias("_tells"),
        F.bool_or(F.col("session_minutes").isNotNull()).alias("_long"),
        F.when(span > 0, span).alias("_span"),
        F.bool_or(F.col("department").isNotNull()).alias("_placed"),
    )
    df = df.join(whole, F.col(file).eqNullSafe(F.col("_file")))
    there = F.coalesce("engaged", F.col("attendance_minutes") > 0)
    length = F.when(F.col("_long"), F.col("session_minutes")).otherwise(F.col("_span"))
    minutes = F.col("attendance_minutes")
    done = F.when(minutes.isNull(), F.lit(None)).when(length > 0, minutes / length >= stayed).otherwise(minutes > 0)
    counted = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in INTERACTIONS if c in df.columns]
    extra = {"interactions": sum(counted[1:], counted[0])} if counted else {}
    out = df.withColumns(
        {
            "engaged": there,
            "opened": F.when(F.col("_tells"), F.when(there, True).otherwise(F.col("opened"))),
            "targeted": F.when(F.col("_tells"), F.col("targeted")),
            "session_minutes": length,
            "completed": done,
            "department": F.when(F.col("_placed"), F.col("department")).otherwise(place_in_name(F.col("participant_name"))),
            **extra,
        }
    )
    return out.drop("_file", "_tells", "_long", "_span", "_placed")


def roster(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Departments by their aliases (whatever the case), active unless said otherwise."""
    from ..functions import coerce as C

    df = df.withColumn("department", C.to_text(F.col("department"), aliases)) if _has(df, "department") else df
    return df.withColumn("is_active", F.coalesce("is_active", F.lit(True))) if _has(df, "is_active") else df


def registry(df: DataFrame) -> DataFrame:
    """Campaigns are not mandatory unless said so."""
    return df.withColumn("mandatory", F.coalesce("mandatory", F.lit(False))) if _has(df, "mandatory") else df
