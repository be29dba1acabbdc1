"""Column expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarflow.schemas import TICKS_PER_UNIT

# Fixed formats of the raw export.
TIMESTAMP_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
WHOLE_NUMBER_WITH_POINT_ZERO = r"^([0-9]+)[.]0$"


def parse_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a zone-free timestamp; anything else becomes NULL."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(TIMESTAMP_SHAPE), trimmed.try_cast("timestamp_ntz"))


def parse_number(text: Column) -> Column:
    """Text to double; unparsable text becomes NULL."""
    return F.trim(text.cast("string")).try_cast("double")


def normalize_user_id(col: Column) -> Column:
    """``12345.0`` to ``12345``; ids that are not all digits before the ``.0`` stay as they are."""
    trimmed = F.trim(col)
    # The cheap suffix test keeps the pattern away from ids that are clean already.
    stripped = F.regexp_replace(trimmed, WHOLE_NUMBER_WITH_POINT_ZERO, "$1")
    return F.when(F.endswith(trimmed, F.lit(".0")), stripped).otherwise(trimmed)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def has_user(col: str = "user_id") -> Column:
    """Rows with a usable user id (NULL and blank are both out)."""
    return F.col(col).isNotNull() & (F.col(col) != "")


def round_half_away(value: Column, places: int) -> Column:
    """Round by scaling to whole numbers: ties are judged on the scaled double, as most engines do."""
    scale = float(10**places)
    return F.round(value * F.lit(scale)) / F.lit(scale)


def to_ticks(amount: Column) -> Column:
    """Money with four decimals as an exact whole number, so that sums do not depend on row order."""
    return F.round(amount * TICKS_PER_UNIT).cast("bigint")


def from_ticks(ticks: Column) -> Column:
    return ticks.cast("double") / F.lit(float(TICKS_PER_UNIT))


def random_policy_score(user_id: Column, as_of_date: Column) -> Column:
    """Repeatable pseudo-random ratio: the first 16 hex digits of a SHA-256 over 2**64 - 1."""
    key = F.concat_ws("|", user_id.cast("string"), as_of_date.cast("string"), F.lit("policy_random"))
    high_bits = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10)
    return high_bits.cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


def rfm_policy_score(lookback: int) -> Column:
    """Recency-frequency-monetary heuristic for one lookback."""
    return (
        F.lit(1.0) / (F.lit(1.0) + F.col("recency_days").cast("double"))
        + F.lit(0.5) * F.col(f"frequency_{lookback}d").cast("double")
        + F.lit(0.01) * F.col(f"monetary_{lookback}d").cast("double")
    )


def dot(left: Column, right: Column) -> Column:
    """Inner product of two numeric arrays, in double."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalized(vector: Column) -> Column:
    """Array divided by its length; a zero vector stays zero."""
    return scaled_down(vector, F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12)))


def scaled_down(vector: Column, by: Column) -> Column:
    """Array divided by a number, which is evaluated once: inside a lambda it would be for every element."""
    return F.zip_with(vector, F.array_repeat(by, F.size(vector)), lambda x, n: x.cast("double") / n)
