"""Column expressions. All are built from Spark functions and stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# These constants and labels appear in results and must not change.
EARTH_RADIUS_KM = 6371
RADIANS_PER_DEGREE = 0.0174533
NEAR = "1. Near (<100km)"
MEDIUM = "2. Medium (100-500km)"
FAR = "3. Far (>500km)"
DELAYED = "Delayed"
ON_TIME = "On-Time (0-5 days early)"
EARLY = "Early (5+ days early)"
ROUTE_ARROW = " -> "

SECONDS_PER_DAY = 86400


def delay_seconds(actual: str | Column, expected: str | Column) -> Column:
    """``actual - expected`` in seconds, exact to the microsecond; negative when early."""
    expected = F.col(expected) if isinstance(expected, str) else expected
    actual = F.col(actual) if isinstance(actual, str) else actual
    return (actual - expected).cast("interval second").cast("decimal(18,6)")


def delay_days(actual: str | Column, expected: str | Column) -> Column:
    """``actual - expected`` in days with the fraction of the day."""
    return delay_seconds(actual, expected).cast("double") / SECONDS_PER_DAY


def rounded_delay(actual: str | Column, expected: str | Column) -> Column:
    """:func:`delay_days` rounded half up to a tenth of a day."""
    tenths = delay_seconds(actual, expected).cast("double") / (SECONDS_PER_DAY // 10)
    return _half_up(tenths) / 10


def _half_up(value: Column) -> Column:
    """Nearest whole number. On whole tables this is several times faster than ``F.round``, which
    goes through decimal text, and unlike ``F.rint`` it takes halves away from zero."""
    return F.when(value < 0, -F.floor(0.5 - value)).otherwise(F.floor(value + 0.5))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres between two points given in degrees.

    The half-chord term is kept within [0, 1], so rounding never turns antipodal points into NaN.
    """
    half = F.lit(RADIANS_PER_DEGREE) / 2
    sin_lat = F.sin((lat2 - lat1) * half)
    sin_lng = F.sin((lng2 - lng1) * half)
    cosines = F.cos(lat1 * RADIANS_PER_DEGREE) * F.cos(lat2 * RADIANS_PER_DEGREE)
    chord = sin_lat * sin_lat + cosines * sin_lng * sin_lng
    # least/greatest skip NULL and rank NaN highest; an unknown position has no distance.
    known = chord.isNotNull() & ~F.isnan(chord)
    chord = F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord)))
    return F.atan2(F.sqrt(chord), F.sqrt(1 - chord)) * (2 * EARTH_RADIUS_KM)


def rounded_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """:func:`haversine_km` rounded to a tenth."""
    return _half_up(haversine_km(lat1, lng1, lat2, lng2) * 10) / 10


def distance_band(km: str | Column) -> Column:
    """Near, medium (100 and 500 included) or far; an unknown distance counts as far."""
    km = F.col(km) if isinstance(km, str) else km
    return F.when(km < 100, NEAR).when(km.between(100, 500), MEDIUM).otherwise(FAR)


def delay_category(days: str | Column) -> Column:
    """Late, at most five days early, or earlier; an unknown delay counts as early."""
    days = F.col(days) if isinstance(days, str) else days
    return F.when(days > 0, DELAYED).when(days.between(-5, 0), ON_TIME).otherwise(EARLY)


def amount(value: str | Column) -> Column:
    """A number with ten places, as an exact decimal. :func:`limbs` are the faster way to a sum.

    What is no number, NaN and infinities among it, or has more than 18 digits before the point, is
    NULL.
    """
    value = F.col(value) if isinstance(value, str) else value
    return value.try_cast("decimal(28,10)")


# The limbs of an amount: its whole part in millions and below, its ten places in five and five.
_LIMBS = 4
_MILLION, _FIVE_PLACES = 10**6, 10**5


def _limb_text(column: str) -> list[str]:
    """SQL of :func:`limbs`. All parts keep the sign, as whole numbers are cut towards zero."""
    number = f"try_cast({column} as double)"
    # A double below 10^5 holds ten places of the decimal it was written as. NaN is above any number.
    small = f"abs({number}) < 1e5D"
    half = f"if({number} < 0, -0.5D, 0.5D)"
    places = f"cast(({number} - cast({number} as bigint)) * 1e10D + {half} as bigint)"
    decimal = f"try_cast({column} as decimal(28,10))"
    exact_whole = f"cast({decimal} as bigint)"
    exact_places = f"cast(({decimal} - {exact_whole}) * 10000000000BD as bigint)"
    return [
        f"if({small}, 0L, {exact_whole} div {_MILLION})",
        f"if({small}, cast({number} as bigint), {exact_whole} % {_MILLION})",
        f"if({small}, {places}, {exact_places}) div {_FIVE_PLACES}",
        f"if({small}, {places}, {exact_places}) % {_FIVE_PLACES}",
    ]


def limbs(column: str) -> list[Column]:
    """:func:`amount` of a column as four whole numbers with its sign, all NULL where it is NULL.

    Sums of whole numbers are the same in any order. Numbers below 10^5, which most amounts are, need
    no decimal at all; larger ones go through one.
    """
    return [F.expr(text) for text in _limb_text(column)]


def limb_names(name: str) -> list[str]:
    return [f"{name}_{i}" for i in range(_LIMBS)]


def limb_sums(column: str, name: str) -> list[Column]:
    """Aggregates: the sums of the limbs of ``column``, as :func:`limb_names` of ``name``."""
    return [F.sum(limb).alias(total) for limb, total in zip(limbs(column), limb_names(name))]


def merged_limbs(name: str) -> list[Column]:
    """Aggregates: sums of :func:`limb_sums`, under the same names."""
    return [F.sum(column).alias(column) for column in limb_names(name)]


def joined_limbs(sums: Sequence[Column]) -> Column:
    """The decimal with ten places that the sums of the limbs stand for."""
    millions, ones, first, last = (s.cast("decimal(20,0)") for s in sums)
    whole = (millions * Decimal(_MILLION) + ones).cast("decimal(27,0)")
    places = first * Decimal("0.00001") + last * Decimal("0.0000000001")
    return whole + places.cast("decimal(36,10)")


def exact_sum(column: str) -> Column:
    """Aggregate: sum of :func:`amount`."""
    return joined_limbs([F.sum(limb) for limb in limbs(column)])


def exact_mean(column: str) -> Column:
    """Aggregate: mean of :func:`amount` as a double; NULL values do not count."""
    return F.try_divide(exact_sum(column).cast("double"), F.count(limbs(column)[0]))


def percent_of(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as a double; NULL when ``whole`` is 0."""
    return F.try_divide(100.0 * part, whole)


def month_index(day: str | Column) -> Column:
    """Months since January 2000 as a whole number."""
    return ((F.year(day) - 2000) * 12 + F.month(day) - 1).cast("int")


_MANTISSA = 2.0**52


def _double_order(value: Column) -> Column:
    """The bits of a double as a whole number that sorts like it; NaN last, and -0.0 equal to 0.0.

    Worked out by arithmetic that is exact for powers of two, so it stays in generated code.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + (size >= power * 2).cast("int") - (size < power).cast("int")
    fraction = size / F.pow(F.lit(2.0), exponent) - 1
    bits = (exponent + 1023).cast("long") * int(_MANTISSA) + (fraction * _MANTISSA).cast("long")
    # Below 2^-1022 the exponent no longer falls; 2^1074 is too large for a double, so in two steps.
    tiny = (size * 2.0**600 * 2.0**474).cast("long")
    magnitude = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit(2047 * 2**52))
        .when(size < 2.0**-1022, tiny)
        .otherwise(bits)
    )
    return (
        F.when(F.isnan(value), F.lit(2**63 - 1))
        .when(value < 0, -magnitude)
        .when(value.isNotNull(), magnitude)
    )


def order_key(column: str, kind: T.DataType) -> Column:
    """A long that sorts like ``column`` of type ``kind``, one for each value; NULL stays NULL."""
    value = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double_order(value.cast("double"))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * Decimal(10**kind.scale)).cast("long")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("int").cast("long") if isinstance(kind, T.BooleanType) else value.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        since = (value - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second")
        return (since.cast("decimal(18,6)") * Decimal(10**6)).cast("long")
    raise ValueError(f"{column} is {kind.simpleString()}, which has no order key")


# The finest zoom level whose two coordinates fit side by side into one long.
FINEST_ZOOM = 30


def tile_steps(degrees: str | Column, span: int, zoom: int) -> Column:
    """Which of the ``2^zoom`` equal steps of a coordinate from -span to span holds ``degrees``.

    The last step includes its end. NULL for what is no position.
    """
    degrees = F.col(degrees) if isinstance(degrees, str) else degrees
    step = F.floor((degrees + span) / (2 * span) * 2.0**zoom)
    return F.when(degrees.between(-span, span), F.least(step, F.lit(2**zoom - 1)).cast("long"))


def _spread(number: Column) -> Column:
    """The bits of a number below 2^32, each with a zero above it."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        number = number.bitwiseOR(F.shiftleft(number, shift)).bitwiseAND(F.lit(mask))
    return number


def tile_key(lat: str | Column, lng: str | Column, zoom: int) -> Column:
    """The tile of a position: bits of its latitude and longitude in turn, the coarsest first.

    Without its two lowest bits it is the key of the tile one level up, and tiles that lie together
    mostly have keys that do. NULL for what is no position.
    """
    if not 0 <= zoom <= FINEST_ZOOM:
        raise ValueError(f"zoom is 0 to {FINEST_ZOOM}")
    north, east = tile_steps(lat, 90, zoom), tile_steps(lng, 180, zoom)
    return F.shiftleft(_spread(north), 1).bitwiseOR(_spread(east))
