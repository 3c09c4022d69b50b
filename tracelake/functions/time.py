"""Timestamps as agents write them, to Unix milliseconds, in integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.json import let

_SHAPE = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2}))?(?:[.,](\d*))?(?:[Zz].*|([+-])(.*))?$"
#: All groups of a match, the one with free text last.
_PARTS = "|".join(f"${k}" for k in range(1, 10))
#: White space at both ends, beyond blanks alone.
_ENDS = r"^\s+|\s+$"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends; ``trim`` strips blanks only."""
    return F.regexp_replace(text, _ENDS, "")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; days past a month's end run over."""
    months = y * 12 + m - 3  # counted from March, so that a leap day ends the year
    year, month = F.floor(months / 12).cast("long"), F.pmod(months, F.lit(12))
    leap = F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)
    return (year * 365 + leap + F.floor((month * 306 + 5) / 10) + d - 1 - 719468).cast("long")


def unix_ms(raw: Column) -> Column:
    """Milliseconds of ``YYYY-MM-DDTHH:MM[:SS[.fraction]][zone]``; null for anything else.

    The separator may be t or a blank, the fraction's mark a comma; digits past the third are cut. Zones are
    Z, +HH, +HHMM or +HH:MM; none means UTC. Second 60 and day 31 of any month are taken as they stand.
    """
    # one match for all parts, each bound once: written out, the expression would outgrow a compiled method
    return let(trimmed(raw), lambda t: let(F.when(t.rlike(_SHAPE), F.split(F.regexp_replace(t, _SHAPE, _PARTS), r"\|", 9)), _from_parts))


def _from_parts(parts: Column) -> Column:
    part = lambda k: F.get(parts, F.lit(k - 1))
    number = lambda k: F.when(part(k) != "", part(k).cast("long"))
    month, day, hour, minute, second = number(2), number(3), number(4), number(5), F.coalesce(number(6), F.lit(0))
    millis = F.rpad(part(7), 3, "0").cast("long")
    zone = F.regexp_replace(part(9), "[^0-9]", "")
    minutes = F.when(part(8) == "", 0).when(F.length(zone) == 2, zone.cast("long") * 60).when(F.length(zone) == 4, F.substring(zone, 1, 2).cast("long") * 60 + F.substring(zone, 3, 2).cast("long"))
    minutes = F.when(part(8) == "-", -minutes).otherwise(minutes)
    ok = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    seconds = days_from_civil(number(1), month, day) * 86400 + hour * 3600 + minute * 60 + second - minutes * 60
    return F.when(ok, seconds * 1000 + millis)
