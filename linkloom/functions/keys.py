"""Keys: canonical form of paths, effective algorithm, blanks and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TENANT_HOST = "intranet.example"
LEGACY_HOST = "oldfarm.example"
DEFAULT_ALGO = "full-sha256"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """``""`` and null both stand for "none"."""
    return F.nullif(col(c), F.lit(""))


def ascii_lower(c: Column | str) -> Column:
    """Only A-Z change; other letters keep their case."""
    return F.translate(col(c), UPPER, LOWER)


def percent_decode(c: Column | str) -> Column:
    """Decodes every well-formed %XX as UTF-8; ``+`` and malformed escapes stay as they are."""
    c = col(c)
    whole = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(whole), c)).otherwise(c)


def strip_host(c: Column | str, host: str = TENANT_HOST) -> Column:
    """Removes scheme and tenant host; keys of other hosts stay whole."""
    return F.regexp_replace(col(c), r"^(?i)(?:https?:)?(?://)?" + host.replace(".", r"\.") + r"(?::\d+)?(?=/|$)", "")


def canonical_form(c: Column | str, host: str = TENANT_HOST) -> Column:
    """Tenant host removed, percent-decoded, ASCII lower case, no slash at the end."""
    return F.regexp_replace(ascii_lower(percent_decode(strip_host(c, host))), "/+$", "")


def effective_algo(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(DEFAULT_ALGO))


def clean_hash(c: Column | str) -> Column:
    """Hashes are hex and compared without regard to letter case; blank is none."""
    return F.lower(blank_to_null(c))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone: no detour over an instant."""
    t = col(c).cast("timestamp_ntz")
    day = F.unix_date(t.cast("date")).cast("long") * F.lit(86_400_000_000)
    within = (F.hour(t) * F.lit(3600) + F.minute(t) * F.lit(60)).cast("long") * F.lit(1_000_000)
    return day + within + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long")
