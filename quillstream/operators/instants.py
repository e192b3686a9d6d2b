"""Mixed timestamp texts to one UTC instant, and the zone of machines that do not state theirs.

Texts are parsed by built-in expressions only: one pattern per family turns a text into nine fields, which become local
microseconds and then an instant by offset, zone name, abbreviation or the zone of the record's machine. Unknown zones
are estimated by aligning wall-clock times with ingestion times: of all offset histories, the one with the fewest
violations (a record ingested before it was written), then the fewest late records.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import cut, settled

# Month names, and minutes east of UTC of the abbreviations that count.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mär": 3, "mrz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "okt": 10, "dezember": 12, "dez": 12,
}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "KST": 540,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_ZONE = r"\s*(Z|z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Z]{2,4}|[A-Za-z]+(?:/[A-Za-z_+\-]+)+)?(?:\[[A-Za-z_/+\-]+\])?"
_MONTH = r"([A-Za-zä]{3,9})\.?"
_DAY_NAME = r"(?:[A-Za-z]{2,10}\.?,?\s+)?"
#: (pattern, replacement): year | month | day | hour | minute | second | fraction | half of day | zone.
FAMILIES = [
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[Tt]|\s+)" + _CLOCK + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일\s*(오전|오후)?\s*" + _CLOCK + _ZONE + "$", "$1|$2|$3|$5|$6|$7|$8|$4|$9"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,12}))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _CLOCK + r"(?:\s*Uhr)?" + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("^" + _DAY_NAME + r"(\d{1,2})\.?\s+" + _MONTH + r"\s+(\d{4}),?\s+(?:um\s+|at\s+)?" + _CLOCK + r"(?:\s*Uhr)?\s*([AaPp][Mm])?" + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("^" + _DAY_NAME + _MONTH + r"\s+(\d{1,2}),\s*(\d{4}),?\s+(?:at\s+)?" + _CLOCK + r"\s*([AaPp][Mm])?" + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (r"^[A-Za-z]{3}\s+" + _MONTH + r"\s+(\d{1,2})\s+" + _CLOCK + r"(?:\s+([A-Z]{1,4}|[+-]\d{4}))?\s+(\d{4})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
]
EPOCH = r"^\d{9,17}(\.\d{1,12})?$"
PLAIN = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"


def zone_names() -> list[str]:
    """Zone names that this Python knows and Java resolves too."""
    return sorted(z for z in zoneinfo.available_timezones() if not z.startswith(("posix", "right", "Factory", "localtime", "SystemV")) and z not in ("EST5EDT", "CST6CDT", "MST7MDT", "PST8PDT", "ROC", "posixrules"))


def _lookup(of: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), key)


def parse_text(df: DataFrame, text: str, zone: str | None = None) -> DataFrame:
    """df with __local_us (wall clock as if UTC), __utc_us and __stated (offset, name, epoch, machine or null).

    zone: a column with the zone of the record's machine, used when the text names none. A local time that occurs
    twice is the earlier instant, a skipped one is read with the offset before the change. Null, blank, placeholder,
    impossible or partial texts give null in all three; so does a wall clock without a usable zone in __utc_us.
    Fractions finer than a microsecond are cut.
    """
    said = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    fields = F.lit(None).cast("string")
    for pattern, replacement in reversed(FAMILIES):
        fields = F.when(F.col("__said").rlike(pattern), F.regexp_replace("__said", pattern, replacement)).otherwise(fields)
    df = settled(settled(df, __said=said), __f=F.split(fields, r"\|", -1))
    part = lambda i: F.get("__f", F.lit(i))
    month = F.coalesce(part(1).try_cast("int"), _lookup(MONTHS, F.lower(part(1))))
    hour, minute, second = part(3).try_cast("int"), part(4).try_cast("int"), F.coalesce(F.when(part(5) != "", part(5)).try_cast("int"), F.lit(0))
    half = F.lower(part(7))
    late, early = half.isin("pm", "오후"), half.isin("am", "오전")
    hour = F.when((late | early) & (hour > 12), None).when(late & (hour < 12), hour + 12).when(early & (hour == 12), 0).otherwise(hour)
    fine = F.rpad(F.substring(F.coalesce(part(6), F.lit("")), 1, 6), 6, "0").try_cast("bigint")

    def local_us(month: Column, hour: Column) -> Column:
        day = F.concat_ws("-", part(0), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")).try_cast("date")
        return F.when((hour < 24) & (minute < 60) & (second < 60), F.unix_date(day).cast("long") * 86_400_000_000 + (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + fine)

    sign = F.when(F.col("__z").contains("-"), -1).otherwise(1)
    digits = F.regexp_replace("__z", "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    offset = F.when(F.col("__z").rlike(r"^(UTC|GMT)?[+-]\d"), F.when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))).otherwise(_lookup(ABBREVIATIONS, F.upper("__z")))
    number = F.when(F.col("__said").rlike(EPOCH), F.substring_index("__said", ".", 1).try_cast("bigint"))
    tail = F.rpad(F.substring(F.regexp_extract("__said", r"\.(\d+)$", 1), 1, 6), 6, "0").try_cast("bigint")
    epoch = F.when(number < 100_000_000_000, number * 1_000_000 + tail).when(number < 100_000_000_000_000, number * 1000 + F.floor(tail / 1000)).otherwise(number)
    df = settled(df, __mon=month, __hour=hour, __z=F.coalesce(part(8), F.lit("")), __epoch=epoch)
    month, hour = F.col("__mon"), F.col("__hour")
    df = settled(df, __local_us=local_us(month, hour), __off=offset, __name=F.when(F.col("__z").contains("/"), F.when(F.col("__z").isin(zone_names()), F.col("__z"))))
    home = F.col(zone) if zone else F.lit(None).cast("string")
    zoned = lambda z: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__local_us"), z))
    stated = (
        F.when(F.col("__epoch").isNotNull(), "epoch")
        .when(F.col("__local_us").isNull(), None)
        .when(F.col("__off").isNotNull(), "offset")
        .when(F.col("__name").isNotNull(), "name")
        .when((F.col("__z") == "") & home.isNotNull(), "machine")
        .when(F.col("__z") == "", "wall")
    )
    df = settled(df, __stated=stated)
    utc = (
        F.when(F.col("__stated") == "epoch", F.col("__epoch"))
        .when(F.col("__stated") == "offset", F.col("__local_us") - F.col("__off").cast("long") * 60_000_000)
        .when(F.col("__stated") == "name", zoned(F.col("__name")))
        .when(F.col("__stated") == "machine", zoned(home))
    )
    return df.withColumn("__utc_us", utc).drop("__said", "__f", "__z", "__off", "__name", "__epoch", "__mon", "__hour")


def estimate_zones(observed: DataFrame, machine: str, local_us: str, ingested_us: str, zones: list[str], prompt_us: int = 1_800_000_000) -> DataFrame:
    """machine, zone, n, violations, late: the offset history of each machine that fits its ingestion times best.

    Wall-clock times are first counted per machine, hour and quarter-hour of lag, so a machine that holds most rows is
    a few rows before the shuffle; each count is then read under every candidate zone. A record ingested before it was
    written is a violation, one ingested more than prompt_us later is late. The zone with the least 2 x violations +
    late wins, of equal ones that with the shortest waits, then the first name; zones with equal offsets over the data are not told apart. Rows with a null
    in any of the three columns are left out; a machine without rows has no estimate.
    """
    quarter = 900_000_000
    counts = (
        observed.where(F.col(machine).isNotNull() & F.col(local_us).isNotNull() & F.col(ingested_us).isNotNull())
        .select(F.col(machine).alias("machine"), F.floor(F.col(local_us) / 3_600_000_000).alias("h"), F.floor((F.col(ingested_us) - F.col(local_us)) / quarter).alias("lag"))
        .groupBy("machine", "h", "lag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = F.timestamp_micros((F.col("h") * 3_600_000_000).cast("long"))
    read = counts.withColumn("zone", F.explode(F.array(*(F.lit(z) for z in zones))))
    shift = F.floor((F.unix_micros(at) - F.unix_micros(F.to_utc_timestamp(at, F.col("zone")))) / quarter)
    fit = (
        read.withColumn("delay", F.col("lag") + shift)
        .groupBy("machine", "zone")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("delay") < 0, F.col("n")).otherwise(0)).alias("violations"),
            F.sum(F.when(F.col("delay") * quarter >= prompt_us, F.col("n")).otherwise(0)).alias("late"),
            F.sum(F.when((F.col("delay") >= 0) & (F.col("delay") * quarter < prompt_us), F.col("n") * F.col("delay")).otherwise(0)).alias("wait"),
        )
    )
    best = Window.partitionBy("machine").orderBy(2 * F.col("violations") + F.col("late"), "wait", "zone")
    return fit.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "wait")


def normalise(df: DataFrame, text: str, machine: str, machines: DataFrame, estimate_from: str | None = None, zones: list[str] | None = None, guesses: DataFrame | None = None) -> DataFrame:
    """df with utc_us and zone_source (epoch, offset, name, machine, estimated, or null when the text states no instant).

    machines: machine, zone. With estimate_from (a timestamp column with the time of ingestion) wall clocks of machines
    without a zone are read under the zone estimated for them, or under that of guesses (machine, zone) if these are
    given; otherwise they stay null. Columns utc_us and zone_source
    of df are replaced; a machine listed twice counts once.
    """
    known = machines.groupBy(F.col("machine").alias("__m")).agg(F.max("zone").alias("__zone"))
    parsed = parse_text(df.join(known, F.col(machine) == F.col("__m"), "left"), text, "__zone")
    if estimate_from and guesses is None:
        wall = parsed.where("__stated = 'wall'").select(F.col(machine).alias("m"), "__local_us", F.unix_micros(F.col(estimate_from)).alias("__ing"))
        guesses = estimate_zones(wall, "m", "__local_us", "__ing", zones or zones_of(wall, "__local_us"))
    if guesses is not None:
        guess = guesses.select(F.col("machine").alias("__g"), F.col("zone").alias("__guess"))
        parsed = parsed.join(guess, F.col(machine) == F.col("__g"), "left")
        open_ = (F.col("__stated") == "wall") & F.col("__guess").isNotNull()
        parsed = parsed.withColumns(
            {
                "__utc_us": F.when(open_, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__local_us"), F.col("__guess")))).otherwise(F.col("__utc_us")),
                "__stated": F.when(open_, "estimated").otherwise(F.col("__stated")),
            }
        ).drop("__g", "__guess")
    source = F.when(F.col("__utc_us").isNotNull(), F.col("__stated"))
    return parsed.withColumns({"utc_us": F.col("__utc_us"), "zone_source": source}).drop("__m", "__zone", "__local_us", "__utc_us", "__stated")


def candidate_zones(first_year: int = 2023, last_year: int = 2026) -> list[str]:
    """One zone for each offset history over the years given (start, middle and end of each month) among the named zones."""
    import datetime as dt

    days = [dt.datetime(y, m, d, 12, tzinfo=dt.timezone.utc) for y in range(first_year, last_year + 1) for m in range(1, 13) for d in (1, 15, 28)]
    first: dict[tuple, str] = {}
    for name in zone_names():
        if "/" in name and not name.startswith("Etc/"):
            zone = zoneinfo.ZoneInfo(name)
            first.setdefault(tuple(d.astimezone(zone).utcoffset() for d in days), name)
    return sorted(first.values())


def zones_of(wall: DataFrame, local_us: str) -> list[str]:
    """The candidate zones of wall-clock times: those that the years of the data tell apart (200 years at most)."""
    year = F.year(F.timestamp_micros(local_us))
    span = wall.agg(F.min(year).alias("a"), F.max(year).alias("b")).first()
    return candidate_zones() if span.a is None else candidate_zones(max(1850, span.a), min(span.b, max(1850, span.a) + 200, 2100))


def unusual_instants(turns: DataFrame, cursors: DataFrame, machines: DataFrame) -> DataFrame:
    """tab, rec_id, utc_us of every text that states an instant in another form than yyyy-MM-ddTHH:mm:ssZ."""
    parts = []
    for tab, df, key, text in (("turns", turns, "turn_id", "timestamp"), ("harvest_cursors", cursors, "cursor_id", "last_scan")):
        own = df.select(F.col(key).alias("rec_id"), F.col(text).alias("text"), F.col("machine").alias("own_machine")).where(F.col("text").isNotNull() & ~F.col("text").rlike(PLAIN))
        parts.append(normalise(own, "text", "own_machine", machines).where("utc_us is not null").select(F.lit(tab).alias("tab"), "rec_id", "utc_us"))
    return parts[0].unionByName(parts[1]).distinct()


def normalised_tables(turns: DataFrame, cursors: DataFrame, machines: DataFrame) -> DataFrame:
    """tab, rec_id, utc_us, zone_source of every turn and cursor.

    Zones are estimated from the turns, as cursors have no time of ingestion, and used for both; a cursor's wall clock
    stays null where its machine has neither a zone nor an estimate.
    """
    known = machines.where("zone is not null").select(F.col("machine").alias("__k"))
    wall = parse_text(turns.select("timestamp", "machine", "ingested_at"), "timestamp").where("__stated = 'wall'").join(known, F.col("machine") == F.col("__k"), "left_anti")
    guesses = cut(estimate_zones(wall.withColumn("__ing", F.unix_micros("ingested_at")), "machine", "__local_us", "__ing", zones_of(wall, "__local_us")).select("machine", "zone"))
    parts = []
    for tab, df, key, text in (("turns", turns, "turn_id", "timestamp"), ("harvest_cursors", cursors, "cursor_id", "last_scan")):
        own = df.select(F.col(key).alias("rec_id"), F.col(text).alias("text"), F.col("machine").alias("own_machine"))
        parts.append(normalise(own, "text", "own_machine", machines, guesses=guesses).select(F.lit(tab).alias("tab"), "rec_id", "utc_us", "zone_source"))
    return parts[0].unionByName(parts[1]).distinct()
