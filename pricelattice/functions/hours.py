"""Opening hours: both stored shapes to one, and the status at a moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
SLOT = "array<struct<open:string,close:string>>"
#: Abbreviations of the days in schema.org text, and longer names in four languages by prefix.
WEEK = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DAY_PREFIXES = (("mon", "mo|lu|maa"), ("tue", "tu|di(?!m)|mar"), ("wed", "we|mi|mer|woe"), ("thu", "th|do|jeu"), ("fri", "fr|ven|vr"), ("sat", "sa|zat"), ("sun", "su|so|dim|zon"))


def slots(raw: Column) -> Column:
    """One day's JSON, ["11:00","22:30"] or a list of such pairs, to slots; what is no pair is dropped."""
    pair = lambda p: F.struct(F.try_element_at(p, F.lit(1)).alias("open"), F.try_element_at(p, F.lit(2)).alias("close"))
    single = F.from_json(raw, "array<string>")
    many = F.filter(F.from_json(raw, "array<array<string>>"), lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    one = F.when(F.size(single) == 2, F.array(pair(single))).otherwise(F.array().cast(SLOT))
    return F.when(raw.rlike(r'^\s*\[\s*"'), one).otherwise(F.coalesce(F.transform(many, pair), F.array().cast(SLOT)))


def canonical(hours_json: Column) -> Column:
    """A JSON object of days to map<day, slots>."""
    return F.transform_values(F.from_json(hours_json, "map<string,string>"), lambda _, v: slots(v))


def minutes(hhmm: Column) -> Column:
    return F.split(hhmm, ":")[0].cast("int") * 60 + F.split(hhmm, ":")[1].cast("int")


def open_status(hours: Column, at: Column) -> Column:
    """struct(status, closes_at, opens_at): a slot that closes before it opens crosses midnight."""
    day = F.dayofweek(at) - 1
    now = F.hour(at) * 60 + F.minute(at)
    of = lambda d: F.coalesce(F.try_element_at(hours, F.element_at(F.array(*[F.lit(x) for x in DAYS]), (d % 7 + 1).cast("int"))), F.array().cast(SLOT))
    today = of(day)

    def is_open(s):
        a, b = minutes(s["open"]), minutes(s["close"])
        return F.when(b < a, (now >= a) | (now < b)).otherwise((now >= a) & (now < b))

    def later(s):
        a, b = minutes(s["open"]), minutes(s["close"])
        return F.when(b < a, (now >= b) & (now < a)).otherwise(now < a)

    running = F.filter(today, is_open)
    upcoming = F.transform(F.filter(today, later), lambda s: F.struct(minutes(s["open"]).alias("m"), s["open"].alias("open")))
    days = [F.when(F.size(of(day + k)) > 0, F.concat(F.lit("tomorrow " if k == 1 else ""), of(day + k)[0]["open"])) for k in range(1, 8)]
    opens = F.coalesce(F.array_min(upcoming)["open"], *days)
    return (
        F.when(hours.isNull(), F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("closes_at"), F.lit(None).cast("string").alias("opens_at")))
        .when(F.size(running) > 0, F.struct(F.lit("open").alias("status"), F.try_element_at(running, F.lit(1))["close"].alias("closes_at"), F.lit(None).cast("string").alias("opens_at")))
        .otherwise(F.struct(F.lit("closed").alias("status"), F.lit(None).cast("string").alias("closes_at"), opens.alias("opens_at")))
    )


def closed_rank(status: Column) -> Column:
    """Sort key: open first, then by the next opening today, tomorrow, later; unknown last."""
    opens = status["opens_at"]
    clock = F.regexp_extract(opens, r"(\d{1,2}:\d{2})", 1)
    return F.when(status["status"] == "open", 0).when(opens.isNull(), 100_000).when(opens.startswith("tomorrow"), 10_000 + minutes(clock)).otherwise(1 + minutes(clock))


def day_of(word: Column) -> Column:
    low = F.lower(F.trim(word))
    return F.coalesce(*[F.when(low.rlike(f"^(?:{p})"), F.lit(d)) for d, p in DAY_PREFIXES])


def span_days(first: Column, last: Column) -> Column:
    """Days from first to last, past the end of the week if need be."""
    week = F.array(*[F.lit(d) for d in WEEK])
    a, b = F.array_position(week, first).cast("int") - 1, F.array_position(week, last).cast("int") - 1
    return F.transform(F.sequence(a, F.when(b < a, b + 7).otherwise(b)), lambda k: F.element_at(week, (k % 7 + 1).cast("int")))


def from_minutes(m: Column) -> Column:
    return F.format_string("%02d:%02d", (F.floor(m / 60) % 24).cast("int"), (m % 60).cast("int"))


def schema_text(text: Column) -> Column:
    """Lines like "Mo-Fr 11:00-22:00" to an array of struct(day, open, close)."""
    found = F.regexp_extract_all(text, F.lit(r"(\p{L}+(?:\s*-\s*\p{L}+)?\s+\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2})"), 1)

    def one(line):
        a, b = day_of(F.regexp_extract(line, r"^(\p{L}+)", 1)), day_of(F.regexp_extract(line, r"^\p{L}+\s*-\s*(\p{L}+)", 1))
        start, end = F.regexp_extract(line, r"(\d{1,2}:\d{2})\s*-", 1), F.regexp_extract(line, r"-\s*(\d{1,2}:\d{2})$", 1)
        return F.transform(span_days(a, F.coalesce(b, a)), lambda d: F.struct(d.alias("day"), F.lpad(start, 5, "0").alias("open"), F.lpad(end, 5, "0").alias("close")))

    return F.flatten(F.transform(F.filter(found, lambda x: day_of(x).isNotNull()), one))


def section_hours(ranges: Column) -> Column:
    """array<struct(dayRange, sectionHours: array<struct(startTime, endTime)>)>, minutes since midnight, to struct(day, open, close)."""

    def one(r):
        parts = F.split(r["dayRange"], " - ")
        a, b = day_of(parts[0]), day_of(F.try_element_at(parts, F.lit(2)))
        known = a.isNotNull() & ((F.size(parts) == 1) | b.isNotNull())
        slot = F.filter(r["sectionHours"], lambda s: s["startTime"].isNotNull() & s["endTime"].isNotNull())
        days = F.when(known, span_days(F.coalesce(a, F.lit("mon")), F.coalesce(b, a, F.lit("mon")))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(days, lambda d: F.transform(slot, lambda s: F.struct(d.alias("day"), from_minutes(s["startTime"]).alias("open"), from_minutes(s["endTime"]).alias("close")))))

    return F.flatten(F.transform(ranges, one))


def regular_hours(slots_: Column) -> Column:
    """Slots whose fields go by several names to struct(day, open, close)."""
    first = lambda s, names: F.coalesce(*[F.nullif(s[n], F.lit("")) for n in names])
    out = F.transform(slots_, lambda s: F.struct(day_of(first(s, ("dayOfWeek", "day"))).alias("day"), F.substring(first(s, ("startTime", "open", "from")), 1, 5).alias("open"), F.substring(first(s, ("endTime", "close", "to")), 1, 5).alias("close")))
    return F.filter(out, lambda s: s["day"].isNotNull() & s["open"].isNotNull() & s["close"].isNotNull())


def by_day(slots_: Column) -> Column:
    """struct(day, open, close) to map<day, slots>."""
    of = lambda d: F.transform(F.filter(slots_, lambda s: s["day"] == d), lambda s: F.struct(s["open"].alias("open"), s["close"].alias("close")))
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(d) for d in WEEK]), F.array(*[of(F.lit(d)) for d in WEEK])), lambda _, v: F.size(v) > 0)


def freshness(age_minutes: Column) -> Column:
    """How old a reading is, in words."""
    return F.when(age_minutes < 90, "fresh").when(age_minutes < 180, "recent").otherwise("old")
