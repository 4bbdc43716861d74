"""Times written in mixed layouts to instants: a table-driven automaton over Arrow buffers, then votes.

All layouts are spelled out into one table of states. A batch's strings advance through it together,
a byte of each at a time; registers gather the numbers on the way, and the state that a string ends in
says which layout it had. Day and month of slashed dates are settled by source: stamps that fit one
order only vote, and stamps that fit both follow a clear majority. Votes are counted by source and one
of SALTS salts, so a source with most of the rows is spread over tasks, and come back by the same pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialise, small_batches

#: Tasks that the rows of one source may be dealt to.
SALTS = 256
#: A majority has over so many times the votes of the other order.
MAJORITY = 3

SPACES = "\t\n\x0b\x0c\r "
DIGITS = "0123456789"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
LAYOUTS = ("bad", "seconds", "millis", "dashed", "compact", "dotted", "named", "slashed")
#: Registers: first, second and third number of the date, hour, minute, second, half of the day (1 or 2),
#: offset's sign (1 or -1), hours and minutes; the first one takes what is not kept.
REGISTERS = ("none", "a", "b", "c", "hour", "minute", "second", "half", "sign", "off_hour", "off_minute")

# A step is (characters, register, value): a digit goes to the register's end, or the value is put there.
Step = tuple[str, str, int | None]


def _number(register: str, n: int) -> list[Step]:
    return [(DIGITS, register, None)] * n


def _mark(chars: str, register: str = "none", value: int | None = 0) -> list[Step]:
    return [(chars, register, value)]


def _times() -> list[list[Step]]:
    """Every form of what may follow a date."""
    clock = _mark("T ") + _number("hour", 2) + _mark(":") + _number("minute", 2)
    seconds = [[], _mark(":") + _number("second", 2)]
    halves = [[]] + [gap + _mark(c, "half", v) + _mark("M") for gap in ([], _mark(" ")) for c, v in (("A", 1), ("P", 2))]
    offsets = [[]]
    for gap in ([], _mark(" ")):
        offsets.append(gap + _mark("Z", "sign", 1))
        for (c, v), colon in itertools.product((("+", 1), ("-", -1)), ([], _mark(":"))):
            offsets.append(gap + _mark(c, "sign", v) + _number("off_hour", 2) + colon + _number("off_minute", 2))
    return [[]] + [clock + s + h + o for s, h, o in itertools.product(seconds, halves, offsets)]


def _forms() -> Iterator[tuple[str, list[Step]]]:
    """Layout and steps of every form; without the numbers that digits stand for there are few."""
    yield "seconds", _number("a", 10)
    yield "millis", _number("a", 13)
    names = [[s for c in name[:-1] for s in _mark(c)] + _mark(name[-1], "b", i + 1) for i, name in enumerate(MONTHS)]
    dates = [
        ("dashed", _number("a", 4) + _mark("-") + _number("b", 2) + _mark("-") + _number("c", 2)),
        ("compact", _number("a", 8)),
        ("dotted", _number("a", 2) + _mark(".") + _number("b", 2) + _mark(".") + _number("c", 4)),
        ("slashed", _number("a", 2) + _mark("/") + _number("b", 2) + _mark("/") + _number("c", 4)),
        *(("named", _number("a", 2) + _mark(" ") + name + _mark(" ") + _number("c", 4)) for name in names),
    ]
    for (layout, date), time in itertools.product(dates, _times()):
        yield layout, date + time


class Automaton:
    """``table[state, byte]``, and for each state the register that entering it changes, the value
    put there (or KEEP: the byte's digit is added), and the layout of strings that end in it.
    State 0 is the dead one, 1 the start. No form is endless, so neither is a walk."""

    KEEP = np.iinfo(np.int64).min

    def __init__(self, forms: Iterator[tuple[str, list[Step]]]):
        edges: list[dict[Step, int]] = [{}, {}]
        register, value, layout = [0, 0], [0, 0], [0, 0]
        for name, steps in forms:
            at = 1
            for step in steps:
                if step not in edges[at]:
                    edges[at][step] = len(edges)
                    edges.append({})
                    register.append(REGISTERS.index(step[1]))
                    value.append(self.KEEP if step[2] is None else step[2])
                    layout.append(0)
                at = edges[at][step]
            layout[at] = LAYOUTS.index(name)
        self.table = np.zeros((len(edges), 256), np.int32)
        for state, steps_of in enumerate(edges):
            for (chars, _, _), to in steps_of.items():
                codes = np.frombuffer(chars.encode(), np.uint8)
                assert not self.table[state, codes].any()  # one way for each byte
                self.table[state, codes] = to
        self.register, self.value, self.layout = np.array(register), np.array(value), np.array(layout, np.int8)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Layouts, and registers by row, of the strings data[start:end]; all advance together, and
        those that end or cannot fit any form stay behind."""
        n = len(starts)
        state, kept = np.ones(n, np.int32), np.zeros((len(REGISTERS), n), np.int64)
        live, step = np.flatnonzero(ends > starts), 0
        while len(live):
            byte = data[starts[live] + step]
            now = self.table[state[live], byte]
            state[live] = now
            on = now > 0
            live, now, byte = live[on], now[on], byte[on]
            r, v = self.register[now], self.value[now]
            kept[r, live] = np.where(v == self.KEEP, kept[r, live] * 10 + byte.astype(np.int64) - 48, v)
            step += 1
            live = live[starts[live] + step < ends[live]]
        return self.layout[state], kept


@cache
def automaton() -> Automaton:
    """The automaton of all layouts, made once a worker."""
    return Automaton(_forms())


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and whether there is such a day in the years 2000 to 2099."""
    fits = (year >= 2000) & (year <= 2099) & (month >= 1) & (month <= 12)
    months = np.where(fits, (year - 1970) * 12 + month - 1, 0)
    first, after = (m.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) for m in (months, months + 1))
    fits &= (day >= 1) & (day <= after - first)
    return first + day - 1, fits


def fields(raw: pa.Array) -> dict[str, np.ndarray]:
    """Per string, stripped of white space: ``kind`` (0 bad, 1 epoch, 2 plain, 3 for stamps that give a
    date in either order), ``us`` (the microseconds it shows, month first if in doubt; of the instant
    if ``fixed``), ``other`` (the same, day first), ``fixed`` (whether the instant is known without
    a zone), ``vote`` (1 day first, -1 month first)."""
    text = pc.utf8_trim(raw.cast(pa.large_string()), characters=SPACES)
    ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    layout, r = automaton().run(data, ends[:-1], ends[1:])
    layout = np.where(text.is_null().to_numpy(zero_copy_only=False), 0, layout)
    named = {k: r[i] for i, k in enumerate(REGISTERS)}
    a, b, c = named["a"], named["b"], named["c"]
    is_ = {k: layout == i for i, k in enumerate(LAYOUTS)}
    year = np.where(is_["dashed"], a, np.where(is_["compact"], a // 10_000, c))
    month = np.where(is_["compact"], a // 100 % 100, np.where(is_["slashed"], a, b))
    day = np.where(is_["dashed"], c, np.where(is_["compact"], a % 100, np.where(is_["slashed"], b, a)))
    days, fits = _days(year, month, day)
    turned, fits_turned = _days(year, day, month)
    fits_turned &= is_["slashed"]
    half, hour = named["half"], named["hour"]
    good = np.where(half > 0, (hour >= 1) & (hour <= 12), hour <= 23) & (named["minute"] <= 59) & (named["second"] <= 59)
    good &= (named["off_hour"] <= 14) & (named["off_minute"] <= 59)
    hour = np.where(half > 0, hour % 12 + 12 * (half == 2), hour)
    clock = (hour * 60 + named["minute"] - named["sign"] * (named["off_hour"] * 60 + named["off_minute"])) * 60 + named["second"]
    instant = lambda d: (d * 86_400 + clock) * 1_000_000
    epoch = is_["seconds"] | is_["millis"]
    dated = ~is_["bad"] & ~epoch & good & (fits | fits_turned)
    both = dated & fits & fits_turned & (days != turned)
    us = np.where(epoch, a * np.where(is_["seconds"], 1_000_000, 1_000), instant(np.where(fits, days, turned)))
    vote = np.where(dated & is_["slashed"] & (fits != fits_turned), np.where(fits, -1, 1), 0)
    return {
        "kind": np.where(epoch, 1, np.where(both, 3, np.where(dated, 2, 0))).astype(np.int8), "us": np.where(epoch | dated, us, 0),
        "other": np.where(both, instant(turned), 0), "fixed": epoch | (named["sign"] != 0), "vote": vote.astype(np.int8),
    }


def parse(stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw") -> DataFrame:
    """``(id, source, zone)`` and the columns of fields(), a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = fields(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, found.values())], ["id", "source", "zone", *found])

    rows = stamps.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(zone_col).alias("zone"), F.col(raw_col).cast("string").alias("raw"))
    id_, source, zone = (rows.schema[c].dataType.simpleString() for c in ("id", "source", "zone"))
    return rows.mapInArrow(run, f"id {id_}, source {source}, zone {zone}, kind tinyint, us long, other long, fixed boolean, vote tinyint")


def _known(spark: SparkSession, zone: Column) -> Column:
    """Whether Spark can read the zone: a name that Java has, or an offset."""
    names = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return F.coalesce(zone.isin(*names) | zone.rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$"), F.lit(False))


def _shown(us: Column, zone: Column) -> Column:
    """The wall clock of an instant, both in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def instants(rows: DataFrame) -> DataFrame:
    """rows with ``utc`` and ``doubtful``: wall times that their zone skips or repeats are read by the
    offset before the change, which is what Spark's own conversion does, and are doubtful."""
    us, zone = F.col("us"), F.col("zone")
    rows = rows.withColumn("utc", F.when(F.col("fixed"), us).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone))))
    day = 86_400 * 1_000_000
    later = us - (_shown(F.col("utc") + day, zone) - (F.col("utc") + day))  # as the offset a day later has it
    skipped = _shown(F.col("utc"), zone) != us
    repeated = (later != F.col("utc")) & (_shown(later, zone) == us)
    return rows.withColumn("doubtful", ~F.col("fixed") & (skipped | repeated))


def counted(parsed: DataFrame) -> DataFrame:
    """``(source, salt, day_first, month_first)``: the votes of a whole source beside each of its
    salts. Rows are counted by source and salt first; a source has SALTS such rows at most, so
    summing them up holds no more than that of one source at a time."""
    parts = parsed.groupBy("source", "salt").agg(*(F.count(F.when(F.col("vote") == v, 1)).alias(n) for v, n in ((1, "day_first"), (-1, "month_first"))))
    own = Window.partitionBy("source")
    return parts.select("source", "salt", *(F.sum(n).over(own).alias(n) for n in ("day_first", "month_first")))


def normalise(stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw", majority: int = MAJORITY) -> DataFrame:
    """Per row of stamps: ``(id_col, utc_us, rule, ambiguous)``.

    Null, empty, over-long and unreadable stamps are bad and have no instant; so is a date without an
    offset in a zone that is null or unknown, and none of them votes. Null sources are one source.
    Repeated rows each count and vote; rows with null ids are kept; an empty table gives an empty
    result; other columns play no part.
    """
    spark = stamps.sparkSession
    small_batches(spark)
    rows = parse(stamps, id_col, source_col, zone_col, raw_col)
    lost = ~F.col("fixed") & ~_known(spark, F.col("zone"))
    rows = rows.withColumn("kind", F.when(lost, F.lit(0)).otherwise(F.col("kind")).cast("tinyint")).withColumn("vote", F.when(lost, F.lit(0)).otherwise(F.col("vote")).cast("tinyint"))
    rows = materialise(rows.withColumn("salt", F.pmod(F.xxhash64("id", "us"), F.lit(SALTS)).cast("int")))
    votes = counted(rows.where("kind = 3 or vote <> 0"))
    votes = votes.select(F.col("source").alias("__source"), F.col("salt").alias("__salt"), "day_first", "month_first")
    # not by broadcast: votes grow with the sources
    open_ = rows.where("kind = 3").join(votes.hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("__source")) & (F.col("salt") == F.col("__salt")))
    day = F.col("day_first") > majority * F.col("month_first")
    month = F.col("month_first") > majority * F.col("day_first")
    settled = open_.select("id", "zone", "kind", "fixed", F.when(day, F.col("other")).otherwise(F.col("us")).alias("us"), F.when(day | month, "votes").otherwise("default").alias("rule"))
    rule = F.when(F.col("kind") == 0, "bad").when(F.col("kind") == 1, "epoch").otherwise("plain")
    rest = rows.where("kind <> 3").select("id", F.when(F.col("kind") == 0, None).otherwise(F.col("zone")).alias("zone"), "kind", "fixed", "us", rule.alias("rule"))
    out = instants(rest.unionByName(settled))
    bad = F.col("kind") == 0
    doubt = F.when(bad, F.lit(False)).otherwise(F.col("rule").isin("votes", "default") | F.coalesce("doubtful", F.lit(False)))
    return out.select(F.col("id").alias(id_col), F.when(~bad, F.col("utc")).alias("utc_us"), "rule", doubt.alias("ambiguous"))
