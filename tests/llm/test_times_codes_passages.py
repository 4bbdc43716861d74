"""Timestamps, vector codes and repeated passages against brute force, and odd rows."""

import hashlib
import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import substring_dedup, timestamps, vector_codes

STAMPS = "stamp_id long, source string, zone string, raw string, id string, kind string, us string, salt string, utc string"
VECTORS = "vec_id long, embedding array<float>, label int, row string, q string, code string, error string"
DOCS = "doc_id long, text string, id string, k string, starts string, n_words string"


# timestamps

EPOCH = datetime(1970, 1, 1)
MONTHS = {m: i + 1 for i, m in enumerate(timestamps.MONTHS)}
TIME = r"(?:[T ](?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<ap>[AP])M)?(?: ?(?:(?P<z>Z)|(?P<sg>[+-])(?P<oh>\d\d):?(?P<om>\d\d)))?)?"
DATES = [r"(?P<y>20\d\d)-(?P<m>\d\d)-(?P<d>\d\d)", r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)", r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>20\d\d)", r"(?P<d>\d\d) (?P<b>[A-Z][a-z][a-z]) (?P<y>20\d\d)", r"(?P<p>\d\d)/(?P<r>\d\d)/(?P<y>20\d\d)"]


def wall_of(y, m, d, h, mi, s):
    try:
        return datetime(int(y), int(m), int(d), h, mi, s)
    except ValueError:
        return None


def read(raw):
    """Kind, walls (month first, day first), offset in minutes or None, by regular expressions."""
    x = (raw or "").strip("\t\n\x0b\x0c\r ")
    if re.fullmatch(r"[0-9]{10}|[0-9]{13}", x):
        return "epoch", int(x) * (10**6 if len(x) == 10 else 1000), None, None
    m = next((m for p in DATES if (m := re.fullmatch(p + TIME, x, re.ASCII))), None)
    if not m:
        return None
    g = m.groupdict()
    h, mi, s = (int(g[k] or 0) for k in ("h", "mi", "s"))
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"] == "P")
    off = 0 if g["z"] else None
    if g["sg"]:
        if int(g["oh"]) > 14 or int(g["om"]) > 59:
            return None
        off = (int(g["oh"]) * 60 + int(g["om"])) * (-1 if g["sg"] == "-" else 1)
    if g.get("p"):
        one, two = wall_of(g["y"], g["p"], g["r"], h, mi, s), wall_of(g["y"], g["r"], g["p"], h, mi, s)
        return ("slashed", one, two, off) if one or two else None
    month = MONTHS.get(g["b"], 0) if g.get("b") else g["m"]
    one = wall_of(g["y"], month, g["d"], h, mi, s)
    return ("plain", one, None, off) if one else None


def brute(rows):
    found = {i: read(raw) for i, _, _, raw in rows}
    votes = {}
    for i, source, _, _ in rows:
        f = found[i]
        if f and f[0] == "slashed" and not (f[1] and f[2]):
            votes.setdefault(source, Counter())["d" if f[2] else "m"] += 1
    out = {}
    for i, source, zone, _ in rows:
        f = found[i]
        if f is None:
            out[i] = (None, "bad", False)
            continue
        if f[0] == "epoch":
            out[i] = (f[1], "epoch", False)
            continue
        _, wall, other, off = f
        v, rule = votes.get(source, Counter()), "plain"
        if wall and other and wall != other:
            rule = "votes" if v["d"] > 3 * v["m"] or v["m"] > 3 * v["d"] else "default"
            wall = other if v["d"] > 3 * v["m"] else wall
        wall = wall or other
        if off is not None:
            out[i] = ((wall - EPOCH) // timedelta(microseconds=1) - off * 60 * 10**6, rule, rule != "plain")
            continue
        a, b = (wall.replace(tzinfo=ZoneInfo(zone), fold=k).utcoffset() for k in (0, 1))
        utc = wall - a
        out[i] = ((utc - EPOCH) // timedelta(microseconds=1), rule, rule != "plain" or a != b)
    return out


def odd_stamps(n, seed):
    rng = random.Random(seed)
    two = lambda lo, hi: f"{rng.randint(lo, hi):02d}"
    rows = []
    for i in range(n):
        y, m, d = f"20{two(0, 99)}", two(0, 13), two(0, 32)
        b = rng.choice([*timestamps.MONTHS, "jan", "Foo"])
        source = rng.choice(["a", "a", "a", "b", "c", None])
        turned = f"{d}/{m}/{y}" if source == "c" else f"{m}/{d}/{y}"
        date = rng.choice([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{d}.{m}.{y}", f"{d} {b} {y}", f"{d}/{m}/{y}", turned, f"{two(1, 12)}/{two(1, 12)}/{y}"])
        time = rng.choice(["", f"{rng.choice('T _')}{two(0, 25)}:{two(0, 61)}" + rng.choice(["", f":{two(0, 61)}"]) + rng.choice(["", "AM", " PM", " pm", "PM"]) + rng.choice(["", "Z", " Z", f" +{two(0, 15)}:{two(0, 61)}", f"-{two(0, 14)}{two(0, 60)}", "z"])])
        raw = rng.choice([date + time] * 8 + [f" {date}{time}\t\n", str(rng.randrange(10**10)).zfill(10), str(rng.randrange(10**13)).zfill(13), "1" * 11, "x", "", None])
        if rng.random() < 0.1:  # clock changes
            raw = rng.choice(["2024-03-10 02:30", "2024-11-03 01:30", "31.03.2024 02:00:00", "27 Oct 2024 02:59", "20241103 00:59:59", "2024-10-27T03:00"])
        rows.append((i, source, rng.choice(["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe"]), raw))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_timestamps_against_regular_expressions(spark, seed):
    rows = odd_stamps(1500, seed)
    got = timestamps.normalise(spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], STAMPS)).collect()
    want = brute(rows)
    assert {r["stamp_id"]: tuple(r)[1:] for r in got} == want
    assert {v[1] for v in want.values()} == {"bad", "epoch", "plain", "votes", "default"} or seed


def test_timestamps_by_majority(spark):
    """Three to one is no majority, four to one is; other sources' votes do not count; bad ones neither."""
    rows = [("a", "13/01/2024")] * 3 + [("a", "01/13/2024"), ("a", "02/03/2024")]
    rows += [("b", "13/01/2024")] * 4 + [("b", "01/13/2024"), ("b", "02/03/2024"), ("b", "01/13/2024 24:00"), ("b", "05/05/2024")]
    rows += [(None, "01/13/2024"), (None, "02/03/2024")]
    df = spark.createDataFrame([(i, s, "UTC", r) for i, (s, r) in enumerate(rows)], "stamp_id long, source string, zone string, raw string")
    got = {r["stamp_id"]: (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=r["utc_us"] or 0), r["rule"]) for r in timestamps.normalise(df).collect()}
    assert [(got[i][0].month, got[i][0].day, got[i][1]) for i in (4, 10, 12, 14)] == [(2, 3, "default"), (3, 2, "votes"), (5, 5, "plain"), (2, 3, "votes")]


def test_timestamps_of_odd_rows(spark):
    rows = [(None, None, "UTC", "20240101"), (None, None, "UTC", "20240101"), (1, "s", None, "20240101"), (2, "s", "Nowhere/At_All", "20240101"), (3, "s", None, "20240101 10:00Z"), (4, "s", "+05:30", "2024-01-01"), (5, "s", "UTC", "9" * 200_000), (6, "s", "UTC", "２０２４0101")]
    df = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")
    got = sorted(map(tuple, timestamps.normalise(df).collect()), key=str)
    day = 1704067200 * 10**6
    assert got == sorted([(None, day, "plain", False)] * 2 + [(1, None, "bad", False), (2, None, "bad", False), (3, day + 36000 * 10**6, "plain", False), (4, day - 19800 * 10**6, "plain", False), (5, None, "bad", False), (6, None, "bad", False)], key=str)
    assert timestamps.normalise(df.limit(0)).count() == 0


def test_votes_of_a_hot_source_are_spread(spark):
    """No task gets all rows of the one source: they are dealt by source and salt."""
    df = spark.range(4000).select(F.col("id").alias("stamp_id"), F.lit("s").alias("source"), F.lit("UTC").alias("zone"), F.when(F.col("id") % 5 == 0, "13/01/2024").otherwise("02/03/2024").alias("raw"))
    got = timestamps.normalise(df)
    assert got.where("rule = 'votes' and ambiguous").count() == 3200
    parsed = timestamps.parse(df).withColumn("salt", F.pmod(F.xxhash64("id", "us"), F.lit(timestamps.SALTS)).cast("int"))
    counts = [r["count"] for r in parsed.groupBy("salt").count().collect()]
    assert len(counts) > 200 and max(counts) < 50
    assert timestamps.counted(parsed).select("day_first", "month_first").distinct().collect() == [(800, 0)]


# vector codes


def lloyd(vectors, parts=8, entries=16, rounds=6):
    """vectors: (id, components, label) in any order."""
    kept = sorted((v for v in vectors if v[1] and all(x is not None and np.isfinite(x) for x in v[1])), key=lambda v: (v[0] is None, v[0]))
    q = [[int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v[1]] for v in kept]
    n = len(q[0]) // parts
    cut = [[tuple(r[p * n : p * n + n]) for p in range(parts)] for r in q]
    books = [[r[p] for r in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            at = [pick(r[p], books[p]) for r in cut]
            for k in range(len(books[p])):
                mine = [r[p] for r, a in zip(cut, at, strict=True) if a == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    out = []
    for v, r in zip(kept, cut, strict=True):
        at = [pick(r[p], books[p]) for p in range(parts)]
        out.append((v[0], bytes(at).hex(), sum(far(r[p], books[p][a]) for p, a in enumerate(at)), v[2]))
    labels = Counter()
    for r in out:
        labels[r[3]] += r[2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab]) for i, c, e, lab in out), key=str), digest


def compressed(spark, vectors):
    df = spark.createDataFrame([(*v, "x", "x", "x", "x") for v in vectors], VECTORS)
    found = vector_codes.compress(df)
    rows = vector_codes.with_label_error(found.codes).select("id", F.lower(F.hex("code")), "error", "label_error").collect()
    return sorted(map(tuple, rows), key=str), found.digest()


@pytest.mark.parametrize("seed, n", [(0, 150), (1, 60), (2, 5)])
def test_vector_codes_against_brute_force(spark, seed, n):
    """Ties, repeated vectors, unused entries, null labels, broken vectors, fewer vectors than entries."""
    rng = np.random.default_rng(seed)
    x = (rng.integers(-3, 4, (n, 16)) / rng.choice([1, 7])).astype(np.float32).tolist()
    rows = [(int(i), v, [None, 1, 2][i % 3]) for i, v in zip(rng.permutation(n * 2)[:n], x, strict=True)]
    rows += [(999, None, 1), (998, [], 1), (997, [float("nan")] * 16, 1), (996, [float("inf")] + [0.0] * 15, None), (995, [None] + [0.0] * 15, 2), (0 if seed else 994, [1.0] * 16, 5)]
    rows = list({r[0]: r for r in rows}.values())
    assert compressed(spark, rows) == lloyd(rows)


def test_vector_codes_of_odd_rows(spark):
    far = [3e38] + [0.0] * 7
    rows = [(None, [1.0] * 8, None), (1, [2.0] * 8, None), (1, [2.0] * 8, None), (3, far, 1), (4, [5.0] * 16, 1)]
    got, _ = compressed(spark, rows)
    assert len(got) == 4 and {r[0] for r in got} == {None, 1, 3}  # id 4 has another length
    assert compressed(spark, [(1, None, 1)])[0] == []
    with pytest.raises(ValueError, match="equal parts"):
        compressed(spark, [(1, [1.0] * 9, 1)])


def test_vector_codes_in_large_numbers(spark):
    """Beyond what doubles hold exactly."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 5000).astype(np.float32).tolist(), 0) for i in range(40)]
    assert compressed(spark, rows) == lloyd(rows)


def test_vectors_meet_their_codes_without_a_shuffle(spark):
    rows = spark.range(200).select(F.col("id").alias("row"), F.array(*[(F.col("id") * (i + 3) % 17).cast("long") for i in range(8)]).alias("q"))
    start = np.arange(32, dtype=np.int64).reshape(8, 4, 1)
    run = vector_codes.Lloyd(rows, 8, start)
    assert run.round()
    plan = run._meet().select("row", "q", "old")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    counts = run.counts.copy()
    run.round()
    assert counts.sum() == run.counts.sum() == 200 * 8 and len(run.tables) == 2
    x = np.array([r["q"] for r in rows.orderBy("row").collect()])
    codes = np.array([list(r["code"]) for r in run.assigned.orderBy("row").collect()])
    assert all(run.sums[p, k, 0] == x[codes[:, p] == k, p].sum() for p in range(8) for k in range(4))


def test_decoding_a_vector_code(spark):
    rows = [(i, [float(i % 4)] * 8, 0) for i in range(20)]
    found = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = found.codes.select("id", vector_codes.decode(F.col("code"), found.books).alias("v")).collect()
    assert all(abs(x - r["id"] % 4) < 0.001 for r in got for x in r["v"])


# repeated passages


def without_repeats(rows, window):
    """rows: (doc_id, text); ids in order, null last."""
    rank = lambda i: (i is None, i or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, rank(i)), rank(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < rank(i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, seed", [(50, 0), (50, 1), (7, 2), (8, 3), (130, 4)])
def test_passages_against_brute_force(spark, window, seed):
    """Copies, near copies, shared passages, few words that repeat at all lengths, equal rows, one id with
    two texts, null ids, texts a little longer and shorter than the window."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ccc", "é", "x y", "Z"]) if rng.random() < 0.5 else str(rng.randrange(400))
    passages = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(4)] + [["same"] * 3 * window]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(window))]
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + [word() for _ in range(rng.randrange(window // 2))]
        if rows and rng.random() < 0.3:
            w = (rng.choice(rows)[1] or "").split(" ")
            if rng.random() < 0.5 and len(w) > 3:
                w[rng.randrange(len(w))] = "changed"
        rows.append((rng.choice([i, i, i, 3, None]), rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [rows[0], rows[0], (50, None), (51, ""), (52, " \t\n"), (53, "y " * (4 * window)), (54, "y " * (2 * window))]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS)
    got = sorted(map(tuple, substring_dedup.dedup_passages(df, window).select("doc_id", "n_words", "n_removed", "text").collect()), key=str)
    assert got == without_repeats(rows, window)
    assert any(r[2] for r in got)


def test_passages_of_nothing_and_of_a_long_text(spark):
    df = spark.createDataFrame([], DOCS)
    assert substring_dedup.dedup_passages(df).count() == 0
    long_text = " ".join(str(i * i % 1009) for i in range(150_000))
    rows = [(2, long_text), (1, "start " + " ".join(long_text.split(" ")[-60:]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: r[2] for r in without_repeats(rows, 50)}
    assert got == want and got[2] >= 60


def test_few_windows_stand_for_all():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    _, by = substring_dedup._stood_for(words, 50)
    assert len(np.unique(by)) < 0.09 * len(words)
    _, again = substring_dedup._stood_for(words[777:1400], 50)
    assert (again == by[777 : 777 + len(again)] - 777).all()  # the same ones, wherever the words stand


def test_the_least_of_each_window():
    rng = np.random.default_rng(1)
    for n, length in [(0, 3), (2, 3), (3, 3), (50, 1), (200, 7), (200, 26), (200, 64)]:
        h = rng.integers(0, 9, n).astype(np.uint64)
        want = [i + min(range(length), key=lambda k: h[i + k]) for i in range(n - length + 1)]  # noqa: B023
        assert substring_dedup.least_in(h, length).tolist() == want
