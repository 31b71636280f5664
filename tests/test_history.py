import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators.history import attribute_history

SCHEMA = "pid string, day date, loaded int, club string, active boolean, valid_from string"


def brute(rows):
    """Versions by a plain walk: last loaded of a day, gaps filled, changes cut."""
    last = {}
    for pid, day, loaded, club, active, _ in rows:
        if pid is None or day is None:
            continue
        key = (pid, day)
        if key not in last or loaded > last[key][0]:
            last[key] = (loaded, club, active)
    out = []
    for pid in {p for p, _ in last}:
        days = sorted(d for p, d in last if p == pid)
        seq = []
        for d in days:
            _, club, active = last[pid, d]
            club = " ".join(club.lower().split()) if club and club.strip() else None
            seq.append([club, active])
        for i in (0, 1):
            known = None
            for s in seq:
                known = s[i] = s[i] if s[i] is not None else known
            first = next((s[i] for s in seq if s[i] is not None), None)
            for s in seq:
                s[i] = s[i] if s[i] is not None else first
        for k, d in enumerate(days):
            if k == 0 or seq[k] != seq[k - 1]:
                out.append((pid, d))
    return sorted(out)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_history_equals_walk(spark, fan_in):
    rng = random.Random(7)
    rows = []
    for _ in range(900):
        pid = "hot" if rng.random() < 0.4 else rng.choice([f"p{i}" for i in range(30)] + [None])
        day = dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(200)) if rng.random() > 0.02 else None
        club = rng.choice(["FC A", "fc  a", " FC A ", "B", "", "  ", None])
        rows.append((pid, day, len(rows), club, rng.choice([True, False, None, True]), "x"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    got = attribute_history(df, "pid", "day", ["club", "active"], ["loaded"], fan_in)
    assert sorted((r.pid, r.valid_from) for r in got.collect()) == brute(rows)
    current = got.where("is_current").groupBy("pid").count().where("count <> 1")
    assert current.isEmpty()
    gaps = got.where((F.col("valid_to") < F.col("valid_from")))
    assert gaps.isEmpty()


def test_history_of_nothing(spark):
    assert attribute_history(spark.createDataFrame([], SCHEMA), "pid", "day", ["club"], ["loaded"]).count() == 0


def test_unknown_values_say_nothing(spark):
    rows = [("a", dt.date(2024, 1, d), d, c, None, "") for d, c in ((1, None), (2, "X"), (3, ""), (4, "x "), (5, "Y"))]
    got = attribute_history(spark.createDataFrame(rows, SCHEMA), "pid", "day", ["club", "active"], ["loaded"]).orderBy("valid_from").collect()
    assert [(r.valid_from.day, r.club) for r in got] == [(1, "X"), (5, "Y")]
    assert got[0].valid_to == dt.date(2024, 1, 4) and got[1].valid_to is None
