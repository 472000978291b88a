"""Streams with state of their own against plain loops: files in and out of order, starts from the checkpoint, late rows, odd rows."""

import math
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from probata.streaming import monitor as MO
from probata.streaming import stateful as SF
from probata.streaming import stream as ST

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def late_by_hand(pieces, allowed):
    seen, n, late = {}, defaultdict(int), defaultdict(int)
    for piece in pieces:
        for place, key, t in sorted(piece, key=lambda r: r[0]):
            n[key] += 1
            if t is not None:
                late[key] += key in seen and t < seen[key] - allowed
                seen[key] = max(t, seen.get(key, t))
    return {k: (n[k], late[k]) for k in n}


@pytest.mark.parametrize("shuffled", [False, True])
def test_late_counts(spark, shuffled):
    g = np.random.default_rng(8)
    rows = [(i, None if i % 31 == 0 else "ab"[i % 3 > 0], None if i % 37 == 0 else int(i * 2 - (g.integers(0, 200) if g.random() < 0.2 else 0))) for i in range(240)]
    order = g.permutation(240) if shuffled else np.arange(240)
    pieces = [[rows[i] for i in order[k : k + 80]] for k in range(0, 240, 80)]
    frames = [spark.createDataFrame([(p, k, at(t)) for p, k, t in piece], "place long, kind string, ts timestamp").repartition(3) for piece in pieces]
    with SF.rocksdb(spark):
        got = ST.fed(frames, lambda x: SF.late_counts(x, "kind", "ts", "place", 3600), "update")
    last = got.groupBy("kind").agg(F.max_by("n", "batch").alias("n"), F.max_by("late", "batch").alias("late")).collect()
    want = late_by_hand(pieces, 60)
    assert {r.kind: (r.n, r.late) for r in last} == want
    assert sum(x for _, x in want.values()) > 10


def test_rocksdb_is_set_inside_only(spark):
    before = spark.conf.get(SF.PROVIDER)
    with SF.rocksdb(spark):
        assert spark.conf.get(SF.PROVIDER) == SF.ROCKSDB
    assert spark.conf.get(SF.PROVIDER) == before


BOOKED = "resource long, slot timestamp, id long, note string"


def booked(spark, rows):
    return spark.createDataFrame([(r, at(t), i, "x") for r, t, i in rows], BOOKED)


def test_bookings_in_and_out_of_order(spark):
    """The holder is the first that came, in a trigger the least number; a start from the checkpoint after each piece changes nothing."""
    g = np.random.default_rng(5)
    rows = [(int(g.integers(0, 3)), int(g.integers(0, 30)) * 60, i) for i in range(150)]
    order = g.permutation(150)
    pieces = [[rows[i] for i in order[k : k + 50]] for k in range(0, 150, 50)]
    pieces[1] += [(None, 60, 900), (1, None, 901), (1, 60, None)]
    with SF.rocksdb(spark):
        got = ST.fed([booked(spark, p) for p in pieces], lambda x: SF.bookings(x, "resource", "slot", "id")).collect()
    holder, want = {}, {}
    for piece in pieces:
        for r, t, i in sorted((x for x in piece if None not in x), key=lambda x: x[2]):
            want[i] = (r, t, holder.setdefault((r, t), i))
    assert len(got) == len(want) == 150
    for x in got:
        r, t, h = want[x.booking]
        assert (x.resource, x.slot, x.holder, x.accepted) == (r, at(t), h, h == x.booking)
    assert 0 < sum(x.accepted for x in got) < 150


def test_bookings_end_with_the_watermark(spark):
    """A slot stays taken while its state lives; bookings behind the watermark are dropped, so none is accepted anew."""
    day = 24 * 60
    pieces = [[(1, 600, 1), (1, 660, 2)], [(1, 600, 3), (2, 3 * day, 4)], [(2, 10 * day, 5)], [(1, 600, 6), (2, 10 * day, 7)], [(2, 10 * day + 60, 8)]]
    with SF.rocksdb(spark):
        got = ST.fed([booked(spark, p) for p in pieces], lambda x: SF.bookings(x, "resource", "slot", "id", "5 days", 48)).collect()
    assert {r.booking: (r.accepted, r.holder) for r in got} == {1: (True, 1), 2: (True, 2), 3: (False, 1), 4: (True, 4), 5: (True, 5), 7: (False, 5), 8: (True, 8)}


PREDICTED = "ts timestamp, p array<double>, y int, seen boolean, n int"


def by_hand(rows, bins=10, classes=3):
    """Figures by day of (minute, p, y, seen)."""
    days = defaultdict(list)
    for t, p, y, seen in rows:
        if t is not None and p is not None and len(p) == classes and all(v is not None and 0 <= v <= 1 for v in p) and abs(sum(p) - 1) <= 1e-6:
            days[t // 1440].append((p.index(max(p)), max(p), y, bool(seen)))
    out = {}
    for day, own in days.items():
        known = [x for x in own if x[2] is not None]
        place = lambda c: min(bins - 1, math.floor(c * bins))
        ece = sum(abs(sum(c - (y == k) for k, c, y, _ in known if place(c) == b)) for b in range(bins)) / len(known) if known else None
        out[day] = (len(own), [sum(x[0] == k for x in own) / len(own) for k in range(classes)], [sum(place(x[1]) == b for x in own) / len(own) for b in range(bins)], sum(x[1] for x in own) / len(own), sum(x[3] for x in own) / len(own), ece)
    return out


def psi(a, b):
    return sum((max(x, 1e-6) - max(y, 1e-6)) * math.log(max(x, 1e-6) / max(y, 1e-6)) for x, y in zip(a, b, strict=True))


def predicted(seed=6):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        p = g.dirichlet([1 + (i < 200), 1, 2 if i > 250 else 1])
        rows.append((i * 20, [float(v) for v in p[:-1]] + [1 - float(sum(p[:-1]))], None if i % 4 == 0 or 72 <= i < 144 else int(g.integers(0, 3)), None if i % 9 == 0 else bool(i % 5 == 0)))
    return rows + [(50, None, 1, True), (60, [0.5, 0.5], 1, True), (70, [0.9, 0.9, 0.9], 1, True), (None, [1.0, 0.0, 0.0], 0, True), (80, [None, 1.0, 0.0], 1, True)]


def frame(spark, rows):
    return spark.createDataFrame([(at(t), p, y, s, 7) for t, p, y, s in rows], PREDICTED)


def holds(got, want):
    first = want[min(want)]
    assert {r.start for r in got} == {at(d * 1440) for d in want}
    for r in got:
        n, by_class, by_bin, confidence, review, ece = want[(r.start - START).days]
        assert r.n == n
        assert list(r.class_shares) == pytest.approx(by_class)
        assert list(r.bin_shares) == pytest.approx(by_bin)
        assert (r.confidence, r.review_share) == (pytest.approx(confidence), pytest.approx(review))
        assert r.ece == (None if ece is None else pytest.approx(ece))
        assert (r.class_psi, r.confidence_psi) == (pytest.approx(psi(by_class, first[1]), abs=1e-9), pytest.approx(psi(by_bin, first[2]), abs=1e-9))
        assert r.ece_change == (None if ece is None else pytest.approx(ece - first[5]))


def test_monitoring_of_a_table(spark):
    rows = predicted()
    got = MO.monitored(MO.cells(frame(spark, rows), "ts", "p", "y", "seen", 3, "1 day", "1 day"), 3).collect()
    holds(got, by_hand(rows))
    assert any(r.ece is None for r in got)
    assert max(r.class_psi for r in got) > 0.05
    none = MO.cells(frame(spark, []), "ts", "p", "y", "seen", 3, "1 day", "1 day")
    assert MO.monitored(none, 3).count() == 0
    later = MO.monitored(MO.cells(frame(spark, rows), "ts", "p", "y", "seen", 3, "1 day", "1 day"), 3, reference=at(1440)).collect()
    assert {r.class_psi for r in later if r.start == at(1440)} == {0.0}


def test_monitoring_of_a_stream_with_late_rows(spark):
    """Rows within the delay count in their window, rows behind the watermark don't; windows come out when they are closed."""
    rows = predicted()
    own = [r for r in rows if r[0] is None or r[0] % 1440 != 700]
    late = [(700, [1.0, 0.0, 0.0], 0, True), (3 * 1440 + 700, [0.0, 1.0, 0.0], 0, True)]
    first = [r for r in own if (r[0] or 0) < 3000]
    second = [r for r in own if 3000 <= (r[0] or 0) < 6400]
    third = [r for r in own if (r[0] or 0) >= 6400]
    # the watermark is at minute 6400 - 1440 from the third piece on, and rows are judged by the one of the trigger before
    pieces = [first, second, [], [*third, *late]]
    got = MO.monitored(ST.fed([frame(spark, p) for p in pieces], lambda x: MO.cells(x, "ts", "p", "y", "seen", 3, "1 day", "1 day")), 3).collect()
    want = by_hand([*own, late[1]])
    closed = {d: x for d, x in want.items() if (d + 1) * 1440 <= 7980 - 1440}
    holds(got, closed)
    assert len(closed) == 4
