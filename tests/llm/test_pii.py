import hashlib
import random
import re

from pyspark.sql import functions as F

from gradeloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def texts():
    rng = random.Random(8)
    fixed = [
        None, "", "mail a.b@c.d.com, now", "a@b.c_d@e.f@g.h.i x@y z@w.", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 001.0000002.3.4",
        "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8796 12", "+1 (736) 555-2678. +12 +1-2 +44.20.7946.0958(", "é🙂 a@b.cd 🙂 9.9.9.9",
        "@@@ a@ @b.c a@b a@b..c a@-.-", "x" * 30_000 + "@", "a." * 20_000, "1" * 20_000, "+1" + "(" * 5000, "a@" + "b." * 9000 + "c", "a@b.c " * 700 + "1.1.1.1 " * 300,
        "write to joe [at] mail.example (dot) com or call 212-555-0188", "order 4041894974608796",
    ]
    parts = ["a", "B7", "@", ".", "-", " ", "+", "(", ")", "%", "_", "1", "255", "256", "4041894974608795", "x@y.zz", "1.2.3.4", "+1 736 555 2678", "é", "\n", "🙂"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(2, "mail a.b@c.d.com, now"), (None, "q@r.st")]
    frame = spark.createDataFrame([(t, i, "e", 3) for i, t in rows], "text string, doc_id long, kind string, spans int")
    got = pii.digest(frame).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        want = brute(by_id[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in pii.KINDS], by_id[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r.spans.split(",")] if r.spans else []
        assert set(text.split(",")) - {""} <= {":".join(s) for s in spans}
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_added_spans(spark):
    sure = [(k, f"mail p{k}@mail.example.com or call +1 736 555 {1000 + k}") for k in range(100)]
    junk = [(200 + k, f"order 999900000000{1000 + k} version 300.{k}.1.1") for k in range(60)]
    loose = [(400 + k, f"please call 212-555-0{100 + k} or mail joe{k} [at] example (dot) com") for k in range(30)]
    plain = [(600, "nothing of the kind in here, 12 of 15")]
    frame = spark.createDataFrame(sure + junk + loose + plain, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(frame).collect()}
    assert all(got[i].count(":") == 4 and "phone" in got[i] and "email" in got[i] for i, _ in loose)
    assert all(got[i] == "" for i, t in junk + plain if not brute(t))


def test_reliabilities():
    counts = {("email", "base", 1, 1, 0): 900, ("email", "base", 1, 1, 1): 300, ("card", "base", -1, -1, -1): 200, ("card", "base", -1, -1, 0): 300, ("phone", "loose", 0, 1, 1): 50}
    posterior, tables = pii.fit_labelers(counts)
    assert posterior["email", "base", 1, 1, 0] > 0.95 and posterior["card", "base", -1, -1, 0] < 0.1
    assert tables[0][1][0] > 0.8


def test_the_classifier_goes_by_features_of_its_own(spark):
    """Spans with the same votes are told apart by what stands around them."""
    votes = {"kind": "phone", "form": "base", "by_form": -1, "by_gazetteer": 0, "by_context": 0}
    good = ("phone", "base", 1, 1, 1)
    rows = [(*good, [1, 2, 3])] * 300 + [(*votes.values(), [4, 5, 3])] * 300 + [(*votes.values(), [1, 2, 3])] * 5
    names = ", ".join(f"{k} {'int' if k.startswith('by') else 'string'}" for k in votes)
    frame = spark.createDataFrame(rows, names + ", slots array<int>")
    spans = frame.select(F.struct(*frame.columns).alias("x"))
    weights = pii.train_classifier(spans, {good: 0.99, tuple(votes.values()): 0.02})
    odds = lambda slots: sum(weights[k] for k in slots)
    assert odds([1, 2, 3]) > 2 and odds([4, 5, 3]) < -2
    (same,) = spans.where("x.by_form = 1").limit(1).select(F.expr(pii._odds(weights, "x")).alias("o")).collect()
    assert abs(same.o - odds([1, 2, 3])) < 1e-9


def test_spelled_out_and_spaced_forms(spark):
    sure = [(k, f"mail p{k}@mail.example.com from ip 8.8.{k}.4 please") for k in range(100)]
    loose = [(200 + k, f"please mail joe{k} at example dot com from ip 8. 8. {k}. 4 now") for k in range(40)]
    plain = [(300 + k, f"we met at noon. {k} people came at 8 . It was version 1. 2. 3. of it") for k in range(20)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(sure + loose + plain, "doc_id long, text string")).collect()}
    assert all(got[i].n_added_email == 1 and got[i].n_added_ip == 1 and got[i].n_email == 0 for i, _ in loose)
    assert all(got[i].spans == "" for i, _ in plain)


def test_empty(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
