"""Scans of long texts, places of many matches, and the interval join of secrets, against brute force."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from xylem.llm import personal, secrets, spans
from xylem.llm.shared import Scratch


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " @", "7" * 1_000_000 + " .", "a@" * 300_000, "1." * 300_000 + "x", "+" + "(" * 500_000, "token" + " " * 500_000 + "x"])
def test_long_runs_take_no_longer(spark, text):
    began = time.perf_counter()
    personal.with_base(one(spark, text)).select("base").collect()
    secrets.with_parts(one(spark, text)).select("base").collect()
    assert time.perf_counter() - began < 20


def test_runs_match_plain_patterns(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("a1.@%-_ é") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", spans.matches(F.col("text"), personal.EMAIL).alias("e"), spans.matches(F.col("text"), personal.IP).alias("i")).collect()
    for r in rows:
        assert r.e == [m[0] for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts[r.doc_id])]
        assert r.i == [m[0] for m in regex.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", texts[r.doc_id])]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 63, 64, 65, 5000])
def test_places_of_many_matches(spark, n):
    text = "".join(f"é{'😀' * (k % 3)} a{k}@b.co;" for k in range(n))
    found = spans.matches(F.col("text"), personal.EMAIL)
    got = one(spark, text).select(spans.placed(F.col("text"), personal.EMAIL, found).alias("p")).first().p
    want = [(m.start(), m.end(), m[0], len(text[: m.start()].encode())) for m in regex.finditer(personal.EMAIL, text)]
    assert [tuple(x) for x in got] == want and len(want) == n


def test_replacements_of_many_overlapping_spans(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abé😀 ") for _ in range(3000))
    at = sorted((rnd.randrange(len(text)), rnd.randint(1, 9)) for _ in range(700))
    ends = [len(text[:k].encode()) for k in range(len(text) + 1)]
    marks = [(ends[a], ends[min(len(text), a + n)], f"<{k}>") for k, (a, n) in enumerate(at)]
    want, reach, raw = b"", 0, text.encode()
    for a, b, put in marks:
        if a >= reach:
            want += raw[reach:a] + put.encode()
        reach = max(reach, b)
    want += raw[reach:]
    frame = spark.createDataFrame([(text, marks)], "text string, spans array<struct<at:int,end:int,put:string>>")
    assert frame.select(spans.replaced(F.col("text"), F.col("spans"))).first()[0] == want.decode()


def brute(text):
    """Weak candidates that the rule bears out, by comparing all with all."""
    base = [(m.start(), m.end(), kind) for kind, p in (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX)) for m in regex.finditer(p, text) if kind != "assign" or len(m[1]) >= 8]
    mixed = lambda v: regex.search("[0-9]", v) and regex.search("[A-Z]", v) and regex.search("[a-z]", v)
    weak = [(m.start(), m.end(), kind) for kind, p in secrets.WEAK.items() for m in regex.finditer(p, text) if kind != "key" or mixed(m[0])]
    weak = [w for w in weak if not any(b[0] < w[1] and w[0] < b[1] for b in base)]
    out = []
    for w in weak:
        near = {secrets.ROLE[y[2]] for y in [*base, *weak] if y[0] < w[1] + secrets.SCOPE and w[0] < y[1] + secrets.SCOPE and secrets.ROLE[y[2]] != secrets.ROLE[w[2]]}
        role = secrets.ROLE[w[2]]
        if "key" in near if role == "identifier" else near & {"identifier", "endpoint"} if role == "key" else {"identifier", "key"} <= near:
            out.append(w)
    return sorted(out)


def test_linked_parts_match_brute_force(spark):
    rnd = random.Random(8)
    parts = ["user: bob", "login=ann.lee", "me@corp.example", "10.0.0.7:5432", "AbCdEf1234567890XyZaBcD", "https://h.example/x", "postgres://db/x", 'token = "abcdefgh1234"', "AKIA1234567890ABCD", "ASIA1234567890ABCD", "f" * 40]
    texts = ["".join(rnd.choice([*parts, " " * rnd.randint(1, 260), " words of prose "]) + " " for _ in range(rnd.randint(1, 30))) for _ in range(120)]
    texts += [None, "", texts[0], " ".join(parts * 300)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, own long, role string")
    rows = {r.doc_id: r for r in secrets.secret_spans(docs, Scratch(spark, "t")).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert sorted((x.start, x.stop, x.kind) for x in rows[k].extra) == brute(t or ""), t


def test_spans_are_listed_by_start(spark, tmp_path):
    text = 'me@corp.example then token = "abcdefgh1234" and ASIA1234567890ABCD'
    one(spark, text).write.parquet(str(tmp_path / "documents.parquet"))
    row = secrets.op5_secrets(spark, str(tmp_path)).first()
    kinds, starts = zip(*((x.split(":")[0], int(x.split(":")[1])) for x in row.spans.split(",")), strict=True)
    assert kinds == ("mail", "assign", "identifier") and list(starts) == sorted(starts) and row.n_assign == 1


def test_disclosing_shares_match_brute_force(spark):
    """Shares of (entity, term), counted over different texts by plain loops."""
    import math
    from collections import defaultdict

    rnd = random.Random(2)
    names, words = [f"p{k}@corp.com" for k in range(6)], [f"word{chr(97 + k)}" for k in range(20)]
    texts = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(300)]
    for k, name in enumerate(names):
        texts += [f"{name} Zeta{chr(97 + k)}x {rnd.choice(words)}" for _ in range(k + 1)]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts[-3:]])], "doc_id long, text string")
    terms = {t: {w.lower() for w in regex.findall(r"\p{L}{4,}", t)} for t in texts}
    of = {t: set(regex.findall(r"p\d@corp\.com", t)) for t in texts}
    with_term, with_entity, both = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in texts:
        for w in terms[t]:
            with_term[w] += 1
        for e in of[t]:
            with_entity[e] += 1
            for w in terms[t]:
                both[e, w] += 1
    n = len(texts)
    share = {(e, w): math.log2(b * n / (with_entity[e] * (with_term[w] + personal.PRIOR))) / math.log2(n / with_entity[e]) for (e, w), b in both.items()}
    flagged = {t: {w for w in terms[t] if any(share[e, w] >= personal.DISCLOSE for e in of[t])} for t in texts}
    rows = personal.personal_spans(docs, Scratch(spark, "t")).join(docs, "doc_id").collect()
    for r in rows:
        want = sorted(m.span() for m in regex.finditer(r"\p{L}{4,}", r.text) if m[0].lower() in flagged[r.text] and not any(b.start < m.end() and m.start() < b.stop for b in r.base))
        assert sorted((x.start, x.stop) for x in r.terms) == want
    assert any(flagged.values())
