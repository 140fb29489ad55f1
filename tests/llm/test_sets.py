"""Jaccard join, components, fingerprints and WARC against brute force, with skew and odd rows."""

import hashlib
import random
import re

import pyarrow as pa
import pyarrow.fs
import pytest

from xylem.llm import archive, jaccard, spots
from xylem.llm.shared import Scratch, components, key_filter, may_contain, shared_folder

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def varied(seed=1):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 5, 12, 60, 300]))] for _ in range(25)]
    passage = " ".join(f"p{k}" for k in range(55))
    out = [None, "", " \t", "one", "ONE", "a b c d", "a b c d e"]
    for w in base:
        for _ in range(rnd.randint(1, 8)):
            copy = list(w)
            for _ in range(rnd.choice([0, 0, 1, 2, len(w) // 30])):
                copy[rnd.randrange(len(copy))] = f"z{rnd.randint(0, 9)}"
            out.append(" ".join(copy) + (" " + passage if rnd.random() < 0.3 else ""))
    template = [f"t{k}" for k in range(120)]
    for k in range(60):  # a chain of near copies and a star of them
        copy = list(template)
        copy[k], copy[(k * 7) % 120] = "x", f"y{k}"
        out.append(" ".join(copy))
    return list(enumerate(out))


def test_classes_match_brute_force(spark):
    rows = varied()
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, n long, rep long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(docs).collect()}
    assert got == classes(rows)


def test_small_lists_and_hot_order_change_nothing(spark, monkeypatch):
    rows = varied(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, count in ((1, 1), (50, 1)):
        monkeypatch.setattr(jaccard, "FREQUENT", size)
        monkeypatch.setattr(jaccard, "COUNT_FROM", count)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(docs).collect()} == classes(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "A B C D E F"), (9, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.similar_sets(docs).collect()), key=str)
    assert rows == [(-1, 2, None), (4, 2, 4), (4, 2, 4), (7, 2, 4), (9, 0, 9)]
    assert jaccard.similar_sets(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect()) == ["4", "4", "9", "None"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.id: r.component for r in components(Scratch(spark, "t"), edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert components(Scratch(spark, "t"), edges.limit(0)).count() == 0


def test_filter_agrees_with_spark_hashes(spark):
    import numpy as np

    table = key_filter(spark.range(1000), "id")
    assert may_contain(table, np.arange(1000)).all() and may_contain(table, np.arange(10_000, 20_000)).mean() < 0.01


# ---- fingerprints


def test_edited_texts_and_likeness(spark):
    texts = ["The cat of the house and a dog " * 9, None, "", "...", "x", "é😀" * 50, "The cat of the house and a dog " * 9, *(f"the {k} of it and {k * 7} to the end {k % 5}" for k in range(40))]
    docs = spark.createDataFrame([(k * 3, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, bucket string")
    rows = {r.doc_id: r for r in spots.compared(docs).collect()}
    order = [(k * 3, t or "") for k, t in enumerate(texts)][::-1]
    assert len(rows) == len(texts)
    for k, (i, t) in enumerate(order):
        n, follow = len(t) // 3, order[(k + 1) % len(order)]
        e, r = t[: len(t) - n] + follow[1][:n], rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        cut = lambda h: {h[q : q + 8] for q in range(0, len(h), 8)}
        for mark, value in ((r.edited_fingerprint, r.near_edited), (rows[follow[0]].fingerprint, r.near_next)):
            a, b = cut(r.fingerprint), cut(mark)
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert rows[0].fingerprint == rows[18].fingerprint


def test_one_row_follows_itself_and_ties(spark):
    one = spots.compared(spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    many = spots.compared(spark.createDataFrame([(1, "the cat sat"), (1, "the cat sat"), (None, "x y"), (1, "a dog ran")], "doc_id long, text string")).collect()
    assert len(many) == 4 and spots.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_common_words_count_whole():
    head, body = "zzq yyq ", [f"wq{k}" for k in range(60)]
    texts = [head + " ".join(body), head + " ".join(f"vq{k}" for k in range(60)), head + " ".join(body[:40] + [f"uq{k}" for k in range(20)]), "the cat " + " ".join(body), "xa xb xc", "xa xb xd", "xa", ""]
    p = spots.prints(texts)
    assert spots.likeness(p[0], p[1]) < 0.1 and 0.3 < spots.likeness(p[0], p[2]) < 0.7 and spots.likeness(p[0], p[3]) > 0.8
    assert spots.likeness(p[4], p[5]) < 1 and [len(x) for x in p[4:]] == [2, 2, 1, 0]
    assert all(spots.prints([t])[0].tolist() == x.tolist() for t, x in zip(texts, p, strict=True))


def test_spot_signatures_follow_anchors():
    a, b, c = spots.spot_sets(pa.array(["zz the red fox", "qq the red fox", "red fox the"]))
    assert len(set(a.tolist()) & set(b.tolist())) == 1 and not set(a.tolist()) & set(c.tolist())


def test_similar_spots(spark):
    body = " ".join(f"the n{k} v{k}" for k in range(40))
    docs = spark.createDataFrame([(1, body), (2, body + " the end"), (3, "of x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in spots.similar_spots(docs).collect()} == {1: 1, 2: 1, 3: 3}


# ---- WARC


def test_archive_round_trip(spark):
    long, rnd = "y" * 400_000, random.Random(5)
    pages = [(5, "http://a/ü b", "p" * 200), (2, "http://b", "p" * 200), (9, None, "p" * 200), (3, "u", "short"), (4, "u", "short"), (7, "u\r\nX: y", None), (8, "u", "\r\n\r\n"), (11, "u", long), (12, "u", long), (None, "u", "p" * 200), (13, "u", "".join(rnd.choice("ab") for _ in range(150)))]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    scratch, folder = Scratch(spark, "t"), f"{shared_folder(spark)}/warc-test"
    index = archive.write_bundles(frame, folder, scratch)
    got = {r.page_id: r for r in archive.read_bundles(index, folder).collect()}
    first = {}
    for i, _, t in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(t or "", i)
    for i, _, t in pages:
        t = t or ""
        refers = first[t] if len(t) >= 100 and first[t] != i else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), "revisit" if refers is not None else "response", refers)
        assert refers is not None or bytes(r.payload) == t.encode()
    head, payload = archive.lookup(index, folder, 11)
    assert payload == long.encode() and head["WARC-Type"] == "response"


def test_bundle_is_plain_zstandard_with_a_seek_table(tmp_path):
    import io

    import zstandard

    with open(tmp_path / "b", "wb") as f:
        bundle = archive.Bundle(f)
        places = [bundle.add(bytes([65 + k]) * 100_000) for k in range(7)]
        bundle.close()
    raw = (tmp_path / "b").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(plain) == 700_000 and places[2] == (1, 0)
    reader = archive.Reader(pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "b")))
    assert reader.frame(1)[:3] == b"CCC" and len(reader.frames) == 4


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    index = archive.write_bundles(frame, f"{shared_folder(spark)}/warc-none", Scratch(spark, "t"))
    assert archive.read_bundles(index, f"{shared_folder(spark)}/warc-none").count() == 0
