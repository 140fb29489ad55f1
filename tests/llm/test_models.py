"""Classifiers: held-out accuracy on made-up texts, edge rows, and the automaton against edit distance; the pipeline."""

import random
import zlib

import pytest

from xylem.llm import language, quality, toxicity

RND = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter", "ses") for b in ("na", "ri", "ton") for c in ("", "s", "ly")]


def prose(n, rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(n, rnd):
    return " ".join(rnd.choice(WORDS).upper() + "!!" for _ in range(n // 2)) + " | " * (n // 3)


@pytest.fixture(scope="module")
def tables(spark):
    rnd, docs, labels = random.Random(4), [], []
    for k in range(500):
        good, toxic = rnd.random() < 0.7, rnd.random() < 0.2
        text = prose(rnd.randint(20, 80), rnd) if good else junk(rnd.randint(20, 80), rnd)
        if toxic:
            at = rnd.randint(0, len(text))
            text = text[:at] + " " + rnd.choice(["grobian", "grobians", "idiot"]) + " " + text[at:]
        docs.append((k, text, "en" if k % 2 else "fr", "s"))
        labels.append((k, int(good), int(toxic)))
    docs += [(1000, None, None, "s"), (1001, "", "en", "s"), (None, "Lone words here.", "en", "s"), (1002, "!!! 123", "en", "s"), (1, docs[1][1], "en", "s")]
    labels += [(None, 1, 0), (3, None, None), (99_999, 0, 1), (5, labels[5][1], labels[5][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels[:500]}


def remainder(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_quality(spark, tables):
    docs, labels, known = tables
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 505 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == known[r.doc_id][1] for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_additive_model_learns_a_pair():
    import numpy as np

    x = np.random.default_rng(1).random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and {(a, b) for a, b, _ in model.pairs} >= {(1, 0)}


def test_toxicity(spark, tables):
    docs, labels, known = tables
    rows = toxicity.scored(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == known[r.doc_id][2] for r in held) >= 0.97 * len(held)
    assert len(rows) == 505 and toxicity.scored(docs.limit(0), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, labels.limit(0)).collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    terms = ["idiot", "moron", "worthless", "scum", "disgusting", "idiots"]
    lexicon, rnd = toxicity.Lexicon([*terms, "lowei*"]), random.Random(2)
    words = {"", "x", "lowe", "loweixyz", "lowei"}
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randint(0, len(w))
                w[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "o", "t"])
            words.add("".join(w))
    for w in words:
        near = min((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(t)) if any(distance(w, t) <= toxicity.edits(t) for t in terms) else None
        want = 3 if w.startswith("lowei") else 0 if near is None else 1 if near[0] == 0 else 2
        assert lexicon.look(w) == want, w


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon(["idiot"])
    plain, quoted = lexicon.features("you idiot go"), lexicon.features('he used the "idiot" slur')
    assert plain[0] > 0 and quoted[0] == 0 and quoted[3] > 0
    assert toxicity.PRIOR @ plain > toxicity.PRIOR @ quoted


def test_language(spark):
    rnd = random.Random(8)
    alphabets = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "nicht", "schön", "über"], "cc": ["que", "los", "niño", "para", "ción"]}
    docs = [(k, " ".join(rnd.choice(alphabets[lang]) for _ in range(30)), lang) for k in range(300) for lang in [rnd.choice(list(alphabets))]]
    docs += [(900, None, "aa"), (901, "12 !?", "aa"), (902, "und", None), (None, "the thing", "aa")]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, score double")
    rows = {r.doc_id: r for r in language.identified(frame).collect()}
    assert all(rows[i].lang_pred == lang for i, _, lang in docs[:300]) and rows[900].lang_pred == rows[901].lang_pred == "und" and rows[902].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in language.identified(frame.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rnd = random.Random(6)
    docs = [(k, prose(40, rnd)) for k in range(150)] + [(150 + k, junk(40, rnd)) for k in range(60)]
    docs += [(300, docs[3][1]), (301, docs[4][1] + " mail me at someone@example.org"), (302, prose(6, rnd) + " alpha beta gamma delta epsilon zeta eta theta one two three four five six seven eight"), (303, "Call +49 30 1234567 today. " + prose(40, rnd))]
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five six seven eight")]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i, _ in docs[:210]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r for r in frame.collect()}
        if name != "pieces":
            assert frame.columns == columns
    assert set(range(150)) <= set(kept["quality"]) and not set(range(150, 210)) & set(kept["quality"])
    assert 300 not in kept["near_duplicates"] and 3 in kept["near_duplicates"]
    assert 302 in kept["near_duplicates"] and 302 not in kept["decontamination"]
    assert "<PHONE>" in kept["personal_data"][303].text and kept["personal_data"][5].text == docs[5][1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(kept["pieces"])
