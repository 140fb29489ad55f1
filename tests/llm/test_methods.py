"""Methods against independent brute-force versions: the map walk, chains of words, rank-order distance, additive scores, edits."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from xylem.llm import language, pieces, quality, spots, toxicity

ODD = ["", "plain", "  two  spaces ", "ﬁne ﬂow", "Ａｂｃ１２３", "é é ö", "①②③ ㍿", "한국어 글", "　wide　", "½ ¼", "\t tab\nline", "😀 👩‍👩‍👧", "ｶﾞｷﾞ", "Ⅷ ⅷ", " nbsp ", "a​b", "ΑΒΓ ςσ", "İstanbul ẞ", "x" * 500, "ͅ", "ﷺ", "…‥", "™℠", "１́"]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf"])
def test_compiled_map_walk(rule):
    """The walk through the library's own compiled maps: normalised length, and sources that lead back to what was replaced."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    own = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(own.serialized_model_proto())
    spec = proto.normalizer_spec
    assert spec.precompiled_charsmap
    walk = pieces.Normalizer(spec)
    for text in ODD:
        data = text.encode()
        out, at = b"", 0
        while at < len(data):
            piece, width = walk.longest(data, at)
            out, at = out + piece, at + width
        length, source = walk(data)
        plain = own.normalize(text)
        assert out.decode().split() == plain.replace("▁", " ").split(), text
        assert length == len(plain.encode()) and len(source) == length + 1 and source[-1] <= len(data) and (np.diff(source) >= 0).all(), text


def chains(text: str) -> set:
    """Spot signatures as tuples, by a walk over the words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({k: k + 32 for k in range(65, 91)}))
    common = [w in set(spots.ANCHORS) for w in words]
    anchors = {k for k, c in enumerate(common) if c}
    runs = itertools.groupby(range(len(words)), key=lambda k: common[k])
    for c, group in runs:
        group = list(group)
        if not c and (len(group) > spots.STRETCH or len(group) == len(words)):
            anchors |= {k for k in group if k - group[0] >= spots.CHAIN - 1}
    out = set()
    for k in [None, *sorted(anchors)]:
        after = [w for j, w in enumerate(words) if not common[j] and (k is None or j > k)][: spots.CHAIN]
        if k is None and words:
            out.add((None, *after, *[None] * (spots.CHAIN - len(after))))
        elif k is not None and after:
            out.add((words[k], *after, *[None] * (spots.CHAIN - len(after))))
    return out


def test_fingerprints_match_chains_by_hand():
    rnd = random.Random(5)
    vocab = [*spots.ANCHORS[:12], *[f"w{k}" for k in range(40)], "É", "x1"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 80))) for _ in range(80)] + [" ".join(f"v{k}" for k in range(30)), "the", "the the", "one", "the one", "one two three", "a " + " ".join(f"u{k}" for k in range(20))]
    found = list(spots.spot_sets(pa.array(texts, pa.large_string())))
    for t, f in zip(texts, found, strict=True):
        assert len(f) == len(chains(t)), t
    for (s, a), (t, b) in itertools.combinations(zip(texts[:30], found[:30], strict=True), 2):
        assert len(np.intersect1d(a, b)) == len(chains(s) & chains(t))


def test_similar_spots_find_what_brute_force_finds(spark):
    rnd = random.Random(6)
    base = [[rnd.choice(["the", "of", "a", *[f"w{k}" for k in range(60)]]) for _ in range(rnd.choice([8, 40, 150]))] for _ in range(25)]
    texts = [None, ""]
    for w in base:
        for _ in range(rnd.randint(1, 5)):
            copy = list(w)
            for _ in range(rnd.choice([0, 1, len(w) // 25])):
                copy[rnd.randrange(len(copy))] = "z"
            texts.append(" ".join(copy))
    sets = [chains(t or "") for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n long, rep string")
    got = {r.doc_id: r.component_id for r in spots.similar_spots(docs).collect()}
    assert got == {k: top(k) for k in range(len(texts))}


def test_rank_order_distance_by_hand():
    def profile(text: str) -> list[str]:
        s = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        seen = [s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)]
        seen = [g for g in seen if g != " "]
        count = {g: seen.count(g) for g in set(seen)}
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return sorted(count, key=lambda g: (-count[g], code(g)))[: language.PLACES]

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    train = {"de": "der die das und nicht ein eine mit von zu auf " * 4, "en": "the of and to in that is was for it with " * 4, "fr": "le la les et de des que qui dans pour une " * 4}
    own = language.Profiles({k: [code(g) for g in profile(t)] for k, t in train.items()})
    for text in ["der mann und die frau", "the man and the dog", "le chat et la souris", "x", "Ünder 12 the", "zz top"]:
        mine = profile(text)
        far = []
        for name in own.names:
            place = {g: k for k, g in enumerate(profile(train[name]))}
            far.append(sum(abs(place[g] - k) if g in place else language.PLACES for k, g in enumerate(mine)))
        assert language.ranked(*language.grams(text)).tolist() == [code(g) for g in mine]
        assert own.distances(language.ranked(*language.grams(text))).tolist() == far
        assert own.best(text)[0] == own.names[int(np.argmin(far))]


def test_ties_go_to_the_first_language(spark):
    own = language.Profiles({"b": [97, 98], "a": [97, 98], "c": [99]})
    assert own.best("ab")[0] == "a" and own.best("12 …") == ("und", 0.0) and own.best(None) == ("und", 0.0)
    docs = spark.createDataFrame([(k, "der hund und die katze" if k % 2 else "the dog and the cat", "de" if k % 2 else "en", 1, "x") for k in range(60)] + [(99, "un chat noir et blanc", "fr", 1, "x"), (100, None, None, 1, "x")], "doc_id long, text string, lang string, score long, held_out string")
    rows = {r.doc_id: r.lang_pred for r in language.identified(docs).collect()}
    assert all(rows[k] == ("de" if k % 2 else "en") for k in range(60)) and rows[100] == "und"


def test_a_rare_language_has_a_profile(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 5)
    docs = spark.createDataFrame([(k, "the dog and the cat of the house", "en") for k in range(3000)] + [(k, "el perro y el gato de la casa", "es") for k in range(3000, 3004)], "doc_id long, text string, lang string")
    assert language.learn(docs).names == ["en", "es"]


def test_additive_scores_by_hand():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)))
    assert model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.75
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        codes = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.base + sum(t[c] for t, c in zip(model.tables, codes, strict=True)) + sum(t[codes[a], codes[b]] for a, b, t in model.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        old, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def test_scores_of_finds_by_hand():
    """Features and score of a text from plain edit distances over all terms and words."""
    terms = ["idiot", "worthless", "scum", "abcde*"]
    own = toxicity.Lexicon(terms)
    texts = ["You idiot and idiott!", 'he said "idiot" to me', "worthles wurthles scum scam", "abcdefgh is", "", "clean words only", "«scum» is a word", "IDIOT IDIOT idot"]
    for text in texts:
        low, counts = text.lower(), [0, 0, 0, 0]
        words = list(re.finditer(r"[^\W\d_](?:[\w@$]*\w)?", low))
        for m in words:
            kind = 0
            if any(m[0].startswith(t[:-1]) for t in terms if t.endswith("*")):
                kind = 3
            elif m[0] in terms:
                kind = 1
            elif any(0 < distance(m[0], t) <= toxicity.edits(t) for t in terms if not t.endswith("*")):
                kind = 2
            if kind:
                counts[3 if toxicity.quoted(low, m.start(), m.end()) else kind - 1] += 1
        got = own.features(text)
        assert [round(float(np.expm1(v))) for v in got[:4]] == counts, text
        assert got[4] == pytest.approx(min(5.0, 100 * sum(counts[:3]) / len(words)) if words else 0.0) and got[5] == 1.0


def test_clashing_columns_and_ties(spark):
    """Extra columns named as inside ones, repeated rows, rows of several labels, empty tables."""
    texts = ["good prose of a calm day. " * 8, "!!! ### |||| $$$ " * 9, "you idiot scum", None, ""]
    rows = [(k, texts[k % 5], 0.5, 7, "x", True) for k in range(120)] + [(3, texts[0], 0.5, 7, "x", True)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label long, x string, held_out boolean")
    labels = spark.createDataFrame([(k, int(k % 5 == 0), int(k % 5 == 2), "z") for k in range(120)] * 2 + [(None, 1, 1, "z"), (0, None, None, "z"), (5, 0, 0, "z")], "doc_id long, quality int, toxic int, text string")
    for run, n in ((quality.scored, 4), (toxicity.scored, 5)):
        got = run(docs, labels)
        assert len(got.columns) == n and got.count() == len(rows)
        same = {}
        for r in got.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
            same.setdefault(r.doc_id, set()).add(r.score)
        assert run(docs.limit(0), labels).count() == 0 and run(docs, labels.limit(0)).count() == len(rows)
