"""Language identification and the quality classifier: held-out accuracy, brute force and edge cases."""

import numpy as np
import pyarrow as pa

from loamspark.llm import language_id, quality_classifier
from pyspark.sql import functions as F

from loamspark.llm.linear_text import bags, bounded_bags, byte_grams, char_grams, mean_scores

SCHEMA = "doc_id long, text string, lang string, family string, p_good string"
MEDIUM = "/root/testdata/sf0.1"


def test_byte_grams_against_slices():
    texts = ["ab c", "", "é", "abc  abd"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    for n in (1, 2, 3):
        bucket, row = byte_grams(data, offsets, n, 12)
        want = [(r, t.encode()[i : i + n]) for r, t in enumerate(texts) for i in range(len(t.encode()) - n + 1)]
        assert row.tolist() == [r for r, _ in want]
        same = {}
        for b, (_, g) in zip(bucket.tolist(), want):
            assert same.setdefault(g, b) == b


def test_mean_score_is_the_bag_times_the_weights():
    texts = pa.array(["one two two", "", None, "Größe "])
    weights = np.random.default_rng(1).standard_normal((quality_classifier.BUCKETS, 2))
    index, share = bags(texts, quality_classifier.features, quality_classifier.BUCKETS)
    (a, b, mean, count), = mean_scores(texts, quality_classifier.features, weights)
    assert (a, b) == (0, 4) and count[1] == count[2] == 0
    for r in range(4):
        assert np.allclose(mean[r], share[r] @ weights[index[r]] if len(index[r]) else 0, atol=1e-5)


def test_char_grams_against_slices():
    texts = ["ab c", "", "é", "größe  über", "日本語 abc", "𝄞𝄞𝄞x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    for n in (3, 4):
        bucket, row = char_grams(data, offsets, n, 30)
        grams = [(r, t[i : i + n]) for r, t in enumerate(texts) for i in range(len(t) - n + 1)]
        want = [(r, g) for r, g in grams if " " not in g[1:-1]]
        assert row.tolist() == [r for r, _ in want]
        same = {}
        for b, (_, g) in zip(bucket.tolist(), want):
            assert same.setdefault(g, b) == b
        assert len(set(same.values())) == len(same)
        # the same in a chunk of ASCII only
        plain, _ = char_grams(np.frombuffer(b"abc abcd", np.uint8), np.array([0, 8]), n, 30)
        assert "abcd"[:n] not in same or same["abcd"[:n]] in plain.tolist()


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    # equal texts are on the same side
    side = F.pmod(F.xxhash64("text"), F.lit(2))
    model = language_id.train(docs.filter(side == 0), 200)
    rows = language_id.languages(docs.filter(side == 1), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) > 4_000
    assert (rows.predicted == rows.lang).mean() > 0.97
    family = {x: f for f, of in language_id.FAMILIES.items() for x in of}
    assert (rows.family == rows.lang.map(family)).mean() > 0.98


def test_training_rows_are_bounded(spark):
    text = "the of and to in a word "
    one = spark.range(5000).selectExpr("cast(7 as long) as doc_id", "concat('word ', id % 3, ' and so on') as text", "'en' as lang")
    other = spark.range(900).selectExpr("id + 100 as doc_id", "concat('wort ', id) as text", "'de' as lang")
    few = spark.createDataFrame([(8, text, "en"), (9, text * 100_000, "en"), (None, text, "en"), (10, " ", "en"), (11, text, "xx")], "doc_id long, text string, lang string")
    docs = one.union(other).union(few)
    labels, index, share = bounded_bags(docs.filter("lang <> 'xx'"), docs.filter("lang <> 'xx'").select("doc_id", "lang"), ["doc_id", "lang"], "lang", 800, language_id.features, 1 << language_id.BITS)
    assert {x: (labels == x).sum() for x in set(labels)} == {"en": 800, "de": 800}
    assert len(index) == len(share) == 1600 and max(map(len, index)) <= 1 << language_id.BITS
    marked = docs.selectExpr("doc_id", "int(lang = 'en') as quality")
    classes, index, _ = bounded_bags(docs.select("doc_id", "text"), marked, ["doc_id"], "quality", 50, quality_classifier.features, quality_classifier.BUCKETS)
    assert {x: (classes == x).sum() for x in set(classes)} == {"0": 50, "1": 50}


def test_votes_against_counting_them():
    rng = np.random.default_rng(4)
    langs = np.array(["en", "de", "fr", "es", "it", "nl"] * 4, dtype=object)
    index = [rng.choice(1 << language_id.BITS, 30, False) for _ in langs]
    share = [np.full(30, 1 / 30, np.float32) for _ in langs]
    model = language_id.Model(index, share, langs)
    margins = np.round(rng.standard_normal((200, len(model.pairs))), 1)  # with ties and zeros
    family, lang, sure = model.predict(margins)

    def winner(row, level, names):
        votes = {x: 0.0 for x in names}
        beaten = {x: [] for x in names}
        for (at, one, other), m in zip(model.pairs, row):
            if at == level:
                for x, s in ((one, m), (other, -m)):
                    votes[x] += (1 if s > 0 else 0) + 1e-3 * float(np.tanh(s))
                    beaten[x].append(s)
        top = max(votes.values())
        name = next(x for x in names if abs(votes[x] - top) < 1e-12)
        return name, min(beaten[name])

    for i, row in enumerate(margins):
        f, _ = winner(row, "", ["germanic", "romance"])
        x, s = winner(row, f, {"germanic": ["de", "en", "nl"], "romance": ["es", "fr", "it"]}[f])
        assert (family[i], lang[i]) == (f, x) and abs(sure[i] - s) < 1e-9


def test_svm_against_a_loop_over_rows():
    rng = np.random.default_rng(5)
    x = rng.random((70, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.2 * x[:, 1] > 0.6, 1, -1)
    got = language_id.train_svm(x, y, np.random.default_rng(1))
    order, w, total, t = np.random.default_rng(1), np.zeros(7), np.zeros(7), 0
    rows = [np.append(r * language_id.SCALE, 1.0) for r in x.astype(np.float64)]
    cost = {s: 0.5 * len(y) / (y == s).sum() for s in (1, -1)}
    for epoch in range(language_id.EPOCHS):
        of = order.permutation(len(y))
        for a in range(0, len(y), 32):
            t += 1
            step, part = 1 / (language_id.LAMBDA * (t + 1000)), of[a : a + 32]
            add = np.zeros(7)
            for i in part:
                if y[i] * float(rows[i] @ w) < 1:
                    add += cost[y[i]] * y[i] * rows[i]
            w = w * (1 - step * language_id.LAMBDA) + step / len(part) * add
            if epoch >= language_id.EPOCHS // 2:
                total += w
    total /= max(1, np.linalg.norm(total))
    total[:-1] *= language_id.SCALE
    assert np.allclose(got, total, atol=1e-3 * np.abs(total).max())
    assert (np.sign(x @ got[:-1] + got[-1]) == y).mean() > 0.9


def test_gradients_against_differences():
    rng = np.random.default_rng(6)
    x, vectors, out, bias = rng.random((5, 7)), rng.standard_normal((7, 3)), rng.standard_normal((3, 2)), rng.standard_normal(2)
    y, weight = np.array([0, 1, 1, 0, 1]), rng.random(5)

    def loss():
        total = 0.0
        for i in range(5):
            z = [sum(sum(x[i, f] * vectors[f, d] for f in range(7)) * out[d, c] for d in range(3)) + bias[c] for c in (0, 1)]
            total += weight[i] * (np.log(np.exp(z[0]) + np.exp(z[1])) - z[y[i]]) / 5
        return total

    for of, got in zip((vectors, out, bias), quality_classifier.gradients(x, vectors, out, bias, y, weight)):
        for at in np.ndindex(of.shape):
            was = of[at]
            of[at] = was + 1e-6
            more = loss()
            of[at] = was - 1e-6
            less = loss()
            of[at] = was
            assert abs((more - less) / 2e-6 - got[at]) < 1e-6


def test_learned_numbers_are_those_of_the_network():
    # scoring by one number a feature is scoring by vectors and softmax: texts of one feature each class are told apart
    index, share = [np.array([3]), np.array([9])] * 20, [np.ones(1, np.float32)] * 40
    numbers, bias = quality_classifier.train_embeddings(index, share, np.array([0, 1] * 20))
    assert numbers[9] + bias > 2 and numbers[3] + bias < -2 and abs(numbers[100]) < 1


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    numbers, bias = quality_classifier.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality_classifier.scored(docs, numbers, bias).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.good.mean() > 0.95 and (~bad.good).mean() > 0.8


def test_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = [(None, "the of and to in", "en", None, None), (1, None, "en", None, None), (2, "", None, None, None), (3, " \n", "xx", None, None), (4, "und der die das " * 50_000, None, None, None), (5, "a", "en", "f", "p"), (5, "a", "en", "f", "p")]
    df = spark.createDataFrame(odd, SCHEMA)
    model = language_id.train(docs, 50)
    got = {(r.doc_id, r.predicted is None) for r in language_id.languages(df, model).collect()}
    assert got == {(None, False), (1, True), (2, True), (3, True), (4, False), (5, False)}
    assert language_id.languages(df, model).count() == len(odd) and language_id.languages(df.limit(0), model).count() == 0
    nothing = language_id.train(df.limit(0))
    assert all(r.predicted is None for r in language_id.languages(df, nothing).collect())
    numbers, bias = quality_classifier.train(docs, labels, 50)
    scores = quality_classifier.scored(df, numbers, bias)
    assert {(r.doc_id, r.p_good is None) for r in scores.collect()} == got
    assert scores.count() == len(odd) and quality_classifier.scored(df.limit(0), numbers, bias).count() == 0
    numbers, bias = quality_classifier.train(docs, labels.limit(0))
    assert {r.p_good for r in quality_classifier.scored(df, numbers, bias).collect()} == {0.5, None}
