import itertools
import math
import random
import zlib

import numpy as np
import pytest

from sparvane.llm import queries, textstats, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder(spark):
    english = "the idiot and the moron had a stupid worthless clown that is pathetic trash so disgusting to see " * 50
    df = spark.createDataFrame([(1, english), (2, None)], "doc_id long, text string")
    return toxicity.Decoder(toxicity.model_costs(toxicity.count_trigrams(df)))


@pytest.mark.parametrize("seen,meant", [("1d10t", "idiot"), ("m0r0n", "moron"), ("stup!d", "stupid"), ("tra$h", "trash"), ("wooorthless", "worthless"), ("p.a.t.h.e.t.i.c", "pathetic"), ("c l o w n", "clown"), ("d1sgust1ng!!", "disgusting"), ("the&&&", "the"), ("42", "")])
def test_readings(decoder, seen, meant):
    assert decoder.restore(seen) == meant


def test_plain_words_have_one_reading(decoder):
    assert decoder.restore("The Moron, see (idiot).\nBooks") == "the moron see idiot books"


@pytest.fixture(scope="module")
def rude(spark):
    text = "the idiot and the moron had a stupid clown that is shit and an ass so see the good book and all the letters of a happy week " * 50
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return toxicity.Decoder(toxicity.model_costs(toxicity.count_trigrams(df)))


@pytest.mark.parametrize("seen,meant", [("5h17", "shit"), ("1d107", "idiot"), ("a55", "ass"), ("@$$", "ass"), ("iidiioott", "idiot"), ("mmoorroonn", "moron"), ("sshhiitt", "shit"), ("11d1100tt", "idiot")])
def test_readings_of_few_letters_and_doubled_letters(rude, seen, meant):
    assert rude.restore(seen) == meant


@pytest.mark.parametrize("seen", ["42", "1,000.50", "$100", "12/05/2024", "+1", "555-1234", "|", "@", "$$$", "!!!", "++"])
def test_numbers_and_lone_signs_are_no_words(rude, seen):
    assert rude.restore(seen) == ""


def test_doubled_letters_of_words_stay(rude):
    text = "see the good book and all the letters of a happy week"
    assert rude.restore(text) == text


@pytest.mark.parametrize("seen,meant", [
    ("s t u p i d.", "stupid"), ("a s t u p i d, idiot", "a stupid idiot"), ("s t u p i d! see", "stupid see"), ('"s t u p i d"', "stupid"), ("(s.t.u.p.i.d)", "stupid"),
    ("s  t  u  p  i  d", "stupid"), ("s\tt\tu\tp\ti\td", "stupid"), ("s\nt\nu\np\ni\nd", "stupid"), ("s - t - u - p - i - d", "stupid"),
    ("s t u p i d   c l o w n", "stupid clown"), ("s t  u p i d", "stupid"), ("the 5 7 u p 1 d?", "the stupid"), ("1  2\n3", ""),
])
def test_readings_of_spaced_words(rude, seen, meant):
    assert rude.restore(seen) == meant


def test_spaced_runs_take_linear_time(rude):
    for text in ("a " * 30_000 + "ab", "a" + " -" * 50_000, "a." * 30_000 + "bc", "-" * 100_000, "a " * 2 + "\n" * 100_000):
        assert isinstance(rude.restore(text), str)


@pytest.mark.parametrize("kind", ["wow" + "!" * 1_000_000, "a!" * 500_000, "$" * 500_000 + "ab" * 250_000, "aabbccdd" * 125_000, "ab" + "?" * 1_000_000, "QUJD0kZ+x/9a" * 83_000])
def test_a_token_takes_linear_time(rude, kind):
    import time

    began = time.time()
    assert isinstance(rude.restore(kind), str)
    assert time.time() - began < 20


def test_a_scorer_remembers_a_bounded_number_of_bytes(rude, monkeypatch):
    model = toxicity.Model(np.array(rude.costs), ["^idi"], np.array([9.0]), -4.0)
    scorer, fresh = toxicity.Scorer(model), toxicity.Scorer(model)
    monkeypatch.setattr(toxicity, "_MOST", 60_000)
    for i in range(60):
        texts = [f"idiot {'x' * 3000}{chr(97 + i % 26)}y{chr(97 + j)} idiots" for j in range(8)]
        assert scorer.score(texts).tolist() == fresh.score([texts[0]]).tolist() * 8
        held = sum(map(toxicity._held_bytes, scorer.clean | scorer.hot.keys()))
        assert held <= scorer.size <= 60_000


def test_one_id_with_many_texts(spark):
    """Repeated rows count once, and different texts of one id are bounded as rows."""
    hot = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5)
    rows = [(hot, f"the idiot number {i % 3000} is here") for i in range(9000)] + [(i, "the good book of a week") for i in range(200, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = textstats.bounded_texts(df, 500, "t")
    assert 350 < own.count() < 650 and textstats.bounded_texts(df, 10**6, "t").count() == 3000 + 1800
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, textstats.bounded_texts(df.repartition(7), 500, "t").collect()))
    model = toxicity.train(df, spark.createDataFrame([(i, int(i == hot)) for i in [hot, *range(200, 2000)]], "doc_id long, toxic int"), most_rows=4000)
    assert model.grams and toxicity.Scorer(model).score(["the idiot is here", "the good book", ""]).round().tolist() == [1.0, 0.0, 0.0]


def test_trigram_counts(spark):
    n = toxicity.count_trigrams(spark.createDataFrame([(1, "abc"), (2, "ab")], "doc_id long, text string")).reshape(64, 64, 64)
    assert n[1, 2, 3] == 1 and n[0, 1, 2] == 2 and n[2, 0, 0] >= 1


def reading_costs(decoder, text, spaced, doubled):
    """Cost of every reading, least first by reading."""
    best = {}
    for way in itertools.product(*(decoder.options(text, i, spaced, doubled) for i in range(len(text)))):
        a = b = 0
        cost = sum(more for _, more in way)
        for x, _ in way:
            if x:
                c = toxicity._class(x)
                cost += decoder.costs[(a * toxicity.CLASSES + b) * toxicity.CLASSES + c]
                a, b = b, c
        cost += decoder.costs[(a * toxicity.CLASSES + b) * toxicity.CLASSES]
        reading = "".join(x for x, _ in way)
        best[reading] = min(cost, best.get(reading, cost))
    return best


def test_viterbi_against_all_readings(rude):
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("iidoottsa015@$!|.-e\n" if rng.random() < 0.7 else "abcdefgh ") for _ in range(rng.randint(1, 7)))
        for spaced, doubled in ((False, False), (True, False), (False, True)):
            cost, reading = rude.best(text, spaced, doubled)
            every = reading_costs(rude, text, spaced, doubled)
            assert cost == pytest.approx(min(every.values())) and every[reading] == pytest.approx(cost)


def test_one_double_is_read_as_by_the_lattice(rude):
    rng = random.Random(6)
    undone = 0
    for _ in range(3000):
        word = "".join(rng.choice("idotshaeeé") for _ in range(rng.randint(1, 8))) if rng.random() < 0.5 else rng.choice(["idiot", "moron", "stupid", "clown", "shit"])
        at = rng.randrange(len(word))
        word = word[:at] + word[at] + word[at:]
        cost, reading = rude.best(word)
        other, short = rude.best(word, doubled=True)
        want = short if other + toxicity.DOUBLED < cost else reading
        assert rude.token(word) == want
        undone += want != word
        if not toxicity._TRIPLE.search(word):
            assert rude.line_cost(word) == pytest.approx(cost)
    assert undone > 100


def test_scores_against_plain_lookup(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    decoder, weight = toxicity.Decoder(model.costs), dict(zip(model.grams, model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert weight and len(got) == len(texts)
    for i, t in texts.items():
        held = set().union(*(toxicity.ngrams(w) for w in decoder.restore(t or "").split()))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(w for g, w in weight.items() if g in held)))))
    below = {r.doc_id for r in toxicity.without_toxic(docs, model, 0.5).collect()}
    assert below == {i for i, s in got.items() if s < 0.5}


def test_held_out_toxicity(spark):
    lab = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op4_toxicity(spark, DATA).filter("held_out").join(lab, "doc_id").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.85


def test_edges(spark, edge_docs, no_docs, labels):
    model = toxicity.train(edge_docs, labels)
    out = toxicity.score(edge_docs, model)
    assert out.count() == edge_docs.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).count() == 0
    assert len({r.score for r in toxicity.score(edge_docs, toxicity.train(edge_docs, labels.limit(0))).collect()}) == 1
    kept = toxicity.without_toxic(edge_docs, model, 2.0)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() and toxicity.without_toxic(edge_docs, model, 0.0).count() == 0
    assert toxicity.deobfuscate(edge_docs, model).count() == edge_docs.count()
