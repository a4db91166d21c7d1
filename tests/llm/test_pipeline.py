import hashlib
import math
import re
from collections import Counter

import corpus_pipeline as C
import pytest
import test_decontamination
import test_mixing
import test_simhash
import test_tokens

from sparvane.llm import toxicity
from sparvane.llm.common import materialize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def states(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in C.STAGES:
        after = materialize(stage(spark, docs, DATA), name)
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_return_documents(states):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(states) == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert all(after.columns == columns for _, after in list(states.values())[:-1])


def test_toxicity_by_plain_lookup(spark, states):
    before, after = states["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    decoder, weight = toxicity.Decoder(model.costs), dict(zip(model.grams, model.weights.tolist(), strict=True))
    kept = []
    for r in before.collect():
        held = set().union(*(toxicity.ngrams(w) for w in decoder.restore(r.text or "").split()))
        if 1 / (1 + math.exp(-(model.bias + sum(weight[g] for g in sorted(held & weight.keys()))))) < 0.5:
            kept.append(r.doc_id)
    assert ids(after) == sorted(kept)


def test_near_duplicates_by_all_pairs(states):
    before, after = states["near_duplicates"]
    rows = before.collect()
    named = test_simhash.brute([test_simhash.plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert ids(after) == sorted({int(component) for _, _, component in named})


def test_decontamination_by_all_windows(spark, states):
    before, after = states["decontamination"]
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    found = test_decontamination.brute([(r.doc_id, r.text) for r in before.collect()], bench)
    assert ids(after) == sorted(int(i) for i, _, hit, _ in found if not hit)


def test_mixing_by_sorting(states):
    before, after = states["mixing"]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = {}
    for r in before.collect():
        by.setdefault(r.source, []).append((int(md5(f"{r.doc_id}:{md5(r.text or '')}:mix")[:15], 16), r.doc_id, r.text))
    targets = test_mixing.levels({s: sum(len(words(t)) for *_, t in rows) for s, rows in by.items()})
    want = Counter()
    for s, rows in by.items():
        total, left = sum(len(words(t)) for *_, t in rows), math.floor(targets[s] + 1e-9)
        while left > 0:
            for _, i, t in sorted(rows):
                own = words(t)[: max(0, left)] if left < total else words(t)
                if own or (left > 0 and not words(t)):
                    want[i, " ".join(own)] += 1
                left -= len(own)
            if not total:
                break
    got = Counter((r.doc_id, " ".join(words(r.text))) for r in after.collect())
    assert {k: n for k, n in got.items() if k[1]} == {k: n for k, n in want.items() if k[1]}


def test_tokens_by_the_library(states):
    before, after = states["tokens"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    got = sorted(map(tuple, after.collect()))
    want = test_tokens.want(rows)
    # copies of one document may come in either order, and a cut one is another text
    assert Counter((i, n, crc) for i, _, n, crc in got) == Counter((i, n, crc) for i, _, n, crc in want)
    places = sorted((start, n) for _, start, n, _ in got)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert [i for i, *_ in sorted(got, key=lambda r: r[1])] == [i for i, _ in rows]


def test_run(spark, states):
    assert sorted(map(tuple, C.run(spark, DATA).collect())) == sorted(map(tuple, states["tokens"][1].collect()))


def test_a_stage_takes_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = ("score", "_id", "_digest", "_key", "_rest", "digest", "kept", "taken", "ids")
    for name in names:
        docs = docs.selectExpr("*", f"doc_id as `{name}`")
    for _, stage in C.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), "clash")
        assert docs.columns[-len(names) :] == list(names) and docs.filter("score <> doc_id or ids <> doc_id").count() == 0
    assert C.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
