import hashlib
import math
import random
import re
from collections import Counter

import regex

from sparvane.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def base(t):
    found = [(m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(RULES) for m in re.finditer(p, t or "") if ok(m[0])]
    return sorted(found)


def card(rng, valid):
    while True:
        c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(c) == valid:
            return c


def test_base_spans(spark, edge_rows):
    rng = random.Random(3)
    parts = ["a", "1", "23", "@", ".", "-", "+", "+1", "(", " ", "é", "\U0001f600", "4111111111111111", "255", "256", "x@y.z", "1.2.3.4", "\n", "_", "%", ")", "0000001"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    rows += [(5001, "1" * 50_000), (5002, "a" * 50_000), (5003, "1 " * 20_000), (5004, "1." * 20_000), (5005, "+1" * 20_000), (5006, "a" * 30_000 + "@b.c")]
    rows += [(6000 + i, r[1]) for i, r in enumerate(edge_rows)]
    texts = dict(rows)
    for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        want = base(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), r.doc_id
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in want) for k in pii.KINDS]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_contexts_find_what_rules_miss(spark):
    rng = random.Random(5)
    rows = [(i, f"words here cardno {card(rng, i % 20 != 0)} more text {i % 7}") for i in range(200)]
    rows += [(1000 + i, f"order {card(rng, False)} for you") for i in range(50)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if len(r.spans) > len(r.base)} == set(range(0, 200, 20))


def test_contexts_find_formats_no_seed_has(spark):
    rng = random.Random(7)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    new = {
        "phone": [f"(017) 555-{d(4)}" for _ in range(15)] + [f"0{d(2)}/{d(7)}" for _ in range(5)],
        "email": [f"jörg{i}@mail.example.com" for i in range(10)] + [f"rené{i}@localhost" for i in range(10)],
        "ip": [f"fe80::{i + 1}ff:fe23:45{i}" for i in range(20)],
        "card": [f"4{d(3)}/{d(4)}/{d(4)}/{d(4)}" for _ in range(20)],
    }
    seeds = {"phone": lambda i: f"+1 (743) 555-{1000 + i}", "email": lambda i: f"ann.{i}@mail.example.com", "ip": lambda i: f"10.1.{i}.7", "card": lambda i: card(rng, True)}
    texts = [(f"please use {k} {x} from now", k, x) for k, xs in new.items() for x in xs]
    other = [f"please use {k} {seeds[k](i)} from now" for k in new for i in range(40)]
    other += [f"please use {k} {n} times now" for k in new for n in range(2)]
    other += [f"written on {i % 28 + 1:02}/{i % 12 + 1:02}/{2000 + i % 20} by hand" for i in range(400)] + ["please use phone 12/11/2031 in time"]
    other += [f"order {d(8)} is sent" for _ in range(50)]
    rows = list(enumerate([x[0] for x in texts] + other))
    added = {(r.doc_id, s.kind, rows[r.doc_id][1][s.start : s.end]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if s not in r.base}
    assert added == {(i, k, x) for i, (_, k, x) in enumerate(texts)}


def shape(x):
    if re.search("[0-9]", x) and re.search("[A-Za-z]", x):
        if re.fullmatch("[0-9A-Fa-f]{8,}", x):
            return f"hex{len(x)}"
        if re.fullmatch("[0-9A-Za-z_+/=-]{12,}", x):
            return f"mix{len(x) - len(x) % 4}"
    return re.sub("[0-9]", "9", regex.sub(r"\p{L}+", "a", x))


def may(x, kind):
    n = len(digits(x))
    like = {
        "email": re.fullmatch(r"[^\s@,;:/<>()]+@[^\s@,;:/<>()]+", x), "ip": re.fullmatch(r"[0-9A-Fa-fx]*+(?:[^\s0-9A-Za-z@]++[0-9A-Fa-f]*+){2,}", x), "card": 7 <= n <= 19, "phone": 7 <= n <= 15,
        "secret": re.fullmatch(r"\S{8,}", x) and re.search("[0-9]", x) and regex.search(r"\p{L}", x),
    }[kind]
    return bool(like) and not any(k == kind and re.fullmatch(p, x) for k, p, _ in RULES) and (kind in ("email", "secret") or "@" not in x)


def brute_spans(texts, rounds=3, sure=0.8, support=3, unknown=0.1):
    """find() by dictionaries: texts by number to sets of (kind, start, end)."""
    cands, bases = [], {}
    for row, t in texts.items():
        bases[row] = [(k, a, b) for a, _, b, k in base(t)]
        found = list(re.finditer(pii.CANDIDATE, t))
        for i, m in enumerate(found):
            before, after = t[found[i - 1].end() if i else 0 : m.start()], t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)]
            last = re.search(r"(?:^|(?<=\s))(\S+(?:\s+[=:]+>?)?)\s*$", before)
            left, right = "".join(last[1].split()) if last else "", (after.split() or [""])[0]
            x, at = m[0], m.start()
            label = re.match(r"([A-Za-z_-]+[=:]+)[^=:\s]", x)
            if label:
                left, x, at = label[1], x[len(label[1]) :], at + len(label[1])
            lead = re.match(r"""(?:(?!\([0-9]++\)[ /.-]?[0-9])[(\[<{"'“„«])*""", x)[0]
            x, at = x[len(lead) :], at + len(lead)
            inside = re.match("""([^"'”“»]+)["'”“»]""", x)
            quoted = lead[-1:] in ('"', "'", "“", "„", "«") and lead
            x = inside[1] if quoted and inside else x.rstrip(""")\\]>}"'”“»,;:!?.""")
            if x:
                cands.append((row, at, at + len(x), x, shape(x), left.lower() + ('"' if quoted and left else ""), right.lower()))
    rules = {}
    for row, a, b, x, *_ in cands:
        for k, c, d in bases[row]:
            if (a, b) == (c, d):
                rules[x] = min(rules.get(x, k), k)
    known = dict.fromkeys(rules, 1.0)
    kind = dict(rules)
    for _, _, _, x, sh, left, _ in cands:
        if x not in rules and sh[:3] in ("hex", "mix") and len(x) >= 16 and re.fullmatch(f"(?:{'|'.join(pii.LABELS)})[=:]+>?\"?", left):
            known[x], kind[x] = 1.0, "secret"
    seeds = dict(kind)
    edges = Counter((w, sh, x) for *_, x, sh, left, right in cands for w in (f"<{left}", f">{right}") if len(w) > 1)
    shapes = Counter(sh for sh, _ in {(sh, x) for _, sh, x in edges})
    best = {}
    for _ in range(rounds):
        total, mass, seen, words = Counter(), Counter(), Counter(), {}
        for (w, sh, x), n in edges.items():
            total[w, sh] += n
            if x in known:
                mass[w, sh, kind[x]] += n * known[x]
                seen[w, sh, kind[x]] += 1
            for k in pii.ALL:
                s = words.setdefault((w, k), [0.0, 0.0, 0])
                if kind.get(x) == k:
                    s[0], s[2] = s[0] + n * known[x], s[2] + 1
                else:
                    s[1] += n * (unknown if x not in kind and may(x, k) else 1)
        doubt, inside = {}, {}
        for (w, sh, k), m in mass.items():
            p = m / total[w, sh]
            if seen[w, sh, k] >= support and p >= sure:
                for (w2, sh2, x) in edges:
                    if (w2, sh2) == (w, sh):
                        doubt[x, k] = doubt.get((x, k), 0.0) + math.log1p(-min(p, 0.999))
        for (w, k), (m, against, n) in words.items():
            if n >= support and m / (m + against) >= sure:
                for (w2, sh, x) in edges:
                    if w2 == w:
                        inside[x, sh, k] = inside.get((x, sh, k), 0.0) + math.log1p(-min(m / (m + against), 0.999))
        scored = [(1 - math.exp(d), k, x) for (x, k), d in doubt.items()]
        own = Counter(kind[x] for x in known)
        share = Counter(k for x, _, k in inside if kind.get(x) == k)
        fits = Counter((sh, k) for _, sh, k in inside)
        for (x, sh, k), d in inside.items():
            if may(x, k) and share[k]:
                scored.append(((1 - math.exp(d)) * min(1.0, 4 * fits[sh, k] / shapes[sh] / (share[k] / own[k])), k, x))
        best = {}
        for c, k, x in sorted(scored):
            if c >= sure:
                best[x] = (c, k)
        kind = seeds | {x: k for x, (_, k) in best.items() if x not in seeds}
        known = dict.fromkeys(seeds, 1.0) | {x: c for x, (c, _) in best.items() if x not in seeds}
    out = {row: set(b) for row, b in bases.items()}
    for row, a, b, x, *_ in cands:
        if x in best and x not in rules:
            k = best[x][1]
            ends = lambda c, d: (x[c - a - 1] if c > a else "") + (x[d - a : d - a + 1] if d < b else "")  # noqa: B023, E731
            cut = lambda q, c, d: q == k and a <= c and d <= b and regex.search(r"[\p{L}\p{M}\p{N}]", ends(c, d))  # noqa: B023, E731
            if all(cut(q, c, d) or b <= c or d <= a for q, c, d in bases[row]):
                out[row].add((k, a, b))
    return out


def test_against_brute_force(spark):
    rng = random.Random(13)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = [lambda: f"+1 (743) 555-{d(4)}", lambda: f"(017) 555-{d(4)}", lambda: f"ann{d(2)}@mail.example.com", lambda: f"jörg{d(2)}@mail.example.com", lambda: f"10.1.{rng.randint(0, 255)}.7", lambda: f"300.1.{d(2)}.7", lambda: card(rng, True), lambda: card(rng, False), lambda: hexed(40), lambda: f"sk_{hexed(9)}!{d(3)}", lambda: d(6), lambda: f"{d(2)}/{d(2)}/20{d(2)}"]
    frames = ["call {} now", "mail {}, please", "host {} is up", "card {} was used", 'token = "{}" is set', "token={} and", "Secret: '{}'###", 'auth = "{}"', "see {} there", "({})"]
    usual = [0, 2, 4, 6, 8, 8, 8, 9, 10, 11]
    texts = {}
    for i in range(260):
        parts = []
        for _ in range(rng.randint(1, 3)):
            f = rng.randrange(len(frames))
            parts.append(frames[f].format(made[usual[f] + (rng.random() < 0.15) if rng.random() < 0.9 and usual[f] < 11 else rng.randrange(len(made))]()))
        texts[i] = rng.choice(["", "word ", "x\n"]) + rng.choice([" ", " und ", "\n"]).join(parts)
    want = brute_spans(texts)
    rows = pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in rows}
    assert got == want
    added = Counter(k for r in rows for k, a, b in got[r.doc_id] if (k, a, b) not in {(s.kind, s.start, s.end) for s in r.base})
    assert added["secret"] > 20 and sum(added.values()) > added["secret"]


def test_secrets_come_from_their_contexts(spark):
    rng = random.Random(11)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    odd = ['9!xk-{}'.format(key(6)) for _ in range(5)]
    rows = [f'before token = "{key(40)}" after' for _ in range(30)] + [f'some token = "{key(40)}"### more' for _ in range(5)] + [f'before token = "{x}" after' for x in odd]
    rows += [f"commit {key(40)} was made" for _ in range(30)]  # hashes in another context are no secrets
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in pii.find(df).collect():
        found = [(s.kind, rows[r.doc_id][s.start : s.end]) for s in r.spans]
        assert found == ([("secret", rows[r.doc_id].split('"')[1])] if r.doc_id < 40 else [])
    # two occurrences are too few to make a pattern
    assert all(not r.spans for r in pii.find(df.filter("doc_id < 2")).collect())


def test_long_words_beside_a_candidate_stay_whole(spark):
    long = "w" * 100
    rows = [f"{long}{'ab'[i % 2]} {' ' * 200}{'4' if i % 2 else '5'}{i:03d}@@x.y" for i in range(40)]
    _, spans = pii._located(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r.left for r in pii._candidates(spans).collect()} == {f"{long}a", f"{long}b"}


def test_plan_stays_in_the_jvm(edge_docs):
    plan = pii.find(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark, edge_docs, no_docs):
    rows = [(None, "mail a@b.c"), (1, "mail a@b.c"), (1, "mail a@b.c"), (2, None), (3, ""), (4, "x" * 100_000 + " 1.2.3.4"), (5, " ")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, row int, kind int")
    got = sorted(((str(r.doc_id), r.n_email, r.n_ip, r.spans, r.n_spans) for r in pii.digests(pii.find(df)).collect()))
    assert got == [("1", 1, 0, "email:5:10", 1), ("1", 1, 0, "email:5:10", 1), ("2", 0, 0, "", 0), ("3", 0, 0, "", 0), ("4", 0, 1, "ip:100001:100008", 1), ("5", 0, 0, "", 0), ("None", 1, 0, "email:5:10", 1)]
    assert {(r.n_spans, r.spans) for r in pii.digests(pii.find(edge_docs)).collect()} == {(0, "")} and pii.find(edge_docs).count() == edge_docs.count()
    assert pii.find(no_docs).count() == 0


def test_rounds_end_when_nothing_new_is_known(spark, monkeypatch):
    """What a round knows decides the next one, so rounds after one that learnt nothing are not run; one that learns is followed by another."""
    made, plain = [], pii.materialize
    monkeypatch.setattr(pii, "materialize", lambda df, name: made.append(name) or plain(df, name))
    rng = random.Random(5)
    texts = [f"pay card {card(rng, True)} now" for _ in range(12)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert made.count("pii-best") == 1 and all(len(r.spans) == 1 for r in found)
    made.clear()
    texts += [f"pay card {card(rng, False)} now" for _ in range(2)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert made.count("pii-best") > 1 and all(len(r.spans) == 1 for r in found)
