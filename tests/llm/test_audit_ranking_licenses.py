import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from pixelloom.llm import audit, licenses, ranking, sharding, simhash
from pixelloom.llm.decontaminate import Matcher
from pixelloom.llm.html import main_text

DOCS = "doc_id long, text string, source string, mask int, part string, word string, key string, rid long"


def rows_of(*rows):
    return [(*r, 1, "clash", "w", "k", 5) for r in rows]


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["The", "Übung", "x-ray", "#tag", "a1"]
    out = []
    for k in range(n):
        size = rng.choice([0, 3, 30, 190, 199, 200, 201, 400])
        out.append(" ".join(rng.choice(vocabulary) + ("!" if rng.random() < 0.02 else "") for _ in range(size)))
    return out + [out[1], out[1], out[5], None, "", " \t\n", "A" * 50, "word " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    ts = texts(3, 40)
    rows = [(k if k % 9 else k // 9, t, None if k % 11 == 0 else "" if k % 11 == 1 else f"s{k % 3}") for k, t in enumerate(ts)]
    rows += [rows[4], rows[4], (None, ts[1], "s0"), (None, ts[1], "s1")]
    return spark.createDataFrame(rows_of(*rows), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_audit_equals_every_order_followed(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(0, 40, 2)] + [(2, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    marks = {}
    for r in labels.collect():
        good, toxic = marks.get(r["doc_id"], (False, False))
        marks[r["doc_id"]] = good or r["quality"] == 1, toxic or r["toxic"] == 1
    rows = docs.collect()
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(least.get(r["text"] or "", math.inf), r["doc_id"])
    facts = []
    for r in rows:
        t = r["text"] or ""
        ws = words(t)
        fails = {f for f, x in {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r["doc_id"] is not None and least[t] < r["doc_id"]}.items() if x}
        facts.append((r["source"] or "", fails, *((False, False) if r["doc_id"] is None else marks.get(r["doc_id"], (False, False)))))
    want = Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        removed_ever = Counter()
        out = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_ever[f] += len(gone)
                out.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        want.update((*o[:-1], removed_ever[o[-1]]) for o in out)
    got = Counter(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in audit.audit(docs, labels).collect())
    assert got == want
    assert audit.audit(empty, labels).count() == 0 and audit.audit(docs, labels.limit(0)).count() == sum(want.values())


def brute_ranking(rows, items, top):
    term = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    bags = [Counter(term(t)) for _, t in rows]
    n_docs, n_terms = sum(map(bool, bags)), sum(sum(b.values()) for b in bags)
    df = Counter(w for b in bags for w in b)
    out = {}
    for item, text in items:
        out[item] = out.get(item, Counter()) + Counter(term(text))
    want = []
    for item, q in out.items():
        scored = []
        for (doc, _), b in zip(rows, bags):
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // max(n_terms, 1)
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w, n in q.items() if w in b)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        want += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return Counter(want)


@pytest.mark.parametrize(("top", "shard", "passes"), [(10, 1 << 24, 1 << 20), (3, 700, 40)])
def test_ranking_equals_brute_force(spark, docs, empty, monkeypatch, top, shard, passes):
    monkeypatch.setattr(ranking, "SHARD_BYTES", shard)
    monkeypatch.setattr(ranking, "PASS_TERMS", passes)
    items = [(1, "w1 w2 the X-RAY w1"), (2, "übung Übung w59 zzz"), (3, None), (4, ""), (5, "nothing here"), (6, "w3 " * 20 + " ".join(f"w{k}" for k in range(60))), (2, "a1 w7"), (None, "w5")]
    bench = spark.createDataFrame([(*i, 1, "t") for i in items], "item_id long, text string, doc_id int, term string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranking.rank(docs.repartition(3), bench, top).collect())
    assert got == brute_ranking(rows, items, top)
    assert ranking.rank(empty, bench).count() == 0 and ranking.rank(docs, bench.limit(0)).count() == 0


def test_merge_equals_sorting():
    """Many lists of many ties, with lists that leave the heap."""
    rng = random.Random(8)
    for _ in range(300):
        lists, total = [], Counter()
        for _ in range(rng.randint(0, 7)):
            at = sorted(rng.sample(range(60), rng.randint(1, 60)))
            gains, times = [rng.choice([1, 2, 3, 50]) * rng.choice([1, 1, 100]) for _ in at], rng.randint(1, 3)
            lists.append((at, gains, max(gains), times))
            for d, g in zip(at, gains):
                total[d] += g * times
        top = rng.randint(1, 12)
        assert ranking.best(lists, top) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:top]


def test_varints_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        v = rng.integers(0, 2 ** rng.integers(1, 60, n)) if n else np.empty(0, np.int64)
        assert ranking.from_varints(ranking.varints(np.array(v, np.int64))[0].tobytes()).tolist() == list(v)
    for ids in ([], [None, None], [-5, -5, 0, 3, 2**62, None], [7]):
        assert ranking.unpacked(ranking.packed(ids)) == ids


def test_licenses_equal_brute_force(spark, docs, empty):
    notice = licenses.TEMPLATES[1][1]
    some = [notice, notice.replace("free", "gratis").replace("deal", "trade"), notice.replace("free", "x1").replace("deal", "x2").replace("copies", "x3").replace("merge", "x4").replace("publish", "x5").replace("notice", "x6").replace("associated", "x7"), "Released under the MIT%%% License. Apache\tLicense mit license mit LICENSE", "general public\nlicense", None, "", "mitlicense é", "lorem " * 500 + notice + " ipsum" * 700, "word " * 30_000 + "Licensed under the Apache License, Version 2.0."]
    rng = random.Random(4)
    for _ in range(30):
        ws = licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))][1].split()
        for _ in range(rng.randint(0, 9)):
            ws[rng.randrange(len(ws))] = rng.choice(["foo", "the", "license"])
        some.append(" ".join(f"f{k}" for k in range(rng.randint(0, 200))) + " " + " ".join(ws))
    df = docs.select(*docs.columns).union(spark.createDataFrame(rows_of(*((1000 + k, t, "s") for k, t in enumerate(some))), DOCS))
    term = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    step = max(len(term(t)) for _, t in licenses.TEMPLATES)
    want = Counter()
    for r in df.collect():
        ws = term(r["text"])
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        blocks = [set(ws[k * step : (k + 2) * step]) for k in range(max(1, -(-len(ws) // step) - 1))]
        found = [(label, len(b & own) / len(own)) for label, t in licenses.TEMPLATES for own in [set(term(t))] for b in blocks if len(b & own) >= math.ceil(0.9 * len(own) - 1e-9)]
        base = {x for _, x in places}
        want[r["doc_id"], len(ws), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), round(max((s for _, s in found), default=0.0), 9)] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in licenses.scan_licenses(df).collect())
    assert got == want
    assert licenses.scan_licenses(empty).count() == 0
    plain = licenses.scan_licenses(df, templates=[("none", "...")]).collect()
    assert all(r["labels"] == r["base_labels"] and r["score"] == 0 for r in plain) and len(plain) == df.count()


def test_shards_do_not_depend_on_the_split(spark, docs):
    runs = [Counter(map(tuple, sharding.shard(docs.select("doc_id", "text").repartition(n)).collect())) for n in (1, 7)]
    assert runs[0] == runs[1] and max(Counter(r[4] for r in runs[0].elements()).values()) - min(Counter(r[4] for r in runs[0].elements()).values()) <= 1


def test_near_dedup_loses_no_link_to_nearer_false_neighbours(spark):
    """Variants of one text, of which many are alike in their bits and not in their shingles, against all pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    variants = []
    for _ in range(150):
        t = base[:]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        variants.append(" ".join(t))
    sets = [set(simhash.hashes(t.encode(), 5).tolist()) for t in variants]
    group = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    assert got == {i: group.index(g) for i, g in enumerate(group)}


def test_histograms_rule_out_no_similar_pair():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(300, 400)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])
        h = [np.frombuffer(simhash.histogram(x), np.uint8)[None] for x in (a, b)]
        same = len(np.intersect1d(a, b))
        if same >= 0.8 * len(np.union1d(a, b)):
            assert simhash.may_reach(*h, 0.8)[0]


@pytest.mark.parametrize(("item", "text", "found"), [("forty two is it", "a forty twu is it b", [1]), ("paris france", "i live in paris france.", [0]), ("paris france", "(paris france)", [0]), ("paris france", "xparis france", []), ("paris france", "paris frances", []), ("ab", "cab ab, c", [0]), ("東京", "私は東京です", [0])])
def test_short_items(item, text, found):
    assert [n for _, n in Matcher([(1, item)], 0.08).hits(text)] == found


P = "<p>This is a long paragraph, with commas, and enough text to be scored by the extraction, since it has many words in it.</p>"


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ('<section id="responses"><p>reader says, hello there friend</p></section>', ""),
        ('<div class="discussion"><p>reader says, hello</p></div>', ""),
        ('<ol class="commentlist"><li>reader says</li></ol>', ""),
        ('<div class="commentary"><p>our view</p></div>', "our view"),
        ('<div class="share-of-market"><p>Market text</p></div>', "Market text"),
        ('<div class="social-history"><p>History text</p></div>', "History text"),
        ('<div class="share"><a>Tweet</a> this</div>', ""),
        ("<h2>Sources</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", "Sources\nOne\nTwo"),
    ],
)
def test_article_parts(inner, kept):
    got = main_text(f"<html><body><nav><a>Home</a></nav><article>{P * 3}{inner}</article></body></html>").split("\n")
    assert "\n".join(got[3:]) == kept
    both = main_text(f"<body><article>{P}first</article><article>{P}second</article></body>").split("\n")
    assert [t for t in both if len(t) < 10] == ["first", "second"]
