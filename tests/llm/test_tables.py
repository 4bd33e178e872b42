"""Operators that bring rows together: chat, language model, mixing, search, lines, near-duplicates."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import chat, lines, minhash, mixing, ngrams, pivots, queries
from folio.llm.components import connect


def saved(tmp_path, df, name="documents"):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- op3


def test_preferences(spark, tmp_path):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"), (1, 3, "assistant", "ciao"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "no"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"), (3, 3, "assistant", "ciao"),
        (4, 0, "system", None), (None, 0, "user", "lost"), (5, None, None, "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    convs = chat.conversations(df)
    rows = {(r.chosen_id, r.rejected_id): r for r in chat.format_preferences(convs, chat.pairs_by_opening(convs)).collect()}
    assert set(rows) == {(1, 2), (1, 3)}
    r = rows[1, 2]
    assert r.n_shared == 2 and r.prompt == "<|user|>\nhi\n<|assistant|>\nhello\n"
    assert r.chosen == "<|user|>\nbye\n<|assistant|>\nciao\n" and r.rejected == "<|user|>\nno\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["ciao"] and r.rejected_mask == []
    assert rows[1, 3].chosen == "" and not rows[1, 3].differs
    every = queries.op3_preferences(spark, saved(tmp_path, df, "conversations")).collect()
    assert sorted((r.chosen_id, r.rejected_id, r.n_shared) for r in every) == [(1, -2, 3), (1, 2, 2), (1, 3, 4), (2, -3, 1), (3, -4, 3)]
    assert queries.op3_preferences(spark, saved(tmp_path, df.limit(0), "conversations")).count() == 0


# --- op4


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


class PlainKatz:
    """Katz backoff of words as they are, by the definition; None is the unknown word."""

    def __init__(self, training, order):
        self.order, self.c = order, [None, *(defaultdict(Counter) for _ in range(order))]
        for t in training:
            tokens = [*t, ""]
            for i, w in enumerate(tokens):
                for k in range(1, order + 1):
                    self.c[k][tuple(tokens[j] if j >= 0 else "" for j in range(i - k + 1, i))][w] += 1
        words = self.c[1][()]
        self.n, self.v, self.words = sum(words.values()), len(words), words
        self.d = [None]
        for k in range(1, order + 1):
            seen = Counter(c for after in self.c[k].values() for c in after.values())
            self.d.append(ngrams.discounts([seen[r] for r in range(65)]))

    def prob(self, k, h, w):
        if k == 0:
            return 1 / (self.v + 1)
        after = self.c[k].get(h, {})
        if not after:
            return self.prob(k - 1, h[1:], w)
        total = sum(after.values())
        kept = sum(self.d[k][min(c, 6)] * c for c in after.values())
        by = total + 1 if kept > total * (1 - 1e-9) else total
        if w in after:
            return self.d[k][min(after[w], 6)] * after[w] / by
        return (1 - kept / by) / (1 - sum(self.prob(k - 1, h[1:], x) for x in after)) * self.prob(k - 1, h[1:], w)

    def score(self, t):
        tokens = [*t, ""]
        return sum(math.log10(self.prob(self.order, tuple(tokens[j] if j >= 0 else "" for j in range(i - self.order + 1, i)), w if w in self.words else None)) for i, w in enumerate(tokens))

    def base(self, t):
        return sum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in [*t, ""])


@pytest.mark.parametrize(("order", "split"), [(1, 500), (2, 500), (2, 8), (3, 500), (3, 8)])
def test_katz(spark, tmp_path, monkeypatch, order, split):
    monkeypatch.setattr(ngrams, "SPLIT", split)
    monkeypatch.setattr(ngrams, "CHUNK", 300)
    rng = random.Random(4)
    vocabulary = [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(400)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "É A b c  Ünseen\nword"), (502, "É A b c  Ünseen\nword"), (None, "w1 w2"), (503, "w1 " * 1500)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    plain = PlainKatz([words_of(t) for i, t in docs if not held(i)], order)
    for k in range(1, order + 1):  # exactly normalised at every order
        assert all(abs(sum(plain.prob(k, h, w) for w in [*plain.words, None]) - 1) < 1e-9 for h in list(plain.c[k])[:150])
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, words int")
    rows = (ngrams.score(df, order=order) if order != ngrams.ORDER else queries.op4_katz_backoff(spark, saved(tmp_path, df))).collect()
    key = lambda r: (str(r[0]), *(round(x, 3) if isinstance(x, float) else x for x in r[1:]))
    want = [(i, held(i), len(t := words_of(x)) + 1, sum(plain.words[w] > 0 for w in [*t, ""]), plain.n, plain.base(t), plain.score(t)) for i, x in docs]
    assert [(a[:5], a[5:]) for a in sorted(map(key, rows))] == [(a[:5], pytest.approx(a[5:], abs=2e-3)) for a in sorted(map(key, want))]


def test_katz_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert queries.op4_katz_backoff(spark, saved(tmp_path, empty)).count() == 0
    only_held = spark.createDataFrame([(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")
    rows = queries.op4_katz_backoff(spark, saved(tmp_path, only_held)).collect()
    assert rows and all(r.base_score == 0 and r.score == 0 and r.train_tokens == 0 for r in rows)


def test_good_turing():
    even = ngrams.discounts([0, 1000, 250, 111, 62, 40, 28])
    assert even[0] == even[-1] == 1 and (np.diff(even[1:]) > 0).all() and 0 < even[1] < even[5] < 1
    for odd in ([0], [0, 5], [0, 1, 50, 1], [0, 0, 0, 7], [0, 3, 0, 0, 9, 0, 30]):
        d = ngrams.discounts(odd)
        assert ((d[1:-1] > 0) & (d[1:-1] < 1)).all()


def test_numbers_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, np.uint64))
    assert (ngrams.unpacked(ngrams.packed(x, "<u8", True), "<u8", True) == x).all()
    assert (ngrams.unpacked(ngrams.packed(x / 7, "<f8"), "<f8") == x / 7).all()


# --- op5


def test_mix(spark, tmp_path):
    rng = random.Random(6)
    docs = [(k, " ".join("w" * (k % 5 + 1) for _ in range(rng.choice([0, 3, 20, 50]))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(600)]
    docs += [(601, None, "a"), (602, "x y", "only"), (603, "x y z", ""), (603, "x y z", "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int").repartition(5)
    rows = queries.op5_mix_sources(spark, saved(tmp_path, df)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in docs:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(total.values()))
    while free:
        per = left / sum(weight[s] for s in free)
        full = {s for s in free if per * weight[s] > 3 * total[s]}
        for s in full or free:
            target[s] = 3.0 * total[s] if full else per * weight[s]
        left, free = left - sum(3 * total[s] for s in full), free - full if full else set()
    of = {i: s for i, _, s in docs}
    assert len(rows) == len(docs)
    taken = Counter()
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 50 for s in order)
    again = queries.op5_mix_sources(spark, saved(tmp_path, df.repartition(2))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert queries.op5_mix_sources(spark, saved(tmp_path, df.limit(0))).count() == 0
    copies = mixing.mixed(df)
    assert copies.columns == df.columns and copies.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(taken.values())


def test_importance_shifts_the_draw(spark):
    df = spark.createDataFrame([(k, "a b c d", "s" if k % 2 else "t") for k in range(2000)], "doc_id long, text string, source string")
    light = mixing.with_copies(df, importance=F.when(F.col("doc_id") < 1000, 0.2).otherwise(5.0), weights=(3, 1))
    counts = {r["low"]: r["n"] for r in light.where("source = 't'").groupBy((F.col("doc_id") < 1000).alias("low")).agg(F.sum("copies").alias("n")).collect()}
    assert counts[False] > 1.3 * counts[True]


def test_certain_documents_are_taken(spark):
    """Inclusion is in proportion to importance, clipped at one, and sums up to the words that are drawn."""
    df = spark.createDataFrame([(k, "w " * (400 if k < 3 else 1 + k % 7), "s" if k % 9 else "t") for k in range(400)], "doc_id long, text string, source string").coalesce(2)
    rows = mixing.with_copies(df, weights=(1, 4), importance=F.pow(F.col("__size"), 2)).collect()
    for source in "st":
        own = [r for r in rows if r.source == source]
        whole = math.floor(own[0].target / own[0].source_size)
        rest, free = own[0].target - whole * own[0].source_size, [r for r in own if r.inclusion < 1]
        assert all(r.copies == whole + 1 for r in own if r.inclusion == 1)
        assert abs(sum(r.inclusion * r.size for r in own) - rest) < 0.01 * rest + 1e-6
        factors = [r.inclusion / r.size**2 for r in free]
        assert not free or max(factors) <= 1.000001 * min(factors)
    assert any(r.inclusion == 1 for r in rows) and any(0 < r.inclusion < 1 for r in rows)


def test_documents_are_drawn_as_often_as_stated(spark):
    """Shares over many seeds against the inclusion probabilities, which add up to the words that are drawn."""
    df = spark.createDataFrame([(k, "w " * (1 + 7 * (k % 5)), "s" if k % 3 else "t") for k in range(300)], "doc_id long, text string, source string").coalesce(2).cache()
    seeds, drawn, stated = 25, Counter(), {}
    for seed in range(seeds):
        for r in mixing.with_copies(df, weights=(3, 1), seed=seed).collect():
            whole = math.floor(r.target / r.source_size)
            drawn[r.doc_id] += r.copies - whole
            stated[r.doc_id] = (r.inclusion, r.size, r.source, r.target - whole * r.source_size)
    for source in "st":
        own = {i: x for i, x in stated.items() if x[2] == source}
        rest = next(iter(own.values()))[3]
        assert abs(sum(p * size for p, size, *_ in own.values()) - rest) < 1e-3 * rest + 1e-6
        for size in {x[1] for x in own.values()}:  # documents of a size have one probability
            alike = [i for i, x in own.items() if x[1] == size]
            n, p = seeds * len(alike), own[alike[0]][0]
            assert abs(sum(drawn[i] for i in alike) / n - p) < 4 * math.sqrt(max(p * (1 - p), 1e-4) / n) + 0.02


# --- op7


def test_top_k(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    vectors += [(500, vectors[0][1]), (501, vectors[0][1]), (600, None), (601, [1.0, None]), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (700, [1.0, 2.0]), (700, [1.0, 2.0]), (None, [1.0] * 8), (800, []), (900, [1e30] * 8)]
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<double>, id int").repartition(4)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, q in {(i, tuple(v)) for i, v in whole if i % 100 == 0}:
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=False)))), j) for j, x in whole if j != i)[:10]
        want |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    rows = queries.op7_top_k(spark, saved(tmp_path, df, "embeddings")).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert queries.op7_top_k(spark, saved(tmp_path, df.limit(0), "embeddings")).count() == 0


def test_search_stops_early():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 40
    x = np.floor((centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 16))) * 100)
    import pandas as pd

    far = pivots.distances(x, x[:8])
    made = pd.DataFrame({"id": range(3000), "row": range(3000), "least": float("-inf"), "x": [v.tobytes() for v in x], "far": [v.tobytes() for v in far]})
    evaluated = []
    plain = pivots.products
    pivots.products = lambda part, q, exact: evaluated.append(len(part)) or plain(part, q, exact)
    try:
        pivots.search_block(made[:5], made, 10)
    finally:
        pivots.products = plain
    assert sum(evaluated) < 5 * 3000 / 2


def test_queries_go_only_where_they_may_win(spark, monkeypatch):
    """Clustered vectors: most blocks are ruled out by their ranges, and the result is exact."""
    monkeypatch.setattr(pivots, "BLOCK", 100)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 7)
    monkeypatch.setattr(pivots, "PACK", 5)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 6)) * 0.02
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)] + [(5000 + k, x[0].tolist()) for k in range(300)], "vec_id long, embedding array<double>").repartition(4)
    sent = []
    plain = pivots.needed_blocks
    monkeypatch.setattr(pivots, "needed_blocks", lambda q, b, *n: sent.append((q.count() * b.count(), (out := plain(q, b, *n)).count())) or out)
    rows = pivots.top_k(df, F.col("id") % 50 == 0).collect()
    whole = {r.vec_id: np.floor(1024 * np.array(r.embedding)) for r in df.collect()}
    ids, m = np.array(list(whole)), np.stack(list(whole.values()))
    want = set()
    for i in ids[ids % 50 == 0]:
        scores = sorted((-s, j) for s, j in zip(m @ whole[i], ids, strict=True) if j != i)[:10]
        want |= {(i, n, j, int(-s)) for n, (s, j) in enumerate(scores, 1)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert sent[0][1] < sent[0][0] / 2


# --- op8


def own(k):
    return " ".join(chr(97 + k % 26) + chr(97 + k // 26) + x for x in "qwertyuiopasdfghjklzxcvbnmqwertyuiopasdfghjkl")


def plain_drops(texts, min_docs=3):
    """Templates by brute force: per text the numbers of its lines that go."""
    lines = {(t, k): tuple(re.sub("[0-9]+", "#", x).split()) for t in {t or "" for t in texts} for k, x in enumerate(t.split("\n"))}
    lines = {at: w for at, w in lines.items() if any(c.isalpha() for c in "".join(w))}
    by_template, found = defaultdict(set), {}
    for at, w in lines.items():
        tail = w[3:]
        parts = min(len(tail), 10)
        stretch = [tuple(x for t, x in enumerate(tail) if t * parts // len(tail) == p) for p in range(parts)]
        fields = max(1, min(4, 2 * (parts + 3) // 5, parts - 1))
        ways = itertools.combinations(range(parts), parts - fields) if parts else ()
        found[at] = {("line", w)} | {(len(w), w[:3], way, tuple(stretch[p] for p in way)) for way in ways}
        for x in found[at]:
            by_template[x].add(at[0])
    gone = defaultdict(list)
    for (t, k), mine in sorted(found.items(), key=lambda x: x[0][1]):
        if any(len(by_template[x]) >= min_docs for x in mine):
            gone[t].append(k)
    return gone


def test_lines(spark, tmp_path):
    docs = [(k, own(k) + f"\nAll rights of this site reserved.\nhost{k} logged in from port {k} today\nOk.\n{{\n") for k in range(6)]
    docs += [(20, None), (21, ""), (22, "Ok.\nOk.\nOk."), (23, "lonely line with many words\nlonely line with many words"), (24, "12\n34 56\n--\n\t"), (25, "保留所有权利。\n" + "x" * 100_000)]
    docs += [(30 + k, "copied first line with words\ncopied second line with words\ncopied third line of all\n" + f"own {own(k)[:9]}") for k in range(4)]
    docs += [(0, docs[0][1])] + [(40 + k, "whole copies of a text") for k in range(5)]
    template = [("red", "one"), ("blue", "two"), ("green", "three"), ("pink", "four")]
    docs += [(50 + k, own(10 + k) + f"\nThe user of {a} has item {b} in the  basket\tnow") for k, (a, b) in enumerate(template)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_lines int")
    rows = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    for k in range(6):
        assert rows[k].dropped == [1, 2, 3] and rows[k].text == docs[k][1].split("\n")[0] + "\n{\n"
    assert rows[20].text is None and rows[21].text == "" and rows[22].dropped == [0, 1, 2] and rows[22].text == "" and rows[23].dropped == rows[24].dropped == rows[25].dropped == []
    assert all(rows[30 + k].dropped == [0, 1, 2] for k in range(4))  # most of a text may go
    assert all(rows[40 + k].dropped == [] for k in range(5))  # copies have one vote
    assert all(rows[50 + k].dropped == [1] for k in range(4))
    assert lines.dedup_lines(df).count() == len(docs)
    assert queries.op8_line_templates(spark, saved(tmp_path, df.limit(0))).count() == 0
    want = plain_drops([t or "" for _, t in docs])
    assert all(r.dropped == want[t or ""] for i, t in docs for r in [rows[i]])


def test_lines_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = "the user of red blue has item one two in basket now 12 é".split()
    docs = [(k, "\n".join(" ".join(["the user of", *(rng.choice(words) for _ in range(rng.randrange(5)))][rng.random() < 0.1 :]) for _ in range(rng.randrange(1, 5)))) for k in range(120)]
    docs += [(200 + k, docs[k][1]) for k in range(10)]
    found = {r.doc_id: r.dropped for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = plain_drops([t for _, t in docs])
    assert all(found[i] == want[t] for i, t in docs) and 20 < sum(bool(x) for x in found.values())
    import duckdb

    from folio.llm.oracle import OP8

    folder = saved(tmp_path, spark.createDataFrame(docs, "doc_id long, text string"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert {r[0]: r[3] for r in con.sql(OP8).fetchall()} == {i: ",".join(map(str, x)) for i, x in found.items()}


def test_boilerplate_goes_whatever_its_share(spark):
    licence = "\n".join(f"clause {w} of the licence says that nothing is owed to anyone" for w in "one two three four five six seven eight".split())
    docs = [(k, f"{own(k)[:70]}\n{licence}") for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for together in (False, True):
        rows = lines.dedup_lines(df, one_vote_per_family=together).collect()
        assert all(r.text == docs[r.doc_id][1].split("\n")[0] for r in rows)


def test_near_copies_share_a_vote(spark):
    near = "\n".join(f"{own(30 + j)[:60]}" for j in range(10))
    edit = lambda k: "\n".join(x if j != k else x.replace(" ", " edited ", 4).replace(" edited ", " ", 3) for j, x in enumerate(near.split("\n")))
    docs = [(30 + k, edit(k)) for k in range(5)] + [(k, own(k) + "\nall rights of this site are reserved") for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    apart, together = ({r.doc_id: r.text for r in lines.dedup_lines(df, one_vote_per_family=x).collect()} for x in (False, True))
    assert all(together[30 + k] == edit(k) and len(apart[30 + k]) < 70 for k in range(5))
    assert all(x[k] == own(k) for k in range(3) for x in (apart, together))


def test_templates_do_not_depend_on_other_lines(spark):
    names = "ann bob cid dan eve fay".split()
    made = [f"Session opened for user {n} by the main server process" for n in names]
    made += [f"Session opened for the {n} job with its {n} new files" for n in "red blue pink".split()]  # another template
    made += [f"Session opened for {' '.join(own(9 + k).split()[:7])}" for k in range(8)]  # unrelated
    made += [f"Login by {a} at {b} gate" for a in ("ann", "bob", "cid") for b in ("red", "blue", "pink")]  # fields of few values
    docs = [(k, f"{own(k)}\n{line}") for k, line in enumerate(made)]
    rows = {r.doc_id: r.dropped for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k] for k in range(len(made))] == [[1]] * 9 + [[]] * 8 + [[1]] * 9


def session_lines(rng, n_docs, n_fields, n_values):
    line = "Session opened for user {} on host {} in zone {} by main {} process now done".split()
    docs = []
    for k in range(n_docs):
        field = iter([f"v{chr(97 + min(rng.randrange(n_values), rng.randrange(n_values)))}" for _ in range(n_fields)] + ["fixed"] * 4)
        docs.append((k, " ".join(next(field) if x == "{}" else x for x in line) + f"\n{own(k % 400)} {k // 400}"))
    return docs


def test_templates_with_several_fields(spark):
    rng = random.Random(5)
    for n_docs in (8, 120):
        docs = session_lines(rng, n_docs, 3, 20)
        rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert all(r.dropped == [0] for r in rows) and len(rows) == n_docs


@pytest.mark.parametrize("n_fields", [1, 2, 3, 4])
def test_more_texts_hide_no_template(spark, n_fields):
    rng = random.Random(n_fields)
    docs = [d for n_values in (2, 9, 25) for d in session_lines(rng, 40, n_fields, n_values)]
    docs += [(0, "Session opened for " + " ".join(rng.choice("user va vb vc on host in zone by main now".split()) for _ in range(rng.randrange(1, 15)))) for _ in range(150)]
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    dropped = lambda some: {(r.doc_id, k) for r in lines.dedup_lines(spark.createDataFrame(some, "doc_id long, text string")).collect() for k in r.dropped}
    whole = dropped(docs)
    want = plain_drops([t for _, t in docs])
    assert whole == {(i, k) for i, t in docs for k in want[t]} and len(whole) >= 120
    for size in (12, 60, 150):
        part = dropped(rng.sample(docs, size))
        assert part <= whole and part


# --- op10


def plain_components(docs, percent=85):
    sets = []
    for _, t in docs:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def near_docs():
    rng = random.Random(8)
    words = [f"word{k}" for k in range(300)]
    docs, at = [], 1000
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            at -= rng.randrange(1, 4)
            docs.append((at, " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
    hub = [rng.choice(words) for _ in range(150)]
    for k in range(40):  # a hot group around one text, whose copies are often not linked with each other
        copy = list(hub)
        for _ in range(3):
            copy[rng.randrange(150)] = f"edit{rng.random()}"
        docs.append((2000 + k, " ".join(copy)))
    docs += [(3000, " ".join(hub)), (3001, None), (3002, ""), (3003, " \t "), (3004, "one"), (3005, "ONE"), (None, "one"), (3006, "one two"), (3000, " ".join(hub))]
    chain = [f"c{k}" for k in range(104)]
    for k in range(6):  # neighbours are linked, ends are not
        docs.append((4000 + k, " ".join([f"n{k}_{j}" if j < 0 else x for j, x in enumerate(chain)][4 * k :] + [f"t{m}" for m in range(4 * k)])))
    return docs


def test_near_duplicates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    docs = near_docs()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, cls int").repartition(4)
    rows = queries.op10_minhash(spark, saved(tmp_path, df)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows) == sorted(map(str, plain_components(docs)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert queries.op10_minhash(spark, saved(tmp_path, df.limit(0))).count() == 0


def test_hot_bucket_of_texts_that_are_hardly_linked(spark, monkeypatch):
    """Texts around the threshold, far more than a block holds: every link that joins components is found."""
    monkeypatch.setattr(minhash, "BLOCK", 40)
    monkeypatch.setattr(minhash, "CELL", 5000)
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 2)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for k in range(250):
        copy = list(base)
        for at in rng.sample(range(6, 120, 12), rng.choice([2, 4])):  # texts are linked that differ in one place
            copy[at] = f"e{rng.randrange(3)}"
        docs.append((k, " ".join(copy)))
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()
    want = plain_components(docs)
    assert 20 < len({c for *_, c in want}) < 220
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted((i, c) for i, _, c in want)


def test_repeated_rows_cost_as_one(spark):
    text = " ".join(f"word{k}" for k in range(200))
    many = spark.range(40_000).selectExpr("case when id % 3 = 0 then null else 7 end as doc_id", f"case when id % 2 = 0 then '{text}' else '{text} more' end as text")
    began = time.perf_counter()
    rows = minhash.near_duplicates(many).groupBy("doc_id", "component_id", "kept").count().collect()
    assert time.perf_counter() - began < 60
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, 7, False), (7, 7, True)} and sum(r["count"] for r in rows) == 40_000


def test_bands_follow_the_threshold():
    for percent in (50, 80, 85, 95):
        bands, rows = minhash.banding(percent)
        assert bands * rows <= minhash.HASHES and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    with pytest.raises(ValueError):
        minhash.banding(5)


def test_sequential_verification():
    least = minhash.least_matches(85)
    assert least == sorted(least) and least[-1] < 0.85 * minhash.HASHES
    x = np.zeros((3, minhash.HASHES), "<u2")
    y = x.copy()
    y[1, :40] = 1
    y[2, ::2] = 1
    assert minhash.bayes_survivors(x, y, least).tolist() == [0]


def test_components(spark):
    chain = [(f"{k:03d}", f"{k + 1:03d}") for k in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in chain], "a binary, b binary")
    labels = {bytes(r.node): bytes(r.label) for r in connect(df).collect()}
    assert len({labels[f"{k:03d}".encode()] for k in range(41)}) == 1 and labels[b"x"] == labels[b"y"] == b"x" and b"z" not in labels
