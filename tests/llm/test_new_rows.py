"""Toxic spans, the audit of filters and the alignment of tokenizers against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folio.llm import align, audit, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def saved(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- op11


def plain_marginals(e, moves):
    """All 2^n state sequences, one after the other."""
    to, back, stay = moves
    total, toxic, none = 0.0, np.zeros(len(e)), 0.0
    for y in product((0, 1), repeat=len(e)):
        steps = list(zip((0, *y), (*y, 0), strict=True))
        score = sum(e[t] for t, s in enumerate(y) if s) + to * steps.count((0, 1)) + back * steps.count((1, 0)) + stay * steps.count((1, 1))
        total += np.exp(score)
        toxic += np.exp(score) * np.array(y)
        none += np.exp(score) * (not any(y))
    return toxic / total, -np.log(none / total)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9):
        e, moves = rng.normal(0, 2, n), rng.normal(0, 1, 3)
        padded = np.exp(np.concatenate([e, [-np.inf, -np.inf]]))[:, None]
        got, _, nothing = toxicity.forward_backward(padded, moves)
        want, want_nothing = plain_marginals(e, moves)
        assert np.allclose(got[:n, 0], want) and np.allclose(got[n:], 0) and np.isclose(nothing[0], want_nothing)


def test_windows_hold_every_word_once():
    lengths = np.array([0, 1, 64, 65, 0, 200])
    text, place, real = toxicity.windows(lengths)
    assert sorted(place[real].tolist()) == list(range(lengths.sum()))
    assert np.bincount(text, minlength=6).tolist() == [0, 1, 1, 2, 0, 4]


def test_field_learns_context():
    """A word that is toxic only after another is told by its neighbour."""
    rnd, rows = random.Random(3), []
    for _ in range(400):
        words = [rnd.choice("sun moon bread stone river".split()) for _ in range(20)]
        marks = bytearray(20)
        at = rnd.randrange(1, 19)
        words[at] = "dog"
        if rnd.random() < 0.5:
            words[at - 1] = "dirty"
            marks[at] = 1
        rows.append((words, bytes(marks)))
    model = toxicity.Model(np.full(toxicity.BUCKETS, np.nan, np.float32))
    toxicity.fit_field(model, rows)
    evidence, spans = toxicity.Reader(model).read(["a dirty dog by the river", "the moon dog by the river", "dirty bread", ""])
    assert spans == [[(8, 11)], [], [], []] and evidence[0, 0] > 1 > evidence[1, 0] and evidence[3].tolist() == [0, 0, 0]


def toxic_tables(spark, n=900):
    rnd = random.Random(11)
    plain = [a + b for a in ("ka", "lo", "mi", "su", "te", "ro") for b in ("na", "ri", "vo", "pel", "dun")]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(20, 90))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(("Vile", "vile")) if i % 8 else "gruk" + rnd.choice("aeiou") + rnd.choice("lmnrst"))
        docs.append((i, " ".join(words), None if i % 5 else "en", "s", None))
        labels.append((i, None, int(toxic)))
    docs += [(n, None, None, None, None), (None, "vile vile", None, None, None), (n + 1, "", None, None, None), (n + 2, "kana " * 150_000 + "vile", None, None, None), (0, docs[0][1], None, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1)], LABELS)


def test_toxicity(spark, tmp_path):
    docs, labels = toxic_tables(spark)
    sf = saved(tmp_path, documents=docs.withColumn("score", F.lit("mine")), labels=labels)
    rows = queries.op11_toxicity(spark, sf).collect()
    assert len(rows) == docs.count() and queries.op11_toxicity(spark, sf).columns == ["doc_id", "held_out", "score", "predicted", "spans"]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert len(held) > 100 and sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.99 * len(held)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 0:
            found = [text[r.doc_id][int(a) : int(b)] for a, b in (s.split(":") for s in r.spans.split(",") if s)]
            assert found and all(w.lower() == "vile" or w.startswith("gruk") for part in found for w in part.split())
    by = {r.doc_id: r for r in rows}
    assert by[902].spans == "750000:750004" and by[900].score == by[901].score < 0.5 and not by[None].held_out
    again = {r.doc_id: r.score for r in queries.op11_toxicity(spark, sf).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_toxicity_without_examples(spark, tmp_path):
    docs, labels = toxic_tables(spark, 20)
    for known, score in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        rows = queries.op11_toxicity(spark, saved(tmp_path, documents=docs, labels=known)).collect()
        assert len(rows) == 25 and {r.score for r in rows} == {score} and {r.spans for r in rows} == {""}
    assert queries.op11_toxicity(spark, saved(tmp_path, documents=docs.limit(0), labels=labels)).count() == 0
    with_columns = toxicity.with_toxicity(docs.withColumn("predicted", F.lit("mine")), 0.25)
    assert with_columns.first().predicted == 0 and with_columns.columns.count("predicted") == 1


# --- op12


def plain_audit(docs, labels):
    smallest, good, bad = {}, defaultdict(bool), defaultdict(bool)
    for d in docs:
        if d[0] is not None:
            smallest[d[1] or ""] = min(d[0], smallest.get(d[1] or "", d[0]))
    for i, q, t in labels:
        good[i] |= q == 1
        bad[i] |= t == 1
    parts = defaultdict(list)
    for i, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = dict(zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > smallest[t]), strict=True))
        parts[lang or ""].append((fails, i is not None and good[i], i is not None and bad[i]))
    rows = {}
    for part, all_docs in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = all_docs
            for step, f in enumerate(order, 1):
                out, left = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in all_docs)
                rows[part, order, step] = [len(left), len(out), failing - len(out), sum(d[0][f] and sum(d[0].values()) == 1 for d in all_docs), sum(d[1] for d in out), sum(d[2] for d in out)]
                total[f] += len(out)
        for (p, order, step), v in rows.items():
            if p == part:
                v.append(total[order[step - 1]])
    return rows


def audit_tables():
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(("w", "W", "x#", "long", "Y")) + str(rnd.randrange(90 if k % 3 else 900)) for _ in range(rnd.choice((5, 99, 100, 130)))) for k in range(30)]
    texts += ["", None, "A" * 300_000, "é " * 120, "\x0b\x1c  x"]
    docs = [(i % 55, rnd.choice(texts), rnd.choice(("en", "de", None, "")), None, None) for i in range(120)]
    docs += [(None, texts[0], "en", None, None), (None, texts[0], None, None, None), (3, "same", "fr", None, None), (3, "same", "fr", None, None), (2, "same", None, None, None)]
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for i in range(0, 55, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("flush_bytes", [1, 1 << 26])
def test_audit(spark, flush_bytes):
    docs, labels = audit_tables()
    made = audit.audit(spark.createDataFrame(docs, DOCS).withColumn("mask", F.lit("mine")).repartition(5), spark.createDataFrame(labels, LABELS), flush_bytes=flush_bytes)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in made.collect()}
    assert got == plain_audit(docs, labels) and len(got) == 4 * 600


def test_audit_tells_equal_hashes_apart():
    """Texts of one hash, as a partition of the routed table has them: sorted by (hash, id)."""
    rows = [((9, 1), (b"one", "p", 0, 1)), ((9, 2), (b"two", "p", 0, 1)), ((9, 3), (b"one", "q", 2, 4)), ((9, 3), (None, "q", audit.COPY, 2)), ((11, 4), (b"one!", "p", 0, 1))]
    assert list(audit.chained(iter(rows))) == [(1, "p", 0, 1), (2, "p", 0, 1), (3, "q", 2 | audit.COPY, 4), (3, "q", audit.COPY, 2), (4, "p", 0, 1)]


def test_audit_of_nothing(spark, tmp_path):
    sf = saved(tmp_path, documents=spark.createDataFrame([], DOCS), labels=spark.createDataFrame([], LABELS))
    assert queries.op12_filter_audit(spark, sf).count() == 0


# --- op13


def plain_alignments(texts):
    """Both libraries over whole texts; groups, links and counts by the definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_TOKENIZER)
    a_of, b_of = align.a_bytes(queries.BYTE_TOKENIZER), align.b_bytes(queries.PIECE_TOKENIZER)
    made, docs_with = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b, raw = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text), (" " + text).encode()
            if b"".join(a_of[i] for i in a) == raw == b"".join(b_of[i] for i in b):
                ends = [set(np.cumsum([len(t[i]) for i in ids]).tolist()) for ids, t in ((a, a_of), (b, b_of))]
                both, at = sorted(ends[0] & ends[1]), [[0, 0], [0, 0]]
                for end in both:
                    group = []
                    for k, (ids, t) in enumerate(((a, a_of), (b, b_of))):
                        part = []
                        while at[k][1] < end:
                            part.append(ids[at[k][0]])
                            at[k] = [at[k][0] + 1, at[k][1] + len(t[part[-1]])]
                        group.append(part)
                    groups.append(group)
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        docs_with.update(links.keys())
        made.append((groups, links))
    highest = Counter()
    for (i, _), n in docs_with.items():
        highest[i] = max(highest[i], n)
    rows = []
    for groups, links in made:
        sha = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else ""
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links.total(), sum(n for p, n in links.items() if docs_with[p] == highest[p[0]]), sum(n * docs_with[p] for p, n in links.items()), sha))
    return rows


ODD = ["", None, "▁a b", "<|endoftext|> and <s> </s> <0x41>", "a  b\n\n c\t\td\r\ne;\r }\r\r f", "  lead and trail  ", "\n", " ", "\x00 \x1c x\x85y　z w", "x▁ y", "naïve Ünïcode 日本語 テスト 👩‍👩‍👧 ́a", "it's we'll THE'S 123 45.6 $$ -- a-b_c",
       "y" * 3000, "tab\tnew\nline\x0bvt\x0cff", "café ﬁ ①", ";\r", "a \r b\r", "\r\n\r\n x", "word " * 400]


def test_cross_tokenizer(spark, tmp_path, monkeypatch):
    rnd = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "\r", ";", "}", "é", "日", "'s", "1", " of", " ", "X", " ", "ing"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    monkeypatch.setattr(align, "CHUNK_BYTES", 2000)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("kind", F.lit("mine")).withColumn("chunk", F.lit("mine"))
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op13_cross_tokenizer(spark, saved(tmp_path, documents=docs)).collect()}
    for k, want in enumerate(plain_alignments(texts)):
        assert rows[k] == want, repr(texts[k])
    assert len(rows) == len(texts)
    empty = saved(tmp_path, documents=docs.limit(0))
    assert queries.op13_cross_tokenizer(spark, empty).count() == 0
    nothing = saved(tmp_path, documents=spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"))
    assert [tuple(r) for r in queries.op13_cross_tokenizer(spark, nothing).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2


def test_cuts_follow_the_vocabularies():
    a, b = align.a_bytes(queries.BYTE_TOKENIZER), align.b_bytes(queries.PIECE_TOKENIZER)
    assert align.cuts(a, b) == " \n\x0b\x0c" or "\r" not in align.cuts(a, b) and " " in align.cuts(a, b)
    assert "\n" not in align.cuts({0: b"x\n"}, b) and " " not in align.cuts({0: b"x y"}, b)
    for breaks in ("", " ", " \n"):
        for text in (t for t in ODD if t):
            assert "".join(align.splitter(breaks).findall(" " + text)) == " " + text
    assert public_tokenizers.path("byte_bpe_50k.json") == queries.BYTE_TOKENIZER
