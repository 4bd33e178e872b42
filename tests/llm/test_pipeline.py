"""The pipeline, stage by stage, against plain versions of what each has to do."""

import random

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from folio.llm import bpe
from folio.llm.common import stored
from tests.llm.test_rows import plain_figures
from tests.llm.test_tables import plain_components


@pytest.fixture(scope="module")
def stages(spark):
    rng = random.Random(9)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    docs = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(6))) for k in range(80)]
    docs += [(100 + k, docs[k][1]) for k in range(10)] + [(200 + k, docs[k][1].replace(" ", "  ", 3)) for k in range(10, 15)]
    docs = [(k, t + "\nall rights of this site are reserved") for k, t in docs]
    docs += [(300, None), (301, ""), (302, "# % & " * 40), (303, "short text"), (304, "again and again and again " * 30), (0, docs[0][1])]
    table = spark.createDataFrame([(k, t, "en", ("a", "b", None)[k % 3], len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    out = {"input": table.collect()}
    now = table
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, ""), "test")
        out[name] = now.collect()
    return out


def test_quality_rejects_what_fails(stages):
    kept = {r.doc_id for r in stages["quality rules"]}
    assert kept == {r.doc_id for r in stages["input"] if not plain_figures(r.text)[-1]} - {302}
    assert set(range(80)) <= kept  # clean documents stay
    assert sorted(map(str, stages["quality rules"])) == sorted(str(r) for r in stages["input"] if r.doc_id in kept)


def test_recurring_lines_go(stages):
    assert len(stages["line dedup"]) == len(stages["quality rules"])
    for r in stages["line dedup"]:
        assert r.n_chars == len(r.text)
    whole = {r.doc_id: r.text for r in stages["quality rules"]}
    changed = [r for r in stages["line dedup"] if r.text != whole[r.doc_id]]
    assert len(changed) > 50 and all(whole[r.doc_id] == r.text + "\nall rights of this site are reserved" for r in changed)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["line dedup"]]
    want = sorted({i for i, _, c in plain_components(rows) if i == c})
    assert sorted(r.doc_id for r in stages["near dedup"]) == want
    texts = {(r.doc_id, r.text) for r in stages["line dedup"]}
    assert all((r.doc_id, r.text) in texts for r in stages["near dedup"])


def test_mix_repeats_documents(stages):
    before = {str(r) for r in stages["near dedup"]}
    assert all(str(r) in before for r in stages["mix sources"])
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(stages["mix sources"]) - words(stages["near dedup"])) < 300


def test_tokens_decode_to_the_texts(stages):
    tree = bpe.TreeBpe(corpus_pipeline.BYTE_RANKS, P.PATTERN)
    text = {r.doc_id: r.text for r in stages["mix sources"]}
    assert sorted(r.doc_id for r in stages["byte bpe"]) == sorted(r.doc_id for r in stages["mix sources"])
    for r in stages["byte bpe"]:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.round_trip and len(ids) == r.n_tokens and ids == tree._bpe.encode_ordinary(text[r.doc_id])


def test_run_is_the_stages(spark, stages, tmp_path):
    table = spark.createDataFrame(stages["input"], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, stages["byte bpe"]))
    table.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
