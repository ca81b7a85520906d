import re
from collections import Counter

import pytest

import corpus_pipeline
from snapquarry.llm import langid, mixing
from snapquarry.llm.shared import materialise

from .test_text import brute_links
from .test_tokens import check_packing

EN = "the of and to in is that for it was on with as by at from this be are an or"
DE = "der die das und ein ist von zu mit auf nicht im den dem des sich auch als"


def text(words, k, n):
    w = words.split()
    return " ".join(w[(k * 7 + i * (k + 3)) % len(w)] + (str() if i % 5 else "en") for i in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows = []
    for k in range(60):
        words, lang = (EN, "en") if k % 3 else (DE, "de")
        t = text(words, k, 30 + k) + f" id{k}"
        rows.append((k, t, None if k % 10 == 4 else lang, f"s{k % 4}", len(t)))
        if k % 6 == 0:
            rows.append((100 + k, t.upper(), lang, "s0", len(t)))
    rows += [(200, None, "en", "s1", 0), (201, "123 456", "en", "s1", 7), (202, "", None, None, 0), (203, text(EN, 91, 40) + " mail a.b@c.example.com or call +1 (375) 555-4393", "en", None, 1)]
    rows += [rows[-1], (204, text(DE, 70, 9000), "de", "s2", 1)]
    top = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(top / "documents.parquet"))
    docs, out = spark.read.parquet(str(top / "documents.parquet")), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(top)), "stage")
        out.append(docs)
    return out, str(top)


def test_languages(stages):
    before, after = stages[0][0].collect(), stages[0][1].collect()
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["text"] and re.search("[a-z]", r["text"].lower()))
    assert {r["doc_id"]: r["lang"] for r in after}[204] == "de" and all(r["lang"] in ("en", "de") for r in after)
    model = langid.train(stages[0][0])
    assert {(r["doc_id"], r["lang_pred"]) for r in langid.predict(stages[0][0], model).collect()} >= {(r["doc_id"], r["lang"]) for r in after}


def test_near_copies(stages):
    before, after = stages[0][1].collect(), stages[0][2].collect()
    rows = sorted((r["doc_id"], r["text"]) for r in before)
    _, root = brute_links(rows)
    assert sorted(r["doc_id"] for r in after) == sorted({rows[k][0] for k in root})


def test_personal_data(stages):
    before, after = {r["doc_id"]: r for r in stages[0][2].collect()}, {r["doc_id"]: r for r in stages[0][3].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r["text"] == before[i]["text"]) == (i != 203) and r["n_chars"] == len(r["text"])
    assert "a.b@c" not in after[203]["text"] and "4393" not in after[203]["text"]
    assert re.search(r"mail \w+@\w+\.example\.com or call \+1 \(\d{3}\) \d{3}-\d{4}$", after[203]["text"])


def test_mixed_and_packed(stages):
    before, after = stages[0][3], stages[0][4]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert after.columns == corpus_pipeline.COLUMNS
    check_packing(stages[0][5].collect(), [(r["doc_id"], r["text"]) for r in after.collect()], 1024)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, stages[1]).count() == stages[0][5].count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
