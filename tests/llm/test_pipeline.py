"""The whole pipeline against plain Python, stage by stage."""

import hashlib
from collections import Counter

import corpus_pipeline
import sentencepiece
from test_decontaminate import brute as contamination
from test_minhash import brute as near_duplicates
from test_native import WORD, features

from quillwatch.llm import quality_rules, queries


def kept_by_rules(docs):
    found = {d["doc_id"]: dict(zip(quality_rules.FEATURES, features(d["text"]))) for d in docs}
    fails = {i: {r: eval(rule, {}, f) for r, rule in quality_rules.RULES.items()} for i, f in found.items()}
    hosts = Counter(d["source"] for d in docs)
    bad = set()
    for r in quality_rules.RULES:
        k = Counter(d["source"] for d in docs if fails[d["doc_id"]][r])
        n, total = len(docs), sum(k.values())
        mean = (total + 0.5) / (n + 1)
        spread = (sum(k[h] ** 2 / c for h, c in hosts.items()) - total**2 / n) / n
        strength = min(max(mean * (1 - mean) / spread - 1, 1), 1e4) if spread > 0 else 1e4
        bad |= {h for h, c in hosts.items() if (k[h] + mean * strength) / (c + strength) > quality_rules.MAX_HOST_RATE}
    return [d for d in docs if d["source"] not in bad and not fails[d["doc_id"]]["few_words"] and not fails[d["doc_id"]]["repeats"]]


def without_boilerplate(docs):
    pages, holds = Counter(d["source"] for d in docs), Counter()
    for d in docs:
        holds.update({(d["source"], x) for x in d["text"].split("\n") if WORD.search(x)})
    common = {(s, x) for (s, x), n in holds.items() if n >= 3 and n > 0.1 * pages[s]}
    out = []
    for d in docs:
        text = "\n".join(x for x in d["text"].split("\n") if (d["source"], x) not in common)
        out.append(d | {"text": text, "n_chars": len(text) if text != d["text"] else d["n_chars"]})
    return out


def test_run_on_whole_tables(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    one = kept_by_rules(docs)
    two = without_boilerplate(one)
    near = near_duplicates([(d["doc_id"], d["text"]) for d in two], 80)
    three = [d for d in two if near[d["doc_id"]][2]]
    hit = contamination([(d["doc_id"], d["text"]) for d in three], items)
    four = [d for d in three if not hit[d["doc_id"]][4]]
    assert len(docs) > len(one) > len(three) > len(four) > 0
    model = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    want = {d["doc_id"]: (d["lang"], d["source"], model.encode(d["text"]), hashlib.sha256(d["text"].encode()).hexdigest(), True) for d in four}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: (r["lang"], r["source"], r["ids"], r["decoded_sha256"], r["round_trips"]) for r in rows} == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(1, good, "en", "a", 400, "x"), (1, good, "en", "a", 400, "x"), (2, None, None, None, None, None), (3, "", "en", None, 0, "y"), (None, good + " more", "en", "a", 1, "z"), (4, good + "\n" + "w" * 10_000, "de", "b", 2, "q")]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.dtypes == df.dtypes
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count()
