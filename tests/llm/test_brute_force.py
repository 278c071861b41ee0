"""Learned decisions and the pipeline against plain versions of the same rules."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from longbox.llm import language, order_minhash, private, quality
from longbox.llm.queries import tokenizer_path


def plain_posteriors(votes: np.ndarray) -> np.ndarray:
    """Expectation-maximisation over single texts, one row of votes each."""
    n, k = votes.shape
    good, right_good, right_bad = 0.8, np.full(k, 0.8), np.full(k, 0.8)
    post = np.zeros(n)
    for step in range(quality.EM_STEPS + 1):
        odds = np.full(n, math.log(good / (1 - good)))
        for j in range(k):
            odds += np.where(votes[:, j] == 1, math.log(right_good[j] / (1 - right_bad[j])), np.where(votes[:, j] == -1, math.log((1 - right_good[j]) / right_bad[j]), 0))
        post = 1 / (1 + np.exp(-odds))
        if step == quality.EM_STEPS:
            return post
        old = np.concatenate([[good], right_good, right_bad])
        for j in range(k):
            cast = votes[:, j] != 0
            right_good[j] = (8 + post[votes[:, j] == 1].sum()) / (10 + post[cast].sum())
            right_bad[j] = (8 + (1 - post)[votes[:, j] == -1].sum()) / (10 + (1 - post)[cast].sum())
        good = (post.sum() + 8) / (n + 10)
        if np.abs(np.concatenate([[good], right_good, right_bad]) - old).max() < quality.EM_CHANGE:
            step = quality.EM_STEPS
            odds = np.full(n, math.log(good / (1 - good)))
            for j in range(k):
                odds += np.where(votes[:, j] == 1, math.log(right_good[j] / (1 - right_bad[j])), np.where(votes[:, j] == -1, math.log((1 - right_good[j]) / right_bad[j]), 0))
            return 1 / (1 + np.exp(-odds))
    return post


def plain_quality(docs) -> dict:
    rules = quality.votes()
    rows = quality.features(docs).select("*", *[c.cast("int").alias(f"v_{r}") for r, c in rules.items()]).collect()
    found = plain_posteriors(np.array([[r[f"v_{x}"] for x in rules] for r in rows]).reshape(-1, len(rules))) if rows else []
    return {r.doc_id: (p, r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words and p >= 0.5) for r, p in zip(rows, found)}


def test_quality_verdicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_quality(docs)
    for r in quality.judge(docs).collect():
        assert abs(r.quality - want[r.doc_id][0]) < 1e-6 and r.kept == want[r.doc_id][1]


def test_bad_documents_go(spark):
    """A table of 1000 rows: rules learn their accuracies from the table, and a few bad texts in 200 teach them little."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    told = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").groupBy("label", "kept").count().collect()
    n = {(r.label, r.kept): r["count"] for r in told}
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0)) and n[1, True] >= 0.95 * (n[1, True] + n.get((1, False), 0))


def plain_language(rows: list[tuple]) -> dict:
    """Counts of all words and n-grams of all labelled rows, in dictionaries."""
    words: dict[str, Counter] = {}
    for i, text, lang in rows:
        if text and lang and zlib.crc32(str(i).encode()) % 3 != 1:
            words.setdefault(lang, Counter()).update(language._WORD.findall(text.lower()))
    names = sorted(words)
    grams = {x: Counter() for x in names}
    for x in names:
        for w, n in words[x].items():
            m = f"<{w}>"
            for size in range(1, 6):
                for k in range(len(m) - size + 1):
                    grams[x][m[k : k + size]] += n

    def scores(counts):
        keys = set().union(*counts.values())
        size = {x: sum(words[x].values()) + 0.5 * (len(keys) + 1) for x in names}
        out = {}
        for key in keys:
            row = np.array([math.log((counts[x][key] + 0.5) / size[x]) for x in names])
            out[key] = row - np.logaddexp.reduce(row)
        return out

    by_word, by_gram = scores(words), scores(grams)

    def unseen(w):
        m = f"<{w}>"
        for size in range(5, 0, -1):
            hits = [by_gram[g] for k in range(len(m) - size + 1) if (g := m[k : k + size]) in by_gram]
            if hits:
                return np.mean(hits, 0)
        return np.zeros(len(names))

    out = {}
    for i, text, _ in rows:
        found = language._WORD.findall((text or "").lower())
        if not found:
            out[i] = ("und", 0.0)
            continue
        total = sum(by_word[w] if w in by_word else unseen(w) for w in found)
        odds = np.exp(total - total.max())
        out[i] = (names[int(odds.argmax())], float(odds.max() / odds.sum()))
    return out


def test_language_predictions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, "zzqx the wörd", None), (9002, "x", "en"), (9003, None, "fr")], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd)
    want = plain_language([tuple(r) for r in docs.collect()])
    for r in language.identify(docs).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3


def test_training_sample_keeps_rare_languages(spark):
    rows = [(i, "a" if i % 100 else "b") for i in range(5000)]
    taken = language.training_sample(spark.createDataFrame(rows, "doc_id long, lang string"), per_language=100)
    n = {r.lang: r["count"] for r in taken.groupBy("lang").count().collect()}
    assert n["b"] == 50 and 50 <= n["a"] <= 150


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(1).select(F.lit(9001).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(odd).unionByName(odd.withColumn("text", F.lit("")).withColumn("doc_id", F.lit(9002).cast("long")))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    told = plain_language([(r.doc_id, r.text, r.lang) for r in rows.values()])
    left = [i for i, (name, score) in told.items() if name != "und" and score >= 0.5]
    good = plain_quality(docs.where(F.col("doc_id").isin(left)))
    left = sorted(i for i in left if good[i][1])
    windows = {i: order_minhash.hashed(order_minhash.words_of(rows[i].text)) for i in left}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(left, 2):
        if min(len(windows[a]), len(windows[b])) >= 0.8 * max(len(windows[a]), len(windows[b])) and np.isin(windows[a], windows[b]).any() and order_minhash.aligned(windows[a], windows[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    left = [i for i in left if find(i) == i]
    texts = [rows[i].text for i in left]
    _, spans = private.all_spans(texts, private.default_field())
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: len(library.encode(private.redacted(t, s), add_special_tokens=False).ids) + 1 for i, t, s in zip(left, texts, spans)}
    got: dict = {}
    placed: dict = {}
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in placed.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


@pytest.mark.parametrize("n", [0])
def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path, n):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(n).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_planted_personal_data_is_found():
    rnd = np.random.Generator(np.random.PCG64(4))
    digits = lambda n: "".join(map(str, rnd.integers(0, 10, n)))
    hexes = lambda n: "".join(rnd.choice(list("0123456789abcdef"), n))
    words = [f"w{''.join(rnd.choice(list('abcdefghijklmnop'), 6))}" for _ in range(60)]
    forms = [lambda: f"user.{digits(2)}@mail{digits(1)}.example.com", lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: ".".join(str(x) for x in rnd.integers(0, 256, 4)), lambda: f'token = "{hexes(40)}"', lambda: f"password={hexes(18)}9", lambda: "AKIA" + "".join(rnd.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"), 15)) + "7Q"]
    planted = [" ".join([*words[:20], forms[k % len(forms)](), *words[20:]]) for k in range(120)]
    clean = [" ".join(rnd.permutation(words)) + f" in {digits(4)} , page {digits(3)} and version {digits(1)}.{digits(1)}" for _ in range(120)]
    _, every = private.all_spans(planted + clean, private.default_field())
    found = [bool(s) for s in every]
    assert sum(found[:120]) >= 0.98 * 120 and sum(found[120:]) <= 2
