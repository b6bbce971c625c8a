"""Language, toxicity and the pipeline's last stages against their definitions in plain Python; both sides of each choice of plan; long texts and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import kernel, langid, lm, mixing, toxicity

WORDS = {"aa": "the and house water green stone river", "bb": "der und haus wasser grün stein fluss", "cc": "le et maison eau vert pierre rivière"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", ",", " 7", "!"]) for _ in range(n))


def codes(text):
    """Letters in lower case; both ends are 0, and so is each run of other signs that follows a letter."""
    out = [0]
    for c in text:
        low = c.lower() if c.isalpha() else ""
        x = ord(low) if len(low) == 1 else ord(c) if low else 0
        if x or out[-1]:
            out.append(x)
    return [*out, 0]


def mixed(x):
    return int(kernel.mix(np.array([x % 2**64], np.uint64))[0])


def counted(text):
    """n-gram buckets of a text and their counts."""
    c, out = codes(text), {}
    for n in langid.SIZES:
        for i in range(len(c) - n + 1):
            h = c[i]
            for x in c[i + 1 : i + n]:
                h = (h * 0x110001 + x) % 2**64
            k = mixed(h * 31 + n) % langid.DIMS
            out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize("text", ["The house", "É à! Straße 99 ß", "a", "word " * 40, "x\n\n--\ty"])
def test_features(text):
    at, n = langid.features(langid.letter_codes(text))
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == counted(text)


def unit(v):
    s = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / s for k, x in v.items()}


def lang_rows(n=12):
    rng = random.Random(3)
    return [(i, prose(rng, "abc"[i % 3] * 2, 6 + i % 9), "abc"[i % 3] * 2) for i in range(3 * n)]


@pytest.mark.parametrize("langs", [langid.LANGS, 0])
def test_language_model_by_its_definition(spark, monkeypatch, langs):
    """idf, centroids and limits of a small corpus, and predictions, in plain loops; the counts of languages broadcast or joined."""
    monkeypatch.setattr(langid, "LANGS", langs)
    rows = lang_rows()
    m = langid.train(spark.createDataFrame([*rows, (99, "123 !!", "aa"), (98, None, "aa"), (97, "x", None)], "doc_id long, text string, lang string").repartition(3), "text", "lang", "doc_id")
    bags = [(lang, counted(t)) for _, t, lang in rows]
    df = {}
    for _, b in bags:
        for k in b:
            df[k] = df.get(k, 0) + 1
    idf = lambda k: math.log((1 + len(bags)) / (1 + df.get(k, 0))) + 1
    assert np.allclose(m.idf, [idf(k) for k in range(langid.DIMS)])
    vec = lambda b: unit({k: (1 + math.log(n)) * idf(k) for k, n in b.items()})
    x = {lang: [vec(b) for name, b in bags if name == lang] for lang in WORDS}
    dense = m.centroids.T
    for lang, limit in m.limits.items():
        mine = [dense[i] for i in range(len(m.langs)) if m.langs[i] == lang]
        assert 1 <= len(mine) <= langid.CLUSTERS
        own = [[sum(v * c[k] for k, v in t.items()) for c in mine] for t in x[lang]]
        # a centroid is the unit mean direction of the texts nearest to it
        for j, c in enumerate(mine):
            total = {}
            for t, cos in zip(x[lang], own, strict=True):
                if max(range(len(mine)), key=lambda i: cos[i]) == j:
                    for k, v in t.items():
                        total[k] = total.get(k, 0) + v
            want = np.zeros(langid.DIMS)
            for k, v in unit(total).items():
                want[k] = v
            assert np.allclose(c, want, atol=1e-4)
        assert limit == pytest.approx(np.quantile([1 - max(c) for c in own], langid.QUANTILE) * langid.SLACK, abs=1e-5)
    for text in ["the green river", "le haus", "zzz qqq", "wasser und stein", "rivière"]:
        t = vec(counted(text))
        cos = {}
        for lang, c in zip(m.langs, dense, strict=True):
            cos[lang] = max(cos.get(lang, -1), sum(v * c[k] for k, v in t.items()))
        best = max(sorted(cos), key=lambda name: cos[name])
        name, score, far, rejected = m.predict(text)
        assert name == best and score == pytest.approx(max(0, cos[best])) and far == pytest.approx(1 - cos[best]) and rejected == (1 - cos[best] > m.limits[best])


def test_clusters_against_plain_rounds():
    rng = np.random.default_rng(5)
    x = rng.random((40, 12)) ** 4
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    centres, near = [x.mean(0)], x @ x.mean(0)
    for _ in range(3):
        centres.append(x[min(range(40), key=lambda i: near[i])])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(12):
        own = [max(range(len(centres)), key=lambda j: float(x[i] @ centres[j])) for i in range(40)]
        new = [sum(x[i] for i in range(40) if own[i] == j) for j in range(len(centres)) if j in own]
        centres = [c / np.sqrt((c * c).sum()) for c in new]
    assert np.allclose(langid.cluster(x, 4), centres, atol=1e-6)


# --- toxicity


def grams(text):
    c, out = codes(text), set()
    for n in toxicity.SIZES:
        for i in range(len(c) - n + 1):
            h = c[i]
            for x in c[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + x) % 2**64
            out.add(mixed(h + n))
    return out


def test_toxicity_ratios_by_their_definition(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, "aa", 8) + (" scoundrel" if i % 3 == 0 else " gentleman" if i % 5 else ""), i) for i in range(60)]
    seen = {}

    def fit(at, col, y, weight, ratio):
        seen.update(ratio=ratio, y=y)
        return np.linspace(-1, 1, len(ratio)), 0.25

    monkeypatch.setattr(toxicity, "fit", fit)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    m = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3), labels)
    a, count = toxicity.ALPHA, {}
    size = [40, 20]
    for i, t, _ in rows:
        for g in grams(t):
            count.setdefault(g, [0, 0])[int(i % 3 == 0)] += 1
    want = {}
    for g, (q, p) in count.items():
        if p + q > 2:
            r = math.log((p + a) / (size[1] + 2 * a)) - math.log((q + a) / (size[0] + 2 * a))
            if abs(r) / math.sqrt(1 / (p + a) + 1 / (q + a)) >= toxicity.LEAST_Z:
                want[g] = r
    assert set(m.keys.tolist()) == set(want) and len(want) > 20
    assert sorted(seen["ratio"].tolist()) == pytest.approx(sorted(want.values()))
    # a text's score is the logistic of the bias and its features' weights, each once
    weight = dict(zip(m.keys.tolist(), m.weight.tolist(), strict=True))
    for t in [rows[0][1], rows[1][1], "", "scoundrel " * 5, "nothing known xyz"]:
        z = 0.25 + sum(weight.get(g, 0) for g in grams(t))
        assert m.score(t) == pytest.approx(1 / (1 + math.exp(-z)))


# --- plans, long texts, the pipeline


def test_mixing_joins_or_broadcasts_its_sources(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 9)), f"s{i % 4}" if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = sorted(map(str, mixing.mix_report(df).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 0)
    assert sorted(map(str, mixing.mix_report(df).collect())) == a


def test_losses_with_target_ids_joined_or_broadcast(spark, monkeypatch):
    rows = [(i, prose(random.Random(i), "aa", 12)) for i in range(30)] + [(99, None)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    key = lambda r: (r.doc_id, r.n_tokens, round(r.score, 9))
    a = sorted(map(key, lm.loss_report(df, labels).collect()))
    monkeypatch.setattr(lm, "BROADCAST", 0)
    assert sorted(map(key, lm.loss_report(df, labels).collect())) == a


def test_very_long_texts(spark):
    """A text of two million signs is taken as a whole by language, toxicity and losses: its end counts."""
    rng = random.Random(9)
    body = "the river " * 200_000
    rows = [(1, body + " " + "wasser und haus " * 200_000, "aa"), (2, body, "aa")] + [(10 + i, prose(rng, x, 9) + (" scoundrel" if i % 2 else ""), x) for i, x in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(df.where("doc_id >= 10"), "text", "lang", "doc_id")
    got = {r.doc_id: r.found for r in langid.identify(df, m, keep=["doc_id"]).collect()}
    for i in (1, 2):
        assert tuple(got[i]) == m.predict(rows[i - 1][1]) and got[i].lang_pred == "aa"
    assert got[1].score < got[2].score - 0.05
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(80)], "doc_id long, toxic int")
    t = toxicity.train(df, labels)
    score = {r.doc_id: r.found.score for r in toxicity.score(spark.createDataFrame([(1, body + "scoundrel"), (2, body)], "doc_id long, text string"), t, keep=["doc_id"]).collect()}
    assert score[1] > score[2]
    losses = {r.doc_id: r for r in lm.loss_report(df, spark.createDataFrame([(i, 1) for i in range(10, 20)], "doc_id long, quality int")).collect()}
    assert losses[1].n_tokens == 2 * 200_000 + 3 * 200_000 and losses[2].n_tokens == 400_000


def test_pipeline_stages_against_their_definitions(spark, tmp_path):
    """Mixing: floor(rate) copies and one by the hash; token output: the library's ids, over documents with columns of any names."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, prose(rng, "aa", 1 + i % 13) if i % 10 else None, "en", f"s{i % 3}", 0) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_found_", "found", "_mix", "_key", "_row", "i", "t", "x", "r", "a.b", "node"):
        docs = docs.withColumn(c, F.lit("?"))
    words = lambda t: len((t or "").split())
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + words(r[1])
    budget, target, free = 1.5 * sum(size.values()), {}, {s: w for s, w in zip(sorted(size), (5, 2, 1), strict=True)}
    while free:
        share = {s: (budget - sum(target.values())) * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * size[s]]
        for s in over or list(free):
            target[s] = 2 * size[s] if over else share[s]
            del free[s]
    want = {}
    for i, t, _, s, _ in rows:
        rate = target[s] / size[s]
        mark = f"{mixing.SEED}:{i}:{hashlib.md5((t or '').encode()).hexdigest()}"
        want[i] = int(rate) + (int(hashlib.md5(mark.encode()).hexdigest()[:12], 16) / 2**48 < rate - int(rate))
    mixed_docs = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed_docs.columns == docs.columns
    got = {}
    for r in mixed_docs.select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    tok = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    text = {r[0]: r[1] or "" for r in rows}
    start, out = 0, []
    for i in sorted(i for i, n in want.items() for _ in range(n)):
        ids = [*tok.encode(text[i], add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.token_shards(spark, mixed_docs, str(tmp_path)).collect()) == out
    # all stages over these columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text[11])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
