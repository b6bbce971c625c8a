"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy, with nulls, empties, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, jaccard, kernel, langid, lm, mixing, neardup, pieces, pii, repair, shared, toxicity

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1):
    """Documents with copies, near copies, a shared passage, nulls, empties, a long text and an id on two rows."""
    rng = random.Random(seed)
    shared_part = prose(rng, 12)
    texts = [prose(rng, rng.randrange(3, 90)) for _ in range(30)]
    for k in (2, 3, 5):
        w = texts[k].split()
        for _ in range(4):
            v = list(w)
            for _ in range(max(1, len(v) // 40)):
                v[rng.randrange(len(v))] = "x" + str(rng.randrange(99))
            texts.append(" ".join(v))
        texts.append(texts[k].upper() + " ")
    texts += [shared_part + " " + prose(rng, 40) for _ in range(6)] + [None, "", " \n\t", "é ñ", "one two", "One two", prose(rng, 4000), "!!! ???", texts[2]]
    rows = [(i, t, "en", "s%d" % (i % 3) if i % 7 else None, 0) for i, t in enumerate(texts)]
    return [*rows, (5, texts[5], "en", None, 0), (None, "no id here at all", None, "s1", 0)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, "doc_id long, text string, lang string, source string, n_chars long")


def clash(df):
    """Extra columns of the names that operators use inside."""
    for c in ("id", "node", "found", "_found_", "_mix", "_more_", "_row", "_key", "_s", "n", "size", "draw", "score", "kept", "_text_", "a.b"):
        df = df.withColumn(c, F.lit("?"))
    return df


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [q[0] for j, q in enumerate(rows) if find(j) == find(i) and q[0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return out


def same(df, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_jaccard(spark):
    rows = corpus()
    same(jaccard.jaccard_report(clash(frame(spark))), groups(rows))
    assert jaccard.jaccard_report(frame(spark, [])).count() == 0


def test_jaccard_keeps_one(spark):
    rows = corpus()
    got = jaccard.keep_one(clash(frame(spark)))
    assert set(got.columns) == set(clash(frame(spark)).columns)
    want = groups(rows)
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, n, c in want if n and c is not None} | {i for i, n, _ in want if not n and i is not None})
    assert ids.count(5) <= 1 and None in ids


def test_jaccard_keeps_unlike_texts_without_own_ids(spark):
    """Null ids and repeated ids join no groups: every unlike text stays, near copies leave one."""
    rng = random.Random(12)
    unlike = [prose(rng, 40) for _ in range(10)]
    near = unlike[0] + " end"
    ids = [None] * 5 + [7, 7, 8, 8, 9]
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, unlike, strict=True)] + [(None, near, "en", "s", 0), (7, unlike[5], "en", "s", 0)]
    got = sorted((r.doc_id is None, r.text) for r in jaccard.keep_one(clash(frame(spark, rows))).collect())
    assert len(got) == 10 and {t for _, t in got} | {near} == set(unlike) | {near} and {unlike[0], near} - {t for _, t in got}
    # the same where nothing links
    assert sorted(r.text for r in jaccard.keep_one(frame(spark, rows[:10])).collect()) == sorted(unlike)


@pytest.mark.parametrize("seed", range(3))
def test_tree_loses_no_pair(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 62, 150).astype(np.uint64) for _ in range(4)]
    sets = []
    for i in range(60):
        b = base[i % 4].copy()
        b[: rng.integers(0, 40)] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(b))
    rows = [(i, len(s), i, len(sig := jaccard.signature(s)) * 8, int.from_bytes(sig, "little"), [0]) for i, s in enumerate(sets)]
    got, full = jaccard.tree_pairs(list(rows), None, 10**6)
    want = {(i, j) for j in range(60) for i in range(j) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))}
    assert want <= set(got) and not full and len(set(got)) < 60 * 59 // 2
    left, right = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
    across, _ = jaccard.tree_pairs(left, right, 10**6)
    assert {p for p in want if (p[0] + p[1]) % 2} <= set(across)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 600)]
    got = {r.node: r.label for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        new = dict(root)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 16))
    x = np.concatenate([x, x[:10] + 0.02 * rng.standard_normal((10, 16)), x[:5], x[:3] * 7])
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [float("inf")] * 16), (906, [1.0]), (907, [2.0]), (0, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("?"))
    got = neardup.vector_report(df).collect()
    ok = [bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, ok, strict=True)]
    link = lambda i, j: i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95
    near = [[j for j in range(len(rows)) if link(i, j)] for i in range(len(rows))]
    want = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        want.append((rows[i][0], len(near[i]), c, rows[i][0] is not None and rows[i][0] == c))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_vector_recall_at_the_threshold(spark):
    """Recall on planted pairs of cosine 0.95 to 0.99, against their exact cosines; hubs of many links stay whole."""
    rng = np.random.default_rng(8)
    n, d = 1500, 64
    for cosine, least in ((0.951, 0.985), (0.96, 0.995), (0.98, 1.0)):
        x = rng.standard_normal((n, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = rng.standard_normal((n, d))
        o -= (o * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
        got = neardup.vector_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        found = got.where("n_links = 1 and vec_id >= %d and component_id = vec_id - %d" % (n, n)).count()
        assert found >= least * n and got.where("n_links > 1").count() == 0
    hub = np.ones(d) / np.sqrt(d)
    rows = [(i, (hub + 0.01 * rng.standard_normal(d)).tolist()) for i in range(3000)]
    got = neardup.vector_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("component_id = 0 and n_links = 2999").count() == 3000
    assert neardup.vector_report(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_empty_tables(spark):
    none, lab = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.language_report(none).count() == pieces.count_report(none).count() == 0
    assert toxicity.toxicity_report(none, lab).count() == lm.loss_report(none, lab).count() == 0


def test_decontamination(spark):
    rows = corpus()
    tail = next(r[1] for r in rows if r[0] == 48)
    long_text = max((r[1] or "" for r in rows), key=len)
    items = [(1, " ".join(tail.split()[:11])), (2, "ONE,two"), (2, "one two"), (3, None), (4, "?!"), (5, " ".join(long_text.split()[-15:])), (6, "é ñ"), (30, "here"), (7, " ".join(["alpha1"] * 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    want = []
    for r in rows:
        w, hit, its = norm(r[1]), set(), set()
        for i, t in items:
            p = norm(t)
            m = min(10, len(p))
            for a in range(len(p) - m + 1) if m else ():
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == p[a : a + m]:
                        hit |= set(range(b, b + m))
                        its.add(str(i))
        want.append((r[0], len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    assert sum(w[5] for w in want) > 3
    same(decontaminate.decontaminate_report(clash(frame(spark)), bench), want)
    more = [(900, "ÉCOLE Zebra-QUAGGA 7_x no benchmark", "en", "s", 0)]
    small = decontaminate.decontaminate(frame(spark, [*rows, *more]), bench, block=5, keep=["doc_id"]).select("doc_id", "found.n_words", "found.n_hit")
    same(small, [*[(w[0], w[1], w[2]) for w in want], (900, len(norm(more[0][1])), 0)])
    # several blocks keep every column and merge runs and items
    cols = [c for c in clash(frame(spark)).columns]
    one, many = (decontaminate.decontaminate(clash(frame(spark)), bench, block=b) for b in (10**6, 5))
    assert one.columns == many.columns == [*cols, "found_"]
    pick = lambda df: df.select("doc_id", "text", "found_")
    same(pick(many), [tuple(r) for r in pick(one).collect()])
    assert not decontaminate.decontaminate_report(frame(spark), bench.limit(0)).where("contaminated").count()
    assert decontaminate.decontaminate_report(frame(spark, []), bench).count() == 0


def test_mixing(spark):
    rows = corpus()
    r = {x.id if x.id is not None else -1: x for x in mixing.rates(clash(frame(spark))).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for x in rows:
        by[x[3]] = by.get(x[3], 0) + size(x[1])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(by.values())
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * by[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * by[s]
            left -= target[s]
            free.discard(s)
    for x in rows:
        got = r[x[0] if x[0] is not None else -1]
        assert got.source_size == by[got.source] and got.target == pytest.approx(target[got.source]) and 0 <= got.copies <= 2
    n = mixing.mix(clash(frame(spark)))
    assert n.columns == clash(frame(spark)).columns
    assert n.count() == mixing.rates(frame(spark)).agg(F.sum("copies")).first()[0]
    assert mixing.mix_report(frame(spark, [])).count() == 0


def test_mixing_draws_apart_without_ids(spark):
    """A third of the words under null ids and as many under one id: each source's taken words come near its target."""
    rng = random.Random(14)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, prose(rng, rng.randrange(5, 40)), "en", f"s{i % 4}", 0) for i in range(3000)]
    got = mixing.rates(frame(spark, rows))
    by = got.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most")).collect()
    assert len(by) == 4 and all(abs(r.taken / r.target - 1) < 0.06 and r.most <= 2 for r in by)
    again = sorted((r.size, r.copies) for r in mixing.rates(frame(spark, rows).repartition(7)).collect())
    assert again == sorted((r.size, r.copies) for r in got.collect())


def test_repair_round_trip():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 9, 5000), np.zeros(1000, int), np.arange(50), np.zeros(0, int), np.tile([1, 2, 3, 4], 700)):
        bounds = np.concatenate([[0], np.sort(rng.integers(0, len(ids) + 1, 7)), [len(ids)]])
        ids = ids.astype(np.uint32)
        s = repair.Shard(repair.write_shard(np.arange(8), ids, bounds))
        for k in range(8):
            part = ids[bounds[k] : bounds[k + 1]]
            assert (s.document(k) == part).all()
            for a, b in ((0, len(part)), (1, 4), (len(part) // 3, len(part) // 2)):
                a, b = min(a, len(part)), min(b, len(part))
                if a < b:
                    assert (s.ids(k, a, b) == part[a:b]).all()
    assert len(repair.write_shard(np.arange(1), np.tile([1, 2, 3, 4], 7000).astype(np.uint32), np.array([0, 28000]))) < 3000


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    """Where two words share a hash, their texts are still encoded exactly."""
    enc = repair.Encoder(repair.default_tokenizer())
    texts = ["the cat sat", "a dog ran", "the dog sat by the cat", "über cats", "the cat"]
    monkeypatch.setattr(repair, "mix", lambda h: h & np.uint64(1))
    for _ in range(2):
        ids, at = enc.encode(pa.array(texts), 2)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*enc.tok.encode(t, add_special_tokens=False).ids, 2]


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(repair.default_tokenizer())
    rows = [*corpus(), (70, "It's 'S we'LL rock'n'roll <|endoftext|> a\x1cb \x7f ×÷ Ünïcode 🎉 ǅ İ ß x\x85y\xa0z 一", None, None, 0)]
    want, at = [], 0
    for i, t in sorted(((-1 if r[0] is None else r[0], r[1]) for r in rows), key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = repair.token_report(clash(frame(spark, rows)))
    same(got, want)
    shards = repair.write_shards(frame(spark, rows), repair.default_tokenizer(), shard=300, partitions=3)
    assert shards.count() > 3
    same(repair.read_shards(shards).select("doc_id", "start", "n_tokens", "ids_crc32"), want)
    assert repair.token_report(frame(spark, [])).count() == 0


def test_piece_counts(spark):
    vocab = {"a", "ab", "abc", "b", "bcd</w>", "c</w>", "cd", "abcdef</w>", "d</w>", "e"}

    def brute(w):
        w, n, i = w + "\0", 0, 0
        while i < len(w):
            for j in range(len(w), i, -1):
                s = w[i:j].replace("\0", "</w>")
                if s in vocab or s == "</w>":
                    break
            else:
                return 0
            n, i = n + (s != "</w>"), j
        return n

    auto = pieces.Automaton(vocab)
    rng = random.Random(6)
    for _ in range(4000):
        w = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12)))
        assert auto.count(w) == brute(w), w
    got = pieces.count_report(clash(frame(spark))).collect()
    assert len(got) == len(corpus()) and all(r.n_tokens >= r.n_words and not r.n_unknown for r in got)


def test_piece_counts_of_texts():
    """Whole texts against greedy longest match word by word, a very long one included."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = set(json.load(f)["model"]["vocab"])
    auto, known = pieces.loaded(public_tokenizers.path("word_bpe_49k.json"))

    def brute(text):
        total = unknown = n = 0
        for w in re.findall(r"\w+|[^\w\s]+", text.lower()):
            s, k, i = pieces.spell(w), 0, 0
            n += 1
            while i < len(s):
                for j in range(len(s), i, -1):
                    if s[i:j] in vocab or j == len(s) and s[i:j] + "</w>" in vocab:
                        break
                else:
                    k = 0
                    break
                k, i = k + 1, j
            total, unknown = total + (k or 1), unknown + (not k)
        return n, total, unknown

    rng = random.Random(15)
    texts = [prose(rng, 30) + " Naïve, über-cool 日本 x_y!! 3.14", "", "...", " ".join(prose(rng, 5) for _ in range(8000))]
    for t in texts:
        assert pieces.count_text(t, auto, known) == brute(t)


def test_language(spark):
    rng = random.Random(7)
    sets = {"aa": "kalo mipo tuna riva", "bb": "strumpf grund zwerg knecht", "cc": "ouvre bleau chaise peu"}
    rows = [(i, " ".join(rng.choice(sets[lang].split()) for _ in range(20)), lang, None, 0) for i, lang in enumerate(list(sets) * 60)]
    rows += [(1000, None, "aa", None, 0), (1001, "123 !?", None, None, 0), (1002, "", "bb", None, 0), (1003, "ЖЖЖЖ ЩЩЩ", None, None, 0), (None, "kalo kalo", None, None, 0)]
    got = {r.doc_id: r for r in langid.language_report(clash(frame(spark, rows))).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:180])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[None].lang_pred == "aa" and got[None].held_out is False
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(180))
    assert {r.lang_pred for r in langid.language_report(frame(spark, [(1, "x", None, None, 0)])).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rng, 30).split()
        if bad:
            t[rng.randrange(30)] = rng.choice(["scoundrel", "blackguard!!", "Scoundrel###"])
        rows.append((i, " ".join(t), "en", None, 0))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (None, "fine", None, None, 0)]
    labels += [(None, 1, 1), (5000, 1, None), (3, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(clash(frame(spark, rows)), lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[None].score < 0.5
    assert toxicity.toxicity_report(frame(spark, rows), lab.limit(0)).where("score <> 0.5").count() == 0


def test_toxicity_fit_against_plain_descent():
    """The blocked accelerated fit against plain gradient steps on the dense matrix."""
    rng = np.random.default_rng(3)
    x = rng.random((60, 25)) < 0.3
    y, weight, ratio = (rng.random(60) < 0.4).astype(float), rng.random(60) + 0.5, rng.standard_normal(25)
    at = np.concatenate([[0], np.cumsum(x.sum(1))])
    w, b = toxicity.fit(at, np.nonzero(x)[1], y, weight, ratio, penalty=1.0, rounds=3000)
    z, v, c = x * ratio, np.zeros(25), 0.0
    for _ in range(60_000):
        g = weight * (1 / (1 + np.exp(-(z @ v + c))) - y)
        v, c = v - 0.01 * (z.T @ g + v), c - 0.01 * g.sum()
    assert np.allclose(w, v, atol=1e-4) and abs(b - c) < 1e-4


def test_toxicity_sample_holds_unlike_texts(spark, monkeypatch):
    """Neither copies nor labels without a text use up the sample, and a shared passage doesn't make texts copies."""
    rng = random.Random(13)
    part = prose(rng, 30)
    rows = [(i, f"{prose(rng, 8)} {part} word{i}", "en", None, 0) for i in range(40)]
    rows += [(100 + i, "the very same clean text", "en", None, 0) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, 8)} {part} scoundrel", "en", None, 0) for i in range(40)]
    labels = [(r[0], 1, int(r[0] >= 1000)) for r in rows] + [(5000 + i, 1, 1) for i in range(300)]
    seen = {}

    def fit(at, col, y, weight, ratio):
        seen.update(texts=len(y), toxic=int(y.sum()))
        return np.zeros(len(ratio)), 0.0

    monkeypatch.setattr(toxicity, "fit", fit)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxicity.train(frame(spark, rows), lab, sample=40)
    assert seen == {"texts": 80, "toxic": 40}
    toxicity.train(frame(spark, rows), lab)
    assert seen == {"texts": 81, "toxic": 40}
    monkeypatch.setattr(toxicity, "BROADCAST", 10)
    toxicity.train(frame(spark, rows), lab)
    assert seen == {"texts": 81, "toxic": 40}
    assert (toxicity.SAMPLE, toxicity.FEATURES) == (4000, 1 << 14)


def test_personal_data(spark):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(9)
    bits = ["a.b@c.de", "x@@y.z", "@q.r", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "0004.3.2.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (826) 555-4081", "+12", "+1+2 345 678 90", "é", "\n", "m@n", "p@q.r.", "..", "7-7"]
    texts = [" ".join(rng.choice(bits) + rng.choice(["", ",", "é"]) for _ in range(12)) for _ in range(300)] + ["1" * 5000, "a" * 5000 + "@", "@" * 2000, "1.1." * 900, ""]

    def base(t):
        out = []
        for k, (name, p) in enumerate(rx.items()):
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m.group())
                ok = name == "email" or name == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or name == "phone" and 9 <= len(d) <= 15 or name == "card" and 12 <= len(d) <= 19 and pii.luhn(d)
                if ok:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for t in texts:
        assert pii.base_spans(t) == base(t), t[:200]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(999, None, None, None, 0), (None, "call +49 30 1234567", None, None, 0)]
    got = {r.doc_id: r for r in pii.personal_data_report(clash(frame(spark, rows))).collect()}
    for i, t in enumerate(texts):
        b = base(t)
        s = ",".join(f"{list(rx)[k]}:{a}:{z}" for a, k, z in b)
        assert got[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest() and got[i].n_email == sum(k == 0 for _, k, _ in b)
        assert set(filter(None, s.split(","))) <= set(got[i].spans.split(","))
    assert got[999].spans == "" and got[None].n_phone == 1


def test_personal_data_learns_contexts(spark):
    rows = [(i, f"word{i} please call phone +49 30 12345{i:02d} thanks", None, None, 0) for i in range(20)]
    rows += [(50, "please call phone 555 123 4567 thanks", None, None, 0), (51, "the number 555 123 9999 was random", None, None, 0)]
    got = {r.doc_id: r for r in pii.personal_data_report(frame(spark, rows)).collect()}
    assert got[50].spans == "phone:18:30" and got[50].n_phone == 0 and got[51].spans == ""


def test_personal_data_learns_each_kind(spark):
    """Planted identifiers that no base pattern takes, of each kind, among decoys: precision and recall of what the method adds."""
    rng = random.Random(16)
    luhn = lambda d: next(d + str(k) for k in range(10) if pii.luhn(d + str(k)))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    known = {"email": lambda: f"write to mailbox {prose(rng, 1)}@{prose(rng, 1)}.org today", "ip": lambda: f"server with address {rng.randrange(256)}.{rng.randrange(256)}.1.2 answered", "card": lambda: f"charged my card {luhn(number(15))} twice", "phone": lambda: f"please call phone +49 30 {number(7)} thanks"}
    hidden = {"email": (lambda: f"{prose(rng, 1)}@localhost", "write to mailbox {} today"), "ip": (lambda: f"10.{rng.randrange(100, 256)}.{rng.randrange(100, 256)}", "server with address {} answered"), "card": (lambda: next(d for d in iter(lambda: number(16), None) if not pii.luhn(d)), "charged my card {} twice"), "phone": (lambda: f"030 {number(7)}", "please call phone {} thanks")}
    rows, want = [], {}
    for k, make in known.items():
        rows += [(len(rows) + i, f"{prose(rng, 6)} {make()} {prose(rng, 4)}", None, None, 0) for i in range(60)]
    for k, (make, frame_) in hidden.items():
        for _ in range(20):
            one, head = make(), prose(rng, 5) + " "
            rows.append((len(rows), head + frame_.format(one) + " " + prose(rng, 3), None, None, 0))
            a = len(head) + frame_.index("{}")
            want[rows[-1][0]] = f"{k}:{a}:{a + len(one)}"
    for _ in range(60):  # numbers and words with an @ in other contexts
        rows.append((len(rows), f"{prose(rng, 4)} item {number(3)} {number(5)} costs {prose(rng, 2)} x@{prose(rng, 1)} {prose(rng, 2)}", None, None, 0))
    # a far context, and a very long word
    rows.append((9000, "please call phone" + " ." * 60 + " 030 7654321", None, None, 0))
    rows.append((9001, "write to mailbox " + "q" * 200 + "@" + "r" * 200 + " today", None, None, 0))
    got = {r.doc_id: r for r in pii.personal_data_report(frame(spark, rows)).collect()}
    n = {r[0]: sum((got[r[0]].n_email, got[r[0]].n_ip, got[r[0]].n_card, got[r[0]].n_phone)) for r in rows}
    assert all(n[i] == 1 for i in range(240)) and not any(n[i] for i in want)
    added = {i: set(filter(None, got[i].spans.split(","))) for i in got if not n[i]}
    right = sum(want[i] in added[i] for i in want)
    assert right >= 0.9 * len(want) and sum(len(s) for s in added.values()) - right <= 0.05 * right + 2
    assert got[9000].spans.startswith("phone:") and got[9001].spans == "email:17:418"
    assert pii.personal_data_report(frame(spark, [])).count() == 0


def test_loss_difference(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(WORDS[:8] if i % 2 else WORDS[6:]) for _ in range(60)), None, None, 0) for i in range(80)]
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (902, "neverseen", None, None, 0)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm.loss_report(clash(frame(spark, rows)), labels).collect()}
    good, bad = [got[i].score for i in range(60, 80) if i % 2], [got[i].score for i in range(60, 80) if not i % 2]
    assert max(good) < min(bad) and got[900].score == got[901].n_tokens == 0
    # losses of one document against the definition
    ids = {r[0]: (r[1] or "").split() for r in rows}
    i = 61
    big = [w for k, ws in ids.items() if k != i for w in ws]
    pairs = [p for k, ws in ids.items() if k != i for p in zip(ws[:-1], ws[1:], strict=True)]
    v = len({w for ws in ids.values() for w in ws}) + 1
    total = 0.0
    for k, w in enumerate(ids[i]):
        p = (big.count(w) + lm.ALPHA) / (len(big) + lm.ALPHA * v)
        if k:
            c = big.count(ids[i][k - 1])
            lam = c / (c + lm.KAPPA)
            p = lam * pairs.count((ids[i][k - 1], w)) / max(c, 1) + (1 - lam) * p
        total -= np.log2(p)
    assert got[i].loss_background == pytest.approx(total / len(ids[i]))


def test_loss_counts_every_word_and_bigram(spark, monkeypatch):
    """More distinct words than 65,536, over many sheets and ranges: rare words keep their own counts."""
    monkeypatch.setattr(lm, "SHEET", 50_000, raising=False)
    monkeypatch.setattr(lm, "KEYS", 10_000, raising=False)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(700)), None, None, 0) for i in range(100)]
    rows += [(200, "rare pair of words", None, None, 0), (200, "rare pair again", None, None, 0), (None, "rare bird", None, None, 0)]
    labels = spark.createDataFrame([(200, 1, 0)], "doc_id long, quality int, toxic int")
    got = [r for r in lm.loss_report(frame(spark, rows), labels).collect() if r.n_tokens < 5]
    texts = [r[1].split() for r in rows]
    v = len({w for t in texts for w in t}) + 1
    assert v > 70_000 and len(got) == 3
    for r in got:
        mine = next(t for t in texts if len(t) == r.n_tokens)
        for col, models in (("loss_background", texts), ("loss_target", texts[100:102])):
            rest = [t for t in models if t is not mine]
            words, pairs = [w for t in rest for w in t], [p for t in rest for p in zip(t[:-1], t[1:], strict=True)]
            total = 0.0
            for k, w in enumerate(mine):
                p = (words.count(w) + lm.ALPHA) / (len(words) + lm.ALPHA * v)
                if k:
                    c = words.count(mine[k - 1])
                    p = c / (c + lm.KAPPA) * pairs.count((mine[k - 1], w)) / max(c, 1) + lm.KAPPA / (c + lm.KAPPA) * p
                total -= np.log2(p)
            assert r[col] == pytest.approx(total / len(mine)), (mine, col)


def test_word_kernel():
    rng = random.Random(11)
    texts = ["".join(rng.choice("aB 9\n-é ") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None]
    data, bounds = kernel.strings(pa.array(texts, pa.string()).slice(3))
    for kind, rx in ((kernel.SPACED, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        starts, ends, at = kernel.words(data, bounds, kind)
        h = kernel.word_hashes(data, starts, ends)
        names = {}
        for i, t in enumerate(texts[3:]):
            want = re.findall(rx, lowered(t)) if kind is kernel.SPACED else re.findall(rx, lowered(t))
            assert [lowered(data[a:b].tobytes().decode()) for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)] == want
            for w, x in zip(want, h[at[i] : at[i + 1]].tolist(), strict=True):
                assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [r for r in corpus() if r[0] is not None]
    labels = []
    for i in range(100, 300):
        t = prose(rng, 30).split()
        if i % 4 == 0:
            t[3] = "scoundrel"
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[10][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        new = shared.cut(stage(spark, docs, str(tmp_path)))
        assert new.columns == docs.columns
        before, ids = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in new.collect()}
        if k == 0:
            assert {i for i in before if i >= 100} - ids == {i for i in range(100, 300) if i % 4 == 0}
        if k == 1:
            left = [(i, t, None, None, 0) for i, t in sorted(before.items())]
            assert ids == {c if n else i for i, n, c in groups(left)}
        if k == 2:
            assert rows[10][0] in before and rows[10][0] not in ids and len(before) - len(ids) <= 2
        docs = new
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_encoder_forgets_words_without_changing_ids():
    path = repair.default_tokenizer()
    letters = [chr(97 + i // 20) + chr(97 + i % 20) for i in range(400)]
    texts = [f"{x}word {x}är other{i % 7} und Straße {i}" for i, x in enumerate(letters)]
    few, all_ = repair.Encoder(path, 50), repair.Encoder(path)
    for a in range(0, 400, 20):
        col = pa.array(texts[a : a + 20])
        got, ends = few.encode(col, 2)
        want, bounds = all_.encode(col, 2)
        assert got.tolist() == want.tolist() and ends.tolist() == bounds.tolist()
        for i, t in enumerate(texts[a : a + 20]):
            assert got[ends[i] : ends[i + 1]].tolist() == [*all_.tok.encode(t, add_special_tokens=False).ids, 2]
    assert len(few.keys) < len(all_.keys)
