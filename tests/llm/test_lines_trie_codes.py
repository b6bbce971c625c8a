"""Line dedup, the conversations' trie and vector codes against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import codes, lines, trie

SPACE = " \t\n\x0b\x0c\r"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# --- lines


def texts(seed=5):
    rng = random.Random(seed)
    common = ["All rights reserved", "é à ü", "x", "Cookies: yes", "z" * 300]
    out = [None, "", "\n\n", "x", " X\t\r\nx", "one line", "\n".join(f"line {i}" for i in range(4000)) + "\nx"]
    for _ in range(60):
        own = [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(4))]
        own += [rng.choice(["", " ", "\t"]) + (c if rng.random() < 0.5 else c.upper()) + rng.choice(["", "\r", "  "]) for c in rng.sample(common, rng.randrange(4))]
        rng.shuffle(own)
        out.append("\n".join(own))
    out += ["Copy of a text\nwith its lines\nand an end"] * 25
    return out


def doc_rows():
    rows = [(i, t) for i, t in enumerate(texts())]
    return [*rows, (None, "no id\nx"), (3, "x"), (3, "x")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in ("found", "_text_", "_row_", "_more_", "key", "row", "id", "n", "a.b"):
        df = df.withColumn(c, F.lit("?"))
    return df


def kept_lines(rows, least, keep_first=False):
    split = [(t or "").split("\n") for _, t in rows]
    where = {}
    for r, ls in enumerate(split):
        for i, x in enumerate(ls):
            where.setdefault(lowered(x).strip(SPACE), []).append((r, i))
    bad = {k: w for k, w in where.items() if k and len({r for r, _ in w}) >= least}
    out = []
    for r, ls in enumerate(split):
        kept = []
        for i, x in enumerate(ls):
            k = lowered(x).strip(SPACE)
            first = k in bad and keep_first and min(bad[k], key=lambda p: (rows[p[0]][0] is None, rows[p[0]][0], p[1])) == (r, i)
            if k not in bad or first:
                kept.append(x)
        out.append((rows[r][0], len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def found(df):
    return sorted(((r.doc_id, r.f.n_lines, r.f.n_dropped, r.f.text) for r in df.select("doc_id", F.col("found_").alias("f")).collect()), key=str)


@pytest.mark.parametrize(("least", "common", "most"), [(10, lines.COMMON, lines.SEGMENTS), (2, 3, 1), (10, 1, lines.SEGMENTS)])
def test_lines(spark, least, common, most):
    """Broadcast lines, joined lines and both; the struct takes a free name."""
    rows = doc_rows()
    got = lines.drop_lines(frame(spark, rows), least=least, common=common, most=most)
    assert got.columns == [*frame(spark, rows).columns, "found_"]
    assert found(got) == sorted(kept_lines(rows, least), key=str)


@pytest.mark.parametrize("common", [lines.COMMON, 1])
def test_lines_keep_first(spark, common):
    rows = [r for r in doc_rows() if r[0] != 3 and r[0] is not None]
    got = lines.drop_lines(frame(spark, rows), keep_first=True, common=common)
    assert found(got) == sorted(kept_lines(rows, 10, True), key=str)


def test_line_report(spark):
    rows = doc_rows()
    got = sorted((tuple(r) for r in lines.line_report(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in kept_lines(rows, 10)], key=str)
    assert lines.line_report(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="least"):
        lines.drop_lines(frame(spark, rows), least=1)


def test_few_lines_are_suspected(spark):
    """The second filter holds every repeated line and next to none of the others, so little is shuffled."""
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(50)] + ["shared"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    filt, segments = lines.twice_filter(df.select("text"), 200 * 51)
    src = df.select("text", F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").alias("id"))
    seen = lines._counted(src, filt, segments).collect()
    places = {}
    for r in seen:
        places[bytes(r.key)] = places.get(bytes(r.key), 0) + r.n
    assert places[hashlib.md5(b"shared").digest()] == 200 and len(places) < 20


# --- conversations


def conversations(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), 100, 107, 113, 240, 999, -3, -25]:
        first = rng.choice(["hi", "Hello  there", ""])
        for i in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, i, "user" if i % 2 == 0 else "bot", first if i == 0 else rng.choice(["yes", "no way", "ok then"])))
    rows += [(40, None, None, None), (41, 1, "user", "tie"), (41, 1, "user", "tie"), (41, 1, "bot", "tie"), (None, 0, "user", "nobody's")]
    rows += [(20, i, "user", f"turn {i}") for i in range(100, 400)]
    rng.shuffle(rows)
    return rows


def trie_wanted(rows, every=20, most=4):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(ts)] for c, ts in own.items()}
    new = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        new[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + ts[h:]
    nodes = {}
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for s, members in nodes.items():
        under = [k for k in nodes if k[: len(s)] == s]
        kids = [k for k in under if len(k) == len(s) + 1]
        leaves = sum(not any(len(k) == len(u) + 1 and k[: len(u)] == u for k in under) for u in under)
        saved = sum((len(nodes[u]) - 1) * len(u[-1][1].split()) for u in under if u)
        ends = ",".join(str(c) for c in sorted(members) if len(new[c]) == len(s))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 2)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    for c in ("place", "key", "parent", "up", "u", "h", "n", "a.b"):
        df = df.withColumn(c, F.lit("?"))
    assert sorted((tuple(r) for r in trie.trie_report(df).collect()), key=str) == trie_wanted(rows)
    assert trie.trie_report(df.where("false")).count() == 0


def test_conversation_of_no_turns_left(spark):
    """Conversations shorter than h whose base isn't there end at the root."""
    short = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:6]
    rows = [(c, i, "user", "t") for c in short for i in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in trie.trie_report(df).collect()), key=str) == trie_wanted(rows)


def test_roll_up_takes_rounds_by_the_logarithm(spark, monkeypatch):
    """A chain of 300 nodes with a bush at its end: 9 jumps double 300 levels."""
    n = 300
    rows = [(i, i - 1 if i else None, 1) for i in range(n)] + [(n + i, n - 1, 2) for i in range(500)]
    rounds, plain = [], trie.lookup
    monkeypatch.setattr(trie, "lookup", lambda *a, **k: rounds.append(1) or plain(*a, **k, least=100))
    df = spark.createDataFrame([(str(i).encode(), None if p is None else str(p).encode(), v) for i, p, v in rows], "key binary, parent binary, v long")
    got = {int(bytes(r.key)): r.v for r in trie.roll_up(df, ["v"]).collect()}
    assert got == {i: n - i + 1000 for i in range(n)} | {n + i: 2 for i in range(500)}
    assert len(rounds) == math.ceil(math.log2(n + 1))


# --- codes


def vectors(seed=4, n=300, width=32):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(0, 0.05, (n, width)) * 64) / 256  # few values, so that there are ties
    rows = [(int(i), [float(np.float32(x)) for x in v[i]], int(i) % 3 if i % 7 else None) for i in rng.permutation(n)]
    bad = [(500, None, 1), (501, [], 1), (502, [0.1] * (width - 1) + [None], 1), (503, [float("nan")] * width, 1), (504, [float("inf")] + [0.0] * (width - 1), 1), (505, [0.5] * (width + 16), 2), (506, [0.5] * 5, 2), (507, [1e30] * width, 0)]
    return [*rows, *bad, rows[0], (None, rows[1][1], 9), (5000, [0.0] * width, None)], width


def lloyd(rows, width, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds over Python integers."""
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    book = [[cut(v, p) for _, v, _ in ok[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(book[p])), key=lambda j: (dist(cut(v, p), book[p][j]), j)) for p in range(parts)] for _, v, _ in ok]
    for _ in range(rounds):
        a = assign()
        for p in range(parts):
            for j in range(len(book[p])):
                mine = [cut(v, p) for (_, v, _), c in zip(ok, a, strict=True) if c[p] == j]
                if mine:
                    book[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    a = assign()
    err = [sum(dist(cut(v, p), book[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(ok, a, strict=True)]
    total = {}
    for (_, _, lab), e in zip(ok, err, strict=True):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{j:02x}" for j in c), e, total[lab], sha) for (i, _, lab), c, e in zip(ok, a, err, strict=True)], key=str), book


def vector_frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    for c in ("code", "error", "ints", "k0", "id", "vec", "its", "upper", "a.b"):
        df = df.withColumn(c, F.lit("?"))
    return df


def test_codes(spark):
    rows, width = vectors()
    want, _ = lloyd(rows, width)
    assert sorted((tuple(r) for r in codes.code_report(vector_frame(spark, rows)).collect()), key=str) == want
    assert codes.code_report(vector_frame(spark, [])).count() == 0


def test_few_vectors_make_few_entries(spark):
    rows, width = vectors(n=20)
    want, _ = lloyd(rows, width)
    assert sorted((tuple(r) for r in codes.code_report(vector_frame(spark, rows)).collect()), key=str) == want


def test_decode(spark):
    rows, width = vectors()
    df, book = codes.encode(vector_frame(spark, rows), entries=16, rounds=3)
    assert df.columns == [*vector_frame(spark, rows).columns, "code_", "error_"]
    got = codes.decode(df.select("code_", "error_", "embedding"), book, "code_").collect()
    for r in got:
        ints = np.floor(np.array(r.embedding, np.float64) * 256)
        assert round(((np.array(r.vector) * 256 - 0.5 - ints) ** 2).sum()) == r.error_


@pytest.mark.parametrize("seed", range(4))
def test_bounds_change_nothing_and_save_distances(seed):
    rng = np.random.default_rng(seed)
    scale = [2, 30, 400, 1 << 26][seed]
    c = rng.integers(-scale, scale + 1, (40, 4))
    x = (c[rng.integers(0, 40, 3000)] + rng.integers(-max(1, scale // 20), max(2, scale // 20), (3000, 4))).astype(np.int64)
    code, d2 = codes.nearest(x, c)
    upper, lower, done = codes._up(d2[np.arange(3000), code]), codes._down(d2), 0
    for _ in range(5):
        new = c.copy()
        for j in np.unique(code):
            new[j] = x[code == j].sum(0) // (code == j).sum()
        code, upper, lower, n = codes.moved(x, new, c, code, upper, lower)
        want, all_d2 = codes.nearest(x, new)
        assert (code == want).all()
        root = np.sqrt(all_d2.astype(np.float64))
        assert (codes._floats(lower) <= root).all() and (upper >= root[np.arange(3000), code]).all()
        c, done = new, done + n
    if scale >= 30:
        assert done < 5 * 3000 * 40 / 8
