"""Nearest neighbours, spelling variants and collocations against brute-force versions, with hard rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventlake.llm import neighbours, phrases, spelling
from eventlake.session import ship_package

DOCS = "doc_id long, text string, lang string, word string, n int, rank int"


def docs(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "word", 1, 2) for i, t, lang in rows], DOCS)


def product(v, w):
    total = 0.0
    for a, b in zip(v, w):
        total += a * b  # sum() would compensate
    return total


def brute_nearest(rows, k, every):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, v in ok:
        if i % every == 0:
            found = sorted((-product(v, w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


def test_op11_equals_brute_force(spark):
    ship_package(spark)
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=24)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 24) for i in range(130)]  # a third of copies, queries among them
    rows += [(2000 + i, [float(i), 1.0]) for i in range(5)]  # another length
    rows += [(3000, None), (3010, []), (3020, [0.0] * 24), (3030, [float("nan")] * 24), (3040, [1.0, None] * 12), (3050, [float("inf")] * 24), (None, [1.0] * 24)]
    rows += rows[:10]  # repeated rows
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, ids int, score int")
    got = neighbours.nearest(df, F.col("vec_id") % 10 == 0, 7).collect()
    want = brute_nearest(rows, 7, 10)
    key = lambda r: (r.query_id, r["rank"], r.vec_id)
    assert {key(x) for x in got} == {x[:3] for x in want} and len(got) == len(want)
    assert {(*key(x), x.score) for x in got} == want


def test_op11_bounds_hold(spark):
    """Hardly an estimate is off by more than its bound (of four deviations), and the bounds leave most rows out."""
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 64)).astype(np.float32)
    code, factor, spread = neighbours.encode_rows(x)
    words = np.ascontiguousarray(code).view(np.uint64)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    for q in r.normal(size=(5, 64)).astype(np.float32):
        estimate, upper = neighbours._Query(q).bounds(words, ones, factor, spread)
        true = neighbours.exact(x, q)
        assert np.corrcoef(estimate, true)[0, 1] > 0.9
        assert (np.abs(true - estimate) > upper - estimate).mean() < 0.001
        assert (upper >= np.sort(true)[-20]).mean() < 0.3


def test_op11_empty_and_lonely(spark):
    ship_package(spark)
    df = spark.createDataFrame([(10, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(df, F.lit(True), 5).count() == 0
    assert neighbours.nearest(df.limit(0), F.lit(True), 5).count() == 0


def brute_words(rows, least_length, least_n, every):
    n = Counter()
    for i, text, _ in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run
            n[word] += len(word) >= least_length
    return {w: c for w, c in n.items() if c >= least_n}


def brute_variants(n, times):
    cuts, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1 :]].add(w)
    for (_, cut), found in cuts.items():
        for w in found:
            near[w] |= found - {w}
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_op12_equals_brute_force(spark):
    ship_package(spark)
    r = random.Random(3)
    base = ["".join(r.choice("abÀé") for _ in range(r.randint(2, 6))) for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = list(base[min(11, int(r.expovariate(0.5)))])
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(["", "a", "B", "aa", "ÿ"])
            words.append("".join(w))
        rows.append((i, "x ".join(words) + r.choice([" 1", "-", "", "ß÷"]), "en"))
    rows += [(60, None, "en"), (61, "", "en"), (None, "aaa bab Àé", None), (5, rows[5][1], "en")]
    words = spelling.counted_words(docs(spark, rows), 3, 2, 5)
    want = brute_words(rows, 3, 2, 5)
    assert {x.word: x.n for x in words.collect()} == want
    got = {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.group_variants(words, 3).collect()}
    assert got == brute_variants(want, 3)
    assert sum(x[1] is not None and x[2] != x[1] for x in got) > 0  # some chains


def test_op12_very_long_words(spark):
    ship_package(spark)
    long = "ab" * 50_000
    rows = [(1, f"{long} {long}", "en"), (2, f"{long}a, {long}a", "en"), (3, f"{long}a", "en")]
    words = spelling.counted_words(docs(spark, rows), 7, 2, 1 << 40)
    assert {(len(x.word), x.n, x.n_near) for x in spelling.group_variants(words).collect()} == {(100_000, 2, 1), (100_001, 3, 1)}


def test_op12_numbers_over_many_tasks(spark):
    ship_package(spark)
    r = random.Random(4)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(words)], "word string, n long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        rows = spelling.number_nodes(df, "word", ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    of, at = {}, {}
    for x in rows:
        assert len(x.nodes) == len(x.word) + 1
        for d, node in enumerate(x.nodes):
            assert of.setdefault(x.word[:d], node) == node and at.setdefault(node, x.word[:d]) == x.word[:d]
    assert [x.word for x in sorted(rows, key=lambda x: x.rank)] == words


def test_op12_empty(spark):
    ship_package(spark)
    assert spelling.group_variants(spelling.counted_words(docs(spark, []), 7, 2, 31)).count() == 0
    assert spelling.group_variants(spelling.counted_words(docs(spark, [(1, "1 2", "en")]), 7, 2, 31)).count() == 0


def brute_collocations(rows, least, top, longest):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    held = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    inside = defaultdict(int)
    for (lang, p), c in held.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], c)
    out = defaultdict(list)
    for (lang, p), a in held.items():
        if inside[lang, p] < a:
            s, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
            out[lang].append((-s, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}  # noqa: E741


def test_op13_equals_brute_force(spark):
    ship_package(spark)
    r = random.Random(5)
    rows = []
    for i in range(120):
        words = [r.choice(["the", "Red", "bell", "house", "öl", "a b", "x"]) for _ in range(r.randint(0, 40))]
        if i % 4 == 0:
            words[:0] = ["one", "Two", "three", "four", "five", "six"]
        text = "".join(w + r.choice([" ", " ", "  ", "\t", ", ", "\n", " . ", "!"]) for w in words)
        rows.append((i, text, r.choice(["en", "fr", None, "und"])))
    rows += [(200, None, "en"), (201, "", None), (None, "the bell the bell", "en"), (3, rows[3][1], rows[3][2]), (202, "bell house " * 30_000, "de"), (203, "only", "it")]
    got = phrases.collocations(docs(spark, rows), 6, 40)
    key = lambda x: (x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score)
    want = brute_collocations(rows, 6, 40, 5)
    assert {key(x) for x in got.collect()} == want and len(want) > 60
    counted, _ = phrases.frequent_phrases(docs(spark, rows), 6, shards=2)
    assert counted.count() == counted.select("lang", "phrase").distinct().count()


def test_op13_full_filters_change_nothing(spark, monkeypatch):
    """With every bit set all phrases are counted, and the result is the same; scanning ends."""
    ship_package(spark)
    rows = [(i, f"red bell {'house' if i % 2 else 'hall'}, old x{i}", "en") for i in range(40)]
    whole = lambda phrases_, bits: np.full(bits >> 6, np.uint64(2**64 - 1))
    want = {tuple(x) for x in phrases.collocations(docs(spark, rows), 10, 50).collect()}
    monkeypatch.setattr(phrases, "_bits", whole)
    assert {tuple(x) for x in phrases.collocations(docs(spark, rows), 10, 50).collect()} == want and want


def test_op13_small_table_and_shared_codes_change_nothing(spark, monkeypatch):
    """A table of bytes that is nearly full begins phrases too early, and two rare words of one code reach the threshold
    together; the counts of the texts decide."""
    ship_package(spark)
    many = [f"w{i}" for i in range(400_000)]
    codes = phrases._Words(pa.array([" ".join(many)]), pa.array(["en"])).codes()[:-1]
    order = np.argsort(codes, kind="stable")
    twin = np.flatnonzero(np.diff(codes[order]) == 0)[0]
    one, two = (many[i] for i in order[twin : twin + 2])
    r = random.Random(13)
    rows = [(i, " ".join(r.choice(["the", "red", "bell", "the red bell rings", f"w{r.randint(0, 40)}"]) for _ in range(60)), r.choice(["en", "fr"])) for i in range(80)]
    rows += [(100 + i, f"{w} rings, a {w} bell", "en") for w in (one, two) for i in range(5)]
    want = brute_collocations(rows, 8, 200, 5)
    for name in ("SLOT_WORDS", "LEAST_SLOTS", "MOST_SLOTS"):
        monkeypatch.setattr(phrases, name, 1 << 20 if name == "SLOT_WORDS" else 128)
    got = phrases.collocations(docs(spark, rows), 8, 200).collect()
    assert {(x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got} == want and len(want) > 20


def test_op13_empty(spark):
    ship_package(spark)
    assert phrases.collocations(docs(spark, []), 2, 10).count() == 0


def test_op13_names_a_phrase_once(spark, monkeypatch):
    """The phrases that tasks hand over do not grow with tasks times frequent phrases."""
    ship_package(spark)
    rows = [(i, f"red bell {'house' if i % 2 else 'hall'} rings, old bell {i % 7}", "en" if i % 3 else "fr") for i in range(400)]
    made, plain = spark.sparkContext.accumulator(0), phrases.in_batches

    def watched(df, step, schema):
        def run(batches):
            for batch in step(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(df, run if "phrase string" in schema else step, schema)

    monkeypatch.setattr(phrases, "in_batches", watched)
    counted, totals = phrases.frequent_phrases(docs(spark, rows).repartition(8), 10)
    assert counted.count() == made.value > 40
    assert {(x.lang, x.n) for x in totals.collect()} == {("en", 266 * 7), ("fr", 134 * 7)}


def test_op13_keys_in_parts(spark, monkeypatch):
    """With few keys at a time the last scans are repeated for each part of the keys."""
    ship_package(spark)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "red", "bell", "the red bell rings"]) for _ in range(30)), r.choice(["en", None])) for i in range(40)]
    monkeypatch.setattr(phrases, "MOST_KEYS", 150)
    got = {(x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in phrases.collocations(docs(spark, rows), 5, 300).collect()}
    assert got == brute_collocations(rows, 5, 300, 5) and len(got) > 150


def test_op13_frequent_words_of_one_code(spark):
    """Two words of one code, both, one or none of them frequent, in one text and in others, keep their own counts."""
    ship_package(spark)
    many = [f"w{i}" for i in range(400_000)]
    codes = phrases._Words(pa.array([" ".join(many)]), pa.array(["en"])).codes()[:-1]
    order = np.argsort(codes, kind="stable")
    twins = [[many[i] for i in order[t : t + 2]] for t in np.flatnonzero(np.diff(codes[order]) == 0)[:3]]
    r = random.Random(31)
    texts = []
    for (one, two), (n, m) in zip(twins, ((30, 20), (40, 3), (6, 5)), strict=True):
        texts += [f"a {w} rings {w} here, the {w} bell" for w, times in ((one, n), (two, m)) for _ in range(times)]
    r.shuffle(texts)
    rows = [(i, "\n".join(texts[i : i + 4]), "en") for i in range(0, len(texts), 4)]
    counted, _ = phrases.frequent_phrases(docs(spark, rows).repartition(3), 9)
    got = {x.phrase: x.n for x in counted.collect()}
    (a, b), (c, d), (e, f) = twins
    assert (got[a], got[b], got[c]) == (90, 60, 120) and got[d] == 9 and (got[e], got[f]) == (18, 15)
    assert got[f"{b} rings {b} here"] == 20 and f"the {d} bell" not in got and f"a {e}" not in got
    key = lambda x: (x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score)
    assert {key(x) for x in phrases.collocations(docs(spark, rows), 9, 500).collect()} == brute_collocations(rows, 9, 500, 5)
