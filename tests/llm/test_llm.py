"""The operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, chat, common, doc_stats, ivf_pq, lattice_lm, mixing, quality_classifier, quality_rules, simhash, suffix_array, suffix_dedup, wavelet, word_table

tokenizers_ = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, text__x string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["the", "Of", "thing", "ébène", "x#y", "shbleon", "12", "don't", "ß", "日本語"] + [f"w{i}" for i in range(40)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = make(60)
    out = [None, "", "  \n\t", "one", "two words", "a\n\n b  c\r\n", "same line\nsame line\nother", make(30) + passage, passage + make(40), make(300), "ab" * 400, "z" * 900]
    out += [make(80) for _ in range(12)]
    out += [out[-1], out[-1], out[-2] + " tail", " x y\x1c" + make(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None, "Z"][i % 4], 0, 7, 8, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], (None, "null id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(28)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_doc_stats(texts):
    for t in texts:
        words = WORD.findall(t or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        got = dict(zip(doc_stats.STATS, doc_stats.text_stats(t)))
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), len(hit))
        assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))


def test_classifier(spark, docs, empty, labels):
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    model = quality_classifier.fit_rules(x[:2000], y[:2000], ["a", "b", "c"])
    got = spark.createDataFrame(x[2000:].tolist(), "a double, b double, c double").select(model.score().alias("s")).toPandas()["s"].to_numpy()
    assert ((got > 0.5) == y[2000:]).mean() > 0.97 and len(model.rules) < 60 and model.describe()
    assert quality_classifier.fit_rules(np.zeros((0, 3)), np.zeros(0), ["a", "b", "c"]).rules == ()
    # the compiled column is the sum of the rules that hold
    z = model.intercept + sum(w * quality_classifier.holds(r, x[2000:], ["a", "b", "c"]) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.classify(docs, labels.limit(0)).count() == docs.count()


def corpus(rng, n):
    """Good and bad texts, their languages and labels; some labels clash, some are missing."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join(rng.choice(words) + (rng.choice(["##", "!!", "$$$"]) if bad and rng.random() < 0.4 else "") for _ in range(rng.randrange(20, 120)))
        rows.append((i, text, ["en", "fr", None][i % 3], "s"))
        if i % 7:
            marks.append((i, int(not bad), 0))
    return rows, marks + [(1, 0, 0), (2, None, 0), (10**6, 1, 0)]


def test_classifier_on_held_out_rows(spark):
    rows, marks = corpus(random.Random(1), 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    held_out = common.fraction_crc32(F.col("doc_id"), 5) == 0
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), train=~held_out).collect()}
    truth = [(i, i % 5 > 0) for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(truth) > 200 and sum((got[i] > 0.5) == y for i, y in truth) / len(truth) > 0.95


def test_quality_rules(spark, docs, empty, labels):
    for k, n in ((0, 100), (3, 200), (7, 50)):
        p = quality_rules.upper_bound(k, n, 0.05)
        assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), 0.05, rel_tol=1e-6)
    assert quality_rules.steps_held([0, 0, 30], 1000, 0.01, 0.01) == 2 and quality_rules.steps_held([0], 20, 0.01, 0.01) == 0
    # false rejections stay under the risk in nearly all simulated calibrations
    rng, bad = random.Random(0), 0
    for _ in range(300):
        rates = [0.01, 0.03, 0.06, 0.2]
        u = [rng.random() for _ in range(400)]
        held = quality_rules.steps_held([sum(x < r for x in u) for r in rates], 400, 0.05, 0.05)
        bad += held > 0 and rates[held - 1] > 0.05
    assert bad / 300 <= 0.08
    got = quality_rules.verdicts(docs, labels).collect()
    assert len(got) == docs.count() and all(not r.kept for r in got if r.base_failed)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert quality_rules.keep_good(docs, labels).columns == docs.columns and quality_rules.verdicts(empty, labels).count() == 0


def test_quality_rules_against_brute_force(spark):
    rows, marks = corpus(random.Random(2), 2400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.verdicts(docs, labels).collect()}
    tune = {r.doc_id for r in docs.where("conv(substring(md5(concat('tune|', doc_id)), 1, 8), 16, 10) % 4 = 0").select("doc_id").collect()}
    stats = {i: dict(zip(doc_stats.STATS, doc_stats.text_stats(t))) for i, t, *_ in rows}
    values = {i: [eval(e.replace("greatest", "max"), {}, s | {"max": max}) for e in quality_rules.RULES.values()] for i, s in stats.items()}  # noqa: S307
    base = {i for i, s in stats.items() if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]}
    mark = {}
    for i, q, _ in marks:
        if q is not None and i in stats and i not in base:
            mark[i] = min(q, mark.get(i, 1))
    good = [values[i] for i in tune if mark.get(i) == 1]
    steps = [[max(v) * f + (f - 1) / 10 for v in zip(*good)] for f in quality_rules.FACTORS]
    for p in quality_rules.QUANTILES:
        steps.append([min(sorted(v)[math.ceil(p * len(v)) - 1], above) for v, above in zip(zip(*good), steps[-1])])
    first = {i: next((k for k, s in enumerate(steps) if any(x > c for x, c in zip(values[i], s))), len(steps)) for i in stats}
    gain = lambda k: sum(first[i] <= k for i in tune if mark.get(i) == 0) / sum(i in tune and mark[i] == 0 for i in mark) - 20 * sum(first[i] <= k for i in tune if mark.get(i) == 1) / len(good)
    best = max(range(len(steps)), key=lambda k: (gain(k), -k))
    want = best + 1 if gain(best) > 0 else 0
    assert want > 0
    lang = {i: x for i, _, x, _ in rows}
    certify = [i for i in mark if mark[i] == 1 and i not in tune]
    strata = {lang[i] for i in certify}
    held = {s: quality_rules.steps_held([sum(first[i] <= k for i in certify if lang[i] == s) for k in range(want)], sum(lang[i] == s for i in certify), 0.05, 0.05 / len(strata)) for s in strata}
    assert any(held.values())
    assert got == {i: (i in base, i not in base and min(first[i], want) >= held.get(lang[i], 0)) for i in stats}
    assert sum(not kept and not failed for failed, kept in got.values()) > 100
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == {i for i, (_, kept) in got.items() if kept}


def test_quality_rules_of_many_strata(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    good = [" ".join(word() for _ in range(60)) for _ in range(40)]
    junk = " ".join(word() + "###" for _ in range(60))
    rows = [(n * 1000 + i, good[i % 40], f"l{n:02}") for n in range(70) for i in range(270)] + [(n * 1000 + 999, junk, f"l{n:02}") for n in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    marks = df.selectExpr("doc_id", "cast(doc_id % 1000 < 999 as int) as quality", "0 as toxic")
    got = quality_rules.verdicts(df, marks).collect()
    assert len(got) == len(rows) and all(r.kept == (r.doc_id % 1000 < 999) for r in got)


def test_chat_round_trip(spark):
    odd = ["", "plain", "### user: x", "</turn>", "</turn>\n", "a\\sb", "\\", "\\### Assistant: </turn> ok", "\\\\t\\h", "日本 </turn>\n### assistant: no", None]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "we: ird", "x</turn>", None]), rng.choice(odd), "clash") for c in range(30) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "assistant", "n", "clash"), (None, None, "user", "m", "clash"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    assert made.where("not round_trip").count() == 0
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    for got in chat.read_back(made).collect():
        turns = [(r, x) for _, r, x in sorted(want[got.conv_id])]
        assert [tuple(t) for t in got.turns] == turns
        assert got.loss == [x for r, x in turns if r == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_simhash(spark, docs, empty, texts):
    import xxhash

    def plain(t):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]
    masks = simhash.covering(list(range(64)), 3)
    rng = random.Random(0)
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & x for m in masks)
    # clusters within the radius, with a bucket limit that forces the second covering
    base = [rng.getrandbits(64) for _ in range(12)] + [1 << 63, 0]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)})
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for limit in (2, 2048):
        scratch = simhash.Scratch(spark, "t")
        got = {r.node: r.root for r in simhash.components(simhash.links(df, scratch, limit=limit), scratch).collect()}
        groups = Counter(got.get(simhash.signed(f), simhash.signed(f)) for f in fps)
        assert sorted(groups.values()) == sorted(Counter(find(i) for i in range(len(fps))).values())
    # whole documents: the fingerprints' components, by the least doc_id
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (None, "null id")]
    prints = [simhash.fingerprint(t) for _, t in rows]
    own = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(prints):
            own[i] = min(own[j] for j, y in enumerate(prints) if (x ^ y).bit_count() <= 3)
    least = {r: min((rows[i][0] for i in range(len(rows)) if own[i] == r and rows[i][0] is not None), default=None) for r in own}
    want = sorted(((d, simhash.signed(f), least[o]) for (d, _), f, o in zip(rows, prints, own)), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_components_that_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        simhash.components(spark.range(1, 50).selectExpr("id as a", "id - 1 as b"), simhash.Scratch(spark, "t"))


def test_drop_near_duplicates(spark, docs, empty):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    a = [rng.choice(words) for _ in range(300)]
    near = [*a]
    near[100] = "changed"
    far = [rng.choice(words) for _ in range(300)]
    df = spark.createDataFrame([(5, " ".join(a)), (2, " ".join(near)), (7, " ".join(a)), (9, " ".join(far)), (9, " ".join(far)), (11, None), (12, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [2, 9, 11]
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    made = [[rng.choice(words) for _ in range(n)] for n in (3, 5, 6, 70, 90, 120, 160, 240, 400, 700) for _ in range(3)]

    def replaced(t, share):
        at = set(rng.sample(range(len(t)), max(1, int(len(t) * share))))
        return [rng.choice(words) if i in at else w for i, w in enumerate(t)]

    out = [*made]
    for t in made:
        out += [t + [rng.choice(words) for _ in range(len(t) // k)] for k in (5, 4, 6)]
        out += [t[: int(len(t) * x)] for x in (0.84, 0.8, 0.79)] + [t[len(t) // 8 :]]
        out += [replaced(t, x) for x in (0.01, 0.018, 0.02, 0.03)]
    rng.shuffle(out)
    sets = [set(zip(*(t[i:] for i in range(5)))) or {tuple(t)} for t in out]
    root = list(range(len(out)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    direct = set()
    for i in range(len(out)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                direct.add((j, i))
    want = [i for i in range(len(out)) if find(i) == i]
    # some texts go only by way of others: they do not resemble the first of their group
    assert sum(find(i) != i and (find(i), i) not in direct for i in range(len(out))) > 10
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(out)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == want


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(120):
        d = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)
        d = np.tile(d, 4) if trial % 4 == 0 else d
        b = d.tobytes()
        sa = suffix_array.suffix_array(np.append(d.astype(int) + 1, 0), 257)[1:]
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sa.tolist() == want
        _, plcp = suffix_array.common_prefixes(d, sa)
        for x, y in zip(want, want[1:]):
            n = next((k for k in range(len(b)) if b[x + k : x + k + 1] != b[y + k : y + k + 1] or not b[y + k : y + k + 1] or not b[x + k : x + k + 1]), 0)
            assert plcp[y] == n


def without_repeats(rows, length):
    """(n_bytes, n_removed, n_spans, sha256) by place of the rows' texts."""
    blobs = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


# a shard of 2 kB cuts the passage's keys again and again, one of 40 bytes all keys down to the strings themselves
@pytest.mark.parametrize("shard_bytes", [2 << 20, 2000, 40])
def test_repeats(spark, texts, empty, shard_bytes):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["日本語"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = make(30)
    rows = [*texts, texts[9], "z" * 300, "z" * 50, *(make(rng.randrange(5, 30)) + passage + make(rng.randrange(5, 30)) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(suffix_dedup.remove_repeats(df, length=40, grams=(12, 24, 40), shard_bytes=shard_bytes, kept_text=True).collect(), key=lambda r: r.row__.doc_id)
    want = without_repeats(rows, 40)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [w[:4] for w in want]
    assert all(w[4].decode(errors="ignore") == r.kept_text or r.n_spans for w, r in zip(want, got))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_texts_of_one_first_hash_stay_apart(spark, texts):
    same = (lambda c: F.lit(7).cast("long"), common.HASHES[1])
    rows = [t for t in texts if t]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(suffix_dedup.remove_repeats(df, length=40, grams=(12, 40), hashes=same).collect(), key=lambda r: r.row__.doc_id)
    assert [r.kept_sha256 for r in got] == [w[3] for w in without_repeats(rows, 40)]
    ids = lambda **o: sorted(r.doc_id for r in simhash.drop_near_duplicates(df, **o).collect())
    assert ids(hashes=same) == ids()
    # the second hash is none of the first
    one, other = (lambda c: F.lit(7).cast("long")), (lambda c: F.xxhash64(F.xxhash64(c)))
    assert df.select(common.HASHES[1](F.col("text")).alias("x"), other(F.col("text")).alias("y")).where("x = y").count() == 0 and one is not None


def test_ivf_pq(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)).round(2)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ivf_pq.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == list(range(1, 11)) and all(s == d[v] for _, v, s in mine)
        hit, total = hit + len(set(want) & {v for _, v, _ in mine}), total + 10
    assert hit / total >= 0.9 and not set(got) - set(range(0, 900, 50))
    assert ivf_pq.search(df.limit(0), df).count() == 0


def test_ivf_pq_recall_and_repeated_queries(spark):
    """Production parameters on more than a block of rows of vectors that cluster no more than the synthetic tables' do."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 300 = 0")
    twice = asked.union(asked.where("vec_id = 0"))
    got = {}
    for r in ivf_pq.search(df, twice).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for q in range(0, 9000, 300):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert len(got[q]) == len(set(got[q])) == 10
        hit += len(set(np.argsort(d)[:10]) & set(got[q]))
    assert hit / 300 >= 0.9
    # all candidates where they are fewer than k
    assert ivf_pq.search(df.where("vec_id < 5"), df.where("vec_id = 0")).count() == 4


@pytest.mark.parametrize("kind", ["scales", "outlier", "copies", "offset"])
def test_ivf_pq_misses_no_neighbour(spark, kind):
    """Rows that lists and codes fitted on all of them tell apart badly."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 12))
    if kind == "scales":  # tight groups beside wide ones: the codes of a tight one's rows are all alike
        x = rng.normal(size=(6, 12))[np.arange(6000) % 6] * 100 + x * 10.0 ** (np.arange(6000) % 6 - 4)[:, None]
    elif kind == "outlier":
        x[17] *= 1e6
    elif kind == "copies":
        x[1000:5000] = x[1000]
        x[5000:5500] = x[1000] + x[5000:5500] * 1e-6
    else:
        x += 1e8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ivf_pq.search(df, df.where("vec_id % 250 = 17 or vec_id in (1000, 5001)")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert len(got) >= 24
    for q, mine in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert [v for _, v in sorted(mine)] == [i for i in np.lexsort((np.arange(6000), d)) if i != q][:10]


def test_wavelet(spark, docs, empty, texts):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(0)
    for size, top in ((0, 5), (1, 1), (5000, 300), (3000, 70_000), (600_000, 3)):
        ids = rng.integers(0, top, size)
        w = wavelet.load(wavelet.dump([1], [size], ids))[2]
        assert (w.ids() == ids).all() and all(w.access(i) == ids[i] for i in range(0, size, 1 + size // 50))
        for v in ids[:3].tolist():
            at = np.flatnonzero(ids == v)
            assert w.count(v) == len(at) and [w.select(v, k) for k in range(0, len(at), 1 + len(at) // 20)] == at[:: 1 + len(at) // 20].tolist() and w.select(v, len(at)) == -1
    path = tokenizers_.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = [(100, "hi <|endoftext|> there"), (101, "a<|startoftext|>B <|EndOfText|> x<|y"), (102, "İstanbul ΣΑΣ ǅ e\u0301 Ångström ẞ 日本"), (103, "ÉCOLE Straße naïve")]
    rows = sorted([(i, x or "") for i, x in enumerate([*texts])] + [(9, texts[9]), (-1, "null id"), *odd])
    more = docs.sparkSession.createDataFrame(odd, "doc_id long, text string")
    folder, got = wavelet.encode_corpus(docs.select("doc_id", "text").union(more), path, shard_tokens=500)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect())
    at, want = 0, []
    for i, x in rows:
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert wavelet.encode_corpus(empty, path)[1].count() == 0
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("string"), "text")
    assert sorted(r.doc_id for r in wavelet.encode_corpus(named, path)[1].collect()) == sorted(r.doc_id for r in named.collect())


def test_word_table():
    made = []
    encode = lambda words: (made.extend(words), (np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words])))[1]
    table, rng = word_table.WordTable(encode, 50), random.Random(0)
    often = [bytes([i, i]) for i in range(10)]
    for _ in range(60):
        table.make_room()
        words = [rng.choice(often) if rng.random() < 0.7 else bytes(rng.randrange(256) for _ in range(rng.randrange(4))) for _ in range(40)]
        draft = np.fromiter(map(table.numbers.__getitem__, words), np.int64)
        table.settle([draft])
        assert table.of(draft).tolist() == [x for w in words for x in w]
    assert len(table.numbers) < 100 and sum(w == often[0] for w in made) == 1


def test_lattice():
    """Marginals and expected uses against the enumeration of all segmentations."""
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.15, "b": 0.3, "ab": 0.1, "▁ab": 0.05, "abab": 0.02}
    trie, model = lattice_lm.Trie.of(list(pieces)), lattice_lm.Model(np.log(np.array([*pieces.values()])), np.full(256, -9.0), -4.0)

    def every(s):
        if not s:
            yield ()
            return
        for i in range(1, len(s) + 1):
            if s[:i] in pieces:
                yield from (((s[:i],), *rest) for rest in every(s[i:]))
        yield from ((tuple(s[0].encode()), *rest) for rest in every(s[1:]))

    weight = lambda segmentation: math.prod(pieces[x[0]] if isinstance(x[0], str) else math.exp(-9.0 * len(x)) for x in segmentation)
    words = ["ab", "aab", "b", "bé", "abab", "", "a" * 7, "日本"]
    assert np.allclose(lattice_lm.word_scores(words, trie, model), [math.log(sum(map(weight, every("▁" + w)))) for w in words])
    uses, raw, want, want_raw = np.zeros(len(pieces)), np.zeros(256), Counter(), np.zeros(256)
    times = np.array([2.0, 1, 0, 3, 1, 1, 1, 5])
    for which, lattice in lattice_lm.lattices(words, trie, model):
        lattice.expect(times[which], uses, raw)
    for w, n in zip(words, times):
        total = sum(map(weight, every("▁" + w)))
        for segmentation in every("▁" + w):
            for x in segmentation:
                if isinstance(x[0], str):
                    want[x[0]] += n * weight(segmentation) / total
                else:
                    for c in x:
                        want_raw[c] += n * weight(segmentation) / total
    assert np.allclose(uses, [want[p] for p in pieces]) and np.allclose(raw, want_raw)


def test_lattice_lm(docs, empty, texts):
    path = tokenizers_.path("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate([*texts])] + [(9, texts[9]), (None, "null id")]
    train = lambda i: i is None or i % 3 > 0
    tokens = lambda t: [w.encode().lower() for w in WORD.findall(t or "")] + [None]
    counts = Counter(w for i, t in rows if train(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    # blocks of a few words, so that documents meet their words from several; two rounds of learning by hand
    got = lattice_lm.score_documents(docs, path, F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True)), distinct=20).collect()
    weights = lattice_lm.vocabulary(path)
    trie, start, ends = lattice_lm.Trie.of(list(weights)), np.array([*weights.values()]), float(counts[None])
    model, words = lattice_lm.settle(start, np.zeros(len(start)), np.zeros(256), 0), [w.decode() for w in counts if w]
    for _ in range(lattice_lm.ROUNDS):
        uses, raw = np.zeros(len(start)), np.zeros(256)
        for which, lattice in lattice_lm.lattices(words, trie, model):
            lattice.expect(np.array([float(counts[words[i].encode()]) for i in which]), uses, raw)
        model = lattice_lm.settle(start, uses, raw, ends)
    every = sorted({w for _, t in rows for w in tokens(t) if w})
    spelled = dict(zip(every, lattice_lm.word_scores([w.decode() for w in every], trie, model)))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        assert math.isclose(r.score, sum(spelled[w] if w else model.end for w in tokens(t)) / math.log(10), rel_tol=1e-9)
    assert lattice_lm.score_documents(empty, path, F.lit(True)).count() == 0
    assert all(r.train_tokens == 0 for r in lattice_lm.score_documents(docs, path, F.lit(False)).collect())


def test_byte_bpe(docs, empty, texts):
    import tiktoken

    path = tokenizers_.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokenizers_.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # a table of 30 words is emptied again and again
    for limit in (30, 100_000):
        rows = byte_bpe.tokenize(docs, path, tokenizers_.PATTERN, limit=limit).collect()
        got = {r.row__.doc_id: r for r in rows}
        for i, t in enumerate(texts):
            assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t or "")
            assert got[i].bytes == (t or "").encode() and len(rows) == len(texts) + 2
    assert byte_bpe.tokenize(empty, path, tokenizers_.PATTERN).count() == 0
    # the fold in arrays, by a heap, and in higher-order functions
    rng, codec = random.Random(0), byte_bpe.Codec(docs.sparkSession, path, tokenizers_.PATTERN)
    words = [bytes(rng.choice(b"abeinrst ") for _ in range(rng.randrange(1, 40))) for _ in range(300)] + [b"a" * n for n in (1, 255, 256, 257, 600)] + [bytes(rng.randrange(256) for _ in range(300))]
    words = sorted({*words})
    want = [enc._core_bpe.encode_single_piece(w) for w in words]
    merger = byte_bpe.Merger(codec.shift, codec.entries, codec.table)
    ids, lengths = merger.fold(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert [merger.fold_long(w).tolist() for w in words[:50]] == want[:50]
    short = [w for w in words if len(w) < 60]
    native = {bytes(r.word): r.ids for r in codec.fold_words(docs.sparkSession.createDataFrame([(w,) for w in short], "word binary")).collect()}
    assert [native[w] for w in short] == [want[words.index(w)] for w in short]


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 9}" if i % 9 else None) for i in range(2000)] + [(5000, "w " * 50_000, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(size), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in plan:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == size[r.source] and r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in size if s != "s1")
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mixing.mix_plan(df).collect()), key=str)
    assert mixing.mix(df).count() == sum(r.copies for r in plan) and mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(empty).count() == 0


def test_mixing_takes_documents_as_often_as_the_fraction_says(spark):
    """The seed is chosen among some by its result: over 600 like sources, that leaves every document's odds near the fraction."""
    rng = random.Random(0)
    sizes = [int(rng.lognormvariate(5, 1)) + 1 for _ in range(40)]
    rows = [(s * 100 + i, "w " * n, f"s{s:04}") for s in range(600) for i, n in enumerate(sizes)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("rate < 1").collect()
    odds = Counter()
    for r in plan:
        odds[r.doc_id % 100] += r.copies
    rate, sources = plan[0].rate, len(plan) / len(sizes)
    assert abs(rate - 0.5) < 1e-9 and sources == 200
    freq = [odds[i] / sources for i in range(len(sizes))]
    assert abs(sum(freq) / len(freq) - rate) < 0.01 and max(abs(f - rate) for f in freq) < 0.15


#: Names that the operators use for columns of their own.
NAMES = [*doc_stats.STATS, *quality_classifier.FEATURES, "step", "base_failed", "kept", "held", "of", "tune", "score", "predicted", "spans", "t", "t1__", "t2__", "a", "b", "a2", "b2", "key", "h", "n", "id", "lo", "starts", "seen", "at", "piece", "kept_text", "n_bytes", "fp", "root", "node", "least", "doc__", "tok", "text__", "row__", "s", "copies", "rate", "size", "target", "source_size", "seed", "goal_source", "ids", "bytes", "block", "words", "word", "idx", "c", "lp", "train", "train__", "file", "kind", "stratum", "quality", "held_out", "component_id", "tokens"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Odd rows under every name that an operator uses itself; the values must come back untouched."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [None, "", " ", make(4), make(120), make(120) + " x", make(90) + "\n" + make(20), "é" * 500]
    texts = [*base, *base[:5], base[4] + " tail", *(make(70) for _ in range(30))]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[-1], (None, None, None, None, None), (None, texts[-1], None, "s1", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns))


def own_values(df, columns=None):
    return all(r[n] == f"own {n}" for r in df.collect() for n in (columns or NAMES))


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows_and_clashing_names(spark, clashing, k):
    name, stage = stages()[k]
    out = stage(spark, clashing, "/root/testdata/sf0.001")
    rows = out.collect()
    if k < 4:
        assert out.columns == clashing.columns and all(r[n] == f"own {n}" for r in rows for n in NAMES)
    texts = [r.text for r in clashing.collect()]
    if name == "near_duplicates":
        assert sum(not (r.text or "").split() for r in rows) == 1 and len({r.text for r in rows}) == len(rows) < len(texts)
    if name in ("repeated_strings", "byte_bpe"):
        assert len(rows) == len(texts)
    assert stage(spark, clashing.limit(0), "/root/testdata/sf0.001").count() == 0


def test_operators_on_odd_rows_and_clashing_names(spark, clashing):
    n = clashing.count()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(clashing, labels).count() == n
    assert quality_rules.verdicts(clashing, labels).count() == n
    assert simhash.near_duplicates(clashing).count() == n
    assert mixing.mix_plan(clashing).count() == n
    assert lattice_lm.score_documents(clashing, tokenizers_.path("piece_bpe_32k.model"), F.lit(True)).count() == n
    assert wavelet.encode_corpus(clashing, tokenizers_.path("word_bpe_49k.json"))[1].count() == n
    for made in (byte_bpe.tokenize(clashing, tokenizers_.path("byte_bpe_50k.tiktoken"), tokenizers_.PATTERN), suffix_dedup.remove_repeats(clashing)):
        assert made.count() == n and own_values(made.select("row__.*"))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept, against its rule in plain Python."""
    import tiktoken

    import corpus_pipeline

    rng = random.Random(6)
    rows, marks = corpus(rng, 900)
    good = [t for i, t, *_ in rows if i % 5]
    passage = " ".join(rng.choice(good).split()[0] for _ in range(70))
    extra = [t + " tail" for t in good[:30]] + good[30:50] + [t + "\n" + passage for t in good[50:80]] + ["", None, "short one"]
    rows += [(1000 + i, t, "en", f"s{i % 3}") for i, t in enumerate(extra)]
    rng.shuffle(rows)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, scratch, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), common.Scratch(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = {r.doc_id: r for r in docs.collect()}, scratch.keep(stage(spark, docs, str(tmp_path)), name)
        after = docs.collect()
        seen[name] = len(after)
        ids = sorted(r.doc_id for r in after)
        if name == "quality_rules":
            got = quality_rules.verdicts(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            assert ids == sorted(r.doc_id for r in got.where("kept").collect()) and 400 < len(ids) < 700
            assert {tuple(r) for r in after} <= {tuple(r) for r in before.values()}
        elif name == "near_duplicates":
            sets = {i: set(zip(*(r.text.split()[k:] for k in range(5)))) or {tuple(r.text.split())} for i, r in before.items()}
            root = {i: i for i in sets}
            for i in sorted(sets):
                for j in sorted(sets):
                    if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        a, b = root[i], root[j]
                        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
            assert ids == sorted(set(root.values())) and len(ids) < len(before)
        elif name == "repeated_strings":
            want = dict(zip(before, without_repeats([r.text for r in before.values()], 200)))
            assert {r.doc_id: r.text for r in after} == {i: w[4].decode() for i, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in after) and any(w[1] for w in want.values())
        elif name == "mixing":
            size = Counter()
            for r in before.values():
                size[r.source] += len(r.text.split())
            assert {tuple(r) for r in after} <= {tuple(r) for r in before.values()} and max(Counter(ids).values()) <= 3
            taken = Counter()
            for r in after:
                taken[r.source] += len(r.text.split())
            plan = {r.source: r.target for r in mixing.mix_plan(spark.createDataFrame([*before.values()], docs.schema)).collect()}
            assert all(abs(taken[x] - plan[x]) <= 0.05 * plan[x] for x in size)
        else:
            ranks = byte_bpe.load_ranks(tokenizers_.path("byte_bpe_50k.tiktoken"))
            enc = tiktoken.Encoding("own", pat_str=tokenizers_.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert all(np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(before[r.doc_id].text) and r.decodes and r.n_tokens == len(r.ids) // 4 for r in after)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_workers_give_back_what_their_tasks_freed(spark):
    """Workers live on between tasks: what a stage took must not stay with them while the next one runs."""
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    rng = random.Random(5)
    rows = [(i, 1, bytes(rng.choices(b"abcdefgh ", k=20_000))) for i in range(160)]
    texts = spark.createDataFrame(rows, "id long, n long, data binary").repartition(4).cache()

    def kept(batches):
        import ctypes
        import re
        import time

        import pyarrow as pa

        def held():
            with open("/proc/self/smaps_rollup") as f:
                return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) // 1024

        for _ in batches:
            pass
        time.sleep(0.5)  # so that each worker gets one
        before = held()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.RecordBatch.from_pydict({"mb": pa.array([before - held()], pa.int64())})

    probe = lambda: max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(kept, "mb long").collect())
    texts.count(), probe()
    assert suffix_dedup.cut_runs(texts, 200, 48).count() > 10_000
    assert probe() < 20


def test_no_local_folder_off_this_machine(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})

    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not jvm_dir.isDefined():
        with pytest.raises(ValueError):
            common.shared_dir(Elsewhere)


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op5_quality_rules", "op7_chat", "op10_mixing"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from graphloom.llm.queries import ORACLES, QUERIES

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and Counter(map(tuple, got[columns].values.tolist())) == Counter(map(tuple, want[columns].values.tolist()))
