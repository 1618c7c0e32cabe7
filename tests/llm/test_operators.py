import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilmoch.llm import codepoints as C
from tilmoch.llm import darts, format_copies, near_duplicates, packing, quality, set_pairs, tokens
from tilmoch.llm.components import components
from tilmoch.llm.cross_split import cross_split_pairs, cut_words
from tilmoch.llm.eval_leaks import leaks, without_leaks
from tilmoch.llm.mixing import mix, pivotal, shares
from tilmoch.llm.near_duplicates import group_pairs, hot_links, near_duplicate_groups, representatives

REC = "id string, tokens array<string>, source string, split string, nid int, w string"


def records(n, seed=1, vocabulary=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.4:
            t = list(rnd.choice(rows)[1])
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                if t and rnd.random() < 0.5:
                    t.pop(rnd.randrange(len(t)))
                else:
                    t.insert(rnd.randint(0, len(t)), rnd.choice(words))
            if rnd.random() < 0.3:
                rnd.shuffle(t)
        else:
            t = [rnd.choice(words) for _ in range(rnd.randint(1, 14))]
        rows.append((f"r{i:05d}", t, rnd.choice(["S a", "s_A", "b", None]), rnd.choice(["train", "train", "test", "validation"]), 1, "x"))
    return rows


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def components_of(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    out = defaultdict(list)
    for x in list(up):
        out[root(x)].append(x)
    return list(out.values())


EDGE = [("e1", None, None, "train", 1, "x"), ("e2", [], "b", "test", 1, "x"), ("e3", [None], "b", "train", 1, "x"), ("e4", ["w1", "!"], None, None, 1, "x"), (None, ["w1"], "b", "train", 1, "x")]


@pytest.mark.parametrize("limit, depth", [(4096, 8), (3, 8), (3, 1)])
def test_cross_split_equals_brute_force(spark, limit, depth):
    rows = records(300) + EDGE
    rows += rows[:5]  # second deliveries
    df = spark.createDataFrame(rows, REC)
    ev = F.when(F.col("split") == "train", False).when(F.col("split").isNotNull(), True)
    got = sorted(map(tuple, cross_split_pairs(df, "id", F.col("tokens"), ev, 0.6, limit, depth).collect()))
    uniq = {r[0]: r for r in rows if r[0]}
    want = sorted((a, b) for a, x in uniq.items() for b, y in uniq.items() if x[3] in ("test", "validation") and y[3] == "train" and x[1] and y[1] and jaccard(x[1], y[1]) >= 0.6 - 1e-12)
    assert got == want and len(want) > 50
    assert cross_split_pairs(df.limit(0), "id", F.col("tokens"), ev).count() == 0


@pytest.mark.parametrize("limit", [4096, 2])
def test_near_duplicates_equal_brute_force(spark, limit):
    rows = records(250, 3, 400) + EDGE
    df = spark.createDataFrame(rows + rows[:3], REC)
    got = near_duplicate_groups(df, "id", F.col("tokens"), F.col("source"), 0.6, limit)
    groups = defaultdict(list)
    key = lambda r: (tuple(w for w in (r[1] or []) if w and w != "!"), None if r[2] is None else "".join(c for c in r[2].lower() if c.isalnum()))
    for r in rows:
        if r[0]:
            groups[key(r)].append(r)
    reps = [min(g, key=lambda r: r[0]) for g in groups.values()]
    links = [(a[0], b[0]) for i, a in enumerate(reps) for b in reps[i + 1 :] if key(a)[0] and key(b)[0] and jaccard(key(a)[0], key(b)[0]) >= 0.6 - 1e-12]
    want = sorted(tuple(sorted((a, b))) for g in components_of(links) for a in g for b in g if a < b)
    assert sorted(map(tuple, group_pairs(got).collect())) == want and len(want) > 30
    assert near_duplicate_groups(df.limit(0), "id", F.col("tokens"), F.col("source")).count() == 0


@pytest.mark.parametrize("limit", [4096, 40])
def test_near_duplicates_in_common_wording(spark, limit):
    """Links that share the wording of a third of all rows and differ in rarer words."""
    common = [f"c{i}" for i in range(12)]
    rows = [(f"a{i:04d}", common + [f"s{i // 2}", f"t{i // 2}"] + [f"o{i}{x}" for x in "abc"], "a", "train", 1, "x") for i in range(400)]
    rows += [(f"b{i:04d}", [f"r{i}x{k}" for k in range(8)], "b", "train", 1, "x") for i in range(800)]
    got = near_duplicate_groups(spark.createDataFrame(rows, REC), "id", F.col("tokens"), F.col("source"), 0.6, limit)
    assert sorted(map(tuple, group_pairs(got).collect())) == [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(0, 400, 2)]


def test_near_duplicates_of_mixed_lengths_at_hot_words(spark):
    rnd = random.Random(4)
    rows = [(f"a{i:04d}", [f"c{k}" for k in range(12)] + [f"o{rnd.randrange(900)}" for _ in range(rnd.choice([4, 6, 7, 8, 9]))], "a", "train", 1, "x") for i in range(150)]
    rows += [(f"b{i:04d}", [f"r{i}x{k}" for k in range(8)], "b", "train", 1, "x") for i in range(100)]
    got = near_duplicate_groups(spark.createDataFrame(rows, REC), "id", F.col("tokens"), F.col("source"), 0.6, 10)
    links = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if jaccard(a[1], b[1]) >= 0.6 - 1e-12]
    want = sorted(tuple(sorted((a, b))) for g in components_of(links) for a in g for b in g if a < b)
    assert sorted(map(tuple, group_pairs(got).collect())) == want and len(want) > 30


@pytest.mark.parametrize("limit, depth", [(1, 3), (40, 8), (5, 0)])
def test_hot_links_connect_what_all_links_would(spark, limit, depth):
    rows = records(160, 5, 60)
    sets = representatives(spark.createDataFrame(rows, REC), "id", F.col("tokens"), F.col("source"))
    data = {r["nid"]: set(r["w"]) for r in sets.collect() if r["n"]}
    hot = sets.where("n > 0").select("nid", F.lit(1).cast("bigint").alias("key"), F.shiftleft(F.col("n").cast("bigint"), 32).alias("at"))
    got = [tuple(r) for r in hot_links(hot, sets, 0.6, limit, 0, depth).collect()]
    assert all(jaccard(data[a], data[b]) >= 0.6 - 1e-9 for a, b in got)
    ids = sorted(data)
    all_links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(data[a], data[b]) >= 0.6 - 1e-9]
    assert sorted(map(sorted, components_of(got))) == sorted(map(sorted, components_of(all_links)))


def test_a_hot_key_of_near_copies_takes_one_comparison_a_row(spark):
    """A third of all rows are one text with small edits: links to one pivot, no pairs."""
    rows = [(f"a{i:04d}", [f"c{k}" for k in range(12)] + [f"o{i}"], "a", "train", 1, "x") for i in range(300)]
    sets = representatives(spark.createDataFrame(rows, REC), "id", F.col("tokens"), F.col("source"))
    hot = sets.select("nid", F.lit(1).cast("bigint").alias("key"), F.shiftleft(F.col("n").cast("bigint"), 32).alias("at"))
    got = hot_links(hot, sets, 0.6, 10, 0, 8)
    assert got.count() == 299 and got.select("a").distinct().count() == 1


def test_streamed_pairs_with_long_runs(spark):
    rnd = random.Random(2)
    rows = [(k, i, 0, rnd.randint(0, 1)) for i, k in enumerate([7] * 50 + [9] * 3 + [rnd.randint(20, 60) for _ in range(100)])]
    df = spark.createDataFrame(rows, "key bigint, nid bigint, sk bigint, at bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = set_pairs.paired(df, lambda c, i, j: np.ones(len(i), bool), 10).collect()
        across = set_pairs.paired(df, lambda c, i, j: np.ones(len(i), bool), 10, across=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for k, i, *_ in rows:
        by[k].append(i)
    want = sorted((a, b) for k, v in by.items() if len(v) <= 10 for a in v for b in v if a < b)
    assert sorted((r["a"], r["b"]) for r in got if r["hot"] is None) == want
    assert sorted(r["a"] for r in got if r["hot"] is not None) == sorted(i for v in by.values() if len(v) > 10 for i in v)
    assert sorted((r["a"], r["b"]) for r in across if r["hot"] is None) == [(a, b) for a, b in want if rows[a][3] != rows[b][3]]
    assert sorted(r["a"] for r in across if r["hot"] is not None) == sorted(r["a"] for r in got if r["hot"] is not None)


def test_segments_cover_and_one_stands():
    """Of every pair of the threshold a one-word segment is common, or the training string is the evaluation string's rest."""
    rnd = random.Random(12)
    for t in (0.5, 0.6, 0.8):
        for _ in range(4000):
            n = rnd.randint(1, 14)
            a = list(range(n))
            b = sorted(rnd.sample(a, rnd.randint(0, n)) + [n + j + 0.5 if rnd.random() < 0.5 else j - 0.5 for j in range(rnd.randint(0, 5))])
            k = int(cut_words(np.array([n]), t)[0])
            if b and jaccard(a, b) >= t - 1e-12:
                assert set(a[:k]) & set(b) or (b == a[k:] and len(b) >= t * n - 1e-9)


def test_banded_distance():
    rnd = random.Random(4)
    sets = [(sorted(rnd.sample(range(30), rnd.randint(0, 15))), sorted(rnd.sample(range(30), rnd.randint(0, 15))), rnd.randint(0, 12)) for _ in range(800)]
    flat = lambda i: np.array([v for s in sets for v in s[i]], np.int32)
    size = lambda i: np.array([len(s[i]) for s in sets])
    got = set_pairs.banded_distance(flat(0), size(0), flat(1), size(1), np.array([k for *_, k in sets]))
    assert got.tolist() == [min(len(set(a) ^ set(b)), k + 1) for a, b, k in sets]


def test_darts_estimate_weighted_jaccard():
    rnd = np.random.default_rng(3)
    words = rnd.integers(1, 2**63, 40).astype(np.uint64)
    weight = rnd.uniform(0.05, 1, 40)
    a, b = np.arange(0, 28), np.arange(12, 40)
    for scale in (1, 0.02):  # light sets throw over a longer range of ranks
        x = weight * scale
        sig = darts.signatures(np.concatenate([words[a], words[b]]), np.concatenate([x[a], x[b]]), np.array([28, 28]), 4000)
        want = weight[12:28].sum() / weight.sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    sig = darts.signatures(np.concatenate([words[a], words[b]]), np.concatenate([weight[a], weight[b]]), np.array([28, 28]), 4000)
    again = darts.signatures(words[b], weight[b], np.array([28]), 4000)
    assert (again[0] == sig[1]).all()
    assert (darts.signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0]), 5) == darts.EMPTY).all()


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + j) for j in range(1, 80)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)] + [(5, 5), (1, 0), (0, 1)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {x: min(g) for g in components_of([e for e in edges if e[0] != e[1]]) for x in g}
    assert {r["nid"]: r["cid"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    with pytest.raises(RuntimeError, match="still change"):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint"), 1)


def test_format_copies(spark):
    rows = [("k3", ["Salom,", "dunyo!"], "Bir-Ikki"), ("k1", ["salom dunyo"], "bir ikki"), ("k2", ["dunyo", "salom"], "bir ikki"), ("k4", ["salom", "dunyo"], None), ("k5", ["SALOM", "DUNYO"], None), ("k6", None, None), ("k7", [], None), ("k3", ["Salom,", "dunyo!"], "Bir-Ikki"), (None, ["salom"], None)]
    df = spark.createDataFrame(rows, "id string, tokens array<string>, source string").withColumn("_k", F.lit(1)).withColumn("first_key", F.lit("x"))
    got = format_copies.record_copies(df, "id", F.col("tokens"), F.col("source"))
    assert sorted(map(tuple, got.collect())) == [("k1", "k3"), ("k4", "k5"), ("k6", "k7")]
    assert format_copies.record_copies(df.limit(0), "id", F.col("tokens"), F.col("source")).count() == 0
    lines = [("a", '{"tokens":["x"],"source":"s"}'), ("b", ' {"source" : "S" , "id": 5, "tokens" : [ "X." ] }\n'), ("c", '{"tokens":["x"],"sou'), ("d", "{'tokens':['x']}"), ("e", None), ("f", ""), ("g", '{"tokens":["x"],"source":"s"} zz'), ("h", '{"tokens": 5}'), ("i", "[1]")]
    p = format_copies.payload_records(spark.createDataFrame(lines, "key string, payload string"), "key", "payload")
    assert sorted(r["key"] for r in p.collect()) == ["a", "b"]


def test_digests_of_any_nesting(spark):
    df = spark.createDataFrame([(1, {"A b": 1, "c": 2}, [("X", ["p"])]), (2, {"c": 2, "a  B!": 1}, [("x", ["P."])]), (3, {"c": 1, "a b": 2}, [("x", ["p"])]), (4, None, None)], "id int, m map<string,int>, s array<struct<u:string,v:array<string>>>")
    row = F.struct("m", "s")
    kind = df.select(row.alias("r")).schema["r"].dataType
    got = {r[0]: r[1] for r in df.select("id", format_copies.digest(row, kind)).collect()}
    full = {r[0]: r[1] for r in df.select("id", format_copies.canonical(row, kind)).collect()}
    assert got[1] == got[2] != got[3] and got[4] not in (got[1], got[3]) and full[1] == full[2] != full[3]


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_leaks(spark, limit):
    item = "bir ikki uch toʻrt besh olti yetti sakkiz toʻqqiz"
    items = spark.createDataFrame([("i1", item), ("i2", "Qisqa matn!"), ("i3", ""), ("i4", None), ("i5", "qisqa matn")], "item_id string, text string")
    texts = [("a", "oh BIR, ikki uch to'rt besh olti yetti ｓakkiz deb"), ("b", "ikki uch toʻrt besh olti yetti sakkiz"), ("c", "bu qisqa-matn ekan"), ("d", None), ("e", ""), ("c", "bu qisqa-matn ekan"), ("f", "x " * 50_000 + item)]
    corpus = spark.createDataFrame(texts, "row_key string, text string").withColumn("item_id", F.lit("clash"))
    got = leaks(corpus, items, 8, limit)
    assert sorted((r["row_key"], r["item_id"]) for r in got.collect()) == [("a", "i1"), ("c", "i2"), ("c", "i5"), ("f", "i1")]
    assert {(r["row_key"], r["item_id"]): r["n_words"] for r in got.collect()} == {("a", "i1"): 8, ("c", "i2"): 2, ("c", "i5"): 2, ("f", "i1"): 9}
    assert leaks(corpus.limit(0), items).count() == 0 and leaks(corpus, items.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_leaked_spans_are_removed(spark, limit):
    words = [f"soʻz{i}" for i in range(1, 11)]
    items = spark.createDataFrame([("i1", " ".join(words)), ("i2", "qisqa matn"), ("i3", ""), ("i4", None)], "item_id string, text string")
    four = " ".join(words[:4])
    texts = [
        ("a", "Boshi, " + " ".join(words) + "! Oxiri"), ("b", "bu Qisqa-Matn! ekan"), ("c", "toza matn"), ("d", None), ("e", ""), ("f", " ".join(words[:7])),
        ("g", f"{four} {' '.join(words[:8])} {' '.join(words[4:8])} keyin"), ("a", "qisqa matn"), ("h", "  TOZA   Matn ﬁ "),
    ]
    corpus = spark.createDataFrame(texts, "row_key string, text string").withColumn("removed_words", F.lit("clash"))
    got = sorted((r["row_key"], r["text"] if r["text"] is None else " ".join(r["text"].split()), r["removed_words"]) for r in without_leaks(corpus, items, 8, limit).collect())
    want = [("a", "", 2), ("a", "Boshi, ! Oxiri", 10), ("b", "bu ! ekan", 2), ("c", "toza matn", 0), ("d", None, 0), ("e", "", 0), ("f", " ".join(words[:7]), 0), ("g", "keyin", 16), ("h", "TOZA Matn ﬁ", 0)]
    assert got == want
    again = spark.createDataFrame([(k, t) for k, t, _ in got], "row_key string, text string")
    assert leaks(again, items).count() == 0
    kept = without_leaks(corpus, items, 8, limit, documents=True)
    assert sorted(r["row_key"] for r in kept.collect()) == ["c", "d", "e", "f", "h"]
    assert without_leaks(corpus.limit(0), items, 8, limit).count() == 0


TOKENIZERS = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_token_counts_are_exact(spark, name):
    rnd = random.Random(8)
    texts = ["", None, "  \n\n\t a", "Oʻzbek tili's 12'da…    x　\n y", "日本語テキスト", "a" * 500] + ["".join(rnd.choice("ab 's1,.\n\t  жʻ ") for _ in range(rnd.randint(0, 400))) for _ in range(40)]
    path = f"{tokens.TOKENIZERS}/{name}"
    c = tokens.Counter(path)
    want = [n if t else 0 for t, n in zip(texts, c._encode([t or "" for t in texts]))]
    assert c.count(pa.array(texts, pa.string())).tolist() == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, t string").withColumn("key", F.lit("clash"))
    got = {r["key"]: r["tokens"] for r in tokens.token_counts(df, "doc", F.col("t"), path, 60).collect()}
    assert got == dict(enumerate(want))
    assert tokens.token_counts(df.limit(0), "doc", F.col("t"), path).count() == 0


def test_counts_do_not_depend_on_length_when_a_key_repeats(spark):
    texts = ["bir ikki " * 30, "uch - " * 50, "qisqa", None, "qisqa"]
    df = spark.createDataFrame([(1, t) for t in texts], "doc int, t string").coalesce(1)
    whole = sorted(tuple(r) for r in tokens.token_counts(df, "doc", F.col("t")).collect())
    assert whole == sorted(tuple(r) for r in tokens.token_counts(df, "doc", F.col("t"), oversized=20).collect()) and len(whole) == 5
    a = quality.quality_counts(df, "doc", F.col("t")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, quality.quality_counts(df, "doc", F.col("t"), 20).collect())) and len(a) == 5


def test_slice_totals(spark):
    df = spark.createDataFrame([("d", "s", "uz", "n", 5), ("d", "s", "ru", "n", 7), ("d", None, None, None, None)], "tbl string, source string, lang string, domain string, tokens bigint")
    t = {(r["level"], r["source"], r["lang"]): (r["rows"], r["tokens"]) for r in tokens.slice_totals(df).collect()}
    assert t["source", "s", None] == (2, 12) and t["all", None, None] == (3, 12) and t["source,lang,domain", "s", "ru"] == (1, 7)


def test_packing(spark):
    rnd = random.Random(9)
    items = [(i, rnd.choice([0, 1, 50, 100, 101, 250, rnd.randint(1, 400)])) for i in range(600)] + [(1000, None), (1001, 100_000)]
    df = spark.createDataFrame(items, "doc_id bigint, tokens bigint").withColumn("block", F.lit("clash"))
    out = packing.pack(df, [(1, 100), (2, 257), (2, 257), (3, 0), (None, 5)], 200)
    rows = out.collect()
    for spec, cap in ((1, 100), (2, 257)):
        own = [r for r in rows if r["spec_id"] == spec]
        used = Counter()
        for r in own:
            used[r["container_id"]] += r["tokens"]
        assert max(used.values()) <= cap and all(used[r["container_id"]] == r["container_tokens"] for r in own)
        parts = defaultdict(list)
        for r in own:
            parts[r["doc_id"]].append(r["tokens"])
        for i, n in items:
            n = n or 0
            assert sum(parts[i]) == n and (len(parts[i]) == 1 if n <= cap else len(parts[i]) == math.ceil(n / cap))
    report = {r["spec_id"]: r for r in packing.fill_report(out).collect()}
    assert report[1]["fill"] > 0.8 and report[2]["fill"] > 0.9
    assert packing.pack(df.limit(0), [(1, 10)]).count() == 0 and packing.pack(df, []).count() == 0


def test_differencing_is_near_equal():
    windows = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(s for s, _ in windows) == [14, 16] or sorted(s for s, _ in windows) == [15, 15]
    assert sorted(i for _, m in windows for i in packing.members(m)) == [0, 1, 2, 3, 4]
    assert packing.differencing([], 3) == [] and packing.fill_windows(np.array([5, 5, 5]), 5).tolist() == [0, 1, 2]


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 50, 400).astype(float)
    p = np.full(400, 0.3)
    total = np.zeros(400)
    for k in range(300):
        q = pivotal(p, w, rng.random(400))
        assert ((q == 0) | (q == 1)).sum() >= 399 and abs((q * w).sum() - (p * w).sum()) < 1e-6
        total += q
    assert abs(total.mean() / 300 - 0.3) < 0.01


def test_mixing(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice(["a"] * 6 + ["b", "b", "c"]), rnd.randint(1, 60)) for i in range(900)] + [(5000, None, 9), (5001, "a", None), (5002, "zzz", 4)]
    df = spark.createDataFrame(docs + docs[:4], "doc_id bigint, source string, tokens bigint").withColumn("plan", F.lit("clash"))
    goals = spark.createDataFrame([("p", "a", 0.2, 1), ("p", "b", 0.3, 4), ("p", "c", 0.5, 2), ("q", "a", 1.0, 3), ("q", "none", 0.5, 2), ("r", None, 0.1, 1), ("s", "a", -1.0, 1)], "plan string, source string, target_share double, max_repeats int")
    uses = mix(df, goals, block=64)
    rows = uses.collect()
    assert len({(r["plan"], r["doc_id"]) for r in rows}) == len(rows)
    s = {(r["plan"], r["source"]): r for r in shares(uses, goals).collect()}
    for key in (("p", "a"), ("p", "b"), ("p", "c")):
        r = s[key]
        assert r["most_uses"] <= r["max_repeats"] and abs(r["actual_share"] - r["target_share"]) * r["plan_tokens"] < 130
    assert s["q", "none"]["used_tokens"] == 0 and s["q", "a"]["actual_share"] == 1.0
    assert [tuple(r) for r in mix(df, goals, block=64).orderBy("plan", "doc_id").collect()] == [tuple(r) for r in uses.orderBy("plan", "doc_id").collect()]
    assert mix(df.limit(0), goals).count() == 0 and mix(df, goals.limit(0)).count() == 0


QUALITY = [
    (1, "Bu oddiy matn, unda gaplar bor. Ular nuqta bilan tugaydi! Shundaymi? Ha, albatta shunday.", "prose"), (2, "- olma\n- anor\n- behi\n- nok\n- uzum", "list"), (3, "a | 1 | 2\nb | 3 | 4\nc | 5 | 6", "table"),
    (4, "{}<>!&^%$#@*&^%{}[]<>|~" * 5, "junk"), (5, None, None), (6, "", None), (7, " \n\t ", None), (8, "so soz " * 60, "junk"), (9, "1. bir\n2. ikki\n3. uch\n4. tort", "list"),
    (10, "— Qalaysan?\n— Yaxshi, rahmat, oʻzingiz qalaysiz bugun?\nAli: Men ham yaxshiman, lekin ishlar koʻp.", "prose"), (11, "Sarlavha\n\nBu uzun va oddiy gap boʻlib, sarlavhadan keyin keladi va hech qanday roʻyxat emas.", "prose"),
    (12, "1\t2\t3\n4\t5\t6", "table"), (13, "men bugun bozorga borib non va sut sotib oldim keyin uyga qaytdim", "prose"), (14, "Bob ...... 5\nBob ikki ....... 8\nUch ...... 11", "list"),
]


def test_quality_kinds_and_chunks(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in QUALITY], "doc_id int, t string").withColumn("key", F.lit("clash"))
    whole = quality.quality_counts(df, "doc_id", F.col("t"))
    cut = quality.quality_counts(df, "doc_id", F.col("t"), 12)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    got = {r["key"]: r["kind"] for r in quality.ratios(whole).collect()}
    assert got == {i: k for i, _, k in QUALITY}
    assert quality.text_quality(df.limit(0), "doc_id", F.col("t")).count() == 0


def test_rules_are_parameters(spark):
    df = spark.createDataFrame([(1, QUALITY[1][1])], "doc_id int, t string")
    assert quality.text_quality(df, "doc_id", F.col("t"), rules=quality.Rules(structured=2.0, short_lines=99)).first()["kind"] == "prose"


def test_quality_of_a_huge_text(spark):
    text = "Bu gap tugadi. " * 40_000 + "\n" + "- olma\n" * 20
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    a = quality.quality_counts(df, "doc_id", F.col("t"), 1 << 14).first()
    b = quality.quality_counts(df, "doc_id", F.col("t"), 1 << 30).first()
    assert tuple(a) == tuple(b) and a["bullet_lines"] == 20


def test_chunk_states_merge_in_any_order():
    rnd = random.Random(11)
    for _ in range(150):
        text = "".join(rnd.choice(["so'z ", "\n", "  ", "\t", "- ", "a. ", "12 ", "....", "| ", ", ", "bir", "#x ", "…\n"]) for _ in range(rnd.randint(1, 40)))
        data = np.frombuffer(text.encode(), np.uint8)
        at = tokens.cuts(data, np.array([0, len(data)]))
        cuts = [0, *sorted(rnd.sample(list(at[1:]), min(len(at) - 1, rnd.randint(0, 6)))), len(data)]
        states = [quality.chunk_state(*C.decode(pa.array([data[a:b].tobytes().decode()])), np.zeros(0, np.uint64))[0] for a, b in zip(cuts, cuts[1:])]
        while len(states) > 1:
            j = rnd.randrange(len(states) - 1)
            states[j : j + 2] = [quality.merge_states(states[j], states[j + 1])]
        want = quality.count_rows(*C.decode(pa.array([text])), np.zeros(0, np.uint64))[0][0]
        assert quality.state_counts(states[0]).tolist() == want.tolist(), text


def test_near_duplicate_parameters():
    b, r = near_duplicates.BANDS, near_duplicates.BAND_ROWS
    assert 1 - (1 - 0.6**r) ** b > 0.99
