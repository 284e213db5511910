"""The corpus operators against brute force, exact round trips, planted cases and awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm import bpe, common, embed_dedup, langid, lm_score, minhash, mixing, queries, tiff, toxicity, url_filter, warc_audit

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
#: nulls in every column, empty, blank and long texts, ties, repeated rows
AWKWARD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", None, "a", 4), (3, "one", "en", None, 3), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3),
    (5, "x " * 30000, "de", "b", 60000), (6, "€ ünï ¼ \x85 \u2028 日本", "fr", "é", 8), (None, "one two three", "en", "a", 13), (7, "1234 5678", "en", "a", 9),
]


def frame(spark, rows, ddl=DOC):
    return spark.createDataFrame(rows, ddl)


def awkward(spark):
    """Awkward rows with further columns whose names clash with the operators' own."""
    extra = {c: F.lit(7) for c in ("size", "taken", "n_shingles", "component_id", "kept", "rep", "key", "h", "a", "b", "block", "chance", "root", "n", "good", "url2")}
    return frame(spark, AWKWARD).withColumns(extra)


def corpus(seed=3, n=160):
    """Documents, with exact and near copies."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(400)]
    out = []
    for i in range(n):
        if i > 20 and r.random() < 0.5:
            w = list(out[r.randrange(len(out))])
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(1, 90))]
        out.append(w)
    return [" ".join(w) for w in out]


# -- shared


def test_words_and_shingles():
    for text in ["", " ", "a", " A b\tC\x0bd\x0c e\x1cf ", "é" * 5000 + " x", "x" * 9000, "ab ba ab ba"]:
        w = text.encode().split()
        h = common.word_hashes(text.encode(), lower=False)
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
        low = text.encode().lower().split()
        assert len(common.shingles(text.encode(), 2)) == len({tuple(low[i : i + 2]) for i in range(max(1, len(low) - 1))} if low else set())


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = dict(common.components(frame(spark, edges, "a long, b long")).collect())
    assert all(find(k) == v for k, v in got.items()) and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert common.components(frame(spark, [], "a long, b long")).count() == 0


# -- 1 mixing


def test_targets():
    assert mixing.targets({"a": 100, "b": 100}, {"a": 1, "b": 3}) == {"a": 50.0, "b": 150.0}
    t = mixing.targets({"a": 1000, "b": 10, "c": 0}, {"a": 1, "b": 9, "c": 5})
    assert t["b"] == 30 and t["c"] == 0 and t["a"] == pytest.approx(980)
    assert mixing.weights_by_order(["b", None, "a", "c", "d"]) == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}


@pytest.mark.parametrize("block", [7, 20_000])
def test_mix_is_balanced_and_repeats(spark, block):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.choice([1, 3, 10, 200]))), "en", r.choice(["s0", "s1", "s1", "s1", "s2", None]), 0) for i in range(600)]
    df = frame(spark, rows)
    got = mixing.mix(df, block=block).toPandas()
    assert len(got) == 600 and (got["taken"] <= 3 * got["size"]).all() and set(got["taken"] % got["size"]) == {0}
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= (2 if block > 600 else 210)
        assert abs(g["copies"].sum() - len(g) * g["target"].iloc[0] / g["size"].sum()) <= (8 if block > 600 else 12)
    again = mixing.mix(df.repartition(5), block=block).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_chances_and_totals_are_kept():
    """The flight keeps both totals exactly; over many seeds a document is taken with its chance."""
    r = random.Random(4)
    z = np.array(sorted((r.choice([1, 4, 9, 9, 30, 700]) for _ in range(200)), reverse=True))
    hits = np.zeros(200)
    for seed in range(60):
        f, p = mixing.Flight(seed * 7919 + 1), np.full(200, 0.3)
        for i in range(200):
            for k, v in f.add(i, float(z[i]), 0.3):
                p[k] = v
        for k, v in f.end():
            p[k] = v
        assert p.sum() == pytest.approx(60) and p @ z == pytest.approx(0.3 * z.sum()) and ((p > 0) & (p < 1)).sum() <= 2
        hits += p
        x = mixing.landed(z, np.full(200, 0.3), seed)
        assert set(x) <= {0, 1} and abs(x @ z - 0.3 * z.sum()) <= 1
    assert abs(hits / 60 - 0.3).mean() < 0.06


def test_targets_of_a_table_are_those_of_the_dictionary(spark):
    r = random.Random(5)
    for weights in (None, {f"s{i}": r.choice([0.5, 1, 40]) for i in range(12)} | {None: 2.0}):
        sizes = {f"s{i}": r.choice([0, 1, 10, 500, 10_000]) for i in range(12)} | {None: 70}
        rows = frame(spark, [(s, n) for s, n in sizes.items()], "source string, size long")
        want = mixing.targets(sizes, weights or mixing.weights_by_order(list(sizes)))
        got = {x["source"]: x["target"] for x in mixing.targeted(rows, weights, 3.0).collect()}
        assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_awkward(spark):
    got = mixing.mix(awkward(spark)).toPandas()
    assert len(got) == len(AWKWARD) and (got["taken"] <= 3 * got["size"]).all()
    assert mixing.mix(frame(spark, [])).count() == 0


# -- 2 scoring


def test_scores_separate_domains(spark):
    r = random.Random(2)
    good = [" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(120)) for _ in range(60)]
    bad = ["".join(r.choice("qwxyz ") for _ in range(700)) for _ in range(60)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(good + bad)])
    domain = docs.where("doc_id < 40")
    got = {x["doc_id"]: x for x in lm_score.cross_entropy(docs, domain).collect()}
    assert np.mean([got[i]["score"] for i in range(40, 60)]) > np.mean([got[i]["score"] for i in range(60, 120)])
    general, inside = lm_score.dictionaries(docs, domain)
    a, b = lm_score.compressor(general), lm_score.compressor(inside)
    for i in (3, 50, 90):
        data = (good + bad)[i].encode()
        assert (got[i]["bytes_general"], got[i]["bytes_domain"]) == (len(a.compress(data)), len(b.compress(data)))


def test_window_counts_against_brute_force(spark):
    texts = corpus(n=30)
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    want = np.zeros((2, 1 << lm_score.TABLE_BITS), np.int64)
    for i, t in enumerate(texts):
        data = t.encode()
        for k in range(len(data) - 7):
            at = ((int.from_bytes(data[k : k + 8], "little") * int(lm_score._PRIME)) % (1 << 64)) >> (64 - lm_score.TABLE_BITS)
            want[0][at] += 1
            want[1][at] += i < 10
    for r in lm_score.counts(lm_score._flagged(docs, docs.where("doc_id < 10"))).collect():
        assert (want[0][r["bucket"]], want[1][r["bucket"]]) == (r["n_all"], r["n_in"])
        want[:, r["bucket"]] = 0
    assert not want.any()


def test_every_document_of_the_domain_counts(spark):
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.format_string("number %06d", "id").alias("text"))
    domain = docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id < 7")).select("doc_id")
    flagged = lm_score._flagged(docs.unionByName(frame(spark, [(None, "number 000001"), (2, "number 000002"), (4, None)], "doc_id long, text string")), domain)
    got = {(r["good"], r["even"]): r["n"] for r in flagged.groupBy("good", (F.substring("text", -6, 6).cast("int") % 2 == 0).alias("even")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(True, True): 25_001, (True, False): 3, (False, False): 24_998}
    assert lm_score.counts(flagged).agg(F.sum("n_in")).first()[0] == 25_004 * 6


def test_best_segment_of_each_slot_against_brute_force(spark):
    r = random.Random(5)
    line = "the same line comes again and again, as a header would do; " * 3
    texts = [" ".join(line if r.random() < 0.1 else str(r.randrange(10**6)) for _ in range(3000)) for _ in range(3)]
    flagged = frame(spark, [(t, i == 1) for i, t in enumerate(texts)], "text string, good boolean")
    tables = np.random.default_rng(1).integers(0, 5, (2, 1 << lm_score.TABLE_BITS))
    want = {}
    for i, t in enumerate(texts):
        data = t.encode()
        for k in range(1 + (i == 1)):
            for at in {*range(0, len(data) - 63, 32), len(data) - 64}:
                w = lm_score.windows(data[at : at + 64])
                key = (k, int(w[0]) % lm_score.SLOTS)
                want[key] = max(want.get(key, (-1, b"")), (int(tables[k][w].sum()), data[at : at + 64]))
    got = {(x["kind"], x["slot"]): (x["score"], bytes(x["segment"])) for x in lm_score.candidates(flagged, tables).collect()}
    assert got == want and len(want) > 600


def test_one_long_text_fills_a_dictionary_and_short_texts_give_one(spark):
    r = random.Random(12)
    long = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(30_000))
    general, inside = lm_score.dictionaries(frame(spark, [(1, long, "en", "s", 0)]), frame(spark, [(1,)], "doc_id long"))
    assert general == inside and len(general) > 0.9 * lm_score.DICT_BYTES
    start, _, _ = lm_score.best_segments(long.encode(), np.ones(1 << lm_score.TABLE_BITS, np.int64))
    assert start[-1] == len(long) - 64 and set(np.diff(start)) <= set(range(1, 33))
    short = frame(spark, [(i, f"short text no {i}" if i % 2 else f"another text {i}", "en", "s", 0) for i in range(2000)])
    general, inside = lm_score.dictionaries(short, short.where("doc_id % 2 = 1").select("doc_id"))
    assert len(general) > 5000 and len(inside) > 5000 and b"another" not in inside
    got = {x["doc_id"]: x["score"] for x in lm_score.score(short, general, inside).collect()}
    assert sum(got[i] for i in range(1, 2000, 2)) > sum(got[i] for i in range(0, 2000, 2))


def test_what_is_gathered_grows_with_the_corpus(spark):
    small, large = (lm_score.sizes(n) for n in (10**6, 10**9))
    assert all(b > 5 * a for a, b in zip(small, large)) and lm_score.sizes(0) == (1 << lm_score.TABLE_BITS, lm_score.SLOTS, lm_score.DICT_BYTES)
    docs = spark.range(6000, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 100), i -> sha2(cast(id * 1000 + i as string), 256)), ' ')").alias("text"))
    general, inside = lm_score.dictionaries(docs, docs.where("doc_id < 3000"))
    size = lm_score.sizes(6000 * (100 * 65 - 1))[2]
    assert size > 1.4 * lm_score.DICT_BYTES and min(len(general), len(inside)) > 1.3 * lm_score.DICT_BYTES
    buckets = 300_001
    want = sum(np.bincount(lm_score.windows(r["text"].encode(), buckets), minlength=buckets) for r in docs.limit(40).collect())
    got = lm_score.counts(docs.limit(40).select("text", F.lit(True).alias("good")), buckets).collect()
    assert len(got) == (want > 0).sum() and all(want[r["bucket"]] == r["n_all"] == r["n_in"] for r in got)


def test_scores_awkward(spark):
    got = lm_score.cross_entropy(awkward(spark), frame(spark, [(5, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(AWKWARD) and all(r["score"] == 0 for r in got if not r["n_bytes"])
    assert lm_score.cross_entropy(frame(spark, []), frame(spark, [])).count() == 0


# -- 3 near-duplicates


def _brute(texts, width, per_cent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    texts = corpus() + ["", None, "one", "ONE", "one two"]
    sizes, roots = _brute(texts, width)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), width).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_every_pair_within_the_distance_shares_a_key(spark):
    r = random.Random(9)
    base = [r.randrange(1 << 16) for _ in range(minhash.SYMBOLS)]
    sigs = []
    for i in range(40):
        s = list(base)
        for k in r.sample(range(minhash.SYMBOLS), minhash.MAX_DISTANCE):
            s[k] = r.randrange(1 << 16)
        sigs.append((i, bytearray(np.array(s, "<u2").tobytes())))
    sigs.append((99, bytearray(np.array(base, "<u2").tobytes())))
    keys = {}
    for k, rep in minhash._keys(frame(spark, sigs, "rep long, sig binary")).collect():
        keys.setdefault(rep, set()).add(k)
    assert all(keys[99] & keys[i] for i in range(40)) and all(len(v) == minhash.SYMBOLS for v in keys.values())


def test_group_whose_head_lacks_a_link(spark):
    """A chain: neighbours are near, ends aren't; and a large group of near copies."""
    w = [f"w{i}" for i in range(60)]
    chain = [" ".join(w[:k] + [f"v{i}" for i in range(k)] + w[k:]) for k in range(0, 40, 4)]
    group = [" ".join([f"g{i}" for i in range(80)] + [f"t{k}"]) for k in range(60)]
    texts = chain + group
    _, roots = _brute(texts, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 2).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_a_template_gives_no_pairs(spark):
    """Documents of 200 shared and 50 own words: near in signature, none linked; pairs don't grow with their square."""
    for n in (300, 2400):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("array_join(concat(transform(sequence(1, 200), i -> 't' || i), transform(sequence(1, 50), i -> 'o' || (id * 50 + i))), ' ')").alias("text"))
        texts = docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"), "text")
        assert minhash.prefix_join(texts, 2, 80).count() <= n
        if n == 300:
            got = minhash.near_duplicates(docs, 2)
            assert got.where("kept").count() == n


def test_prefix_join_against_brute_force(spark):
    texts = corpus(seed=11, n=250)
    w = [t.split() for t in texts]
    sets = [{tuple(x[i : i + min(2, len(x))]) for i in range(len(x) - min(2, len(x)) + 1)} for x in w]
    pairs = lambda p: {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= p * len(a | b)}
    df = frame(spark, [(i, i, t) for i, t in enumerate(texts)], "rep long, label long, text string")
    for p in (60, 80, 95):
        got = {tuple(r) for r in minhash.prefix_join(df, 2, p).collect()}
        assert pairs(p) <= got


def test_crowded_buckets_against_brute_force(spark):
    """A large bucket of a template in which some documents are linked, though not to its smallest id."""
    r = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base + [f"o{k}_{i}" for i in range(r.choice([10, 25, 40]))]) for k in range(150)]
    texts += [t + " z" * (k % 2) + f" y{k}" for k, t in enumerate(texts[20:60])]
    _, roots = _brute(texts, 2)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 2).collect()}
    assert [got[i] for i in range(len(texts))] == roots and len(set(roots)) > 50


def test_hot_tokens_meet_in_blocks(spark, monkeypatch):
    """Near copies of one text, some outside the main component: costly tokens aren't joined, links are those of brute force."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(240):
        t = list(base)
        for k in r.sample(range(150), 2 + i % 13):
            t[k] = f"e{r.randrange(2000)}"
        texts.append(" ".join(t))
    joined, met = [], []
    pairs, blocks = minhash._prefix_pairs, minhash.block_links
    monkeypatch.setattr(minhash, "HOT_PAIRS", 50)
    monkeypatch.setattr(minhash, "HEADS", 4)
    monkeypatch.setattr(minhash, "HELD", 2000)
    monkeypatch.setattr(minhash, "PASSING", 20_000)
    monkeypatch.setattr(minhash, "_prefix_pairs", lambda rows, p: joined.append(minhash.token_costs(rows).agg(F.max("pairs")).first()[0] or 0) or pairs(rows, p))
    monkeypatch.setattr(minhash, "block_links", lambda *a: met.append(blocks(*a)) or met[0])
    _, roots = _brute(texts, 2)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 2).collect()}
    assert [got[i] for i in range(len(texts))] == roots and len(set(roots)) > 2
    assert joined[0] <= 50 and met[0]


def test_near_duplicates_awkward(spark):
    got = minhash.near_duplicates(awkward(spark), 2)
    rows = got.collect()
    assert len(rows) == len(AWKWARD) and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert [r["component_id"] for r in rows if r["doc_id"] == 4] == [3, 3] and all(r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


# -- 4 embeddings


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((300, 48))
    for i in range(100, 300):
        if i % 2:
            j = i - 100 if i < 220 else 5
            v[i] = v[j] / np.linalg.norm(v[j]) + r.standard_normal(48) * r.uniform(0, 0.08)
    v[299] = v[5] * 3
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {x["vec_id"]: x for x in embed_dedup.near_vectors(frame(spark, [(i, [float(y) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i]["n_links"] for i in range(300)] == near.sum(1).tolist()
    label = np.arange(300)
    for _ in range(300):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(300)])
        if (new == label).all():
            break
        label = new
    assert [got[i]["component_id"] for i in range(300)] == label.tolist()


def _pairs_at(x, least, r):
    """For unit rows x, unit rows at just that cosine."""
    z = r.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    return least * x + math.sqrt(1 - least * least) * z / np.linalg.norm(z, axis=1)[:, None]


@pytest.mark.parametrize("d", [2, 4, 64, 768])
@pytest.mark.parametrize("n", [10_000, 1_000_000_000])
@pytest.mark.parametrize("shared", [0.0, 1.6])
def test_recall_of_the_buckets(d, n, shared):
    r = np.random.default_rng(8)
    mean = r.standard_normal(d)
    mean *= shared / np.linalg.norm(mean)
    draw = lambda k: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(r.standard_normal((k, d)) / math.sqrt(d) + mean)
    centre, depth, tables = embed_dedup.fitted(draw(1000), n, 0.9)
    assert tables <= embed_dedup.MOST_TABLES and depth >= (1 if d < 64 or shared and d > 64 else {10_000: 2, 1_000_000: 2, 1_000_000_000: 3}[n] - (shared > 0))
    a = draw(300)
    b = _pairs_at(a, 0.9, r)
    x, y = (embed_dedup.buckets(q - centre, tables, depth) for q in (a, b))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist())]) >= (0.99 if d > 4 and not shared else 0.95)
    h = r.standard_normal((9, 64))
    assert np.allclose(embed_dedup.hadamard(embed_dedup.hadamard(h)), h)


def _links(v, least=0.9):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


def test_vectors_that_share_a_direction(spark):
    """Mean cosine 0.72 and no link but the planted ones: buckets stay small, links are found."""
    r = np.random.default_rng(3)
    mean = r.standard_normal(64)
    for n in (500, 1000):
        v = r.standard_normal((n, 64)) / 8 + 1.6 * mean / np.linalg.norm(mean)
        for i in range(0, 60, 2):
            v[i + 1] = v[i] + r.standard_normal(64) * 0.02
        near = _links(v)
        u = v / np.linalg.norm(v, axis=1)[:, None]
        assert near.any(0)[:60].all() and (u @ u.T).mean() > 0.7
        centre, depth, tables = embed_dedup.fitted(u, n, 0.9)
        keys = embed_dedup.buckets(u - centre, tables, depth)
        sizes = np.unique(keys, return_counts=True)[1]
        assert sizes.max() <= 0.2 * n
        if n == 500:
            got = {x["vec_id"]: x["n_links"] for x in embed_dedup.near_vectors(frame(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
            want = near.sum(1)
            assert sum(min(got[i], want[i]) for i in range(n)) >= 0.9 * want.sum() and all(got[i] <= want[i] for i in range(n))


def test_crowded_buckets_are_split(spark, monkeypatch):
    """Several narrow topics: the mean of all doesn't help, that of a bucket does."""
    monkeypatch.setattr(embed_dedup, "CROWD", 20)
    r = np.random.default_rng(5)
    topics = r.standard_normal((4, 32))
    v = np.stack([topics[i % 4] / np.linalg.norm(topics[i % 4]) * 1.5 + r.standard_normal(32) / 6 for i in range(400)])
    for i in range(0, 80, 8):
        v[i + 4] = v[i] + r.standard_normal(32) * 0.01
    near = _links(v, 0.97)
    df = frame(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: x["n_links"] for x in embed_dedup.near_vectors(df, least=0.97).collect()}
    assert sum(min(got[i], n) for i, n in enumerate(near.sum(1))) >= 0.9 * near.sum() and all(got[i] <= n for i, n in enumerate(near.sum(1)))


def test_borderline_cells_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    r = np.random.default_rng(6)
    a = r.standard_normal(16)
    a /= np.linalg.norm(a)
    b = _pairs_at(a[None, :], 0.9, r)[0]
    v = np.stack([(a, b)[i % 2] + r.standard_normal(16) * 0.02 for i in range(240)])
    near = _links(v)
    got = {x["vec_id"]: x for x in embed_dedup.near_vectors(frame(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i]["n_links"] for i in range(240)] == near.sum(1).tolist() and {got[i]["component_id"] for i in range(240)} == {0}


def test_vectors_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(None, [1.0, 0.0], 0), (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [2.0, 4.0], 1), (8, [2.0, 4.0], 1), (9, [1e-300, 2e-300], 0), (10, [1.0, 2.0, 0.0], 0)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("cid", "cell", "m", "rep", "unit", "key")})
    got = {}
    for r in embed_dedup.near_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[7] == [(2, 7, True)] and got[8] == [(2, 7, False)] * 2 and got[9] == [(2, 7, False)] and got[10] == [(0, 10, True)]
    assert all(got[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6)) and got[None] == [(0, None, True)]
    assert embed_dedup.near_vectors(frame(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0


# -- 5 urls


def _url_brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = min([k for k in (rest.find(c) for c in "/?#") if k >= 0] or [len(rest)])
    host, rest = rest[:i], rest[i:]
    j = min([k for k in (rest.find(c) for c in "?#") if k >= 0] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:j]


def test_urls(spark):
    urls = ["http://a.NET/x", "https://x.example.net/en/1", "http://example.net/en", "http://example.com/de/1?q", "http://b.example.com/de/", "http://w.org/fr/", "http://Org/fr/x", "http://notnet/x", "http://a.net", "http://a.net?x/", None, "", "no scheme", "a://b://c/d", "http://É.net/\n#f", "http://casino-bonus.example/free-spins/jackpot", "http://a.example/" + "x/" * 500_000]
    df = frame(spark, list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "verdict": F.lit(3)})
    got = {r["page_id"]: r for r in url_filter.judged(df).collect()}
    w, b = url_filter.trained(url_filter.SEED)
    for i, u in enumerate(urls):
        host, path = _url_brute(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits)[1] if fits else None
        want = max(fits)[2] if fits else ("block" if url_filter.chance(host, path, w, b) >= 0.5 else "allow")
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, want)
    assert got[1]["rule"] == "example.net/en/" and got[15]["verdict"] == "block" and got[10]["verdict"] == "allow"
    assert url_filter.judged(frame(spark, [], "page_id long, url string")).count() == 0


def test_url_model_learns_its_table():
    w, b = url_filter.trained(url_filter.SEED)
    assert np.mean([(url_filter.chance(h, p, w, b) >= 0.5) == bool(y) for h, p, y in url_filter.SEED]) == 1


def test_url_model_on_rows_that_it_has_not_seen():
    """Five folds of the labelled table; no host of it is of the test tables' domains."""
    rows = list(url_filter.SEED)
    random.Random(2).shuffle(rows)
    assert len(rows) >= 190 and len({h for h, _, _ in rows}) == len(rows) and not any(h.endswith(("example.com", "example.org", "example.net")) for h, _, _ in rows)
    hits = []
    for k in range(5):
        w, b = url_filter.trained([x for i, x in enumerate(rows) if i % 5 != k])
        hits += [(url_filter.chance(h, p, w, b) >= 0.5) == bool(y) for i, (h, p, y) in enumerate(rows) if i % 5 == k]
    assert np.mean(hits) > 0.8


# -- 6 toxicity


def test_grammar():
    plain = toxicity.clause_value([("O", 0), ("I", 2.0)])
    assert plain == 2.0 and toxicity.clause_value([("N", 0), ("O", 0), ("I", 2.0)]) == 1.0
    assert toxicity.clause_value([("R", 0), ("O", 0), ("I", 2.0)]) == pytest.approx(1.2)
    assert toxicity.clause_value([("U", 1), ("O", 0), ("I", 2.0)]) == pytest.approx(2.6)
    assert toxicity.clause_value([("T", 2.0)]) == 0 and toxicity.clause_value([("T", 2.0), ("U", 1)]) == 2.0
    assert toxicity.clause_value([("S", 4.0), ("O", 0), ("U", 1)]) == toxicity.clause_value([("U", 1), ("O", 0), ("S", 4.0)]) == 4.0
    assert toxicity.clause_value([("T", 2.0), *[("O", 0)] * 5, ("U", 1)]) == 0 and toxicity.clause_value([("N", 0), ("T", 2.0), ("U", 1)]) == 1.0
    assert toxicity.clause_value([("I", 2.0), ("O", 0), ("I", 2.0)]) == pytest.approx(4.4)
    assert toxicity.clause_value([("N", 0), ("O", 0), ("O", 0), ("O", 0), ("I", 2.0)]) == 2.0


def test_composition_equals_running_in_turn():
    r = random.Random(3)
    parts = [p for _, p in toxicity.PARTS]
    machine = toxicity.grammar()
    assert machine.states > 500
    for _ in range(300):
        seq = [r.choice("ITSUNRO") for _ in range(r.randint(1, 14))]
        q, whole, state = 0, [], [0] * len(parts)
        for s in seq:
            q, out, w = machine.table[(q, s)]
            factor, now = 1.0, s
            for k, p in enumerate(parts):
                state[k], now, f = p.table[(state[k], now)]
                factor *= f
            whole.append((out, w) == (now, pytest.approx(factor)))
        assert all(whole)


def test_lexicon_transducer():
    t = toxicity.Trie()
    for w in ("ab", "abcd*", "abcdef*", "abcdx"):
        t.add(w, (w,))
    assert [t.read(w) for w in ("ab", "abc", "abcd", "abcde", "abcdefg", "abcdx", "zz", "")] == [("ab",), None, None, ("abcd*",), ("abcd*",), ("abcdx",), None, None]


def test_weights_as_columns(spark):
    rows = [(a, b) for a in (0, 1, 2, 3, 7, 20, 40) for b in (0, 1, 2, 5, 300, 1000)]
    got = frame(spark, rows, "pos long, neg long").select("pos", "neg", toxicity.weight_column(F.col("pos"), F.col("neg"), 40.0, 1000.0).alias("w")).collect()
    assert all(r["w"] == pytest.approx(toxicity.weight(r["pos"], r["neg"], 40, 1000)) for r in got) and sum(r["w"] > 0 for r in got) > 5


def test_threats_need_a_target(spark):
    """A word that is toxic only next to a target is learned as a threat, and counts only there."""
    r = random.Random(7)
    vocab = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(vocab) for _ in range(30)]
        kind, verb, who = i % 6, ("frobb", "zlatt", "murgh")[i // 6 % 3], r.choice(["you", "your", "dich", "vous"])
        rows.append((i, " ".join(w) + f". {verb} {who}. " * (kind == 0) + f". {verb} wood. " * (kind in (1, 2, 3)) + f". see {who}. " * (kind > 3) + " ".join(w[:9]), "en", "s", 0))
        labels.append((i, 1, int(kind == 0)))
    docs = frame(spark, rows)
    model = toxicity.learned(docs, frame(spark, labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 5 != 0)
    assert "!frobb" in model["lexicon"] and "frobb" not in model["lexicon"]
    probe = frame(spark, [(1, "a frobb for you", None, None, 0), (2, "a frobb for wood", None, None, 0), (3, "you see", None, None, 0)])
    assert {x["doc_id"]: x["predicted"] for x in toxicity.scored(probe, model).collect()} == {1: 1, 2: 0, 3: 0}


def test_toxicity_ties_and_very_long_texts(spark):
    model = toxicity.DEFAULT
    long = "word " * 800_000
    rows = [(1, long + "you idiot", None, None, 0), (2, long, None, None, 0), (3, "idiot", None, None, 0), (4, "idiot", None, None, 0)]
    got = {x["doc_id"]: (x["predicted"], x["score"]) for x in toxicity.scored(frame(spark, rows), model).select("doc_id", "predicted", "score").collect()}
    assert got[1][0] == 1 and got[2][0] == 0 and got[3] == got[4]


def test_toxicity_is_learned(spark):
    r = random.Random(6)
    vocab = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(60)]
        y = i % 5 == 0
        if y:
            for k in range(3):
                w[r.randrange(60)] = "gromp" + r.choice(["el", "ix", "ar", "o"]) if i % 2 else r.choice(["blart", "snerk"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(y)))
    docs, lab = frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, lab, F.col("doc_id") % 3 != 0)
    got = {x["doc_id"]: x["predicted"] for x in toxicity.scored(docs, model).collect()}
    held = [i for i in range(600) if i % 3 == 0]
    assert np.mean([got[i] == labels[i][2] for i in held]) > 0.97


def test_toxicity_awkward(spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    model = toxicity.learned(awkward(spark), none, F.lit(True))
    got = toxicity.scored(awkward(spark), model)
    assert got.count() == len(AWKWARD) and got.where("predicted = 1").count() == 0 and got.where("score is null").count() == 0
    assert toxicity.scored(frame(spark, []), model).count() == 0
    one = frame(spark, [(None, 1, 1), (3, None, None), (4, 1, 1), (5, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.learned(awkward(spark), one, F.lit(True))["coef"]


# -- 7 languages


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predicted(docs, queries.language_model(docs)).where(common.crc_mod("doc_id", 4) == 2).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_backoff():
    zero = (-9.0, -9.0)
    model = {"langs": ["a", "b"], "base": dict.fromkeys(range(5), zero), "tokens": {0: {"the": ((0, 8.0), (1, 4.0))}, 4: {}, 3: {"zzz": ((1, 8.0),)}, 2: {}, 1: {"q": ((0, 7.0), (1, 6.0))}}}
    s = langid.Scorer(model)
    assert s("the the")[0] == "a" and s("zzzz")[0] == "b" and s("q")[0] == "a"
    assert s(None) == s("") == s("12 ...") == s("½ ²") == ("und", 0.0)


def test_small_and_many_languages_keep_their_words(spark):
    r = random.Random(8)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(5, 9)))
    small = [word("uvwxyz") for _ in range(243)]
    rows = [(i, " ".join(word("abcdefghijkl") for _ in range(75)), "big", "s", 0) for i in range(2000)]
    rows += [(5000 + i, " ".join(r.choice(small) for _ in range(40)), "small", "s", 0) for i in range(40)]
    model = langid.learned(frame(spark, rows), F.lit(True))
    at = model["langs"].index("small")
    assert sum(any(i == at for i, _ in model["tokens"][0].get(w, ())) for w in set(small)) > 230
    many = frame(spark, [(i, f"{chr(0x4E00 + 7 * (i % 300))}{chr(0x6000 + i % 300)} und", f"l{i % 300:03d}", "s", 0) for i in range(900)])
    model = langid.learned(many, F.lit(True))
    got = langid.predicted(many, model).select("lang", "lang_pred").collect()
    assert len(model["langs"]) == 300 and np.mean([x["lang"] == x["lang_pred"] for x in got]) == 1


def test_language_ties_and_very_long_texts(spark):
    rows = [(1, "aa bb", "x", "s", 0), (2, "aa bb", "a", "s", 0), (3, "cc " * 700_000, "long", "s", 0), (3, "cc " * 700_000, "long", "s", 0)]
    df = frame(spark, rows)
    got = langid.predicted(df, langid.learned(df, F.lit(True))).select("doc_id", "lang_pred").collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got) == [(1, "a"), (2, "a"), (3, "long"), (3, "long")]


def test_languages_awkward(spark):
    df = awkward(spark)
    got = langid.predicted(df, langid.learned(df, F.lit(True)))
    rows = got.collect()
    assert len(rows) == len(AWKWARD) and all(r["lang_pred"] == "und" for r in rows if r["text"] is None or not any(c.isalpha() for c in r["text"]))
    empty = langid.learned(frame(spark, []), F.lit(True))
    assert [r["lang_pred"] for r in langid.predicted(df, empty).collect()] == ["und"] * len(AWKWARD)


# -- 8 byte-level BPE


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def test_ids_are_those_of_the_rank_file(codec):
    import public_tokenizers as P
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    r = random.Random(1)
    texts = corpus(n=40) + ["", " ", "<|endoftext|>", "a" * 3000, "it's  we'LL\n\n\t x", "".join(map(chr, range(300))), "日本語 ünï ½ ² 𝔘𝔫𝔦 \u200b\x1c\x85\xa0", "\0\0"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 256), r.randrange(0x370, 0x500), 32, 10])) for _ in range(80)) for _ in range(60)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_coded(spark, codec):
    import public_tokenizers as P

    got = bpe.coded(awkward(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert len(got) == len(AWKWARD)
    texts = {r[0]: r[1] for r in AWKWARD if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or ""
            ids = codec.encode(t)
            assert (r["ids"], r["n_tokens"]) == (ids, len(ids)) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.coded(frame(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    with pytest.raises(ValueError, match="ranks"):
        bpe.serialised({b"a": 0, b"b": 2})


# -- 9 TIFF


def test_lzw_codes_are_cut_out_together(monkeypatch):
    """Encoded bytes as they were; the decoder cuts out a table's codes at once, not bit by bit; full tables, clears and bad codes."""
    r = random.Random(5)
    data = b"".join(r.choice([b"lattice ", b"work ", b"aaaa", b"\0" * 9, r.randbytes(5)]) for _ in range(9000))
    kept = tiff.lzw_encode(data)
    assert hashlib.sha256(kept).hexdigest() == "756abf6c39a2becd984f235096adf21c1766a82124b5a51dba452a27a0c7c2b0"
    assert hashlib.sha256(tiff.packbits_encode(data)).hexdigest() == "53c6d7e8c8233fa01c2fc53017781390aba4b7cc058744715992bb4fd7149231"
    cuts, cut = [], tiff._codes
    monkeypatch.setattr(tiff, "_codes", lambda *a: cuts.append(1) or cut(*a))
    assert tiff.lzw_decode(kept) == data and len(cuts) < 12
    for n in (3834, 3835, 3836, 3837, 7673):
        some = r.randbytes(n)
        assert tiff.lzw_decode(tiff.lzw_encode(some)) == some
    # 9-bit codes without a clear, then one that no entry has
    assert tiff.lzw_decode((65 << 7).to_bytes(2, "big")) == b"A"
    with pytest.raises(tiff.TiffError):
        tiff.lzw_decode((65 << 23 | 300 << 14).to_bytes(4, "big"))


def test_codecs_round_trip():
    r = random.Random(2)
    cases = [b"", b"a", b"aa", b"ab" * 300, bytes(5000), bytes(r.randrange(256) for _ in range(20000)), bytes(r.choice(b"ab") for _ in range(30000)), b"x" * 129 + b"yz" + b"q" * 128]
    for data in cases:
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE])
@pytest.mark.parametrize("layout", [{"rows": 5}, {"tile": 16}, {"rows": 1024}])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files_round_trip(codec, layout, predictor, order):
    r = random.Random(codec)
    own = [bytes(r.choice(b"abcde") for _ in range(24 * h)) for h in (1, 24, 37)]
    got = list(tiff.pages(tiff.stored(own, codec=codec, predictor=predictor, order=order, **layout)))
    assert [p.pixels.tobytes() for p in got] == own and [p.index for p in got] == [0, 1, 2] and got[0].tiled == ("tile" in layout)


def test_page_rows(spark):
    good = tiff.stored([b"\x01" * 48, b"\x02" * 24])
    loop = bytearray(tiff.stored([b"\x01" * 24]))
    loop[-4:] = loop[4:8]
    files = frame(spark, [("g", bytearray(good)), ("n", None), ("e", bytearray()), ("x", bytearray(b"GIF89a")), ("l", loop), ("t", bytearray(good[:60]))], "file_id string, data binary")
    rows = {}
    for r in tiff.page_rows(files).collect():
        rows.setdefault(r["file_id"], []).append(r)
    assert set(rows) == {"g", "x", "l", "t"} and [(r["page"], r["height"]) for r in rows["g"]] == [(0, 2), (1, 1)]
    assert rows["x"][0]["error"] and rows["l"][-1]["error"] and rows["t"][-1]["error"]


def _tag(data, tag, kind, *values):
    """A file's first directory with one entry overwritten."""
    import struct

    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    (n,) = struct.unpack_from("<H", out, at)
    for i in range(n):
        if struct.unpack_from("<H", out, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<HI", out, at + 4 + 12 * i, kind, len(values) if values else 0)
            out[at + 10 + 12 * i : at + 14 + 12 * i] = struct.pack("<" + {3: "H", 4: "I", 9: "i", 2: "B"}[kind] * len(values), *values).ljust(4, b"\0")[:4]
    return bytes(out)


def test_malformed_files_give_an_error_row(spark):
    tiled, plain = tiff.stored([b"abc" * 192], tile=16), tiff.stored([b"abc" * 192], codec=tiff.NONE)
    bad = [_tag(tiled, 322, 3, 0), _tag(plain, 256, 4), _tag(plain, 256, 2, 65), _tag(_tag(plain, 256, 4, 1 << 31), 257, 4, 1 << 31), _tag(plain, 256, 9, -5), _tag(plain, 259, 3, 7), _tag(plain, 279, 4, 1 << 30), _tag(plain, 278, 4, 0), plain[:30]]
    for data in bad:
        (found,) = tiff.pages_or_errors(data)
        assert isinstance(found, tuple) and found[1]
    # the next directory is read all the same
    two = tiff.joined(_tag(plain, 256, 2, 65), tiff.stored([b"x" * 48]))
    assert [isinstance(p, tiff.Page) for p in tiff.pages_or_errors(two)] == [False, True]
    rows = tiff.page_rows(frame(spark, [(None, bytearray(two)), ("a", bytearray(bad[0])), ("a", bytearray(bad[0]))], "file_id string, data binary").withColumn("page", F.lit(1))).collect()
    assert len(rows) == 4 and sum(r["error"] is None for r in rows) == 1


def test_every_byte_changed(spark):
    data = tiff.joined(tiff.stored([b"ab" * 48], codec=tiff.LZW), tiff.stored([b"ab" * 48], codec=tiff.PACKBITS, predictor=2))
    for i in range(len(data)):
        for v in (0, 1, 127, 255):
            assert all(isinstance(p, (tiff.Page, tuple)) for p in tiff.pages_or_errors(data[:i] + bytes([v]) + data[i + 1 :]))


@pytest.mark.parametrize("order", ["<", ">"])
def test_other_samples(order):
    """1, 4 and 16 bits, and planes, in files put together by hand."""
    import struct

    def made(tags, blocks):
        out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        tags = tags | {273: (4, offsets), 279: (4, [len(b) for b in blocks])}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
            if len(body) > 4:
                at = len(out)
                out += body
                body = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, 4, len(out))
        return bytes(out + struct.pack(order + "H", len(tags)) + entries + bytes(4))

    r = np.random.default_rng(1)
    base = {256: (4, [13]), 257: (4, [5])}
    x = r.integers(0, 2, (5, 13), dtype=np.uint8)
    raw = b"".join(tiff.packbits_encode(row.tobytes()) for row in np.packbits(x, axis=1))
    (p,) = tiff.pages(made(base | {258: (3, [1]), 259: (3, [tiff.PACKBITS])}, [raw]))
    assert (p.pixels[:, :, 0] == x).all()
    x = r.integers(0, 16, (5, 13), dtype=np.uint8)
    wide = np.pad(x, ((0, 0), (0, 1)))
    (p,) = tiff.pages(made(base | {258: (3, [4])}, [(wide[:, ::2] << 4 | wide[:, 1::2]).astype(np.uint8).tobytes()]))
    assert (p.pixels[:, :, 0] == x).all()
    x = r.integers(0, 1 << 16, (5, 13, 3)).astype(np.uint16)
    d = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1).astype(order + "u2")
    (p,) = tiff.pages(made(base | {258: (3, [16, 16, 16]), 277: (3, [3]), 317: (3, [2])}, [d.tobytes()]))
    assert (p.pixels == x).all()
    x = r.integers(0, 256, (5, 13, 3), dtype=np.uint8)
    (p,) = tiff.pages(made(base | {258: (3, [8, 8, 8]), 277: (3, [3]), 284: (3, [2]), 278: (4, [3])}, [x[y : y + 3, :, k].tobytes() for k in range(3) for y in (0, 3)]))
    assert (p.pixels == x).all()


def test_text_media(spark):
    got = tiff.text_media(awkward(spark)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in AWKWARD if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            data = texts[r["doc_id"]]
            want = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
            assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(want), zlib.crc32(want[-32:])) and r["payload_sha256"] == hashlib.sha256(want).hexdigest()
            media = tiff.stored([want], codec=tiff.DEFLATE, predictor=2)
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert len(got) == len(AWKWARD) and tiff.text_media(frame(spark, [])).count() == 0
    assert len(tiff.payload(b"x" * 576)) == 576


# -- 10 WARC


def _replica(spark, rows):
    return frame(spark, rows, "archive long, position long, record_id string, record string")


def _records(n, per=1000):
    return [(i // per, i, f"r{i}", f"<p>{i * 7919}</p>" * (1 + i % 4)) for i in range(n)]


def test_audit_finds_the_damage_alone(spark):
    ours = _records(2345)
    theirs = [(a, 2 * p, r, "damaged" if r == "r1203" else x.replace("<", "[", 1) if r == "r17" else x) for a, p, r, x in ours if r not in ("r2000", "r1900")]
    theirs += [(0, 2 * 500 + 1, "new", "new")]
    theirs = [(a, p + 5 if r == "r2100" else p, r, x) for a, p, r, x in theirs]
    got = {(r["archive"], r["record_id"]): r for r in warc_audit.audit(_replica(spark, ours), _replica(spark, theirs)).collect()}
    # brute force over both lists
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def placed(rows):
        out, at = {}, {}
        for a, p, r, x in sorted(rows):
            lo, no = at.get(a, (0, 0))
            out[a, r] = (no, lo, lo + len(x), sha(x))
            at[a] = (lo + len(x), no + 1)
        return out

    mine, other = placed(ours), placed(theirs)
    for key in mine.keys() | other.keys():
        x, y = mine.get(key), other.get(key)
        want = "added" if x is None else "missing" if y is None else "corrupt" if x[3] != y[3] else "shifted" if x[1:3] != y[1:3] else "ok"
        assert got[key]["status"] == want, key
    assert len(got) == len(mine.keys() | other.keys()) and got[0, "r17"]["status"] == "corrupt" and got[0, "r18"]["status"] == "ok" and got[0, "r501"]["status"] == "shifted"
    assert warc_audit.audit(_replica(spark, ours), _replica(spark, ours)).where("status <> 'ok'").count() == 0


def test_roots_against_brute_force(spark):
    own = _records(1042)
    got = sorted(warc_audit.audit(_replica(spark, own), _replica(spark, own)).collect(), key=lambda r: (r["archive"], r["no"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for archive in (0, 1):
        rows = [r for r in got if r["archive"] == archive]
        level = [(r["lo"], r["hi"], sha(f"{r['lo']}-{r['hi']}:{r['record_sha256']}")) for r in rows]
        assert [x[2] for x in level] == [r["leaf_sha256"] for r in rows]
        for _ in range(3):
            groups = [level[i : i + 10] for i in range(0, len(level), 10)]
            level = [(g[0][0], g[-1][1], sha(f"{g[0][0]}-{g[-1][1]}:" + "".join(x[2] for x in g))) for g in groups]
        assert len(level) == 1 and {r["archive_root"] for r in rows} == {level[0][2]}


def test_audit_descends_only_where_it_differs(spark):
    ours = _records(30_000, per=100)
    theirs = [(a, p, r, x.upper() if r in ("r555", "r29999") else x) for a, p, r, x in ours]
    a, b = (warc_audit.trees(warc_audit.leaves(_replica(spark, x)), 3) for x in (ours, theirs))
    assert sorted(r[0] for r in warc_audit.differing_archives(a, b).collect()) == [5, 299]
    assert sorted(tuple(r) for r in warc_audit.differing_leaves(a, b, 3).collect()) == [(5, 55), (299, 99)]


def test_audit_awkward(spark):
    rows = [(None, None, None, None), (0, None, None, "é"), (0, None, None, "é"), (0, 1, "", None), (7, 2, "x", "y")]
    df = _replica(spark, [r for r in rows if r[0] is not None]).withColumns({c: F.lit(1) for c in ("no", "sha", "lo", "hi", "leaf", "root")})
    got = warc_audit.audit(df, df).collect()
    assert len(got) == 4 and all(r["status"] == "ok" for r in got)
    none = _replica(spark, [])
    assert warc_audit.audit(none, none).count() == 0
    assert [r["status"] for r in warc_audit.audit(df, none).collect()] == ["missing"] * 4 and [r["status"] for r in warc_audit.audit(none, df).collect()] == ["added"] * 4
    swapped = _replica(spark, [(0, 1, "a", "x"), (0, 2, "a", "x"), (0, 3, "b", "yy")])
    moved = _replica(spark, [(0, 1, "b", "yy"), (0, 2, "a", "x"), (0, 3, "a", "x")])
    assert sorted((r["record_id"], r["status"]) for r in warc_audit.audit(swapped, moved).collect()) == [("a", "shifted"), ("a", "shifted"), ("b", "shifted")]


# -- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_whole(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = {"op4_embedding_dedup": "embeddings", "op5_url_filter": "pages", "op10_warc_fixity": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() == (2 * n if name == "tiff_pages" else n) + (name == "op10_warc_fixity")  # the drill adds a record
    assert not any(isinstance(f.dataType, T.NullType) for f in df.schema.fields)


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "near_duplicates", "mixing", "byte_bpe"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = P.language(spark, docs, SF)
    assert one.columns == docs.columns
    two = P.toxic(spark, one, SF)
    three = P.near_duplicates(spark, two, SF).toPandas()
    kept = two.toPandas()
    _, roots = _brute(kept["text"].tolist(), 5)
    order = kept["doc_id"].tolist()
    first = {}
    for i, root in enumerate(roots):
        first[root] = min(first.get(root, order[i]), order[i])
    assert sorted(three["doc_id"]) == sorted(first.values())
    final = P.run(spark, SF).toPandas()
    assert set(final["doc_id"]) <= set(three["doc_id"]) and (final.groupby("doc_id").size() <= 3).all()


def test_pipeline_stages_awkward(spark):
    import corpus_pipeline as P

    df = frame(spark, AWKWARD)
    for name, stage in P.STAGES:
        got = stage(spark, df, SF)
        assert got.count() <= 3 * len(AWKWARD)
        assert name == "byte_bpe" or got.columns == P.COLUMNS
        assert stage(spark, frame(spark, []), SF).count() == 0


def test_pipeline_stages_take_int_ids_and_clashing_columns(spark):
    import corpus_pipeline as P

    base = frame(spark, [(i, f"some words of text number {i} are here " * (1 + i % 3), "en", "ab"[i % 2], 0) for i in range(60)])
    for name, stage in P.STAGES:
        want = stage(spark, base, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
        clash = base.withColumn("doc_id", F.col("doc_id").cast("int")).withColumns({c: F.lit(7) for c in ("h", "h2", "copies", "n", "i", "x", "k", "score", "predicted", "lang_pred", "kept", "component_id", "n_tokens", "size", "target")})
        got = stage(spark, clash, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
        assert len(want) > 0 and list(got.columns) == list(want.columns) and got.astype(str).equals(want.astype(str)), name
