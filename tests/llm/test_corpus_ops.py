"""Near-duplicates, embeddings, sharding, language, language model, URL lists and pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobtide.llm import components, hnsw, language, lm, minhash, shards, url_lists
from jobtide.llm.batches import Scratch, Texts


def words(pick, n, prefix="w"):
    return [f"{prefix}{pick.randint(0, 400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    out = [None, None, "", "", "!!!", "one two", "One, two!", "one two three four"]
    base = words(pick, 120)
    for k in range(30):  # near copies, most of them nearer to the base than to each other
        copy = list(base)
        for i in pick.sample(range(120), k % 5):
            copy[i] = f"x{k}{i}"
        out.append(" ".join(copy))
    out += [" ".join(base)] * 3
    passage = words(pick, 40, "p")
    out += [" ".join(words(pick, 60) + passage) for _ in range(20)]
    return out + [" ".join(words(pick, pick.randint(1, 80))) for _ in range(30)] + ["rep " * 300]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles_of(text):
    own = WORD.findall(text.translate(LOWER))
    return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter()


def brute_weights(texts):
    """TF-IDF weights of the shingles of each text, by dictionaries of words."""
    found = [shingles_of(t or "") for t in texts]
    n = sum(bool(x) for x in found)
    df = Counter(s for x in found for s in x)
    idf = {s: 1 + math.log(1 / max(k / n, 1 / 512)) / math.log(512) for s, k in df.items()}
    return [{s: (1 + math.log(k)) * idf[s] for s, k in x.items()} for x in found]


def jaccard(x, y):
    least = sum(min(w, y[s]) for s, w in x.items() if s in y)
    total = sum(x.values()) + sum(y.values()) - least
    return least / total if total else 0.0


def brute_classes(texts):
    weights = brute_weights(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or texts[i] and texts[j] and jaccard(weights[i], weights[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [8 << 20, 1500])
def test_near_duplicates_are_brute_force(spark, texts, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, h string, class_rows int")
    want = brute_classes(texts)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert [found[i]["class_id"] for i in range(len(texts))] == want
    assert all(found[i]["kept"] == (want[i] == i) for i in found)
    assert all(found[i]["class_rows"] == (want.count(want[i]) if texts[i] is not None else 1) for i in found)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_inverse_frequencies_are_true(spark):
    pick = random.Random(12)
    shared = [" ".join(words(pick, 12, f"s{k}")) for k in range(6)]
    texts = [" ".join([*words(pick, 8), *(s for k, s in enumerate(shared) if pick.random() < 2.0**-k)]) for _ in range(1500)] + ["", None]
    idf = minhash.inverse_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), "text")
    df = Counter(s for t in texts for s in shingles_of(t or ""))
    for s in pick.sample(list(df), 400) + [s for s, _ in df.most_common(60)]:
        hashes, _ = minhash.shingles(Texts.of(pa.array([" ".join(s)])))
        assert idf.of(hashes)[0] == pytest.approx(1 + math.log(1 / max(df[s] / 1500, 1 / 512)) / math.log(512), abs=1e-4)
    assert len(idf.found) == sum(k > 1500 / 512 for k in df.values())


def test_samples_agree_as_often_as_texts_are_similar():
    draw = np.random.default_rng(4)
    sampler = minhash.Sampler(2000)
    for shared in (30, 80, 140):
        ids = draw.integers(0, 1 << 63, 300 - shared, np.uint64)
        a, b = ids[:150], np.concatenate([ids[:shared], ids[150:]])
        weights = dict(zip(ids.tolist(), draw.uniform(0.5, 4, len(ids)), strict=True))
        other = {k: w * (1.5 if i % 3 else 1) for i, (k, w) in enumerate(weights.items())}
        x, y = np.array([weights[k] for k in a.tolist()]), np.array([other[k] for k in b.tolist()])
        found, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        samples = sampler.samples(found, np.concatenate([x, y]), first)
        want = jaccard(dict(zip(a.tolist(), x, strict=True)), dict(zip(b.tolist(), y, strict=True)))
        assert (samples[0] == samples[1]).mean() == pytest.approx(want, abs=0.04)


def test_one_of_each_class_stays(spark, texts):
    docs = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, __n int")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    marked = minhash.near_duplicates(docs)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in marked.where("kept").collect()}
    twice = minhash.keep_one_of_each(docs.unionByName(docs).where("text IS NOT NULL"))
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted(r["doc_id"] for r in kept.where("text IS NOT NULL").collect())
    assert minhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(6)
    pairs = [(pick.randint(0, 60), pick.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    labels = components.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark))
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for r in labels.collect():
        seen, todo = {r["v"]}, [r["v"]]
        while todo:
            todo += [x for x in near[todo.pop()] - seen if not seen.add(x)]
        assert r["label"] == min(seen)
    assert labels.count() == len(near)


def test_ordered_path_takes_few_rounds(spark):
    scratch = Scratch(spark)
    labels = components.components(spark.range(10_000).selectExpr("id AS a", "id + 1 AS b"), scratch)
    assert labels.count() == 10_001 and labels.where("label <> 0").count() == 0
    assert scratch._n <= 25  # tables written, of which each doubling is one


def test_forest_joins_what_is_linked():
    draw = np.random.default_rng(5)
    for n in (1, 30, 400):
        forest = hnsw.Forest(n)
        a, b = draw.integers(0, n, (2, n))
        forest.add(a[: n // 2], b[: n // 2])
        forest.add(a[n // 2 :], b[n // 2 :])
        label = np.arange(n)
        for _ in range(n):
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
        root = forest._find(np.arange(n))
        assert (root == label).all()
        assert sum(len(x) for x, _ in forest.links) == n - len(np.unique(root))


@pytest.mark.parametrize("few, splits", [(16, 50_000), (3, 60)])
def test_near_vectors_by_graphs_are_brute_force(spark, few, splits, monkeypatch):
    """Graphs, and not the audit, give the result; hot groups as counts and as pairs."""
    monkeypatch.setattr(hnsw, "QUERY_ROWS", splits)
    monkeypatch.setattr(hnsw, "AUDIT_ROWS", 100)
    monkeypatch.setattr(hnsw, "AUDIT_LEAST", 5)
    draw = np.random.default_rng(9)
    x = draw.normal(size=(600, 16))
    x[100:300] = x[0] + draw.normal(0, 0.1, (200, 16))
    x[300:500:2] = x[301:500:2] + draw.normal(0, 0.05, (100, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in hnsw.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    for _ in range(20):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    right = [found[i]["n_links"] == near[i].sum() - 1 for i in range(len(x))]
    assert np.mean(right) > 0.97
    assert all(found[i]["n_links"] <= near[i].sum() - 1 for i in range(len(x)))
    assert np.mean([found[i]["component_id"] == label[i] for i in range(len(x))]) > 0.97


def test_near_vectors_are_brute_force(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(240, 12))
    x[60:120] = x[0] + draw.normal(0, 0.08, (60, 12))
    x[130:136] = x[130]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0]]
    rows += [(1000 + i, v, "d") for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = {r["vec_id"]: r for r in hnsw.near_vectors(df, keep=["vec_id", "label"]).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    assert [found[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [found[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert found[1005]["n_links"] == found[1006]["n_links"] == 1 and found[1006]["component_id"] == 1005
    assert all(found[1000 + k]["n_links"] == 0 and found[1000 + k]["kept"] for k in (0, 1, 2, 3, 4, 7))
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def least_capacity(sizes, n):
    best = [math.inf] * (len(sizes) + 1)
    best[0] = 0
    for _ in range(n):
        best = [min(max(best[i], sum(sizes[i:j])) for i in range(j + 1)) for j in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("few", [20_000, 3])
def test_shards_are_minimax(spark, few, monkeypatch):
    monkeypatch.setattr(shards, "FEW", few)
    monkeypatch.setattr(shards, "FAN", 4 if few == 3 else 4096)
    pick = random.Random(9)
    rows = [(i, None if i == 3 else "é" * pick.randint(0, 9) + str(pick.randint(0, 30)), 1) for i in range(150)]
    rows += [(900, "hot" * 40, 1)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, SIZE int")
    found = shards.assign_shards(df, 8, keep=["doc_id", "text"]).collect()
    groups = defaultdict(int)
    for r in found:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        groups[r["text"] or ""] += len(data) + 1
    hashes = {r["t"]: r["h"] for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(groups, key=hashes.__getitem__)
    sizes = Counter()
    by_text = {}
    for r in found:
        sizes[r["shard"]] += r["size"]
        assert by_text.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    assert max(sizes.values()) == least_capacity([groups[t] for t in order], 8)
    assert [by_text[t] for t in order] == sorted(by_text[t] for t in order)
    for k in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))
    assert shards.assign_shards(df.limit(0)).count() == 0
    assert shards.digest(shards.assign_shards(df)).columns[:4] == ["doc_id", "size", "text_crc32", "law"]


def brute_viterbi(scores, switch):
    import itertools

    best = max(
        itertools.product(range(scores.shape[1]), repeat=len(scores)),
        key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False)),
    )
    return sum(scores[i, k] for i, k in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:], strict=False))


def test_viterbi_is_best():
    draw = np.random.default_rng(3)
    lengths = [0, 1, 6, 3, 0, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = draw.normal(0, 3, (first[-1], 3))
    labels = language.viterbi(scores, first, 2.0)
    for a, b in zip(first, first[1:], strict=False):
        own, path = scores[a:b], labels[a:b]
        got = sum(own[i, k] for i, k in enumerate(path)) - 2 * (np.diff(path) != 0).sum()
        assert got == pytest.approx(brute_viterbi(own, 2.0) if len(own) else 0)


def test_language_spans_and_edges(spark):
    pick = random.Random(4)
    en = ["the", "and", "thing", "with", "order", "house"]
    de = ["und", "nicht", "schön", "auch", "straße", "ein"]
    ru = ["это", "как", "дом", "мир", "слово"]
    say = lambda w, n=30: " ".join(pick.choices(w, k=n))
    rows = [(i, say((en, de, ru)[i % 3]), ("en", "de", "ru")[i % 3], 1.5) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.learn(df)
    asked = [None, "", "123 -- !", "— … 😀", say(en), say(de), say(ru, 4), say(en) + " " + say(ru), "日本語", say(en, 9000)]
    out = language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model, spans=True).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out[:7]] == ["und"] * 4 + ["en", "de", "ru"] and out[9]["lang_pred"] == "en"
    assert all(r["score"] == 0 for r in out[:4]) and out[8]["lang_pred"] in ("en", "de", "ru")
    assert [s["lang"] for s in out[7]["lang_spans"]] == ["en", "ru"]
    cut = out[7]["lang_spans"][1]
    assert asked[7][cut["start"] : cut["end"]].split() == asked[7].split()[30:]
    assert language.identify(df, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert language.identify(df, language.learn(df.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert language.keep_accepted(df, model).columns == df.columns and language.keep_accepted(df, model).count() == 90


def numeric_gradient(network, inputs, begins, targets, key, at, step=1e-3):
    def loss():
        states, _, _ = network.forward(inputs, begins, np.zeros((inputs.shape[1], lm.HIDDEN), np.float32))
        return float(network.outputs(states.reshape(-1, lm.HIDDEN), targets.ravel(), False).sum())

    was = network.w[key][at]
    network.w[key][at] = was + step
    high = loss()
    network.w[key][at] = was - step
    low = loss()
    network.w[key][at] = was
    return (high - low) / (2 * step)


def test_backpropagation():
    vocabulary = lm.Vocabulary([(b"w%d" % k, 100 - k) for k in range(60)] + [(lm.END, 40)], short=40)
    network = lm.Network(vocabulary)
    network.w = {k: w.astype(np.float64) for k, w in network.w.items()}
    draw = np.random.default_rng(1)
    inputs, targets = draw.integers(0, vocabulary.begin, (5, 4)), draw.integers(0, vocabulary.begin, (5, 4))
    begins = np.zeros((5, 4))
    begins[0], begins[3, 1] = 1, 1
    states, _, kept = network.forward(inputs, begins, np.zeros((4, lm.HIDDEN), np.float32))
    _, back, grads = network.outputs(states.reshape(-1, lm.HIDDEN), targets.ravel(), True)
    grads |= network.backward(inputs, begins, kept, back.reshape(states.shape))
    for key, grad in grads.items():
        for at in list(zip(*np.nonzero(np.abs(grad) > 0.05), strict=True))[:6]:
            assert -grad[at] == pytest.approx(numeric_gradient(network, inputs, begins, targets, key, at), rel=0.05, abs=0.02)


def scalar_score(network, codes):
    """Natural log probability of codes, token by token."""
    w, v = {k: x.astype(float) for k, x in network.w.items()}, network.v
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, before, total = np.zeros(lm.HIDDEN), v.begin, 0.0
    for code in codes:
        z = sigmoid(w["in_z"][before] + h @ w["state_z"])
        r = sigmoid(w["in_r"][before] + h @ w["state_r"])
        c = np.tanh(w["in_c"][before] + r * (h @ w["state_c"]))
        h = z * h + (1 - z) * c
        logits = h @ w["to_class"] + w["class_bias"]
        k = v.class_of[code]
        total += logits[k] - np.log(np.exp(logits).sum())
        if k < lm.CLASSES:
            a, b = v.starts[k], v.starts[k + 1]
            logits = w["to_word"][a:b] @ h + w["word_bias"][a:b]
            total += logits[code - a] - np.log(np.exp(logits).sum())
        before = code
    return total


def test_scores_are_those_token_by_token():
    draw = np.random.default_rng(6)
    vocabulary = lm.Vocabulary([(b"w%d" % k, 300 - k) for k in range(200)] + [(lm.END, 40)], short=150)
    network = lm.Network(vocabulary)
    coded = [draw.integers(0, vocabulary.begin, n).tolist() for n in (1, 2, 700, 5, 90, 64, 65)]
    lm.Trainer(network).train(*lm.flattened(coded))
    assert lm.log_likelihoods(network, coded) == pytest.approx([scalar_score(network, c) for c in coded], rel=1e-5)
    network.w["class_bias"] += 70  # the same probabilities by logits that exp alone could not take
    assert lm.log_likelihoods(network, coded) == pytest.approx([scalar_score(network, c) for c in coded], rel=1e-4)


def test_tokens_of_one_count(spark, monkeypatch):
    """More tokens of the greatest count than are kept: scores stay what the counts say."""
    monkeypatch.setattr(lm, "KNOWN", 60)
    df = spark.createDataFrame([(i, " ".join(f"t{i}_{k}" for k in range(20))) for i in range(20)], "doc_id long, text string")
    scratch = Scratch(spark)
    model, counts = lm.learn(df, scratch, id_col="doc_id")
    assert 20 < len(model.coding.tokens) <= 100 and (model.n, model.v) == (420, 401)
    for r in lm.score_texts(df, model, counts, scratch).collect():
        assert r["n_known"] == 21 and r["base_score"] == pytest.approx(20 * math.log10(2 / 822) + math.log10(21 / 822)) and r["score"] < 0


def test_long_text_takes_memory_by_its_tokens():
    import tracemalloc

    vocabulary = lm.Vocabulary([(b"w%d" % k, 300 - k) for k in range(200)] + [(lm.END, 40)])
    network = lm.Network(vocabulary)
    codes = np.arange(60_000 + 300, dtype=np.int32) % vocabulary.begin
    bounds = np.concatenate([np.arange(300), [60_300]])
    tracemalloc.start()
    scores = lm.scores_of(network, codes, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and len(scores) == 300 and (scores < 0).all()


def test_model_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 2500)
    monkeypatch.setattr(lm, "WARM_TOKENS", 3000)
    pick = random.Random(13)
    rows = [(i, " ".join(words(pick, pick.randint(1, 60)))) for i in range(400)]
    df = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string")
    found = []
    for parts in (1, 7):
        training = F.col("doc_id") % 4 != 0
        out = lm.learn_and_score(df.repartition(parts), training, Scratch(spark), id_col="doc_id", keep=["doc_id"])
        found.append({r["doc_id"]: (r["score"], r["base_score"], r["n_tokens"]) for r in out.collect()})
    assert all(found[0][i][0] / found[0][i][2] == pytest.approx(found[1][i][0] / found[1][i][2], abs=1e-6) for i in found[0])
    assert all(found[0][i][1:] == pytest.approx(found[1][i][1:]) for i in found[0])
    assert lm.learn_and_score(df.limit(0), training, Scratch(spark), id_col="doc_id").count() == 0


def test_lm_scores(spark):
    pick = random.Random(2)
    chain = {"a": "bb", "bb": "c.", "c.": "a"}

    def text():
        w = [pick.choice("a")]
        for _ in range(40):
            w.append(chain.get(w[-1], "a") if pick.random() < 0.9 else f"r{pick.randint(0, 300)}")
        return " ".join(w)

    texts = [text() for _ in range(300)] + [None, "", "A  unSEEN\n"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    scratch = Scratch(spark)
    train = df.where("doc_id < 200")
    model, counts = lm.learn(train, scratch)
    out = {r["doc_id"]: r for r in lm.score_texts(df, model, counts, scratch, keep=["doc_id"]).collect()}
    seen = Counter(w for t in texts[:200] for w in lm.tokens(t.encode()))
    n, v = sum(seen.values()), len(seen)
    for i, t in enumerate(texts):
        own = lm.tokens((t or "").encode())
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in seen for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own))
    held = [out[i] for i in range(200, 300)]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    coded = [model.network.v.encode(lm.tokens((t or "").encode())) for t in texts]
    together, alone = lm.log_likelihoods(model.network, coded), [lm.log_likelihoods(model.network, [c])[0] for c in coded]
    assert together == pytest.approx(alone, rel=1e-3, abs=1e-3)
    nothing, none = lm.learn(train.limit(0), scratch)
    assert lm.score_texts(df.limit(3), nothing, none, scratch).count() == 3 and nothing.n == 0


@pytest.mark.parametrize("most", [url_lists.BROADCAST_ENTRIES, 0])
def test_url_lists(spark, most):
    entries = spark.sql(
        """SELECT kind, value, action, CAST(day AS TIMESTAMP) AS listed_at FROM VALUES
        ('domain', 'Bad.com', 'block', '2024-01-10'), ('domain', 'bad.com', 'remove', '2024-02-01'), ('host', 'ok.bad.com', 'allow', '2024-01-01'),
        ('prefix', 'ok.bad.com/x/y', 'block', '2024-01-20'), ('host', 'tie.com', 'allow', '2024-01-01'), ('host', 'tie.com', 'block', '2024-01-01'),
        ('host', NULL, 'block', '2024-01-01'), ('odd', 'a.com', 'block', '2024-01-01') AS t(kind, value, action, day)"""
    )
    cases = [
        ("http://bad.com/", "2024-01-09", "none"), ("http://BAD.com./a", "2024-01-10", "block"), ("https://u@w.bad.com:80/?q", "2024-01-31", "block"),
        ("http://bad.com/", "2024-02-01", "none"), ("http://ok.bad.com/x/z", "2024-01-21", "allow"), ("http://ok.bad.com/X/y/z?k#f", "2024-01-21", "block"),
        ("http://ok.bad.com/x/yy", "2024-01-21", "allow"), ("http://notbad.com/", "2024-01-15", "none"), ("http://tie.com", "2024-03-01", "block"),
        (None, "2024-01-15", "none"), ("no url", "2024-01-15", "none"), ("http://bad.com/", None, "none"), ("http://a.com", "2024-01-15", "none"),
    ]
    rows = [(i, u, d, "x") for i, (u, d, _) in enumerate(cases)]
    captures = spark.createDataFrame([*rows, rows[1]], "page_id long, url string, day string, decision string").selectExpr("*", "CAST(day AS TIMESTAMP) AS fetched_at")
    out = url_lists.filter_urls(captures, entries, broadcast_entries=most).collect()
    assert len(out) == len(cases) + 1 and all(r["decision"] == cases[r["page_id"]][2] for r in out)
    assert url_lists.filter_urls(captures, entries.limit(0)).where("decision <> 'none'").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    pick = random.Random(11)
    say = lambda n: " ".join(pick.choices(["the", "and", "with", "order", "house", "thing", "other", "never", "again", "stone"], k=n))
    item = say(14)
    texts = [say(60) for _ in range(40)]
    texts += [texts[3], texts[3] + "!", "1234 5678", None, say(20) + " " + item + " " + say(20), say(30) + ' token = "0123456789abcdef0123"']
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        left.append({r["doc_id"] for r in docs.collect()})
    every = set(range(len(texts)))
    assert left == [every - {42, 43}, every - {40, 41, 42, 43}, every - {40, 41, 42, 43, 44}, every - {40, 41, 42, 43, 44}, every - {40, 41, 42, 43, 44}]
    masked = spark.read.parquet(f"{tmp_path}/secrets").where("doc_id = 45").first()
    assert masked["text"].endswith('token = "[secret]"') and masked["n_chars"] == len(masked["text"])
    assert docs.where("NOT decodes").count() == 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == len(left[-1])
