"""Packing, spelling variants and the prefix trie against plain Python over the same rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from jobtide.llm import packing, prefixes, variants
from jobtide.llm.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def public():
    found = Tokenizer.from_file(VOCABULARY)
    found.encode_special_tokens = True
    return found


def check_pieces(rows, texts, public, window):
    """rows: (doc, start, length, crc32, doc_tokens, sequence, offset)."""
    ids = {doc: [*public.encode(text or "", add_special_tokens=False).ids, 0] for doc, text in texts.items()}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset in rows:
        assert tokens == len(ids[doc]) and length > 0
        assert crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
        of_doc[doc].append((start, length))
        of_sequence[sequence].append((offset, length))
    assert set(of_doc) == set(texts)
    for doc, pieces in of_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[doc])
    padding = 0
    for pieces in of_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, ids


def test_packing_of_a_table(spark, public):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [tuple(r) for r in QUERIES["op11_packing"](spark, SF_DIR).collect()]
    padding, ids = check_pieces(rows, texts, public, 1024)
    assert padding == 0
    # whole windows of long documents, rests that need no cut, and few that do
    assert len(rows) <= sum(-(-len(x) // 1024) for x in ids.values()) + len({r[5] for r in rows})


@pytest.mark.parametrize("window", [8, 64])
def test_packing_of_odd_texts(spark, public, window):
    draw = random.Random(window)
    odd = [None, "", " ", "a", "<|endoftext|> x", "é" * 90, "x " * 500, "same text here", "same text here", *(" ".join("abcdefgh"[: draw.randrange(9)] for _ in range(draw.randrange(40))) for _ in range(300))]
    rows = [(i, t, "q", 5) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, `K0` int").repartition(5)
    found = packing.pack(df, VOCABULARY, window, scratch=None)
    assert found.columns == ["doc_id", "text", "K0", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert {r["K0"] for r in found.collect()} == {5}
    padding, _ = check_pieces([tuple(r) for r in packing.digest(found).collect()], dict(enumerate(odd)), public, window)
    assert padding == 0
    assert packing.pack(df.limit(0), VOCABULARY, window).count() == 0


def test_ranks_of_the_file():
    from jobtide.llm.byte_bpe import read_ranks

    assert packing.read_ranks(VOCABULARY) == read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_combinations_fill_the_window():
    there = np.array([1, 2, 3, 5, 8, 13])
    parts, times = packing.combinations(there, 16)
    assert ((parts * times).sum(1) == 16).all()
    want = set()
    for a in there.tolist():
        want |= {tuple(sorted(Counter({a: k, 16 - k * a: 1}).items())) for k in range(1, 16 // a + 1) if 16 - k * a in there and 16 - k * a != a}
        if 16 % a == 0:
            want.add(((a, 16 // a),))
        want |= {tuple((n, 1) for n in (a, b, 16 - a - b)) for b in there.tolist() if a < b < 16 - a - b and 16 - a - b in there}
    assert {tuple(sorted((p, t) for p, t in zip(ps, ts, strict=True) if t)) for ps, ts in zip(parts.tolist(), times.tolist(), strict=True)} == want
    assert len(packing.combinations(there, 16, 2)[0]) < len(parts)


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_is_optimal(seed):
    """At the solution no column lowers the distance, and none that is used would by being used less (Kuhn and Tucker)."""
    draw = np.random.default_rng(seed)
    lengths = np.flatnonzero(draw.random(41) < 0.6)[1:]
    parts, times = packing.combinations(lengths[lengths < 40], 40)
    wanted = np.zeros(41)
    wanted[lengths[lengths < 40]] = draw.integers(0, 1000, (lengths < 40).sum())
    x = packing.least_squares(parts, times, wanted, 1e-6)
    matrix = np.zeros((41, len(parts)))
    for j in range(len(parts)):
        np.add.at(matrix[:, j], parts[j], times[j])
    gain = matrix.T @ (wanted - matrix @ x)
    assert (x >= 0).all() and (gain <= 1e-3).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-3


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_what_is_there(seed):
    draw = random.Random(seed)
    histogram = {draw.randrange(1, 1024): draw.randrange(1, 5000) for _ in range(draw.choice([1, 5, 60, 900]))}
    patterns, line = packing.plan(histogram, 1024)
    used = Counter(line)
    for n, taken in patterns:
        assert n > 0 and sum(length * k for length, k in taken) == 1024
        used.update({length: n * k for length, k in taken})
    assert used == Counter(histogram)


@pytest.mark.parametrize("seed", range(3))
def test_plan_finds_what_fits(seed):
    """Lengths that came of cutting windows in two or three fit again but for a few."""
    draw = random.Random(seed)
    histogram = Counter()
    for _ in range(400):
        cuts = sorted(draw.sample(range(1, 1024), draw.choice([1, 2])))
        n = draw.randrange(1, 3000)
        for a, b in zip([0, *cuts], [*cuts, 1024], strict=True):
            histogram[b - a] += n
    _, line = packing.plan(histogram, 1024)
    assert sum(line.values()) < 0.02 * sum(histogram.values())


def test_line_end():
    assert packing.line_end(2048, 1024) == [2048] and packing.line_end(1024 + 13, 1024) == [1024, 1032, 1036, 1037]


def plain_variants(documents):
    counts = Counter()
    for doc, text in documents:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]

    out = {}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w, n in words.items():
        others = [o for k in (-1, 0, 1) for o in by_length[len(w) + k] if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(others), words[form] if form else None]
    for w, told in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        told[1] = root
    return {w: tuple(x) for w, x in out.items()}


def test_variants_of_a_table(spark):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = QUERIES["op12_variants"](spark, SF_DIR).collect()
    assert {r["word"]: tuple(r)[1:] for r in rows} == plain_variants(documents) and len({r["word"] for r in rows}) == len(rows)
    assert any(r["form"] for r in rows)


@pytest.mark.parametrize("group", [1, 256])
def test_variants_of_odd_texts(spark, monkeypatch, group):
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "HELD_WORDS", 50)
    monkeypatch.setattr(variants, "READ_BYTES", 64)
    draw = random.Random(7)
    made = ["".join(draw.choice("abü÷ß") for _ in range(draw.randrange(1, 8))) for _ in range(600)]
    texts = [None, "", "ŁÓDŹ×× ŁódŹ łódź", "x" * 5000, "Étoile ÉTOILE étoile étoilé étoilés étoilés " * 4, "日本 straße strasse straße strase " * 5]
    texts += [" ".join(draw.choice(made) for _ in range(400)) for _ in range(60)] + [" ".join(w + "abcde" for w in draw.choices(made, k=300)) for _ in range(20)]
    rows = [(None if i == 9 else i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int").repartition(3)
    found = variants.variants(df).collect()
    assert {r["word"]: tuple(r)[1:] for r in found} == plain_variants([r[:2] for r in rows])
    assert variants.variants(df.limit(0)).count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    told = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        told[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = 0 if children[node] else 1
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for child in children[node]:
            leaves += out[child][5]
            saved += out[child][6]
        ends = ",".join(map(str, sorted(c for c in members[node] if len(told[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), up, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def test_trie_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, SF_DIR).collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("light,few", [(4, 1000), (12, 0), (50_000, 1000)])
def test_trie_of_odd_conversations(spark, monkeypatch, light, few):
    """Copies in a third of all conversations, shared heads, gaps in ids, repeated and null turns, and a long conversation."""
    monkeypatch.setattr(prefixes, "FEW_HEAVY", few)
    monkeypatch.setattr(prefixes, "ID_RANGE", 7)
    monkeypatch.setattr(prefixes, "STEP", 3)
    draw = random.Random(3)
    rows = []
    for c in draw.sample(range(-20, 400), 260):
        if c % 3 == 0:
            turns = [(k, "user" if k % 2 == 0 else "assistant", f"copy {k}") for k in range(4)]
        else:
            turns = [(draw.choice([k, k, k, None]), draw.choice(["user", None]), draw.choice(["a", "b", "é", None, ""])) for k in range(draw.randrange(1, 12))]
        rows += [(c, *t) for t in turns]
    rows += [(1000, k, "user", f"t{k % 7}") for k in range(300)] + [(1001, 0, "user", "x"), (None, 0, "user", "lost")] + rows[:5]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(4)
    found = prefixes.prefix_trie(df, light)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(rows)
    assert prefixes.prefix_trie(df.limit(0), light).count() == 0


def test_louds_of_a_forest():
    # two trees: 0(2, 3), 1; 2(4)
    parents = np.array([-1, -1, 0, 0, 2])
    bits = prefixes.louds(parents)
    assert "".join(map(str, bits)) == "110" + "110" + "0" + "10" + "0" + "0"
    assert (prefixes.louds_parents(bits) == parents).all()
    assert prefixes.louds(np.zeros(0, int)).tolist() == [0]
