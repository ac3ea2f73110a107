"""Near-duplicate groups and cross-split overlaps against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from ticketloom.llm import overlap, setjoin
from ticketloom.llm.overlap import cross_split_pairs, shared_parts
from ticketloom.llm.setjoin import near_groups

WORD = regex.compile(r"[\p{L}\p{N}]+")


def brute_pairs(rows, t):
    sets = {i: frozenset(WORD.findall(x or "")) for i, x in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        u = sets[a] | sets[b]
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(u) - 1e-9:
            yield a, b


def brute_groups(rows, t):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows, t):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for i in parent:
        groups.setdefault(root(i), []).append(i)
    return {(i, min(m)) for m in groups.values() if len(m) > 1 for i in m}


def corpus(n, seed, common=30, length=(1, 40)):
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(w) // 5))):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = [f"n{rng.randrange(400)}"]
            if rng.random() < 0.3:
                rng.shuffle(w)
        else:
            w = [f"c{rng.randrange(common)}" if rng.random() < 0.6 else f"n{rng.randrange(400)}" for _ in range(rng.randint(*length))]
        texts.append(w)
        rows.append((i, rng.choice([" ", ", ", " - "]).join(w)))
    return rows


@pytest.mark.parametrize("t,seed", [(0.7, 1), (0.5, 2), (0.8, 3), (1.0, 4)])
def test_groups_equal_brute_force(spark, t, seed):
    rows = corpus(300, seed)
    df = spark.createDataFrame(rows, "record_id bigint, text_clean string")
    assert {tuple(r) for r in near_groups(df, threshold=t).collect()} == brute_groups(rows, t)


class Shared:
    def __init__(self, value):
        self.value = value


def in_process(rows, t):
    """The links of setjoin.near_links by its kernels in this process, where constants can be changed."""
    sets = {}
    for i, text in rows:
        w = frozenset(WORD.findall(text))
        if w:
            sets.setdefault(w, []).append(i)
    keys = list(sets)
    code = {w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) for k in keys for w in k}
    lists = [sorted(code[w] for w in k) for k in keys]
    mask = (1 << setjoin.SKETCH_BITS) - 1
    counts = np.bincount([v & mask for x in lists for v in x], minlength=mask + 1)
    sketch = np.where(counts > 1, np.minimum(255, np.round(8 * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8).tobytes()

    def candidates(role):
        b = pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(np.zeros(len(keys), np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(role)], names=["h1", "h2", "t", "role"])
        emitted = pa.Table.from_batches(list(setjoin._emitter(Shared(sketch), t)(iter([b])))).sort_by("g").combine_chunks()
        out = {}
        for r in setjoin._pairer(t, bool(role.any()), True)(iter(emitted.to_batches(max_chunksize=97))):
            for a, b_, star in zip(r["a1"].to_pylist(), r["b1"].to_pylist(), r["star"].to_pylist()):
                out[(a, b_)] = max(star, out.get((a, b_), 0))
        return out

    def near(a, b):
        return len(keys[a] & keys[b]) >= t * len(keys[a] | keys[b]) - 1e-9

    found = candidates(np.zeros(len(keys), np.int32))
    links = {p for p in found if near(*p)}
    failed = {x for p, star in found.items() if star and not near(*p) for x in p}
    if failed:
        links |= {p for p in candidates(np.array([3 if k in failed else 2 for k in range(len(keys))], np.int32)) if near(*p)}
    merged = [(i, keys[k]) for k in range(len(keys)) for i in sets[keys[k]]]
    parent = {k: k for k in range(len(keys))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for k in range(len(keys)):
        groups.setdefault(root(k), []).extend(sets[keys[k]])
    assert len(merged) == sum(map(len, groups.values()))
    return {(i, min(m)) for m in groups.values() if len(m) > 1 for i in m}, bool(failed), len(links)


@pytest.mark.parametrize("small,hot,dense", [(3, 1 << 17, 10**6), (3, 8, 10**6), (2, 1 << 17, 2), (4, 20, 6)])
def test_hot_words_large_and_dense_groups(monkeypatch, small, hot, dense):
    monkeypatch.setattr(setjoin, "SKETCH_BITS", 14)
    monkeypatch.setattr(setjoin, "SMALL_GROUP", small)
    monkeypatch.setattr(setjoin, "HOT_WORD", hot)
    monkeypatch.setattr(setjoin, "DENSE", dense)
    rng = random.Random(dense)
    base = [f"b{k}" for k in range(20)]
    rows = [(i, " ".join(w for w in base if rng.random() > 0.12) + f" u{rng.randrange(50)} v{rng.randrange(50)}") for i in range(150)]
    rows += [(1000 + i, t) for i, t in corpus(250, 21, common=12, length=(3, 30))]
    got, again, links = in_process(rows, 0.7)
    assert got == brute_groups(rows, 0.7)
    if dense < 10:
        assert again and links < len(list(brute_pairs(rows, 0.7)))


def test_links_of_dense_groups_stay_links(monkeypatch):
    """A link to one set of a dense run is flagged as such though a smaller run of the group has the same pair."""
    monkeypatch.setattr(setjoin, "SKETCH_BITS", 14)
    monkeypatch.setattr(setjoin, "SMALL_GROUP", 3)
    monkeypatch.setattr(setjoin, "DENSE", 6)
    plain, links, flags = setjoin._dense, [], []

    def dense(x, run, t, only):
        got = plain(x, run, t, only)
        links.extend((x, int(min(a, b)), int(max(a, b))) for i, j in (got[0] if got else []) for a, b in zip(i, j))
        return got

    def group_pairs(x, *args):
        i, j, star = pairs(x, *args)
        flags.extend((x, a, b) for a, b, s in zip(i.tolist(), j.tolist(), star) if s)
        return i, j, star

    pairs = setjoin.group_pairs
    monkeypatch.setattr(setjoin, "_dense", dense)
    monkeypatch.setattr(setjoin, "group_pairs", group_pairs)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(20)]
    rows = [(i, " ".join(w for w in base if rng.random() > 0.15)) for i in range(150)]
    assert in_process(rows, 0.7)[0] == brute_groups(rows, 0.7)
    assert links and set(links) == set(flags)


def test_edge_rows_and_clashing_columns(spark):
    long_text = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " !? "), (4, "one two three four"), (4, "one two three four"), (5, "one two three four"), (6, "four three two one"), (None, "one two three four"), (7, long_text), (8, long_text + " x"), (9, "alone")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "record_id bigint, text_clean string, t string, h1 int, group_id int")
    assert {tuple(r) for r in near_groups(df).collect()} == {(4, 4), (5, 4), (6, 4), (7, 7), (8, 7)}
    empty = near_groups(df.limit(0))
    assert empty.columns == ["record_id", "group_id"] and empty.isEmpty()


def split_brute(rows, splits, t):
    of = {}
    for k, s in splits:
        of.setdefault(k, set()).add(s)
    out = set()
    key = {i: k for i, k, _ in rows}
    for a, b in brute_pairs([(i, x) for i, _, x in rows], t):
        sa, sb = of.get(key[a], set()), of.get(key[b], set())
        if ("training" in sa and sb & {"validation", "holdout"}) or ("training" in sb and sa & {"validation", "holdout"}):
            out.add((a, b))
    return out


def chunk_parts(a, b):
    """The part of either text's words in chunks of the other, one text at a time."""

    def chunks(text):
        w = np.array([HASH[x] for x in WORD.findall(text)], np.int64)
        d, begin, size = overlap.cut(w, np.array([0]))
        return list(zip(d.tolist(), size.tolist())), len(w)

    (x, n), (y, m) = chunks(a), chunks(b)
    return sum(s for d, s in x if d in {e for e, _ in y}) / n, sum(s for d, s in y if d in {e for e, _ in x}) / m


HASH = {}


@pytest.mark.parametrize("seed,length", [(1, (1, 24)), (2, (20, 90))])
def test_overlaps_equal_brute_force(spark, seed, length):
    base = corpus(260, seed, length=length)
    rng = random.Random(seed)
    rows = [(i, i + 1000, t) for i, t in base]
    splits = [(i + 1000, rng.choice(["training", "training", "validation", "holdout"])) for i, _ in base if rng.random() < 0.95]
    splits += splits[:20]
    got = cross_split_pairs(spark.createDataFrame(rows, "record_id bigint, source_row_id bigint, text_clean string"), spark.createDataFrame(splits, "source_row_id bigint, split string"))
    pairs = [(r[0], r[1]) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == split_brute(rows, splits, 0.7)
    text = dict(base)
    all_words = sorted({w for x in text.values() for w in WORD.findall(x)})
    HASH.update({r[0]: r[1] for r in spark.createDataFrame([(w,) for w in all_words], "w string").selectExpr("w", "xxhash64(w)").collect()})
    for r in got.collect():
        assert (r["overlap_a"], r["overlap_b"]) == pytest.approx(chunk_parts(text[r[0]], text[r[1]]))


def test_overlaps_of_variants_lose_no_pair(spark):
    """Long variants of one template whose edits are rarer than all that they share."""
    rng = random.Random(36)
    rows = []
    for i in range(420):
        w = [f"b{k}" for k in range(36)]
        for k in rng.sample(range(36), 3):
            w[k] = f"e{rng.randrange(300)}"
        rows.append((i, i, " ".join(w)))
    splits = [(i, "training" if i % 2 else "holdout") for i, _, _ in rows]
    got = cross_split_pairs(spark.createDataFrame(rows, "record_id bigint, source_row_id bigint, text_clean string"), spark.createDataFrame(splits, "source_row_id bigint, split string")).collect()
    assert {(r[0], r[1]) for r in got} == split_brute(rows, splits, 0.7)
    assert len(got) == len({(r[0], r[1]) for r in got}) and all(0 <= r[x] <= 1 for r in got for x in ("overlap_a", "overlap_b"))


def test_parts_of_equal_moved_and_other_sequences():
    rng = np.random.default_rng(5)
    w = rng.integers(-(2**62), 2**62, 60)
    rows = [(w, w), (w, np.concatenate([w[30:], w[:30]])), (w, rng.integers(-(2**62), 2**62, 40)), (w[:1], w[:1]), (w, np.concatenate([w, w]))]
    a, b = (pa.array([r[k].tolist() for r in rows], pa.list_(pa.int64())) for k in (0, 1))
    x, y = shared_parts(a, b)
    assert x[0] == y[0] == 1 and x[1] > 0.85 and y[1] > 0.85 and x[2] == y[2] == 0 and x[3] == y[3] == 1 and x[4] > 0.9 and y[4] > 0.9


def test_an_edit_changes_only_chunks_around_it():
    rng = np.random.default_rng(7)
    w = rng.integers(-(2**62), 2**62, 200)
    edited = np.concatenate([w[:100], rng.integers(-(2**62), 2**62, 1), w[100:]])
    before, after = (set(overlap.cut(x, np.array([0]))[0].tolist()) for x in (w, edited))
    assert len(before - after) <= 2 and len(before) > 40


def test_overlaps_of_edge_rows(spark):
    schema = "record_id bigint, source_row_id bigint, text_clean string, role string"
    rows = [(1, 1, "a b c d", None), (2, 2, "a b c d", None), (3, 3, "a b c d", None), (4, None, "a b c d", None), (5, 5, None, None), (6, 6, "", None), (None, 2, "a b c d", None), (7, 7, "a b c d e", None)]
    splits = spark.createDataFrame([(1, "training"), (2, "holdout"), (2, "holdout"), (3, None), (5, "holdout"), (6, "holdout"), (7, "validation"), (None, "training")], "source_row_id bigint, split string")
    df = spark.createDataFrame(rows, schema)
    assert {(r[0], r[1]) for r in cross_split_pairs(df, splits).collect()} == {(1, 2), (1, 7)}
    assert cross_split_pairs(df.limit(0), splits).isEmpty() and cross_split_pairs(df, splits.limit(0)).isEmpty()
