"""Encoding, splitting and mixing against plain encoding and direct counts."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketloom.llm import tokens
from ticketloom.llm.mixing import mix, shares
from ticketloom.llm.splitting import split_oversized

if not os.path.exists(os.path.join(tokens.FOLDER, tokens.NAME + ".tiktoken")):
    pytest.skip("no vocabulary files", allow_module_level=True)


def plain(text):
    return tokens.encoder()._encode(text or "")


def chunked(texts):
    return [np.frombuffer(x, np.int32).tolist() for x in tokens.encoded(pa.array(texts, pa.string()), tokens.encoder())]


WORDS = ["the", " invoice", "12", "don't", "'s", "\n\n", " ", "   ", "ß", "日本", "🙂", "<|endoftext|>", "!?", "\t", "a1b2", " ", "x" * 30, "\r\n", "é", "'LL"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=60).map("".join), max_size=5))
def test_equals_plain_encoding(texts):
    assert chunked(texts) == [plain(t) for t in texts]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=80).map("".join), st.data())
def test_repaired_joins_are_exact(text, data):
    raw = text.encode()
    places = sorted(set(data.draw(st.lists(st.integers(1, max(1, len(raw) - 1)), max_size=6))))
    cuts = [p for p in places if 0 < p < len(raw) and (raw[p] & 0xC0) != 0x80]
    got = tokens.encoder().document(raw, cuts, [False] * len(cuts))
    assert np.frombuffer(got, np.int32).tolist() == plain(text)


def test_long_runs_without_a_safe_place():
    rng = random.Random(4)
    texts = ["".join(rng.choice("+/=_-") for _ in range(30_000)), "ä" * 20_000, " " * 12_000 + "x", "".join(rng.choice("ab ,é日") for _ in range(40_000))]
    assert chunked(texts) == [plain(t) for t in texts]


def test_time_grows_with_the_text():
    import time

    rng = random.Random(9)
    cjk = "".join(rng.choice("日本語文字列処理能力向上計画") + ("。" if rng.random() < 0.05 else "") for _ in range(350_000))
    cyrillic = " ".join("".join(rng.choice("абвгдежзик") for _ in range(rng.randint(2, 9))) for _ in range(80_000))
    letters = "".join(rng.choice("日本語文字列処理") for _ in range(300_000))
    plain("warm")
    for text in (cjk, cyrillic, letters, cyrillic.replace(" ", "\u00a0"), cjk.replace("。", "'s ")):
        began = time.process_time()
        want = plain(text)
        middle = time.process_time()
        assert chunked([text]) == [want]
        assert time.process_time() - middle <= 3 * (middle - began) + 0.5


def test_encode_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello world"), (4, "Hello world"), (None, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"] or -1), r["ids"]) for r in tokens.encode(df).collect())
    assert got == sorted(((i or -1), plain(t)) for i, t in rows)
    assert tokens.encode(df.limit(0)).isEmpty()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta Epsilon zeta. eta! theta? iota\n kappa\n\n Agent: lambda mu, nu 12 3.4 über".split(" ")
    rows = []
    for i in range(120):
        kind = i % 6
        body = " ".join(rng.choice(words) for _ in range(rng.choice([5, 80, 400])))
        if kind == 0:
            body = "".join(rng.choice("abcdef0123+/") for _ in range(3000))
        if kind == 1:
            body = body.replace(" ", " ").replace("\n", "\r\n")
        rows.append((i, rng.choice(["a", "b", "c", None, "unlisted"]), body))
    return rows + [(500, "a", None), (501, "b", ""), (502, "a", "  \n "), (None, "a", "one two")]


LIMITS = [("a", 60, 12), ("b", 100, 0), ("any_other", 80, 20)]


def test_pieces(spark, texts):
    df = spark.createDataFrame(texts, "doc_id bigint, source string, text string").withColumn("tokens", F.lit("x"))
    limits = spark.createDataFrame(LIMITS, "source string, max_tokens int, overlap_tokens int")
    got = split_oversized(df, limits).toPandas()
    table = {s: (m, o) for s, m, o in LIMITS}
    of = {i: (s, t) for i, s, t in texts if i is not None}
    assert set(got.doc_id.dropna()) == {i for i, (_, t) in of.items() if t}
    for i, ps in got.dropna(subset=["doc_id"]).groupby("doc_id"):
        source, text = of[int(i)]
        most, overlap = table.get(source, table["any_other"])
        ps = ps.sort_values("piece_no")
        assert list(ps.piece_no) == list(range(1, len(ps) + 1))
        at = 0  # where the next piece must begin at the latest
        begin = -1
        for no, (p, n, shared) in enumerate(zip(ps.text, ps.tokens, ps.shared_tokens)):
            assert len(plain(p)) <= most and n <= most
            found = text.find(p, begin + 1)
            while not (found <= at < found + len(p) or (found == at)):
                found = text.find(p, found + 1)
                assert found >= 0
            assert shared <= overlap
            if no:
                assert len(plain(text[found:at])) == shared
            begin, at = found, found + len(p)
        assert at == len(text)
        if len(plain(text)) <= most:
            assert len(ps) == 1
    assert split_oversized(df.limit(0), limits).isEmpty()
    assert split_oversized(df, limits.limit(0)).count() == len(set(of) - {500, 501}) + 1


def test_natural_boundaries_come_first(spark):
    text = "First paragraph here.\n\nSecond one is here too. And more words follow it now.\n\nThird."
    limits = spark.createDataFrame([("any_other", 12, 0)], "source string, max_tokens int, overlap_tokens int")
    got = split_oversized(spark.createDataFrame([(1, None, text)], "doc_id bigint, source string, text string"), limits).orderBy("piece_no").toPandas()
    assert "".join(got.text) == text and not (got.ends_at == "hard").any()
    assert set(got.ends_at) <= {"paragraph", "sentence", "end"}


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 8 + ["small", None, "other"]), " word" * rng.randint(1, 40)) for i in range(600)] + [(900, "big", None), (901, "small", ""), (None, "big", " x")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("uses", F.lit(3))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 4), ("missing", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    uses = mix(df, targets)
    got = uses.toPandas()
    assert set(got.source) == {"big", "small"} and (got.tokens > 0).all()
    cap = got.source.map({"big": 1, "small": 4})
    assert (got.uses <= cap).all() and got.doc_id.is_unique
    total = (got.uses * got.tokens).sum()
    share = {s: (g.uses * g.tokens).sum() / total for s, g in got.groupby("source")}
    assert share["big"] == pytest.approx(0.5 / 0.9, abs=0.03)
    spread = got.groupby("source").uses.agg(["min", "max"])
    assert (spread["max"] - spread["min"] <= 1).all()
    report = shares(uses, targets).toPandas().set_index("source")
    assert report.loc["missing", "actual_share"] == 0 and report.actual_share.sum() == pytest.approx(1)
    again = mix(df.repartition(5), targets).toPandas()
    assert dict(zip(got.doc_id.fillna(-1), got.uses)) == dict(zip(again.doc_id.fillna(-1), again.uses))
    much = mix(df, targets, total_tokens=10**9).toPandas()
    assert (much.uses == much.source.map({"big": 1, "small": 4})).all()
    assert mix(df.limit(0), targets).isEmpty() and mix(df, targets.limit(0)).isEmpty()
