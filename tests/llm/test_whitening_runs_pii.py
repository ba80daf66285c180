"""Whitening against a library's eigenvectors, runs and personal data against brute force, and rows that trip them."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from retentia.llm import periodic_runs, pii, whitening
from retentia.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import ODD_TEXTS, documents


# --- whitening ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 2, 3, 17, 64])
def test_spectrum_slices_equal_library(width):
    for seed in range(4):
        rows = np.random.default_rng(seed).standard_normal((2 * width, width)) * np.logspace(0, seed, width)
        matrix = np.cov(rows.T, bias=True).reshape(width, width)
        values, vectors = np.linalg.eigh(matrix)
        found = whitening.leading(matrix, 8)
        k = min(8, width)
        assert np.allclose(found.values, values[::-1][:k], rtol=1e-11)
        assert np.allclose(np.abs(np.sum(found.vectors * vectors[:, ::-1][:, :k], axis=0)), 1, atol=1e-9)


def test_counts_of_positive_pivots():
    draw = np.random.default_rng(5)
    for width in (1, 2, 5, 30):
        for _ in range(20):
            a = draw.standard_normal((width, width))
            a = a + a.T
            assert whitening.positive_pivots(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert whitening.positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and whitening.positive_pivots(np.zeros((3, 3))) == 0


def test_equal_and_missing_variances():
    found = whitening.leading(np.diag([5.0, 5.0, 5.0, 2.0, 0.0]), 8)
    assert found.values.tolist() == pytest.approx([5, 5, 5, 2]) and np.allclose(found.vectors.T @ found.vectors, np.eye(4), atol=1e-12)
    assert len(whitening.leading(np.zeros((4, 4)), 8).values) == 0


def brute_whitening(rows):
    x = np.floor(1024 * np.array(rows, np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return ((n * x - total) ** 2).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_query_equals_library(spark):
    given = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    deviation, whitened, explained = brute_whitening([r["embedding"] for r in given])
    place = {r["vec_id"]: i for i, r in enumerate(given)}
    rows = QUERIES["op11_whitening"](spark, SMALL).collect()
    assert len(rows) == 8 * len(given)
    sign = {}
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == deviation[i] and r["n"] == len(given) and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
        sign.setdefault(c, np.sign(r["whitened"] * whitened[i, c]))
        assert r["whitened"] == pytest.approx(sign[c] * whitened[i, c], rel=1e-6, abs=1e-8)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 3.0], [1.5, 1.0, 0.0], None, [nan, 1.0, 2.0], [1.0, inf, 0.0], [1.0, None, 0.0], [], [0.0, 0.0], [0.25, -7.0, 1e-9], [0.25, -7.0, 1e-9], [2.0, 2.0, 2.0]]
    given = spark.createDataFrame([(i % 9, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component string")
    used = [(i % 9, v) for i, v in enumerate(vectors) if v and len(v) == 3 and None not in v and np.isfinite(v).all()]
    deviation = brute_whitening([v for _, v in used])[0].tolist()
    rows = whitening.whiten(given).collect()
    assert sorted((r["vec_id"], int(r["deviation"])) for r in rows if r["component"] == 1) == sorted((i, d) for (i, _), d in zip(used, deviation))
    assert {r["n"] for r in rows} == {len(used)} and {r["component"] for r in rows} == {1, 2, 3}
    assert whitening.whiten(given.filter("false")).collect() == []
    assert whitening.whiten(given.filter("vec_id = 0 and embedding[0] = 1")).collect() == []  # one vector has no variance
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(far).collect()) >= 3


# --- periodic runs -----------------------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q):
                own = words[i : i + length]
                if not any(all(own[t] == own[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    draw = random.Random(7)
    for _ in range(300):
        n, k = draw.randrange(150), draw.choice([1, 2, 2, 3, 6, 30])
        words = [draw.randrange(k) for _ in range(n)]
        for _ in range(draw.randrange(3)):
            a = draw.randrange(n + 1)
            p = 1 + (n - a) // draw.randrange(3, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert [tuple(r) for r in periodic_runs.maximal_runs(np.array(words, np.int64)).tolist()] == brute_runs(words)


def expected_runs_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    lost = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in lost)),
    )


def test_runs_query_equals_brute_force(spark, tmp_path):
    phrase = " ".join(f"w{i}" for i in range(11))
    texts = [*(t for t in ODD_TEXTS if len(t or "") < 9000), "a " * 23, "a " * 24, "x " + "a b " * 12 + "a y", "\t".join([phrase] * 3), (phrase + " ") * 2 + "w0 w1", "é\x85é " * 30]
    texts += ["".join(random.Random(i).choices(["a ", "b ", "c\n"], k=90)) for i in range(60)]
    docs = documents(spark, texts)
    docs.union(docs.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect())
    assert found == sorted(expected_runs_row(i, t) for i, t in [*enumerate(texts), *list(enumerate(texts))[:5]])


def test_runs_without_id_and_without_rows(spark):
    given = spark.createDataFrame([(None, "a " * 30), (None, None)], "doc_id long, text string")
    rows = periodic_runs.periodic_runs(given, planted=True).collect()
    assert [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows] == [(30, [(0, 30, 1)], "a"), (0, [], "")]
    assert periodic_runs.periodic_runs(given.filter("false")).collect() == []


def test_runs_do_not_cross_texts():
    texts = [[b"a"] * 20, [b"a"] * 20, [], [b"a"] * 24]
    assert [r for r, _ in periodic_runs.described(texts)] == [[], [], [], [(0, 24, 1)]]


def test_long_repetition_is_quick():
    words = [f"w{i}".encode() for i in range(70_000)] * 3
    (runs, kept), = periodic_runs.described([words])
    assert runs == [(0, 210_000, 70_000)] and len(kept) == 70_000


# --- personal data -----------------------------------------------------------------------------------------------


def brute_base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_plain_patterns():
    draw = random.Random(8)
    for _ in range(20_000):
        text = "".join(draw.choices("ab.@@+-12 5_()0é", k=draw.randrange(40)))
        assert pii.base_spans(text) == brute_base(text)
    for _ in range(3_000):
        text = "".join(draw.choices("0123456789", k=draw.randrange(12, 22)))
        assert pii.base_spans(text) == brute_base(text)
    for text in ("9" * 50_000, "a." * 50_000, "1." * 50_000, "+1" + " " * 50_000, "x@" * 30_000):
        pii.base_spans(text)  # linear, whatever the text


@pytest.fixture(scope="module")
def passages():
    texts = [t for t in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist() if t and len(t) > 400]
    return [t[100:340] for t in texts]


@pytest.fixture(scope="module")
def field(passages):
    return pii.Field(pii.trained(pii.training_texts(passages[::2], 1)))


def test_field_on_held_out_texts(field, passages):
    right = given = found = 0
    for text, spans in pii.training_texts(passages[1::2], 2):
        got = set(field.segments(text))
        right, given, found = right + len(got & set(spans)), given + len(spans), found + len(got)
    assert right / given > 0.95 and right / found > 0.95


def test_field_adds_what_patterns_miss_and_leaves_clean_text(field):
    for text, kind, inside in [
        ("call (988) 555-2485 now", "phone", "(988) 555-2485"), ("write to anna [at] example [dot] com today", "email", "anna [at] example [dot] com"),
        ("pay with 4539.1488.0343.6467 then", "card", "4539.1488.0343.6467"), ("+1 (269) 555-3296 4524132264652876 end", "phone", "+1 (269) 555-3296"),
    ]:
        base, added = pii.spans_of(text, field)
        assert (inside, kind) in [(text[a:b], k) for a, b, k in added], text
        assert not any(x < b and a < y for a, b, _ in added for x, y, _ in base)
    for text in ("In 2024-05-17 the version 4.0 of 1990-1995 sold 1,234,567 times.", "see you at noon. Then home", "", "12 34 56 78 90 12 34 56 78 90 11 22"):
        assert pii.spans_of(text, field)[1] == []


def test_best_segments_equal_every_choice(field):
    draw = random.Random(4)
    for _ in range(200):
        found = sorted({(a := draw.randrange(12), a + draw.randrange(1, 5)) for _ in range(draw.randrange(9))}, key=lambda x: (x[1], x[0]))
        found = [pii.Candidate(a, b, "ip", ()) for a, b in found]
        scores = [draw.uniform(-2, 3) for _ in found]
        sets = [[k for k in range(len(found)) if mask >> k & 1] for mask in range(1 << len(found))]
        apart = [s for s in sets if all(found[i].end <= found[j].start or found[j].end <= found[i].start for i in s for j in s if i < j)]
        most = max(sum(scores[k] for k in s) for s in apart)
        chosen = pii.best_segments(found, scores)
        assert sum(scores[found.index(c)] for c in chosen) == pytest.approx(most)
        # The sum over all segmentations, and the probability of each segment.
        places = {p: i for i, p in enumerate(sorted({0, *[c.start for c in found], *[c.end for c in found]}))}
        ends, starts = (np.array([places[getattr(c, side)] for c in found], int) for side in ("end", "start"))
        chance, whole = pii.marginals(ends, starts, len(places), np.array(scores))
        total = sum(np.exp(sum(scores[k] for k in s)) for s in apart)
        assert np.exp(whole) == pytest.approx(total)
        for k in range(len(found)):
            assert chance[k] == pytest.approx(sum(np.exp(sum(scores[i] for i in s)) for s in apart if k in s) / total)


def test_personal_data_query(spark, tmp_path):
    texts = [*ODD_TEXTS, "call +1 (988) 555-2485 or mail a.b@c.de, 10.0.0.1", "4539 1488 0343 6467", "1.2.3.4.5.6.7.8", "1 2 " * 4000]
    docs = documents(spark, texts)
    docs.union(docs.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        base = brute_base(texts[r["doc_id"]] or "")
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r["spans"].split(","))
        starts = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)


def test_personal_data_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).collect() == []
    given = spark.createDataFrame([(None, None), (None, "x@y.zz")], "doc_id long, text string")
    assert [len(r["spans"]) for r in pii.personal_data(given).collect()] == [0, 1]
