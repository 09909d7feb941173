"""Fingerprints, cuts and vector codes: brute force, round trips and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import fill_in_middle, filtering_lloyd, piecewise_hash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, key string, n long, form string, range int, head boolean, address string, fingerprint string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 7, "f", 3, True, "a", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(60_000))
    return docs_of(spark, [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "one two three four five"), (5, "one two three four five"), (5, "another text"), (None, "no id here"), (None, None), (8, "Café 中文 😀 x\u0085y "), (9, "has <S> inside"), (10, long)])


# fill-in-middle


def test_boundaries_come_back():
    draw = random.Random(5)
    for n in (0, 1, 2, 7, 300):
        for gap in (1, 3, 40, 5000):
            values = np.cumsum([draw.randint(1, gap) for _ in range(n)], dtype=np.int64)
            code = fill_in_middle.Boundaries(fill_in_middle.Boundaries.encode(values))
            assert [code.select(k) for k in range(code.n)] == values.tolist()


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    tokens, told = TOKEN.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (doc_id, len(tokens), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


def number(x):
    return None if x is None else int(x)


def cuts(df):
    return sorted(((number(r.doc_id), r.n, r.form, number(r.prefix_chars), number(r.middle_chars), r.output) for r in fill_in_middle.fill_in_middle(df).collect()), key=repr)


def test_cuts_against_brute_force(spark, odd):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (odd, table, odd.limit(0)):
        want = sorted((plain_cut(r.doc_id, r.text) for r in df.collect()), key=repr)
        assert cuts(df) == want
        assert all(fill_in_middle.restore(w[5], w[2]) == t for w, t in ((plain_cut(r.doc_id, r.text), r.text or "") for r in df.collect()))
    assert {w[2] for w in want} | {w[2] for w in cuts(table)} == {"plain", "spm", "psm"}


def test_cuts_with_one_address_for_all_texts(spark, monkeypatch):
    """Groups are verified by their content, not by the digest that they meet by."""
    df = docs_of(spark, [(i, " ".join(f"w{j}" for j in range(3 + i % 4))) for i in range(40)])
    monkeypatch.setattr(fill_in_middle, "address", lambda: F.unhex(F.lit("00")))
    assert cuts(df) == sorted((plain_cut(r.doc_id, r.text) for r in df.collect()), key=repr)


def test_cuts_without_the_bitmap(spark, monkeypatch):
    from barline.llm import common

    monkeypatch.setattr(common, "MOST_BITS", 2)
    df = docs_of(spark, [(i, f"some words {i % 7} and more") for i in range(30)])
    assert cuts(df) == sorted((plain_cut(r.doc_id, r.text) for r in df.collect()), key=repr)


# fingerprints


def plain_fingerprint(text):
    """The definition, byte by byte."""
    data, ends = text.encode(), []
    for i in range(len(data)):
        h = sum((data[i - j] + 1) * pow(piecewise_hash.ROLL, j + 1, 1 << 32) for j in range(min(7, i + 1))) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 13
        ends.append((h & -h).bit_length() - 1 if h else 32)
    k = next((k for k in range(33) if sum(e >= k for e in ends) < 64), 33)

    def written(level):
        out, chunk = "", b""
        for i, byte in enumerate(data):
            chunk += bytes([byte])
            if ends[i] >= level or i == len(data) - 1:
                v = sum((b + 1) * pow(piecewise_hash.STEP, j, 1 << 64) for j, b in enumerate(chunk)) % (1 << 64)
                out += piecewise_hash.LETTERS[((v ^ v >> 29) * piecewise_hash.STEP % (1 << 64)) >> 58]
                chunk = b""
        return out

    return f"{1 << k}:{written(k)}:{written(k + 1)}"


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            new.append(row[j] if a == b else 1 + min(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fingerprints_against_brute_force(spark, odd, monkeypatch):
    texts = ["", "a", "Café 中文 😀", "x" * 300, "ab" * 400] + [" ".join(random.Random(n).choice(["sun", "moon", "tide"]) + str(k % n) for k in range(n)) for n in (3, 20, 90, 400)]
    for t in texts:
        assert piecewise_hash.fingerprint(t) == plain_fingerprint(t), t[:40]
    whole = [piecewise_hash.fingerprint(t) for t in texts]
    monkeypatch.setattr(piecewise_hash, "SLAB", 64)
    assert [piecewise_hash.fingerprint(t) for t in texts] == whole
    draw = random.Random(3)
    for _ in range(200):
        x, y = ("".join(draw.choice("abcd") for _ in range(draw.randrange(20))) for _ in range(2))
        assert piecewise_hash.distance(x, y) == plain_distance(x, y)


def test_next_documents_against_brute_force(spark, odd):
    for df, ranges in ((odd, 5), (odd, 1), (odd.limit(1), 3), (odd.limit(0), 3), (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), None)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
            changed = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            x, y, z = (piecewise_hash.fingerprint(v) for v in (t, changed, u))
            want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), x, y, piecewise_hash.likeness(x, y), piecewise_hash.likeness(x, z)))
        got = [(number(r.doc_id), *r[1:]) for r in piecewise_hash.fingerprints(df, ranges).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    near, far = [w[5] for w in want if w[1] > 200], [w[6] for w in want if w[1] > 200]
    print("likeness to edited, to next:", np.mean(near), np.mean(far))
    assert np.mean(near) > 0.5 > 0.1 > np.mean(far)  # half of the text stays
    assert np.mean(np.array(near) > 0.3) > 0.95


# vector codes


def plain_codes(vectors):
    """(codes, errors, books) of [vector][64] floats in the order of their ids."""
    x = np.clip(np.floor(256 * np.asarray(vectors, np.float64)), -(1 << 22), 1 << 22).astype(np.int64).reshape(len(vectors), 16, -1)
    books = x[:64].copy()

    def nearest(p):
        far = ((x[:, p, None] - books[None, :, p]) ** 2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(2):
        for p in range(16):
            own = nearest(p)[0]
            for e in range(len(books)):
                if (own == e).any():
                    books[e, p] = x[own == e, p].sum(0) // (own == e).sum()
    found = [nearest(p) for p in range(16)]
    return ["".join(f"{e[i]:02x}" for e, _ in found) for i in range(len(x))], sum(f for _, f in found).tolist(), books.transpose(1, 0, 2)


VECTORS = "vec_id long, embedding array<float>, label int, part int, entry int, n long, code string, error long"


@pytest.mark.parametrize("n, levels", [(3, 2), (63, 3), (700, 3), (5000, 40), (400, 10**9)])
def test_codes_against_brute_force(spark, n, levels):
    """Few levels make many ties; one common vector is a third of the rows."""
    draw = np.random.default_rng(n)
    x = (draw.integers(0, levels, (n, 64)) - levels // 2) / 256
    x[:: 3] = x[0]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), None if i % 5 == 0 else i % 3, 1, 1, 1, "c", 1) for i, v in enumerate(x)]
    bad = [(10**6, None, 1, 1, 1, 1, "c", 1), (-1, [0.5] * 63 + [None], 1, 1, 1, 1, "c", 1), (-2, [0.5] * 63 + [float("nan")], 1, 1, 1, 1, "c", 1), (-3, [float("-inf")] * 64, 1, 1, 1, 1, "c", 1), (10**6 + 1, [0.5] * 32, 1, 1, 1, 1, "c", 1), (10**6 + 2, [], 1, 1, 1, 1, "c", 1)]
    codes, books = filtering_lloyd.compress(spark.createDataFrame(rows + bad, VECTORS).repartition(3))
    want = plain_codes(x)
    got = sorted(((int(r.vec_id), r.code, r.error) for r in codes.collect()))
    assert got == [(i, c, e) for i, (c, e) in enumerate(zip(*want[:2], strict=True))] and (books == want[2]).all()


def test_codes_of_odd_tables(spark):
    one = [0.25, float(2**40)] * 32
    rows = [(None, one), (2, one), (2, [0.5] * 64), (1, None)]
    df = spark.createDataFrame([(i, v, None, 1, 1, 1, "c", 1) for i, v in rows], VECTORS)
    assert sorted(filtering_lloyd.compress(df)[0].select("vec_id").collect(), key=repr) == sorted([(None,), ("2",), ("2",)], key=repr)
    assert filtering_lloyd.compress(df.limit(0))[0].count() == 0
    short = spark.createDataFrame([(1, [0.5] * 15, 1, 1, 1, 1, "c", 1)], VECTORS)
    assert filtering_lloyd.compress(short)[0].count() == 0


def test_subtrees_go_to_one_entry_as_a_whole():
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.integers(-5, 5, (2000, 4)) + c for c in (-1000, 0, 1000)])
    tree = filtering_lloyd.Tree.grown(points)
    book = np.array([[-1000] * 4, [0] * 4, [1000] * 4])
    whole, places, _ = tree.filtered(book)
    assert sum(end - begin for _, begin, end, _ in whole) > 0.9 * len(points) and len(whole) < 20
    assert (tree.totals(book)[1] == 2000).all() and len(places) + sum(e - b for _, b, e, _ in whole) == len(points)
