"""Operators 11 to 13 against brute force, and their defined results for nulls, empties, repeats and ties."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations, packing, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, words string, `a` long, phrase string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and blank texts, very long ones, a repeated row, ties, and columns with clashing names."""
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)] + ["Éa", "ﬁ", "don't", "X", "x"]
    marks = ["", "", "", "", ",", ".", "\n", "\r\n", "; ", "\t", "  "]
    texts = [" ".join(rng.choice(vocab) + rng.choice(marks) for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    texts += [None, "", "  \n", "...", "one", "a a a a a a a a a a a a a", "New York City. " * 40, "new york! " * 15, "Tie one, tie two, " * 12]
    texts.append(" ".join(rng.choice(vocab) for _ in range(60_000)))  # one piece over many runs
    rows = [(k, t, ("en", "de", None, "und")[k % 4], "x", 1, "y") for k, t in enumerate(texts)]
    rows.append((None, " ".join(rng.choice(vocab) for _ in range(400_000)), "en", "x", 1, "y"))
    return spark.createDataFrame([*rows, rows[3]], DOCS)


# --- collocations -----------------------------------------------------------------------------------


def brute_collocations(rows, least=10, inside=50, top=2000):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        longer = {}
        for p, c in f.items():
            if len(p) == 3 and c >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer.get(q, 0), c)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (p in longer and 100 * longer[p] >= inside * a):
                cuts = [(int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_collocations_against_counting(spark, docs):
    rows = [(r.text, r.lang) for r in docs.collect()]
    want = brute_collocations(rows)
    assert len(want) > 300 and any(p == "new york city" for _, _, p, *_ in want) and any(p == "a a a" for _, _, p, *_ in want)
    assert rows_of(collocations.collocations(docs)) == want
    assert rows_of(collocations.collocations(docs, top=7)) == brute_collocations(rows, top=7)
    assert rows_of(collocations.collocations(docs.where("doc_id < 20"), least=3, inside=80)) == brute_collocations([(r.text, r.lang) for r in docs.where("doc_id < 20").collect()], 3, 80)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.OP12_SQL})").fetchall())
    assert want and rows_of(collocations.op12_collocations(spark, SF)) == want


def test_words_of_one_id_are_told_apart(monkeypatch):
    """Words that share an id get rows of their own; phrases that share a leading number are counted apart."""
    monkeypatch.setattr(collocations, "mix", lambda x: x & np.uint64(7))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": ["one two three four five six seven eight nine ten one", "one"]})
    got = Counter()
    for b in collocations._word_rows(iter([batch]), collocations._alphabet(0)):
        for r in b.to_pylist():
            got[r["lang"], r["word"]] += r["c"]
    assert got == Counter({("en", w): 1 for w in "two three four five six seven eight nine ten".split()} | {("en", "one"): 2, ("de", "one"): 1})
    key = [np.array(x, np.uint64) for x in ([5, 5, 5, 5, 2], [1, 2, 1, 2, 1], [0, 0, 0, 0, 9])]
    runs, counts = collocations.run_lengths(key, np.array([1, 10, 100, 1000, 7]))
    assert [tuple(map(int, k)) for k in zip(*runs, strict=True)] == [(2, 1, 9), (5, 1, 0), (5, 2, 0)] and counts.tolist() == [7, 101, 1010]


def test_other_alphabets_give_the_same_words():
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["Ab aB AB ab äb Äb zZ [{ {["]})
    for seed in range(3):
        (found,) = collocations._word_rows(iter([batch]), collocations._alphabet(seed))
        assert dict(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True)) == {"ab": 4, "äb": 1, "Äb": 1, "zz": 1, "[{": 1, "{[": 1}
        assert len(set(found["id"].to_pylist())) == 6


def test_keys_unpack_to_their_ids():
    rng = np.random.default_rng(0)
    for n in (2, 3):
        ids = [rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(n)]
        assert all((a == b).all() for a, b in zip(collocations.unpacked(collocations.packed(ids)), ids, strict=True))


# --- whitening ---------------------------------------------------------------------------------------


def check_whitening(got, vectors, components=4):
    """Rows of whitened() by id against numpy on the kept vectors (id to whole numbers)."""
    x = np.array(list(vectors.values()), dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = (centred**2).sum() / n
    want = ((n * x - sums) / n).astype(float) @ axes / np.sqrt(values)
    own = np.array([[got[i, c].whitened for c in range(1, components + 1)] for i in vectors])
    assert np.allclose(own * np.sign((own * want).sum(0)), want, atol=1e-8)
    for k, i in enumerate(vectors):
        for c in range(1, components + 1):
            r = got[i, c]
            assert r.n == n and r.deviation == sum(int(v) ** 2 for v in n * x[k] - sums) and r.identity_error < 1e-9
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] + rng.normal(size=6) * 10
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(base.astype(np.float32).astype(float))]
    rows += [(900 + k, rows[k][1], "x", 1) for k in range(5)]  # copies count once in the fit
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [1.0, 2.0]), (1005, [])]
    df = spark.createDataFrame([*rows, *((i, v, "x", 1) for i, v in odd)], "vec_id long, embedding array<float>, whitened string, n long")
    got = {(r.vec_id, r.component): r for r in whitening.whitened(df.repartition(40)).collect()}
    vectors = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v, *_ in rows}
    assert len(got) == 4 * len(rows)
    check_whitening(got, vectors)


def test_summaries_merge_without_loss():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 5)) * 100).astype(np.int64)
    x[:, 3] = x[:, 2]  # not of full rank
    for cuts in ([], [1, 2, 3, 400], range(1, 500), [3, 250]):
        held = None
        for part in np.split(x, list(cuts)):
            own = whitening.Summary.of(part)
            held = own if held is None else held.merged(own)
        centred = x - x.mean(0)
        assert held.n == 500 and held.sums == x.sum(0).tolist()
        assert np.allclose(held.vectors.T @ np.diag(held.values**2) @ held.vectors, centred.T @ centred)
        assert np.allclose(held.vectors @ held.vectors.T, np.eye(5), atol=1e-12)


def test_whitening_of_few_and_large_and_no_vectors(spark):
    kind = "vec_id string, embedding array<double>"
    one = whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id or "", r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == sorted(
        (i, c, 1, 0, None, 0.0, 0.0) for i in ("", "a", "b") for c in (1, 2)
    )
    two = whitening.whitened(spark.createDataFrame([("a", [0.0, 0.0, 1.0]), ("b", [2.0, 0.0, 1.0])], kind)).collect()
    assert {(r.component, round(r.explained, 9), r.whitened is None) for r in two} == {(1, 1.0, False), (2, 0.0, True), (3, 0.0, True)}
    assert {abs(round(r.whitened, 9)) for r in two if r.component == 1} == {1.0}
    large = whitening.whitened(spark.createDataFrame([("a", [1e12]), ("b", [2e12]), ("c", [-3e12]), ("d", [5.0])], kind)).collect()
    assert {r.vec_id: r.deviation for r in large}["a"] is None and {r.n for r in large} == {4} and large[0].identity_error < 1e-9
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([("a", None), ("b", [])], kind)).count() == 0


# --- packing -----------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity=packing.CAPACITY):
    """Rows of packed() against the tokenizers library; texts: (id, text) of each document. Gives the number of sequences."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        marks = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]
    none = lambda r: tuple((x is None, x) if x is None else (False, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=lambda r: str(none(r))) == sorted(want, key=lambda r: str(none(r)))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_equals_the_library_and_is_tight(spark, docs):
    extra = [(5000, "<|endoftext|> and <|endoftext|>", "en", "x", 1, "y"), (5001, "   a b  c\t\td 12 3's 🙂", "en", "x", 1, "y"), (5001, "twice", "en", "x", 1, "y"), (5001, "twice", "en", "x", 1, "y")]
    extra += [(6000 + k, "a" * k, "en", "x", 1, "y") for k in range(40)]
    df = docs.where("doc_id IS NOT NULL").union(spark.createDataFrame(extra, DOCS)).union(spark.createDataFrame([(None, "no id", None, "x", 1, "y")] * 2, DOCS))
    rows = packing.packed(df).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in df.collect()])
    assert used == -(-sum(r.length for r in rows) // packing.CAPACITY)
    small = packing.packed(df, capacity=64).collect()
    assert check_packing(small, [(r.doc_id, r.text) for r in df.collect()], 64) <= 1.001 * sum(r.length for r in small) / 64 + 1
    assert packing.packed(df.limit(0)).count() == 0


def test_packing_of_a_table_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 25)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.packed(docs).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= sum(r.length for r in rows) / packing.CAPACITY + len(rows) / 25 + 1  # at most one sequence lost in each block
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.packed(docs).collect()))


def test_offspring_are_packings_and_beat_best_fit():
    """Triples that fill a sequence exactly, where best fit of falling lengths wastes room."""
    rng = np.random.default_rng(7)
    capacity, triples = 1000, []
    for _ in range(30):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (capacity - a) // 2))
        triples += [a, b, capacity - a - b]
    lengths = rng.permutation(np.array(triples))
    none = np.full(len(lengths), -1)
    first = packing.best_fit(lengths, none, np.argsort(-lengths, kind="stable"), capacity)
    population = [first, *(packing._placed(lengths, none, capacity, packing._rng(k)) for k in range(5))]
    for k, p in enumerate(population):
        child = packing.crossover(lengths, p, population[k - 1], capacity, packing._rng(k))
        for bins in (p, child, packing.mutated(lengths, child, capacity, packing._rng(k))):
            assert bins.min() == 0 and set(bins) == set(range(bins.max() + 1)) and np.bincount(bins, lengths).max() <= capacity
    best = packing.evolved(lengths, population, capacity, 400, packing._rng(1))[0]
    assert packing.worth(lengths, best) < packing.worth(lengths, first) and packing.worth(lengths, best)[0] < packing.worth(lengths, first)[0]


def test_crossover_keeps_well_filled_sequences():
    lengths = np.array([600, 400, 700, 300, 500, 200])
    a, b = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 2, 2])
    b = packing.best_fit(lengths, np.full(6, -1), np.arange(6), 1000)
    seen = set()
    for k in range(20):
        child = packing.crossover(lengths, a, b, 1000, packing._rng(k))
        seen.add((child[0] == child[1], child[2] == child[3]))
    assert (True, True) in seen


def test_cuts():
    assert [packing.cuts(n, 10) for n in (1, 10, 11, 20, 25)] == [[0, 1], [0, 10], [0, 1, 11], [0, 10, 20], [0, 5, 15, 25]]


def test_collocation_keys_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    held = [[rng.integers(0, 1 << 20, collocations.KEYS // 4).astype(np.uint64) for _ in range(3)] for _ in range(4)]
    tracemalloc.start()
    found = collocations._key_rows(held, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == [] and sum(found["c"].to_pylist()) == collocations.KEYS
    assert most < 150 << 20
