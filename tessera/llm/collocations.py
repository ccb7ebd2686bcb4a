"""Operator 12: mining of phrases whose words stand together more often than chance.

Words get 64-bit ids from a dictionary that Spark builds of all words by language, and ids are checked to be
unique there. Words under the least count break their piece, as no phrase of them can be frequent. What is left is
packed into keys of fixed width, one 64-bit number a word. The leading number mixes all ids of the phrase
reversibly, so that ranges of equal width hold like numbers of keys, whatever word they begin with. Tasks sort and
count what they have read, keys move to their range, Spark sorts each range by the leading number (a radix sort)
and runs of equal keys are counted. Triples are only packed where both of their pairs are frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import mix, pieces_at, prefix_sums, row_slices, shuffle_partitions, text_buffers
from tessera.session import delete, stored, table

#: Bits of the two bitmaps that the reading tasks hold (of frequent words and pairs): 16 MB each, whatever the input.
#: What passes them by chance is counted like the rest and falls short of the least count.
BITS = 1 << 27
#: Keys that a task holds before it sorts and counts them.
KEYS = 1 << 20
#: A language's phrases are ranked in so many shares before they are ranked together.
SHARES = 256
#: Attempts to find ids without a clash; one fails with a probability of about (words of the corpus) * (frequent words) / 2^64.
ATTEMPTS = 8
NO_LANGUAGE = "und"

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
BETWEEN = BREAK.copy()
BETWEEN[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _alphabet(seed: int) -> np.ndarray:
    """Folds A-Z and permutes the bytes that are left; none becomes a capital, which ``prefix_sums`` folds itself."""
    if seed == 0:
        return _FOLD
    left = np.array([b for b in range(256) if not 65 <= b < 91], np.uint8)
    to = np.arange(256, dtype=np.uint8)
    to[left] = np.random.Generator(np.random.PCG64(seed)).permutation(left)
    return to[_FOLD]


# --- words of a batch ------------------------------------------------------------------------------


class _Run:
    """Words of some neighbouring texts: ids, the number of the piece each stands in, and where it stands."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, keys: np.ndarray, alphabet: np.ndarray):
        self.data = data
        word = ~BETWEEN[data]
        inner = word[1:] & word[:-1]
        inner[starts[(starts > 0) & (starts < len(data))] - 1] = False
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~inner
        end[:-1] &= ~inner
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        total, down = prefix_sums(alphabet[data])
        self.row = np.searchsorted(starts, self.first, "right") - 1
        self.ids = mix(mix((total[self.last] - total[self.first]) * down[self.first]) ^ keys[self.row])
        self.piece = np.cumsum(BREAK[data])[self.first] + self.row


def _language_keys(languages: pa.Array) -> tuple[list[str], np.ndarray]:
    """The languages of a batch's rows, null as NO_LANGUAGE, and a 64-bit number for each row's language."""
    coded = pc.fill_null(languages, NO_LANGUAGE).dictionary_encode()
    names = coded.dictionary.to_pylist()
    own = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in names] or [0], np.uint64)
    return pc.fill_null(languages, NO_LANGUAGE), own[coded.indices.to_numpy()]


def _runs(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray) -> Iterator[tuple[_Run, pa.Array, bool]]:
    """Runs of about 1 MB, each with its rows' languages and whether it goes on within the text of the run before."""
    for batch in batches:
        languages, keys = _language_keys(batch.column(0))
        offsets, data = text_buffers(batch.column(1))
        for row, stop in row_slices(offsets):
            part = data[offsets[row] : offsets[stop]]
            if stop - row > 1:
                yield _Run(part, offsets[row:stop] - offsets[row], keys[row:stop], alphabet), languages.slice(row, stop - row), False
                continue
            for k, piece in enumerate(pieces_at(part, BETWEEN)):
                yield _Run(piece, np.zeros(1, np.int64), keys[row:stop], alphabet), languages.slice(row, 1), k > 0


# --- the dictionary --------------------------------------------------------------------------------


def _spelt(run: _Run, at: np.ndarray) -> pa.Array:
    """The words at these places, folded."""
    size = run.last[at] - run.first[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - run.first[at], size)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_FOLD[run.data[where]])]
    return pa.Array.from_buffers(pa.string(), len(at), buffers)


def _differ(run: _Run, same: np.ndarray) -> np.ndarray:
    """Places whose word is not spelt as the word at the place ``same`` says."""
    size = run.last - run.first
    odd = size != size[same]
    data = np.concatenate([_FOLD[run.data], np.zeros(8, np.uint8)])
    left, at = np.flatnonzero(~odd & (np.arange(len(same)) != same)), 0
    while len(left):
        chunk = lambda first: np.lib.stride_tricks.sliding_window_view(data, 8)[first + at]  # noqa: E731, B023
        inside = np.arange(at, at + 8) < size[left][:, None]
        odd[left] |= ((chunk(run.first[left]) != chunk(run.first[same[left]])) & inside).any(1)
        at += 8
        left = left[size[left] > at]
    return np.flatnonzero(odd)


def _word_rows(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray) -> Iterator[pa.RecordBatch]:
    """lang, id, word, c of each run's distinct words; words that share an id get a row each."""
    names = ["lang", "id", "word", "c"]
    for run, languages, _ in _runs(batches, alphabet):
        if not len(run.ids):
            continue
        _, at, inverse, n = np.unique(run.ids, return_index=True, return_inverse=True, return_counts=True)
        odd = _differ(run, at[inverse])
        np.subtract.at(n, inverse[odd], 1)
        for place, count in ((at, n), (odd, np.ones(len(odd), np.int64))):
            if len(place):
                columns = [languages.take(pa.array(run.row[place])), pa.array(run.ids[place].view(np.int64)), _spelt(run, place), pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, names)


def dictionary(texts: DataFrame, least: int) -> tuple[DataFrame, np.ndarray]:
    """All words (lang, id, word, f), stored, and the alphabet that gave no two words one id if either has ``least``."""
    for seed in range(ATTEMPTS):
        alphabet = _alphabet(seed)

        def rows(batches, alphabet=alphabet):
            return _word_rows(batches, alphabet)

        counted = texts.mapInArrow(rows, "lang string, id long, word string, c long")
        words = stored(counted.groupBy("lang", "id", "word").agg(F.sum("c").alias("f")))
        clashes = words.groupBy("id").agg(F.count("*").alias("words"), F.max("f").alias("most")).where(f"words > 1 AND most >= {least}")
        if clashes.isEmpty():
            return words, alphabet
        delete(texts.sparkSession, words.stored_at)
    raise ValueError("no ids without clashes were found")


def _bitmap(places: DataFrame) -> np.ndarray:
    """The bits at the numbers of the column ``place``, as bytes: BITS / 8, whatever the number of rows."""
    one = F.col("place") + 1  # Spark's buckets begin with number 1
    bits = places.select(F.bitmap_bucket_number(one).alias("bucket"), F.bitmap_bit_position(one).alias("bit"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in bits.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        own = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * len(own) :][: len(own)] = own
    return out


def _among(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    place = (numbers % np.uint64(BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


# --- keys --------------------------------------------------------------------------------------------


def packed(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The key of a phrase: a leading number that mixes all ids, then the ids behind the first one."""
    rest = np.zeros(len(ids[0]), np.uint64)
    for own in reversed(ids[1:]):
        rest = mix(rest + own)
    return [ids[0] ^ rest, *ids[1:]]


def unpacked(key: list[np.ndarray]) -> list[np.ndarray]:
    return packed(key)  # mixing in the same number again takes it out


def run_lengths(key: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(counts):
        return key, counts
    order = np.argsort(key[0], kind="stable")
    lead = key[0][order]
    new = lead[1:] != lead[:-1]
    if any(((k[order][1:] != k[order][:-1]) & ~new).any() for k in key[1:]):  # keys that share their leading number
        order = np.lexsort(key[::-1])
        new = np.zeros(len(order) - 1, bool)
        for k in key:
            new |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return [k[order[starts]] for k in key], np.add.reduceat(counts[order], starts)


_SIGN = np.uint64(1 << 63)


def _key_rows(held: list[list[np.ndarray]], parts: int) -> pa.RecordBatch:
    """part, k0 (the leading number, ordered as signed), k1 .., c of the keys held, which are then held no more."""
    ids = [np.concatenate(x) for x in zip(*held, strict=True)]
    held.clear()
    key = packed(ids)
    del ids
    key, counts = run_lengths(key, np.ones(len(key[0]), np.int64))
    part = ((key[0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    columns = [pa.array(part.astype(np.int32)), pa.array((key[0] ^ _SIGN).view(np.int64)), *(pa.array(k.view(np.int64)) for k in key[1:]), pa.array(counts)]
    return pa.RecordBatch.from_arrays(columns, ["part", *(f"k{i}" for i in range(len(key))), "c"])


def _ranges(batches: Iterator[pa.RecordBatch], n: int, least: int) -> Iterator[pa.RecordBatch]:
    """i1 .., a, place of the phrases that a sorted range holds ``least`` times or more."""
    held: list[np.ndarray] = [np.zeros(0, np.uint64)] * n + [np.zeros(0, np.int64)]

    def whole(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, a = run_lengths(columns[:n], columns[n])
        key, a = [k[a >= least] for k in key], a[a >= least]
        place = key[0] % np.uint64(BITS)
        out = [*unpacked(key), a, place]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out], [*(f"i{k + 1}" for k in range(n)), "a", "place"])

    for batch in batches:
        own = [batch.column(k).to_numpy().view(np.uint64) for k in range(n)]
        own[0] = own[0] ^ _SIGN
        columns = [np.concatenate(x) for x in zip(held, [*own, batch.column(n).to_numpy()], strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0  # the last leading number may go on
        yield whole([x[:cut] for x in columns])
        key, counts = run_lengths([x[cut:] for x in columns[:n]], columns[n][cut:])
        held = [*key, counts]
    yield whole(held)


def phrases(texts: DataFrame, n: int, least: int, alphabet: np.ndarray, bitmaps: list) -> DataFrame:
    """i1 .. in, a, place: the phrases of ``n`` words with their counts, if ``least`` or more.

    ``bitmaps`` (broadcast): of frequent words, then of frequent phrases of 2 .. n - 1 words, each by leading number.
    """
    parts = shuffle_partitions(texts.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of the tasks that this worker ran before
        held, size = [], 0
        ids, piece = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for run, _, goes_on in _runs(batches, alphabet):
            before = min(n - 1, len(ids)) if goes_on else 0  # words that may begin a phrase across the cut
            old = piece[len(piece) - before :]
            piece = np.concatenate([old - (old[-1] if before else 0), run.piece])
            ids = np.concatenate([ids[len(ids) - before :], run.ids])
            good = _among(bitmaps[0].value, ids)
            at = np.flatnonzero(good)
            for k in range(1, n):
                at = at[at + k < len(ids)]
                at = at[good[at + k] & (piece[at + k] == piece[at])]
            at = at[at + n > before]
            for k in range(2, n):
                for j in range(n - k + 1):
                    at = at[_among(bitmaps[k - 1].value, packed([ids[at + j + i] for i in range(k)])[0])]
            if len(at):
                held.append([ids[at + k] for k in range(n)])
                size += len(at)
            if size >= KEYS:
                yield _key_rows(held, parts)
                size = 0
        if held:
            yield _key_rows(held, parts)

    keys = [f"k{i}" for i in range(n)]
    dealt = texts.mapInArrow(rows, ", ".join(["part int", *(f"{k} long" for k in keys), "c long"]))
    dealt = dealt.repartitionById(parts, "part").select(*keys, "c").sortWithinPartitions("k0")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ranges(batches, n, least)

    return dealt.mapInArrow(counted, ", ".join([*(f"i{k + 1} long" for k in range(n)), "a long", "place long"]))


# --- scores ------------------------------------------------------------------------------------------


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact while counts stay below 10^16."""
    wide = lambda x: x.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, inside: int = 50, top: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or three words.

    A-Z is lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. A phrase stands ``a`` >= ``least`` times within pieces of its language, overlaps included. Its cut
    into two parts that stand l and r times has the score floor(1000000 * a * a / (l * r)); the lowest counts, of equal
    ones the first. A phrase is left out if a longer one that holds it has 100 * count >= ``inside`` * a. Order:
    score and a descending, then the phrase's bytes. ``n`` counts the language's words.

    A null text has no words; a null language is ``und`` and counts with that name. Texts of any length are read whole
    (phrases go on across the blocks that a long text is read in), repeated rows count each time, other columns are
    ignored, an empty table gives an empty result. Ranks have no ties, as a language's phrases differ.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    words, alphabet = dictionary(texts, least)
    frequent = words.where(F.col("f") >= least)
    bitmaps = [spark.sparkContext.broadcast(_bitmap(frequent.select(F.col("id").bitwiseAND(BITS - 1).alias("place"))))]
    pairs = stored(phrases(texts, 2, least, alphabet, bitmaps))
    bitmaps.append(spark.sparkContext.broadcast(_bitmap(pairs.select("place"))))
    triples = stored(phrases(texts, 3, least, alphabet, bitmaps))

    pair, triple = pairs.drop("place"), triples.drop("place")
    word = lambda k: frequent.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    longer = triple.select("i1", "i2", "a").union(triple.select("i2", "i3", "a")).groupBy("i1", "i2").agg(F.max("a").alias("longer"))
    two = pair.join(longer, ["i1", "i2"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {inside} * a"))
    two = two.join(word(1).join(frequent.select(F.col("id").alias("i1"), "lang"), "i1"), "i1").join(word(2), "i2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    two = two.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))

    three = triple.join(pair.toDF("i1", "i2", "front"), ["i1", "i2"]).join(pair.toDF("i2", "i3", "back"), ["i2", "i3"])
    three = three.join(word(1).join(frequent.select(F.col("id").alias("i1"), "lang"), "i1"), "i1").join(word(2), "i2").join(word(3), "i3")
    three = three.withColumn("s1", _score(F.col("a"), F.col("f1"), F.col("back"))).withColumn("s2", _score(F.col("a"), F.col("front"), F.col("f3")))
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(early, F.col("f1")).otherwise(F.col("front")).alias("l"),
        F.when(early, F.col("back")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    found = two.union(three).withColumn("__share", share)
    found = found.withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).where(F.col("__at") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = found.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    out = stored(out)
    for done in (words, pairs, triples):
        delete(spark, done.stored_at)
    for b in bitmaps:
        b.destroy()
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS k FROM words WHERE len(w) > 0),
one AS (SELECT lang, w[k] AS p, count(*) AS f FROM places GROUP BY 1, 2),
totals AS (SELECT lang, sum(f) AS n FROM one GROUP BY 1),
two AS (SELECT lang, w[k] AS p1, w[k + 1] AS p2, count(*) AS f FROM places WHERE k < len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
three AS (SELECT lang, w[k] AS p1, w[k + 1] AS p2, w[k + 2] AS p3, count(*) AS f FROM places WHERE k + 1 < len(w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
longer AS (SELECT lang, p1, p2, max(f) AS m FROM (SELECT lang, p1, p2, f FROM three UNION ALL SELECT lang, p2, p3, f FROM three) GROUP BY 1, 2, 3),
cuts AS (
  SELECT t.lang, t.p1 || ' ' || t.p2 AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.p = t.p1 JOIN one y ON y.lang = t.lang AND y.p = t.p2
  LEFT JOIN longer g ON g.lang = t.lang AND g.p1 = t.p1 AND g.p2 = t.p2
  WHERE g.m IS NULL OR 100 * g.m < 50 * t.f
  UNION ALL
  SELECT t.lang, t.p1 || ' ' || t.p2 || ' ' || t.p3, 1, t.f, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.p1 JOIN two y ON y.lang = t.lang AND y.p1 = t.p2 AND y.p2 = t.p3
  UNION ALL
  SELECT t.lang, t.p1 || ' ' || t.p2 || ' ' || t.p3, 2, t.f, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.p1 = t.p1 AND x.p2 = t.p2 JOIN one y ON y.lang = t.lang AND y.p = t.p3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
