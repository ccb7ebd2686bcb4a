"""The corpus operators against brute force, and their defined results for nulls, empties, repeats and ties."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, exact_dedup, html_text, katz, licenses, near_dup, pieces, preferences, resampling, shared, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, words string, `_t` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and blank texts, a very long one, copies, a repeated row, and columns with clashing names."""
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(vocab, k=60)) for _ in range(12)]
    texts = [*base, base[0].upper(), base[1] + " tail words here", None, "", "  \n", "one two", " ".join(rng.choices(vocab, k=30_000)), base[2]]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, base[4], "x", "y")], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_greedy_tiles_against_naive_tiling():
    rng = random.Random(5)

    def naive(doc, item, least):
        d, t, out = [True] * len(doc), [True] * len(item), []
        while True:
            best, at = 0, []
            for i in range(len(doc)):
                for j in range(len(item)):
                    n = 0
                    while i + n < len(doc) and j + n < len(item) and d[i + n] and t[j + n] and doc[i + n] == item[j + n]:
                        n += 1
                    if n > best:
                        best, at = n, []
                    if n == best:
                        at.append((i, j))
            if best < least:
                return out
            for i, j in at:
                if all(d[i : i + best]) and all(t[j : j + best]):
                    d[i : i + best], t[j : j + best] = [False] * best, [False] * best
                    out.append((best, i, j))

    for _ in range(150):
        doc, item = ([rng.randrange(6) for _ in range(rng.randrange(1, 60))] for _ in range(2))
        got = decontamination.greedy_tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert sum(n for n, _, _ in got) == sum(n for n, _, _ in naive(doc, item, 3))
        assert all(doc[i : i + n] == item[j : j + n] for n, i, j in got)


def test_tiling_of_texts_that_repeat_themselves():
    import time

    import pyarrow as pa

    same = lambda n: np.full(n, 7, np.uint64)
    began = time.perf_counter()
    assert decontamination.greedy_tiles(same(200_000), same(50), 5) == [(50, 0, 0)]
    assert decontamination.greedy_tiles(same(200_000), np.concatenate([same(25), np.arange(100, 125, dtype=np.uint64)]), 5) == [(25, 0, 0)]
    items = ["a " * 50, "x y z " * 20, "stock phrase of some length here " + " ".join(f"i{k}" for k in range(60))]
    index = decontamination.seed_index([1, 2, 3], pa.array(items), 5)
    texts = pa.array(["a " * 200_000, "x y z " * 50_000, "stock phrase of some length here . " * 5_000, None, ""])
    assert [(row, item, covered) for row, item, covered, _, _ in decontamination._leaks_in(texts, index, 5, 0.5)] == [(0, 1, 1.0), (1, 2, 1.0)]
    assert time.perf_counter() - began < 20  # some 4 s alone; work that grows with words times words would take minutes


def test_decontamination_finds_reordered_passages(spark, docs, nothing):
    a, b = "alpha beta gamma delta epsilon zeta eta", "one1 two2 three3 four4 five5 six6"
    bench = spark.createDataFrame([(1, f"{a} {b}"), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    extra = spark.createDataFrame([(100, f"x {b} y y y {a.upper()} z", "", ""), (101, f"{a[:20]} q", "", ""), (102, "a TINY\nitem", "", "")], DOCS)
    for size in (8 << 20, 20):  # one block, several blocks
        found = decontamination.leaks(docs.union(extra), bench, block_bytes=size)
        assert sorted((r.doc_id, r.item_id, r.covered, r.tiles) for r in found.collect()) == [(100, 1, 1.0, 2), (102, 4, 1.0, 1)]
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_sentencepiece_equals_the_library(spark, docs, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    odd = ["a  b", " lead", "trail ", "▁mark", "日本語 ok", "\n\nx\ty", "é \U0001f600", "aaaaaaaa bbbb"]
    more = spark.createDataFrame([(200 + k, t, "", "") for k, t in enumerate(odd)], DOCS)
    text = {r.doc_id: r.text or "" for r in docs.union(more).collect()}
    for r in pieces.encode_decode(docs.union(more), pieces.default_model()).collect():
        ids = [*sp.encode(text[r.doc_id]), 2]
        assert r.ids == ids and r.decoded == sp.decode(ids)
    assert pieces.encode_decode(nothing, pieces.default_model()).count() == 0


def test_katz_weights_normalise_and_counts_are_exact(spark, docs, nothing):
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    train = [words(t) + [None] for i, t in ((k[0], k[1]) for k in rows) for _ in range(2 if i == 3 else 1) if i is None or __import__("zlib").crc32(str(i).encode()) % 7 != 2]
    count: dict = {}
    for w in (x for t in train for x in t):
        count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    for shortlist in (50, 1 << 18):
        got = [r for r in katz.katz_scores(docs, shortlist=shortlist).collect() if r.doc_id not in (None, 3)]
        for r in got:
            own = words(next(t for i, t in rows if i == r.doc_id)) + [None]
            base = sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in own)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), total)
            assert r.base_score == pytest.approx(base) and r.score < 0
    model = katz.train(docs, "text")
    assert model.alone.sum() == pytest.approx(1)
    assert katz.katz_scores(nothing).count() == 0


def test_katz_equals_a_dictionary_model_whatever_is_listed(spark, docs):
    rows = [(r.doc_id, [None, *words(r.text), None]) for r in docs.collect()]  # None: begin and end
    train = [t for i, t in rows if i is None or __import__("zlib").crc32(str(i).encode()) % 7 != 2]
    word, pair = ({}, {})
    for t in train:
        for h, w in zip(t, t[1:], strict=False):
            word[w] = word.get(w, 0) + 1
            pair.setdefault(h, {})
            pair[h][w] = pair[h].get(w, 0) + 1
    total = sum(word.values())

    def discounts(counts):
        of = {}
        for n in counts:
            of[n] = of.get(n, 0) + 1
        d = katz.good_turing(of)
        return lambda n: n * (d[n] if n <= katz.RELIABLE else 1)

    of_word, of_pair = discounts(word.values()), discounts(n for x in pair.values() for n in x.values())
    lost = sum(n - of_word(n) for n in word.values())
    alone = {w: (1 if lost >= 1 else 1 - 1 / total) * of_word(n) / total for w, n in word.items()}
    unseen = 1 - sum(alone.values())

    def p(h, w):
        if h not in pair:
            return alone.get(w, unseen)
        n, kept = sum(pair[h].values()), sum(map(of_pair, pair[h].values()))
        reserve = 1 - kept / n if kept < n - 1e-9 else 1 / (n + 1)
        if w in pair[h]:
            return (1 - reserve) * of_pair(pair[h][w]) / kept
        return reserve * alone.get(w, unseen) / (1 - sum(alone[x] for x in pair[h]))

    for h in [None, *list(pair)[:40]]:  # every history sums to 1 over the words and the one unseen type
        assert sum(p(h, w) for w in word) + p(h, "never") == pytest.approx(1)
    want = sorted((i or -1, sum(np.log10(p(h, w)) for h, w in zip(t, t[1:], strict=False))) for i, t in rows)
    for shortlist, head in ((0, 1), (20, 1 << 40), (200, 300), (1 << 18, 1 << 17), (1 << 18, 1 << 40), (1 << 18, 1)):
        got = sorted((r.doc_id or -1, r.score) for r in katz.katz_scores(docs, shortlist=shortlist, head=head).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


LONG_TEXT = "the cat and the dog are in the house with all of their friends and it is a good day for them. " * 4


def test_good_turing_discounts():
    n = {1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 34}
    top = 6 * n[6] / n[1]
    want = [((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, 6)]
    assert katz.good_turing(n)[1:] == pytest.approx(want)
    for odd in ({1: 5}, {}, {1: 3, 2: 9, 5: 1}, {7: 4}, {1: 10, 2: 10, 3: 10, 4: 10, 5: 10, 6: 10}):
        got = katz.good_turing(odd)[1:]
        assert ((got > 0) & (got < 1)).all() and (np.diff(got) > 0).all()


def test_html_rules():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=1>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>First <b>bold</b>
    words&nbsp;here.<p>Short.<div class="ad">Buy the best of it now</div><p>{LONG_TEXT}</p><ul><li><a href=2>more links</a></li></ul>
    <section id="comments"><p>{LONG_TEXT}</p></section></article><form>mail <input></form><footer>&copy; us</footer><script>var a = "</p>";</script>"""
    assert html_text.main_text(page) == f"Head & line\n\nFirst bold words here.\n\nShort.\n\n{LONG_TEXT.strip()}"
    assert html_text.main_text(f"<div><a href=1>one</a> <a href=2>two</a></div><div>{LONG_TEXT}</div><div>Short one</div>") == f"{LONG_TEXT.strip()}\n\nShort one"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<article><h1>A</h1><p>Few words.</p></article><footer>x</footer>") == "A\n\nFew words."


def test_html_rules_without_markup_names():
    menu = "".join(f"<li><a href=/{k}>place {k}</a></li>" for k in range(5))
    page = f"<body><div><ul>{menu}</ul></div><div>Buy it now.</div><div><h2>Head</h2><p>Begins short.</p><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p><p>Ends.</p></div><div><ul>{menu}</ul></div></body>"
    assert html_text.main_text(page) == f"Head\n\nBegins short.\n\n{LONG_TEXT.strip()}\n\n{LONG_TEXT.strip()}\n\nEnds."


def test_html_names_that_only_hold_such_words():
    t = LONG_TEXT.strip()
    page = f"""<article><h1>Head</h1><p class="notice-of-motion">{t}</p><h2 id="related-work">Related work</h2><p>{t}</p><div class="share-price">Price 4.</div></article>"""
    assert html_text.main_text(page) == f"Head\n\n{t}\n\nRelated work\n\n{t}\n\nPrice 4."
    assert html_text.main_text(f'<div class="login-history">{t}</div>') == t
    assert html_text.main_text(f'<div class="layout with-sidebar"><article class="post comments-open"><p>{t}</p></article></div>') == t


def test_html_keeps_the_article_whole():
    t = LONG_TEXT.strip()
    text = html_text.main_text
    assert text(f"<article><p>{t}</p><aside>Ad</aside><p>Last line.</p></article>") == f"{t}\n\nLast line."
    assert text(f"<p>{t}</p><p>One.</p><form>x</form><p>Two.</p><p>Three.</p>") == f"{t}\n\nOne.\n\nTwo.\n\nThree."
    assert text(f"<p>Before <button>buy</button> after words.</p><p>{t}</p>") == f"Before after words.\n\n{t}"
    assert text(f"<p>{t}</p><p><a href=1>See the full text of the bill</a></p><p>{t}</p>") == f"{t}\n\nSee the full text of the bill\n\n{t}"
    assert text(f"<body><form><nav>x</nav><p>{t}</p><p>Two.</p></form></body>") == f"{t}\n\nTwo."
    assert text("<form><p>Few.</p><p>Two.</p></form>") == "Few.\n\nTwo."
    assert text(f'<article><p>{t}</p><p class="related">{t}</p></article>') == f"{t}\n\n{t}"
    assert text(f'<article><p>{t}</p><div class="comments"><p>{t}</p><p>Nice.</p></div><p>End.</p></article>') == f"{t}\n\nEnd."
    assert text(f"<div><p>{t}</p></div><form><p>{t[:150]}</p><input></form>") == t


def test_html_planted_articles():
    rng = random.Random(11)
    stop = sorted(html_text.STOP_WORDS)
    prose = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.4 else f"word{rng.randrange(99)}" for _ in range(n)) + "."
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Place {k}</a></li>" for k in range(6)) + "</ul>"
    for _ in range(200):
        inside, planted = [], []
        for k in range(rng.randrange(3, 12)):
            kind = rng.choice(["long", "long", "short", "linked", "button", "aside", "form", "heading"]) if k else "long"
            words = prose(60 if kind == "long" else rng.randrange(2, 9))
            if kind in ("long", "short"):
                inside.append(f"<p>{words}</p>")
            elif kind == "heading":
                inside.append(f"<h2>{words}</h2>")
            elif kind == "linked":
                inside.append(f"<p>{words} <a href=x>{words}</a></p>")
                words = f"{words} {words}"
            elif kind == "button":
                inside.append(f"<p>{words[:-1]} <button>Share it</button> again.</p>")
                words = f"{words[:-1]} again."
            else:
                inside.append({"aside": f"<aside><p>{prose(50)}</p></aside>", "form": f"<form><label>{words}</label><input></form>"}[kind])
                continue
            planted.append(words)
        inside.append(f"<p>{(end := prose(60))}</p>")
        planted.append(end)
        tag = rng.choice(["article", "div"])
        page = f"<html><head><title>T</title></head><body><nav>{menu}</nav><div class='ad'>{prose(50)}</div><{tag}>{''.join(inside)}</{tag}><div>{menu}</div><footer>(c) us</footer></body></html>"
        assert html_text.main_text(page) == "\n\n".join(planted), page


def test_html_given_pages_equal_their_articles(spark):
    import html as entities

    tags = re.compile(r"(?i)</?(?:p|h\d|ul|ol|li|div|blockquote|table|tr|td|section|pre)\b[^>]*>")
    inner = re.compile(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>")
    for r in spark.read.parquet(f"{SF}/../sf0.01/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(entities.unescape(inner.sub(lambda m: " " if m[0].lower().startswith("<br") else "", b)).split()) for b in tags.split(article))
        assert html_text.main_text(r.html) == "\n\n".join(b for b in blocks if b)


def test_html_deep_and_long_pages():
    import time

    began = time.perf_counter()
    assert html_text.main_text("<div>" * 100_000 + LONG_TEXT) == LONG_TEXT.strip()
    assert len(html_text.main_text(f"<p>{LONG_TEXT}" * 5000)) > 5000 * 300
    assert time.perf_counter() - began < 20  # about 3 s alone; quadratic work would take minutes


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (2, None, None)], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract(pages).collect())) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_near_duplicates_leave_no_tables_of_their_rounds(spark, docs):
    from pathlib import Path

    from tessera.session import shared_folder

    tables = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("table-*")}
    before = tables()
    near_dup.near_duplicates(docs).count()
    assert tables() <= before


def test_near_duplicates_against_all_pairs(spark, docs, nothing):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) if (w := words(t)) else set() for i, t in text.items()}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in sets} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert got[None].kept and got[None].component_id is None
    assert near_dup.near_duplicates(nothing).count() == 0


def test_key_filter_loses_nothing(spark):
    rows = spark.range(50_000).selectExpr("id AS k", "'x' AS __maybe_not")
    wanted = spark.range(0, 50_000, 7).toDF("k")
    passed = shared.maybe_among(rows, "k", wanted)
    assert passed.join(wanted, "k").count() == wanted.count() and passed.count() < wanted.count() + 50 and passed.columns == rows.columns
    assert shared.maybe_among(rows, "k", wanted.limit(0)).count() == 0
    assert shared.marked(rows, "k", wanted).count() == 50_000


def test_near_duplicates_with_tiny_blocks_and_many_rounds(spark):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(120)]
    texts = []
    for group in range(6):  # groups that share half of their words with all others, so that buckets hold several
        own = [f"g{group}w{k}" for k in range(rng.choice([20, 60, 120]))]
        for _ in range(10):
            copy = common + own
            copy[rng.randrange(len(copy))] = "z"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    was = near_dup.BLOCK, near_dup.SHRINKS
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(words, texts)]
    label = list(range(len(sets)))
    for _ in range(6):
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    try:
        for near_dup.BLOCK, near_dup.SHRINKS in ((4, 0.0), (2048, 0.99)):
            got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
            assert [got[i] for i in range(len(sets))] == label
    finally:
        near_dup.BLOCK, near_dup.SHRINKS = was


def test_exact_dedup(spark, docs, nothing):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, keep="max").collect()}
    assert (got[0].keep_id, got[0].group_size, got[0].kept, got[12].kept) == (12, 2, False, True)
    assert (got[14].keep_id, got[15].keep_id, got[14].text_sha256) == (15, 15, hashlib.sha256(b"").hexdigest())
    assert got[3].kept and got[3].group_size == 2
    assert exact_dedup.exact_dedup(docs, keep="min").where("doc_id = 12").first().keep_id == 0
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_toxicity_machine_equals_its_parts_in_turn():
    rng = random.Random(8)
    parts, whole = [toxicity.negation(), toxicity.report(), toxicity.threat(), toxicity.insult()], toxicity.grammar()
    step = whole.arcs()
    for _ in range(3000):
        clause = "".join(rng.choices("ILVMPDNRO", weights=[3, 2, 2, 2, 2, 2, 1, 1, 5], k=rng.randrange(1, 25)))
        said = clause
        for part in parts:
            said = part.run(said)
        state, out = whole.start, ""
        for symbol in clause:
            state, more = step(state, symbol)
            out += more
        assert out == said == brute_clause(clause), clause


def brute_clause(clause):
    """What a clause emits, from the positions of its symbols alone."""
    tame, out = {}, {}
    for k, s in enumerate(clause):
        if s in "ILV":
            negated = "N" in clause[max(0, k - 3) : k]
            tame[k] = "r" if "R" in clause[:k] and not negated else "n" if negated else ""
    verbs = [k for k, s in enumerate(clause) if s == "V" and not tame[k]]
    mode, done, who, wait = 4, set(), "", None  # insults: strongest target so far, and the one that waits
    for k, s in enumerate(clause):
        said = ""
        if s in "PD":
            near = [v for v in verbs if v not in done and k - v <= mode and v < k]
            if near and near[-1] == max(v for v in verbs if v < k):
                said += "T" if any(clause[j] == "M" for j in range(max(0, near[-1] - mode), near[-1])) else "t"
                done |= set(near)
            if wait is not None and k - wait <= mode:
                said += {"IP": "A", "ID": "B", "LP": "a", "LD": "b"}[clause[wait] + s]
            wait, who = None, "P" if "P" in (who, s) else "D"
        elif s in "IL" and not tame[k]:
            if who:
                said, wait = {"IP": "A", "ID": "B", "IO": "C", "LP": "a", "LD": "b", "LO": "c"}[s + who], None
            else:
                wait = k
        elif tame.get(k):
            said = tame[k]
        elif s in "OV" and not who:
            who = "O"
        out[k] = said
    return "".join(out.values())


def test_toxicity_grammar_and_filter(spark, nothing):
    texts = [
        "You are a worthless idiot.", "The sky is blue.", None, "You are not an idiot.", "idiot", "I will destroy you!", "He said you are an idiot.",
        "", "a b. " * 500_000 + "You idiot.", "You are a worthless idiot.",
    ]
    docs = spark.createDataFrame([(k, t, "score", "") for k, t in enumerate(texts)], "doc_id long, text string, score string, predicted string")
    docs = docs.union(docs.where("doc_id = 0"))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[0].insult_pronoun == 2 and got[0].predicted == got[9].predicted == 1 and got[1].predicted == got[2].predicted == 0
    assert got[3].negated and got[3].score < got[0].score and got[6].reported and got[6].score < got[0].score
    assert got[4].score == got[2].score == got[7].score and got[8].insult_pronoun == 1  # a word alone is no clause
    assert got[5].threat_intended == 1 and got[5].predicted == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_toxicity_learns_from_a_bounded_sample(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 10 = 0 AS int) AS toxic")
    every = toxicity.training_labels(labels, "doc_id", "toxic").count()
    some = toxicity.training_labels(labels, "doc_id", "toxic", rows=2000).count()
    assert 14_000 < every < 16_000 and 1800 < some < 2200


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has 94 held-out labels, too few for a share
    got = toxicity.op7_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98 and got[got.toxic == 1].predicted.mean() > 0.85


def test_licenses(spark, nothing):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", "int main"), ("a/b/y.c", "prose here " * 20 + "\nLicensed under the Apache License, Version 2.0."),
        ("a/b/c/z.c", None), ("q/r.c", "nothing"), (None, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(k, *f, 0.5) for k, f in enumerate(files)], "id long, path string, text string, cosine double")
    got = {r.id: (r.license, r.origin) for r in licenses.license_scan(df, "id", df["path"]).collect()}
    none = (None, "none")  # a notice in a file without a name covers nothing else
    assert got == {0: ("MIT", "file"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "file"), 3: ("MIT", "inherited"), 4: none, 5: ("CC-BY-NC-4.0", "file")}
    again = df.union(df).union(spark.createDataFrame([(None, "a/n.c", "Licensed under CC BY-NC 4.0.", 0.5), (50, "a/e.c", "", 0.5), (51, "a/long.c", "word " * 200_000 + "\nReleased under the MIT License.", 0.5)], df.schema))
    rows = licenses.license_scan(again, "id", again["path"]).collect()
    assert len(rows) == 15 and {(r.license, r.origin) for r in rows if r.id in (None, 50)} == {("MIT", "inherited")}
    assert {(r.license, r.origin) for r in rows if r.id == 51} == {("MIT", "file")} and {r.license for r in rows if r.id == 2} == {"Apache-2.0"}
    assert licenses.license_scan(nothing, "doc_id", nothing["words"]).count() == 0


def test_licenses_against_plain_cosines(spark):
    """Every file's best licence and cosine from its segments, worked out in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    reworded = ["This project is released under the MIT License", "these pages: Licensed under the Apache License Version 2.0, all of them", "a license of no kind", "copyright me"]
    docs = docs.union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(reworded)], docs.schema))
    terms = lambda t: [x for x in re.split("[^a-z0-9]+", t) if x]
    texts = {r.doc_id: re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "") for r in docs.collect()}
    df: dict = {}
    for t in texts.values():
        for x in set(terms(t)):
            df[x] = df.get(x, 0) + 1
    weight = lambda t: {x: terms(t).count(x) * (np.log((1 + len(texts)) / (1 + df.get(x, 0))) + 1) for x in set(terms(t))}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    templates = [(name, weight(t.lower())) for name, t in licenses.TEMPLATES]
    want = {}
    for i, t in texts.items():
        if not re.search(licenses.CUE, t):
            continue
        parts = {t, *(x for x in t.split("\n") if re.search(licenses.CUE, x)), *(x for x in re.split(r"\n[ \t]*\n", t) if re.search(licenses.CUE, x))}
        found = []
        for part in parts:
            v = weight(part)
            for name, w in templates:
                cosine = round(sum(x * w.get(k, 0) for k, x in v.items()) / (size(v) * size(w)), 4)
                if cosine >= licenses.THRESHOLD:
                    found.append((-cosine, name))
        if found:
            want[i] = min(found)
    got = {r.doc_id: (-r.cosine, r.license) for r in licenses.license_scan(docs, "doc_id", F.lit("x")).where("origin = 'file'").collect()}
    assert set(got) == set(want) and 10_000 in want and 10_002 not in want
    assert all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0], abs=2e-4) for i in want)


def test_licenses_weigh_every_word_by_its_files(spark):
    texts = ["These tools were released under the MIT License."] + ["Released under the MIT License."] * 20 + ["these tools were made"] * 1979
    df = spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(texts)], "id long, path string, text string")
    got = licenses.license_scan(df, "id", df["path"]).where("id = 0").first()
    rare, often = np.log(2001 / 22) + 1, np.log(2001 / 1981) + 1  # files with the term, and one more
    assert (got.license, got.origin) == ("MIT", "file")
    assert got.cosine == pytest.approx(np.sqrt(5 * rare**2 / (5 * rare**2 + 3 * often**2)), abs=1e-4)


def test_full_licence_texts_are_inherited(spark):
    rng = random.Random(3)
    body = "\n\n".join(" ".join(rng.choices([f"clause{k}" for k in range(300)], k=60)) for _ in range(20))
    apache = f"Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n{body}"
    notice = f"{licenses.TEMPLATES[4][1]}\n\n{body}"
    bsd2 = "Copyright (c) 2020, Acme\n\n" + licenses._BSD.format("1. ", "\n2. ").replace("met: ", "met:\n\n") + "\n\n" + licenses._BSD_END
    bsd3 = bsd2.replace("THIS SOFTWARE IS PROVIDED", "3. Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED")
    files = [
        ("a/LICENSE", apache), ("b/COPYING", f"GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n{body}"), ("c/LICENSE-APACHE.txt", notice),
        ("d/main.c", notice), ("e/license.py", notice), ("f/LICENCE.md", bsd2), ("g/License.txt", bsd3), ("h/LICENSE", body),
    ]
    df = spark.createDataFrame([(k, *f) for k, f in enumerate([*files, *((f"{d}/sub/x.c", "int main") for d in "abcdefgh")])], "id long, path string, text string")
    got = {r.directory[0]: (r.license, r.origin) for r in licenses.license_scan(df, "id", df["path"]).where(f"id >= {len(files)}").collect()}
    want = {"a": "Apache-2.0", "b": "GPL-3.0", "c": "Apache-2.0", "d": None, "e": None, "f": "BSD-2-Clause", "g": "BSD-3-Clause", "h": None}
    assert got == {d: (x, "inherited" if x else "none") for d, x in want.items()}


def test_resampling_keeps_the_largest_keys(spark, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = resampling.resample(docs, labels, fraction=0.4).toPandas()
    assert set(got[got.kept].doc_id) == set(got.nlargest(int(np.ceil(0.4 * len(got))), "gumbel_key").doc_id)
    ties = spark.createDataFrame([(k, 1.0) for k in range(5000)], "id long, key double")
    assert ties.where(resampling.gumbel_top_k(ties, "id", "key", 1234)).count() == 1234
    assert resampling.resample(nothing, labels).count() == 0
    assert resampling.resample(docs, labels.limit(0)).where("kept").count() == docs.count()


def test_resampling_weights_against_plain_counts(spark):
    """Models and weights from single words' hashes, with null, empty, long, repeated texts and clashing columns."""
    import pyarrow as pa

    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 30))) for _ in range(60)] + [None, "", " \n", " ".join(rng.choices(vocab, k=40_000)), "W1 w2"]
    rows = [(k, t, "x", 1.0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], (None, "w3 w4", "x", 1.0)], "doc_id long, text string, kept string, log_weight double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 1), (7, None), (None, 1)], "doc_id long, quality int")
    code = {w: next(h for _, _, h in shared.word_hashes(pa.array([w])))[0] for w in vocab}

    def buckets(t):
        own = words(t)
        pairs = [shared.grams(np.array([code[a], code[b]], np.uint64), 2)[0] for a, b in zip(own, own[1:], strict=False)]
        return [int(x % np.uint64(resampling.BUCKETS)) for x in [*(shared.grams(np.array([code[w]], np.uint64), 1)[0] for w in own), *pairs]]

    import zlib

    good = {k for k in range(40) if k % 2 and zlib.crc32(str(k).encode()) % 4 != 2}
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    every = [(r.doc_id, buckets(r.text)) for r in docs.collect()]
    for i, found in every:
        for b in found:
            raw[b] += 1
            target[b] += i in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((i is not None, i or 0, len(b), round(sum(ratio[x] for x in b), 6)) for i, b in every)
    got = resampling.resample(docs, labels, fraction=0.5).collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_features, round(r.log_weight, 6)) for r in got)
    assert np.allclose(np.array(found, float), np.array(want, float), rtol=1e-6, atol=1e-5)
    assert len({r.kept for r in got if r.doc_id == 5}) == 1 and 33 <= sum(r.kept for r in got) <= 35


def test_preferences_prompt_and_masks(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes, and more"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 1, "assistant", "no"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes, and more"), (4, 0, "user", None), (5, None, "user", "x"), (None, 0, "user", "hi"),
        (1, 2, "user", "and?"), (1, 3, "assistant", "ok"),
    ]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, chosen string, prompt string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 1), (1, 1), (2, 4)], "chosen long, rejected long")
    got = {(r.chosen, r.rejected): r for r in preferences.format_preferences(df, pairs).collect()}
    assert set(got) == {(1, 2), (3, 1), (2, 4)}  # 1 against itself is no preference
    one = got[1, 2]
    assert (one.prompt_turns, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    spans = lambda text, mask: [text[int(b) : int(e)] for b, e in (x.split(":") for x in mask.split(",") if x)]
    assert spans(one.rejected_text, one.rejected_mask) == ["no"] and spans(one.chosen_text, one.chosen_mask) == ["yes, and more", "ok"]
    assert got[3, 1].prompt_turns == 2 and (got[3, 1].chosen_text, got[3, 1].chosen_mask) == ("", "")
    assert spans(got[3, 1].rejected_text, got[3, 1].rejected_mask) == ["ok"] and got[2, 4].prompt_turns == 0
    assert preferences.format_preferences(df.limit(0)).count() == preferences.format_preferences(df.limit(0), pairs).count() == 0


def test_preferences_swap_the_last_reply(spark):
    turns = [(0, 0, "user", "a"), (0, 1, "assistant", "A"), (0, 2, "user", "left out"), (1, 0, "user", "b"), (1, 1, "assistant", "B"), (6, 0, "user", "c"), (6, 1, "assistant", "C"), (6, 2, "user", "d"), (6, 3, "assistant", "D"), (8, 0, "assistant", "E"), (10, 0, "user", "f")]
    got = {r.chosen: r for r in preferences.format_preferences(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r.prompt_turns, r.chosen_text[14:15], r.rejected_text[14:15], r.rejected) for k, r in got.items()} == {0: (1, "A", "B", -1), 1: (1, "B", "A", -2), 6: (3, "D", "C", -7)}
    for first in (0, 5000):  # whatever the numbers are, a pair is one record
        long = [(0, first + k, ("user", "assistant")[k % 2], f"t{k}") for k in range(10_000)] + [(1, 0, "user", "q"), (1, 1, "assistant", "o" * 300_000)]
        df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
        (whole,) = preferences.format_preferences(df).where("chosen = 0").collect()
        assert whole.prompt_turns == 9_999 and whole.prompt == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, _, r, t in long[:9_999])
        assert len(whole.rejected_text) == 300_000 + 22 and whole.chosen_text == "<|assistant|>\nt9999<|end|>\n"


def brute_pipeline(rows, toxic, items, sp):
    """The stages in plain Python over rows (place, doc_id, text), given the scored toxic rows: place to ids."""
    rows = [r for r in rows if r[0] not in toxic]
    last: dict = {}
    for _, i, t in rows:
        key = tuple(lower(t))
        last[key] = max(last.get(key, (False, 0)), (i is not None, i or 0))
    rows = [r for r in rows if (r[1] is not None, r[1] or 0) == last[tuple(lower(r[2]))]]
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) if (w := words(t)) else set() for _, i, t in rows if i is not None}
    holds: dict = {}
    for i, s in sets.items():
        for x in s:
            holds.setdefault(x, []).append(i)
    label = {i: i for i in sets}
    links = {(i, j) for own in holds.values() for i in own for j in own if i < j}
    links = [(i, j) for i, j in links if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in range(len(links)):
        before = dict(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    rows = [r for r in rows if r[1] is None or label[r[1]] == r[1]]

    def leaks(t):
        own = words(t)
        grams = {tuple(own[k : k + n]) for n in {min(5, len(x)) for x in items} for k in range(len(own) - n + 1)}
        for x in items:
            n = min(5, len(x))
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                tiles = decontamination.greedy_tiles(*(np.array([abs(hash(w)) for w in side], np.uint64) for side in (own, x)), n)
                if sum(m for m, _, _ in tiles) >= 0.5 * len(x):
                    return True
        return False

    rows = [r for r in rows if not leaks(r[2])]
    return sorted((i is not None, i or 0, tuple([*sp.encode(t or ""), 2])) for _, i, t in rows)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, leak = docs.orderBy("doc_id").first(), spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(None, first.text), (None, None), (900_001, None), (900_002, ""), (None, f"x {leak} y"), (900_003, first.text), (900_003, "another text here with this id"), (900_003, "another text here with this id"), (900_004, "w " * 200_000)]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd], docs.schema)
    docs.unionByName(more).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").select("doc_id").collect()
    bad = {r.doc_id for r in scored}
    rows = [(k, r.doc_id, r.text) for k, r in enumerate(docs.collect())]
    assert 5 < len(bad) < 60
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r.text))]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = brute_pipeline(rows, {k for k, i, _ in rows if i in bad}, items, sp)
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == want
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
