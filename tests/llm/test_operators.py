"""Operators of the llm subpackage against brute force on small tables with nulls, empty and repeated rows."""

import collections
import hashlib
import itertools
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "/opt")

from spectralake.llm import bpe, decontaminate, html_text, language_id, near_dedup, quality_net, quality_rules, substring_dedup, suffix_dedup, url_filters


def corpus():
    r = random.Random(5)
    words = [f"w{i}ö" for i in range(200)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = make(70), make(150)
    texts = [base, base, make(3), None, "", " \n", "a" * 900, "ab" * 300, make(40) + " " + passage + " " + make(20), passage + " " + make(60)]
    for _ in range(6):
        w = base.split()
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    return [(i, t, r.choice(["en", "de", None]), "s", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")


def test_suffix_dedup(docs):
    rows = {r.doc_id: r for r in suffix_dedup.remove(docs).collect()}
    data = {i: (t or "").encode() for i, t, *_ in corpus()}
    seen = collections.Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (rows[k].n_bytes, rows[k].n_removed, rows[k].n_spans, rows[k].kept_sha256) == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())


def test_substring_dedup(docs):
    rows = {r.doc_id: r for r in substring_dedup.remove(docs).collect()}
    data = {i: (t or "").split() for i, t, *_ in corpus()}
    low = {}
    for k in sorted(data):
        for i in range(len(data[k]) - 12):
            low.setdefault(tuple(data[k][i : i + 13]), k)
    for k, w in data.items():
        gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (rows[k].n_words, rows[k].n_removed, rows[k].kept_text) == (len(w), len(gone), kept)


def test_near_dedup(docs):
    rows = {r.doc_id: r for r in near_dedup.group(docs).collect()}
    sets = {i: frozenset(near_dedup.shingles(t, 2).tolist()) for i, t, *_ in corpus()}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[b] = root[a] = min(root[a], root[b])
    assert {k: r.component_id for k, r in rows.items()} == root
    assert all(rows[k].n_shingles == len(s) and rows[k].kept == (root[k] == k) for k, s in sets.items())


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    changed = item.replace("four ", "FOUR! ").replace("seven", "other").replace("eleven", "more")
    docs = spark.createDataFrame([(1, f"x y {changed} z"), (2, None), (3, ""), (4, "one two three nothing else here at all"), (5, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "a b")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 9), (5, 9)}
    assert {r.doc_id for r in decontaminate.keep(docs, bench).collect()} == {2, 3, 4}


def test_mask_always_hits_within_two_substitutions():
    mask = decontaminate.MASKS[0]
    for a in range(13):
        for b in range(13):
            assert any(not {p + m for m in mask} & {a, b} for p in range(13 - mask[-1]))


def test_short_items_with_every_allowed_substitution(spark):
    items, docs, want = [], [], set()
    for n in (1, 2, 3, 4, 5, 6, 7, 10, 11, 12):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for changed in itertools.combinations(range(n), n // 5):
            docs.append((len(docs), " ".join(["x", *(f"c{k}" if k in changed else w for k, w in enumerate(item)), "y"])))
            want.add((len(docs) - 1, n))
        docs.append((len(docs), " ".join(["x", *(f"c{k}" if k <= n // 5 else w for k, w in enumerate(item)), "y"])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_quality_rules(docs):
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert rows[3].n_words == 0 and rows[3].base_failed and not rows[3].kept
    assert rows[0].n_words == 150 and not rows[0].base_failed
    assert len(rows) == len(corpus())


def test_html():
    page = "<nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<!-- x --><script>var t='</p>'</script></p></article><footer>&copy;</footer>"
    assert " ".join(t for t, m in html_text.blocks(page) if m) == "A & B one two three four"
    assert html_text.blocks(None) == html_text.blocks("") == []


def test_html_repetition_does_not_depend_on_the_size_of_a_host(spark, monkeypatch):
    r = random.Random(11)
    make = lambda n: [f"t{r.randrange(10**6)}" for _ in range(n)]
    notes = [make(12 + i % 3) for i in range(12)]
    bodies = [make(40) + notes[i % 12] + make(30) for i in range(30)]
    bodies += [make(20) + notes[0][:11] + make(5), notes[3] * 2 + make(3), make(5)]
    pages = [(i, f"http://{'Big' if i % 2 else 'big'}.com/{i}", "<p>" + " ".join(b)) for i, b in enumerate(bodies)]
    pages += [(100, "http://small.com/", "<p>" + " ".join(bodies[0])), (101, "http://big.com/x", pages[4][2]), (102, None, None)]
    owners = {}
    for i, b in enumerate(bodies):
        for j in range(len(b) - 11):
            owners.setdefault(tuple(b[j : j + 12]), set()).add(i)
    want = {100: " ".join(bodies[0]), 102: ""}
    for i, b in enumerate(bodies):
        gone = {j + k for j in range(len(b) - 11) if len(owners[tuple(b[j : j + 12])]) > 1 for k in range(12)}
        want[i] = " ".join(w for j, w in enumerate(b) if j not in gone)
    want[101] = want[4]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for tokens in (html_text.HOST_TOKENS, 100):
        monkeypatch.setattr(html_text, "HOST_TOKENS", tokens)
        assert {x.page_id: x.text for x in html_text.extract(df).collect()} == want


def test_bpe_matches_tiktoken():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec.of(path, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    import numpy as np

    for text in ["", "Hello  world\n\n", "ünïcödé 漢字 🙂" * 3, "a" * 300, "thatthethere<|endoftext|>"]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text


def test_models_without_text():
    assert language_id.fit([]).predict("abc") == ("und", 0.0)
    model = language_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)
    assert model.predict("der und die")[0] == "de" and model.predict("1 2")[0] == model.predict(None)[0] == "und"
    net = quality_net.fit([("good words", 1), ("%%% ***", 0)] * 10)
    assert net.score("good words") > net.score("%%% ***") and 0 <= net.score(None) <= 1


def test_language_fit_reads_whole_texts(spark):
    rows = [(i, "1 " * 10_500 + ("the cat and the dog", "der hund und die katze")[i % 2], ("en", "de")[i % 2]) for i in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["de", "en"] and model.predict("der und die")[0] == "de"


def test_url_terms():
    assert url_filters.hits("http://x.com/casino?free", url_filters.STRICT, tuple(url_filters.SOFT.items())) == (["casino"], ["free"])
    assert url_filters.hits(None, url_filters.STRICT, ()) == ([], [])
