"""Every operator on odd rows: nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "/opt")

from spectralake.llm import bpe, decontaminate, html_text, language_id, near_dedup, quality_net, quality_rules, substring_dedup, suffix_dedup, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["row", "stats", "k", "d", "h", "node", "spans", "_k", "_text", "_words", "_id", "bands", "c0", "items", "_lang", "_x0", "_g", "seed", "word", "value"]


def _make(n, r=None):
    r = r or random.Random(n)
    return " ".join(r.choice("alpha beta gamma delta omega kappa sigma theta".split()) + str(r.randrange(50)) for _ in range(n))


def odd_rows():
    long = _make(60_000)
    rows = [(1, _make(80), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t", "de", None, 3), (5, long, "en", "a", 9), (6, _make(80), "en", "a", 1), (None, _make(70), "en", "b", 1), (1, _make(80), "en", "a", 1), (7, "x" * 5000, "en", "a", 1)]
    return rows + [rows[0], rows[1]]


def run_all(spark, docs):
    import public_tokenizers

    learn = F.lit(True)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, _make(80)[:200]), (2, None), (None, "a b c")], "item_id long, text string")
    net = quality_net.train(docs, labels, learn)
    model = language_id.train(docs, learn)
    return {
        "op1": quality_rules.judge(docs).collect(), "op1_keep": quality_rules.keep(docs).collect(), "op2": quality_net.scored(docs, net, ["doc_id"]).collect(), "op3": substring_dedup.remove(docs).collect(),
        "op4": near_dedup.group(docs).collect(), "op4_keep": near_dedup.keep(docs).collect(), "op5": language_id.identified(docs, model, ["doc_id"]).collect(), "op7": bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False).collect(),
        "op8": suffix_dedup.remove(docs).collect(), "op8_clean": suffix_dedup.clean(docs).collect(), "op10": decontaminate.leaks(docs, bench).collect(), "op10_keep": decontaminate.keep(docs, bench).collect(),
    }


def test_odd_rows_and_clashing_names(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = run_all(spark, docs)
    for name in ("op1", "op2", "op3", "op4", "op5", "op7", "op8", "op8_clean"):
        assert len(plain[name]) == len(rows), name
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    clash = run_all(spark, wide)
    for name, got in plain.items():
        columns = list(got[0].asDict()) if got else []
        if "score" in columns:
            columns.remove("score")
        key = lambda r: str([r[c] for c in columns])  # noqa: B023, E731
        assert sorted(map(key, got)) == sorted(map(key, clash[name])), name
    assert len(clash["op8_clean"][0]) == len(wide.columns) and len(clash["op1_keep"][0]) == len(wide.columns)


def test_defined_results_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = run_all(spark, docs)
    one = lambda name, i: next(r for r in got[name] if r.doc_id == i)
    for i in (2, 3, 4):
        assert one("op1", i).n_words == 0 and one("op1", i).base_failed and not one("op1", i).kept
        assert one("op4", i).n_shingles == 0 and one("op4", i).component_id == i and one("op4", i).kept
        assert one("op3", i).n_removed == 0 and 0 <= one("op2", i).score <= 1 and one("op5", i).lang_pred == "und"
    assert one("op7", 2).n_tokens == 0 and one("op8", 2).n_bytes == 0 and one("op1", 5).n_words == 60_000
    # equal ids aren't smaller than each other, so repeated rows keep their words; for bytes they are occurrences
    assert all(r.n_removed == 0 for r in got["op3"] if r.doc_id == 1) and all(r.n_removed == r.n_bytes for r in got["op8"] if r.doc_id == 1)
    assert one("op4", 6).component_id == 1 and not one("op4", 6).kept and one("op4", None).component_id is None


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, rows in run_all(spark, docs).items():
        assert rows == [], name
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == url_filters.judge(pages, []).count() == 0


def test_pages_with_odd_rows(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.com/x?casino", "<p>" * 3000 + "deep"), (3, "http://A.com/x?casino", "<p>" * 3000 + "deep"), (None, "https://b.net#f", "<article><p>a &amp; b</article>"), (4, "://", "plain < text &lt;b&gt; &#x41")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(n) for n in ("_h", "text", "texts", "judged", "_host", "host", "path", "rule")])
    text = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert text[1] == text[2] == ("", 0) and text[None][0] == "a & b" and text[4] == ("plain < text <b> A", 18) and text[3][0] == "deep"
    judged = {r.page_id: (r.host, r.path, r.verdict) for r in url_filters.judge(pages, [("block", "net", "/")]).collect()}
    assert judged[1] == judged[2] == ("", "", "allow") and judged[3] == ("a.com", "/x", "block") and judged[None] == ("b.net", "", "allow") and judged[4] == ("", "", "allow")


def test_ties_of_url_rules_are_settled_by_length_then_order(spark):
    pages = spark.createDataFrame([(1, "http://x.org/fr/a")], "page_id long, url string")
    rules = [("block", "org", "/fr/"), ("allow", "org", "/fr/")]
    assert url_filters.judge(pages, rules).first().verdict == url_filters.judge(pages, rules[::-1]).first().verdict


def test_rules_without_languages_and_sources(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).select("doc_id", "text")
    assert quality_rules.judge(docs).count() == quality_rules.judge(docs.withColumn("lang", F.lit(None).cast("string"))).count() == len(odd_rows())


def _sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("tile", [256, 4])
@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_with_independent_shingles(spark, monkeypatch, k, tile):
    r = random.Random(9)
    words = [f"W{i}é" for i in range(40)] + ["İ", "ſ", "Kelvin", "a b", "x\ty"]
    base, other = [r.choice(words) for _ in range(120)], [r.choice(words) for _ in range(60)]
    texts = [" ".join(base), " ".join(base).lower(), " ".join(w.upper() if w.isascii() else w for w in base), "A", "a", "A b", None, "", "one two three"]
    for n in (1, 2, 4, 6, 8, 10, 12, 15, 20, 30):
        for _ in range(4):
            w = list(base)
            for _ in range(n):
                w[r.randrange(len(w))] = r.choice(words) + "q" * r.randrange(2)
            texts.append(" ".join(w))
    texts += [" ".join(other + [r.choice(words) + str(r.randrange(99)) for _ in range(r.randrange(5, 40))]) for _ in range(30)]
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1 if tile == 4 else 3)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    sets = [_sets(t, k) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    assert [got[i].component_id for i in range(len(texts))] == root
    assert all(got[i].n_shingles == len(s) and got[i].kept == (root[i] == i) for i, s in enumerate(sets))


def test_base_columns_of_the_quality_rules(spark):
    r = random.Random(4)
    texts = ["a b c a b c\na b c\n\na b c", "é #$ *%|<>& é x y", "one", "l\nl\nl\n \nm\r\nm\r\n", _make(60), " ".join("ab"[r.randrange(2)] for _ in range(200))]
    texts += [" ".join(r.choice("aé#|\n b\t") for _ in range(r.randrange(80))) for _ in range(40)]
    got = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        repeated = {j + x for j, w in enumerate(windows) if windows.count(w) > 1 for x in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_counts_don_t_depend_on_blocks(monkeypatch):
    text = "Der İstanbul Straße, 漢字 and ΣΑΣ " * 40
    whole = language_id.counts(text)
    for block in (1, 2, 5, 17, 64):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert (language_id.counts(text) == whole).all()


def test_held_out_accuracy(spark):
    from spectralake.llm.common import crc_bucket

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fold = crc_bucket("doc_id", 5)
    model = language_id.train(docs, fold != 0)
    held = language_id.identified(docs.where((fold == 0) & F.col("lang").isNotNull()), model, ["doc_id", "lang"]).where("lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in held)
    assert right / len(held) > 0.97 and 0 < model.least < 1
    assert sum(r.rejected for r in held) <= 0.1 * len(held)
    fold = crc_bucket("doc_id", 4)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = quality_net.train(docs, labels, fold != 2)
    scores = quality_net.scored(docs.where(fold == 2), net, ["doc_id"]).join(labels, "doc_id").where("quality is not null").collect()
    good, bad = ([r.score for r in scores if r.quality == y] for y in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.85


def test_score_reads_every_byte_and_learns_from_whole_texts(spark):
    rows = [(i, "word " * 3000 + ("good end" if i % 2 else "%%% ***"), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality_net.train(docs.drop("quality"), docs.select("doc_id", "quality"), F.lit(True))
    assert net.score("word " * 3000 + "good end") > net.score("word " * 3000 + "%%% ***") + 0.2


def test_doubtful_blocks_go_only_where_they_repeat(spark):
    note = "<p class='share-note'>Share this with all of your many friends and family on every network today please</p>"
    short = "<p class='social'>Share</p>"
    page = lambda i, extra: f"<article><p>story {i} has its own words</p>{extra}<p>end {i}</p></article>"
    rows = [(1, "http://a.com/1", page(1, note + short)), (2, "http://a.com/2", page(2, note + short)), (3, "http://b.com/1", page(3, note)), (4, "http://a.com/4", page(4, "<p class='share-note'>A sentence that only this page has</p>")), (5, "http://a.com/5", page(5, "<div class='share'>Tweet</div>"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "story 1 has its own words end 1" and got[5] == "story 5 has its own words end 5"
    assert "many friends" in got[3] and got[4] == "story 4 has its own words A sentence that only this page has end 4"


def test_plain_blocks_go_where_half_of_a_host_has_them(spark, monkeypatch):
    r = random.Random(5)
    make = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    notice, quoted, cookie, story = make(15), make(14), "We use cookies", make(60)
    page = lambda *paragraphs: "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    rows, want = [], {}

    def add(host, kept, *paragraphs):
        rows.append((len(rows), f"http://{host}/{len(rows)}", page(*paragraphs)))
        want[len(rows) - 1] = " ".join(kept)

    for i in range(8):  # a notice on 6 of 8 pages, a short one on all, a quotation on 3
        own, end = make(30), make(20)
        more = [notice] if i < 6 else [quoted + " " + make(5)]
        text = [quoted] if i == 0 else []
        add("a.com", [own, *text, *(more if i >= 6 else []), end], own, *text, *more, cookie, end)
    for _ in range(3):  # what three pages share is too few
        own = make(30)
        add("b.com", [own, notice], own, notice)
    for i in range(5):  # copies of one story but for a word stay whole
        add("c.com", [story, f"number{i}"], story, f"number{i}")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for tokens in (html_text.HOST_TOKENS, 100):
        monkeypatch.setattr(html_text, "HOST_TOKENS", tokens)
        assert {x.page_id: x.text for x in html_text.extract(df).collect()} == want
