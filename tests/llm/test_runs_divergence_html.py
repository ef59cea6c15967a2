"""Periodic runs, source divergence and main text against plain versions of what they are to give."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import compare
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanforge.llm import divergence, htmlmain, registry, runs
from spanforge.llm.common import importable, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_runs(words, least_length=6, least_exponent=4):
    n, out = len(words), set()
    for q in range(1, n // least_exponent + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k + q - start
            if length >= max(least_length, least_exponent * q) and not any(all(words[start + i] == words[start + i + p] for i in range(length - p)) for p in range(1, q)):
                out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {k for s, m, q in found for k in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(400):
        documents = []
        for _ in range(rng.randint(0, 5)):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randint(1, 6)
                words = words[:a] + [words[min(a + k % p, len(words) - 1)] for k in range(len(words) - a)]
            documents.append(words)
        for bounds in ((6, 4), (3, 3)):
            assert runs.runs_of(documents, *bounds) == [plain_runs(w, *bounds) for w in documents]


def test_parts_of_the_runs_method():
    rng = random.Random(3)
    words = [b"%d" % rng.randrange(2) for _ in range(400)]
    codes, offsets = runs.encoded([words, words[:50], []])
    order, rank = runs.suffix_array(codes, offsets)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    suffixes = [(int(np.searchsorted(offsets, k, "right")), codes[k : ends[k]].tolist()) for k in range(len(codes))]
    assert order.tolist() == sorted(range(len(codes)), key=suffixes.__getitem__) and (rank[order] == np.arange(len(codes))).all()
    document = np.repeat(np.arange(3), np.diff(offsets))
    extend = runs.Extensions(runs.common_prefixes(codes, order, rank, document), rank)
    left, right = rng.sample(range(401), 200), rng.sample(range(401), 200)
    pairs = [(a, b) for a, b in zip(left, right) if a != b]
    plain = [next((k for k in range(401) if codes[a + k] != codes[b + k] or not codes[a + k]), 0) for a, b in pairs]
    assert extend.of(*map(np.array, zip(*pairs))).tolist() == plain
    values = rng.sample(range(1000), 1000)
    assert runs.next_smaller(np.array(values)).tolist() == [next((j for j in range(k + 1, 1000) if values[j] < v), 1000) for k, v in enumerate(values)]
    for values in (np.arange(5000), np.arange(5000)[::-1], np.concatenate([[-1], np.arange(5000)[::-1]])):
        want = [next((j for j in range(k + 1, len(values)) if values[j] < values[k]), len(values)) for k in (0, 1, 4999)]
        assert runs.next_smaller(values)[[0, 1, 4999]].tolist() == want


def test_runs_of_long_periods():
    for words in ([b"a"] * 50_000, [b"%d" % (k % 7) for k in range(50_001)]):
        assert runs.runs_of([words]) == [[(0, len(words), len(set(words)))]]


def test_runs_query_is_the_plain_version(spark):
    importable(spark)
    got = registry.queries()["op11_runs"](spark, SMALL)
    want = Counter(plain_row(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect())
    assert Counter(map(tuple, got.collect())) == want and any(r[1] for r in want)


def test_runs_of_odd_rows(spark):
    importable(spark)
    long = " ".join(f"w{k * 7919 % 13}" for k in range(30_000))
    rows = [(None, "a a a a a a a b", None, "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 3), (4, "a b a b a b a b", "en", "s", 15), (4, "a b a b a b a b", "en", "s", 15), (5, long, "en", "s", 1), (6, "x", "en", "s", 1)]
    odd = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(k).alias(c) for k, c in enumerate(("start", "length", "period", "n_runs", "collapsed"))))
    got = {(r.doc_id, r.n_runs, r.collapsed) for r in runs.periodic_runs(odd).collect()}
    assert got == {(None, 1, "a b"), (1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 1, "a b"), (5, 1, " ".join(long.split()[:13])), (6, 0, "x")}
    assert runs.periodic_runs(odd).count() == len(rows) and runs.periodic_runs(odd.limit(0)).count() == 0
    alone = runs.periodic_runs(odd.filter("doc_id = 2 OR doc_id = 6")).collect()
    assert all(r.runs == [] and r.start is r.length is r.period is r.exponent_milli is None for r in alone)
    ties = spark.createDataFrame([(1, "a a a a a a x b b b b b b")], "doc_id long, text string")
    assert [(r.start, r.length, r.period, r.exponent_milli) for r in runs.periodic_runs(ties).collect()] == [(0, 6, 1, 6000)]


def plain_audit(rows):
    """rows of (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), g or "", s or "") for t, g, s in rows]
    in_docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for terms, lang, source in docs:
        in_docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for g, t in in_docs if g == lang and in_docs[g, t] >= 3), key=str.encode)
        own = {s: [counts[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        p, q = {s: share(c) for s, c in own.items()}, share([sum(c) for c in zip(*own.values())])
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources - {s}]
            terms = [(-((a - b) ** 2 // b), t.encode(), t) for c, a, b, t in zip(own[s], p[s], q, kept) if c and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, t, -v, k) for k, (v, _, t) in enumerate(found, 1)}
    return out


def audited(docs):
    rows = divergence.audit(docs).collect()
    assert len(set(rows)) == len(rows)
    return set(map(tuple, rows))


def test_divergence_of_random_rows(spark, monkeypatch):
    importable(spark)
    rng = random.Random(5)
    words = [rng.choice(["a", "B", "Ä", "ß", "é", "z", "\U0001f600"]) * rng.randint(1, 3) + rng.choice(["", "x", " "]) for _ in range(40)]
    rows = [(rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 30))) + ",1-x_" + rng.choice(words)]), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "Z", None, "é", ""])) for _ in range(150)]
    rows += [("only here", "fr", "one"), ("only there", "fr", "two"), (None, "it", "one"), ("same same", "es", "s"), ("same", "es", "s"), ("same", "es", "s"), ("word " * 50_000, "en", "s")]
    docs = spark.createDataFrame([(k, *r, 1, "x", 7) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, value int").repartition(3)
    want = plain_audit(rows)
    assert audited(docs) == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_in_small_pieces(monkeypatch):
    """Stretches of the dictionary of a few terms, and tallies handed on early, give the same sums."""
    rng = random.Random(9)
    rows = sorted({(t, s): rng.randint(1, 9) for t in "abcdefghijklm" for s in "xyz" if rng.random() < 0.7}.items())
    import pandas as pd

    frame = pd.DataFrame([("en", t, s, n) for (t, s), n in rows], columns=["lang", "term", "source", "n"])
    groups = divergence.Groups([type("Row", (), {"lang": "en", "source": s, "n": int(frame.n[frame.source == s].sum()), "terms": frame.term.nunique() if s == "x" else 0}) for s in "xyz"])
    sums = {}
    for dense_size in (1 << 20, 9):
        monkeypatch.setattr(divergence, "DENSE", dense_size)
        total = np.zeros((3, 3), np.int64)
        stretches = list(divergence._chunks(iter([frame.iloc[:7], frame.iloc[7:]]), groups))
        for lang, chunk in stretches:
            for k, values in divergence.divergences(lang, chunk, groups)[0]:
                total[k] += values
        sums[len(stretches) > 1] = total.tolist()
    assert sums[True] == sums[False] and divergence.shares(np.array([6, 0, 10**15]), np.array([7, 3, 10**15 + 1])).tolist() == [10**9 + 1, 333333334, 10**9 + 1]


def test_divergence_query_is_its_sql(spark):
    con = compare.connect(SMALL)
    assert compare.differences(spark, registry.queries()["op12_divergence"], registry.oracle_sql()["op12_divergence"], con, SMALL) is None


LONG = "First long paragraph of the text that goes on and on for a while."
PAGES = [
    (f"<body><div id=nav><a href=1>Home</a> <a href=2>News</a></div><div class='with-sidebar'><div class=content><h1>Title here</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}{LONG}</p></div></div><div id=footer>c 2020</div></body>", f"Title here {LONG} Short. {LONG}"),
    ("<header><h1>Site</h1></header><main><article><header><h1>Real title</h1><p class=byline>By me</p></header><p>Body &amp; soul&nbsp;of\n the <i>mat</i>ter.</p><aside>Aside</aside><form><label>Mail</label></form><div class='cookie-notice'>We use cookies</div><section id=comments><h2>Comments</h2><article class=comment><p>" + LONG * 9 + "</p></article></section></article></main><footer>f</footer>", "Real title Body & soul of the matter."),
    ("<p>One<p>Two<ul><li>a<li>b</ul><script>if(a<b){'</p>'}</script>", "One Two a b"),
    ("<article><h1>T</h1><p>Hi.</p><h2>3 Comments</h2><p>great great great great great great</p></article>", "T Hi."),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><p>d <span class=ad>buy</span>e</article>", "a b c d e"),
    ("<body class='has-sidebar'><div class='ad'>" + LONG * 5 + "</div><article><p>Short one.</p></article><div style='display:none'>" + LONG * 5 + "</div></body>", "Short one."),
    ("<body><nav><ul><li><a href=x>" + LONG + "</a></ul></nav><p>" + LONG + "</p><p>x</p><p>" + LONG + "</p><div><a href=1>more</a></div></body>", f"{LONG} x {LONG}"),
    ("<article><p>a&amp b &am c &#8364; &copy; &lt;p&gt;</p><p>tail <b", "a& b &am c € © <p> tail"),
    ("", ""), ("<p>   </p>", ""), ("plain text only", "plain text only"), ("<nav>x</nav>", ""), (None, ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert htmlmain.main_text(page) == want


def test_main_text_of_odd_pages():
    for page in ("<a " * 20_000, "<a " * 20_000 + ">", "<!--" * 20_000, "<!--" * 20_000 + ">", "&" * 20_000, "<" * 20_000, "</p>" * 20_000, "<div>" * 20_000, "<p class=" * 20_000 + ">"):
        assert isinstance(htmlmain.main_text(page), str)
    assert htmlmain.main_text("<b>" * 20_000 + "x" + "<p>" * 20_000 + "</i>" * 20_000) == "x"
    assert htmlmain.main_text("<article>" + f"<p>{LONG}</p>" * 5_000 + "</article>") == " ".join([LONG] * 5_000)


def test_smoothing_and_clusters():
    ratios = np.array([0, 0, 50.0, 60, 0, 0, 0, 0, 0, 0, 0])
    smooth = htmlmain.smoothed(ratios)
    weights = lambda k: np.exp(-0.5 * ((np.arange(11) - k) / htmlmain.SIGMA) ** 2) * (abs(np.arange(11) - k) <= htmlmain.REACH)
    assert np.allclose(smooth, [weights(k) @ ratios / weights(k).sum() for k in range(11)])
    lines = [htmlmain.Line(0, "x" * int(r), 0, 1, False) for r in ratios]
    above, cluster = htmlmain.content_lines(lines)
    assert above.tolist() == [r > 0 for r in ratios] and cluster[2] == cluster[3] == 1


def test_pages_query_gives_the_articles(spark):
    importable(spark)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in registry.queries()["op13_main_text"](spark, SMALL).collect()}
    pages = table(spark, SMALL, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:  # the pages of these tables hold one article element with paragraphs, bold type and line breaks
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(t) for t in re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", "\n", article)).split("\n"))
        text = " ".join(text.split())
        assert got[r.page_id] == (r.url, text, len(text))


def test_pages_with_odd_rows(spark):
    importable(spark)
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, None, "<p>x</p>", 3)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").withColumn("text", F.lit("old")).withColumn("a.b", F.lit(1))
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in htmlmain.extract(odd).collect()))
    assert got == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "x", 1)]
    assert htmlmain.extract(odd).columns == ["page_id", "url", "html", "a.b", "text", "n_chars"] and htmlmain.extract(odd.limit(0)).count() == 0
