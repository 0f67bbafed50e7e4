"""The corpus operators against brute force, on small fixtures with awkward rows."""

import hashlib
import html as html_lib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regimera.llm import common, html_template, jaccard_join, lm_lbl, matroska, mixing, quality_fm, quality_rules, registry, secret_scan, sentencepiece_ac, token_count
from regimera.llm.components import components
from regimera.llm.textkernel import Words, chunks, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string"


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def corpus():
    """Rows with nulls, blanks, repeats, copies, near copies, a long text, and an extra column whose name clashes."""
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "one two three four", "One Two THREE four", "é ü x \U0001f600 tail"]
    base = [sentence(rng, rng.randrange(20, 120)) for _ in range(30)]
    texts += base
    for b in base[:12]:
        for _ in range(3):
            w = b.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(w))
    texts += [base[0].upper(), base[1] + "\n" + base[1], "### $$$ %%% " * 30, sentence(rng, 4000, 50), "same line here now ok\n" * 12]
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "S3")[i % 4], None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(r[0], 0 if r[1] and ("###" in r[1] or "same line" in r[1]) else 1, 0) for r in corpus() if r[0] % 2 == 0]
    return spark.createDataFrame([*rows, (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")


def words(t):
    return WORD.findall(t or "")


# Text kernel


def test_kernel_matches_plain_code():
    texts = [t or "" for _, t, *_ in corpus()]
    for limit in (1, 700, 1 << 20):
        got = []
        for _, _, data, offsets in chunks(pa.array(texts), limit):
            w = Words(data, offsets)
            raw = data.tobytes()
            for d in range(len(offsets) - 1):
                got.append([raw[w.start[i] : w.end[i]].decode() for i in range(w.first[d], w.first[d + 1])])
        assert got == [words(t) for t in texts]
    _, _, data, offsets = next(chunks(pa.array(texts)))
    sets, offs, weight = shingle_sets(Words(data, offsets), 5, np.ones(sum(len(words(t)) for t in texts), np.int64))
    for d, t in enumerate(texts):
        w = words(t.translate(FOLD))
        n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))
        assert offs[d + 1] - offs[d] == n
        assert set(weight[offs[d] : offs[d + 1]].tolist()) <= ({5} if len(w) >= 5 else {0})


# op1


def base_counts(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def test_quality_rules(docs, labels, none):
    rows = quality_rules.judge(docs, labels, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_counts(r["text"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(none, labels, keep=["doc_id"]).count() == 0
    whole = quality_rules.judge(docs, labels.limit(0), keep=docs.columns).collect()
    assert all(r["kept"] != r["base_failed"] for r in whole) and whole[0].__fields__[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_binomial_tail(spark):
    part = lambda i, n, p: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    exact = lambda k, n, p: math.fsum(part(i, n, p) for i in range(k + 1))
    cases = [(0, 1, 0.3), (0, 217, 0.02), (3, 500, 0.02), (40, 3000, 0.02), (5, 20, 0.4), (600, 1500, 0.45), (19_700, 1_000_000, 0.02)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(exact(k, n, p), rel=1e-8)
    assert spark.range(1).select(quality_rules.binomial_tail(F.lit(9), F.lit(10), 0.02)).first()[0] == 1


def test_cutoffs_bound_false_rejections(spark):
    n = len(quality_rules.RULES)
    rows = [("en", True, [min(100, i % 40)] + [0] * (n - 1)) for i in range(6000)] + [("en", False, [90] + [0] * (n - 1))] * 500 + [("de", True, [0] * n)] * 30 + [("de", False, [99] * n)] * 30
    got = {(r["stratum"], r["rule"]): r for r in quality_rules.cutoffs(spark.createDataFrame(rows, "stratum string, good boolean, stats array<int>")).collect()}
    assert set(got) == {("en", 0)}  # thirty good documents certify nothing at this level
    r = got["en", 0]
    assert r["cutoff"] > 39 and r["caught"] == 500 and r["lost"] == 0
    assert r["lost"] / r["n_good"] <= quality_rules.ALPHA


# op2


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(FOLD))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), best[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_join(docs, none):
    want = brute_components(corpus())
    assert sorted(map(tuple, jaccard_join.join(docs).collect())) == want
    assert sorted(map(tuple, jaccard_join.join(docs, salt_at=2).collect())) == want
    assert jaccard_join.join(none).count() == 0


def test_jaccard_join_families(spark, monkeypatch):
    """Families around the threshold, cut into several blocks and salted lists."""
    rng = random.Random(11)
    rows = []
    for f in range(3):
        base = [f"v{f}_{i}" for i in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_components(rows)
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 4)
    assert sorted(map(tuple, jaccard_join.join(df).collect())) == want
    assert sorted(map(tuple, jaccard_join.join(df, salt_at=4).collect())) == want


def test_one_of_each(docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted({c for _, _, c in brute_components(corpus())})
    shuffled = jaccard_join.one_of_each(docs, broadcast_ids=0).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in shuffled) == sorted(ids)


def test_sketch_sums_and_sets_beyond_the_filter(spark, docs):
    some = docs.select("doc_id", "text").repartition(37)
    profiled = jaccard_join.profile(some).cache()
    one, few = jaccard_join.read_sketch(profiled, fan=1000), jaccard_join.read_sketch(profiled, fan=2)
    shingles = sum(r["n_shingles"] for r in profiled.where("slice is null").collect())
    assert np.array_equal(one, few) and one[0].sum() == shingles and one[1].sum() == sum(len(words(r[1])) for r in corpus())
    nodes = [r["node"] for r in profiled.where("n_shingles > 0").select("node").distinct().limit(9).collect()]
    pairs = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    joined = jaccard_join.set_table(some, pairs, most=0).select("node", "size", "members").collect()
    held = {r["node"]: r for r in jaccard_join.set_table(some, pairs).select("node", "size", "members").collect()}
    assert {r["node"] for r in joined} == set(nodes) and all(held[r["node"]] == r for r in joined)


def test_bitmap_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
        offs = lambda x: np.array([0, len(x)])
        for factor in (1, 8):
            s = jaccard_join.slack(np.array([len(a)]), np.array([len(b)]), jaccard_join.signatures(a, offs(a), factor), jaccard_join.signatures(b, offs(b), factor), factor)[0]
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 80 * (len(a) + len(b) - inter):
                assert s >= 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


# op3


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><script>var a="<p>no</p>";</script></head><body class="x{i}"><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav><div class="ad-box">Buy now {i}</div><div id="wrap"><div class="{c}"><h1>Head {i}</h1>
<p>Text &amp; more&nbsp;{i} with  a   few words<br>and a second line.</p><p><b>Bold {i}<p>Last para {i} is here &lt;ok&gt;</p><div class="share">Share it</div></div>
<aside>Side {i}</aside><div class="comments"><p>A reader says {i} a lot of things here, much longer than the article itself, on and on and on and on.</p></div></div>
<form><input name=q>Search</form><footer>&copy; 2024 {i}</footer>{end}"""
WANT = "Head {i}\n\nText & more {i} with a few words and a second line.\n\nBold {i}\n\nLast para {i} is here <ok>"


def test_html_extraction(spark, none):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i=i, c="post" if i % 2 else "zone", end="</body></html>" if i % 3 else "")) for i in range(12)]
    rows += [(100, None, None), (101, "http://one.example/", ""), (102, "http://alone.example/x", PAGE.format(i=102, c="story", end="")), (103, "nonsense", "just text &am"), rows[3]]
    got = sorted(map(tuple, html_template.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "text", "n_chars").collect()))
    assert len(got) == len(rows)
    for i, text, n in got:
        want = {100: "", 101: "", 103: "just text &am"}.get(i, WANT.format(i=i))
        assert (text, n) == (want, len(want)), i
    assert html_template.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


PROBE = """<html><body><div class="top">Home News {n}</div><div class="box"><h1>Head {i}</h1><p>Please accept our policy of the {t} cookies.</p><p>{a}</p><p class="tags-note">Noted {i} in passing.</p>
<div class="social contract">The contract of {i} is signed.</div><p>{b}</p><p>By the same writer</p><div class="comments"><p>Reader {i} says {b}</p></div><ul><li><a href="/x">More {i}</a></li></ul></div></body></html>"""


def test_html_fixed_lines_go_and_named_content_stays(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(6):
        a, b = sentence(rng, 30), "the policy " + sentence(rng, 40)
        rows.append((i, f"http://six.example/{i}", PROBE.format(i=i, a=a, b=b, t="", n=i)))
        want[i] = "\n\n".join([f"Head {i}", a, f"Noted {i} in passing.", f"The contract of {i} is signed.", b])
    frames = [("<div>{nav}</div><main>{x}</main>", "Alpha menu"), ("<table><tr><td>{nav}</td><td>{x}</td></tr></table>", "Beta menu"), ("<section>{x}</section><p>{nav}</p>", "Gamma menu")]
    for i in range(12):
        frame, nav = frames[i % 3]
        a, b = sentence(rng, 20), sentence(rng, 20)
        rows.append((10 + i, f"http://three.example/{i}", "<html><body>" + frame.format(nav=nav, x=f"<p>{a}</p><p>{nav}</p><p>{b}</p>") + "</body></html>"))
        want[10 + i] = f"{a}\n\n{b}"
    long_name = "n" * 60
    deep = "".join(f'<div class="{long_name}{"x" * k}">' for k in range(20))
    for i in range(4):
        rows.append((30 + i, f"http://deep.example/{i}", f"<body><div>menu {i}</div>{deep}<p>{'text ' * 30}{i}</p></body>"))
        want[30 + i] = "text " * 30 + str(i)
    copies = "<body><div><p>All the same here</p><p>and here</p></div></body>"
    rows += [(40 + i, "http://copies.example/", copies) for i in range(5)]
    want |= {40 + i: "All the same here\n\nand here" for i in range(5)}
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert got == want


def test_html_very_deep_and_broken_markup():
    deep = "<div>" * 30000 + "core text" + "</span></p>" * 1000
    assert html_template.article(deep) == "core text"
    assert html_template.article("<p>a<svg>" + "<svg>b" * 3000) == "ab" + "b" * 2999
    assert html_template.article("</div></p><p>x<i>y</p>z<p") == "xy\n\nz"


def brute_classes(pages, support):
    """Equivalence classes of a host by comparing whole count vectors: {vector: (tag paths, last words)} where a tag anchors them."""
    counts = []
    for page in pages:
        nodes, blocks = html_template.read(page)
        path = lambda x: (path(x.parent) if x.parent is not None else ()) + (x.label,)
        counts.append(Counter([(0, path(x)) for x in nodes] + [(1, path(x), line) for x, line in blocks if not x.away]))
    out = {}
    for token in {t for c in counts for t in c}:
        vector = tuple(c[token] for c in counts)
        if sum(v > 0 for v in vector) >= support:
            out.setdefault(vector, (set(), set()))[token[0]].add(token)
    return {v: x for v, x in out.items() if x[0]}


def small_site(rng):
    """A site of one to three templates: frames with fixed lines, repeated records, optional parts and slots."""
    frames = []
    for k, box in enumerate(rng.sample(["div", "section", "main", "td"], rng.randrange(1, 4))):  # templates differ in their tags
        cls = rng.choice(["", f' class="b{chr(97 + k)}"', f' id="content{chr(97 + k)}"'])
        frames.append((box, cls, [f"fixed line {k} {j}" for j in range(rng.randrange(0, 3))], rng.random() < 0.5, rng.random() < 0.5))
    pages, want = [], []
    for i in range(rng.randrange(3 * len(frames), 16)):
        box, cls, fixed, menu, notes = frames[i % len(frames)]
        paragraphs = [sentence(rng, rng.randrange(12, 30), 10_000) for _ in range(rng.randrange(2, 5))]
        inner = "".join(f"<p>{x}</p>" for x in fixed[:1]) + "".join(f"<p>{x}</p>" for x in paragraphs) + "".join(f"<div>{x}</div>" for x in fixed[1:])
        listed = "<ul>" + "".join(f"<li><a href=/{j}>link {rng.randrange(99)}</a></li>" for j in range(3)) + "</ul>" if menu else ""
        noted = f"<p>Served in {i} ms</p>" if notes else ""
        pages.append(f"<html><body>{listed}<div>{noted}</div><{box}{cls}>{inner}</{box}><footer>end {i}</footer></body></html>")
        want.append("\n\n".join(paragraphs))
    return pages, want


def test_template_deduction_against_brute_force(spark):
    rng = random.Random(12)
    sites = [small_site(rng) for _ in range(200)]
    rows = [(k * 100 + i, f"http://site{k}.example/{i}", page) for k, (pages, _) in enumerate(sites) for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    stats = html_template.token_stats(df.select("html", html_template.host_of().alias("host"))).collect()
    by_host = {}
    for r in stats:
        by_host.setdefault(r["host"], []).append(r)
    for k, (pages, _) in enumerate(sites):
        kept = [r for r in by_host[f"site{k}.example"] if r["pages"] >= 3]
        made = html_template.equivalence_classes([(r["kind"], r["token"], r["parent"], r["depth"], tuple(r[c] for c in html_template.VECTOR)) for r in kept])
        brute = brute_classes(pages, 3)
        shape = lambda pages_, n, t, w: (pages_, n, len(t), len(w))
        assert sorted(shape(c["pages"], c["occurrences"], c["tags"], c["words"]) for c in made) == sorted(shape(sum(x > 0 for x in v), sum(v), *x) for v, x in brute.items())
    got = {r["page_id"]: r["text"] for r in html_template.extract(df).collect()}
    wrong = [(k, i) for k, (_, want) in enumerate(sites) for i, text in enumerate(want) if got[k * 100 + i] != text]
    assert len(wrong) == 0, (len(wrong), wrong[:3], [got[k * 100 + i] for k, i in wrong[:2]], [sites[k][0][i] for k, i in wrong[:2]])


def test_equivalence_classes():
    rows = [(0, 1, 0, 1, (5, 5, 1, 1)), (0, 2, 1, 2, (5, 5, 1, 1)), (0, 3, 2, 3, (5, 20, 7, 9)), (0, 4, 3, 4, (5, 20, 7, 9)), (1, 9, None, None, (5, 5, 1, 1)), (1, 8, None, None, (4, 4, 2, 2))]
    classes = html_template.equivalence_classes(rows)
    assert [(c["tags"], c["words"]) for c in classes] == [([1, 2], [9]), ([3, 4], [])] and classes[1]["parent"] == 0 and all(c["valid"] for c in classes)


# op4


def water_level(sizes, weights, most=3):
    total, target, open_ = sum(sizes.values()), {}, dict(weights)
    left = float(total)
    while open_:
        unit = left / sum(open_.values())
        over = [s for s in open_ if unit * open_[s] > most * sizes[s]]
        if not over:
            return target | {s: unit * w for s, w in open_.items()}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            del open_[s]
    return target


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus())
    sizes = Counter()
    for r in corpus():
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=3)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"]) for r in rs)
    assert key(again) == key(rows)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_schedule_is_low_discrepancy(spark):
    goals = mixing.targets(spark.createDataFrame([("a", 5000), ("b", 5000), ("c", 100)], "source string, source_size long"))
    share = {r["source"]: r["target"] / r["total"] for r in goals.collect()}
    rows = mixing.schedule(goals, 10).orderBy("slot").collect()
    for n in (64, 200, len(rows)):
        seen = Counter(r["source"] for r in rows[:n])
        assert all(abs(seen[s] - n * share[s]) <= 8 for s in share)
    ranks = [r["rank"] for r in rows if r["source"] == "a"]
    assert ranks == list(range(len(ranks)))


def test_mixing_of_sources_smaller_than_a_block(spark):
    sizes = {"a": [1000] * 30 + [7] * 20, "b": [900] * 20, "c": [2, 1], "d": [150, 250], "e": [4000, 1999, 1], None: [60] * 5}
    rows = [(i, f"{i} " + "w " * (n - 1), "en", s, 0, None) for i, (s, n) in enumerate((s, n) for s in sizes for n in sizes[s])]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), bits=4).collect()
    want = water_level({s: sum(v) for s, v in sizes.items()}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)})
    for s in sizes:
        # The first words of the source's repeated stream, as many as its target.
        mine, left = sorted((r for r in got if r["source"] == s), key=lambda r: r["h"] % 2**64), round(want[s])
        taken = dict.fromkeys((r["doc_id"] for r in mine), 0)
        while left:
            for r in mine:
                taken[r["doc_id"]] += min(left, r["size"])
                left -= min(left, r["size"])
        assert {r["doc_id"]: r["taken"] for r in mine} == taken


# op5


def test_lm_scoring(docs, none):
    rows = lm_lbl.score_corpus(docs, head=64, steps=60).collect()
    assert len(rows) == len(corpus())
    counts, texts = Counter(), {}
    for r in corpus():
        texts.setdefault(r[0], r[1])
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(words((r[1] or "").translate(FOLD)))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*words((texts[r["doc_id"]] or "").translate(FOLD)), None]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0
    want = brute_scores(60, 64)
    assert all(r["score"] == pytest.approx(want[texts[r["doc_id"]]], rel=1e-4) for r in rows)
    assert lm_lbl.score_corpus(none, steps=5).count() == 0


def brute_scores(steps, head):
    """text -> score, token by token, from dictionaries of counts; the model is trained from the same trigram counts."""

    def keys(text):
        raw = [w.encode() for w in words((text or "").translate(FOLD))]
        return [int(lm_lbl.token_keys(np.frombuffer(w, np.uint8), Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])))[0]) for w in raw]

    train = [keys(r[1]) for r in corpus() if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter(k for t in train for k in t)
    bins = Counter(math.floor(math.log2(v) * 6) for v in counts.values())
    least = min((b for b in bins if sum(n for x, n in bins.items() if x >= b) <= head), default=99)
    often = [k for k in counts if math.floor(math.log2(counts[k]) * 6) >= least]
    units = {k: 2 + i for i, k in enumerate(sorted(often, key=lambda k: (-counts[k], k))[: lm_lbl.UNITS])}
    class_of = lambda k: units.get(k, 2 + lm_lbl.UNITS + k % lm_lbl.SUFFIXES)

    def trigrams(t):
        seq = [0, 0, *map(class_of, t), 1]
        return list(zip(seq, seq[1:], seq[2:]))

    found = Counter(x for t in train for x in trigrams(t))
    c = lm_lbl.CLASSES
    coded = sorted(((a * c + b) * c + x, n) for (a, b, x), n in found.items())
    table = lm_lbl.log_table(lm_lbl.train(np.array([k for k, _ in coded]), np.array([n for _, n in coded]), steps=steps))
    once, twice = (sum(v == i for v in counts.values()) for i in (1, 2))
    off = min(0.95, max(0.05, once / (once + 2 * twice)))
    tokens, kinds = Counter(), Counter()
    for k, v in counts.items():
        if k not in units:
            tokens[class_of(k)] += v
            kinds[class_of(k)] += 1

    def within(k):
        g = class_of(k)
        if k in units or not tokens[g]:
            return 0.0
        return math.log10((counts[k] - off if counts[k] else off * kinds[g]) / tokens[g])

    out = {}
    for r in corpus():
        t = keys(r[1])
        out[r[1]] = sum(float(table[a * c + b, x]) for a, b, x in trigrams(t)) + sum(map(within, t))
    return out


def test_lm_gains_on_held_out_text(spark):
    got = lm_lbl.score_corpus(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert (got[0] - got[1]) / got[2] > 0.5


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, lm_lbl.CLASSES**3, 500))
    table = lm_lbl.log_table(lm_lbl.train(codes, np.ones(len(codes), int), steps=20))
    assert (10.0**table).sum(1) == pytest.approx(1, abs=1e-4)
    keys = np.sort(np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.arange(1, 2000)
    tokens, kinds = np.zeros(lm_lbl.SUFFIXES, int), np.zeros(lm_lbl.SUFFIXES, int)
    suffix = (keys & np.uint64(lm_lbl.SUFFIXES - 1)).astype(int)
    np.add.at(tokens, suffix, counts)
    np.add.at(kinds, suffix, 1)
    voc = lm_lbl.Vocabulary(keys, counts, tokens, kinds, len(keys), 0.6, 10)
    classes, c, found = voc.lookup(keys)
    for k in range(lm_lbl.SUFFIXES):
        inside = classes == 2 + lm_lbl.UNITS + k
        assert found.all() and (c[inside] - 0.6).sum() / 10 ** voc.room[k] + 10 ** voc.unseen[k] == pytest.approx(1)


def test_lm_learns_context():
    """Alternating classes are predicted far better than by their shares."""
    a, b, c = 10, 11, lm_lbl.CLASSES
    codes, counts = np.array(sorted([(a * c + b) * c + a, (b * c + a) * c + b])), np.array([500, 500])
    table = lm_lbl.log_table(lm_lbl.train(codes, counts, steps=400))
    assert 10.0 ** table[a * c + b, a] > 0.7 and 10.0 ** table[b * c + a, b] > 0.7


# op6


def test_matroska(docs, none):
    rows = matroska.digest(docs).collect()
    texts = {r[0]: r[1] for r in corpus()}
    by_text = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert matroska.digest(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 576, 5000, 400_000])
def test_matroska_round_trip(n):
    payload = bytes(random.Random(n).randrange(256) for _ in range(n))
    media = matroska.write(payload)
    found = matroska.parse(media)
    assert b"".join(media[a:b] for _, _, a, b, _, _ in found.packets) == payload
    assert found.cues_valid and len(found.cues) == len(found.clusters)
    assert [p[1] for p in found.packets] == [12_000 * i for i in range(len(found.packets))]
    cut = matroska.parse(media[: len(media) * 2 // 3])
    assert len(cut.packets) <= len(found.packets) and cut.packets == found.packets[: len(cut.packets)]


def test_matroska_unknown_sizes_and_noise():
    media = matroska.write(b"x" * 3000)
    at = media.index((matroska.SEGMENT).to_bytes(4, "big")) + 4
    width = 9 - media[at].bit_length()
    open_ended = media[:at] + b"\x01" + b"\xff" * 7 + media[at + width :]
    found = matroska.parse(open_ended)
    assert b"".join(open_ended[a:b] for _, _, a, b, _, _ in found.packets) == b"x" * 3000
    deep = bytes([0xE1, 0xFF]) * 2000 + bytes([0xE1, 0x40, 0x03]) * 2000  # masters in masters
    assert matroska.parse(deep).packets == [] and matroska.parse(deep + media).tracks is not None
    assert matroska.parse(b"").packets == [] and matroska.parse(bytes(200)).packets == [] and matroska.parse(b"\xff" * 99).packets == []


def test_packet_table(spark):
    deep = bytearray([0xE1, 0xFF] * 2000)
    df = spark.createDataFrame([(1, bytearray(matroska.write(b"y" * 2000))), (2, None), (3, deep)], "media_id long, media binary")
    rows = matroska.packet_table(df).orderBy("packet").collect()
    assert [r["end"] - r["start"] for r in rows] == [576, 576, 576, 272] and rows[0]["codec"] == "A_PCM/INT/LIT"


# op7


def greedy(word, first, later):
    n, at, start = 0, 0, True
    while at < len(word) or start:
        vocab = first if start else later
        end = next((e for e in range(len(word), at - start, -1) if word[at:e] in vocab), None)
        if end is None:
            return 1
        at, n, start = end, n + 1, False
    return n


def test_longest_match():
    rng = random.Random(2)
    for _ in range(200):
        pick = lambda lo, k: [bytes(rng.choices(b"abc", k=rng.randrange(lo, 4))) for _ in range(k)]
        first, later = pick(0, 4), pick(1, 5)
        lengths = token_count.Lengths(first, later, memo=7)
        for _ in range(40):
            w = bytes(rng.choices(b"abc", k=rng.randrange(1, 9)))
            assert lengths[w] == greedy(w, set(first), set(later))


def test_token_count(docs, none):
    vocabulary = token_count.load_vocabulary(registry.BYTE_VOCABULARY)
    first, later = map(set, vocabulary)
    texts = {r[0]: r[1] for r in corpus()}
    for r in token_count.count_tokens(docs, vocabulary).collect():
        w = (texts[r["doc_id"]] or "").encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(greedy(x, first, later) for x in w))
    assert token_count.count_tokens(none, vocabulary).count() == 0


# op8


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = {"w": rng.normal(size=quality_fm.N_FEATURES), "v": rng.normal(size=(quality_fm.N_FEATURES, 4)), "b": 0.3}
    index, value = np.array([3, 9, 40, 41]), np.array([0.5, 1.0, -2.0, 0.1])
    plain = 0.3 + (model["w"][index] * value).sum() + sum(model["v"][index[i]] @ model["v"][index[j]] * value[i] * value[j] for i, j in itertools.combinations(range(4), 2))
    assert quality_fm.margins(model, index, value, np.array([0, 4]))[0] == pytest.approx(plain)


def test_quality_classifier(spark, docs, labels, none):
    rows = quality_fm.classify(docs, labels).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert quality_fm.classify(none, labels).count() == 0
    assert {r["score"] for r in quality_fm.classify(docs.limit(3), labels.limit(0)).collect()} != set()


def test_quality_classifier_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_fm.classify(d, l).where("held_out").join(l, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9


# op9


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_ac.load_pieces(registry.PIECE_MODEL)


def test_viterbi_is_best(pieces):
    codec = sentencepiece_ac.Codec(pieces)
    score = {p: s for p, s in zip(pieces["pieces"], pieces["scores"]) if s is not None}
    cost = lambda ids: sum(sentencepiece_ac.BYTE_COST if pieces["scores"][i] is None else pieces["scores"][i] for i in ids)

    def best(t):
        b = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            b[e] = b[e - 1] + sentencepiece_ac.BYTE_COST
            for k in range(max(0, e - 16), e):
                if t[k:e] in score:
                    b[e] = max(b[e], b[k] + score[t[k:e]])
        return b[-1]

    rng = random.Random(4)
    for _ in range(300):
        t = " " + "".join(rng.choices("theoanirs e,.", k=rng.randrange(1, 30)))
        whole = cost(codec.encode(t[1:]).tolist())
        assert whole == pytest.approx(best(t.replace(" ", sentencepiece_ac.META)))


def test_sentencepiece(docs, none, pieces):
    rows = sentencepiece_ac.digest(docs, pieces).collect()
    assert len(rows) == len(corpus()) and all(r["round_trip"] for r in rows)
    encoded = sentencepiece_ac.encode(docs, pieces)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_ac.decode(encoded, pieces).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in corpus())
    assert sentencepiece_ac.digest(none, pieces).count() == 0
    codec = sentencepiece_ac.Codec(pieces, memo=2)
    for t in ("", " ", "  a  b ", "x\ty\n z", "日本▁ 語\U0001f600", "\0▁\0", "▁"):
        assert codec.decode(codec.encode(t)) == t


def test_sentencepiece_scores_below_minus_twenty_and_meta_inside():
    names = ["<unk>", "\u2581", "a", "b", "ab", "a\u2581b", "\u2581ab"] + [f"<0x{i:02X}>" for i in range(256)]
    scores = [None, -30.0, -40.0, -41.0, -45.0, -50.0, -60.0] + [None] * 256
    model = {"pieces": names, "scores": scores, "bytes": list(range(7, 263)), "unknown": 0}
    codec = sentencepiece_ac.Codec(model)
    assert not codec.by_run and codec.byte_cost == -70

    def best(text):  # every split, by pieces or one character's bytes
        if not text:
            return 0.0, ()
        ways = [(-70.0 + best(text[1:])[0], (None, *best(text[1:])[1]))]
        ways += [(v + best(text[len(p) :])[0], (i, *best(text[len(p) :])[1])) for i, (p, v) in enumerate(zip(names, scores)) if v is not None and text.startswith(p)]
        return max(ways, key=lambda w: w[0])

    for text in ("ab ab", "a b", "ba  b", "aab b a", "axb"):
        ids = codec.encode(text)
        want = [i for i in best("\u2581" + text.replace(" ", "\u2581"))[1]]
        got = [int(i) if i < 7 else None for i in ids]
        assert got == want and codec.decode(ids) == text


# op10


def brute_spans(t):
    letters = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    key = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + letters("api") + "_?" + letters("key")
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""(?:{key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


SECRETS = [
    "token=token:abcdefgh", "Api_Key: 'abc.def-1' é token = \"deadbeef\"", "AKIA" + "A1" * 8 + " AKIA" + "B" * 15 + " AKIAAKIA" + "C" * 16, "x" + "0a" * 12 + " 0123456789abcdef01234567g", "\U0001f600 passwd=123456 \U0001f600 secret : zzzzzz",
    "token==abc token =  = abcdefg", "live Zx81kd92Lq7vB3nM5tR_x", None, "", "password=" + "a" * 50 + "f" * 30, "again Example12345678Example5678 here", "again Example12345678Example5678 there", "again Example12345678Example5678 twice",
    "é eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4 http://me:hunter22@host x AKIA0a", "-----BEGIN RSA PRIVATE KEY-----\nMIIEpAIBAAK\n-----END RSA PRIVATE KEY----- a-long-slug-of-words-2023-11-05",
]
GENERIC = re.compile(secret_scan.GENERIC)


def brute_scan(rows, share=0.1):
    """rows: (id, text, owner, repository). (id, base spans, owned spans, examples) by pairs of spans and sets of owners."""

    def candidate(v):
        if len(v) < 8:
            return False
        if v.startswith(("://", "-----BEGIN ", "eyJ")) and not (v.startswith("eyJ") and "." not in v):
            return True
        return sum(c.isdigit() for c in v) >= 3 and sum(c.isalpha() for c in v) >= 3 and re.search("[A-Za-z0-9]{16}", v) is not None

    held, owners, repositories = [], {}, {}
    for i, t, owner, repository in rows:
        base = brute_spans(t or "")
        values = set()
        for a, k, b in base:
            v = re.search("[A-Za-z0-9+/_.=-]+$", t[a:b])[0] if k == 0 else t[a:b]
            if k == 0:  # the value is the group, not the longest tail
                v = re.match(ASSIGN_VALUE, t[a:b])[1]
            values.add((b - len(v), b))
        for m in GENERIC.finditer(t or ""):
            if candidate(m[0]) and all(b <= m.start() or m.end() <= a for a, _, b in base):
                values.add((m.start(), m.end()))
        held.append((i, base, values, t))
        for a, b in values:
            owners.setdefault(t[a:b], set()).add(owner)
            repositories.setdefault(t[a:b], set()).add(repository)
    few_o, few_r = (max(1, int(share * len({r[k] for r in rows}))) for k in (2, 3))
    live = {v for v in owners if len(owners[v]) <= few_o and len(repositories[v]) <= few_r}
    return [(i, base, {x for x in values if t[x[0] : x[1]] in live}, sum(t[a:b] not in live for a, b in values)) for i, base, values, t in held]


ASSIGN_VALUE = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def check_scan(spark, rows):
    """rows by SCHEMA against brute_scan; ids may repeat."""
    got = secret_scan.scan(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()
    want = brute_scan([(r[0], r[1], r[3], (r[3], r[2])) for r in rows])
    names = ("assign", "access", "hex")
    told = []
    for i, base, owned, examples in want:
        listed = [(a, k, b, names[k]) for a, k, b in base]
        text = ",".join(f"{n}:{a}:{b}" for a, k, b, n in listed)
        spans = ",".join(f"{n}:{a}:{b}" for a, k, b, n in sorted([*listed, *((a, 4, b, "owned") for a, b in owned)]))
        told.append((i, *(sum(k == x for _, k, _, _ in listed) for x in range(3)), hashlib.sha256(text.encode()).hexdigest(), spans, len(owned), examples))
    assert sorted(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")) for r in got) == sorted(told)
    return {r["doc_id"]: r for r in got}


def test_secret_scan(spark, none):
    rows = [(i, t, "en", f"s{i}", 1, "c") for i, t in enumerate(SECRETS)]
    by = check_scan(spark, [*rows, rows[0]])
    assert by[6]["spans"] == "owned:5:26" and by[6]["n_live"] == 1
    assert by[10]["spans"] == "" and by[10]["n_example"] == 1  # three owners carry it
    assert by[14]["spans"].startswith("owned:0:") and by[14]["n_live"] == 1  # the slug has no core
    assert secret_scan.scan(none, keep=["doc_id"]).count() == 0


def test_secret_scan_tells_copied_examples_from_owned_keys(spark):
    rng = random.Random(3)
    examples = [f"token = \"{rng.getrandbits(160):040x}\"" for _ in range(5)] + [f"Bearer {rng.getrandbits(100):025X}k9k" for _ in range(5)]
    keys = {i: f"key {rng.getrandbits(120):030X}x1x" for i in range(0, 1000, 10)}
    rows = []
    for i in range(1000):
        owner = f"owner{i % 40}" if i % 3 else "hot"  # a third of all rows have one owner
        text = f"{sentence(rng, 10)} {examples[i % 10] if i % 2 else ''} {keys.get(i, '')} {sentence(rng, 5)}"
        rows.append((i, text, "en", owner, 1, f"p{i}"))
    by = check_scan(spark, rows)
    assert all(by[i]["n_live"] == 1 for i in keys) and all(by[i]["n_live"] == 0 for i in range(1000) if i not in keys)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i:032x} K{i:020d}abC" for i in range(1500)) + " " + "x" * 5000
    rows = [(1, text, "en", "a", len(text), "c"), (2, "plain", None, None, 5, "c")]
    by = check_scan(spark, rows)
    assert by[1]["n_live"] == 3000
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == " ".join(["[secret]"] * 3000) + " " + "x" * 5000 and got[2] == "plain"


def test_redact(spark, docs):
    rows = [(i, t, "en", f"s{i}", 1 if t is None else len(t), "c") for i, t in enumerate(SECRETS)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in secret_scan.redact(df).collect()}
    told = brute_scan([(r[0], r[1], r[3], (r[3], r[2])) for r in rows])
    for (i, t, *_), (_, base, owned, _) in zip(rows, told):
        if t is None:
            assert got[i]["text"] is None
            continue
        hidden = {p for a, b in [*((a, b) for a, _, b in base), *owned] for p in range(a, b)}
        left = "".join(c if p not in hidden else ("\0" if p - 1 not in hidden or any(p == a for a, _, _ in base) and all(not a < p < b for a, _, b in base) else "") for p, c in enumerate(t))
        assert got[i]["text"] == left.replace("\0", "[secret]") and got[i]["n_chars"] == len(got[i]["text"])
        assert not brute_spans(got[i]["text"])
    assert got[6]["text"] == "live [secret]" and got[10]["text"] == SECRETS[10] and got[4]["text"] == "\U0001f600 [secret] \U0001f600 [secret]"
    assert sorted(map(str, secret_scan.redact(docs).collect())) == sorted(map(str, docs.collect()))


def test_redaction_counts_owners_as_the_scan_does(spark):
    value = "abcdef1234567890xyzw"
    rows = [(i, f"password={value}" if i else f"bare {value}", "en", f"s{i}", 0, None) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df, keep=["doc_id"]).collect()}
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert spans[0] == "" and got[0] == f"bare {value}" and got[1] == "[secret]"


# Shared helpers and the pipeline


def test_shared_dir(spark):
    assert common.shared_dir(spark)
    df = common.materialise(spark.range(3).toDF("x"), "test")
    assert df.count() == 3


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf), "test-stage")
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in kept["quality rules"].collect()} == {i for i, t in raw.items() if not base_counts(t)[5]}
    rows = [(r["doc_id"], r["text"]) for r in kept["quality rules"].collect()]
    assert {r["doc_id"] for r in kept["n-gram Jaccard join"].collect()} == {c for _, _, c in brute_components(rows)}
    assert all(not brute_spans(r["text"]) for r in kept["secret scans"].collect())
    # The mix holds each source near its target, whole documents, none more than three times.
    sizes, taken, copies = Counter(), Counter(), Counter()
    for r in kept["secret scans"].collect():
        sizes[r["source"]] += len(words(r["text"]))
    for r in kept["mixing sources"].collect():
        taken[r["source"]] += len(words(r["text"]))
        copies[r["doc_id"]] += 1
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = water_level(sizes, {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)})
    longest = max(len(words(r["text"])) for r in kept["secret scans"].collect())
    assert max(copies.values()) <= 3 and all(abs(taken[x] - want[x]) <= longest for x in want)
    encoded = {r["doc_id"]: list(r["ids"]) for r in kept["SentencePiece encoding"].collect()}
    codec = sentencepiece_ac.Codec(sentencepiece_ac.load_pieces(registry.PIECE_MODEL))
    assert all(codec.decode(np.array(encoded[r["doc_id"]], "<i4")) == r["text"] for r in kept["mixing sources"].collect())
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_on_awkward_rows(spark, docs, none, labels, tmp_path):
    """Nulls, blanks, repeats, a long text, clashing names and an empty table through every stage."""
    import corpus_pipeline

    awkward = docs.withColumns({"row": F.lit(1), "text2": F.col("text"), "stats": F.lit("x"), "h": F.lit(2), "size": F.lit(3)})
    for name, table in (("some", awkward), ("none", awkward.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        step, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
        for stage, f in corpus_pipeline.STAGES:
            out = common.materialise(f(spark, step, folder), "test-awkward")
            assert stage == corpus_pipeline.STAGES[-1][0] or out.columns == table.columns
            step = kept[stage] = out
        if name == "none":
            assert step.count() == 0
            continue
        texts = {r[0]: r[1] for r in corpus()}
        passed = [r["doc_id"] for r in kept["quality rules"].collect()]  # thirty labels certify no cutoff
        assert Counter(passed) == Counter(r[0] for r in corpus() if not base_counts(r[1])[5])
        single = [r["doc_id"] for r in kept["n-gram Jaccard join"].collect()]
        assert sorted(single) == sorted({c for _, _, c in brute_components([(i, texts[i]) for i in passed])})
        assert sorted(r["doc_id"] for r in kept["secret scans"].collect()) == sorted(single)
